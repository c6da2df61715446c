"""Acoustic features of one channel in numpy. Pitch, harmonicity, formants and the like follow the usual definitions;
they agree with other implementations to a tolerance only."""

from __future__ import annotations

import numpy as np

from sonoframe.functions.kernels import butterworth_low_pass, mel_spectrogram, mfcc, resample, spectrogram, stft

NAN = float("nan")


def _frames(x, rate, size_sec, step_sec):
    size, step = max(int(round(size_sec * rate)), 2), max(int(round(step_sec * rate)), 1)
    if len(x) < size:
        return np.zeros((0, size)), np.zeros(0)
    f = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
    return f, (np.arange(len(f)) * step + size / 2) / rate


def autocorrelation_pitch(x, rate, floor=75.0, ceiling=500.0, step=0.01, voicing=0.45, silence=0.03):
    """(f0, strength, times) per frame: the best peak of the normalized autocorrelation between the two limits;
    f0 is 0 where a frame is unvoiced."""
    f, t = _frames(x, rate, 3.0 / floor, step)
    if not len(f):
        return np.zeros(0), np.zeros(0), t
    n = f.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(n) + 0.5) / n)
    size = 1 << (2 * n - 1).bit_length()
    acf = lambda m: np.fft.irfft(np.abs(np.fft.rfft(m, size, axis=-1)) ** 2, size, axis=-1)[..., :n]
    r = acf((f - f.mean(1, keepdims=True)) * window)
    r = r / np.maximum(r[:, :1], 1e-20) / np.maximum(acf(window) / (window**2).sum(), 1e-6)
    low, high = max(int(rate / ceiling), 2), min(int(np.ceil(rate / floor)), n // 2)
    if high <= low + 1:
        return np.zeros(len(f)), np.zeros(len(f)), t
    part = r[:, low : high + 1]
    peak = (part[:, 1:-1] >= part[:, :-2]) & (part[:, 1:-1] >= part[:, 2:])
    # peaks lie between the samples: those of short periods would else be too low against their multiples
    a, b, c = part[:, :-2], part[:, 1:-1], part[:, 2:]
    bend = a - 2 * b + c
    shift = np.clip(np.where(np.abs(bend) > 1e-12, 0.5 * (a - c) / np.where(np.abs(bend) > 1e-12, bend, 1), 0), -1, 1)
    height = b - 0.25 * (a - c) * shift
    height = np.where(height > 1, 1 / np.maximum(height, 1), height)
    score = np.where(peak, height - 0.01 * np.log2(np.arange(low + 1, high) * floor / rate + 1), -1)
    best = score.argmax(1)
    rows = np.arange(len(f))
    shift, strength = shift[rows, best], np.clip(height[rows, best], 0, 1)
    peaks = np.abs(f - f.mean(1, keepdims=True)).max(1)
    loud = peaks > silence * max(np.abs(x - x.mean()).max(), 1e-20)
    f0 = rate / (low + 1 + best + shift)
    return np.where(loud & (strength > voicing) & (score[rows, best] > -1), f0, 0.0), strength, t


def pitch_track(x, rate, low=80, high=500):
    """f0 per 10 ms frame, 0 where unvoiced."""
    if low <= 0:
        raise ValueError("the lowest frequency is positive")
    return autocorrelation_pitch(x, rate, low, high)[0]


def pitch_range(x, rate):
    """Limits for further analysis: a wide first track without outliers tells a low voice from a high one."""
    f0 = autocorrelation_pitch(x, rate, 50, 600, 0.005)[0]
    f0 = f0[f0 > 0]
    if len(f0) and f0.std() > 0:
        f0 = f0[np.abs((f0 - f0.mean()) / f0.std()) <= 2]
    low = len(f0) and f0.mean() < 170
    return {"pitch_floor": 60.0 if low else 100.0, "pitch_ceiling": 250.0 if low else 500.0}


def pitch_descriptors(x, rate, floor=75.0, ceiling=500.0, step=0.005, unit="Hertz"):
    f0 = autocorrelation_pitch(x, rate, floor, ceiling, step)[0]
    f0 = f0[f0 > 0]
    if unit == "semitones":
        f0 = 12 * np.log2(f0 / 100)
    return {"mean_f0": float(f0.mean()) if len(f0) else NAN, "std_f0": float(f0.std(ddof=1)) if len(f0) > 1 else NAN}


def intensity(x, rate, floor=75.0, step=0.005):
    """dB above 20 micropascal per frame, Gaussian-weighted."""
    f, t = _frames(x, rate, 3.2 / floor, step)
    if not len(f):
        return np.zeros(0), t
    n = f.shape[1]
    w = np.exp(-12 * ((np.arange(n) + 0.5) / n - 0.5) ** 2)
    power = (((f - f.mean(1, keepdims=True)) ** 2) * w).sum(1) / w.sum()
    return 10 * np.log10(np.maximum(power, 1e-30) / 4e-10), t


def intensity_descriptors(x, rate, floor=75.0, step=0.005):
    db, _ = intensity(x, rate, floor, step)
    if not len(db):
        return {"mean_db": NAN, "std_db": NAN, "range_db_ratio": NAN}
    mean = 10 * np.log10((10 ** (db / 10)).mean())
    return {"mean_db": float(mean), "std_db": float(db.std(ddof=1)) if len(db) > 1 else NAN, "range_db_ratio": float(db.max() / db.min()) if db.min() else NAN}


def harmonicity_descriptors(x, rate, floor=75.0, step=0.005):
    f0, s, _ = autocorrelation_pitch(x, rate, floor, min(rate / 4, 500), step, voicing=0.1)
    s = np.clip(s[f0 > 0], 1e-6, 1 - 1e-6)
    hnr = 10 * np.log10(s / (1 - s))
    return {"mean_hnr_db": float(hnr.mean()) if len(hnr) else NAN, "std_hnr_db": float(hnr.std(ddof=1)) if len(hnr) > 1 else NAN}


def slope_tilt(x, rate):
    """Energy of 50-1000 Hz against 1000-4000 Hz in the long-term spectrum, and its slope per Hz below 5 kHz, in dB."""
    p = np.abs(np.fft.rfft(x)) ** 2 + 1e-20
    f = np.fft.rfftfreq(len(x), 1 / rate)
    band = lambda a, b: p[(f >= a) & (f < b)]
    low, high = band(50, 1000), band(1000, 4000)
    inside = (f > 50) & (f < 5000)
    tilt = np.polyfit(f[inside], 10 * np.log10(p[inside]), 1)[0] if inside.sum() > 1 else NAN
    return {"spectral_slope": float(10 * np.log10(high.mean() / low.mean())) if len(low) and len(high) else NAN, "spectral_tilt": float(tilt)}


def cepstral_peak(x, rate, floor=75.0, ceiling=500.0, step=0.01):
    """Smoothed cepstral peak prominence over voiced frames above 4 dB."""
    f, _ = _frames(x, rate, 0.04, step)
    if not len(f):
        return {"mean_cpp": NAN, "std_cpp": NAN}
    n = f.shape[1]
    spectrum = 10 * np.log10(np.abs(np.fft.rfft(f * np.hanning(n), axis=1)) ** 2 + 1e-20)
    cep = 10 * np.log10(np.abs(np.fft.irfft(spectrum, axis=1)) ** 2 + 1e-20)
    q = np.arange(cep.shape[1]) / rate
    fit, look = (q >= 0.001) & (q <= q[-1] / 2), (q >= 1 / ceiling) & (q <= 1 / floor)
    if look.sum() < 2 or fit.sum() < 2:
        return {"mean_cpp": NAN, "std_cpp": NAN}
    slope, base = np.polyfit(q[fit], cep[:, fit].T, 1)
    at = cep[:, look].argmax(1)
    cpp = cep[:, look].max(1) - (slope * q[look][at] + base)
    cpp = cpp[cpp > 4]
    return {"mean_cpp": float(cpp.mean()) if len(cpp) else NAN, "std_cpp": float(cpp.std()) if len(cpp) else NAN}


def formants(x, rate, floor=75.0, ceiling=500.0, step=0.005, number=5, maximum=5000.0, window=0.025, emphasis=50.0):
    """Means and deviations of the first two formants and their bandwidths over voiced frames (Burg)."""
    names = ["f1_mean", "f1_std", "b1_mean", "b1_std", "f2_mean", "f2_std", "b2_mean", "b2_std"]
    new = int(min(2 * maximum, rate))
    y = resample(x, rate, new) if new != rate else x
    if len(y) < 4:
        return dict.fromkeys(names, NAN)
    y = np.concatenate([[y[0]], y[1:] - np.exp(-2 * np.pi * emphasis / new) * y[:-1]])
    f, t = _frames(y, new, 2 * window, step)
    f0, _, t0 = autocorrelation_pitch(x, rate, floor, ceiling, step)
    if not len(f) or not len(f0):
        return dict.fromkeys(names, NAN)
    voiced = np.interp(t, t0, f0 > 0) > 0.5
    rows = []
    for frame in f[voiced] * np.exp(-12 * ((np.arange(f.shape[1]) + 0.5) / f.shape[1] - 0.5) ** 2):
        roots = np.roots(burg(frame, 2 * number))
        roots = roots[np.imag(roots) > 0]
        hz, width = np.angle(roots) * new / 2 / np.pi, -np.log(np.maximum(np.abs(roots), 1e-12)) * new / np.pi
        keep = np.argsort(hz)
        keep = keep[(hz[keep] > 50) & (hz[keep] < new / 2 - 50)][:2]
        rows.append([*np.column_stack([hz[keep], width[keep]]).ravel(), *[NAN] * 4][:4])
    m = np.array(rows).reshape(-1, 4)
    stat = lambda g, c: float(g(c[~np.isnan(c)])) if (~np.isnan(c)).any() else NAN
    return dict(zip(names, (v for c in m.T for v in (stat(np.mean, c), stat(np.std, c))), strict=True)) if len(m) else dict.fromkeys(names, NAN)


def burg(x, order):
    """Prediction coefficients (1, a1, ...)."""
    f, b, a = x[1:].copy(), x[:-1].copy(), np.array([1.0])
    for _ in range(order):
        bottom = (f * f).sum() + (b * b).sum()
        k = -2 * (f * b).sum() / bottom if bottom > 0 else 0.0
        a = np.concatenate([a, [0.0]]) + k * np.concatenate([[0.0], a[::-1]])
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
    return a


def spectral_moments(x, rate, floor=75.0, ceiling=500.0, window=0.025, step=0.005):
    """Centroid, deviation, skewness and kurtosis of the power spectrum, mean over voiced frames."""
    names = ["spectral_gravity", "spectral_std_dev", "spectral_skewness", "spectral_kurtosis"]
    f, t = _frames(x, rate, window, step)
    f0, _, t0 = autocorrelation_pitch(x, rate, floor, ceiling, step)
    if not len(f) or not len(f0):
        return dict.fromkeys(names, NAN)
    f = f[np.interp(t, t0, f0 > 0) > 0.5]
    if not len(f):
        return dict.fromkeys(names, NAN)
    p = np.abs(np.fft.rfft(f * np.hanning(f.shape[1]), axis=1)) ** 2
    p /= np.maximum(p.sum(1, keepdims=True), 1e-30)
    hz = np.fft.rfftfreq(f.shape[1], 1 / rate)
    mean = p @ hz
    central = lambda k: (p * (hz - mean[:, None]) ** k).sum(1)
    var = np.maximum(central(2), 1e-30)
    return dict(zip(names, (float(v.mean()) for v in (mean, np.sqrt(var), central(3) / var**1.5, central(4) / var**2 - 3)), strict=True))


def pulses(x, rate, floor=75.0, ceiling=500.0):
    """Times and peaks of glottal periods: in voiced stretches the next extreme about a period later."""
    f0, _, t = autocorrelation_pitch(x, rate, floor, ceiling, 0.005)
    runs, at = [], 0
    voiced = np.flatnonzero(np.diff(np.concatenate([[0], (f0 > 0).astype(int), [0]])))
    for a, b in voiced.reshape(-1, 2):
        times, sizes = [], []
        at = t[a]
        while at < t[b - 1]:
            period = 1 / max(np.interp(at, t[a:b], f0[a:b]), 1e-9)
            lo, hi = int((at + (0.8 * period if times else 0)) * rate), int((at + (1.2 if times else 1.0) * period) * rate) + 1
            if hi > len(x) or hi - lo < 1:
                break
            i = lo + int(x[lo:hi].argmax())
            p, q, r = (x[i - 1], x[i], x[i + 1]) if 0 < i < len(x) - 1 else (x[i],) * 3
            shift = 0.5 * (p - r) / (p - 2 * q + r) if abs(p - 2 * q + r) > 1e-12 else 0.0
            if times and (i + shift) / rate <= times[-1]:
                break
            times.append((i + shift) / rate)
            sizes.append(abs(q))
            at = times[-1]
        if len(times) > 2:
            runs.append((np.array(times), np.array(sizes)))
    return runs


def _neighbourhood(values, k):
    """Mean absolute difference of a value from the mean of k around it."""
    half = k // 2
    parts = [np.abs(v[half : len(v) - half] - np.convolve(v, np.ones(k) / k, "valid")) for v in values if len(v) >= k]
    return float(np.concatenate(parts).mean()) if parts else NAN


def jitter(x, rate, floor=75.0, ceiling=500.0):
    periods = [np.diff(t) for t, _ in pulses(x, rate, floor, ceiling)]
    steps = [np.abs(np.diff(p)) for p in periods if len(p) > 1]
    if not steps:
        return dict.fromkeys(["local_jitter", "localabsolute_jitter", "rap_jitter", "ppq5_jitter", "ddp_jitter"], NAN)
    mean, absolute = np.concatenate(periods).mean(), np.concatenate(steps).mean()
    rap = _neighbourhood(periods, 3) / mean
    return {"local_jitter": float(absolute / mean), "localabsolute_jitter": float(absolute), "rap_jitter": rap, "ppq5_jitter": _neighbourhood(periods, 5) / mean, "ddp_jitter": 3 * rap}


def shimmer(x, rate, floor=75.0, ceiling=500.0):
    sizes = [np.maximum(s, 1e-12) for _, s in pulses(x, rate, floor, ceiling)]
    names = ["local_shimmer", "localDB_shimmer", "apq3_shimmer", "apq5_shimmer", "apq11_shimmer", "dda_shimmer"]
    if not sizes:
        return dict.fromkeys(names, NAN)
    mean = np.concatenate(sizes).mean()
    local = np.concatenate([np.abs(np.diff(s)) for s in sizes]).mean() / mean
    db = np.concatenate([np.abs(20 * np.log10(s[1:] / s[:-1])) for s in sizes]).mean()
    a3 = _neighbourhood(sizes, 3) / mean
    return dict(zip(names, map(float, (local, db, a3, _neighbourhood(sizes, 5) / mean, _neighbourhood(sizes, 11) / mean, 3 * a3)), strict=True))


def speech_rate(x, rate):
    """Syllable nuclei (voiced intensity peaks above the floor with a dip of 2 dB between them), pauses of 0.3 s and
    more, and rates per second."""
    names = ["speaking_rate", "articulation_rate", "phonation_ratio", "pause_rate", "mean_pause_duration"]
    db, t = intensity(x, rate, 50, 0.016)
    if not len(db):
        return dict.fromkeys(names, NAN)
    total = len(x) / rate
    level = max(np.percentile(db, 99) - 25, db.min())
    loud = db > level
    edges = np.flatnonzero(np.diff(np.concatenate([[1], loud.astype(int), [1]])))
    pauses = [(b - a) * 0.016 for a, b in edges.reshape(-1, 2) if (b - a) * 0.016 >= 0.3 and a > 0 and b < len(db)]
    f0, _, t0 = autocorrelation_pitch(x, rate, 75, 500, 0.01)
    peaks, dip, last = 0, np.inf, None
    for i in range(1, len(db) - 1):
        dip = min(dip, db[i])
        if db[i] >= db[i - 1] and db[i] > db[i + 1] and loud[i] and (last is None or db[i] - dip > 2):
            if len(f0) and np.interp(t[i], t0, f0 > 0) > 0.5:
                peaks += 1
            last, dip = i, db[i]
    spoken = loud.sum() * 0.016
    return dict(zip(names, map(float, (peaks / total, peaks / spoken if spoken else NAN, min(spoken / total, 1.0), len(pauses) / total, np.mean(pauses) if pauses else 0.0)), strict=True))


def duration(x, rate):
    return {"duration": len(x) / rate}


#: Families of scalar features: name -> (function of channel, rate, floor, ceiling).
FAMILIES = {
    "speech_rate": lambda x, r, lo, hi: speech_rate(x, r),
    "intensity": lambda x, r, lo, hi: intensity_descriptors(x, r, lo),
    "harmonicity": lambda x, r, lo, hi: harmonicity_descriptors(x, r, lo),
    "formants": lambda x, r, lo, hi: formants(x, r, lo, hi),
    "spectral_moments": lambda x, r, lo, hi: spectral_moments(x, r, lo, hi),
    "pitch": lambda x, r, lo, hi: pitch_descriptors(x, r, lo, hi),
    "slope_tilt": lambda x, r, lo, hi: slope_tilt(x, r),
    "cpp": lambda x, r, lo, hi: cepstral_peak(x, r, lo, hi),
    "duration": lambda x, r, lo, hi: duration(x, r),
    "jitter": lambda x, r, lo, hi: jitter(x, r, lo, hi),
    "shimmer": lambda x, r, lo, hi: shimmer(x, r, lo, hi),
}

#: Names of the features of each family (fixed values, the order of the output).
FAMILY_FEATURES = {
    "speech_rate": ["speaking_rate", "articulation_rate", "phonation_ratio", "pause_rate", "mean_pause_duration"],
    "intensity": ["mean_db", "std_db", "range_db_ratio"],
    "harmonicity": ["mean_hnr_db", "std_hnr_db"],
    "formants": ["f1_mean", "f1_std", "b1_mean", "b1_std", "f2_mean", "f2_std", "b2_mean", "b2_std"],
    "spectral_moments": ["spectral_gravity", "spectral_std_dev", "spectral_skewness", "spectral_kurtosis"],
    "pitch": ["mean_f0", "std_f0"],
    "slope_tilt": ["spectral_slope", "spectral_tilt"],
    "cpp": ["mean_cpp", "std_cpp"],
    "duration": ["duration"],
    "jitter": ["local_jitter", "localabsolute_jitter", "rap_jitter", "ppq5_jitter", "ddp_jitter"],
    "shimmer": ["local_shimmer", "localDB_shimmer", "apq3_shimmer", "apq5_shimmer", "apq11_shimmer", "dda_shimmer"],
}

__all__ = ["FAMILIES", "FAMILY_FEATURES", "butterworth_low_pass", "mel_spectrogram", "mfcc", "pitch_range", "pitch_track", "spectrogram", "stft"]
