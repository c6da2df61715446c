"""Numpy kernels: metrics and features of one signal, given as an array (channels, samples) of doubles."""

from __future__ import annotations

import numpy as np


def proportion_silent_metric(w, t=0.01):
    return float((np.abs(w) < t).mean()) if w.size else 1.0


def proportion_silence_at_beginning_metric(w, t=0.01):
    loud = np.flatnonzero((np.abs(w) >= t).any(axis=0)) if w.size else []
    return float(loud[0] / w.shape[1]) if len(loud) else 1.0


def proportion_silence_at_end_metric(w, t=0.01):
    loud = np.flatnonzero((np.abs(w) >= t).any(axis=0)) if w.size else []
    return float((w.shape[1] - loud[-1] - 1) / w.shape[1]) if len(loud) else 1.0


def amplitude_headroom_metric(w):
    if not w.size:
        return 1.0
    high, low = w.max(), w.min()
    return None if high > 1 or low < -1 else float(min(1 - high, 1 + low))


def longest_run(mask) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def proportion_clipped_metric(w, t=1.0):
    if not w.size:
        return 0.0
    shares = []
    for a in np.abs(w):
        close = np.isclose(a, a.max())
        shares.append((a >= t).mean() if a.max() >= t else close.mean() if longest_run(close) > 3 else 0.0)
    return float(np.mean(shares))


def root_mean_square_energy_metric(w):
    return float(np.sqrt((w * w).mean(axis=1)).mean()) if w.size else None


def zero_crossing_rate_metric(w):
    return float((np.sign(w[:, 1:]) * np.sign(w[:, :-1]) < 0).mean(axis=1).mean()) if w.shape[1] > 1 else float("nan")


def signal_variance_metric(w):
    return float(w.var(ddof=1)) if w.size > 1 else float("nan")


def dynamic_range_metric(w):
    return float(w.max() - w.min()) if w.size else 0.0


def mean_absolute_amplitude_metric(w):
    return float(np.abs(w).mean()) if w.size else float("nan")


def mean_absolute_deviation_metric(w):
    return float(np.abs(w - w.mean(axis=1, keepdims=True)).mean(axis=1).mean()) if w.size else None


def shannon_entropy_amplitude_metric(w, bins=256):
    if not w.size:
        return None
    x = w.ravel()
    low, high = x.min(), x.max()
    if low == high:
        return 0.0
    counts = np.bincount(np.minimum(np.floor((x - low) / (high - low) * bins), bins - 1).astype(int))
    p = counts[counts > 0] / x.size
    return float(-(p * np.log2(p)).sum())


def crest_factor_metric(w):
    if not w.size:
        return float("nan")
    rms = np.sqrt((w * w).mean())
    return float("inf") if rms == 0 else float(np.abs(w).max() / rms)


def _standard_moment(w, k):
    if not w.size:
        return float("nan")
    d = w.ravel() - w.mean()
    m2 = (d * d).mean()
    return float((d**k).mean() / m2 ** (k / 2)) if m2 > 0 else float("nan")


def amplitude_skew_metric(w):
    return _standard_moment(w, 3)


def amplitude_kurtosis_metric(w):
    return _standard_moment(w, 4) - 3


def amplitude_interquartile_range_metric(w):
    return float(np.subtract(*np.percentile(w, [75, 25]))) if w.size else float("nan")


def phase_correlation_metric(w, frame=2048, hop=512):
    k, n = w.shape
    if k < 2:
        return 1.0
    if n < frame:
        frame, hop = n, max(1, n // 2)
    means = []
    for at in range(0, n - frame + 1, hop) if frame >= 2 else ():
        part = w[:, at : at + frame] - w[:, at : at + frame].mean(axis=1, keepdims=True)
        norms = np.sqrt((part * part).sum(axis=1))
        i, j = np.triu_indices(k, 1)
        scale = norms[i] * norms[j]
        ok = scale > 0
        if ok.any():
            means.append(((part[i] * part[j]).sum(axis=1)[ok] / scale[ok]).mean())
    return float(np.mean(means)) if means else 0.0


# spectra


def stft(x, n_fft, win, hop, padding="constant"):
    """Centered short-time Fourier transform with a periodic Hann window: (bins, frames), complex."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / win)
    window = np.pad(window, ((n_fft - win) // 2, n_fft - win - (n_fft - win) // 2))
    mode = padding if padding == "constant" or len(x) > n_fft // 2 else "constant"
    padded = np.pad(x, n_fft // 2, mode=mode)
    if len(padded) < n_fft:
        return np.zeros((n_fft // 2 + 1, 0), dtype=complex)
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    return np.fft.rfft(frames * window, axis=1).T


def spectrogram(x, n_fft=1024, win=None, hop=None):
    """Power spectrogram (n_fft / 2 + 1, frames)."""
    win = win or n_fft
    return np.abs(stft(x, n_fft, win, hop or win // 2, "reflect")) ** 2


def mel_matrix(rate, n_fft, n_mels=128, low=0.0, high=None):
    """Triangular filters on the HTK mel scale: (n_mels, bins)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(low), mel(high or rate / 2), n_mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (f - points[:-2, None]) / np.maximum(points[1:-1] - points[:-2], 1e-12)[:, None]
    down = (points[2:, None] - f) / np.maximum(points[2:] - points[1:-1], 1e-12)[:, None]
    return np.maximum(0, np.minimum(up, down))


def mel_spectrogram(x, rate, n_fft=1024, win=None, hop=None, n_mels=128):
    return mel_matrix(rate, n_fft, n_mels) @ spectrogram(x, n_fft, win, hop)


def power_to_db(s, ref=1.0, amin=1e-10, top_db=80.0):
    db = 10 * np.log10(np.maximum(amin, s)) - 10 * np.log10(max(amin, ref))
    return np.maximum(db, db.max() - top_db) if db.size else db


def mfcc(x, rate, n_mfcc=40, n_fft=400, win=None, hop=None, n_mels=128):
    logs = power_to_db(mel_spectrogram(x, rate, n_fft, win, hop, n_mels))
    k = np.arange(n_mels)
    basis = np.cos(np.pi / n_mels * (k + 0.5) * np.arange(n_mfcc)[:, None]) * np.sqrt(2 / n_mels)
    basis[0] *= np.sqrt(0.5)
    return basis @ logs


def _noise_floor(w, frame, hop, percentile):
    magnitude = np.abs(stft(w.mean(axis=0), frame, frame, hop))
    return magnitude, np.percentile(magnitude, percentile, axis=1)


def spectral_gating_snr_metric(w, frame=2048, hop=512, percentile=10):
    if not w.size:
        return None
    magnitude, floor = _noise_floor(w, frame, hop, percentile)
    return float((10 * np.log10(((magnitude**2).mean(axis=1) + 1e-10) / (floor**2 + 1e-10))).mean())


def peak_snr_from_spectral_metric(w, frame=2048, hop=512, percentile=10):
    if not w.size:
        return float("nan")
    _, floor = _noise_floor(w, frame, hop, percentile)
    peak = np.abs(w.mean(axis=0)).max()
    with np.errstate(divide="ignore"):
        return float(20 * np.log10(peak / np.sqrt((floor**2).mean() + 1e-10)))


def envelope(x):
    """Magnitude of the analytic signal."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * gain))


def amplitude_modulation_depth_metric(w):
    if not w.size:
        return float("nan")
    envelopes = [envelope(c) for c in w]
    return float(np.mean([(e.max() - e.min()) / (e.max() + e.min() + 1e-10) for e in envelopes]))


def butterworth_low_pass(x, cut, rate, order=4):
    """Zero-phase low-pass with the squared magnitude of a Butterworth filter, applied to the spectrum."""
    if not len(x):
        return x
    padded = np.concatenate([2 * x[0] - x[: min(len(x), 256)][::-1], x, 2 * x[-1] - x[-min(len(x), 256) :][::-1]])
    skip = min(len(x), 256)
    f = np.fft.rfftfreq(len(padded), 1 / rate)
    warped = np.tan(np.pi * np.minimum(f, rate / 2 * 0.999999) / rate) / np.tan(np.pi * min(cut, rate / 2 * 0.999) / rate)
    return np.fft.irfft(np.fft.rfft(padded) / (1 + warped ** (2 * order)), len(padded))[skip : skip + len(x)]


def resample(x, old, new, low_cut=None, order=4):
    """Low-pass and windowed-sinc resampling of one channel to ceil(n new / old) samples."""
    size = -(-len(x) * new // old)
    if not len(x) or old == new:
        return x
    x = butterworth_low_pass(x, low_cut or min(new, old) / 2 - min(100, new / 8), old, order)
    scale = min(1.0, new / old)
    at = np.arange(size) * old / new
    reach = int(np.ceil(16 / scale))
    taps = np.arange(-reach, reach + 1)
    near = np.floor(at).astype(int)[:, None] + taps
    distance = at[:, None] - near
    weights = np.sinc(distance * scale) * scale * (0.5 + 0.5 * np.cos(np.pi * np.clip(distance / (reach + 1), -1, 1)))
    inside = (near >= 0) & (near < len(x))
    return (np.where(inside, x[np.clip(near, 0, len(x) - 1)], 0) * weights).sum(axis=1)


def cross_correlation(a, b):
    """Full normalized cross-correlation; none for an empty or silent signal."""
    scale = np.sqrt((a * a).sum() * (b * b).sum()) if len(a) and len(b) else 0
    return np.correlate(a, b, mode="full") / scale if scale > 0 else None


METRICS = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "").endswith("_metric")}
