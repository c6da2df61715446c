"""Metrics of a signal as column expressions over ``channels`` (array of channels, each an array of doubles).

For short signals: higher-order functions need no shuffle and no Python. For long ones the planner takes the
numpy kernels of :mod:`sonoframe.functions.kernels`, which give the same values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonoframe.functions.arrays import absolutes, dot, indices, let, mean, piece, quantile, squares, starts, total

NAN = float("nan")


def _flat(ch: Column) -> Column:
    return F.flatten(ch)


def _centred(x: Column) -> Column:
    """Without the mean, which is computed once."""
    return let(mean(x), lambda mu: F.transform(x, lambda v: v - mu))


def _per_channel(ch: Column, f) -> Column:
    return mean(F.transform(ch, f))


def proportion_silent_metric(ch: Column, t: float = 0.01) -> Column:
    """Share of samples below the threshold in absolute value; 1 for an empty signal."""
    x = _flat(ch)
    return F.coalesce(F.try_divide(F.size(F.filter(x, lambda v: F.abs(v) < t)), F.size(x)), F.lit(1.0))


def _loud(ch: Column, t: float) -> Column:
    """Per time step whether any channel is at the threshold or above."""
    n = F.coalesce(F.size(F.get(ch, F.lit(0))), F.lit(0))
    return F.transform(indices(n), lambda i: F.exists(ch, lambda c: F.abs(F.get(c, i)) >= t))


def proportion_silence_at_beginning_metric(ch: Column, t: float = 0.01) -> Column:
    loud = _loud(ch, t)
    first = F.array_position(loud, F.lit(True))
    return F.when(first > 0, (first - 1) / F.nullif(F.size(loud), F.lit(0))).otherwise(1.0)


def proportion_silence_at_end_metric(ch: Column, t: float = 0.01) -> Column:
    loud = F.reverse(_loud(ch, t))
    first = F.array_position(loud, F.lit(True))
    return F.when(first > 0, (first - 1) / F.nullif(F.size(loud), F.lit(0))).otherwise(1.0)


def amplitude_headroom_metric(ch: Column) -> Column:
    """Room to full scale; null if a sample is beyond it; 1 for an empty signal."""
    x = _flat(ch)
    high, low = F.array_max(x), F.array_min(x)
    return F.when(F.size(x) == 0, 1.0).when((high <= 1) & (low >= -1), F.least(1 - high, 1 + low))


def proportion_clipped_metric(ch: Column, t: float = 1.0) -> Column:
    """Samples at the threshold or above; without any, those close to the largest if more than 3 of them follow each
    other. Mean over channels; 0 for an empty signal."""

    def of(c: Column) -> Column:
        return let(absolutes(c), lambda a: let(F.array_max(a), lambda top: share(a, top)))

    def share(a: Column, top: Column) -> Column:
        close = F.transform(a, lambda v: F.abs(v - top) <= 1e-8 + 1e-5 * F.abs(top))
        step = lambda s, v: F.struct(
            F.when(v, s["run"] + 1).otherwise(0).alias("run"), F.when(v, F.greatest(s["longest"], s["run"] + 1)).otherwise(s["longest"]).alias("longest")
        )
        plateau = lambda c: F.aggregate(c, F.struct(F.lit(0).alias("run"), F.lit(0).alias("longest")), step)["longest"] > 3
        near = let(close, lambda c: F.when(plateau(c), F.size(F.filter(c, lambda v: v))).otherwise(0))
        return F.try_divide(F.when(top >= t, F.size(F.filter(a, lambda v: v >= t))).otherwise(near), F.size(a))

    return F.when(F.size(_flat(ch)) == 0, 0.0).otherwise(_per_channel(ch, of))


def root_mean_square_energy_metric(ch: Column) -> Column:
    return _per_channel(ch, lambda c: F.sqrt(mean(squares(c))))


def zero_crossing_rate_metric(ch: Column) -> Column:
    """Share of neighbours of opposite sign; a zero between them is no crossing."""

    def of(c: Column) -> Column:
        n = F.size(c)
        pairs = F.zip_with(piece(c, F.lit(1), F.greatest(n - 1, F.lit(0))), piece(c, F.lit(0), F.greatest(n - 1, F.lit(0))), lambda x, y: F.signum(x) * F.signum(y) < 0)
        return F.coalesce(F.when(n > 1, F.try_divide(F.size(F.filter(pairs, lambda v: v)), n - 1)), F.lit(NAN))

    return _per_channel(ch, of)


def signal_variance_metric(ch: Column) -> Column:
    """Unbiased variance of all samples; NaN for fewer than two."""
    x = _flat(ch)
    return F.coalesce(F.when(F.size(x) > 1, total(squares(_centred(x))) / F.nullif(F.size(x) - 1, F.lit(0))), F.lit(NAN))


def dynamic_range_metric(ch: Column) -> Column:
    x = _flat(ch)
    return F.coalesce(F.array_max(x) - F.array_min(x), F.lit(0.0))


def mean_absolute_amplitude_metric(ch: Column) -> Column:
    return F.coalesce(mean(absolutes(_flat(ch))), F.lit(NAN))


def mean_absolute_deviation_metric(ch: Column) -> Column:
    return _per_channel(ch, lambda c: mean(absolutes(_centred(c))))


def shannon_entropy_amplitude_metric(ch: Column, bins: int = 256) -> Column:
    """Entropy in bits over equal bins from the smallest to the largest sample, the last bin closed; 0 if constant."""
    def entropy(p: Column) -> Column:
        x, low, high = p["x"], p["low"], p["high"]
        ordered = F.array_sort(F.transform(x, lambda v: F.least(F.floor(F.try_divide(v - low, high - low) * bins), F.lit(bins - 1)).cast("int")))
        # equal bins follow each other: the sum of k log2 k over the runs, the last run still open at the end
        start = F.struct(F.lit(-1).alias("bin"), F.lit(0.0).alias("k"), F.lit(0.0).alias("done"))
        closed = lambda s: s["done"] + F.when(s["k"] > 0, s["k"] * F.log2(s["k"])).otherwise(0.0)
        same = lambda s, b: s["bin"] == b
        step = lambda s, b: F.struct(b.alias("bin"), F.when(same(s, b), s["k"] + 1).otherwise(1.0).alias("k"), F.when(same(s, b), s["done"]).otherwise(closed(s)).alias("done"))
        n = F.size(x).cast("double")
        return F.when(high == low, 0.0).when(n > 0, F.log2(n) - F.aggregate(ordered, start, step, closed) / n)

    x = _flat(ch)
    return let(F.struct(x.alias("x"), F.array_min(x).alias("low"), F.array_max(x).alias("high")), entropy)


def crest_factor_metric(ch: Column) -> Column:
    """Peak over the root mean square of all samples; infinite for silence, NaN for an empty signal."""
    x = _flat(ch)
    rms = F.sqrt(mean(squares(x)))
    return F.when(F.size(x) == 0, NAN).when(rms == 0, float("inf")).otherwise(F.array_max(absolutes(x)) / F.nullif(rms, F.lit(0.0)))


def _moment(x: Column, k: int) -> Column:
    return mean(F.transform(_centred(x), lambda v: F.pow(v, F.lit(k))))


def amplitude_skew_metric(ch: Column) -> Column:
    """Population skewness; NaN for a constant signal."""
    x = _flat(ch)
    return F.coalesce(F.try_divide(_moment(x, 3), F.pow(_moment(x, 2), F.lit(1.5))), F.lit(NAN))


def amplitude_kurtosis_metric(ch: Column) -> Column:
    """Population excess kurtosis; NaN for a constant signal."""
    x = _flat(ch)
    m2 = _moment(x, 2)
    return F.coalesce(F.try_divide(_moment(x, 4), m2 * m2) - 3, F.lit(NAN))


def amplitude_interquartile_range_metric(ch: Column) -> Column:
    x = F.array_sort(_flat(ch))
    return F.coalesce(quantile(x, 0.75) - quantile(x, 0.25), F.lit(NAN))


def phase_correlation_metric(ch: Column, frame: int = 2048, hop: int = 512) -> Column:
    """Mean correlation of the channel pairs, per frame and then over frames; 1 for one channel, 0 where no pair of
    any frame has a correlation (a constant channel has none)."""
    n = F.coalesce(F.size(F.get(ch, F.lit(0))), F.lit(0))
    size = F.when(n < frame, n).otherwise(frame)
    step = F.when(n < frame, F.greatest(F.lit(1), (n / 2).cast("int"))).otherwise(hop)
    begin = F.when(n >= 2, starts(n - size + 1, step)).otherwise(F.array().cast("array<int>"))
    k = F.size(ch)
    pairs = F.flatten(F.transform(indices(k), lambda i: F.transform(F.filter(indices(k), lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))

    def centred(c: Column, at: Column) -> Column:
        return let(piece(c, at, size), _centred)

    def corr(at: Column, p: Column) -> Column:
        both = F.struct(centred(F.get(ch, p["i"]), at).alias("a"), centred(F.get(ch, p["j"]), at).alias("b"))
        return let(both, lambda s: F.try_divide(dot(s["a"], s["b"]), F.sqrt(dot(s["a"], s["a"])) * F.sqrt(dot(s["b"], s["b"]))))

    frames = F.transform(begin, lambda at: mean(F.filter(F.transform(pairs, lambda p: corr(at, p)), lambda r: r.isNotNull())))
    return F.when(k < 2, 1.0).otherwise(F.coalesce(mean(F.filter(frames, lambda r: r.isNotNull())), F.lit(0.0)))
