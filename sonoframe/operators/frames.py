"""Cutting, windowing and joining of signals. Clips have clip_id, sampling_rate and channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.functions.arrays import indices, mean, piece, starts


def n_samples(channels: Column) -> Column:
    """Samples per channel; 0 without channels."""
    return F.coalesce(F.size(F.get(channels, F.lit(0))), F.lit(0))


def cut(channels: Column, start: Column, size: Column | int) -> Column:
    return F.transform(channels, lambda c: piece(c, start, size))


def downmix(clips: DataFrame) -> DataFrame:
    """One channel, the mean of all."""
    ch = F.col("channels")
    mono = F.transform(indices(n_samples(ch)), lambda i: mean(F.transform(ch, lambda c: F.get(c, i))))
    return clips.withColumn("channels", F.array(mono))


def select_channel(clips: DataFrame, index: int) -> DataFrame:
    """Only the channel ``index`` (from 0); a clip without it raises."""
    ok = F.assert_true(F.lit(index >= 0) & (F.size("channels") > index), F.lit(f"no channel {index}")).isNull()
    return clips.withColumn("channels", F.when(ok, F.array(F.get("channels", F.lit(index)))))


def sliding_windows(clips: DataFrame, window: Column | int, step: Column | int, clip_ends: bool = False) -> DataFrame:
    """A row per window: clips' columns, window_index, start_sample, end_sample and the window's channels.

    Windows begin at 0, step, ... below the length, so there are ceil(n / step); the last ones are short. end_sample
    is start + window, or, with ``clip_ends``, no more than the length. An empty clip has no window. Sizes in samples.
    """
    win = F.lit(window) if isinstance(window, int) else window
    rows = clips.withColumn("_n", n_samples(F.col("channels"))).withColumn("_win", win)
    rows = rows.select("*", F.posexplode(starts(F.col("_n"), step)).alias("window_index", "start_sample"))
    end = F.col("start_sample") + F.col("_win")
    return (
        rows.withColumn("end_sample", F.least(end, "_n") if clip_ends else end)
        .withColumn("channels", cut(F.col("channels"), F.col("start_sample"), F.col("_win")))
        .drop("_n", "_win")
    )


def windows_in_seconds(clips: DataFrame, window_sec: float, step_sec: float, at_least_one: bool = False, clip_ends: bool = False) -> DataFrame:
    """:func:`sliding_windows` with sizes in seconds, cut to whole samples (at least one sample if ``at_least_one``),
    and window_start, window_end in seconds."""
    size = lambda s: (F.greatest((F.col("sampling_rate") * s).cast("int"), F.lit(1)) if at_least_one else (F.col("sampling_rate") * s).cast("int"))
    rows = sliding_windows(clips, size(window_sec), size(step_sec), clip_ends)
    return rows.withColumns({"window_start": F.col("start_sample") / F.col("sampling_rate"), "window_end": F.col("end_sample") / F.col("sampling_rate")})


def full_frames(clips: DataFrame, frame: int, hop: int) -> DataFrame:
    """A row per whole frame: starts at 0, hop, ... as long as the frame fits."""
    rows = clips.withColumn("_n", n_samples(F.col("channels"))).where(F.col("_n") >= frame)
    rows = rows.select("*", F.posexplode(F.sequence(F.lit(0), F.col("_n") - frame, F.lit(hop))).alias("window_index", "start_sample"))
    return rows.withColumn("channels", cut(F.col("channels"), F.col("start_sample"), frame)).drop("_n")


def even_segments(clips: DataFrame, seconds: float, pad_last: bool = True) -> DataFrame:
    """Segments of round(seconds * rate) samples (one at least), with segment_index; the last one is zero-padded or
    short. An empty clip is its own single segment."""
    seg = F.greatest(F.rint(F.col("sampling_rate") * F.lit(seconds)).cast("int"), F.lit(1))
    rows = clips.withColumn("_seg", seg).withColumn("_n", n_samples(F.col("channels")))
    at = F.when(F.col("_n") == 0, F.array(F.lit(0))).otherwise(starts(F.col("_n"), F.col("_seg")))
    rows = rows.select("*", F.posexplode(at).alias("segment_index", "_at"))
    rows = rows.withColumn("channels", cut(F.col("channels"), F.col("_at"), F.col("_seg")))
    if pad_last:
        rows = rows.withColumn("channels", F.when(F.col("_n") > 0, padded(F.col("channels"), F.col("_seg"))).otherwise(F.col("channels")))
    return rows.drop("_seg", "_n", "_at")


def padded(channels: Column, size: Column | int) -> Column:
    """Zeros at the right up to ``size`` samples; longer channels stay as they are."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.transform(channels, lambda c: F.concat(c, F.array_repeat(F.lit(0.0), F.greatest(size - F.size(c), F.lit(0)).cast("int"))))


def pad(clips: DataFrame, samples: int) -> DataFrame:
    return clips.withColumn("channels", padded(F.col("channels"), samples))


def extract_segments(clips: DataFrame, segments: DataFrame, strict: bool = False) -> DataFrame:
    """A row per row of ``segments`` (clip_id, start_sec, end_sec, ...): the samples int(start rate) .. int(end rate).

    A start below 0 or an end after the clip raises; ``strict`` also refuses a start that isn't before the end. Segments
    of unknown clips and those with a null time have no row.
    """
    rows = clips.join(segments.where("start_sec IS NOT NULL AND end_sec IS NOT NULL"), "clip_id")
    rate, n = F.col("sampling_rate"), n_samples(F.col("channels"))
    ok = (F.col("start_sec") >= 0) & (F.col("end_sec") <= n / rate)
    if strict:
        ok = ok & (F.col("start_sec") < F.col("end_sec"))
    fine = F.assert_true(ok, F.lit("segment outside its clip")).isNull()
    first = (F.col("start_sec") * rate).cast("int")
    size = F.greatest((F.col("end_sec") * rate).cast("int") - first, F.lit(0))
    return rows.withColumn("channels", F.when(fine, cut(F.col("channels"), first, size)))


def chunk(clips: DataFrame, spans: DataFrame) -> DataFrame:
    """:func:`extract_segments` of one span per clip, start before end, with segment_start and segment_end."""
    return extract_segments(clips, spans, strict=True).withColumnsRenamed({"start_sec": "segment_start", "end_sec": "segment_end"})


def concatenate(clips: DataFrame, group: str, order: str) -> DataFrame:
    """``group``, sampling_rate, channels: the clips of each group one after the other by ``order``. Different rates or
    numbers of channels in a group raise. The result is one row per group, so a group has to fit into one."""
    rows = clips.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("channels").alias("c")))).alias("parts"),
        F.min("sampling_rate").alias("sampling_rate"), F.max("sampling_rate").alias("_r"),
        F.min(F.size("channels")).alias("_k"), F.max(F.size("channels")).alias("_k2"),
    )
    same = F.assert_true((F.col("sampling_rate") == F.col("_r")) & (F.col("_k") == F.col("_k2")), F.lit("clips of a group differ in rate or channels")).isNull()
    joined = F.transform(indices(F.col("_k")), lambda i: F.flatten(F.transform("parts", lambda p: F.get(p["c"], i))))
    return rows.select(group, "sampling_rate", F.when(same, joined).alias("channels"))


def pad_to_longest(clips: DataFrame, batch: str) -> DataFrame:
    """Clips of each batch zero-padded to its longest; a batch with different numbers of channels raises."""
    longest = clips.groupBy(batch).agg(F.max(n_samples(F.col("channels"))).alias("_to"), F.min(F.size("channels")).alias("_a"), F.max(F.size("channels")).alias("_b"))
    rows = clips.join(longest, batch)
    same = F.assert_true(F.col("_a") == F.col("_b"), F.lit("clips of a batch differ in channels")).isNull()
    return rows.withColumn("channels", F.when(same, padded(F.col("channels"), F.col("_to")))).drop("_to", "_a", "_b")


def unbatch(batches: DataFrame, column: str = "items") -> DataFrame:
    """A row per element of an array column, with its position ``ord``."""
    others = [c for c in batches.columns if c != column]
    return batches.select(*others, F.posexplode(column).alias("ord", "item"))


#: Rows of one range when rows are numbered, about.
RANGE_ROWS = 1_000_000


def numbered(df: DataFrame, order: str, name: str = "_no", ranges: int | None = None) -> DataFrame:
    """Rows numbered from 0 by ``order``, nulls first, ties in no set order. Rows are numbered within ranges of the
    key, and a range's start is the number of rows in the ranges before it, so no task sees all rows. There are as many
    ranges as the rows need (RANGE_ROWS each), or as the session has shuffle partitions."""
    from sonoframe.plans.durable import durable

    if ranges is None:
        ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    placed = df.repartitionByRange(ranges, order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id())
    placed = durable(placed.withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_k"))
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sizes.select("_range", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


def in_at_most(df: DataFrame, n_batches: int, order: str) -> DataFrame:
    """With batch_no: at most ``n_batches`` batches of ceil(rows / n) rows in order; there may be fewer batches."""
    if n_batches < 1:
        raise ValueError("at least one batch")
    rows = numbered(df, order)
    total = rows.agg(F.count("*").alias("_total"))  # one row
    size = F.greatest(F.ceil(F.col("_total") / F.least(F.lit(n_batches), F.greatest("_total", F.lit(1)))), F.lit(1))
    return rows.join(F.broadcast(total), F.lit(True)).withColumn("batch_no", F.floor(F.col("_no") / size).cast("int")).drop("_no", "_total")


def in_batches_of(df: DataFrame, size: int, order: str) -> DataFrame:
    """With batch_no: batches of ``size`` rows in order."""
    if size < 1:
        raise ValueError("batches hold at least one row")
    return numbered(df, order).withColumn("batch_no", F.floor(F.col("_no") / size).cast("int")).drop("_no")


def resample(clips: DataFrame, rate: int, low_cut: float | None = None, order: int = 4) -> DataFrame:
    """At another rate: zero-phase low-pass, then windowed sinc; ceil(n rate / old) samples. Values match other
    resamplers to a tolerance only."""
    import pandas as pd

    def run(ch: pd.Series, old: pd.Series) -> pd.Series:
        import numpy as np

        from sonoframe.functions import kernels

        return pd.Series([None if c is None else [kernels.resample(np.asarray(x, dtype="float64"), int(o), rate, low_cut, order).tolist() for x in c] for c, o in zip(ch, old, strict=True)])

    run.__annotations__ = {"ch": pd.Series, "old": pd.Series, "return": pd.Series}
    return clips.withColumn("channels", F.pandas_udf(run, "array<array<double>>")("channels", "sampling_rate")).withColumn("sampling_rate", F.lit(rate))


def pool(vectors: DataFrame, key: str, column: str, how: str = "mean", over: str = "rows") -> DataFrame:
    """Mean, minimum or maximum of the vectors of each ``key``: over its rows (a vector per key, element by element,
    partly aggregated before the shuffle) or over the elements of each row (``over="elements"``, a number per row)."""
    if how not in ("mean", "min", "max"):
        raise ValueError(f"unknown pooling {how!r}")
    if over == "elements":
        f = {"mean": mean, "min": F.array_min, "max": F.array_max}[how]
        return vectors.withColumn("pooled", f(F.col(column)))
    f = {"mean": F.avg, "min": F.min, "max": F.max}[how]
    parts = vectors.select(key, F.posexplode(column).alias("_i", "_x")).groupBy(key, "_i").agg(f("_x").alias("_x"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"])
    return parts.groupBy(key).agg(rows.alias("pooled"))
