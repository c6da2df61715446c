"""Streams of chunks of signals. Every operator here also takes a batch, and then gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.functions.arrays import piece, starts
from sonoframe.operators.frames import n_samples
from sonoframe.plans.durable import scratch


def chunks(clips: DataFrame, seconds: float = 1.0) -> DataFrame:
    """A row per chunk of ``seconds`` (the last one short) with chunk_no; the metadata goes along."""
    size = F.greatest((F.col("sampling_rate") * seconds).cast("int"), F.lit(1))
    rows = clips.withColumn("_size", size).select("*", F.posexplode(starts(n_samples(F.col("channels")), F.col("_size"))).alias("chunk_no", "_at"))
    return rows.withColumn("channels", F.transform("channels", lambda c: piece(c, F.col("_at"), F.col("_size")))).drop("_at", "_size")


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files that appear in ``path``."""
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def _timely(rows: DataFrame, at: str, late: str | None) -> tuple[DataFrame, str]:
    """With a watermark if asked for, and the type of times. Watermarks need a time with a zone, so one without is taken
    to be in the session's; results have the type that came."""
    kind = dict(rows.dtypes)[at]
    if not late:
        return rows, kind
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late), kind


def event_windows(events: DataFrame, key: str, at: str, value: str, size: str, step: str | None = None, late: str | None = None) -> DataFrame:
    """key, window_start, window_end, n, total, low, high per tumbling (no step) or sliding window; with ``late`` rows
    later than that behind the newest are dropped and old windows are let go."""
    rows, kind = _timely(events, at, late)
    out = rows.groupBy(key, F.window(at, size, step).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(key, F.col("w.start").cast(kind).alias("window_start"), F.col("w.end").cast(kind).alias("window_end"), "n", "total", "low", "high")


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str | None = None) -> DataFrame:
    """key, session_start, session_end, n: events no further apart than ``gap``."""
    rows, kind = _timely(events, at, late)
    out = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast(kind).alias("session_start"), F.col("w.end").cast(kind).alias("session_end"), "n")


STATE = "n bigint, total double, squares double, low double, high double, crossings bigint, last double, last_no bigint"
RUNNING = "clip_id string, n bigint, mean_square double, low double, high double, zero_crossing_rate double"


def running_metrics(stream: DataFrame) -> DataFrame:
    """clip_id, n, mean_square, low, high, zero_crossing_rate after each trigger, for streams of (clip_id, chunk_no,
    samples). The state of a clip is eight numbers, so clips may be endless. Chunks of a clip come in order of chunk_no;
    one that was counted already is ignored."""

    def step(key: tuple, parts: Iterator, state) -> Iterator:
        import numpy as np
        import pandas as pd

        n, total, squares, low, high, crossings, last, last_no = state.get if state.exists else (0, 0.0, 0.0, float("inf"), float("-inf"), 0, 0.0, -1)
        rows = pd.concat(list(parts)).sort_values("chunk_no", kind="stable")
        for no, samples in zip(rows["chunk_no"], rows["samples"], strict=True):
            x = np.asarray(samples, dtype="float64")
            if no <= last_no or not len(x):
                continue
            before = np.concatenate([[last] if n else [], x])
            crossings += int((np.sign(before[1:]) * np.sign(before[:-1]) < 0).sum())
            n, total, squares = n + len(x), total + float(x.sum()), squares + float((x * x).sum())
            low, high, last, last_no = min(low, float(x.min())), max(high, float(x.max())), float(x[-1]), int(no)
        state.update((n, total, squares, low, high, crossings, last, last_no))
        yield pd.DataFrame([(key[0], n, squares / n if n else None, low, high, crossings / (n - 1) if n > 1 else None)], columns=[c.split()[0] for c in RUNNING.split(", ")])

    return stream.groupBy("clip_id").applyInPandasWithState(step, RUNNING, STATE, "update", "NoTimeout")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, and gives its result: all batches together, or the last one in ``complete``
    mode. State and results lie in the shared folder; a batch that is repeated replaces what it wrote."""
    spark = stream.sparkSession
    place = scratch(spark, "stream")

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/rows/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows").select(*stream.columns)
