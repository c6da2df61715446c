"""Metrics of clips: one pass over each signal for all that is asked for.

Three groups of metrics: of the signal (``channels``), by higher-order functions or by one Arrow kernel that computes
all of them in a single read; and of the speech in it, by aggregates over script lines.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.functions import kernels, signal
from sonoframe.functions.arrow import arrow_column, doubles, signals
from sonoframe.operators.diarization import speech_metrics

#: Metrics that have a column expression.
COLUMNS = {n: f for n, f in vars(signal).items() if n.endswith("_metric")}

#: Metrics of a signal that only a kernel computes.
KERNEL_ONLY = tuple(n for n in kernels.METRICS if n not in COLUMNS)

#: Metrics of a clip's script lines.
SPEECH = ("primary_speaker_ratio_metric", "voice_activity_detection_metric", "voice_signal_to_noise_power_ratio_metric")

ALL = (*kernels.METRICS, *SPEECH)


def kernel_struct(names: Iterable[str], channels: Column) -> Column:
    """One struct column with the named metrics, computed by numpy in Arrow batches. A metric that fails is null."""
    names = list(names)

    def run(ch):
        rows = [[None] * len(names) if w is None else [_safe(kernels.METRICS[n], w) for n in names] for w in signals(ch)]
        return doubles(rows, names)

    return arrow_column(run, ", ".join(f"{n} double" for n in names), channels)


def _safe(f, w):
    try:
        return f(w)
    except (ValueError, ZeroDivisionError, IndexError):
        return None


def with_metrics(clips: DataFrame, names: Iterable[str], lines: DataFrame | None = None, route: str = "kernel") -> DataFrame:
    """``clips`` (clip_id, sampling_rate, channels, ...) with a column per named metric.

    ``route`` is ``kernel`` (one Arrow pass, for recordings) or ``columns`` (higher-order functions, for signals of up
    to a few thousand samples; metrics without a column expression still go through the kernel). ``lines`` (clip_id,
    speaker, start_sec, end_sec) is needed for metrics of speech, else they are null. Unknown names raise.
    """
    names = list(dict.fromkeys(names))
    unknown = [n for n in names if n not in ALL]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    own = [n for n in names if n not in SPEECH]
    native = [n for n in own if route == "columns" and n in COLUMNS]
    by_kernel = [n for n in own if n not in native]
    df = clips
    if by_kernel:
        df = df.withColumn("_kernel", kernel_struct(by_kernel, F.col("channels"))).select("*", *[F.col(f"_kernel.{n}").alias(n) for n in by_kernel]).drop("_kernel")
    if native:
        df = df.withColumns({n: COLUMNS[n](F.col("channels")) for n in native})
    speech = [n for n in names if n in SPEECH]
    if speech:
        if lines is None:
            df = df.withColumns({n: F.lit(None).cast("double") for n in speech})
        else:
            df = speech_metrics(df, lines, speech)
    return df
