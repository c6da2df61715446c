"""Acoustic features of clips. The first channel after a downmix counts; a feature that fails is NaN."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.functions.arrow import arrow_column, doubles, signals
from sonoframe.functions.features import FAMILIES, FAMILY_FEATURES

#: Families of the health preset: no duration, jitter and shimmer.
HEALTH = tuple(f for f in FAMILIES if f not in ("duration", "jitter", "shimmer"))

MATRIX = "array<array<double>>"


def _matrix_udf(kernel, channels: Column, rate: Column) -> Column:
    """An array of rows per clip; NaN in a single cell where the kernel fails."""
    def run(ch, hz):
        import numpy as np
        import pyarrow as pa

        out = []
        for w, r in zip(signals(ch), hz.to_pylist(), strict=True):
            if w is None:
                out.append(None)
                continue
            try:
                out.append(np.atleast_2d(kernel(w.mean(axis=0), int(r))).tolist())
            except (ValueError, IndexError, ZeroDivisionError):
                out.append([[float("nan")]])
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    return arrow_column(run, MATRIX, channels, rate)


def spectrogram(clips: DataFrame, n_fft: int = 1024, win: int | None = None, hop: int | None = None) -> DataFrame:
    """With spectrogram: power, n_fft / 2 + 1 bins by frames."""
    from sonoframe.functions import kernels

    return clips.withColumn("spectrogram", _matrix_udf(lambda x, r: kernels.spectrogram(x, n_fft, win, hop), F.col("channels"), F.col("sampling_rate")))


def mel_spectrogram(clips: DataFrame, n_fft: int = 1024, win: int | None = None, hop: int | None = None, n_mels: int = 128) -> DataFrame:
    from sonoframe.functions import kernels

    return clips.withColumn("mel_spectrogram", _matrix_udf(lambda x, r: kernels.mel_spectrogram(x, r, n_fft, win, hop, n_mels), F.col("channels"), F.col("sampling_rate")))


def mfcc(clips: DataFrame, n_mfcc: int = 40, n_fft: int = 400, win: int | None = None, hop: int | None = None, n_mels: int = 128) -> DataFrame:
    from sonoframe.functions import kernels

    return clips.withColumn("mfcc", _matrix_udf(lambda x, r: kernels.mfcc(x, r, n_mfcc, n_fft, win, hop, n_mels), F.col("channels"), F.col("sampling_rate")))


def mel_of_spectrograms(spectrograms: DataFrame, rate: int, n_mels: int = 128) -> DataFrame:
    """With mel_filter_bank: the mel filters applied to the column ``spectrogram``."""
    import pandas as pd

    def run(s: pd.Series) -> pd.Series:
        import numpy as np

        from sonoframe.functions import kernels

        return pd.Series([None if m is None else (kernels.mel_matrix(rate, 2 * (len(m) - 1), n_mels) @ np.stack([np.asarray(r) for r in m])).tolist() for m in s])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return spectrograms.withColumn("mel_filter_bank", F.pandas_udf(run, MATRIX)("spectrogram"))


def pitch(clips: DataFrame, low: int = 80, high: int = 500) -> DataFrame:
    """With pitch: f0 per 10 ms, 0 where unvoiced. ``low`` is positive."""
    if low <= 0:
        raise ValueError("the lowest frequency is positive")
    from sonoframe.functions import features as f

    return clips.withColumn("pitch", F.get(_matrix_udf(lambda x, r: f.pitch_track(x, r, low, high), F.col("channels"), F.col("sampling_rate")), F.lit(0)))


def to_db(power: Column, top_db: float = 80.0) -> Column:
    """Decibels of an array of powers, no lower than ``top_db`` under the largest; in the JVM."""
    from sonoframe.functions.arrays import let

    db = F.transform(power, lambda x: F.lit(10.0) * F.log10(F.greatest(x, F.lit(1e-10))))
    return let(db, lambda a: let(F.array_max(a) - top_db, lambda low: F.transform(a, lambda x: F.greatest(x, low))))


def voice_features(clips: DataFrame, families: Iterable[str] = tuple(FAMILIES)) -> DataFrame:
    """With features: a struct of a double per feature of the families; limits of pitch are found once per clip and
    shared. The schema follows from the families alone. No families: an empty map."""
    families = [f for f in FAMILIES if f in set(families)]
    if not families:
        return clips.withColumn("features", F.create_map().cast("map<string,double>"))
    names = [n for f in families for n in FAMILY_FEATURES[f]]
    def run(ch, hz):
        import numpy as np

        from sonoframe.functions import features as f

        rows = []
        for w, r in zip(signals(ch), hz.to_pylist(), strict=True):
            found = dict.fromkeys(names, float("nan"))
            if w is not None and w.shape[1]:
                x = w.mean(axis=0)
                with np.errstate(all="ignore"):
                    try:
                        limits = f.pitch_range(x, int(r))
                    except (ValueError, IndexError):
                        limits = {"pitch_floor": 75.0, "pitch_ceiling": 500.0}
                    for family in families:
                        try:
                            found |= f.FAMILIES[family](x, int(r), limits["pitch_floor"], limits["pitch_ceiling"])
                        except (ValueError, IndexError, ZeroDivisionError, np.linalg.LinAlgError):
                            pass
            rows.append([found[n] for n in names])
        return doubles(rows, names)

    schema = ", ".join(f"{n} double" for n in names)
    return clips.withColumn("features", arrow_column(run, schema, F.col("channels"), F.col("sampling_rate")))


def health_measurements(clips: DataFrame) -> DataFrame:
    return voice_features(clips, HEALTH)


def extract_features(clips: DataFrame, voice: bool | Iterable[str] = True, spectral: bool = True) -> DataFrame:
    """clip_id and a struct column per enabled group (``voice``, ``spectral``); none enabled gives clip_id alone.
    Groups are columns of their own, so a query that reads one computes only that."""
    rows, keep = clips, ["clip_id"]
    if voice:
        rows = voice_features(rows, FAMILIES if voice is True else voice).withColumnRenamed("features", "voice")
        keep.append("voice")
    if spectral:
        rows = mfcc(pitch(mel_spectrogram(spectrogram(rows)))).withColumn("spectral", F.struct("spectrogram", "mel_spectrogram", "mfcc", "pitch"))
        keep.append("spectral")
    return rows.select(*keep)


#: Phonemes of a posteriorgram, in the order of its columns (fixed values).
PHONEMES = (
    "aa",
    "ae",
    "ah",
    "ao",
    "aw",
    "ay",
    "b",
    "ch",
    "d",
    "dh",
    "eh",
    "er",
    "ey",
    "f",
    "g",
    "hh",
    "ih",
    "iy",
    "jh",
    "k",
    "l",
    "m",
    "n",
    "ng",
    "ow",
    "oy",
    "p",
    "r",
    "s",
    "sh",
    "t",
    "th",
    "uh",
    "uw",
    "v",
    "w",
    "y",
    "z",
    "zh",
    "<silent>",
)


def frame_major(m: Column, n_phonemes: int = len(PHONEMES)) -> Column:
    """Rows of frames: exchanged if only the rows are as many as phonemes, or, if neither or both are, if there are
    fewer rows than columns."""
    from sonoframe.functions.arrays import transposed

    a, b = F.size(m), F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0))
    turn = F.when((a == n_phonemes) & (b != n_phonemes), True).when((b == n_phonemes) & (a != n_phonemes), False).otherwise(a < b)
    return F.when(turn, transposed(m)).otherwise(m)


def phoneme_segments(rows: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """clip_id, phoneme_index, phoneme, start_frame, end_frame, frame_count, start_sec, end_sec, duration_sec: runs of
    frames with the same largest column. ``rows`` has clip_id, duration_sec and posteriorgram (frames by phonemes).

    Runs are found within the clip's own array, by where the largest column changes, so frames are never shuffled.
    """
    from sonoframe.functions.arrays import arg_max, indices

    names = F.array(*[F.lit(x) for x in (labels or PHONEMES)])
    best = F.transform("posteriorgram", arg_max)
    df = rows.select("clip_id", "duration_sec", best.alias("_b")).where(F.size("_b") > 0)
    begin = F.filter(indices(F.size("_b")), lambda i: (i == 0) | (F.get("_b", i) != F.get("_b", F.greatest(i - 1, F.lit(0)))))
    df = df.withColumn("_s", begin).withColumn("_f", F.col("duration_sec") / F.size("_b"))
    df = df.select("clip_id", "_b", "_s", "_f", F.posexplode("_s").alias("_i", "start_frame"))
    stop = F.coalesce(F.get("_s", F.col("_i") + 1), F.size("_b"))
    k = F.get("_b", F.col("start_frame"))
    count = stop - F.col("start_frame")
    return df.select(
        "clip_id", k.alias("phoneme_index"), F.coalesce(F.get(names, k), k.cast("string")).alias("phoneme"), "start_frame", (stop - 1).alias("end_frame"), count.alias("frame_count"),
        (F.col("start_frame") * F.col("_f")).alias("start_sec"), (stop * F.col("_f")).alias("end_sec"), (count * F.col("_f")).alias("duration_sec"),
    )


def phoneme_durations(segments: DataFrame) -> DataFrame:
    """clip_id, phoneme, count, total_sec, mean_sec."""
    return segments.groupBy("clip_id", "phoneme").agg(F.count("*").alias("count"), F.sum("duration_sec").alias("total_sec"), F.avg("duration_sec").alias("mean_sec"))
