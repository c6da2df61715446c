"""Whole analyses as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.operators import frames
from sonoframe.operators.features import voice_features
from sonoframe.plans.skew import join_one


def conversation_segments(clips: DataFrame, lines: DataFrame, bucket_sec: float = 10.0, read: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """A row per line with both times: clip_id, ord, speaker, start_sec, end_sec, sampling_rate and the channels of
    that stretch. A line's own number goes along, so lines that fall out shift nothing. Lines outside their clip raise.

    A clip is first cut into stretches that hold the lines beginning in the same ``bucket_sec``, each sample about once,
    so that a clip of many lines is neither repeated for each of them nor left to one task.

    With ``read`` no clip is ever held as a whole: it gives the channels of a stretch (first sample, number of samples)
    from the columns of ``clips``, which have n_samples in place of channels.
    """
    if read is not None:
        return _read_segments(clips, lines, read)
    usable = lines.where("start_sec IS NOT NULL AND end_sec IS NOT NULL").select("clip_id", "ord", "speaker", "start_sec", "end_sec", F.floor(F.col("start_sec") / bucket_sec).alias("_b"))
    spans = usable.groupBy("clip_id", "_b").agg(F.min("start_sec").alias("s"), F.max("end_sec").alias("e"))
    spans = spans.groupBy("clip_id").agg(F.collect_list("_b").alias("_bs"), F.collect_list("s").alias("_starts"), F.collect_list("e").alias("_ends"))  # a stretch of the clip each
    rows = clips.select("clip_id", "path", "sampling_rate", "channels")
    kinds = dict(rows.dtypes)

    def stretches(batches):
        import pandas as pd

        for batch in batches:
            for r in batch.itertuples(index=False):
                bs, starts, ends, channels = r[4], r[5], r[6], r[3]
                n = len(channels[0]) if len(channels) else 0
                for at in range(0, len(bs), 1000):
                    part = []
                    for b, s, e in zip(bs[at : at + 1000], starts[at : at + 1000], ends[at : at + 1000], strict=True):
                        first = max(int(s * r[2]), 0)
                        part.append((r[0], r[1], r[2], n, b, first, [c[first : max(int(e * r[2]), first)] for c in channels]))
                    yield pd.DataFrame(part, columns=["clip_id", "path", "sampling_rate", "_n", "_b", "_first", "channels"])

    schema = f"clip_id {kinds['clip_id']}, path {kinds['path']}, sampling_rate {kinds['sampling_rate']}, _n bigint, _b bigint, _first bigint, channels {kinds['channels']}"
    found = rows.join(spans, "clip_id").mapInPandas(stretches, schema).join(usable, ["clip_id", "_b"])
    fine, first, size = _place(F.col("_n"))
    return found.withColumn("channels", F.when(fine, frames.cut(F.col("channels"), (first - F.col("_first")).cast("int"), size))).drop("_n", "_b", "_first")


def _place(n: Column) -> tuple[Column, Column, Column]:
    """Whether a line is inside its clip of ``n`` samples (else it raises), its first sample and their number."""
    rate = F.col("sampling_rate")
    fine = F.assert_true((F.col("start_sec") >= 0) & (F.col("end_sec") <= n / rate), F.lit("segment outside its clip")).isNull()
    first = (F.col("start_sec") * rate).cast("int")
    return fine, first, F.greatest((F.col("end_sec") * rate).cast("int") - first, F.lit(0))


def _read_segments(clips: DataFrame, lines: DataFrame, read: Callable[[Column, Column], Column]) -> DataFrame:
    usable = lines.where("start_sec IS NOT NULL AND end_sec IS NOT NULL").select("clip_id", "ord", "speaker", "start_sec", "end_sec")
    fine, first, size = _place(F.col("n_samples"))
    return join_one(usable, clips, "clip_id").select("clip_id", "path", "sampling_rate", F.when(fine, read(first, size)).alias("channels"), "ord", "speaker", "start_sec", "end_sec")


def explore_conversation(
    clips: DataFrame,
    lines: DataFrame,
    transcribers: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    families: tuple[str, ...] = (),
    speaker_embedders: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    ssl_embedders: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    read: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """original_file, segments: per file the array of its segments in order, each with original_file, sampling_rate,
    speaker_id, start, end, transcripts, features, speaker_embeddings and ssl_embeddings.

    Each callable takes the segments and adds a column: ``text``, ``vector`` or ``layers`` (frames are averaged). The
    models' results become maps by model name. original_file is the clip's path (its id where it has none); a clip
    without usable lines has an empty array. Without clips there are no rows. ``read`` is that of
    :func:`conversation_segments`, for clips too long to be held.
    """
    rows = conversation_segments(clips, lines, read=read)
    transcripts, speakers, ssl = [], [], []
    for name, call in (transcribers or {}).items():
        rows = call(rows).withColumnRenamed("text", f"_t_{len(transcripts)}")
        transcripts.append((name, F.col(f"_t_{len(transcripts)}")))
    for name, call in (speaker_embedders or {}).items():
        rows = call(rows).withColumnRenamed("vector", f"_v_{len(speakers)}")
        speakers.append((name, F.col(f"_v_{len(speakers)}")))
    for name, call in (ssl_embedders or {}).items():
        rows = call(rows).withColumnRenamed("layers", f"_s_{len(ssl)}")
        mean = F.transform(F.col(f"_s_{len(ssl)}"), _mean_rows)
        ssl.append((name, mean))
    rows = voice_features(rows, families) if families else rows.withColumn("features", F.create_map().cast("map<string,double>"))
    by_name = lambda pairs, kind: F.map_from_arrays(F.array(*[F.lit(n) for n, _ in pairs]), F.array(*[v for _, v in pairs])) if pairs else F.create_map().cast(f"map<string,{kind}>")
    one = F.struct(
        F.col("path").alias("original_file"), "sampling_rate", F.col("speaker").alias("speaker_id"), F.col("start_sec").alias("start"), F.col("end_sec").alias("end"),
        by_name(transcripts, "string").alias("transcripts"), "features", by_name(speakers, "array<double>").alias("speaker_embeddings"), by_name(ssl, "array<array<double>>").alias("ssl_embeddings"),
    )
    # a file's segments are one row of the result
    placed = rows.select("clip_id", F.struct(F.col("start_sec").alias("s"), F.col("ord").alias("o")).alias("k"), F.to_json(one).alias("j"))
    grouped = placed.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "j"))), lambda x: x["j"]).alias("segments"))
    everyone = clips.select("clip_id", F.coalesce(F.col("path"), F.col("clip_id").cast("string")).alias("original_file"))
    return everyone.join(grouped, "clip_id", "left").select("original_file", F.coalesce("segments", F.array().cast("array<string>")).alias("segments"))


def _mean_rows(layer):
    from sonoframe.functions.arrays import transposed

    return F.transform(transposed(layer), lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(c), F.lit(1)))
