"""Datasets on disk, and the catalog of participants, sessions, clips and videos."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.sources.files import file_system, is_directory, open_file

FORMATS = ("parquet", "json", "csv", "arrow", "sql")


def read_dataset(spark: SparkSession, path: str, split: str | None = None, streaming: bool = False, schema: str | None = None) -> DataFrame:
    """A dataset by its extension; a directory holds Parquet unless it is named otherwise (``x.json`` may be a
    directory). ``split`` names a sub-directory. With ``streaming`` a stream (which needs a schema)."""
    ext = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower() or "parquet"
    kind = {"jsonl": "json", "pq": "parquet"}.get(ext, ext)
    if kind not in FORMATS or kind == "sql":
        raise RuntimeError(f"can't read {path}: unknown format {kind!r}")
    where = f"{path}/{split}" if split and split != "all" else path
    if kind == "arrow":
        return _read_arrow(spark, where)
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(schema) if schema else reader
    if kind == "csv":
        reader = reader.option("header", True)
        reader = reader if schema else reader.option("inferSchema", True)
    return reader.format(kind).load(where)


def save_dataset(df: DataFrame, directory: str, name: str, kind: str = "parquet", mode: str = "overwrite", jdbc: dict | None = None) -> str:
    """Writes a dataset and gives its path: all from the executors: Parquet, JSON lines, CSV, ``arrow`` as a folder of IPC
    files; ``sql`` through JDBC (``jdbc`` has url, driver and further options)."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    path = f"{directory}/{name}.{kind}"
    if kind == "sql":
        if not jdbc:
            raise ValueError("JDBC options are needed")
        df.write.format("jdbc").options(dbtable=name, **jdbc).mode(mode).save()
    elif kind == "arrow":
        _write_arrow(df, path)
    elif kind == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).format(kind).save(path)
    return path


def _read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """IPC files (one, or a folder of them), each read on an executor; the schema is that of the first."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def batches(parts):
        import pyarrow as pa

        for part in parts:
            for content in part.column("content"):
                yield from pa.ipc.open_file(content.as_buffer()).read_all().to_batches()

    files = spark.read.format("binaryFile").load(path)
    first = files.orderBy("path").select("path").first()
    if first is None:
        raise RuntimeError(f"no files in {path}")
    import pyarrow as pa

    with open_file(first.path) as source:
        schema = pa.ipc.open_file(source).schema
    return files.select("content").mapInArrow(batches, from_arrow_schema(schema))


def _write_arrow(df: DataFrame, folder: str) -> None:
    """An IPC file per partition, whole or not there at all; what lay there before is removed."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    names = df.columns

    def write(parts):
        import pyarrow as pa
        from pyspark import TaskContext

        context, rows, writer = TaskContext.get(), 0, None
        target = f"{folder}/part-{context.partitionId():05}.arrow"
        part = f"{target}.{context.taskAttemptId()}.part"
        for batch in parts:
            if writer is None:
                sink = open_file(part, "wb")
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            sink.close()
            system, where = file_system(part)
            system.move(where, file_system(target)[1])
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["n"])

    df.select(*names).mapInArrow(write, "n bigint").agg(F.sum("n")).collect()  # one number


def read_mirror(spark: SparkSession, mirror: str, repository: str, revision: str = "main", split: str = "all") -> DataFrame:
    """A dataset of a hub from a local mirror ``mirror/repository/revision[/split]``; a missing one raises."""
    path = f"{mirror}/{repository}/{revision}"
    if not is_directory(spark, path):
        raise RuntimeError(f"no mirror of {repository} at {revision}")
    return read_dataset(spark, path, split)


def save_mirror(df: DataFrame, mirror: str, repository: str, revision: str = "main", split: str = "all") -> str:
    path = f"{mirror}/{repository}/{revision}" + ("" if split == "all" else f"/{split}")
    df.write.mode("overwrite").parquet(path)
    return path


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``, of which evaluating a row whose key stands twice raises; keys are counted, never gathered."""
    counts = df.groupBy(key).agg(F.count("*").alias("_k"))
    rows = df.join(counts, key)
    fine = F.assert_true(F.col("_k") == 1, F.concat(F.lit(f"{key} stands twice: "), F.col(key).cast("string"))).isNull()
    return rows.where(fine).drop("_k")


@dataclass(frozen=True)
class Catalog:
    """participants and sessions (id, metadata), clips and videos; any of them may be None."""

    participants: DataFrame | None = None
    sessions: DataFrame | None = None
    clips: DataFrame | None = None
    videos: DataFrame | None = None

    def add(self, what: str, rows: DataFrame) -> Catalog:
        """With ``rows`` (id, metadata) added; ids that are null or blank are replaced by new ones, ids that are there
        already raise when they are read."""
        own = getattr(self, what)
        named = rows.withColumn("id", F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.uuid()))
        return replace(self, **{what: require_unique(named if own is None else own.unionByName(named), "id")})

    def add_clips(self, rows: DataFrame) -> Catalog:
        return replace(self, clips=rows if self.clips is None else self.clips.unionByName(rows, allowMissingColumns=True))

    def batches(self, size: int) -> DataFrame:
        from sonoframe.operators.frames import in_batches_of

        return in_batches_of(self.clips, size, "clip_id")

    def exported(self) -> dict[str, DataFrame]:
        """Clips as (audio struct, metadata) and videos as they are; participants and sessions are not exported."""
        out = {}
        if self.clips is not None:
            out["audios"] = self.clips.select(F.struct("path", "sampling_rate", "channels").alias("audio"), "metadata")
        if self.videos is not None:
            out["videos"] = self.videos
        return out

    @staticmethod
    def imported(tables: dict[str, DataFrame], transfer_metadata: bool = False) -> Catalog:
        """The inverse; with ``transfer_metadata`` all further columns are folded into metadata as text."""
        audios = tables.get("audios")
        if audios is not None:
            more = [c for c in audios.columns if c not in ("audio", "metadata")]
            meta = F.coalesce("metadata", F.create_map().cast("map<string,string>")) if "metadata" in audios.columns else F.create_map().cast("map<string,string>")
            if transfer_metadata and more:
                extra = F.map_from_arrays(F.array(*[F.lit(c) for c in more]), F.array(*[F.col(c).cast("string") for c in more]))
                meta = F.map_from_entries(F.concat(F.map_entries(F.map_filter(meta, lambda k, _: ~k.isin(more))), F.map_entries(extra)))
            audios = audios.select(content_id(F.col("audio.channels"), F.col("audio.sampling_rate")).alias("clip_id"), "audio.*", meta.alias("metadata"))
        return Catalog(clips=audios, videos=tables.get("videos"))


def content_id(channels, rate):
    """An id of a clip's content: equal samples and rate give equal ids, however long the clip."""
    return F.sha2(F.concat_ws("|", F.to_json(channels), rate.cast("string")), 256)


def version_matrix(spark: SparkSession, entries: dict[str, dict[str, list[str]]]) -> DataFrame:
    """function, dependency versions: every combination of the versions listed for each function (a few)."""
    from itertools import product

    rows = [(name, dict(zip(deps, combo, strict=True))) for name, deps in entries.items() for combo in product(*deps.values())]
    return spark.createDataFrame(rows, "function string, versions map<string,string>")
