"""Files as rows: listing, types, checks, checksums. Listing is Spark's own (``binaryFile``), so it is distributed."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of each file type (fixed values).
FILE_TYPES = {"audio": (".wav", ".mp3"), "video": (".mp4", ".avi")}

#: Extensions that count as audio in a directory (fixed values).
AUDIO_EXTENSIONS = (".wav", ".mp3", ".flac", ".m4a", ".ogg", ".aac", ".wma")


def extension(path: Column) -> Column:
    """With the dot; empty without one."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def plain_path(path: Column) -> Column:
    """Without the scheme that Spark puts before local paths."""
    return F.regexp_replace(path, "^file:/*(?=/)", "")


def is_directory(spark: SparkSession, path: str) -> bool:
    """Asks the file system that the path belongs to, whichever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.exists(where) and system.getFileStatus(where).isDirectory())


def open_file(path: str, mode: str = "rb"):
    """A file of any file system that Arrow knows, for code on executors; ``wb`` makes missing folders."""
    from pyarrow import fs

    system, where = file_system(path)
    if mode == "rb":
        return system.open_input_file(where)
    if isinstance(system, fs.LocalFileSystem):
        os.makedirs(os.path.dirname(where) or ".", exist_ok=True)
    return system.open_output_stream(where)


def file_system(path: str):
    """Arrow's file system of a path, and the path within it."""
    from pyarrow import fs

    local = re.sub("^file:/*(?=/)", "", path)
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)


def file_type(path: Column) -> Column:
    """``audio`` or ``video`` by extension; another one raises."""
    ext = F.lower(extension(path))
    column = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, exts in FILE_TYPES.items():
        column = column.when(ext.isin(*exts), kind)
    return column.otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), path)))


def listing(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    """path, length, modified of the files under ``paths``; their contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths)
    return rows.select(plain_path(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified"))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "path string, length bigint, modified timestamp")


def audio_files(spark: SparkSession, directory: str, extensions: Iterable[str] = AUDIO_EXTENSIONS, recursive: bool = True) -> DataFrame:
    """Audio files of a directory, sorted, each once. Suffixes match in lower or in upper case, not mixed. A missing
    directory, or a path that is none, gives no rows."""
    if not is_directory(spark, directory):
        return _empty(spark)
    exts = [x for e in extensions for x in (e.lower(), e.upper())]
    rows = listing(spark, directory, recursive)
    return rows.where(extension(F.col("path")).isin(exts)).dropDuplicates(["path"]).orderBy("path")


def list_files(
    spark: SparkSession, root: str, types: Sequence[str] | None = None, extensions: Sequence[str] | None = None, include_hidden: bool = False
) -> DataFrame:
    """path and type of the files below ``root``, sorted: those with an extension of one of ``types`` or one of
    ``extensions`` (dot optional, any case), all known ones by default. Hidden files and folders only on demand."""
    if not is_directory(spark, root):
        raise ValueError(f"not a directory: {root}")
    unknown = set(types or ()) - set(FILE_TYPES)
    if unknown:
        raise ValueError(f"unknown file types: {sorted(unknown)}")
    wanted = {e for t in types or () for e in FILE_TYPES[t]} | {"." + e.lower().lstrip(".") for e in extensions or ()}
    known = {e for exts in FILE_TYPES.values() for e in exts}
    rows = listing(spark, root).where(F.lower(extension(F.col("path"))).isin(*((wanted & known) if wanted else known)))
    if not include_hidden:
        top = spark._jvm.org.apache.hadoop.fs.Path(root)
        top = top.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(top).toString()
        below = F.substring(F.col("path"), len(re.sub("^file:/*(?=/)", "", top).rstrip("/")) + 1, 1_000_000)
        rows = rows.where(~below.rlike(r"/\."))
    return rows.select("path", file_type(F.col("path")).alias("type")).orderBy("path")


def existing(paths: DataFrame, found: DataFrame, raise_on_empty: bool = True) -> DataFrame:
    """Rows of ``paths`` (path) that are files in ``found`` (:func:`listing`); none left raises on demand."""
    rows = paths.join(found.select("path"), "path", "left_semi")
    if raise_on_empty and rows.isEmpty():
        raise ValueError("none of the paths is a file")
    return rows


def common_directory(files: DataFrame) -> str:
    """The longest directory that all paths share, with a slash at its end. Only the smallest and the largest path
    come to the driver: what these two share, all share."""
    row = files.agg(F.min("path").alias("a"), F.max("path").alias("b")).first()
    if row.a is None:
        raise ValueError("no files")
    return os.path.join(os.path.commonpath([os.path.dirname(row.a), os.path.dirname(row.b)]), "")


def one_type(files: DataFrame) -> DataFrame:
    """type, path of files that are all of one type, a row per file; several types raise."""
    kinds = files.select(file_type(F.col("path")).alias("type"), "path")
    if len(kinds.select("type").distinct().limit(2).collect()) > 1:
        raise ValueError("files of several types")
    return kinds


def checksums(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, checksum (SHA-256 of the content)."""
    rows = spark.read.format("binaryFile").load(paths)
    return rows.select(plain_path(F.col("path")).alias("path"), F.sha2("content", 256).alias("checksum"))


def verified(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """path, ok: whether a file still has the checksum noted for it; a missing file is not ok."""
    noted = expected.select("path", F.col("checksum").alias("_noted"))
    return noted.join(actual, "path", "left").select("path", F.coalesce(F.col("checksum") == F.col("_noted"), F.lit(False)).alias("ok"))
