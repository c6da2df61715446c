"""WAV files as clips, and clips as WAV files; numpy and ``struct`` only."""

from __future__ import annotations

import os
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.functions.arrow import signals
from sonoframe.sources.files import file_system, open_file, plain_path


def parse_header(content: bytes) -> dict | None:
    """format (1 PCM, 3 float), channels, rate, bits, and where the samples lie; None if it is no WAV file."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, found = 12, {}
    while at + 8 <= len(content):
        kind, size = struct.unpack_from("<4sI", content, at)
        if kind == b"fmt ":
            if at + 24 > len(content) or (size >= 40 and at + 34 > len(content)):
                return None
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            if code == 0xFFFE and size >= 40:
                code = struct.unpack_from("<H", content, at + 32)[0]
            found = {"format": code, "channels": channels, "rate": rate, "bits": bits}
        elif kind == b"data" and found:
            return found | {"start": at + 8, "size": size}
        at += 8 + size + size % 2
    return None


def decode(content: bytes, offset_sec: float = 0.0, duration_sec: float | None = None):
    """(rate, array of channels x samples in [-1, 1]) of PCM 8 to 32 bit and 32 or 64 bit float. Only the samples of
    the wanted stretch are converted."""
    import numpy as np

    head = parse_header(content)
    if head is None:
        raise ValueError("not a WAV file")
    width = head["bits"] // 8
    frame = width * head["channels"]
    data = memoryview(content)[head["start"] : head["start"] + head["size"]]
    n = len(data) // frame
    first = min(int(offset_sec * head["rate"]), n)
    last = n if duration_sec is None or duration_sec < 0 else min(first + int(duration_sec * head["rate"]), n)
    raw = data[first * frame : last * frame]
    if head["format"] == 3:
        x = np.frombuffer(raw, dtype="<f4" if width == 4 else "<f8").astype("float64")
    elif head["format"] != 1:
        raise ValueError(f"WAV format {head['format']} is not supported")
    elif width == 1:
        x = (np.frombuffer(raw, dtype=np.uint8).astype("float64") - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / float(1 << 23)
    else:
        x = np.frombuffer(raw, dtype=f"<i{width}").astype("float64") / float(1 << (8 * width - 1))
    return head["rate"], x.reshape(-1, head["channels"]).T


def encode(channels, rate: int, bits: int = 16) -> bytes:
    """A WAV file: PCM of 16 or 32 bits, samples clipped to [-1, 1], or float for ``bits=-32``."""
    import numpy as np

    x = np.asarray(channels, dtype="float64")
    if x.ndim != 2 or rate <= 0:
        raise ValueError("two dimensions and a positive rate are needed")
    if bits == -32:
        code, width, body = 3, 4, x.T.astype("<f4").tobytes()
    else:
        code, width = 1, bits // 8
        top = (1 << (bits - 1)) - 1
        body = np.rint(np.clip(x.T, -1, 1) * top).astype(f"<i{width}").tobytes()
    n = x.shape[0]
    head = struct.pack("<HHIIHH", code, n, rate, rate * n * width, n * width, width * 8)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def read_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, sampling_rate, n_channels, duration_sec; null for files that are no WAV files. Samples are not decoded;
    a file's whole content is looked at only where its first 4096 bytes are of a WAV file and don't reach the samples."""
    import pandas as pd

    def run(head: pd.Series, size: pd.Series, whole: pd.Series) -> pd.DataFrame:
        rows = []
        for c, n, w in zip(head, size, whole, strict=True):
            h = parse_header(bytes(c)) or (parse_header(w) if w is not None else None)
            rows.append((None, None, None) if h is None else (h["rate"], h["channels"], min(h["size"], n - h["start"]) / (h["rate"] * h["channels"] * h["bits"] / 8)))
        return pd.DataFrame(rows, columns=["sampling_rate", "n_channels", "duration_sec"])

    def reached(head: pd.Series) -> pd.Series:
        return pd.Series([bytes(c[:4]) != b"RIFF" or bytes(c[8:12]) != b"WAVE" or parse_header(bytes(c)) is not None for c in head], dtype=bool)

    run.__annotations__ = {"head": pd.Series, "size": pd.Series, "whole": pd.Series, "return": pd.DataFrame}
    reached.__annotations__ = {"head": pd.Series, "return": pd.Series}
    rows = spark.read.format("binaryFile").load(paths).select(plain_path(F.col("path")).alias("path"), F.substring("content", 1, 4096).alias("_h"), F.col("length").alias("_n"), "content")
    rows = rows.withColumn("_w", F.when((F.col("_n") > 4096) & ~F.pandas_udf(reached, "boolean")("_h"), F.col("content"))).drop("content")
    info = F.pandas_udf(run, "sampling_rate int, n_channels int, duration_sec double")("_h", "_n", "_w")
    return rows.select("path", info.alias("_i")).select("path", "_i.*")


def read_clips(spark: SparkSession, paths: str | list[str], offset_sec: float = 0.0, duration_sec: float | None = None) -> DataFrame:
    """clip_id (the path), path, sampling_rate, channels, metadata of WAV files. A missing path raises, as does a
    negative offset or a duration below 0 other than -1. Column pruning leaves samples undecoded that aren't used."""
    import pandas as pd

    if offset_sec < 0 or (duration_sec is not None and duration_sec < 0 and duration_sec != -1):
        raise ValueError("offset and duration can't be negative")

    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            rate, x = decode(bytes(c), offset_sec, duration_sec)
            rows.append((rate, x.tolist()))
        return pd.DataFrame(rows, columns=["sampling_rate", "channels"])

    run.__annotations__ = {"content": pd.Series, "return": pd.DataFrame}
    rows = spark.read.format("binaryFile").load(paths)
    path = plain_path(F.col("path"))
    decoded = F.pandas_udf(run, "sampling_rate int, channels array<array<double>>")("content")
    rows = rows.select(path.alias("path"), decoded.alias("_d"))
    return rows.select(F.col("path").alias("clip_id"), "path", "_d.sampling_rate", "_d.channels", F.create_map().cast("map<string,string>").alias("metadata"))


def from_arrays(df: DataFrame) -> DataFrame:
    """Clips of in-memory samples: ``samples`` may be an array or an array of channels; rate at least 1."""
    kind = dict(df.dtypes)["samples"]
    channels = F.col("samples").cast("array<array<double>>") if kind.startswith("array<array") else F.array(F.col("samples").cast("array<double>"))
    fine = F.assert_true(F.col("sampling_rate") > 0, F.lit("a sampling rate is positive")).isNull()
    return df.withColumn("channels", F.when(fine, channels)).drop("samples")


def save_clips(clips: DataFrame, bits: int = 16) -> DataFrame:
    """Writes each clip to its ``path`` (a folder that executors share; missing folders are made) and gives path,
    n_bytes. A file is written under another name first and then renamed, so a repeated task leaves whole files."""

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = []
            for path, rate, ch in zip(batch.column("path").to_pylist(), batch.column("sampling_rate").to_pylist(), signals(batch.column("channels")), strict=True):
                body = encode([[]] if ch is None else ch, int(rate), bits)
                part = f"{path}.{os.getpid()}.part"
                with open_file(part, "wb") as file:
                    file.write(body)
                system, where = file_system(path)
                system.move(file_system(part)[1], where)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], ["path", "n_bytes"])

    return clips.select("path", "sampling_rate", "channels").mapInArrow(write, "path string, n_bytes bigint")
