"""CHAT transcripts (.cha) as script lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.sources.files import plain_path


def chat_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, ord, speaker, text, start_sec, end_sec: the utterances of each file in order.

    Continued lines are joined. Retraced and repeated material (before [/], [//], [///], [/?] and [/-]), bracketed codes,
    events, fillers' marks and pauses are no words; the shortened and completed forms of a word stay. The last token,
    the terminator, follows the words without a blank. Times are null without a time mark. All in the JVM.
    """
    rows = spark.read.text(paths, wholetext=True).select(plain_path(F.col("_metadata.file_path")).alias("path"), "value")
    joined = F.regexp_replace("value", r"\r?\n\t", " ")
    lines = rows.select("path", F.posexplode(F.split(joined, r"\r?\n")).alias("_at", "_line")).where(F.col("_line").startswith("*"))
    said = F.regexp_extract("_line", r"^\*[^:]+:\s*(.*)$", 1)
    text = said
    for pattern, into in (
        (r"\x15", " "),
        (r"(?:<[^<>]*>|\S+)\s*\[/{1,3}[?-]?\]", " "),  # retraced
        (r"(?:<[^<>]*>|\S+)\s*\[/{1,3}[?-]?\]", " "),  # retraced twice
        (r"\[[^\]]*\]", " "),
        (r"[<>]", " "),
        (r"(?<!\S)&\S+", " "),
        (r"(?<!\S)\(\.*\d*\.*\)(?!\S)", " "),
        (r"(?<!\S)\+[<\"^,+]+(?!\S)", " "),
        (r"[()]", ""),
        (r"(?<=\S)@\S+", ""),
        (r"\d+_\d+\s*$", " "),
        (r"\s+", " "),
    ):
        text = F.regexp_replace(text, pattern, into)
    words = F.filter(F.split(F.trim(text), " "), lambda w: (w != "") & (w != "0") & ~w.isin("xxx", "yyy", "www", ",", "‡", "„"))
    n = F.size(words)
    body = F.concat(F.array_join(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), " "), F.coalesce(F.get(words, n - 1), F.lit("")))
    mark = lambda i: F.try_divide(F.regexp_extract("_line", r"(\d+)_(\d+)\x15?\s*$", i).try_cast("double"), F.lit(1000.0))
    from pyspark.sql import Window

    # a file is one row before, so its lines are bounded by what one row holds
    place = F.row_number().over(Window.partitionBy("path").orderBy("_at")) - 1
    return lines.select("path", place.alias("ord"), F.regexp_extract("_line", r"^\*([^:]+):", 1).alias("speaker"), body.alias("text"), mark(1).alias("start_sec"), mark(2).alias("end_sec"))
