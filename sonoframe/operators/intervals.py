"""Continuous periods and gaps of overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of one time bucket. A key's intervals are merged bucket by bucket, so a key that holds a
#: third of all rows is spread over as many tasks as it has buckets.
BUCKET_MS = 600_000


#: From here on a bigint of milliseconds can't hold a time in seconds.
MOST_SEC = 9.2e15


def _millis(seconds: Column) -> Column:
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < MOST_SEC)
    return F.when(finite, F.round(seconds * 1000).cast("bigint"))


def usable_intervals(lines: DataFrame, keys: list[Column], start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """``keys``, from_ms and to_ms of the rows that are intervals.

    Times are rounded to whole milliseconds. A row with a null, NaN, negative or infinite time (or one that no bigint of
    milliseconds can hold), or one that does not end after it starts, is no interval. Rows with a null key stay, under the
    null key. Of extra columns none is looked at, whatever its name.
    """
    rows = lines.select(*keys, _millis(lines[start]).alias("from_ms"), _millis(lines[end]).alias("to_ms"), lines[start].alias("_raw"))
    return rows.where((F.col("_raw") >= 0) & (F.col("from_ms") >= 0) & (F.col("to_ms") > F.col("from_ms"))).drop("_raw")


def periods_and_gaps(intervals: DataFrame, keys: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``keys``, kind, from_ms, to_ms: the periods (kind ``period``) covered by the intervals of each key, touching
    intervals joined, and the gaps (kind ``gap``) between one period and the next.

    ``intervals`` has the keys (texts or numbers, null is a key of its own) and bigint columns from_ms < to_ms, from_ms
    not negative. Within a time bucket session windows whose duration is each row's own length merge what overlaps (partly
    before the shuffle), and sessions that touch become one piece. Sessions count time from the start of their bucket and end with it
    at the latest, as nothing begins in the bucket after that; so times may be as large as a bigint holds. Of each bucket only its latest end and the start of its last piece go
    through a window over the key, so no task ever holds all intervals of a key. Repeated rows change nothing; a key
    with one period has no gap; no rows give none.
    """
    plain, back, names = _without_nulls(intervals, keys)
    bucket = F.coalesce(F.expr(f"from_ms div {bucket_ms}"), F.lit(0))  # never null: all reads stay alike
    base = F.col("_bucket") * F.lit(bucket_ms)
    inside = F.least(F.col("to_ms") - F.col("from_ms"), F.lit(bucket_ms) - F.pmod(F.col("from_ms"), F.lit(bucket_ms)))
    length = F.make_interval(secs=inside.cast("decimal(18,3)") / F.lit(1000).cast("decimal(18,3)"))
    local = [*names, "_bucket"]
    merged = (
        plain.select(*names, "to_ms", bucket.alias("_bucket"), F.timestamp_millis(F.pmod(F.col("from_ms"), F.lit(bucket_ms))).alias("_at"), length.alias("_length"))
        .groupBy(*local, F.session_window("_at", F.col("_length")).alias("_session"))
        .agg(F.max("to_ms").alias("to_ms"))
        .select(*local, (F.unix_millis(F.col("_session.start")) + base).alias("from_ms"), "to_ms")
    )
    order = Window.partitionBy(*local).orderBy("from_ms")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    heads = merged.withColumn("_head", F.coalesce(F.col("from_ms") > F.max("to_ms").over(before), F.lit(True)).cast("int"))
    islands = heads.withColumn("_island", F.sum("_head").over(upto))
    pieces = islands.groupBy(*local, "_island").agg(F.min("from_ms").alias("from_ms"), F.max("to_ms").alias("to_ms"))

    # A piece begins a period if nothing in earlier buckets reaches it. As a bucket's pieces are apart, its last piece
    # tells where its last period begins, if any does.
    ends = pieces.groupBy(*local).agg(F.max("to_ms").alias("_end"), F.max("from_ms").alias("_start"))
    across = Window.partitionBy(*names).orderBy("_bucket")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_reach", F.coalesce(F.max("_end").over(earlier), F.lit(-1)))
    ends = ends.withColumn("_opened", F.when(F.col("_start") > F.col("_reach"), F.col("_start")))
    ends = ends.withColumn("_open", F.max("_opened").over(earlier))
    final = ends.groupBy(*names).agg(F.max("_opened").alias("from_ms"), F.max("_end").alias("to_ms")).select(*back, F.lit("period").alias("kind"), "from_ms", "to_ms")

    # Each start of a period closes the one before it at what was reached so far.
    rows = pieces.join(ends.select(*local, "_reach", "_open"), local)
    rows = rows.withColumn("_closed", F.greatest("_reach", F.max("to_ms").over(before))).where("from_ms > _reach")
    rows = rows.withColumn("_open", F.coalesce(F.lag("from_ms").over(order), F.col("_open"))).where("_open IS NOT NULL")
    period = F.struct(F.lit("period").alias("kind"), F.col("_open").alias("from_ms"), F.col("_closed").alias("to_ms"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("_closed").alias("from_ms"), F.col("from_ms").alias("to_ms"))
    return rows.select(*back, F.explode(F.array(period, gap)).alias("_row")).select(*keys, "_row.*").unionByName(final)


def _without_nulls(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[Column], list[str]]:
    """``df`` with key columns that hold no null, the columns that give the keys back, and the new columns' names;
    equality of such columns keeps a join on the partitioning of an aggregate."""
    kinds, columns, back = dict(df.dtypes), {}, []
    for i, c in enumerate(keys):
        if kinds[c] != "string" and not kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
            raise ValueError(f"{c} is neither a text nor a number")
        columns[f"_k{i}"] = F.coalesce(F.col(c), F.lit("" if kinds[c] == "string" else 0).cast(kinds[c]))
        columns[f"_n{i}"] = F.col(c).isNull()
        back.append(F.when(~F.col(f"_n{i}"), F.col(f"_k{i}")).alias(c))
    return df.select(*[e.alias(n) for n, e in columns.items()], "from_ms", "to_ms"), back, list(columns)


def speaking_periods(lines: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """clip_id, speaker, kind, from_ms, to_ms of diarization lines, speakers trimmed and in upper case.

    A null speaker is a speaker of its own (null). See :func:`usable_intervals` for the rows that take no part.
    """
    speaker = F.upper(F.regexp_replace(lines["speaker"], r"^\s+|\s+$", ""))
    rows = usable_intervals(lines, [lines["clip_id"].alias("clip_id"), speaker.alias("speaker")])
    return periods_and_gaps(rows, ["clip_id", "speaker"], bucket_ms)
