"""Train, validation and test splits that keep related records together.

Records are tied by shared ids. The ties' connected components come from a distributed union-find: each partition
builds a forest of its own edges, forests are merged partition-wise along their larger ends, and a large-star step
hangs what is left directly under its smallest known node, until nothing changes. No component, and no list of
links, ever lies on the driver or in one task as a whole.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, lcm, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sonoframe.plans.durable import durable
from sonoframe.plans.skew import join_one

EDGE = "child string, root string"

#: Groups that a rank bucket of one size holds, about; there are as many buckets as the groups need.
RANK_ROWS = 50_000


def plain_id(raw: Column) -> Column:
    """An id in lower-case hyphenated form, however it is written; null where the text is no id or is all zero."""
    hexes = F.lower(F.regexp_replace(F.regexp_replace(raw, r"(?i)^\s*\{?\s*(urn:uuid:)?|\}?\s*$", ""), r"[-_\s]", ""))
    parts = F.regexp_replace(hexes, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(hexes.rlike("^[0-9a-f]{32}$") & (hexes != "0" * 32), parts)


def _forest(batches):
    """The spanning forest of a partition's edges, every node under the smallest of its tree."""
    import pandas as pd

    parent: dict[str, str] = {}

    def find(x: str) -> str:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for batch in batches:
        for a, b in set(zip(batch["child"], batch["root"], strict=True)):
            a, b = find(a), find(b)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pd.DataFrame({"child": part, "root": [find(x) for x in part]}, dtype="object")


def connected(edges: DataFrame) -> DataFrame:
    """child, root: for each node of ``edges`` (child string, root string) that isn't the smallest of its component,
    the smallest. Null ends and loops are ignored; repeated edges change nothing; no edges give no rows.

    Each round lowers some node's root or changes nothing, which ends it; a chain is halved by a round at least. A root
    may have a third of all nodes: its children meet its smallest neighbour without being brought together.
    """
    found = edges.where("child IS NOT NULL AND root IS NOT NULL AND child <> root").select("child", "root")
    found = durable(found.mapInPandas(_forest, EDGE))
    seen = None
    while True:
        merged = found.repartition("child").mapInPandas(_forest, EDGE)
        merged = durable(merged.distinct())
        both = merged.select(F.col("child").alias("node"), F.col("root").alias("near")).unionByName(
            merged.select(F.col("root").alias("node"), F.col("child").alias("near"))
        )
        least = both.groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("node", "least").alias("least"))
        # every larger neighbour of a node goes under the smallest neighbour of that node
        hung = join_one(merged, least.withColumnRenamed("node", "root"), "root").select("child", F.col("least").alias("root"))
        found = durable(hung.distinct())
        state = found.agg(F.count("*"), F.sum(F.xxhash64("child", "root").cast("decimal(38,0)"))).first()
        if state == seen:
            return found
        seen = state


def id_ties(recordings: DataFrame, participants: DataFrame, sessions: DataFrame) -> DataFrame:
    """Edges between participants (``p`` after the id) and sessions (``s``): those of one recording, a participant
    and whom it is the same as, a session and the one it continues."""
    mark = lambda c, kind: F.concat(plain_id(c), F.lit(kind))
    return (
        recordings.select(mark(F.col("participant_id"), "p").alias("child"), mark(F.col("session_id"), "s").alias("root"))
        .unionByName(participants.select(mark(F.col("id"), "p").alias("child"), mark(F.try_element_at("metadata", F.lit("same_as")), "p").alias("root")))
        .unionByName(sessions.select(mark(F.col("id"), "s").alias("child"), mark(F.try_element_at("metadata", F.lit("continues")), "s").alias("root")))
    )


def related_groups(recordings: DataFrame, participants: DataFrame, sessions: DataFrame) -> DataFrame:
    """clip_id, group_key: one row per clip; the key is the smallest id of all participants and sessions that the
    clip is tied to, directly or through others, and null for a clip without a usable id.

    A clip delivered several times counts once; if its deliveries name different ids it takes the smallest one's
    group. Clips with a null clip_id count as one.
    """
    roots = connected(id_ties(recordings, participants, sessions))
    own = F.coalesce(F.concat(plain_id(F.col("participant_id")), F.lit("p")), F.concat(plain_id(F.col("session_id")), F.lit("s")))
    clips = recordings.select("clip_id", own.alias("node")).groupBy("clip_id").agg(F.min("node").alias("node"))
    placed = join_one(clips, roots.withColumnRenamed("child", "node"), "node", "left")
    return placed.select("clip_id", F.substring(F.coalesce("root", "node"), 1, 36).alias("group_key"))


def greedy_quotas(sizes: list[tuple[int, int]], shares: list[float]) -> list[tuple[int, int, int]]:
    """(size, split, groups) in order of placing: groups, largest first, each to the split furthest below its target
    (the first of those as far below).

    ``sizes`` is the histogram (size, number of groups) of the groups. Groups of one size are placed together: what a
    split lacks falls by the same step with each of them, so placing one by one takes the highest of these falling
    levels, and the level at which they run out is found by bisection. All arithmetic is in whole numbers.
    """
    exact = [Fraction(repr(float(x))) for x in shares]
    scale = lcm(*(x.denominator for x in exact))
    parts = [int(x * scale) for x in exact]
    weight, total = sum(parts), sum(s * n for s, n in sizes)
    lacks = [total * x for x in parts]  # in units of 1 / weight
    placed: list[tuple[int, int, int]] = []
    for size, count in sorted(sizes, reverse=True):
        step = size * weight
        above = lambda level: [max(0, -((level - x) // step)) for x in lacks]  # noqa: E731, B023 - groups placed from above it
        low, high = min(lacks) - step * (count + 1), max(lacks)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if sum(above(middle)) <= count else (middle, high)
        given = above(high)
        level = [i for i, x in enumerate(lacks) if x >= high and (x - high) % step == 0]
        for i in level[: count - sum(given)]:
            given[i] += 1
        lacks = [x - g * step for x, g in zip(lacks, given, strict=True)]
        placed += [(size, i, n) for i, n in enumerate(given) if n]
    return placed


def assign_splits(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """clip_id, split_name of every row of ``groups`` (clip_id, group_key); rows with a null key are groups of their own.

    ``targets`` (split_name, target_share; a few rows) gives the splits; shares are scaled to add up to 1, a null one
    is 0. The driver sees the histogram of group sizes only (n records have at most sqrt(2n) sizes), and decides how
    many groups of each size a split gets; which ones follows from their rank among groups of that size, in order of
    the MD5 of their keys.
    """
    splits = [(r.split_name, float(r.target_share or 0)) for r in targets.select("split_name", "target_share").orderBy("split_name").collect()]
    if not splits or sum(s for _, s in splits) <= 0:
        raise ValueError("no split has a share")
    keyed = durable(groups.select("clip_id", F.coalesce(F.col("group_key"), F.concat(F.lit("clip "), F.coalesce(F.col("clip_id").cast("string"), F.lit("")))).alias("_key")))
    sized = durable(keyed.groupBy("_key").agg(F.count("*").alias("_size")).withColumn("_mark", F.md5("_key")))
    digits = max(1, ceil(log(sized.count() / RANK_ROWS + 1, 16)))
    sized = sized.withColumn("_bucket", F.substring("_mark", 1, digits))
    counts = sized.groupBy("_size", "_bucket").agg(F.count("*").alias("_n"))
    histogram = [(r._size, r.n) for r in counts.groupBy("_size").agg(F.sum("_n").alias("n")).collect()]
    ranges, reached = [], {}
    for size, split, n in greedy_quotas(histogram, [s for _, s in splits]):
        low = reached.get(size, 0)
        reached[size] = low + n
        ranges.append((size, splits[split][0], low, low + n))
    spark = groups.sparkSession
    ranges = spark.createDataFrame(ranges, "_size bigint, split_name string, _low bigint, _high bigint")
    before = Window.partitionBy("_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_size", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_size", "_bucket").orderBy("_mark", "_key")
    ranked = sized.withColumn("_at", F.row_number().over(inside) - 1).join(offsets, ["_size", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_at"))
    # at most a row per size and split
    chosen = ranked.join(F.broadcast(ranges), "_size").where("_rank >= _low AND _rank < _high").select("_key", "split_name")
    return join_one(keyed, chosen, "_key").select("clip_id", "split_name")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """split_name, target_share, n_clips, actual_share; a split that got nothing has 0."""
    counts = assigned.groupBy("split_name").agg(F.count("*").alias("n_clips"))
    everything = Window.partitionBy()  # a row per split
    rows = targets.select("split_name", "target_share").join(counts, "split_name", "left").na.fill(0, ["n_clips"])
    return rows.withColumn("actual_share", F.try_divide(F.col("n_clips"), F.sum("n_clips").over(everything)))
