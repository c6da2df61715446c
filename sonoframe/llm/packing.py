"""Items of varying length into containers of fixed capacity, packed over the histogram of lengths."""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.tokens import VOCABULARY, token_count
from sonoframe.plans.durable import durable

#: Items that a hash bucket holds, about; items of one length are numbered in buckets, of which there are as many as all
#: items need, so that no window holds all items of a length.
BUCKET_ITEMS = 50_000


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns (count, [(length, times), ...]) for ``histogram`` (length -> items, lengths 1..capacity).

    Lengths are placed longest first, each item into the shortest pack that is open (the one with most room), into a
    new one if it fits in none. Packs alike are one pattern with a count, so the work does not grow with the number
    of items: a length moves whole patterns and splits at most one, and opens at most two. Hence there are at most 3
    patterns per length, and as the lengths in a pack differ and add up to the capacity, sqrt(2 capacity) entries in
    each.
    """
    open_packs: dict[int, list[list]] = {}  # room -> [count, ((length, times), rest of the pattern)]
    rooms: list[int] = []  # negative, so that the largest comes first
    closed: list[list] = []

    def put(room: int, count: int, pattern: tuple | None) -> None:
        if room == 0:
            closed.append([count, pattern])
            return
        if room not in open_packs:
            open_packs[room] = []
            heappush(rooms, -room)
        open_packs[room].append([count, pattern])

    def add(pattern: tuple | None, length: int, times: int) -> tuple:
        if pattern is not None and pattern[0][0] == length:
            return ((length, pattern[0][1] + times), pattern[1])
        return ((length, times), pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        while left:
            while rooms and not open_packs.get(-rooms[0]):
                open_packs.pop(-heappop(rooms), None)
            if rooms and -rooms[0] >= length:
                room = -rooms[0]
                count, pattern = open_packs[room].pop()
                taken = min(count, left)
                if count > taken:
                    open_packs[room].append([count - taken, pattern])
                put(room - length, taken, add(pattern, length, 1))
                left -= taken
            else:
                times = capacity // length
                if full := left // times:
                    put(capacity - times * length, full, ((length, times), None))
                if rest := left % times:
                    put(capacity - rest * length, 1, ((length, rest), None))
                left = 0
    packed = []
    for count, pattern in [*closed, *(p for packs in open_packs.values() for p in packs)]:
        entries = []
        while pattern is not None:
            entries.append(pattern[0])
            pattern = pattern[1]
        packed.append((count, entries))
    return packed


def pack_items(items: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """container_name, container_no (from 0), item_id, piece_no, first_token, n_tokens.

    ``items`` has item_id and n_tokens. Each item comes once for every container of ``capacities`` (a few); one longer
    than the capacity is cut into pieces of the full capacity and a rest. Items without tokens take no room and lie in
    container 0. Repeated ids are items of their own. The driver sees the histogram of lengths, at most as many rows
    as the capacities add up to; the pattern table that is broadcast is bounded by
    3 capacity * sqrt(2 capacity) entries, see :func:`shortest_pack_first`.
    """
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("a container needs a capacity of at least 1")
    spark = items.sparkSession
    names = sorted(capacities)
    holds = F.array(*[F.struct(F.lit(i).alias("_c"), F.lit(int(capacities[n])).cast("bigint").alias("_cap")) for i, n in enumerate(names)])
    buckets = max(-(-items.count() // BUCKET_ITEMS), 16)
    sized = items.select("item_id", F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("bigint").alias("_n"))
    spread = sized.select("item_id", "_n", F.explode(holds).alias("_h")).select("item_id", "_n", "_h.*")
    last = F.greatest(F.ceil(F.col("_n") / F.col("_cap")) - 1, F.lit(0))
    pieces = spread.select("item_id", "_n", "_c", "_cap", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
    first = F.col("piece_no") * F.col("_cap")
    pieces = pieces.select("_c", "item_id", F.col("piece_no").cast("int").alias("piece_no"), first.alias("first_token"), F.least(F.col("_n") - first, F.col("_cap")).cast("int").alias("n_tokens"))
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("item_id", "piece_no"), F.lit(buckets)).cast("int"))

    counts = durable(pieces.groupBy("_c", "n_tokens", "_bucket").agg(F.count("*").alias("_k")))
    histograms: dict[int, dict[int, int]] = {i: {} for i in range(len(names))}
    for r in counts.groupBy("_c", "n_tokens").agg(F.sum("_k").alias("k")).collect():
        histograms[r._c][r.n_tokens] = r.k
    table = spark.sparkContext.broadcast(_slots(histograms, [int(capacities[n]) for n in names]))

    before = Window.partitionBy("_c", "n_tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_c", "n_tokens", "_bucket", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    keys = ["_c", "n_tokens", "_bucket"]
    inside = Window.partitionBy(*keys).orderBy("item_id", "piece_no")
    ranked = pieces.withColumn("_at", F.row_number().over(inside) - 1).join(offsets, keys)
    ranked = ranked.select("_c", "item_id", "piece_no", "first_token", "n_tokens", (F.col("_before") + F.col("_at")).alias("_rank"))

    def place(batches):
        import numpy as np
        import pandas as pd

        keys, starts, low, base, times = table.value
        for batch in batches:
            c, n = batch["_c"].to_numpy(), batch["n_tokens"].to_numpy()
            key = c.astype("int64") << 40 | n.astype("int64")
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            offset = np.where(keys[place] == key, starts[place], -1) if len(keys) else key * 0 - 1
            at = offset + batch["_rank"].to_numpy()
            slot = np.maximum(np.searchsorted(low, at, side="right") - 1, 0)
            inside = (at - low[slot]) // times[slot] + base[slot] if len(low) else at * 0
            yield pd.DataFrame(
                {
                    "container_name": [names[i] for i in c.tolist()],
                    "container_no": np.where(offset < 0, 0, inside),
                    "item_id": batch["item_id"],
                    "piece_no": batch["piece_no"],
                    "first_token": batch["first_token"],
                    "n_tokens": batch["n_tokens"],
                }
            )

    kind = dict(items.dtypes)["item_id"]
    return ranked.mapInPandas(place, f"container_name string, container_no bigint, item_id {kind}, piece_no int, first_token bigint, n_tokens int")


def _slots(histograms: dict[int, dict[int, int]], capacities: list[int]):
    """Sorted keys of container kind and length, where the items of each begin in the numbering of all items, and for each
    run of it: first item, first container, items per container."""
    import numpy as np

    starts: dict[tuple[int, int], int] = {}
    slots: list[tuple[int, int, int]] = []
    at = 0
    for c, histogram in histograms.items():
        lengths = {n: k for n, k in histogram.items() if n > 0}
        filled: dict[int, int] = {}
        for length, k in lengths.items():
            starts[c, length] = filled[length] = at
            at += k
        container = 0
        for count, entries in shortest_pack_first(lengths, capacities[c]):
            for length, times in entries:
                slots.append((filled[length], container, times))
                filled[length] += count * times
            container += count
    low, base, times = np.array(sorted(slots), dtype="int64").reshape(-1, 3).T.copy()
    found = sorted((c << 40 | length, at) for (c, length), at in starts.items())
    keys, at = np.array(found, dtype="int64").reshape(-1, 2).T.copy()
    return keys, at, low, base, times


def pack_documents(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """:func:`pack_items` for texts: doc_id is the item, its size the tokens of ``text`` (null and empty: none).

    ``containers`` (container_name, capacity_tokens) is a table of a few rows.
    """
    capacities = {r.container_name: r.capacity_tokens for r in containers.select("container_name", "capacity_tokens").collect()}
    spark = documents.sparkSession
    sized = documents.select(documents["doc_id"].alias("item_id"), token_count(spark, documents["text"], vocabulary).alias("n_tokens"))
    return pack_items(durable(sized), capacities).withColumnRenamed("item_id", "doc_id")


def packing_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """container_name, capacity_tokens, n_containers, n_tokens and fill, the share of the room that is used."""
    per = packed.groupBy("container_name", "container_no").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    per = per.groupBy("container_name").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    rows = containers.select("container_name", "capacity_tokens").join(per, "container_name", "left")
    return rows.withColumn("fill", F.try_divide("n_tokens", F.col("n_containers") * F.col("capacity_tokens")))
