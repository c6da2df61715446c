"""Long spans that stand verbatim in more than one document.

Any run of SPAN characters contains a k-gram that is the smallest, by hash, among its k-grams; the same run selects
the same k-gram wherever it stands. So a document is cut into pieces, one per selected k-gram, each holding all runs
that select it, and only pieces with the same k-gram can share a run. K-grams of one document only are dropped; they
route, and decide nothing. What is shared is found by suffix automata: the pieces of a k-gram are reference text, put
into shards, an automaton is built of each shard, and pieces are streamed through it for their matching statistics.

The texts of the k-grams that most documents have make up the broadcast reference, REFERENCE_CHARS at most: its shards'
automata go to every executor, and all documents' pieces are streamed through them where they lie, so that no text
that a third of all documents holds is ever brought together. Shards beyond that bound meet their pieces by a shuffle, a
k-gram each, as broadcasting all of them would send the whole collection to every executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.automaton import SuffixAutomaton
from sonoframe.plans.durable import durable
from sonoframe.plans.skew import join_one

#: Least number of common characters.
SPAN = 300

#: Characters of a k-gram, as a part of the span: longer ones meet by chance less often, shorter ones are fewer.
GRAM_PART = 3

#: Characters of the reference that is broadcast, at most, and of one of its shards, about.
REFERENCE_CHARS, SHARD_CHARS = 200_000, 25_000

#: Different pieces of one k-gram that go into one automaton; more are split into blocks that meet in pairs.
BLOCK_PIECES = 1000

#: Documents of one class that meet in one block of the pair join.
BLOCK_DOCUMENTS = 500

#: Characters that are hashed at a time; longer texts are taken in stretches that overlap by a span.
STRETCH = 1 << 20

_POSITION_BITS = 24


def pieces_of(text: str, span: int = SPAN):
    """Arrays of k-gram hash, from, to of the pieces of ``text``: every run of ``span`` characters lies in the piece of the
    k-gram it selects. Shorter texts have none."""
    import numpy as np

    found = [(np.zeros(0, "int64"),) * 3]
    for at in range(0, max(len(text) - span + 1, 0), STRETCH - span + 1):
        part = text[at : at + STRETCH]
        if len(part) >= span:
            f, lo, hi = _stretch(part, span)
            found.append((f, lo + at, hi + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _powers(n: int, base: int, known: dict = {}):  # noqa: B006 - kept between calls
    import numpy as np

    if base not in known or len(known[base]) < n:
        row = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        row[0] = 1
        known[base] = np.cumprod(row)
    return known[base][:n]


def _stretch(text: str, span: int):
    import numpy as np

    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    k = max(span // GRAM_PART, 1)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * _powers(n, base))])
    grams = (sums[k:] - sums[:-k]) * _powers(n - k + 1, inverse)  # a polynomial of each k-gram, wherever it stands
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    # ties go to the later position, so that a key tells its position
    mask = np.uint64((1 << _POSITION_BITS) - 1)
    keys = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
    width = span - k + 1
    count = len(keys) - width + 1
    padded = np.concatenate([keys, np.full(-len(keys) % width, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    edges = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], edges])
    last = np.concatenate([edges, [count]]) - 1
    at = (mask - (least[first] & mask)).astype(np.int64)
    return grams[at].astype(np.int64), first.astype(np.int64), (last + span).astype(np.int64)


def _fingerprints(documents: DataFrame, span: int) -> DataFrame:
    """doc_id, sha, f, lo, hi: the SHA-256 of each text and its pieces, as arrays."""

    def batches(parts):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for part in parts:
            texts = part.column("text").to_pylist()
            own = [pieces_of(t, span) for t in texts]
            ends = pa.array(np.cumsum([0, *(len(f) for f, _, _ in own)]), pa.int32())
            column = lambda k, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, "int64"), *(x[k] for x in own)]).astype(kind)))  # noqa: E731, B023
            shas = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), shas, column(0, "int64"), column(1, "int32"), column(2, "int32")], ["doc_id", "sha", "f", "lo", "hi"])

    return documents.select("doc_id", "text").mapInArrow(batches, "doc_id bigint, sha binary, f array<bigint>, lo array<int>, hi array<int>")


#: A piece of reference text: its text, the smallest and the largest id of the documents that hold it.
Member = tuple[str, int, int]


def _holders(rows: list[list[int]], members: list[Member], alone: bool = True) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Automaton state -> smallest document and pieces (numbers in ``members``) that hold its run, for runs that more
    than one document holds. ``rows`` are the states of the members' windows. Unless ``alone``, those of more than one piece."""
    where: dict[int, list[int]] = {}
    for i, row in enumerate(rows):
        for state in set(row):
            if state >= 0:
                where.setdefault(state, []).append(i)
    found = {}
    for state, own in where.items():
        least = min(members[i][1] for i in own)
        if any(members[i][2] != least for i in own) and (alone or len(own) > 1):
            found[state] = (least, tuple(own))
    return found


def _spans(row: list[int], holder_of, span: int):
    """from, to, holder: the maximal stretches of windows with the same smallest holder in one piece."""
    start, end, holder = 0, 0, None
    for at, state in enumerate(row):
        now = holder_of(state)
        if now is not None and now == holder and at + 1 - span <= end:
            end = at + 1
        elif now is not None:
            if holder is not None:
                yield start, end, holder
            start, end, holder = at + 1 - span, at + 1, now
    if holder is not None:
        yield start, end, holder


class Reference:
    """Automata of the shards of a reference, each state marked with the class of documents that hold its run."""

    def __init__(self, grams: dict[int, list[Member]], span: int) -> None:
        self.span = span
        self.shard_of: dict[int, int] = {}
        self.shards: list[tuple[SuffixAutomaton, dict[int, tuple[int, int]]]] = []
        held: list[int] = []
        size = 0
        for f in sorted(grams):
            held.append(f)
            size += sum(len(t) for t, _, _ in grams[f])
            if size >= SHARD_CHARS:
                self._add(held, grams)
                held, size = [], 0
        if held:
            self._add(held, grams)

    def _add(self, held: list[int], grams: dict[int, list[Member]]) -> None:
        automaton, members = SuffixAutomaton(), [m for f in held for m in grams[f]]
        for text, _, _ in members:
            automaton.add(text)
        classes: dict[tuple[int, ...], int] = {}
        marks = {}
        for state, (least, own) in _holders([automaton.windows(t, self.span) for t, _, _ in members], members).items():
            marks[state] = (classes.setdefault(own, len(classes)), least)
        self.shard_of |= dict.fromkeys(held, len(self.shards))
        self.shards.append((automaton, marks))

    def match(self, f: int, text: str) -> tuple[set[str], list[tuple[int, int, int]]]:
        """The classes that hold a run of ``text``, a piece of k-gram ``f``, and its shared spans."""
        shard = self.shard_of[f]
        automaton, marks = self.shards[shard]
        row = automaton.windows(text, self.span)
        classes = {marks[s][0] for s in set(row) if s in marks}
        return {f"{shard}:{c}" for c in classes}, list(_spans(row, lambda s: marks[s][1] if s in marks else None, self.span))


def _streamed(parts, reference: Reference):
    """doc_id, class | from_at, to_at, holder: documents' pieces through the broadcast reference."""
    import pandas as pd

    for part in parts:
        rows: list[tuple] = []
        for doc, f, lo, text in part[["doc_id", "f", "lo", "text"]].itertuples(index=False):
            classes, spans = reference.match(f, text)
            rows += [(doc, c, None, None, None) for c in classes]
            rows += [(doc, None, lo + a, lo + b, holder) for a, b, holder in spans]
        yield pd.DataFrame(rows, columns=["doc_id", "class", "from_at", "to_at", "holder"]).astype({"doc_id": "int64", "from_at": "Int32", "to_at": "Int32", "holder": "Int64"})


def _matched(parts, span: int):
    """The groups of one k-gram (and pair of blocks), one after the other as the rows are sorted, each streamed through
    the automaton of its reference block. Gives, for pieces that share a run, their classes and their shared spans."""
    import pandas as pd

    columns = ["f", "piece", "class", "from_at", "to_at", "holder"]
    rows: list[tuple] = []

    def match(key: tuple, pieces: list[tuple]) -> None:
        automaton, members = SuffixAutomaton(), [m for _, m, _ in pieces]
        for _, (text, _, _), reference in pieces:
            if reference:
                automaton.add(text)
        states = [automaton.windows(text, span) for text, _, _ in members]
        # a piece that several documents hold is told once, by the block it lies in
        held = _holders(states, members, alone=key[1] == key[2])
        classes: dict[tuple, int] = {}
        for _, own in held.values():
            classes.setdefault(own, len(classes))
        for own, number in classes.items():
            rows.extend((key[0], pieces[i][0], f"{key[0]}/{key[1]}/{key[2]}/{number}", None, None, None) for i in own)
        for i, row in enumerate(states):
            rows.extend((key[0], pieces[i][0], None, *found) for found in _spans(row, lambda s: held[s][0] if s in held else None, span))

    def frame():
        table = pd.DataFrame(rows, columns=columns)
        rows.clear()
        return table.astype({"f": "int64", "from_at": "Int32", "to_at": "Int32", "holder": "Int64"})

    key, pieces = None, []
    for part in parts:
        for f, i, j, piece, text, least, most, reference in part[["f", "i", "j", "piece", "text", "least", "most", "reference"]].itertuples(index=False):
            if (f, i, j) != key:
                if pieces:
                    match(key, pieces)
                key, pieces = (f, i, j), []
            pieces.append((piece, (text, least, most), reference))
        if len(rows) > 50_000:
            yield frame()
    if pieces:
        match(key, pieces)
    yield frame()


class SharedSpans:
    """The spans of at least ``span`` characters that the texts of ``documents`` (doc_id bigint, text) share.

    Null and shorter texts share nothing. doc_id is unique; texts are compared exactly as stored, in characters. All
    texts are read whole; documents with the same text are looked at once, as one class of copies.
    """

    def __init__(self, documents: DataFrame, span: int = SPAN) -> None:
        self.span = span
        self.documents = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"].alias("text"))
        long = self.documents.where(F.length("text") >= span)
        prints = durable(_fingerprints(long, span))
        firsts = prints.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
        #: least, doc_id, n: each long document under the smallest id with the same text
        self.copies = durable(join_one(prints.select("doc_id", "sha"), firsts, "sha").select("least", "doc_id", "n"))
        self._find(long, prints)

    def _find(self, long: DataFrame, prints: DataFrame) -> None:
        later = self.copies.where("doc_id <> least").select("doc_id")
        grams = prints.join(later, "doc_id", "left_anti").select("doc_id", F.explode(F.arrays_zip("f", "lo", "hi")).alias("p")).select("doc_id", "p.*")
        often = grams.groupBy("f").agg(F.count("*").alias("_n"), (F.min("doc_id") != F.max("doc_id")).alias("several")).where("several").drop("several")
        often = durable(often)
        own = join_one(grams, often.select("f"), "f", sizes=often).groupBy("doc_id").agg(F.collect_list(F.struct("f", "lo", "hi")).alias("own"))  # bounded by the text
        cut = F.transform("own", lambda p: F.struct(p["f"].alias("f"), p["lo"].alias("lo"), F.substring(F.col("text"), p["lo"] + 1, p["hi"] - p["lo"]).alias("text")))
        pieces = long.join(own, "doc_id").select("doc_id", F.explode(cut).alias("p")).select("doc_id", "p.*")
        pieces = durable(pieces.withColumn("piece", F.md5("text")))
        # equal pieces of a k-gram are reference text once
        distinct = pieces.groupBy("f", "piece").agg(F.first("text").alias("text"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("held"))
        sizes = durable(distinct.groupBy("f").agg(F.count("*").alias("n"), F.sum("held").alias("held"), F.sum(F.length("text")).alias("chars")))
        near = self._broadcast(pieces, distinct, sizes)
        far, places = (distinct, pieces) if near is None else (distinct.join(F.broadcast(near), "f", "left_anti"), pieces.join(F.broadcast(near), "f", "left_anti"))
        #: f, piece, doc_id, lo: where each piece beyond the broadcast reference stands
        self.places = places.select("f", "piece", "doc_id", "lo")
        blocks = F.ceil(F.col("n") / BLOCK_PIECES).cast("int")
        split = far.join(sizes.select("f", blocks.alias("blocks")), "f").withColumn("b", F.pmod(F.xxhash64("piece"), F.col("blocks")).cast("int"))
        # block b is reference for itself and the blocks after it, and is streamed against those before it
        meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("b"), o).alias("i"), F.greatest(F.col("b"), o).alias("j")))
        routed = split.select("f", "piece", "text", "least", "most", "b", F.explode(meets).alias("m")).select("f", "m.i", "m.j", "piece", "text", "least", "most", (F.col("b") == F.col("m.i")).alias("reference"))
        span = self.span
        routed = routed.repartition("f", "i", "j").sortWithinPartitions("f", "i", "j", "piece")
        #: f, piece, class | from_at, to_at, holder: what the automata beyond the broadcast ones found
        self.matches = durable(routed.mapInPandas(lambda parts: _matched(parts, span), "f bigint, piece string, class string, from_at int, to_at int, holder bigint"))

    def _broadcast(self, pieces: DataFrame, distinct: DataFrame, sizes: DataFrame) -> DataFrame | None:
        """The k-grams whose pieces the broadcast reference took (null: none), and ``self.streamed``: doc_id, class |
        from_at, to_at, holder. Those that most documents hold come first, as far as REFERENCE_CHARS go."""
        spark, left, taken = pieces.sparkSession, REFERENCE_CHARS, []
        most = sizes.where(F.col("chars") <= REFERENCE_CHARS).orderBy(F.desc("held"), "f").limit(REFERENCE_CHARS // self.span + 1)
        for r in most.collect():  # a k-gram has a piece at least, and a piece span characters
            if r.chars <= left:
                left -= r.chars
                taken.append((r.f,))
        if not taken:
            self.streamed = spark.createDataFrame([], "doc_id bigint, class string, from_at int, to_at int, holder bigint")
            return None
        near = spark.createDataFrame(taken, "f bigint")
        grams: dict[int, list[Member]] = {}
        for r in distinct.join(F.broadcast(near), "f", "left_semi").collect():  # REFERENCE_CHARS at most
            grams.setdefault(r.f, []).append((r.text, r.least, r.most))
        shared = spark.sparkContext.broadcast(Reference(grams, self.span))
        found = pieces.join(F.broadcast(near), "f", "left_semi").select("doc_id", "f", "lo", "text")
        self.streamed = durable(found.mapInPandas(lambda parts: _streamed(parts, shared.value), "doc_id bigint, class string, from_at int, to_at int, holder bigint"))
        return near

    def classes(self) -> DataFrame:
        """class, doc_id: documents that have a run in common, copies left to :attr:`copies`. Of classes with the
        same documents one is kept."""
        near = self.streamed.where("class IS NOT NULL").select("class", "doc_id")
        far = self.matches.where("class IS NOT NULL").select("f", "piece", "class").join(self.places, ["f", "piece"]).select("class", "doc_id")
        members = durable(near.unionByName(far).distinct())
        wide = lambda seed: F.sum(F.xxhash64("doc_id", F.lit(seed)).cast("decimal(38,0)"))
        marks = members.groupBy("class").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), wide(1).alias("x"), wide(2).alias("y"))
        kept = marks.where("n > 1").groupBy("n", "a", "b", "x", "y").agg(F.min("class").alias("class")).select("class")
        return join_one(members, kept, "class")

    def pairs(self) -> DataFrame:
        """doc_id_a, doc_id_b: each pair of documents, the smaller id first, with a common run."""
        reached = self.classes().withColumnRenamed("doc_id", "least").join(self.copies, "least").select("class", "doc_id")
        alike = self.copies.where("n > 1").select(F.concat(F.lit("="), F.col("least").cast("string")).alias("class"), "doc_id")
        return _pairs_within(reached.unionByName(alike))

    def links(self) -> DataFrame:
        """doc_id, class_id, n_copies, n_links: of every document the smallest id with the same text, how many have this
        text (itself included), and how many other documents have a common run with it. Shorter and null texts are
        alone. Pairs are formed of different texts only."""
        own = self.copies.groupBy("least").agg(F.first("n").alias("n"))
        pairs = _pairs_within(self.classes())
        both = pairs.select(F.col("doc_id_a").alias("least"), F.col("doc_id_b").alias("other")).unionByName(pairs.select(F.col("doc_id_b").alias("least"), F.col("doc_id_a").alias("other")))
        far = both.join(own.select(F.col("least").alias("other"), "n"), "other").groupBy("least").agg(F.sum("n").alias("k"))
        per = own.join(far, "least", "left").select("least", (F.col("n") - 1 + F.coalesce("k", F.lit(0))).alias("k"))
        long = join_one(self.copies, per, "least").select("doc_id", F.col("least").alias("class_id"), F.col("n").alias("n_copies"), F.col("k").alias("n_links"))
        rows = self.documents.select("doc_id").join(long, "doc_id", "left")
        return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

    def spans(self) -> DataFrame:
        """doc_id, from_at, to_at (characters, counted from 0, end exclusive), holder: where a text stands elsewhere,
        and the smallest id of the documents that hold it. Spans may overlap."""
        near = self.streamed.where("class IS NULL").select("doc_id", "from_at", "to_at", "holder")
        found = self.matches.where("class IS NULL").join(self.places, ["f", "piece"])
        return near.unionByName(found.select("doc_id", (F.col("lo") + F.col("from_at")).alias("from_at"), (F.col("lo") + F.col("to_at")).alias("to_at"), "holder"))


def _pairs_within(members: DataFrame) -> DataFrame:
    """Each pair of doc_ids (a < b) of one class, once. A class is cut into blocks and each pair of blocks is a join
    key of its own, so that no task meets more than BLOCK_DOCUMENTS squared pairs of one key."""
    members = durable(members)
    sizes = members.groupBy("class").agg(F.ceil(F.count("*") / BLOCK_DOCUMENTS).cast("int").alias("blocks"))
    rows = join_one(members, sizes, "class").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    a = rows.select("class", F.col("doc_id").alias("doc_id_a"), F.col("own").alias("i"), other).withColumnRenamed("other", "j")
    b = rows.select("class", F.col("doc_id").alias("doc_id_b"), F.col("own").alias("j"), other).withColumnRenamed("other", "i")
    return a.join(b, ["class", "i", "j"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()


def _covered(spans: DataFrame) -> DataFrame:
    """doc_id, from_at, to_at: the spans of each document joined where they touch or overlap."""
    local = Window.partitionBy("doc_id").orderBy("from_at", "to_at")  # a document's spans are bounded by its text
    head = F.coalesce(F.col("from_at") > F.max("to_at").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    rows = spans.distinct().withColumn("head", head.cast("int"))
    rows = rows.withColumn("no", F.sum("head").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "no").agg(F.min("from_at").alias("from_at"), F.max("to_at").alias("to_at")).drop("no")


def shared_parts(found: SharedSpans) -> DataFrame:
    """doc_id, n_chars, shared_chars, shared_part, n_spans: of every document how much of its text stands elsewhere.

    A text with a copy is shared whole. A null text has null n_chars, and nothing shared; an empty one has a part of 0.
    """
    own = _covered(found.spans().select("doc_id", "from_at", "to_at"))
    own = own.groupBy("doc_id").agg(F.sum(F.col("to_at") - F.col("from_at")).alias("c"), F.count("*").alias("k"))
    copied = found.copies.where("n > 1").select("doc_id", F.lit(True).alias("copied"))
    rows = found.documents.select("doc_id", F.length("text").cast("bigint").alias("n_chars")).join(own, "doc_id", "left").join(copied, "doc_id", "left")
    chars = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("c", F.lit(0)))
    return rows.select(
        "doc_id", "n_chars", chars.alias("shared_chars"), F.coalesce(F.try_divide(chars, "n_chars"), F.lit(0.0)).alias("shared_part"),
        F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("k", F.lit(0))).alias("n_spans"),
    )


def without_repeats(found: SharedSpans) -> DataFrame:
    """doc_id, text, removed_chars: every text without the maximal spans that also stand in a document with a smaller
    id; a copy of such a document becomes empty. Null texts stay null."""
    later = found.spans().where("holder < doc_id").select("doc_id", "from_at", "to_at")
    cuts = _covered(later).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("from_at", "to_at"))).alias("cuts"))
    copied = found.copies.where("doc_id <> least").select("doc_id", F.lit(True).alias("copied"))
    rows = found.documents.join(cuts, "doc_id", "left").join(copied, "doc_id", "left")

    def clean(parts):
        import pandas as pd

        for part in parts:
            texts = []
            for text, spans, copy in zip(part["text"], part["cuts"], part["copied"], strict=True):
                if text is not None and copy is True:
                    text = ""
                elif text is not None and spans is not None:
                    kept, at = [], 0
                    for s in spans:
                        kept.append(text[at : s["from_at"]])
                        at = s["to_at"]
                    text = "".join([*kept, text[at:]])
                texts.append(text)
            sizes = [0 if a is None else len(a) - len(b) for a, b in zip(part["text"], texts, strict=True)]
            yield pd.DataFrame({"doc_id": part["doc_id"], "text": pd.Series(texts, dtype="object"), "removed_chars": pd.Series(sizes, dtype="int64")})

    return rows.select("doc_id", "text", "cuts", "copied").mapInPandas(clean, "doc_id bigint, text string, removed_chars bigint")
