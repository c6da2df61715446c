"""Records of several sources in target shares of the total size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.tokens import VOCABULARY, token_count
from sonoframe.plans.durable import durable

#: Ranges of an epoch's order, see :func:`mix_sources`.
RANGES = 4096


def plain_source(source: Column) -> Column:
    """A source's name whatever its case, blanks and hyphens."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s_-]+", "_")


def spread_budget(amount: float, leaves: list[tuple[tuple[str, ...], float, float]]) -> dict[tuple[str, ...], float]:
    """What each leaf gets of ``amount``. A leaf is (path from the root, weight, capacity).

    A node's amount goes to its children by weight. What a child can't hold goes to its siblings by weight; only what
    all of them can't hold is missing at their parent, whose siblings then take it.
    """
    children: dict[str, list] = {}
    given: dict[tuple[str, ...], float] = {}
    for path, weight, room in leaves:
        if len(path) == 0:
            given[path] = min(amount, room)
        else:
            children.setdefault(path[0], []).append((path[1:], weight, room))
    open_ = {name: (sum(w for _, w, _ in below), sum(r for _, _, r in below)) for name, below in children.items()}
    share: dict[str, float] = {}
    left = amount
    while open_ and left > 0:
        weight = sum(w for w, _ in open_.values())
        if weight <= 0:
            break
        full = {n for n, (w, room) in open_.items() if left * w / weight >= room}
        if not full:
            share |= {n: left * w / weight for n, (w, _) in open_.items()}
            break
        share |= {n: open_[n][1] for n in full}
        left -= sum(open_.pop(n)[1] for n in full)
    for name, below in children.items():
        given |= {(name, *path): x for path, x in spread_budget(share.get(name, 0.0), below).items()}
    return given


def sized_documents(documents: DataFrame, languages: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, language, n_tokens of the documents whose source some mix names; language is the code of the
    ``lang`` label, ``und`` without a known one."""
    names = F.array_distinct(F.array(F.lower("language_code"), F.lower("alpha_2"), F.lower("language_name")))
    known = languages.select(F.col("language_code").alias("language"), F.explode(names).alias("_name")).where("_name IS NOT NULL").dropDuplicates(["_name"])
    wanted = [r[0] for r in targets.select(plain_source(F.col("source"))).distinct().collect() if r[0] is not None]
    rows = documents.select("doc_id", "text", plain_source(F.col("source")).alias("source"), F.lower(F.trim("lang")).alias("_name"))
    rows = rows.where(F.col("source").isin(wanted)) if wanted else rows.where(F.lit(False))
    rows = rows.join(F.broadcast(known), "_name", "left")  # a dimension: a few names for each language there is
    size = token_count(documents.sparkSession, F.col("text"), vocabulary)
    return durable(rows.select("doc_id", "source", F.coalesce("language", F.lit("und")).alias("language"), size.cast("bigint").alias("n_tokens")))


def _mixes(targets: DataFrame) -> dict[str, dict[str, tuple[float, int]]]:
    """mix -> source -> (share, repeats); a few rows. A null share, or one below 0, is 0, null repeats are 1."""
    mixes: dict[str, dict[str, tuple[float, int]]] = {}
    for r in targets.select("mix_name", plain_source(F.col("source")).alias("source"), "target_share", "max_repeats").collect():
        mixes.setdefault(r.mix_name, {})[r.source] = max(float(r.target_share or 0), 0.0), max(int(1 if r.max_repeats is None else r.max_repeats), 0)
    return mixes


def _domains(domains: DataFrame | None) -> dict[str, str]:
    """source -> domain; a few rows."""
    return {} if domains is None else {r[0]: r[1] for r in domains.select(plain_source(F.col("source")), "domain").collect() if r[0] and r[1]}


def budget_leaves(sources: dict[str, tuple[float, int]], have: dict[tuple[str, str], int], domain: dict[str, str]) -> list[tuple[tuple[str, str, str], float, float]]:
    """The leaves (domain, language, source), weight, room of a mix's tree. A source's weight is split over its languages
    as its tokens (``have``) are; a source without tokens is a leaf of language ``und`` without room, so that its
    siblings get its share."""
    leaves = []
    for source, (share, repeats) in sources.items():
        own = {lang: n for (s, lang), n in have.items() if s == source and n > 0}
        whole = sum(own.values())
        leaves += [((domain.get(source, source), lang, source), share * n / whole, float(n * repeats)) for lang, n in own.items()]
        if not own:
            leaves.append(((domain.get(source, source), "und", source), share, 0.0))
    return leaves


def mix_sources(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, domains: DataFrame | None = None) -> DataFrame:
    """mix_name, source, language, doc_id, epoch, tokens_used: the documents that make up each mix.

    ``targets`` (mix_name, source, target_share, max_repeats; a few rows) names the sources of a mix; ``sized`` is
    :func:`sized_documents`; ``domains`` (source, domain; a few rows) is the first level of the tree, a source that it
    does not name is a domain of its own. The budget of a mix (``total`` tokens, or all tokens of its sources once)
    goes down a tree domain > language > source, where a source's weight is split over its languages as its tokens
    are; a leaf holds its tokens max_repeats times. What a source is short of goes to its siblings, and only what they
    can't hold to other domains. A leaf's tokens come from epochs, each an order of its documents by a seeded hash:
    whole epochs first, then a prefix of the next, whose last document is cut.

    An epoch's order is cut into RANGES ranges of the hash; sums per range say in which one the prefix ends, and only
    the documents of that range are put in order, so that a source with most of the rows never meets in one task.
    Documents without tokens are in no mix; a null share or weight is 0; a source without documents reaches nothing,
    and its share goes to its siblings. The same seed gives the same mix.
    """
    spark = sized.sparkSession
    have = {(r.source, r.language): int(r.n) for r in sized.groupBy("source", "language").agg(F.sum("n_tokens").alias("n")).collect()}
    domain = _domains(domains)
    rows = []
    for mix, sources in _mixes(targets).items():
        own = {k: n for k, n in have.items() if k[0] in sources and n > 0}
        budget = total if total is not None else sum(own.values())
        for (_, lang, s), amount in spread_budget(float(budget), budget_leaves(sources, own, domain)).items():
            if n := own.get((s, lang)):
                tokens = min(int(amount + 1e-6), n * sources[s][1])
                rows.append((mix, s, lang, tokens // n, tokens % n))
    plan = spark.createDataFrame(rows, "mix_name string, source string, language string, _whole bigint, _rest bigint")
    # at most a row per mix, source and language
    members = sized.where("n_tokens > 0").join(F.broadcast(plan), ["source", "language"])
    order = F.xxhash64(F.lit(seed), "mix_name", "_whole", "doc_id")
    members = members.withColumn("_order", order).withColumn("_range", F.shiftrightunsigned("_order", 52).cast("int"))
    leaf = ["mix_name", "source", "language"]
    columns = [*leaf, "doc_id", "epoch", "tokens_used"]
    epochs = F.sequence(F.lit(0), F.col("_whole").cast("int") - 1)
    whole = members.where("_whole > 0").select(*leaf, "doc_id", F.explode(epochs).alias("epoch"), F.col("n_tokens").alias("tokens_used"))

    partial = members.where("_rest > 0")
    before = Window.partitionBy(*leaf).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = partial.groupBy(*leaf, "_range").agg(F.sum("n_tokens").alias("_sum"), F.first("_rest").alias("_need"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where("_before < _need")
    sums = sums.select(*leaf, "_range", "_before", (F.col("_before") + F.col("_sum") <= F.col("_need")).alias("_all"))
    partial = partial.join(sums, [*leaf, "_range"])
    inside = Window.partitionBy(*leaf, "_range").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    easy = partial.where("_all").withColumn("tokens_used", F.col("n_tokens"))
    edge = partial.where("NOT _all").withColumn("_end", F.col("_before") + F.sum("n_tokens").over(inside))
    edge = edge.withColumn("tokens_used", F.least("n_tokens", F.col("_rest") - (F.col("_end") - F.col("n_tokens")))).where("tokens_used > 0")
    epoch = F.col("_whole").cast("int").alias("epoch")
    return whole.select(*columns).unionByName(easy.select(*leaf, "doc_id", epoch, "tokens_used")).unionByName(edge.select(*leaf, "doc_id", epoch, "tokens_used"))


def mix_report(mixed: DataFrame, sized: DataFrame, targets: DataFrame, total: int | None = None, domains: DataFrame | None = None) -> DataFrame:
    """A row per mix and source: mix_name, domain, source, target_share, actual_share, wanted_tokens (the share of the
    budget), tokens_used, short_tokens, from_siblings and from_ancestors (tokens beyond the share that other sources of
    the domain, or other domains, were short of), available_tokens, repeats, max_repeats.

    ``total`` and ``domains`` as for :func:`mix_sources`. Everything but the sums over documents is a few rows.
    """
    used = mixed.groupBy("mix_name", "source").agg(F.sum("tokens_used").alias("tokens_used"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    domain = _domains(domains)
    known = F.create_map(*[F.lit(x) for pair in domain.items() for x in pair]) if domain else F.create_map().cast("map<string,string>")
    rows = targets.select("mix_name", plain_source(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), "max_repeats")
    rows = rows.join(used, ["mix_name", "source"], "left").join(have, "source", "left").na.fill(0, ["tokens_used", "available_tokens"])
    rows = rows.withColumn("domain", F.coalesce(F.try_element_at(known, F.col("source")), F.col("source")))
    mix, within = Window.partitionBy("mix_name"), Window.partitionBy("mix_name", "domain")
    budget = F.sum("available_tokens").over(mix) if total is None else F.lit(total)
    wanted = F.coalesce(F.try_divide(budget * F.col("target_share"), F.sum("target_share").over(mix)), F.lit(0.0))
    rows = rows.withColumn("wanted_tokens", F.round(wanted).cast("bigint"))
    more = F.col("tokens_used") - F.col("wanted_tokens")
    rows = rows.withColumn("_more", F.greatest(more, F.lit(0))).withColumn("short_tokens", F.greatest(-more, F.lit(0)))
    outside = F.greatest(F.sum("tokens_used").over(within) - F.sum("wanted_tokens").over(within), F.lit(0))
    outside = F.round(F.coalesce(F.try_divide(F.col("_more") * outside, F.sum("_more").over(within)), F.lit(0.0))).cast("bigint")
    return rows.withColumn("from_ancestors", outside).select(
        "mix_name", "domain", "source", "target_share",
        F.try_divide("tokens_used", F.sum("tokens_used").over(mix)).alias("actual_share"),
        "wanted_tokens", "tokens_used", "short_tokens", (F.col("_more") - F.col("from_ancestors")).alias("from_siblings"), "from_ancestors",
        "available_tokens", F.try_divide("tokens_used", "available_tokens").alias("repeats"), "max_repeats",
    )
