"""Similarity of vectors and of whole representations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.functions.arrays import cosine
from sonoframe.plans.durable import durable


def verify(pairs: DataFrame, a: str = "vector_a", b: str = "vector_b", threshold: float = 0.25) -> DataFrame:
    """``pairs`` with score, the cosine, and same_speaker: score above the threshold (NaN is not)."""
    score = cosine(F.col(a), F.col(b))
    return pairs.withColumn("score", score).withColumn("same_speaker", F.when(F.isnan("score"), F.lit(False)).otherwise(F.col("score") > threshold))


#: Numbers of the matrix of queries that is broadcast at a time, at most about (32 MB).
QUERY_NUMBERS = 4_000_000


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, query_numbers: int | None = None) -> DataFrame:
    """query_id, clip_id, score, rank: the ``k`` most similar vectors of each query, itself left out, ties by id.

    ``queries`` (query_id, vector) are held against all ``vectors`` (clip_id, vector), exactly. Blocks of queries whose
    matrix has at most ``query_numbers`` numbers are broadcast one after the other, and the vectors are streamed past them
    where they lie: none is copied or shuffled, and a task passes on k rows per query. Null vectors take no part; a query
    without length, or with NaN, has no neighbours, and a vector without length is nobody's.
    """
    if k < 1:
        raise ValueError("at least one neighbour")
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>").alias("v")).where("v IS NOT NULL AND query_id IS NOT NULL")
    v = vectors.select(F.col("clip_id").cast("string").alias("clip_id"), F.col("vector").cast("array<double>").alias("v")).where("v IS NOT NULL")
    q = durable(q)
    counts = q.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    per = max((query_numbers or QUERY_NUMBERS) // max(counts.d or 1, 1), 1)
    blocks = max(-(-counts.n // per), 1)
    parts = []
    for i in range(blocks):
        own = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        found = _nearest_of(own, v, k)
        parts.append(found if blocks == 1 else durable(found))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every


def _nearest_of(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    import numpy as np

    rows = queries.orderBy("query_id").collect()  # a block, bounded by QUERY_NUMBERS
    unit = _unit_rows(np.array([r.v for r in rows], dtype="float64").reshape(len(rows), len(rows[0].v) if rows else 0))
    shared = queries.sparkSession.sparkContext.broadcast(([r.query_id for r in rows], unit))

    def stream(batches):
        import pyarrow as pa

        ids, m = shared.value
        best = np.zeros((len(ids), 0))
        names = np.zeros((len(ids), 0), dtype=object)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own = np.array(batch.column("clip_id").to_pylist(), dtype=object)
            flat = batch.column("v")
            w = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            scores = np.round(m @ _unit_rows(w).T, 12)
            scores[np.isnan(scores)] = -2
            scores[np.array(ids, dtype=object)[:, None] == own[None, :]] = -3
            best, names = np.hstack([best, scores]), np.hstack([names, np.broadcast_to(own, scores.shape)])
            if best.shape[1] > k:  # those of equal score by id: sorted by id first, then stably by score
                order = np.argsort(names, axis=1, kind="stable")
                best, names = np.take_along_axis(best, order, 1), np.take_along_axis(names, order, 1)
                order = np.argsort(-best, axis=1, kind="stable")[:, :k]
                best, names = np.take_along_axis(best, order, 1), np.take_along_axis(names, order, 1)
        i, j = np.nonzero(best > -1.5)
        columns = [pa.array([ids[x] for x in i], pa.string()), pa.array(names[i, j].tolist(), pa.string()), pa.array(best[i, j], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "clip_id", "score"])

    found = vectors.mapInArrow(stream, "query_id string, clip_id string, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "clip_id")  # k rows of each partition
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit_rows(m):
    import numpy as np

    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def equal_error_rate(scores: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """One row: eer, threshold. ``positive`` tells which rows should score high.

    Thresholds are the midpoints between neighbouring distinct scores (the only score if there is one). At each the
    rejected positives and accepted negatives are counted; where both rates are closest, eer is their mean. Distinct
    scores are counted in ranges, so that no task sees all of them.
    """
    from sonoframe.operators.frames import numbered

    each = scores.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    rows = numbered(each, "s", "_at").withColumn("_r", F.floor(F.col("_at") / 10_000))
    parts = rows.groupBy("_r").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"), F.min("s").alias("_s"))
    over = Window.partitionBy().orderBy("_r")  # a row per 10,000 distinct scores
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    parts = parts.select("_r", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.sum("_p").over(everything).alias("_P"), F.sum("_n").over(everything).alias("_N"), F.lead("_s").over(over).alias("_after"))
    local = Window.partitionBy("_r").orderBy("s")
    run = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(parts, "_r").select(
        "s", (F.col("_p0") + F.sum("p").over(run)).alias("rejected"), (F.col("_N") - F.col("_n0") - F.sum("n").over(run)).alias("accepted"),
        "_P", "_N", F.coalesce(F.lead("s").over(local), F.col("_after")).alias("_to"), F.count("*").over(local.rowsBetween(Window.unboundedPreceding, 0)).alias("_k"),
    )
    rows = rows.withColumns({"frr": F.try_divide("rejected", "_P"), "far": F.try_divide("accepted", "_N"), "threshold": (F.col("s") + F.coalesce("_to", F.col("s"))) / 2})
    gap = F.struct(F.col("_to").isNull().alias("last"), F.abs(F.col("far") - F.col("frr")).alias("g"), F.col("threshold"))
    best = rows.agg(F.min_by(F.struct(((F.col("far") + F.col("frr")) / 2).alias("eer"), F.col("threshold")), gap).alias("b"))
    return best.select("b.*")


def scored_lists(positives: DataFrame, negatives: DataFrame, score: str = "score") -> DataFrame:
    """Two lists of scores as input of :func:`equal_error_rate`."""
    return positives.select(F.col(score).alias("score"), F.lit(True).alias("positive")).unionByName(negatives.select(F.col(score).alias("score"), F.lit(False).alias("positive")))


# whole representations: rows (x array, y array) of the same sample


def _moments(rows: DataFrame, x: str, y: str):
    """n, sums and cross products of [x, y]: partial sums per Arrow batch, one row of d*d numbers per partition."""
    import numpy as np
    import pandas as pd

    def part(batches):
        total = None
        for b in batches:
            if not len(b):
                continue
            m = np.hstack([np.ones((len(b), 1)), np.stack(b["x"].to_list()), np.stack(b["y"].to_list())])
            total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    first = rows.select(F.size(x).alias("a"), F.size(y).alias("b")).first()
    if first is None:
        raise ValueError("no samples")
    sums = rows.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")).mapInPandas(part, "i int, v double")
    d = 1 + first.a + first.b
    flat = np.zeros(d * d)
    for r in sums.groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[r.i] = r.v
    m = flat.reshape(d, d)
    n, mu = m[0, 0], m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] - n * np.outer(mu, mu)
    return n, mu, cov, first.a


def _scaled(cov, n, standardize):
    import numpy as np

    if not standardize:
        return cov
    s = 1 / (np.sqrt(np.maximum(np.diag(cov), 0) / max(n - 1, 1)) + 1e-8)
    return cov * np.outer(s, s)


def canonical_correlation(rows: DataFrame, x: str = "x", y: str = "y", standardize: bool = True) -> float:
    """Mean squared canonical correlation of two representations, by one distributed pass for the moments."""
    import numpy as np

    n, _, cov, a = _moments(rows, x, y)
    c = _scaled(cov, n, standardize)
    # |Qx' Qy|^2 = tr(Sxx^-1 Sxy Syy^-1 Syx); directions without variance add nothing
    value = np.trace(np.linalg.pinv(c[:a, :a], rcond=1e-10, hermitian=True) @ c[:a, a:] @ np.linalg.pinv(c[a:, a:], rcond=1e-10, hermitian=True) @ c[a:, :a])
    return float(value / min(a, len(c) - a))


def linear_alignment(rows: DataFrame, x: str = "x", y: str = "y", standardize: bool = True, reg: float = 1e-6) -> float:
    """Centered kernel alignment with linear kernels. The n x n matrices are never built: their inner products follow
    from the d x d cross products, the regularized diagonal included."""
    import numpy as np

    n, _, cov, a = _moments(rows, x, y)
    c = _scaled(cov, n, standardize)
    xx, xy, yy = c[:a, :a], c[:a, a:], c[a:, a:]
    tx, ty, rest = np.trace(xx), np.trace(yy), reg * reg * (n - 1)
    top = (xy**2).sum() + reg * (tx + ty) + rest
    bottom = np.sqrt(((xx**2).sum() + 2 * reg * tx + rest) * ((yy**2).sum() + 2 * reg * ty + rest)) + 1e-8
    return float(min(top / bottom, 1.0))


def _spread(rows: DataFrame, column: str):
    """Mean and sample deviation of each position, a row per position on the driver."""
    import numpy as np

    each = rows.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("s"))
    got = sorted(each.collect())
    return np.array([r.m for r in got]), np.array([r.s for r in got])


def rbf_alignment(rows: DataFrame, x: str = "x", y: str = "y", standardize: bool = True, threshold: float = 1.0, reg: float = 1e-6, block_rows: int = 1024) -> float:
    """Centered kernel alignment with Gaussian kernels whose width is the median squared distance (the lower one of
    two) times threshold squared.

    Samples are cut into blocks of about ``block_rows`` and each pair of blocks is one task. The median is found exactly
    by four counting passes over the distances, 16 bits of the number each; the centered inner products follow from
    sums over the blocks and over each sample's row. The driver sees at most 2 x 65536 counts a pass.
    """
    import numpy as np
    import pandas as pd

    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.monotonically_increasing_id().alias("id"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"))
    pairs = durable(pairs)  # ids must be the same in each pass
    n = pairs.count()
    if not n:
        raise ValueError("no samples")
    scale = {c: _spread(pairs, c) if standardize else None for c in "xy"}
    blocks = n // block_rows + 1
    numbered = pairs.withColumn("b", F.pmod("id", F.lit(blocks)).cast("int")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # a block meets itself once: its rows then come in one copy
    met = numbered.select("id", "x", "y", "b", F.least("b", "_k").alias("i"), F.greatest("b", "_k").alias("j")).repartition(min(blocks * (blocks + 1) // 2, 2000), "i", "j")

    def distances(key, pdf, c):
        """Ids of both sides and the squared distances between them."""
        pdf = pdf.sort_values("id")
        p, q = pdf[pdf["b"] == key[0]], pdf[pdf["b"] == key[1]]
        if not len(p) or not len(q):
            return p["id"].to_numpy(), q["id"].to_numpy(), np.zeros((len(p), len(q)))
        m, o = np.stack(p[c].to_list()), np.stack(q[c].to_list())
        if scale[c] is not None:
            mean, s = scale[c]
            m, o = (m - mean) / (s + 1e-8), (o - mean) / (s + 1e-8)
        d = np.maximum((m * m).sum(1)[:, None] + (o * o).sum(1)[None, :] - 2 * (m @ o.T), 0)
        if key[0] == key[1]:
            np.fill_diagonal(d, np.where(np.isnan(np.diag(d)), np.nan, 0))
        d[np.isnan(d)] = np.nan
        return p["id"].to_numpy(), q["id"].to_numpy(), d

    known = {"x": 0, "y": 0}  # the median's leading bits; numbers from 0 up have the order of their bits
    rank = {"x": (n * n - 1) // 2, "y": (n * n - 1) // 2}

    def counter(shift, known):
        def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            parts = []
            for c in "xy":
                bits = (distances(key, pdf, c)[2] + 0.0).view(np.int64).ravel()
                if shift < 48:
                    bits = bits[bits >> (shift + 16) == known[c]]
                v = np.bincount((bits >> shift) & 0xFFFF, minlength=1)
                at = np.flatnonzero(v)
                parts.append(pd.DataFrame({"side": c, "bin": at.astype("int32"), "v": v[at].astype("int64") * (1 if key[0] == key[1] else 2)}))
            return pd.concat(parts)

        return count

    for shift in (48, 32, 16, 0):
        counts = met.groupBy("i", "j").applyInPandas(counter(shift, dict(known)), "side string, bin int, v bigint").groupBy("side", "bin").agg(F.sum("v").alias("v")).collect()
        for c in "xy":
            got = sorted((r.bin, r.v) for r in counts if r.side == c)
            total = np.cumsum([v for _, v in got])
            k = min(int(np.searchsorted(total, rank[c], side="right")), len(got) - 1)
            rank[c] -= int(total[k - 1]) if k else 0
            known[c] = known[c] << 16 | got[k][0]
    width = {c: 2 * threshold**2 * max(float(np.int64(known[c]).view(np.float64)), 1e-10) for c in "xy"}
    middle = float(np.exp(-1 / (2 * threshold**2)))

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k = {}
        for c in "xy":
            p, q, d = distances(key, pdf, c)
            k[c] = np.exp(-d / width[c]) - middle  # centering takes any constant away; this one keeps the sums small
            if key[0] == key[1]:
                k[c] += reg * np.eye(len(p))
        times = 1 if key[0] == key[1] else 2
        parts = [pd.DataFrame({"id": p, "r": k["x"].sum(1), "s": k["y"].sum(1), "xx": 0.0, "xy": 0.0, "yy": 0.0})]
        if times == 2:
            parts.append(pd.DataFrame({"id": q, "r": k["x"].sum(0), "s": k["y"].sum(0), "xx": 0.0, "xy": 0.0, "yy": 0.0}))
        parts.append(pd.DataFrame({"id": [-1], "r": 0.0, "s": 0.0, "xx": times * (k["x"] ** 2).sum(), "xy": times * (k["x"] * k["y"]).sum(), "yy": times * (k["y"] ** 2).sum()}))
        return pd.concat(parts)

    each = met.groupBy("i", "j").applyInPandas(sums, "id bigint, r double, s double, xx double, xy double, yy double").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("r", "s", "xx", "xy", "yy")])
    t = each.agg(*[F.sum(c).alias(c) for c in ("r", "s", "xx", "xy", "yy")], *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("rr", "rs", "ss")]).first()
    inner = lambda whole, by_row, a, b: whole - 2 / n * by_row + a * b / n**2
    top, a, b = inner(t.xy, t.rs, t.r, t.s), inner(t.xx, t.rr, t.r, t.r), inner(t.yy, t.ss, t.s, t.s)
    return float(min(top / (np.sqrt(max(a, 0)) * np.sqrt(max(b, 0)) + 1e-8), 1.0))


def principal_components(rows: DataFrame, column: str, n_components: int = 2) -> DataFrame:
    """``rows`` with projected: the first components of the centered vectors; signs so that each component's largest
    weight is positive. Moments come from one distributed pass."""
    import numpy as np

    if n_components < 1:
        raise ValueError("at least one component")
    _, mu, cov, a = _moments(rows, column, column)
    if n_components > a:
        raise ValueError("no more components than dimensions")
    values, vectors = np.linalg.eigh(cov[:a, :a])
    w = vectors[:, np.argsort(-values)[:n_components]].T
    w *= np.sign(w[np.arange(len(w)), np.abs(w).argmax(axis=1)])[:, None]
    v = F.col(column).cast("array<double>")
    centred = F.zip_with(v, F.array(*[F.lit(float(m)) for m in mu[:a]]), lambda p, q: p - q)
    one = lambda r: F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(z)) for z in r]), lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return rows.withColumn("projected", F.array(*[one(r) for r in w]))


def reduced(rows: DataFrame, column: str, model: str = "pca", n_components: int = 2, reducer=None) -> DataFrame:
    """Dimensionality reduction: ``pca`` here; ``tsne`` and ``umap`` by an injected callable (matrix -> matrix) on all
    rows at once, as these methods need."""
    if model == "pca":
        return principal_components(rows, column, n_components)
    if model not in ("tsne", "umap"):
        raise ValueError(f"unknown model {model!r}")
    if reducer is None:
        raise ValueError(f"{model} needs a reducer")
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf["projected"] = [list(map(float, r)) for r in reducer(np.stack(pdf[column].to_list()), n_components)]
        return pdf

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return durable(rows).groupBy(F.lit(0)).applyInPandas(run, f"{schema}, projected array<double>")


def correlation_of_pairs(df: DataFrame, a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant (``corr`` would raise)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
