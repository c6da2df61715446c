"""Including and excluding recordings by the votes of their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.plans.durable import durable

INCLUDE, EXCLUDE, ABSTAIN = 1, 0, -1

#: Texts that count as true (fixed values).
TRUE_TEXTS = ("1", "true", "t", "yes", "y")


def vote(column: Column, kind: str) -> Column:
    """A check's vote: abstain on null and NaN, exclude if true, else include."""
    if kind == "string":
        true = F.lower(F.trim(column)).isin(*TRUE_TEXTS)
        none = column.isNull()
    elif kind in ("double", "float"):
        true, none = column != 0, column.isNull() | F.isnan(column)
    else:
        true, none = column.cast("boolean"), column.isNull()
    return F.when(none, ABSTAIN).when(true, EXCLUDE).otherwise(INCLUDE)


def none_failed(columns: list[str]) -> Column:
    """Include unless a check is true; null counts as passed, NaN (which no check gives) too."""
    return F.when(F.exists(F.array(*[F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in columns]), lambda x: x), EXCLUDE).otherwise(INCLUDE)


def votes(checks: DataFrame, columns: list[str]) -> DataFrame:
    """``checks`` with a column lf_<check> per vote and lf_none_failed."""
    kinds = dict(checks.dtypes)
    return checks.withColumns({f"lf_{c}": vote(F.col(c), kinds[c]) for c in columns} | {"lf_none_failed": none_failed(columns)})


def prune_checks(checks: DataFrame, columns: list[str], threshold: float = 0.99) -> tuple[list[str], dict[str, list[str]]]:
    """(kept columns, {kept column: columns dropped for it}): constant columns go first, then each column whose
    correlation (signed) with an earlier kept one reaches the threshold. One aggregate gives all moments; only the
    matrix of the columns comes to the driver."""
    if not columns:
        return [], {}
    import numpy as np
    import pandas as pd

    d = len(columns)

    def moments(batches):
        total = np.zeros((4, d, d))
        for batch in batches:
            x = batch.to_numpy(dtype="float64")
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0), there.astype(float)
            total += np.stack([m.T @ m, x.T @ m, x.T @ x, (x * x).T @ m])
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    values = checks.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    flat = np.zeros(4 * d * d)
    for r in values.mapInPandas(moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[r.i] = r.v
    n, sx, sxy, sxx = flat.reshape(4, d, d)  # over the rows where both columns have a value
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (n * sxy - sx * sx.T) / np.sqrt((n * sxx - sx**2) * (n * sxx - sx**2).T)
    constant = np.diag(n) * np.diag(sxx) - np.diag(sx) ** 2 <= 1e-12
    kept: list[str] = []
    dropped: dict[str, list[str]] = {}
    for i, c in enumerate(columns):
        if constant[i]:
            continue
        cause = next((k for k in kept if r[columns.index(k), i] >= threshold), None)
        if cause is None:
            kept.append(c)
        else:
            dropped.setdefault(cause, []).append(c)
    return kept, dropped


def majority(columns: list[str]) -> Column:
    """Include if at least as many votes say so as say exclude, abstentions aside."""
    of = lambda v: sum((F.when(F.col(c) == v, 1).otherwise(0) for c in columns), F.lit(0))
    return F.when(of(INCLUDE) >= of(EXCLUDE), INCLUDE).otherwise(EXCLUDE)


#: Vote patterns that the driver takes, at most.
PATTERNS = 50_000


def fit_label_model(voted: DataFrame, columns: list[str], rounds: int = 50) -> tuple[float, dict[str, tuple[float, float]]]:
    """(share of includes, {vote column: (chance of voting include on an include, on an exclude)}).

    Expectation maximization over the counts of vote patterns: independent voters, majority as the start. Where there
    are more than PATTERNS patterns, a round is a pass over them on the executors, whose sums are two numbers per column
    and side; otherwise the driver has them. Both give the same.
    """
    import numpy as np

    patterns = voted.groupBy(*columns).agg(F.count("*").alias("_n"))
    rows = patterns.limit(PATTERNS + 1).collect()
    if not rows:
        return 0.5, {c: (0.5, 0.5) for c in columns}
    far = durable(patterns) if len(rows) > PATTERNS else None
    near = None if far is not None else (np.array([[r[c] for c in columns] for r in rows]), np.array([r["_n"] for r in rows], dtype=float))
    model = None
    for _ in range(rounds):
        sums = _vote_sums(*near, model) if far is None else _far_vote_sums(far, columns, model)
        model = (sums[0] / sums[1], [(sums[2 + i] + 1) / (sums[4 + i] + 2) for i in range(2)])
    share, chance = model
    return float(np.max(share)), {c: (float(a), float(b)) for c, a, b in zip(columns, *chance, strict=True)}


def _vote_sums(v, n, model):
    """Rows of a number per column: weight of includes, of all; votes to include and votes cast, on includes and excludes."""
    import numpy as np

    inc, exc, cast = v == INCLUDE, v == EXCLUDE, v != ABSTAIN
    if model is None:
        q = np.where(inc.sum(1) >= exc.sum(1), 0.9, 0.1)
    else:
        share, chance = float(np.max(model[0])), model[1]
        logs = [np.log(s) + (inc * np.log(c) + exc * np.log(1 - c)).sum(1) for s, c in zip((max(share, 1e-9), max(1 - share, 1e-9)), chance, strict=True)]
        q = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
    sides = (n * q, n * (1 - q))
    every = np.ones(v.shape[1])
    return np.stack([every * sides[0].sum(), every * n.sum(), *[(w[:, None] * inc).sum(0) for w in sides], *[(w[:, None] * cast).sum(0) for w in sides]])


def _far_vote_sums(patterns: DataFrame, columns: list[str], model):
    import numpy as np
    import pandas as pd

    def run(batches):
        total = np.zeros((6, len(columns)))
        for b in batches:
            total += _vote_sums(b[columns].to_numpy(), b["_n"].to_numpy(dtype=float), model)
        yield pd.DataFrame({"i": np.arange(total.size), "x": total.ravel()})

    flat = np.zeros(6 * len(columns))
    for r in patterns.mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        flat[r.i] = r.x
    return flat.reshape(6, -1)


def predict(columns: list[str], model: tuple[float, dict[str, tuple[float, float]]]) -> Column:
    """The label of the model, as a column expression: the sign of the log odds."""
    import math

    share, chances = model
    odds = F.lit(math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    for c in columns:
        a, b = chances[c]
        odds = odds + F.when(F.col(c) == INCLUDE, math.log(a / b)).when(F.col(c) == EXCLUDE, math.log((1 - a) / (1 - b))).otherwise(0.0)
    return F.when(odds >= 0, INCLUDE).otherwise(EXCLUDE)


def review(checks: DataFrame, columns: list[str], threshold: float = 0.99, prune: bool = True) -> DataFrame:
    """``checks`` with votes and label (INCLUDE or EXCLUDE): pruned checks, their votes and the composite one, weighed
    by the label model. Without any column left everything is INCLUDE."""
    kept = prune_checks(checks, columns, threshold)[0] if prune else columns
    if not kept:
        return checks.withColumn("label", F.lit("INCLUDE"))
    voted = votes(checks, kept)
    names = [f"lf_{c}" for c in kept] + ["lf_none_failed"]
    label = predict(names, fit_label_model(voted, names))
    return voted.withColumn("label", F.when(label == INCLUDE, "INCLUDE").otherwise("EXCLUDE"))


def reliability(voted: DataFrame, columns: list[str], label: Column) -> DataFrame:
    """lf_name, n_include, n_exclude, agreement with the label (4 places; null if it never voted), best first."""
    pairs = F.array(*[F.struct(F.lit(c).alias("lf_name"), F.col(c).alias("vote")) for c in columns])
    rows = voted.select(label.alias("_label"), F.explode(pairs).alias("_p")).select("_label", "_p.*")
    cast = F.col("vote") != ABSTAIN
    out = rows.groupBy("lf_name").agg(
        F.count_if(F.col("vote") == INCLUDE).alias("n_include"),
        F.count_if(F.col("vote") == EXCLUDE).alias("n_exclude"),
        F.round(F.avg(F.when(cast, (F.col("vote") == F.col("_label")).cast("double"))), 4).alias("agreement"),
    )
    return out.orderBy(F.desc_nulls_last("agreement"), F.desc("n_include"), "lf_name")
