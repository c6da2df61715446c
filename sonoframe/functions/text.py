"""Scores of a transcript against a reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_counts(reference: list, hypothesis: list) -> tuple[int, int, int, int]:
    """(hits, substitutions, deletions, insertions) of a shortest alignment, by rows of numpy vectors."""
    import numpy as np

    n, m = len(reference), len(hypothesis)
    ids: dict = {}
    r = np.array([ids.setdefault(x, len(ids)) for x in reference], dtype=np.int64)
    h = np.array([ids.setdefault(x, len(ids)) for x in hypothesis], dtype=np.int64)
    table = np.empty((n + 1, m + 1), dtype=np.int32)
    table[0] = np.arange(m + 1)
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.minimum(table[i - 1, 1:] + 1, table[i - 1, :-1] + (h != r[i - 1]))
        row = np.concatenate([[i], best])
        table[i] = np.minimum.accumulate(row - steps) + steps  # insertions run along the row
    hits = subs = dels = ins = 0
    i, j = n, m
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (r[i - 1] != h[j - 1]):
            hits, subs = hits + (r[i - 1] == h[j - 1]), subs + (r[i - 1] != h[j - 1])
            i, j = i - 1, j - 1
        elif i and table[i, j] == table[i - 1, j] + 1:
            dels, i = dels + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return int(hits), int(subs), int(dels), int(ins)


def word_scores(reference: Column, hypothesis: Column) -> Column:
    """Struct of wer, mer, wil and wip by words split at blanks.

    Both texts empty: no errors, all preserved. An empty reference against words has a wer per inserted word of
    infinity; a null on either side gives null scores.
    """
    import pandas as pd

    def run(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(ref, hyp, strict=True):
            if a is None or b is None:
                rows.append((None,) * 4)
                continue
            x, y = a.split(), b.split()
            c, s, d, i = edit_counts(x, y)
            wrong = s + d + i
            wip = 1.0 if not x and not y else c / len(x) * c / len(y) if x and y else 0.0
            wer = wrong / len(x) if x else float("inf") if wrong else 0.0
            rows.append((wer, wrong / (wrong + c) if wrong + c else 0.0, 1 - wip, wip))
        return pd.DataFrame(rows, columns=["wer", "mer", "wil", "wip"], dtype="object")

    run.__annotations__ = {"ref": pd.Series, "hyp": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "wer double, mer double, wil double, wip double")(reference, hypothesis)


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's characters; infinite for an empty reference against a text. In the JVM."""
    n = F.length(reference)
    d = F.levenshtein(reference, hypothesis)
    return F.when(n > 0, d / F.nullif(n, F.lit(0))).when(d == 0, 0.0).when(d > 0, float("inf"))
