"""Languages by code or name. ``languages`` has language_code, alpha_2 and language_name (a few rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolved(df: DataFrame, column: str, languages: DataFrame) -> DataFrame:
    """``df`` with language_code, alpha_2 and language_name of what ``column`` says: a two-letter code, else a
    three-letter code, else a name, without regard to case; null where it says none of them."""
    each = languages.select(
        "language_code", "alpha_2", "language_name",
        F.posexplode(F.array(F.lower("alpha_2"), F.lower("language_code"), F.lower("language_name"))).alias("_rank", "_name"),
    ).where("_name IS NOT NULL")
    best = each.groupBy("_name").agg(F.min_by(F.struct("language_code", "alpha_2", "language_name"), F.struct("_rank", "language_code")).alias("_l"))
    # a dimension of three names per language
    return df.withColumn("_name", F.lower(F.trim(column))).join(F.broadcast(best), "_name", "left").select(*[df[c] for c in df.columns], "_l.*")
