"""Quality of recordings: which evaluations apply, their values per clip and per window, wide and long."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.operators.checks import CHECKS, LENGTH_CHECK, check_column, length_zero_check
from sonoframe.operators.frames import windows_in_seconds
from sonoframe.operators.metrics import ALL, with_metrics
from sonoframe.operators.taxonomy import Taxonomy, bioacoustic

#: Seconds of the windows of a quality report, and of a single evaluation.
WINDOW, STEP = 0.025, 0.0125
SINGLE_WINDOW, SINGLE_STEP = 0.02, 0.01


def plan_evaluations(names: list[str]) -> tuple[list[str], list[str]]:
    """(metrics to compute, checks to derive) for ``names`` in any order: a check's metric is computed once, however
    many checks are held against it. A name that is neither a metric nor a check raises."""
    checks = [n for n in names if n in CHECKS or n == LENGTH_CHECK]
    unknown = [n for n in names if n not in checks and n not in ALL]
    if unknown:
        raise ValueError(f"unknown evaluations: {unknown}")
    metrics = [n for n in names if n in ALL] + [CHECKS[n].metric for n in checks if n in CHECKS]
    return list(dict.fromkeys(metrics)), checks


def evaluate(clips: DataFrame, names: list[str], lines: DataFrame | None = None, route: str = "kernel", thresholds: dict[str, tuple] | None = None) -> DataFrame:
    """``clips`` without its samples, with a column per evaluation. ``thresholds`` may give other bounds of checks."""
    metrics, checks = plan_evaluations(names)
    df = with_metrics(clips, metrics, lines, route)
    bounds = thresholds or {}
    columns: dict[str, Column] = {}
    for name in checks:
        columns[name] = length_zero_check(F.col("channels")) if name == LENGTH_CHECK else check_column(name, F.col(CHECKS[name].metric), *bounds.get(name, ()))
    keep = [c for c in clips.columns if c != "channels"]
    values = {n: F.col(n) for n in metrics} | columns
    return df.select(*keep, *[values[n].alias(n) for n in names])


def with_activity(clips: DataFrame, activities: DataFrame | None, tree: Taxonomy) -> DataFrame:
    """With the clip's activity of ``activities`` (clip_id, activity; one row a clip), the root's name without one."""
    if activities is None:
        return clips.withColumn("activity", F.lit(tree.name))
    mapped = activities.select("clip_id", F.col("activity").alias("_activity"))
    return clips.join(mapped, "clip_id", "left").withColumn("activity", F.coalesce("_activity", F.lit(tree.name))).drop("_activity")


def by_activity(clips: DataFrame, tree: Taxonomy, activities: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Activities that have the same evaluations, together: evaluations -> activities."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for a in activities:
        groups.setdefault(tuple(tree.evaluations_for(a)), []).append(a)
    return groups


def check_quality(clips: DataFrame, activities: DataFrame | None = None, tree: Taxonomy | None = None, lines: DataFrame | None = None, route: str = "kernel") -> DataFrame:
    """The wide report: a row per clip with its activity and a column per evaluation of the tree, null where the
    evaluation doesn't belong to the clip's activity. An activity that the tree doesn't know raises when it is met.

    Activities differ in evaluations only, and all clips are evaluated in one pass: a column is kept where the
    activity has it.
    """
    tree = tree or bioacoustic()
    known = {path[-1]: tree.evaluations_for(path[-1]) for path, _ in tree.walk()}
    names = list(dict.fromkeys(e for own in known.values() for e in own))
    rows = with_activity(clips, activities, tree)
    fine = F.assert_true(F.col("activity").isin(list(known)), F.concat(F.lit("unknown activity "), F.col("activity"))).isNull()
    rows = rows.withColumn("activity", F.when(fine, F.col("activity")))
    wide = evaluate(rows, names, lines, route)
    for name in names:
        owners = [a for a, own in known.items() if name in own]
        if len(owners) < len(known):
            wide = wide.withColumn(name, F.when(F.col("activity").isin(owners), F.col(name)))
    return wide


def windowed(clips: DataFrame, names: list[str], window_sec: float = WINDOW, step_sec: float = STEP, route: str = "kernel") -> DataFrame:
    """The long report of windows: clip_id, evaluation_name, window_start, window_end, value.

    Sizes are cut to whole samples. Windows begin at 0, step, ...; their ends in the report are start + window even
    beyond the clip. Checks become 1 and 0. An evaluation of which one window is null has no rows for that clip at all.
    """
    rows = windows_in_seconds(clips.select("clip_id", "sampling_rate", "channels"), window_sec, step_sec)
    rows = rows.withColumns({"window_start": F.col("window_index") * F.lit(step_sec), "window_end": F.col("window_index") * F.lit(step_sec) + F.lit(window_sec)})
    wide = evaluate(rows.select("clip_id", "sampling_rate", "channels", "window_start", "window_end"), names, None, route)
    return drop_broken_series(long_form(wide, ["clip_id", "window_start", "window_end"], names))


def long_form(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, evaluation_name, value: a row per evaluation column."""
    pairs = F.array(*[F.struct(F.lit(n).alias("evaluation_name"), F.col(n).cast("double").alias("value")) for n in names])
    return wide.select(*keys, F.explode(pairs).alias("_p")).select(keys[0], "_p.evaluation_name", *keys[1:], "_p.value")


def drop_broken_series(rows: DataFrame) -> DataFrame:
    """Without the series (clip and evaluation) of which a window is null. The broken series are found by an aggregate
    and taken out by a join, so a clip of any number of windows is never in one task."""
    broken = rows.where("value IS NULL").select("clip_id", "evaluation_name").distinct()
    return rows.join(broken, ["clip_id", "evaluation_name"], "left_anti")


def with_cached(wide: DataFrame, cached: DataFrame, names: list[str]) -> DataFrame:
    """``wide`` with values of ``cached`` (clip_id, evaluation_name, value; window-free rows) in place of its own."""
    kept = cached.where(F.col("evaluation_name").isin(names)).groupBy("clip_id").pivot("evaluation_name", names).agg(F.first("value"))
    kept = kept.withColumnsRenamed({n: f"_c_{n}" for n in names})
    kinds = dict(wide.dtypes)
    rows = wide.join(kept, "clip_id", "left")
    return rows.withColumns({n: F.coalesce(F.col(f"_c_{n}").cast(kinds[n]), F.col(n)) for n in names}).drop(*[f"_c_{n}" for n in names])


def missing(clips: DataFrame, cached: DataFrame, names: list[str]) -> DataFrame:
    """clip_id, evaluation_name: what has no result yet."""
    wanted = clips.select("clip_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("evaluation_name"))
    return wanted.join(cached.select("clip_id", "evaluation_name"), ["clip_id", "evaluation_name"], "left_anti")


def flatten_records(records: DataFrame, names: list[str]) -> DataFrame:
    """A row per record (clip_id, path, activity, evaluations map) with a column for each of ``names``."""
    return records.select("clip_id", "path", "activity", *[F.try_element_at("evaluations", F.lit(n)).alias(n) for n in names])


def flatten_windowed_records(records: DataFrame) -> DataFrame:
    """clip_id, evaluation_name, window_start, window_end, value of records with time_windows (array of start and end)
    and windowed_evaluations (map to arrays); values beyond the windows are dropped."""
    each = records.select("clip_id", "time_windows", F.explode("windowed_evaluations").alias("evaluation_name", "_values"))
    each = each.select("clip_id", "evaluation_name", "time_windows", F.posexplode("_values").alias("_i", "value")).where(F.col("_i") < F.size("time_windows"))
    at = F.get("time_windows", F.col("_i"))
    return each.select("clip_id", "evaluation_name", at["start"].alias("window_start"), at["end"].alias("window_end"), "value")


def save_results(wide: DataFrame, long: DataFrame | None, folder: str, mode: str = "overwrite") -> None:
    """Parquet tables ``wide`` and ``long`` in ``folder``, and both as CSV beside them."""
    for name, df in (("wide", wide), ("long", long)):
        if df is not None:
            df.write.mode(mode).parquet(f"{folder}/{name}")
            df.write.mode(mode).option("header", True).csv(f"{folder}/{name}_csv")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
