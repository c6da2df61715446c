"""Trees of script lines (utterance > sub-segment > word > character) as a table of nodes.

A node has clip_id, node_path (``/0/2``: the third child of the first line), level (0 for lines), ord (its place under
its parent), text, speaker, start_sec and end_sec.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def cleaned(lines: DataFrame) -> DataFrame:
    """Texts and speakers stripped of white space; a line with neither, or with a negative time, raises when read."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    text, speaker = strip(F.col("text")), strip(F.col("speaker"))
    named = (F.coalesce(text, F.lit("")) != "") | (F.coalesce(speaker, F.lit("")) != "")
    timely = (F.coalesce("start_sec", F.lit(0.0)) >= 0) & (F.coalesce("end_sec", F.lit(0.0)) >= 0)
    fine = F.assert_true(named, F.lit("a script line needs a text or a speaker")).isNull() & F.assert_true(timely, F.lit("times can't be negative")).isNull()
    return lines.withColumns({"text": F.when(fine, text), "speaker": speaker})


def inherited_times(nodes: DataFrame) -> DataFrame:
    """Nodes without times take the start of their first child and the end of their last one, if both have them."""
    below = nodes.where("level > 0").groupBy("clip_id", parent_path(F.col("node_path")).alias("node_path")).agg(F.min_by("start_sec", "ord").alias("_s"), F.max_by("end_sec", "ord").alias("_e"))
    none = F.col("start_sec").isNull() & F.col("end_sec").isNull() & F.col("_s").isNotNull() & F.col("_e").isNotNull()
    rows = nodes.join(below, ["clip_id", "node_path"], "left")
    return rows.withColumns({"start_sec": F.when(none, F.col("_s")).otherwise(F.col("start_sec")), "end_sec": F.when(none, F.col("_e")).otherwise(F.col("end_sec"))}).drop("_s", "_e")


def _ordinals(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: x.cast("int"))


def remove_level(nodes: DataFrame, level: int, keep_lower: bool = True) -> DataFrame:
    """Without the nodes of ``level``. Their children move up to the parents, in order; without ``keep_lower`` all
    below goes too. Numbers are counted anew under each parent."""
    if not keep_lower:
        return nodes.where(F.col("level") < level)
    kept = nodes.where(F.col("level") != level)
    rows = kept.withColumn("_numbers", _ordinals(F.col("node_path")))
    moved = rows.where(F.col("level") == level + 1).select("clip_id", "_numbers")
    # a child's new place follows from its old parent's place and its own
    under = Window.partitionBy("clip_id", F.slice("_numbers", 1, level)).orderBy("_numbers")
    moved = moved.select("clip_id", F.col("_numbers").alias("_head"), (F.row_number().over(under) - 1).alias("_place"))
    low = rows.where(F.col("level") > level).withColumn("_head", F.slice("_numbers", 1, level + 2)).join(moved, ["clip_id", "_head"])
    fresh = F.concat(F.slice("_head", 1, level), F.array("_place"), F.slice("_numbers", F.lit(level + 3), F.size("_numbers")))
    low = low.withColumn("node_path", F.concat(F.lit("/"), F.array_join(fresh.cast("array<string>"), "/"))).withColumn("level", F.col("level") - 1).withColumn("ord", F.element_at(fresh, -1))
    return rows.where(F.col("level") < level).select(*nodes.columns).unionByName(low.select(*nodes.columns))


def keep_levels(nodes: DataFrame, utterance: bool = False, word: bool = False, char: bool = False) -> DataFrame:
    """Only the wanted levels of aligned trees (0 utterance, 1 sub-segment, 2 word, 3 character): without words and
    characters level 2 and all below goes; without words level 2 is spliced out; without characters level 3 goes;
    without utterances level 0 is spliced out."""
    rows = nodes
    if not word and not char:
        rows = remove_level(rows, 2, keep_lower=False)
    elif not word:
        rows = remove_level(rows, 2)
    elif not char:
        rows = remove_level(rows, 3)
    return rows if utterance else remove_level(rows, 0)


def flattened(nested: DataFrame, column: str = "lines") -> DataFrame:
    """One level of nesting less; null elements stay."""
    return nested.withColumn(column, F.flatten(F.transform(column, lambda x: F.coalesce(x, F.array(F.lit(None))))))


def formatted(text: Column, speaker: Column, start: Column, end: Column) -> Column:
    """``speaker: text [s.ss - e.ee]``, parts left out where null; times are rounded half up as written in decimals."""
    head = F.when(F.coalesce(speaker, F.lit("")) != "", F.concat(speaker, F.lit(": "))).otherwise("")
    times = F.when(start.isNotNull() & end.isNotNull(), F.format_string(" [%.2f - %.2f]", start, end)).otherwise("")
    return F.concat(head, F.coalesce(text, F.lit("")), times)


def indented(nodes: DataFrame) -> DataFrame:
    """clip_id, node_path, line: each node as a line, four blanks deeper per level."""
    line = formatted(F.col("text"), F.col("speaker"), F.col("start_sec"), F.col("end_sec"))
    return nodes.select("clip_id", "node_path", F.concat(F.repeat(F.lit("    "), F.col("level")), line).alias("line"))


def differences(one: DataFrame, two: DataFrame, tolerance: float = 0.1, check_text: bool = True) -> DataFrame:
    """clip_id, node_path, start_diff, end_diff, same_text, ok of the nodes of two alignments. Children are held
    against each other only where both parents have as many. Texts are compared without case, where both have one."""
    kids = lambda d: d.where("level > 0").groupBy("clip_id", parent_path(F.col("node_path")).alias("_up")).agg(F.count("*").alias("_k"))
    a = one.withColumn("_up", parent_path(F.col("node_path")))
    uneven = kids(one).withColumnRenamed("_k", "_a").join(kids(two).withColumnRenamed("_k", "_b"), ["clip_id", "_up"], "full").where("NOT (_a <=> _b)")
    uneven = uneven.select("clip_id", F.col("_up").alias("_broken"))
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.col("level"), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split("node_path", "/"), lambda x: x != ""), 1, i), "/")))
    below = a.where("level > 0").select("clip_id", "node_path", F.explode(ups).alias("_broken")).where("_broken <> node_path")
    out = below.join(uneven, ["clip_id", "_broken"], "left_semi").select("clip_id", "node_path").distinct()
    b = two.select("clip_id", "node_path", F.col("text").alias("_t"), F.col("start_sec").alias("_s"), F.col("end_sec").alias("_e"))
    rows = a.join(out, ["clip_id", "node_path"], "left_anti").join(b, ["clip_id", "node_path"])
    same = F.when((F.coalesce("text", F.lit("")) != "") & (F.coalesce("_t", F.lit("")) != ""), F.lower("text") == F.lower("_t")).otherwise(True)
    rows = rows.select("clip_id", "node_path", F.abs(F.col("start_sec") - F.col("_s")).alias("start_diff"), F.abs(F.col("end_sec") - F.col("_e")).alias("end_diff"), same.alias("same_text"))
    near = lambda c: F.coalesce(F.col(c) < tolerance, F.lit(True))
    return rows.withColumn("ok", near("start_diff") & near("end_diff") & (F.col("same_text") if check_text else F.lit(True)))


def assert_alike(one: DataFrame, two: DataFrame, tolerance: float = 0.1, check_text: bool = True) -> None:
    bad = differences(one, two, tolerance, check_text).where(~F.col("ok")).limit(1).collect()
    if bad:
        raise AssertionError(f"alignments differ at {bad[0].clip_id}{bad[0].node_path}")
