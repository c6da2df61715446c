"""Registered queries on nested records and on intervals, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.operators.intervals import speaking_periods
from sonoframe.operators.nested import all_nodes, node_table, pose_nodes, record_nodes
from sonoframe.sources.tables import load


def p2_found(spark, d):
    return all_nodes(load(spark, d, "raw_records"), load(spark, d, "image_poses"))


def p2_chunks(spark, d):
    return node_table(record_nodes(load(spark, d, "raw_records")), "chunk", ["text", "speaker", "start_sec", "end_sec"])


def p2_segments(spark, d):
    return node_table(record_nodes(load(spark, d, "raw_records")), "segment", ["text", "start_sec", "end_sec"])


def p2_words(spark, d):
    return node_table(record_nodes(load(spark, d, "raw_records")), "word", ["text", "start_sec", "end_sec", "score"])


def p2_individuals(spark, d):
    return node_table(pose_nodes(load(spark, d, "image_poses")), "individual", ["individual_index"])


def p2_landmarks(spark, d):
    return node_table(pose_nodes(load(spark, d, "image_poses")), "landmark", ["x", "y", "z", "visibility", "confidence"])


def p3_found(spark, d):
    return speaking_periods(load(spark, d, "diar_lines"))


def p3_totals(spark, d):
    """Speaking and silent milliseconds of each clip and speaker."""
    rows = speaking_periods(load(spark, d, "diar_lines"))
    length = F.col("to_ms") - F.col("from_ms")
    return rows.groupBy("clip_id", "speaker").agg(
        F.sum(F.when(F.col("kind") == "period", length)).alias("spoken_ms"),
        F.coalesce(F.sum(F.when(F.col("kind") == "gap", length)), F.lit(0)).cast("bigint").alias("silent_ms"),
        F.count(F.when(F.col("kind") == "period", 1)).alias("n_periods"),
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_chunks, p2_segments, p2_words, p2_individuals, p2_landmarks, p3_found, p3_totals)}

_PERIODS = """
WITH rounded AS (SELECT clip_id, upper(regexp_replace(speaker, '^\\s+|\\s+$', '', 'g')) AS speaker,
    CAST(round(start_sec * 1000) AS BIGINT) AS a, CAST(round(end_sec * 1000) AS BIGINT) AS b
  FROM diar_lines WHERE start_sec >= 0 AND end_sec >= 0 AND NOT isnan(start_sec) AND NOT isnan(end_sec)),
usable AS (SELECT * FROM rounded WHERE b > a),
heads AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY clip_id, speaker ORDER BY a, b
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS head FROM usable),
numbered AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, speaker ORDER BY a, b
  ROWS UNBOUNDED PRECEDING) AS n FROM heads),
periods AS (SELECT clip_id, speaker, n, min(a) AS from_ms, max(b) AS to_ms FROM numbered GROUP BY 1, 2, 3),
gaps AS (SELECT clip_id, speaker, to_ms AS from_ms,
  lead(from_ms) OVER (PARTITION BY clip_id, speaker ORDER BY n) AS to_ms FROM periods),
found AS (SELECT clip_id, speaker, 'period' AS kind, from_ms, to_ms FROM periods
  UNION ALL SELECT clip_id, speaker, 'gap', from_ms, to_ms FROM gaps WHERE to_ms IS NOT NULL)
"""


def _texts(c: str) -> str:
    return f"CASE json_type({c}) WHEN 'VARCHAR' THEN json_extract_string({c}, '$') ELSE CAST({c} AS VARCHAR) END"


def _list(c: str) -> str:
    return f"""CASE WHEN NOT json_valid({c}) THEN NULL WHEN json_type({c}) = 'ARRAY' THEN json_extract({c}, '$[*]')
      WHEN json_type({c}) = 'OBJECT' THEN [CAST({c} AS JSON)] END"""


def _children(parent: str, field: str, path: str, extra: str = "") -> str:
    """Rows (record_id, node, path) of the list ``field`` of the nodes in ``parent``."""
    return f"""SELECT record_id, unnest(l) AS node, {path} || '/' || CAST(generate_subscripts(l, 1) - 1 AS VARCHAR) AS path FROM (
    SELECT record_id, {path}, {_list("t")} AS l FROM (
      SELECT record_id, {path}, {_texts("c")} AS t FROM (
        SELECT record_id, {path}, json_extract(node, '$.{field}') AS c FROM {parent} {extra})))"""


_ELEMENTS = f"""
WITH RECURSIVE ranked AS (SELECT record_id, payload, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) AS r FROM raw_records),
latest AS (SELECT record_id, payload AS p FROM ranked WHERE r = 1 AND json_valid(payload)),
opened AS (SELECT record_id, {_texts("CAST(p AS JSON)")} AS p FROM latest),
tops AS (SELECT record_id, CAST(p AS JSON) AS node, '' AS path FROM opened WHERE json_valid(p) AND json_type(p) = 'OBJECT'),
chunks AS ({_children("tops", "chunks", "path")} UNION ALL {_children("chunks", "chunks", "path", "WHERE json_type(node) = 'OBJECT'")}),
segments AS ({_children("tops", "segments", "path")}),
words AS ({_children("segments", "words", "path", "WHERE json_type(node) = 'OBJECT'")}),
records AS (SELECT record_id, 'chunk' AS kind, node, path FROM chunks UNION ALL SELECT record_id, 'segment', node, path FROM segments
  UNION ALL SELECT record_id, 'word', node, path FROM words),
nodes AS (SELECT record_id, kind, path AS node_path, regexp_replace(path, '/[^/]*$', '') AS parent_path, node FROM records WHERE json_type(node) <> 'NULL'),
images AS (SELECT image_id, individuals, row_number() OVER (PARTITION BY image_id ORDER BY ingested_at DESC) AS r FROM image_poses),
people AS (SELECT image_id AS record_id, unnest(individuals) AS one, '/' || CAST(generate_subscripts(individuals, 1) - 1 AS VARCHAR) AS path FROM images WHERE r = 1),
marks AS (SELECT record_id, path, unnest(map_entries(one.normalized_landmarks)) AS e FROM people WHERE one IS NOT NULL)
"""



def _time(field: str, at: int) -> str:
    return f"""CASE WHEN json_type(node, '$.timestamps') = 'ARRAY' AND json_array_length(node, '$.timestamps') = 2 THEN TRY_CAST(json_extract_string(node, '$.timestamps[{at}]') AS DOUBLE)
      ELSE TRY_CAST(json_extract_string(node, '$.{field}') AS DOUBLE) END AS {field}_sec"""


_PLACE = "record_id, node_path, parent_path, regexp_extract(node_path, '[^/]*$') AS place, coalesce(json_extract_string(node, '$.text'), json_extract_string(node, '$.word')) AS text"
_TIMES = f"{_time('start', 0)}, {_time('end', 1)}"

#: Elements of raw records as a tree (SQL that follows gets ``tree``: clip_id, path, level, ord and values).
TREE = (
    _ELEMENTS
    + f""", tree AS (SELECT CAST(record_id AS VARCHAR) AS clip_id, node_path, CAST(len(string_split(node_path, '/')) - 2 AS INT) AS level, CAST(regexp_extract(node_path, '[^/]*$') AS INT) AS ord,
    json_extract_string(node, '$.text') AS text, json_extract_string(node, '$.speaker') AS speaker, {_TIMES} FROM nodes WHERE kind = 'chunk')
"""
)

SQL = {
    "p2_chunks": _ELEMENTS + f"SELECT {_PLACE}, json_extract_string(node, '$.speaker') AS speaker, {_TIMES} FROM nodes WHERE kind = 'chunk'",
    "p2_segments": _ELEMENTS + f"SELECT {_PLACE}, {_TIMES} FROM nodes WHERE kind = 'segment'",
    "p2_words": _ELEMENTS + f"SELECT {_PLACE}, {_TIMES}, TRY_CAST(json_extract_string(node, '$.score') AS DOUBLE) AS score FROM nodes WHERE kind = 'word'",
    "p3_found": _PERIODS + "SELECT * FROM found",
    "p3_totals": _PERIODS
    + """SELECT clip_id, speaker, CAST(sum(CASE WHEN kind = 'period' THEN to_ms - from_ms END) AS BIGINT) AS spoken_ms,
    CAST(coalesce(sum(CASE WHEN kind = 'gap' THEN to_ms - from_ms END), 0) AS BIGINT) AS silent_ms,
    count(CASE WHEN kind = 'period' THEN 1 END) AS n_periods FROM found GROUP BY 1, 2""",
    "p2_found": _ELEMENTS
    + """SELECT record_id, kind, node_path, parent_path FROM nodes
    UNION ALL SELECT record_id, 'individual', path, '' FROM people WHERE one IS NOT NULL
    UNION ALL SELECT record_id, 'landmark', path || '/' || e.key, path FROM marks WHERE e.value IS NOT NULL""",
    "p2_individuals": _ELEMENTS
    + "SELECT record_id, path AS node_path, '' AS parent_path, path[2:] AS place, one.individual_index AS individual_index FROM people WHERE one IS NOT NULL",
    "p2_landmarks": _ELEMENTS
    + """SELECT record_id, path || '/' || e.key AS node_path, path AS parent_path, e.key AS place, e.value.x AS x, e.value.y AS y,
    e.value.z AS z, e.value.visibility AS visibility, e.value.confidence AS confidence FROM marks WHERE e.value IS NOT NULL""",
}
