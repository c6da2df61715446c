"""Registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from sonoframe.llm import language, mixing, packing, shared, splits, turns
from sonoframe.sources.tables import load


def p1_found(spark, d):
    return p1_turn_texts(spark, d).select("clip_id", "turn_no", "speaker", "first_line_id", "last_line_id", "n_words")


def p1_turn_texts(spark, d):
    return turns.speaker_turns(load(spark, d, "transcript_lines"), load(spark, d, "speaker_codes"))


def _groups(spark, d):
    return splits.related_groups(load(spark, d, "recordings"), load(spark, d, "participants"), load(spark, d, "sessions"))


def p4_found(spark, d):
    return _groups(spark, d).where("group_key IS NOT NULL")


def p4_splits(spark, d):
    return splits.assign_splits(_groups(spark, d), load(spark, d, "split_targets"))


def p4_report(spark, d):
    return splits.split_report(p4_splits(spark, d), load(spark, d, "split_targets"))


def p5_segments(spark, d):
    transcriptions, languages = load(spark, d, "transcriptions"), load(spark, d, "languages")
    model = language.fit_language_model(transcriptions, languages, load(spark, d, "documents"))
    return language.language_segments(transcriptions, languages, model)


def p5_found(spark, d):
    return language.corrected_languages(p5_segments(spark, d)).select("transcription_id", "seg_no", "language_code")


def p6_packing(spark, d):
    return packing.pack_documents(load(spark, d, "documents"), load(spark, d, "containers"))


def p6_report(spark, d):
    return packing.packing_report(p6_packing(spark, d), load(spark, d, "containers"))


def _sized(spark, d):
    return mixing.sized_documents(load(spark, d, "documents"), load(spark, d, "languages"), load(spark, d, "mix_targets"))


#: Domain of each source of the mixes, the first level of the budget tree.
DOMAINS = [
    ("session_notes", "clinical"),
    ("clinic_letters", "clinical"),
    ("consent_forms", "clinical"),
    ("field_diaries", "personal"),
    ("forum_threads", "public"),
    ("tutorial_pages", "public"),
    ("task_protocols", "technical"),
    ("qc_reports", "technical"),
    ("asr_output", "technical"),
]


def _domains(spark):
    return spark.createDataFrame(DOMAINS, "source string, domain string")


def p7_mixes(spark, d):
    return mixing.mix_sources(_sized(spark, d), load(spark, d, "mix_targets"), domains=_domains(spark))


def p7_report(spark, d):
    sized, targets, domains = _sized(spark, d), load(spark, d, "mix_targets"), _domains(spark)
    return mixing.mix_report(mixing.mix_sources(sized, targets, domains=domains), sized, targets, domains=domains)


def _spans(spark, d):
    return shared.SharedSpans(load(spark, d, "documents"))


def p8_found(spark, d):
    return _spans(spark, d).pairs()


def p8_classes(spark, d):
    return _spans(spark, d).links()


def p8_shared_parts(spark, d):
    return shared.shared_parts(_spans(spark, d))


def p8_without_repeats(spark, d):
    return shared.without_repeats(_spans(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_turn_texts, p4_found, p4_splits, p4_report, p5_found, p5_segments, p6_packing, p6_report, p7_mixes, p7_report,
        p8_found, p8_classes, p8_shared_parts, p8_without_repeats,
    )
}

def _id(column: str) -> str:
    return f"lower(regexp_replace(regexp_replace({column}, '^\\s*\\{{?\\s*(urn:uuid:)?|\\}}?\\s*$', '', 'gi'), '[-_\\s]', '', 'g'))"


_WINDOWS = """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 300), i AS (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM d),
w AS (SELECT doc_id, i, hash(substring(text, i, 300)) AS h FROM i), g AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), s AS (SELECT w.* FROM w JOIN g USING (h))
"""

_GROUPS = f"""
WITH RECURSIVE r AS (SELECT clip_id, {_id("participant_id")} AS p, {_id("session_id")} AS s FROM recordings),
raw AS (SELECT p || 'p' AS a, s || 's' AS b FROM r UNION SELECT {_id("id")} || 'p', {_id("metadata['same_as']")} || 'p' FROM participants
  UNION SELECT {_id("id")} || 's', {_id("metadata['continues']")} || 's' FROM sessions),
e AS (SELECT a, b FROM raw WHERE regexp_matches(a, '^[0-9a-f]{{32}}.$') AND regexp_matches(b, '^[0-9a-f]{{32}}.$') AND a NOT LIKE repeat('0', 32) || '_' AND b NOT LIKE repeat('0', 32) || '_'),
sides AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n AS (SELECT clip_id, min(x) AS x FROM (SELECT clip_id, CASE WHEN regexp_matches(p, '^[0-9a-f]{{32}}$') AND p <> repeat('0', 32) THEN p || 'p' WHEN regexp_matches(s, '^[0-9a-f]{{32}}$') AND s <> repeat('0', 32) THEN s || 's' END AS x FROM r)
  WHERE x IS NOT NULL GROUP BY 1),
reach AS (SELECT a AS x, a AS y FROM sides UNION SELECT reach.x, sides.b FROM reach JOIN sides ON sides.a = reach.y),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY 1), groups AS (SELECT clip_id, regexp_replace(coalesce(y, n.x)[1:32], '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS group_key FROM n LEFT JOIN least ON least.x = n.x)
"""

#: Groups one by one, largest first, each to the split that lacks most; then groups of one size in order of their MD5.
_SPLITS = _GROUPS + """, k AS (SELECT clip_id, coalesce(group_key, 'clip ' || coalesce(CAST(clip_id AS VARCHAR), '')) AS key FROM (SELECT DISTINCT clip_id FROM recordings) LEFT JOIN groups USING (clip_id)),
z AS (SELECT key, count(*) AS size FROM k GROUP BY 1), o AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS no FROM z),
t AS (SELECT list(split_name ORDER BY split_name) AS names, list(CAST(round(target_share * 1000000) AS HUGEINT) ORDER BY split_name) AS parts, (SELECT CAST(sum(size) AS HUGEINT) FROM z) AS total FROM split_targets),
greedy AS (SELECT CAST(0 AS BIGINT) AS no, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS pick, list_transform(parts, lambda x: x * total) AS lacks FROM t
  UNION ALL SELECT o.no, o.size, CAST(list_position(lacks, list_max(lacks)) AS BIGINT), list_transform(lacks, lambda x, i: x - CASE WHEN i = list_position(lacks, list_max(lacks)) THEN o.size * list_sum(parts) ELSE 0 END)
  FROM greedy JOIN o ON o.no = greedy.no + 1, t),
q AS (SELECT size, pick, count(*) AS c FROM greedy WHERE no > 0 GROUP BY 1, 2), w AS (SELECT *, sum(c) OVER (PARTITION BY size ORDER BY pick) - c AS low FROM q),
x AS (SELECT key, size, row_number() OVER (PARTITION BY size ORDER BY md5(key)) - 1 AS rank FROM z),
placed AS (SELECT clip_id, names[pick] AS split_name FROM k JOIN x USING (key) JOIN w ON w.size = x.size AND rank >= low AND rank < low + c, t)
"""

SQL: dict[str, str] = {
    "p4_found": _GROUPS + "SELECT * FROM groups",
    "p4_splits": _SPLITS + "SELECT * FROM placed",
    "p4_report": _SPLITS + """SELECT split_name, target_share, coalesce(n, 0) AS n_clips, coalesce(n, 0) / (SELECT count(*) FROM placed) AS actual_share
FROM split_targets LEFT JOIN (SELECT split_name, count(*) AS n FROM placed GROUP BY 1) USING (split_name)""",
    "p8_found": _WINDOWS + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p8_classes": _WINDOWS
    + """, p AS (SELECT a.doc_id, count(DISTINCT b.doc_id) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n FROM d)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n, 1) AS n_copies, coalesce(k, 0) AS n_links FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id)""",
    "p8_without_repeats": _WINDOWS
    + """, m AS (SELECT h, min(doc_id) AS m FROM s GROUP BY 1), e AS (SELECT DISTINCT doc_id, i FROM s JOIN m USING (h) WHERE m < doc_id),
f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 300 THEN 0 ELSE 1 END AS f FROM e), o AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM f),
r AS (SELECT doc_id, g, min(i) AS a, max(i) + 300 AS b FROM o GROUP BY 1, 2), k AS (SELECT doc_id, g, a, b, lag(b, 1, 1) OVER (PARTITION BY doc_id ORDER BY g) AS z FROM r),
t AS (SELECT doc_id, string_agg(substring(text, z, a - z), '' ORDER BY g) || substring(any_value(text), max(b)) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, coalesce(kept, text) AS text, coalesce(length(text) - length(kept), 0) AS removed_chars FROM documents LEFT JOIN t USING (doc_id)""",
    "p8_shared_parts": _WINDOWS
    + """, t AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM (SELECT DISTINCT doc_id, i FROM s)),
c AS (SELECT doc_id, sum(least(300, coalesce(j - i, 300))) AS c, count(CASE WHEN j IS NULL OR j > i + 300 THEN 1 END) AS k FROM t GROUP BY 1)
SELECT doc_id, length(text) AS n_chars, CAST(coalesce(c, 0) AS BIGINT) AS shared_chars, coalesce(c / nullif(length(text), 0), 0.0) AS shared_part, coalesce(k, 0) AS n_spans FROM documents LEFT JOIN c USING (doc_id)""",
}
