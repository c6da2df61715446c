"""Registered queries on signals: metrics, checks, reports, cutting, labels; and their SQL.

Vectors of ``embeddings`` serve as one-second clips of one channel at 64 Hz, two neighbours as a stereo clip.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.functions.arrays import cosine, cross_correlation
from sonoframe.operators import features, frames, labeling, metrics, quality, results, similarity, taxonomy
from sonoframe.operators.checks import CHECKS
from sonoframe.sources.tables import load

RATE = 64


def clips(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), F.lit(RATE).alias("sampling_rate"), F.array(F.col("embedding").cast("array<double>")).alias("channels"))


def stereo(spark, d):
    rows = load(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).cast("bigint").alias("clip_id"), "vec_id", F.col("embedding").cast("array<double>").alias("w"))
    both = rows.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "w"))), lambda x: x["w"]).alias("channels"))
    return both.select("clip_id", F.lit(RATE).alias("sampling_rate"), "channels")


def rounded(df, keys):
    """All doubles to six places, infinities kept."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" and c not in keys else F.col(c) for c in df.columns])


NATIVE = [n for n in metrics.COLUMNS if n != "phase_correlation_metric"]
NATIVE_CHECKS = [n for n, c in CHECKS.items() if c.metric in NATIVE]

QUERIES: dict = {}
SQL: dict[str, str] = {}

_SAMPLES = """
WITH s AS (SELECT vec_id AS clip_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
l AS (SELECT *, lag(x) OVER (PARTITION BY clip_id ORDER BY i) AS p, avg(x) OVER (PARTITION BY clip_id) AS mu, min(x) OVER (PARTITION BY clip_id) AS lo,
  max(x) OVER (PARTITION BY clip_id) AS hi, max(abs(x)) OVER (PARTITION BY clip_id) AS top, count(*) OVER (PARTITION BY clip_id) AS n FROM s),
bins AS (SELECT clip_id, least(floor((x - lo) / (hi - lo) * 256), 255) AS b, count(*) / any_value(n) AS share FROM l GROUP BY 1, 2),
entropy AS (SELECT clip_id, -sum(share * log2(share)) AS e FROM bins GROUP BY 1),
close AS (SELECT *, abs(abs(x) - top) <= 1e-8 + 1e-5 * top AS c FROM l),
runs AS (SELECT clip_id, c, i - row_number() OVER (PARTITION BY clip_id, c ORDER BY i) AS g FROM close),
longest AS (SELECT clip_id, max(k) AS k FROM (SELECT clip_id, count(*) AS k FROM runs WHERE c GROUP BY clip_id, g) GROUP BY 1),
a AS (SELECT clip_id, any_value(n) AS n, avg(x) AS mu, min(x) AS lo, max(x) AS hi, max(abs(x)) AS top, avg(x * x) AS ms, avg((x - mu) * (x - mu)) AS m2,
  avg((x - mu) * (x - mu) * (x - mu)) AS m3, avg(power(x - mu, 4)) AS m4,
  avg(CASE WHEN abs(x) < 0.01 THEN 1.0 ELSE 0.0 END) AS proportion_silent_metric,
  coalesce((min(CASE WHEN abs(x) >= 0.01 THEN i END) - 1) / count(*), 1.0) AS proportion_silence_at_beginning_metric,
  coalesce((count(*) - max(CASE WHEN abs(x) >= 0.01 THEN i END)) / count(*), 1.0) AS proportion_silence_at_end_metric,
  sum(CASE WHEN sign(x) * sign(p) < 0 THEN 1 ELSE 0 END) / (count(*) - 1) AS zero_crossing_rate_metric,
  var_samp(x) AS signal_variance_metric, avg(abs(x)) AS mean_absolute_amplitude_metric, avg(abs(x - mu)) AS mean_absolute_deviation_metric,
  quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS amplitude_interquartile_range_metric,
  sum(CASE WHEN abs(x) >= 1 THEN 1 ELSE 0 END) AS over, sum(CASE WHEN c THEN 1 ELSE 0 END) AS near FROM close GROUP BY 1),
m AS (SELECT a.clip_id, proportion_silent_metric, proportion_silence_at_beginning_metric, proportion_silence_at_end_metric,
  CASE WHEN hi > 1 OR lo < -1 THEN NULL ELSE least(1 - hi, 1 + lo) END AS amplitude_headroom_metric,
  (CASE WHEN top >= 1 THEN over WHEN k > 3 THEN near ELSE 0 END) / n AS proportion_clipped_metric, sqrt(ms) AS root_mean_square_energy_metric,
  zero_crossing_rate_metric, signal_variance_metric, hi - lo AS dynamic_range_metric, mean_absolute_amplitude_metric, mean_absolute_deviation_metric,
  e AS shannon_entropy_amplitude_metric, top / sqrt(ms) AS crest_factor_metric, m3 / power(m2, 1.5) AS amplitude_skew_metric,
  m4 / (m2 * m2) - 3 AS amplitude_kurtosis_metric, amplitude_interquartile_range_metric
  FROM a JOIN entropy USING (clip_id) JOIN longest USING (clip_id))
"""


def _register(f, sql: str | None = None, name: str | None = None):
    QUERIES[name or f.__name__] = f
    if sql:
        SQL[name or f.__name__] = sql
    return f


def _metric_query(metric: str):
    def query(spark, d):
        rows = metrics.with_metrics(clips(spark, d), [metric], route="columns")
        return rounded(rows.select("clip_id", metric), ["clip_id"])

    return query


#: A clip of 64 samples is one frame of 2048: the noise floor is the spectrum itself, whose mean power follows from the
#: windowed samples and the first and last bin. The envelope's other part is a sum over samples at odd distances.
_KERNEL_SQL = {
    "spectral_gating_snr_metric": "SELECT vec_id AS clip_id, 0.0::DOUBLE AS spectral_gating_snr_metric FROM embeddings",
    "peak_snr_from_spectral_metric": """WITH s AS (SELECT vec_id AS clip_id, generate_subscripts(embedding, 1) - 1 AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
y AS (SELECT clip_id, p, x, x * (0.5 - 0.5 * cos(2 * pi() * (1024 + p) / 2048)) AS y FROM s),
m AS (SELECT clip_id, max(abs(x)) AS top, (2048 * sum(y * y) + power(sum(y), 2) + power(sum(y * CASE WHEN p % 2 = 0 THEN 1 ELSE -1 END), 2)) / 2 / 1025 AS power FROM y GROUP BY 1)
SELECT clip_id, round(20 * log10(top / sqrt(power + 1e-10)), 6) AS peak_snr_from_spectral_metric FROM m""",
    "amplitude_modulation_depth_metric": """WITH s AS (SELECT vec_id AS clip_id, generate_subscripts(embedding, 1) - 1 AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
h AS (SELECT a.clip_id, a.p, any_value(a.x) AS x, sum(b.x / tan(pi() * (a.p - b.p) / 64)) / 32 AS h FROM s a JOIN s b ON a.clip_id = b.clip_id AND (a.p - b.p) % 2 <> 0 GROUP BY 1, 2),
e AS (SELECT clip_id, max(sqrt(x * x + h * h)) AS hi, min(sqrt(x * x + h * h)) AS lo FROM h GROUP BY 1) SELECT clip_id, round((hi - lo) / (hi + lo + 1e-10), 6) AS amplitude_modulation_depth_metric FROM e""",
}

for _m in NATIVE:
    _register(_metric_query(_m), _SAMPLES + f"SELECT clip_id, round({_m}, 6) AS {_m} FROM m", f"metric_{_m.removesuffix('_metric')}")
for _m in metrics.KERNEL_ONLY:
    _register(_metric_query(_m), _KERNEL_SQL.get(_m), f"metric_{_m.removesuffix('_metric')}")

_ALL = ", ".join(f"round({m}, 6) AS {m}" for m in NATIVE)


def metrics_by_kernel(spark, d):
    """All metrics with a column expression, by the numpy kernels in one Arrow pass."""
    return rounded(metrics.with_metrics(clips(spark, d), NATIVE, route="kernel").drop("sampling_rate", "channels"), ["clip_id"])


_register(metrics_by_kernel, _SAMPLES + f"SELECT clip_id, {_ALL} FROM m")


def checks_all(spark, d):
    return quality.evaluate(clips(spark, d), NATIVE_CHECKS, route="columns").drop("sampling_rate")


def _check_sql(name: str) -> str:
    c = CHECKS[name]
    value = f"abs({c.metric})" if c.magnitude else c.metric
    upper = f" AND {value} < {c.upper}" if c.upper is not None else ""
    return f"({value} {c.op} {c.bound}{upper}) AS {name}"


_register(checks_all, _SAMPLES + "SELECT clip_id, " + ", ".join(map(_check_sql, NATIVE_CHECKS)) + " FROM m")

SUMMARY_METRICS = ["proportion_silent_metric", "dynamic_range_metric", "root_mean_square_energy_metric", "zero_crossing_rate_metric", "crest_factor_metric", "amplitude_skew_metric", "amplitude_kurtosis_metric", "amplitude_interquartile_range_metric"]
SUMMARY_CHECKS = ["completely_silent_check", "mostly_silent_check", "low_zero_crossing_rate_check", "high_crest_factor_check", "very_low_dynamic_range_check"]


def activities(spark, d):
    """One activity per clip, of the first delivery that names one."""
    return load(spark, d, "recordings").where("activity IS NOT NULL").groupBy("clip_id").agg(F.min("activity").alias("activity"))


def qc_summary(spark, d):
    """Clips with their activity, eight metrics and five checks, wide."""
    rows = quality.with_activity(clips(spark, d), activities(spark, d), taxonomy.voice_assessment())
    return rounded(quality.evaluate(rows, SUMMARY_METRICS + SUMMARY_CHECKS, route="columns").drop("sampling_rate"), ["clip_id"])


_ACTIVITY = "(SELECT clip_id, min(activity) AS activity FROM recordings WHERE activity IS NOT NULL GROUP BY 1)"
_register(
    qc_summary,
    _SAMPLES + "SELECT m.clip_id, coalesce(activity, 'voice_assessment') AS activity, " + ", ".join(f"round({x}, 6) AS {x}" for x in SUMMARY_METRICS) + ", " + ", ".join(map(_check_sql, SUMMARY_CHECKS))
    + f" FROM m LEFT JOIN {_ACTIVITY} t ON m.clip_id = t.clip_id",
)


def check_quality(spark, d):
    """The report of all evaluations that belong to each clip's activity; activities that the tree lacks count as its
    root."""
    tree = taxonomy.voice_assessment()
    known = activities(spark, d).where(F.col("activity").isin([path[-1] for path, _ in tree.walk()]))
    return rounded(quality.check_quality(clips(spark, d), known, tree, route="kernel").drop("sampling_rate"), ["clip_id"])


_register(check_quality)


def qc_long(spark, d):
    wide = quality.evaluate(clips(spark, d), SUMMARY_METRICS, route="columns")
    return rounded(quality.long_form(wide, ["clip_id"], SUMMARY_METRICS), ["clip_id"])


_register(qc_long, _SAMPLES + " UNION ALL ".join(f"SELECT clip_id, '{x}' AS evaluation_name, round({x}, 6) AS value FROM m" for x in SUMMARY_METRICS))

WINDOW, STEP = 0.25, 0.125


def qc_windowed_long(spark, d):
    names = ["root_mean_square_energy_metric", "dynamic_range_metric", "mean_absolute_amplitude_metric"]
    return rounded(quality.windowed(clips(spark, d), names, WINDOW, STEP, route="columns"), ["clip_id", "window_start", "window_end"])


_WINDOWS = """
WITH k AS (SELECT vec_id AS clip_id, unnest(range(0, CAST(ceil(len(embedding) / 8) AS BIGINT))) AS k, embedding FROM embeddings),
w AS (SELECT clip_id, k, CAST(unnest(embedding[k * 8 + 1 : k * 8 + 16]) AS DOUBLE) AS x FROM k),
a AS (SELECT clip_id, k, sqrt(avg(x * x)) AS r, max(x) - min(x) AS g, avg(abs(x)) AS b FROM w GROUP BY 1, 2)
"""
_register(
    qc_windowed_long,
    _WINDOWS + " UNION ALL ".join(
        f"SELECT clip_id, '{name}' AS evaluation_name, k * 0.125::DOUBLE AS window_start, k * 0.125::DOUBLE + 0.25::DOUBLE AS window_end, round({c}, 6) AS value FROM a"
        for name, c in (("root_mean_square_energy_metric", "r"), ("dynamic_range_metric", "g"), ("mean_absolute_amplitude_metric", "b"))
    ),
)


def _cached(spark, d):
    """Earlier results of every third clip."""
    old = clips(spark, d).where(F.col("clip_id") % 3 == 0)
    return old.select("clip_id", F.lit("dynamic_range_metric").alias("evaluation_name"), F.lit(7.0).alias("value"))


def qc_cached(spark, d):
    """Cached values win, missing ones are computed."""
    wide = quality.evaluate(clips(spark, d), ["dynamic_range_metric", "root_mean_square_energy_metric"], route="columns").drop("sampling_rate")
    return rounded(quality.with_cached(wide, _cached(spark, d), ["dynamic_range_metric"]), ["clip_id"])


_register(qc_cached, _SAMPLES + "SELECT clip_id, CASE WHEN clip_id % 3 = 0 THEN 7.0 ELSE round(dynamic_range_metric, 6) END AS dynamic_range_metric, round(root_mean_square_energy_metric, 6) AS root_mean_square_energy_metric FROM m")


def qc_missing(spark, d):
    return quality.missing(clips(spark, d), _cached(spark, d), ["dynamic_range_metric", "crest_factor_metric"])


_register(qc_missing, "SELECT vec_id AS clip_id, e AS evaluation_name FROM embeddings, (VALUES ('dynamic_range_metric'), ('crest_factor_metric')) t(e) WHERE NOT (vec_id % 3 = 0 AND e = 'dynamic_range_metric')")


def qc_flatten_windowed(spark, d):
    """Records with window lists as long rows; values beyond the windows are dropped."""
    w = F.col("embedding").cast("array<double>")
    windows = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.struct((i * 0.5).cast("double").alias("start"), (i * 0.5 + 1).cast("double").alias("end")))
    records = load(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), windows.alias("time_windows"), F.create_map(F.lit("a"), F.slice(w, 1, 48), F.lit("b"), F.slice(w, 49, 16)).alias("windowed_evaluations"))
    return rounded(quality.flatten_windowed_records(records), ["clip_id"])


_register(qc_flatten_windowed, """
WITH v AS (SELECT vec_id, 'a' AS e, unnest(range(0, 40)) AS i, embedding[1:48] AS w FROM embeddings UNION ALL SELECT vec_id, 'b', unnest(range(0, 16)), embedding[49:64] FROM embeddings)
SELECT vec_id AS clip_id, e AS evaluation_name, CAST(i * 0.5 AS DOUBLE) AS window_start, CAST(i * 0.5 + 1 AS DOUBLE) AS window_end, round(CAST(w[i + 1] AS DOUBLE), 6) AS value FROM v""")


def activity_evaluations(spark, d):
    """What the activities of the recordings are evaluated by."""
    tree = taxonomy.voice_assessment()
    rows = [(path[-1], i, e) for path, _ in tree.walk() for i, e in enumerate(tree.evaluations_for(path[-1]))]
    known = spark.createDataFrame(rows, "activity string, ord int, evaluation string")
    return activities(spark, d).select("activity").distinct().join(known, "activity")


_EVALS = ", ".join(f"({i}, '{e}')" for i, e in enumerate((*taxonomy.ROOT_METRICS, *taxonomy.ROOT_CHECKS)))
_KNOWN = ", ".join(f"'{path[-1]}'" for path, _ in taxonomy.voice_assessment().walk())
_register(activity_evaluations, f"SELECT DISTINCT activity, CAST(o AS INT) AS ord, e AS evaluation FROM {_ACTIVITY}, (VALUES {_EVALS}) t(o, e) WHERE activity IN ({_KNOWN})")


def taxonomy_table(spark, d):
    return taxonomy.voice_assessment().table(spark).select("node", "parent", "depth", "ord", F.size("evaluations").alias("n"))


_register(taxonomy_table)


# channels and cutting


def _flat(df, *keys):
    """channels as rows of rounded samples: keys, channel, pos, x."""
    rows = df.select(*keys, F.posexplode("channels").alias("channel", "_w"))
    return rows.select(*keys, "channel", F.posexplode("_w").alias("pos", "x")).withColumn("x", F.round("x", 6))


_PAIRS = "WITH p AS (SELECT vec_id // 2 AS clip_id, vec_id % 2 AS channel, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)\n"
_MONO = "WITH s AS (SELECT vec_id AS clip_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)\n"


def downmix(spark, d):
    return _flat(frames.downmix(stereo(spark, d)), "clip_id")


_register(downmix, _PAIRS + "SELECT clip_id, 0 AS channel, CAST(pos AS INT) AS pos, round(avg(x), 6) AS x FROM p GROUP BY clip_id, pos")


def select_channel(spark, d):
    return _flat(frames.select_channel(stereo(spark, d), 1), "clip_id")


_register(select_channel, _PAIRS + "SELECT clip_id, 0 AS channel, CAST(pos AS INT) AS pos, round(x, 6) AS x FROM p WHERE channel = 1")


def stereo_phase_correlation(spark, d):
    return rounded(metrics.with_metrics(stereo(spark, d), ["phase_correlation_metric"], route="columns").select("clip_id", "phase_correlation_metric"), ["clip_id"])


_register(stereo_phase_correlation, _PAIRS + "SELECT a.clip_id, round(corr(a.x, b.x), 6) AS phase_correlation_metric FROM p a JOIN p b ON a.clip_id = b.clip_id AND a.pos = b.pos AND a.channel = 0 AND b.channel = 1 GROUP BY 1")


def sliding_windows(spark, d):
    rows = frames.sliding_windows(clips(spark, d), 24, 10)
    return rows.select("clip_id", "window_index", "start_sample", "end_sample", F.size(F.get("channels", F.lit(0))).alias("n"), F.round(F.aggregate(F.get("channels", F.lit(0)), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


_register(sliding_windows, """
WITH k AS (SELECT vec_id AS clip_id, unnest(range(0, CAST(ceil(len(embedding) / 10) AS BIGINT))) AS k, embedding AS w FROM embeddings)
SELECT clip_id, CAST(k AS INT) AS window_index, CAST(k * 10 AS INT) AS start_sample, CAST(k * 10 + 24 AS INT) AS end_sample, CAST(len(w[k * 10 + 1 : k * 10 + 24]) AS INT) AS n,
round(list_sum(list_transform(w[k * 10 + 1 : k * 10 + 24], lambda x: CAST(x AS DOUBLE))), 5) AS total FROM k""")


def full_frames(spark, d):
    return frames.full_frames(clips(spark, d), 24, 10).select("clip_id", "window_index", "start_sample", F.size(F.get("channels", F.lit(0))).alias("n"))


_register(full_frames, "SELECT vec_id AS clip_id, CAST(k AS INT) AS window_index, CAST(k * 10 AS INT) AS start_sample, 24 AS n FROM embeddings, (SELECT unnest(range(0, 5)) AS k)")


def segment_even(spark, d):
    rows = frames.even_segments(clips(spark, d), 0.3)
    return _flat(rows, "clip_id", "segment_index")


_register(segment_even, _MONO + """, g AS (SELECT DISTINCT clip_id, unnest(range(0, 4)) AS k FROM s), e AS (SELECT clip_id, k, unnest(range(0, 19)) AS q FROM g)
SELECT e.clip_id, CAST(e.k AS INT) AS segment_index, 0 AS channel, CAST(q AS INT) AS pos, round(coalesce(x, 0.0), 6) AS x FROM e LEFT JOIN s ON s.clip_id = e.clip_id AND s.pos = e.k * 19 + q""")


def extract_segments(spark, d):
    spans = clips(spark, d).select("clip_id", F.explode(F.array(*[F.struct(F.lit(a).alias("start_sec"), F.lit(b).alias("end_sec")) for a, b in ((0.0, 0.5), (0.33, 1.0), (0.25, 0.25))])).alias("s")).select("clip_id", "s.*")
    return _flat(frames.extract_segments(clips(spark, d), spans), "clip_id", "start_sec", "end_sec")


_register(extract_segments, _MONO + """SELECT clip_id, a AS start_sec, b AS end_sec, 0 AS channel, CAST(pos - CAST(floor(a * 64) AS INT) AS INT) AS pos, round(x, 6) AS x
FROM s, (VALUES (0.0::DOUBLE, 0.5::DOUBLE), (0.33, 1.0), (0.25, 0.25)) t(a, b) WHERE pos >= floor(a * 64) AND pos < floor(b * 64)""")


def chunk(spark, d):
    spans = clips(spark, d).select("clip_id", ((F.col("clip_id") % 5) / 10.0).alias("start_sec"), F.lit(0.75).alias("end_sec"))
    return _flat(frames.chunk(clips(spark, d), spans), "clip_id", "segment_start", "segment_end")


_register(chunk, _MONO + """SELECT clip_id, (clip_id % 5) / 10.0::DOUBLE AS segment_start, 0.75::DOUBLE AS segment_end, 0 AS channel, CAST(pos - floor((clip_id % 5) / 10.0::DOUBLE * 64) AS INT) AS pos,
round(x, 6) AS x FROM s WHERE pos >= floor((clip_id % 5) / 10.0::DOUBLE * 64) AND pos < 48""")


def pad(spark, d):
    return _flat(frames.pad(clips(spark, d), 70), "clip_id")


_register(pad, _MONO + "SELECT clip_id, 0 AS channel, pos, round(x, 6) AS x FROM s UNION ALL SELECT vec_id, 0, CAST(64 + k AS INT), 0.0 FROM embeddings, (SELECT unnest(range(0, 6)) AS k)")


def concatenate(spark, d):
    rows = clips(spark, d).withColumn("part", F.floor(F.col("clip_id") / 3).cast("bigint"))
    return _flat(frames.concatenate(rows, "part", "clip_id"), "part")


_register(concatenate, _MONO + "SELECT clip_id // 3 AS part, 0 AS channel, CAST((clip_id % 3) * 64 + pos AS INT) AS pos, round(x, 6) AS x FROM s")


def pad_to_longest(spark, d):
    rows = clips(spark, d).withColumns({"batch": F.col("clip_id") % 10, "channels": F.transform("channels", lambda c: F.slice(c, 1, (F.col("clip_id") % 60 + 1).cast("int")))})
    return frames.pad_to_longest(rows, "batch").select("clip_id", "batch", F.size(F.get("channels", F.lit(0))).alias("n"))


_register(pad_to_longest, "SELECT vec_id AS clip_id, vec_id % 10 AS batch, CAST(max(vec_id % 60 + 1) OVER (PARTITION BY vec_id % 10) AS INT) AS n FROM embeddings")


def batch_list(spark, d):
    return frames.in_at_most(load(spark, d, "documents").select("doc_id"), 7, "doc_id")


_register(batch_list, "WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CAST(floor(r / ceil(n / least(7, n))) AS INT) AS batch_no FROM t")


def fixed_batches(spark, d):
    return frames.in_batches_of(load(spark, d, "documents").select("doc_id"), 64, "doc_id")


_register(fixed_batches, "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 64 AS INT) AS batch_no FROM documents")


def unbatch(spark, d):
    rows = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("items"))
    return rounded(frames.unbatch(rows), [])


_register(unbatch, "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS ord, round(CAST(unnest(embedding) AS DOUBLE), 6) AS item FROM embeddings")


def resample(spark, d):
    return frames.resample(clips(spark, d), 48).select("clip_id", "sampling_rate", F.size(F.get("channels", F.lit(0))).alias("n"))


_register(resample, "SELECT vec_id AS clip_id, 48 AS sampling_rate, CAST(ceil(len(embedding) * 48 / 64) AS INT) AS n FROM embeddings")


def _pool(how: str):
    def query(spark, d):
        rows = frames.pool(load(spark, d, "embeddings"), "label", "embedding", how)
        return rows.select("label", F.posexplode("pooled").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 6))

    return query


for _how, _f in (("mean", "avg"), ("min", "min"), ("max", "max")):
    _register(_pool(_how), f"WITH s AS (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT label, pos, round({_f}(x), 6) AS x FROM s GROUP BY 1, 2", f"pool_{_how}")


# results, similarity


def _results(spark, d):
    w = F.col("embedding").cast("array<double>")
    return load(spark, d, "embeddings").select("vec_id", results.result(F.transform(w, lambda x, i: F.format_string("class %02d", i)), w).alias("r"))


def top_k_labels(spark, d):
    return _results(spark, d).select("vec_id", F.posexplode(results.pairs(results.top_k(F.col("r"), 3))).alias("rank", "p")).select("vec_id", "rank", "p.label", F.round("p.score", 6).alias("score"))


_TOP = "WITH s AS (SELECT vec_id, 'class ' || lpad(CAST(generate_subscripts(embedding, 1) - 1 AS VARCHAR), 2, '0') AS label, CAST(unnest(embedding) AS DOUBLE) AS score FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) - 1 AS rank FROM s)\n"
_register(top_k_labels, _TOP + "SELECT vec_id, CAST(rank AS INT) AS rank, label, round(score, 6) AS score FROM r WHERE rank < 3")


def top_label(spark, d):
    return _results(spark, d).select("vec_id", results.top_label(F.col("r")).alias("label"), F.round(results.top_score(F.col("r")), 6).alias("score"))


_register(top_label, _TOP + "SELECT vec_id, label, round(score, 6) AS score FROM r WHERE rank = 0")


def scene_segments(spark, d):
    """Windows of a clip labelled by where their largest sample is; windows that begin with a negative one stay unlabelled."""
    rows = results.classification_windows(clips(spark, d), 0.5)
    x = F.get("channels", F.lit(0))
    label = F.when(F.get(x, F.lit(0)) >= 0, F.array(F.concat(F.lit("at "), F.array_position(x, F.array_max(x)).cast("string")))).otherwise(F.array().cast("array<string>"))
    return results.scene_segments(rows.select("clip_id", label.alias("labels"), F.col("window_start").alias("start_sec"), F.col("window_end").alias("end_sec")))


_register(scene_segments, """
WITH k AS (SELECT vec_id AS clip_id, unnest(range(0, 4)) AS k, embedding AS w FROM embeddings)
SELECT clip_id, CASE WHEN w[k * 16 + 1] >= 0 THEN 'at ' || list_position(w[k * 16 + 1 : k * 16 + 32], list_max(w[k * 16 + 1 : k * 16 + 32])) ELSE 'unknown' END AS label,
CAST(k * 16 / 64 AS DOUBLE) AS start_sec, CAST(least(k * 16 + 32, 64) / 64 AS DOUBLE) AS end_sec FROM k""")


def _neighbours(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select(F.col("vec_id").alias("a_id"), F.col("v").alias("vector_a")).join(e.select((F.col("vec_id") - 1).alias("a_id"), F.col("v").alias("vector_b")), "a_id")


_NEXT = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def cosine_pairs(spark, d):
    return _neighbours(spark, d).select("a_id", F.round(cosine(F.col("vector_a"), F.col("vector_b")), 6).alias("score"))


_COS = "list_dot_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))) / sqrt(list_dot_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)))) / sqrt(list_dot_product(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))))"
_register(cosine_pairs, f"SELECT a.vec_id AS a_id, round({_COS}, 6) AS score {_NEXT}")


def verify_pairs(spark, d):
    return similarity.verify(_neighbours(spark, d)).select("a_id", F.round("score", 6).alias("score"), "same_speaker")


_register(verify_pairs, f"SELECT a.vec_id AS a_id, round({_COS}, 6) AS score, {_COS} > 0.25 AS same_speaker {_NEXT}")


def xcorr(spark, d):
    rows = _neighbours(spark, d).select("a_id", F.posexplode(cross_correlation(F.col("vector_a"), F.col("vector_b"))).alias("lag", "r"))
    return rows.withColumn("r", F.round("r", 6))


_register(xcorr, """
WITH p AS (SELECT a.vec_id AS a_id, list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) AS u, list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
i AS (SELECT a_id, unnest(range(0, len(u))) AS i, u, v, sqrt(list_dot_product(u, u) * list_dot_product(v, v)) AS n FROM p), j AS (SELECT a_id, i, unnest(range(0, len(v))) AS j, u, v, n FROM i)
SELECT a_id, CAST(i - j + len(any_value(v)) - 1 AS INT) AS lag, round(sum(u[i + 1] * v[j + 1] / n), 6) AS r FROM j GROUP BY a_id, i - j""")


def nearest(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("clip_id"), F.col("embedding").alias("vector"))
    found = similarity.nearest(e.where(F.col("clip_id").cast("bigint") % 20 == 0).withColumnRenamed("clip_id", "query_id"), e, 5)
    return found.select("query_id", "clip_id", F.round("score", 6).alias("score"), "rank")


_register(nearest, f"""
WITH s AS (SELECT CAST(a.vec_id AS VARCHAR) AS query_id, CAST(b.vec_id AS VARCHAR) AS clip_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, clip_id) AS rank FROM s) SELECT query_id, clip_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")


def equal_error_rate(spark, d):
    e = load(spark, d, "embeddings").select(F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda t, x: t + x), 6).alias("score"), (F.col("label") < 5).alias("positive"))
    return rounded(similarity.equal_error_rate(e), [])


_register(equal_error_rate, """
WITH e AS (SELECT round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS s, label < 5 AS p FROM embeddings), c AS (SELECT s, sum(CASE WHEN p THEN 1 ELSE 0 END) AS p, sum(CASE WHEN p THEN 0 ELSE 1 END) AS n FROM e GROUP BY 1),
r AS (SELECT s, sum(p) OVER (ORDER BY s) / sum(p) OVER () AS frr, 1 - sum(n) OVER (ORDER BY s) / sum(n) OVER () AS far, lead(s) OVER (ORDER BY s) AS t FROM c),
b AS (SELECT *, (s + coalesce(t, s)) / 2 AS threshold FROM r ORDER BY t IS NULL, round(abs(far - frr), 12), threshold LIMIT 1) SELECT round((far + frr) / 2, 6) AS eer, round(threshold, 6) AS threshold FROM b""")


def _halves(spark, d):
    w = F.col("embedding").cast("array<double>")
    return load(spark, d, "embeddings").select(F.slice(w, 1, 36).alias("x"), F.slice(w, 29, 36).alias("y"))


def representation_similarity(spark, d):
    rows = _halves(spark, d)
    got = [("cca", similarity.canonical_correlation(rows)), ("cka_linear", similarity.linear_alignment(rows)), ("cka_rbf", similarity.rbf_alignment(rows))]
    return rounded(spark.createDataFrame(got, "measure string, value double"), [])


_register(representation_similarity)


def representation_alignment(spark, d):
    """Linear alignment of the halves of all vectors."""
    return rounded(spark.createDataFrame([(similarity.linear_alignment(_halves(spark, d)),)], "cka_linear double"), [])


_register(representation_alignment, """WITH s AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), z AS (SELECT vec_id, i, (v - avg(v) OVER (PARTITION BY i)) / (stddev_samp(v) OVER (PARTITION BY i) + 1e-8) AS v FROM s),
x AS (SELECT vec_id, i, v, i <= 36 AS x, i >= 29 AS y FROM z), c AS (SELECT a.i, b.i AS j, bool_and(a.x) AS ax, bool_and(a.y) AS ay, bool_and(b.x) AS bx, bool_and(b.y) AS by_, sum(a.v * b.v) AS c FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2),
t AS (SELECT sum(CASE WHEN ax AND by_ THEN c * c END) AS xy, sum(CASE WHEN ax AND bx THEN c * c END) AS xx, sum(CASE WHEN ay AND by_ THEN c * c END) AS yy, sum(CASE WHEN ax AND i = j THEN c END) AS tx, sum(CASE WHEN ay AND i = j THEN c END) AS ty, (SELECT count(*) - 1 FROM embeddings) AS n FROM c)
SELECT round(least((xy + 1e-6 * (tx + ty) + 1e-12 * n) / (sqrt((xx + 2e-6 * tx + 1e-12 * n) * (yy + 2e-6 * ty + 1e-12 * n)) + 1e-8), 1.0), 6) AS cka_linear FROM t""")


def pca_2d(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    p = similarity.principal_components(e, "embedding", 2)
    return p.select("vec_id", F.round(F.get("projected", F.lit(0)), 6).alias("a"), F.round(F.get("projected", F.lit(1)), 6).alias("b"))


_register(pca_2d)


# votes and labels

VOTE_CHECKS = ["low_crest_factor_check", "high_zero_crossing_rate_check", "very_high_zero_crossing_rate_check", "very_low_dynamic_range_check", "low_signal_variance_check", "high_amplitude_skew_magnitude_check"]


def _voted(spark, d):
    checks = quality.evaluate(clips(spark, d), VOTE_CHECKS, route="columns").drop("sampling_rate")
    return labeling.votes(checks, VOTE_CHECKS)


_VOTES = "v AS (SELECT clip_id, " + ", ".join(f"CASE WHEN {c} THEN 0 ELSE 1 END AS lf_{c}" for c in VOTE_CHECKS) + ", CASE WHEN " + " OR ".join(VOTE_CHECKS) + " THEN 0 ELSE 1 END AS lf_none_failed FROM c)"
_CHECKED = _SAMPLES + ", c AS (SELECT clip_id, " + ", ".join(map(_check_sql, VOTE_CHECKS)) + " FROM m), " + _VOTES
_LFS = [f"lf_{c}" for c in VOTE_CHECKS]


def lf_votes(spark, d):
    return _voted(spark, d).select("clip_id", *_LFS, "lf_none_failed")


_register(lf_votes, _CHECKED + "SELECT * FROM v")


def lf_majority(spark, d):
    return _voted(spark, d).select("clip_id", labeling.majority(_LFS).alias("label"))


_SUMS = " + ".join(_LFS)
_register(lf_majority, _CHECKED + f"SELECT clip_id, CASE WHEN {_SUMS} >= {len(_LFS)} - ({_SUMS}) THEN 1 ELSE 0 END AS label FROM v")


def lf_reliability(spark, d):
    return labeling.reliability(_voted(spark, d), _LFS, F.col("lf_none_failed"))


_register(lf_reliability, _CHECKED + " UNION ALL ".join(f"SELECT '{c}' AS lf_name, count(CASE WHEN {c} = 1 THEN 1 END) AS n_include, count(CASE WHEN {c} = 0 THEN 1 END) AS n_exclude, round(avg(CASE WHEN {c} = lf_none_failed THEN 1.0 ELSE 0.0 END), 4) AS agreement FROM v" for c in _LFS))


def prune_checks(spark, d):
    kept, dropped = labeling.prune_checks(quality.evaluate(clips(spark, d), NATIVE_CHECKS, route="columns"), NATIVE_CHECKS)
    rows = [(c, "kept", None) for c in kept] + [(c, "correlated", k) for k, cs in dropped.items() for c in cs]
    rows += [(c, "constant", None) for c in NATIVE_CHECKS if c not in {r[0] for r in rows}]
    return spark.createDataFrame(rows, "check_name string, state string, because_of string")


_register(prune_checks)


def review(spark, d):
    checks = quality.evaluate(clips(spark, d), VOTE_CHECKS, route="columns")
    return labeling.review(checks, VOTE_CHECKS).select("clip_id", "label")


_register(review)


# features


def spectrogram_shape(spark, d):
    rows = features.spectrogram(clips(spark, d), 32)
    return rows.select("clip_id", F.size("spectrogram").alias("bins"), F.size(F.get("spectrogram", F.lit(0))).alias("frames"))


_register(spectrogram_shape, "SELECT vec_id AS clip_id, 17 AS bins, CAST(1 + len(embedding) // 16 AS INT) AS frames FROM embeddings")


def mel_mfcc_shape(spark, d):
    rows = features.mfcc(features.mel_spectrogram(clips(spark, d), 32, n_mels=12), 5, 32, n_mels=12)
    return rows.select("clip_id", F.size("mel_spectrogram").alias("mels"), F.size("mfcc").alias("coefficients"))


_register(mel_mfcc_shape, "SELECT vec_id AS clip_id, 12 AS mels, 5 AS coefficients FROM embeddings")


def power_db(spark, d):
    w = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * x)
    return load(spark, d, "embeddings").select("vec_id", F.posexplode(features.to_db(w)).alias("pos", "db")).withColumn("db", F.round("db", 5))


_register(power_db, """WITH s AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), l AS (SELECT vec_id, pos, 10 * log10(greatest(x * x, 1e-10)) AS db FROM s)
SELECT vec_id, pos, round(greatest(db, max(db) OVER (PARTITION BY vec_id) - 80), 5) AS db FROM l""")


def _posteriorgrams(spark, d):
    w = F.col("embedding").cast("array<double>")
    m = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(w, i * 4 + 1, F.lit(4)))
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("clip_id"), F.lit(1.0).alias("duration_sec"), m.alias("posteriorgram"))


_ISLANDS = """
WITH f AS (SELECT vec_id AS clip_id, unnest(range(0, 16)) AS frame, embedding AS w FROM embeddings), b AS (SELECT clip_id, frame, list_position(w[frame * 4 + 1 : frame * 4 + 4], list_max(w[frame * 4 + 1 : frame * 4 + 4])) - 1 AS k FROM f),
g AS (SELECT *, frame - row_number() OVER (PARTITION BY clip_id, k ORDER BY frame) AS g FROM b),
r AS (SELECT clip_id, CAST(k AS INT) AS phoneme_index, (['aa', 'ae', 'ah', 'ao'])[k + 1] AS phoneme, CAST(min(frame) AS INT) AS start_frame, CAST(max(frame) AS INT) AS end_frame, CAST(count(*) AS INT) AS frame_count FROM g GROUP BY clip_id, k, g)
"""


def phoneme_islands(spark, d):
    return features.phoneme_segments(_posteriorgrams(spark, d)).select("clip_id", "phoneme_index", "phoneme", "start_frame", "end_frame", "frame_count", F.round("duration_sec", 6).alias("duration_sec"))


_register(phoneme_islands, _ISLANDS + "SELECT *, round(CAST(frame_count / 16 AS DOUBLE), 6) AS duration_sec FROM r")


def phoneme_durations(spark, d):
    return rounded(features.phoneme_durations(features.phoneme_segments(_posteriorgrams(spark, d))), ["clip_id"])


_register(phoneme_durations, _ISLANDS + "SELECT clip_id, phoneme, count(*) AS count, round(sum(CAST(frame_count / 16 AS DOUBLE)), 6) AS total_sec, round(avg(CAST(frame_count / 16 AS DOUBLE)), 6) AS mean_sec FROM r GROUP BY 1, 2")


def voice_features(spark, d):
    """Features of the clips' voice, on each user's events as a signal of 8 kHz."""
    return features.voice_features(signals(spark, d)).select("clip_id", *[F.round(f"features.{n}", 4).alias(n) for n in ("mean_f0", "mean_db", "mean_hnr_db", "spectral_gravity", "local_jitter", "duration")])


def signals(spark, d):
    """Each user's event values in order, around 0 and within full scale, as a clip."""
    e = load(spark, d, "events").where("value IS NOT NULL").groupBy(F.col("user_id").alias("clip_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("w"))
    top = F.greatest(F.array_max(F.transform("w", lambda x: F.abs(x))), F.lit(1e-9))
    return e.select("clip_id", F.lit(8000).alias("sampling_rate"), F.array(F.transform("w", lambda x: x / top - 0.5)).alias("channels"))


_register(voice_features)


def health_measurements(spark, d):
    return features.health_measurements(signals(spark, d)).select("clip_id", F.round("features.mean_db", 4).alias("mean_db"), F.round("features.spectral_slope", 4).alias("spectral_slope"))


_register(health_measurements)
