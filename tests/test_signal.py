import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.functions import kernels, signal
from sonoframe.operators import checks, frames, metrics, quality, results, taxonomy

NAN = float("nan")

#: metric, keyword arguments, channels, expected
GOLDEN = [
    ("proportion_silent_metric", {"t": 0.05}, [[0, 0, 0, 0]], 1.0),
    ("proportion_silent_metric", {"t": 0.05}, [[0, 0.1, 0.2, 0.3]], 0.25),
    ("proportion_silence_at_beginning_metric", {"t": 0.05}, [[0, 0, 0.1, 0.2]], 0.5),
    ("proportion_silence_at_beginning_metric", {"t": 0.05}, [[0, 0, 0, 0]], 1.0),
    ("proportion_silence_at_end_metric", {"t": 0.05}, [[0.1, 0.2, 0, 0]], 0.5),
    ("proportion_silence_at_end_metric", {"t": 0.05}, [[0.1, 0.2, 0.3, 0.4]], 0.0),
    ("amplitude_headroom_metric", {}, [[0.5, -0.5, 0.8, -0.8]], 0.2),
    ("amplitude_headroom_metric", {}, [[1.1, -0.5]], None),
    ("proportion_clipped_metric", {}, [[0, 0.5, 1, -1]], 0.5),
    ("proportion_clipped_metric", {}, [[0, 0.4, 0.6, -0.9]], 0.0),
    ("proportion_clipped_metric", {}, [[0.5, 0.5, 0.5, -0.5, 0.5, 0.5]], 1.0),
    ("proportion_clipped_metric", {}, [[0.5, 0.5, -0.4, 0.5, 0.5]], 0.0),
    ("root_mean_square_energy_metric", {}, [[1, 0, 1, 0]], math.sqrt(0.5)),
    ("root_mean_square_energy_metric", {}, [[1, 1], [0, 0]], 0.5),
    ("zero_crossing_rate_metric", {}, [[1, 1, -1, -1]], 1 / 3),
    ("zero_crossing_rate_metric", {}, [[1, 0, -1, 0]], 0.0),
    ("zero_crossing_rate_metric", {}, [[1, -1, -1], [0.5, 0.5, 0.5]], 0.25),
    ("signal_variance_metric", {}, [[1, 2, 3, 4]], 5 / 3),
    ("dynamic_range_metric", {}, [[-0.5, 0.3, 0.8], [-1, 0, 0.5]], 1.8),
    ("mean_absolute_amplitude_metric", {}, [[1, 0, -1, 0], [2, 2, 2, 2]], 1.25),
    ("mean_absolute_deviation_metric", {}, [[1, 2, 3, 4], [-1, -2, -3, -4]], 1.0),
    ("phase_correlation_metric", {}, [[0.1, 0.1, 0.2], [-0.1, 0.1, 0.3]], 0.8660254037844387),
    ("phase_correlation_metric", {}, [[0.1, 0.2], [0.3, 0.4], [0.5, 0.3]], -1 / 3),
    ("phase_correlation_metric", {}, [[0.1, 0.2], [0.0, 0.0]], 0.0),
    ("phase_correlation_metric", {}, [[0.1, 0.2, 0.3]], 1.0),
    ("crest_factor_metric", {}, [[0, 0]], float("inf")),
    ("shannon_entropy_amplitude_metric", {}, [[0.5, 0.5]], 0.0),
]


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and bool(np.isclose(a, b, equal_nan=True, rtol=1e-9, atol=1e-12)))


@pytest.mark.parametrize("name, args, channels, expected", GOLDEN)
def test_golden(spark, name, args, channels, expected):
    channels = [[float(x) for x in c] for c in channels]
    df = spark.createDataFrame([(channels,)], "ch array<array<double>>")
    assert same(df.select(getattr(signal, name)(F.col("ch"), **args)).first()[0], expected)
    assert same(kernels.METRICS[name](np.array(channels), **args), expected)


def test_columns_and_kernels_agree(spark):
    rng = np.random.default_rng(3)
    cases = [rng.uniform(-1, 1, (2, 200)), rng.uniform(-0.2, 0.2, (1, 33)), np.zeros((1, 5)), np.ones((3, 4)), np.array([[0.4]]), np.zeros((1, 0))]
    df = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cases)], "i int, ch array<array<double>>")
    rows = df.select("i", *[f(F.col("ch")).alias(n) for n, f in metrics.COLUMNS.items()]).orderBy("i").collect()
    for row, w in zip(rows, cases, strict=True):
        for n in metrics.COLUMNS:
            assert same(row[n], kernels.METRICS[n](w)), (n, w.shape)


def test_modulation_depth():
    depth = kernels.METRICS["amplitude_modulation_depth_metric"]
    assert depth(np.full((1, 4), 0.5)) == pytest.approx(0, abs=1e-6)
    assert depth(np.array([[0.1, 0.9, 0.1, 0.9]])) == pytest.approx(0.8, abs=1e-6)
    assert depth(np.zeros((1, 4))) == pytest.approx(0, abs=1e-6)


def test_checks_hold_nan_and_null(spark):
    df = spark.createDataFrame([(NAN,), (None,), (-5.0,), (6.0,), (2.0,)], "m double")
    got = [r[0] for r in df.select(checks.check_column("high_amplitude_skew_magnitude_check", F.col("m"))).collect()]
    assert got == [False, None, False, True, False]
    voice = [r[0] for r in df.select(checks.check_column("voice_signal_to_noise_power_ratio_check", F.col("m"))).collect()]
    assert voice == [None, None, False, True, True]


@pytest.mark.parametrize("name", sorted(checks.CHECKS))
def test_check_at_its_threshold(spark, name):
    c, e = checks.CHECKS[name], 1e-6
    values = [c.bound - e, float(c.bound), c.bound + e] + ([c.upper - e, c.upper] if c.upper is not None else [])
    df = spark.createDataFrame([(float(v),) for v in values], "m double")
    expected = {"=": [False, True, False], ">": [False, False, True], ">=": [False, True, True], "<": [True, False, False], "<=": [True, True, False]}[c.op]
    assert [r[0] for r in df.select(checks.check_column(name, F.col("m"))).collect()] == expected + ([True, False] if c.upper is not None else [])


def test_number_of_checks():
    assert len(checks.CHECKS) + 1 == 39


def clips(spark, *rows):
    return spark.createDataFrame([(f"c{i}", rate, ch) for i, (rate, ch) in enumerate(rows)], "clip_id string, sampling_rate int, channels array<array<double>>")


def ramp(n):
    return [[float(i) for i in range(n)]]


@pytest.mark.parametrize("n, win, step, count", [(32, 16, 8, 4), (8, 16, 8, 1), (48, 32, 16, 3), (10, 3, 5, 2), (0, 4, 2, 0)])
def test_window_count(spark, n, win, step, count):
    rows = frames.sliding_windows(clips(spark, (16, ramp(n))), win, step).orderBy("window_index").collect()
    assert len(rows) == count == -(-n // step)
    assert all(r.end_sample == r.start_sample + win for r in rows)
    assert sum(len(r.channels[0]) for r in rows) == sum(min(win, n - s) for s in range(0, n, step))


def test_classification_windows(spark):
    rows = results.classification_windows(clips(spark, (16, ramp(32))), 1.0, 0.5).orderBy("window_index").collect()
    assert [(r.window_start, r.window_end) for r in rows] == [(0, 1), (0.5, 1.5), (1, 2), (1.5, 2)]
    assert [(r.window_start, r.window_end) for r in results.classification_windows(clips(spark, (16, ramp(8))), 1.0).collect()] == [(0, 0.5)]


def test_windowed_report_does_not_clip_and_drops_broken_series(spark):
    df = clips(spark, (4, [[0.1, 0.2, 0.3, 0.4, 2.0]]))
    rows = quality.windowed(df, ["amplitude_headroom_metric", "dynamic_range_metric"], 1.0, 0.5, route="columns").orderBy("window_start").collect()
    assert {r.evaluation_name for r in rows} == {"dynamic_range_metric"}
    assert [(r.window_start, r.window_end) for r in rows] == [(0, 1), (0.5, 1.5), (1, 2)]


def test_even_segments(spark):
    rows = frames.even_segments(clips(spark, (4, ramp(7)), (4, [[]])), 1.0).orderBy("clip_id", "segment_index").collect()
    assert [r.channels for r in rows] == [[[0, 1, 2, 3]], [[4, 5, 6, 0]], [[]]]
    assert frames.even_segments(clips(spark, (4, ramp(7))), 1.0, pad_last=False).orderBy("segment_index").collect()[1].channels == [[4, 5, 6]]


def test_segments_outside_raise_and_empty_ones_pass(spark):
    df = clips(spark, (4, ramp(8)))
    spans = lambda *s: spark.createDataFrame([("c0", a, b) for a, b in s], "clip_id string, start_sec double, end_sec double")
    assert [r.channels for r in frames.extract_segments(df, spans((0.5, 1.0), (1.0, 1.0))).orderBy("start_sec").collect()] == [[[2, 3]], [[]]]
    for bad in ((-0.5, 1.0), (0.0, 3.0)):
        with pytest.raises(Exception, match="outside"):
            frames.extract_segments(df, spans(bad)).collect()
    with pytest.raises(Exception, match="outside"):
        frames.chunk(df, spans((1.0, 1.0))).collect()


def test_channels(spark):
    df = clips(spark, (4, [[1.0, 2.0], [3.0, 6.0]]))
    assert frames.downmix(df).first().channels == [[2, 4]]
    assert frames.select_channel(df, 1).first().channels == [[3, 6]]
    with pytest.raises(Exception, match="no channel"):
        frames.select_channel(df, 2).collect()


def test_concatenate_refuses_mixed_rates(spark):
    df = clips(spark, (4, ramp(2)), (8, ramp(2))).withColumn("g", F.lit(1))
    with pytest.raises(Exception, match="differ"):
        frames.concatenate(df, "g", "clip_id").collect()


@pytest.mark.parametrize("n, k, sizes", [(6, 3, [2, 2, 2]), (7, 3, [3, 3, 1]), (6, 1, [6]), (3, 5, [1, 1, 1]), (0, 2, [])])
def test_batch_list(spark, n, k, sizes):
    rows = frames.in_at_most(spark.range(n), k, "id").groupBy("batch_no").count().orderBy("batch_no").collect()
    assert [r["count"] for r in rows] == sizes


def test_resample_keeps_a_low_tone():
    t = np.arange(1600) / 16000
    y = kernels.resample(np.sin(2 * np.pi * 200 * t), 16000, 8000)
    assert len(y) == 800
    assert np.abs(y - np.sin(2 * np.pi * 200 * np.arange(800) / 8000))[60:-60].max() < 0.02


def test_taxonomy():
    tree = taxonomy.voice_assessment()
    assert len(list(tree.walk())) == 72
    assert tree.path_to("rainbow_passage") == ["voice_assessment", "human", "vocalization", "speech", "scripted", "passage_reading", "rainbow_passage"]
    assert tree.path_to("nothing") is None
    chain = tree.pruned("speech")
    assert [p[-1] for p, _ in chain.walk()] == ["voice_assessment", "human", "vocalization", "speech"]
    assert tree.evaluations_for("glides")[:5] == list(taxonomy.ROOT_METRICS)
    node = taxonomy.Taxonomy("a", ["m1"], ["c1"])
    node.add("b", taxonomy.Taxonomy("b", ["m2", "m1"], ["c1", "c2"]))
    assert node.evaluations() == ["m1", "c1", "m2", "c2"]
    with pytest.raises(ValueError):
        tree.evaluations_for("nothing")


def test_quality_report_and_unknown_activity(spark):
    df = clips(spark, (16, ramp(40)), (16, [[0.0] * 40]))
    acts = spark.createDataFrame([("c0", "speech")], "clip_id string, activity string")
    rows = {r.clip_id: r for r in quality.check_quality(df, acts, taxonomy.voice_assessment()).collect()}
    assert rows["c0"].activity == "speech" and rows["c1"].activity == "voice_assessment"
    assert rows["c1"].completely_silent_check is True and rows["c0"].completely_silent_check is False
    bad = spark.createDataFrame([("c0", "nothing")], "clip_id string, activity string")
    with pytest.raises(Exception, match="unknown activity"):
        quality.check_quality(df, bad).collect()
    with pytest.raises(ValueError):
        quality.evaluate(df, ["nothing_metric"])


def test_cached_values_win(spark):
    wide = spark.createDataFrame([("a", 2.0, True), ("b", 3.0, False)], "clip_id string, m_metric double, c_check boolean")
    cached = spark.createDataFrame([("a", "m_metric", 1.0)], "clip_id string, evaluation_name string, value double")
    rows = {r.clip_id: (r.m_metric, r.c_check) for r in quality.with_cached(wide, cached, ["m_metric", "c_check"]).collect()}
    assert rows == {"a": (1.0, True), "b": (3.0, False)}


def test_results(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [0.2, 0.5, 0.2])], "l array<string>, s array<double>")
    r = results.result(F.col("l"), F.col("s"))
    row = df.select(results.labels(r), results.top_k_labels(r, 2), results.top_label(r), results.top_score(r)).first()
    assert list(row) == [["b", "a", "c"], ["b", "a"], "b", 0.5]
    with pytest.raises(Exception, match="no top"):
        df.select(results.top_k(r, 4)).collect()
    with pytest.raises(Exception, match="as many"):
        df.select(results.result(F.col("l"), F.array(F.lit(1.0)))).collect()
    kinds = spark.createDataFrame([(["positive", "negative", "neutral"],), (["arousal"],), (["joy"],), (["x"],)], "n array<string>")
    assert [x[0] for x in kinds.select(results.emotion_kind(F.col("n"))).collect()] == ["valence", "continuous", "discrete", "not_recognized"]


def test_null_and_empty_clips(spark):
    df = spark.createDataFrame([("a", 16, None), ("b", 16, [])], "clip_id string, sampling_rate int, channels array<array<double>>")
    for route in ("kernel", "columns"):
        assert len(metrics.with_metrics(df, list(metrics.ALL), route=route).collect()) == 2
    assert metrics.with_metrics(df.limit(0), ["crest_factor_metric"]).count() == 0
