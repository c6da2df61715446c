import itertools
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.functions.text import character_error_rate, edit_counts, word_scores
from sonoframe.operators import alignment, diarization, features, intervals, labeling, languages, models, nested, pose, similarity, tree
from sonoframe.sources import chat, datasets, files, wav
from sonoframe.streaming import windows

LINE = "clip_id string, speaker string, start_sec double, end_sec double"


# intervals


def merged(rows):
    out = []
    for a, b in sorted(rows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("bucket", [7, 50, 600_000])
def test_periods_against_brute_force(spark, bucket):
    rng = random.Random(bucket)
    rows = [(k, a, a + rng.randint(1, 40)) for k in ("x", "y", None) for a in (rng.randint(0, 400) for _ in range(30))]
    df = spark.createDataFrame(rows + rows[:5], "k string, from_ms bigint, to_ms bigint")
    got = intervals.periods_and_gaps(df, ["k"], bucket).collect()
    for k in ("x", "y", None):
        periods = merged([(a, b) for q, a, b in rows if q == k])
        assert sorted((r.from_ms, r.to_ms) for r in got if r.k == k and r.kind == "period") == periods
        assert sorted((r.from_ms, r.to_ms) for r in got if r.k == k and r.kind == "gap") == [(a[1], b[0]) for a, b in zip(periods, periods[1:])]


def test_lines_that_are_no_intervals(spark):
    nan = float("nan")
    rows = [("a", " s ", 0.0, 1.0), ("a", "S", 1.0, 2.0), ("a", "S", 2.0004, 2.5), ("a", "S", 3.0, 3.0004), ("a", "S", None, 5.0), ("a", "S", -1.0, 9.0), ("a", "S", 8.0, 7.0), ("a", "S", nan, 9.0), ("a", "S", 1.0, float("inf")), ("b", "S", 0.0, 8.9e11), ("b", "S", 1.0, 1e300), (None, None, 1.0, 2.0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], LINE + ", from_ms int, _bucket int")
    got = sorted((str(r.clip_id), str(r.speaker), r.kind, r.from_ms, r.to_ms) for r in intervals.speaking_periods(df).collect())
    assert got == [("None", "None", "period", 1000, 2000), ("a", "S", "period", 0, 2500), ("b", "S", "period", 0, 890_000_000_000_000)]
    assert intervals.speaking_periods(df.limit(0)).count() == 0


# nested records


def shredded(payload):
    return [(k, p) for k, p, *_ in nested.shred(payload)]


def test_shred_reads_a_list_however_it_is_written():
    word = {"word": "a", "start": 0.0}
    plain = json.dumps({"segments": [{"text": "x", "words": [word]}]})
    expected = [("segment", "/0"), ("word", "/0/0")]
    lone = json.dumps({"segments": {"text": "x", "words": json.dumps(word)}})
    text = json.dumps({"segments": json.dumps([{"text": "x", "words": json.dumps([word])}])})
    for payload in (plain, lone, text, json.dumps(plain), json.dumps(json.dumps(plain))):
        assert shredded(payload) == expected


@pytest.mark.parametrize("payload", [None, "", " ", "null", "3", "[]", '{"chunks": [{"text": "a"}', '"{"', '{"chunks": null}', '{"chunks": "oops"}', "[1, 2]"])
def test_shred_of_nothing(payload):
    assert shredded(payload) == []


def test_nulls_keep_their_place_and_depth_is_free():
    assert shredded('{"chunks": [null, {"chunks": {"chunks": [null, {}]}}, "word"]}') == [("chunk", "/1"), ("chunk", "/1/0"), ("chunk", "/1/0/1"), ("chunk", "/2")]
    for depth in (300, 50_000):
        assert sum(1 for _ in nested.shred('{"chunks":' * depth + "[]" + "}" * depth)) == depth - 1


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, {"b": null}], "c": "x\\u00e9\\""}', "[]", " {} ", "[[[]], {}]", "3", '"s"', "true", '{"a":1,"a":2}'])
def test_deep_reader_reads_what_the_usual_one_reads(text):
    assert nested.read_deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "[", "[1,]", "[1 2]", '{"a"}', '{"a":}', '{"a":1,}', "[1]]", "{1:2}", "nul", '["x]', "01", "[}", "{]"])
def test_deep_reader_refuses_what_the_usual_one_refuses(text):
    with pytest.raises(ValueError):
        json.loads(text)
    with pytest.raises(ValueError):
        nested.read_deep(text)


def test_latest_delivery_counts(spark):
    rows = [(1, '{"chunks": [{}, {}]}', "2024-01-01"), (1, '{"chunks": [{}]}', "2024-01-02"), (1, "bad", None), (2, "bad", "2024-01-02"), (2, '{"chunks": [{}]}', "2024-01-01"), (None, '{"chunks": [{}]}', None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id bigint, payload string, t string, kind string").withColumn("ingested_at", F.col("t").cast("timestamp"))
    got = sorted((str(r.record_id), r.node_path, r.parent_path) for r in nested.record_nodes(df).collect())
    assert got == [("1", "/0", ""), ("None", "/0", "")]
    assert nested.record_nodes(df.limit(0)).count() == 0


def test_poses_with_nulls(spark):
    mark = "struct<x:double,y:double,z:double,visibility:double,confidence:double>"
    kind = f"image_id bigint, individuals array<struct<individual_index:int,normalized_landmarks:map<string,{mark}>,world_landmarks:map<string,{mark}>>>, ingested_at timestamp"
    rows = [(1, [None, (0, {"nose": (1.0, 2.0, None, None, 0.9), "ear": None}, None), (0, None, None)], None), (2, None, None), (3, [], None)]
    df = spark.createDataFrame(rows, kind)
    got = sorted((r.record_id, r.kind, r.node_path, r.parent_path) for r in nested.pose_nodes(df).collect())
    assert got == [(1, "individual", "/1", ""), (1, "individual", "/2", ""), (1, "landmark", "/1/nose", "/1")]
    p = df.where("image_id = 1").select(pose.individual(F.col("individuals"), 1).alias("p"))
    assert p.select(pose.as_list(pose.landmark(F.col("p"), "nose"), "yolo")).first()[0] == [1.0, 2.0, 0.9]
    with pytest.raises(Exception, match="no landmark"):
        p.select(pose.landmark(F.col("p"), "knee")).collect()
    with pytest.raises(Exception, match="no individual"):
        df.where("image_id = 1").select(pose.individual(F.col("individuals"), 5)).collect()


# diarization


def lines(spark, *rows):
    return spark.createDataFrame([("c", *r) for r in rows], LINE)


def test_error_rate_optimal(spark):
    ref = lines(spark, ("A", 0.0, 10.0), ("B", 13.0, 21.0), ("A", 24.0, 32.0), ("C", 32.0, 40.0))
    hyp = lines(spark, ("A", 2.0, 14.0), ("C", 14.0, 15.0), ("B", 15.0, 20.0), ("C", 23.0, 36.0), ("D", 36.0, 40.0))
    r = diarization.error_rate(ref, hyp).first()
    assert (r.false_alarm, r.missed, r.confusion) == (4, 3, 14)
    assert r.mapping == {"A": "A", "B": "B", "C": "C"}


def test_error_rate_greedy(spark):
    ref = lines(spark, ("C", 0.0, 5.0), ("D", 5.0, 9.0), ("A", 10.0, 14.0), ("D", 14.0, 15.0), ("C", 17.0, 20.0), ("B", 22.0, 25.0))
    hyp = lines(spark, ("C", 0.0, 8.0), ("A", 11.0, 15.0), ("C", 17.0, 21.0), ("B", 23.0, 25.0))
    assert diarization.error_rate(ref, hyp, greedy=True).first().error_rate == pytest.approx(0.4)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(1, 6))
        m = rng.uniform(0.1, 5, (n, n))
        names = list("abcdef")[:n]
        got = diarization._assignment(m, names, names, False)
        assert sum(m[names.index(r), names.index(h)] for h, r in got.items()) == pytest.approx(max(sum(m[i, p[i]] for i in range(n)) for p in permutations(range(n))))


def test_voice_metrics(spark):
    vad = lines(spark, ("VOICE", 0.0, 0.5), ("VOICE", 0.6, 1.0))
    assert diarization.voice_seconds(vad).first()[1] == pytest.approx(0.9)
    assert diarization.speaker_ratio(lines(spark, ("a", 0.0, 0.7), ("b", 0.7, 1.0), (None, 0.0, 9.0))).first()[1] == pytest.approx(0.7)
    clip = spark.createDataFrame([("c", 10, [[1.0] * 5 + [0.1] * 5])], "clip_id string, sampling_rate int, channels array<array<double>>")
    got = diarization.speech_metrics(clip, lines(spark, ("VOICE", 0.0, 0.45)), ["voice_signal_to_noise_power_ratio_metric", "primary_speaker_ratio_metric"]).first()
    assert got.voice_signal_to_noise_power_ratio_metric == pytest.approx(20)
    none = diarization.speech_metrics(clip, lines(spark).limit(0), ["voice_activity_detection_metric", "voice_signal_to_noise_power_ratio_metric"]).first()
    assert none.voice_activity_detection_metric == 0 and np.isnan(none.voice_signal_to_noise_power_ratio_metric)


def test_voice_snr_against_brute_force(spark):
    rng, rate = np.random.default_rng(5), 7
    w = rng.normal(size=300)
    rows = [(str(rng.choice(["VOICE", "x"])), a := round(float(rng.uniform(0, 30)), 1), a + round(float(rng.uniform(0, 0.4)), 1)) for _ in range(60)]
    clip = spark.createDataFrame([("c", rate, [w.tolist()])], "clip_id string, sampling_rate int, channels array<array<double>>")
    got = diarization.speech_metrics(clip, lines(spark, *rows), ["voice_signal_to_noise_power_ratio_metric"]).first()
    time, voice, noise, end = np.arange(300) / rate, [], [], 0.0
    for s, a, b in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        voice += [*w[(time >= a) & (time <= b)]] if s == "VOICE" else []
        noise += [*w[(time >= end) & (time < a)]]
        end = max(end, b)
    noise += [*w[time > end]]
    assert got.voice_signal_to_noise_power_ratio_metric == pytest.approx(10 * np.log10(np.mean(np.square(voice)) / np.mean(np.square(noise))), abs=1e-9)


def test_voice_snr_of_a_long_clip_with_many_lines(spark):
    import time

    seconds, rate = 20_000, 50  # lines times samples were 2e10
    clip = spark.sql(f"SELECT 'c' AS clip_id, {rate} AS sampling_rate, array(transform(sequence(0, {seconds * rate - 1}), i -> IF(i % {rate} < 25, 1d, 0.1d))) AS channels")
    spoken = spark.range(seconds).selectExpr("'c' AS clip_id", "'VOICE' AS speaker", "id * 1d AS start_sec", "id + 0.49 AS end_sec")
    began = time.monotonic()
    assert diarization.speech_metrics(clip, spoken, ["voice_signal_to_noise_power_ratio_metric"]).first().voice_signal_to_noise_power_ratio_metric == pytest.approx(20)
    assert time.monotonic() - began < 20


# texts


def test_word_scores(spark):
    df = spark.createDataFrame([("hello world", "hello duck"), ("", ""), (None, "a"), ("a", ""), ("", "a b")], "r string, h string")
    rows = df.select(word_scores(F.col("r"), F.col("h")).alias("s"), character_error_rate(F.col("r"), F.col("h")).alias("c")).collect()
    assert tuple(rows[0].s) == (0.5, 0.5, 0.75, 0.25) and rows[0].c == pytest.approx(0.45454545454545453)
    assert tuple(rows[1].s) == (0, 0, 0, 1) and rows[1].c == 0
    assert tuple(rows[2].s) == (None,) * 4 and rows[2].c is None
    assert rows[3].s.wer == 1 and rows[4].s.wer == float("inf")


def test_edit_counts_against_table():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        t = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        hits, s, d, i = edit_counts(a, b)
        assert s + d + i == t[-1][-1] and hits + s + d == len(a) and hits + s + i == len(b)


# similarity


def test_similarities(spark):
    x = [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]
    df = spark.createDataFrame([(a, [2 * v for v in a]) for a in x], "x array<double>, y array<double>")
    assert similarity.linear_alignment(df) == pytest.approx(1, abs=1e-4)
    rank_one = similarity.canonical_correlation(df)
    assert rank_one == pytest.approx(0.5, abs=1e-4)  # the columns are collinear: one of two directions
    rng = np.random.default_rng(0)
    z = rng.normal(size=(40, 3))
    full = spark.createDataFrame([(a.tolist(), (a @ np.array([[1.0, 2, 0], [0, 1, 1], [1, 0, 1]])).tolist()) for a in z], "x array<double>, y array<double>")
    assert similarity.canonical_correlation(full) == pytest.approx(1, abs=1e-6)
    assert similarity.rbf_alignment(full.select("x", F.col("x").alias("y"))) == pytest.approx(1, abs=1e-6)


def test_linear_alignment_is_the_kernel_form(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=(30, 3))
    h = np.eye(30) - 1 / 30
    a, b = (h @ (m @ m.T + 1e-6 * np.eye(30)) @ h for m in (x, y))
    df = spark.createDataFrame([(p.tolist(), q.tolist()) for p, q in zip(x, y)], "x array<double>, y array<double>")
    assert similarity.linear_alignment(df, standardize=False) == pytest.approx((a * b).sum() / np.linalg.norm(a) / np.linalg.norm(b), rel=1e-6)


def whole_rbf_alignment(x, y, threshold=1.0, reg=1e-6):
    def gram(m):
        m = (m - m.mean(0)) / (m.std(0, ddof=1) + 1e-8)
        d = ((m[:, None, :] - m[None, :, :]) ** 2).sum(2)
        flat = np.sort(d, axis=None)
        k = np.exp(-d / (2 * threshold**2 * max(flat[(flat.size - 1) // 2], 1e-10))) + reg * np.eye(len(m))
        h = np.eye(len(m)) - 1 / len(m)
        return h @ k @ h

    a, b = gram(x), gram(y)
    return (a * b).sum() / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-8)


@pytest.mark.parametrize("n, block_rows", [(61, 16), (60, 1000), (2, 1)])
def test_rbf_alignment_in_blocks(spark, n, block_rows):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(n, 4)), rng.normal(size=(n, 3)) ** 3
    x[: n // 4], y[: n // 3] = x[0], y[0]  # samples that are alike
    y[:, 0] += x[:, 0]
    df = spark.createDataFrame([(p.tolist(), q.tolist()) for p, q in zip(x, y)], "x array<double>, y array<double>").repartition(3)
    for threshold in (1.0, 0.5):
        assert similarity.rbf_alignment(df, threshold=threshold, block_rows=block_rows) == pytest.approx(whole_rbf_alignment(x, y, threshold), rel=1e-9)


def test_rbf_alignment_of_more_than_5000(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5003, 2))
    df = spark.createDataFrame([(p.tolist(), q.tolist()) for p, q in zip(x, 3 * x + 1)], "x array<double>, y array<double>")
    assert similarity.rbf_alignment(df) == pytest.approx(1, abs=1e-6)


def test_equal_error_rate(spark):
    pos = spark.createDataFrame([(v,) for v in (0.6, 0.7, 0.8, 0.5)], "score double")
    neg = spark.createDataFrame([(v,) for v in (0.4, 0.3, 0.2, 0.1)], "score double")
    r = similarity.equal_error_rate(similarity.scored_lists(pos, neg)).first()
    assert r.eer == 0 and r.threshold == pytest.approx(0.45)


def test_cross_correlation(spark):
    from sonoframe.functions.arrays import cosine, cross_correlation

    df = spark.createDataFrame([([1.0, 2.0, 1.0], [1.0, 2.0]), ([1.0, 1.0], [1.0, 1.0]), ([0.0, 0.0], [1.0]), ([], [1.0])], "a array<double>, b array<double>")
    rows = [r[0] for r in df.select(cross_correlation(F.col("a"), F.col("b"))).collect()]
    assert rows[0] == pytest.approx([0.3651, 0.9129, 0.7303, 0.1826], abs=1e-4) and rows[1] == pytest.approx([0.5, 1, 0.5]) and rows[2:] == [None, None]
    pair = spark.createDataFrame([([0.0], [1.0])], "a array<double>, b array<double>")
    assert np.isnan(pair.select(cosine(F.col("a"), F.col("b"))).first()[0])
    with pytest.raises(Exception, match="length"):
        df.limit(1).select(cosine(F.col("a"), F.col("b"))).collect()


def test_pca_is_centred(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3)) * [5, 1, 0.1] + 10
    got = np.array([r.projected for r in similarity.principal_components(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), "v", 2).collect()])
    assert np.abs(got.mean(0)).max() < 1e-9
    assert got.var(0, ddof=1) == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2])


# trees and alignment

NODE = "clip_id string, node_path string, level int, ord int, text string, speaker string, start_sec double, end_sec double"


def some_tree(spark):
    rows = [("/0", 0), ("/0/0", 1), ("/0/0/0", 2), ("/0/0/1", 2), ("/0/1", 1), ("/0/1/0", 2), ("/1", 0), ("/1/0", 1)]
    return spark.createDataFrame([("c", p, n, int(p.split("/")[-1]), p, None, float(i), i + 1.0) for i, (p, n) in enumerate(rows)], NODE)


def paths(df):
    return sorted((r.node_path, r.text, r.level, r.ord) for r in df.collect())


def test_levels(spark):
    assert paths(tree.remove_level(some_tree(spark), 1)) == [("/0", "/0", 0, 0), ("/0/0", "/0/0/0", 1, 0), ("/0/1", "/0/0/1", 1, 1), ("/0/2", "/0/1/0", 1, 2), ("/1", "/1", 0, 1)]
    assert [p[:2] for p in paths(tree.remove_level(some_tree(spark), 0))] == [("/0", "/0/0"), ("/0/0", "/0/0/0"), ("/0/1", "/0/0/1"), ("/1", "/0/1"), ("/1/0", "/0/1/0"), ("/2", "/1/0")]
    assert {r.level for r in tree.keep_levels(some_tree(spark), utterance=True).collect()} == {0, 1}


def test_script_lines(spark):
    df = spark.createDataFrame([("c", "/0", 0, 0, " ok ", "spk1", 0.0, 0.5)], NODE)
    assert tree.indented(tree.cleaned(df)).first().line == "spk1: ok [0.00 - 0.50]"
    for bad in ([("c", "/0", 0, 0, " ", None, None, None)], [("c", "/0", 0, 0, "a", None, -1.0, 2.0)]):
        with pytest.raises(Exception, match="script line|negative"):
            tree.cleaned(spark.createDataFrame(bad, NODE)).select("text").collect()
    timed = spark.createDataFrame([("c", "/0", 0, 0, "x", None, None, None), ("c", "/0/0", 1, 0, "a", None, 0.0, 0.5), ("c", "/0/1", 1, 1, "b", None, 0.6, 1.2)], NODE)
    top = tree.inherited_times(timed).where("level = 0").first()
    assert (top.start_sec, top.end_sec) == (0.0, 1.2)
    tree.assert_alike(timed, timed)
    with pytest.raises(AssertionError):
        tree.assert_alike(timed, timed.withColumn("start_sec", F.col("start_sec") + 0.2))


def test_alignment(spark):
    vocabulary = ["-", "|", "A", "B"]
    said = [2, 2, 0, 3, 1, 2, 2]  # A A - B | A A
    emission = [[-0.05 if v == k else -5.0 for v in range(4)] for k in said]
    df = spark.createDataFrame([("c", 0, "ab a.", 1.0, 1.14, emission), ("c", 1, "??", 0.0, 1.0, emission), ("c", 2, "abababab", 0.0, 1.0, emission)], "clip_id string, ord int, text string, start_sec double, end_sec double, emission array<array<double>>")
    rows = {r.node_path: r for r in alignment.align(df, vocabulary).collect()}
    assert rows["/0/0/0"].text == "ab" and rows["/0/0"].text == "ab a."
    assert [rows[f"/0/0/0/{i}"].text for i in range(2)] == ["a", "b"]
    assert rows["/0/0/0/0"].start_sec == pytest.approx(1.0, abs=0.03) and rows["/0/0/1"].end_sec == pytest.approx(1.14, abs=0.03)
    assert sorted(p for p in rows if p.startswith(("/1", "/2"))) == ["/1", "/2"]
    assert alignment.sentences("Dr. A came. He left!") == [(0, 11), (12, 20)]


def every_path(emission, tokens, blank=0):
    """All monotone paths, one by one: the best one's frames of each token."""
    best, frames = (-np.inf, None), len(emission)
    for moves in itertools.combinations(range(frames), len(tokens)):
        total, j, spans = 0.0, 0, []
        for t in range(moves[-1] + 1):
            moving = t in moves
            total += emission[t][tokens[j] if moving else blank]
            if moving:
                spans.append([t, t + 1])
                j += 1
            elif j:
                spans[-1][1] = t + 1
        best = max(best, (total, spans), key=lambda x: x[0])
    return best[1]


def test_best_paths_against_all_paths(monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_CELLS", 300)
    rng = np.random.default_rng(3)
    emissions = [np.log(rng.dirichlet(np.ones(5), int(rng.integers(1, 9)))) for _ in range(60)]
    tokens = [rng.integers(1, 5, int(rng.integers(1, len(e) + 1))).tolist() for e in emissions]
    for e, t, got in zip(emissions, tokens, alignment.best_paths(emissions, tokens), strict=True):
        assert [list(x) for x in zip(got.first, got.end, strict=True)] == every_path(e, t)
        assert all(0 < x <= 1 for x in got.score)
    assert alignment.best_paths([np.zeros((2, 3))], [[1, 1, 2]]) == [None] and alignment.best_paths([], []) == []
    assert alignment.best_paths([np.full((3, 2), -np.inf)], [[1]]) == [None]


def test_segments_beyond_the_audio(spark):
    emission = [[-0.05 if v == k else -5.0 for v in range(3)] for k in (1, 2)]
    rows = [("c", 0, "ab", 1.0, 2.0, emission, 1.5), ("c", 1, "ab", 1.5, 2.0, emission, 1.5), ("c", 2, None, 0.0, 1.0, emission, None), ("c", 3, "ab", None, None, None, 9.0), ("c", 4, "", 0.0, float("nan"), [], 9.0)]
    df = spark.createDataFrame(rows, "clip_id string, ord int, text string, start_sec double, end_sec double, emission array<array<double>>, audio_sec double")
    paths = sorted(r.node_path for r in alignment.align(df, ["-", "A", "B"]).collect())
    assert paths == ["/0", "/0/0", "/0/0/0", "/0/0/0/0", "/0/0/0/1", "/1", "/2", "/3", "/4"]
    texts = spark.createDataFrame([("Dr. A came. He left!",), (None,), ("",), ("  no mark ",)], "t string")
    assert [r[0] if r[0] is None else [tuple(x) for x in r[0]] for r in texts.select(alignment.sentence_spans(F.col("t"))).collect()] == [[(0, 11), (12, 20)], None, [], [(0, 9)]]


# labels


def test_votes_and_labels(spark):
    df = spark.createDataFrame([(True, False, "yes", float("nan")), (None, False, "no", 0.0), (False, False, None, 1.0)], "a boolean, b boolean, s string, d double")
    rows = labeling.votes(df, ["a", "b", "s", "d"]).collect()
    assert [(r.lf_a, r.lf_b, r.lf_s, r.lf_d) for r in rows] == [(0, 1, 0, -1), (-1, 1, 1, 1), (1, 1, -1, 0)]
    kept, dropped = labeling.prune_checks(spark.createDataFrame([(True, True, False, True), (False, False, True, True), (True, True, False, True)], "a boolean, b boolean, c boolean, k boolean"), ["a", "b", "c", "k"])
    assert kept == ["a", "c"] and dropped == {"a": ["b"]}
    only = labeling.review(spark.createDataFrame([(True,), (True,)], "k boolean"), ["k"])
    assert {r.label for r in only.collect()} == {"INCLUDE"}


# sources


def test_wav_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).uniform(-1, 1, (2, 100))
    for bits, tolerance in ((16, 1e-4), (32, 1e-9), (-32, 1e-6)):
        rate, y = wav.decode(wav.encode(x, 8000, bits))
        assert rate == 8000 and np.abs(x - y).max() < tolerance
    df = spark.createDataFrame([(str(tmp_path / "a" / f"{i}.wav"), 8000, x.tolist()) for i in range(3)], "path string, sampling_rate int, channels array<array<double>>")
    assert wav.save_clips(df).count() == 3
    got = wav.read_clips(spark, str(tmp_path / "a"), offset_sec=0.005, duration_sec=0.005).collect()
    assert len(got) == 3 and np.abs(np.array(got[0].channels) - x[:, 40:80]).max() < 1e-4
    head = wav.read_headers(spark, str(tmp_path / "a")).first()
    assert (head.sampling_rate, head.n_channels, head.duration_sec) == (8000, 2, 100 / 8000)
    with pytest.raises(ValueError):
        wav.read_clips(spark, str(tmp_path), offset_sec=-1)


def test_files(spark, tmp_path):
    for name in ("b.wav", "a.WAV", "c.mp3", "d.Mp3", "e.txt", ".h.wav", "sub/f.mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    names = lambda df: [os.path.basename(r.path) for r in df.collect()]
    assert [n for n in names(files.audio_files(spark, str(tmp_path))) if n[0] != "."] == ["a.WAV", "b.wav", "c.mp3"]
    assert files.audio_files(spark, str(tmp_path / "none")).count() == 0
    assert names(files.list_files(spark, str(tmp_path), types=["video"], extensions=["mp3"])) == ["c.mp3", "d.Mp3", "f.mp4"]
    with pytest.raises(ValueError):
        files.list_files(spark, str(tmp_path), types=["image"])
    wanted = spark.createDataFrame([(str(tmp_path / "b.wav"),), ("/none.wav",)], "path string")
    assert names(files.existing(wanted, files.listing(spark, str(tmp_path)))) == ["b.wav"]
    with pytest.raises(ValueError):
        files.existing(wanted.where("path = '/none.wav'"), files.listing(spark, str(tmp_path)))
    with pytest.raises(Exception, match="unsupported"):
        files.one_type(spark.createDataFrame([("x.txt",)], "path string")).collect()
    sums = files.checksums(spark, str(tmp_path / "b.wav"))
    assert files.verified(sums, sums).first().ok is True


def test_chat(spark, tmp_path):
    text = "@Begin\n*CHI:\ta boy named jack was watching his frog last night . \x151_34881\x15\n%mor:\tx\n*CHI:\twhen he forgot to close the lid <on> [/] <on the frog> [//] on\n\tthe jar . \x1534881_50681\x15\n*MOT:\t&-um (be)cause xxx he did !\n@End\n"
    (tmp_path / "a.cha").write_text(text)
    rows = chat.chat_lines(spark, str(tmp_path / "a.cha")).orderBy("ord").collect()
    assert [(r.speaker, r.text, r.start_sec, r.end_sec) for r in rows] == [
        ("CHI", "a boy named jack was watching his frog last night.", 0.001, 34.881),
        ("CHI", "when he forgot to close the lid on the jar.", 34.881, 50.681),
        ("MOT", "because he did!", None, None),
    ]


def test_datasets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i bigint, s string")
    for kind in ("parquet", "json", "csv", "arrow"):
        path = datasets.save_dataset(df, str(tmp_path), "t", kind)
        assert sorted((int(r.i), r.s) for r in datasets.read_dataset(spark, path).collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        datasets.save_dataset(df, str(tmp_path), "t", "xml")
    with pytest.raises(RuntimeError):
        datasets.read_dataset(spark, str(tmp_path / "t.xml"))
    people = spark.createDataFrame([("p", {}), (" ", {})], "id string, metadata map<string,string>")
    catalog = datasets.Catalog().add("participants", people)
    assert catalog.participants.count() == 2
    with pytest.raises(Exception, match="stands twice"):
        catalog.add("participants", people.where("id = 'p'")).participants.collect()
    clips = spark.createDataFrame([("x", 8, [[0.5]], {"a": "1"})], "path string, sampling_rate int, channels array<array<double>>, metadata map<string,string>")
    back = datasets.Catalog.imported({"audios": datasets.Catalog(clips=clips).exported()["audios"].withColumn("site", F.lit(3))}, transfer_metadata=True)
    assert back.clips.first().metadata == {"a": "1", "site": "3"}


def test_languages(spark):
    table = spark.createDataFrame([("eng", "en", "English"), ("csb", None, "Kashubian")], "language_code string, alpha_2 string, language_name string")
    df = spark.createDataFrame([("EN",), ("kashubian",), ("csb",), ("xx",), (None,)], "l string")
    assert [r.language_code for r in languages.resolved(df, "l", table).collect()] == ["eng", "csb", "csb", None, None]


# models


def test_adapter(spark):
    import pandas as pd

    df = spark.createDataFrame([("a", "x y"), ("b", "z")], "id string, text string")
    load = lambda ref: lambda batch: pd.DataFrame({"vector": [[float(len(t))] for t in batch["text"]]})
    assert [r.vector for r in models.apply_model(df, "text_embedding", load, models.ModelRef("m")).orderBy("id").collect()] == [[3.0], [1.0]]
    short = lambda ref: lambda batch: pd.DataFrame({"vector": []})
    with pytest.raises(Exception, match="results for"):
        models.apply_model(df, "text_embedding", short, models.ModelRef("short")).collect()
    clip = spark.createDataFrame([(8000, [[0.0]])], "sampling_rate int, channels array<array<double>>")
    with pytest.raises(Exception, match="16000"):
        models.apply_model(clip, "transcribe", load, models.ModelRef("m")).collect()
    raw = spark.createDataFrame([(["1.0 2.0 B", "0.5 1.0 A"],)], "raw array<string>")
    assert [x.speaker for x in models.parsed_diarization(raw).first().lines] == ["A", "B"]


def test_features(spark):
    t = np.arange(8000) / 8000
    tone = (0.5 * np.sin(2 * np.pi * 150 * t)).tolist()
    df = spark.createDataFrame([("a", 8000, [tone]), ("b", 8000, [[0.0] * 400]), ("c", 8000, [[]])], "clip_id string, sampling_rate int, channels array<array<double>>")
    rows = {r.clip_id: r.features for r in features.voice_features(df).collect()}
    assert rows["a"].mean_f0 == pytest.approx(150, rel=0.01) and rows["a"].local_jitter < 0.01 and rows["a"].duration == 1.0
    assert np.isnan(rows["b"].mean_f0) and np.isnan(rows["c"].mean_f0)
    shape = features.spectrogram(df.where("clip_id = 'a'")).first().spectrogram
    assert len(shape) == 513
    assert len(features.mfcc(df.where("clip_id = 'a'")).first().mfcc) == 40


# streams


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [(f"c{c}", k, [float((c + 1) * (i - 3) * (-1) ** i) for i in range(k * 5, k * 5 + 5)]) for c in range(3) for k in range(4)]
    schema = "clip_id string, chunk_no int, samples array<double>"
    for k in range(4):
        spark.createDataFrame([r for r in rows if r[1] == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = windows.running_metrics(windows.read_stream(spark, str(tmp_path / "s"), schema))
    got = {r.clip_id: r for r in windows.run_to_end(stream, "update").orderBy("n").collect()}
    for c in range(3):
        x = np.concatenate([r[2] for r in rows if r[0] == f"c{c}"])
        assert got[f"c{c}"].n == 20 and got[f"c{c}"].mean_square == pytest.approx((x * x).mean())
        assert got[f"c{c}"].zero_crossing_rate == pytest.approx((np.sign(x[1:]) * np.sign(x[:-1]) < 0).mean())


# whole analyses


def test_conversation_report_has_every_line(spark, tmp_path):
    from sonoframe.plans.queries_speech import conversation_report

    vectors = {1: [i / 64 for i in range(64)], 2: [-0.5] * 64, 3: [0.1] * 64}
    spark.createDataFrame([(k, 0, v) for k, v in vectors.items()], "vec_id bigint, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rng = random.Random(5)
    spans = [(1, 0.0, 0.5), (1, 9.5, 23.25), (1, 3.0, 3.0), (2, 0.2, 1.7), (4, 0.0, 0.5)] + [(1, s, s + rng.random() * 9) for s in (rng.random() * 900 for _ in range(300))]
    rows = [(i, c, " a", s, e) for i, (c, s, e) in enumerate(spans)]
    spark.createDataFrame([*rows, rows[0]], "line_id bigint, clip_id bigint, speaker string, start_sec double, end_sec double").write.parquet(str(tmp_path / "diar_lines.parquet"))
    got = sorted(conversation_report(spark, str(tmp_path)).collect(), key=lambda r: (r.original_file, r.start_sec or 0, r.end_sec or 0))
    wanted = sorted(s for s in spans if s[0] in vectors)
    assert [(r.original_file, r.n) for r in got if r.n == 0] == [("clip 3", 0)]
    got = [r for r in got if r.n]
    assert [(r.original_file, r.start_sec, r.end_sec) for r in got] == [(f"clip {c}", round(a, 6), round(b, 6)) for c, a, b in wanted]
    assert {(r.original_file, r.n) for r in got} == {("clip 1", 303), ("clip 2", 1)}
    for r, (c, start, end) in zip(got, wanted, strict=True):
        x = np.tile(np.array(vectors[c], dtype="float32").astype(float), 1000)[int(start * 64) : int(end * 64)]
        assert [r.mean, r.peak] == pytest.approx([x.mean(), np.abs(x).max()] if len(x) else [0, 0], abs=1e-6)


def test_conversation_report_keeps_no_list_beside_its_rows(spark, data):
    import re

    from sonoframe.plans.queries_speech import conversation_report

    plan = conversation_report(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    kept = re.search(r"Generate posexplode\(.*\), \[([\d, ]*)\], true", plan).group(1)
    assert kept  # the list itself isn't copied into each of its rows


def test_conversation_segments_read_or_held(spark):
    clips = spark.createDataFrame([("a", "p", 10, [[float(i) for i in range(50)]]), ("b", None, 10, [[0.5] * 20])], "clip_id string, path string, sampling_rate int, channels array<array<double>>")
    own = spark.createDataFrame([("a", 0, "x", 0.0, 1.25), ("a", 1, "y", 1.0, 5.0), ("a", 2, "y", 3.0, 3.0), ("a", 3, "z", None, 1.0), ("b", 0, "x", 0.5, 2.0), ("c", 0, "x", 0.5, 2.0)], "clip_id string, ord int, speaker string, start_sec double, end_sec double")
    held = workflows_segments(clips, own)
    lazy = clips.withColumn("n_samples", F.size(F.get("channels", F.lit(0)))).withColumnRenamed("channels", "w")
    assert workflows_segments(lazy, own, lambda first, size: F.transform("w", lambda c: F.slice(c, first + 1, size))) == held and len(held) == 4
    with pytest.raises(Exception, match="outside"):
        workflows_segments(lazy, own.withColumn("end_sec", F.lit(5.1)), lambda first, size: F.col("w"))


def workflows_segments(clips, own, read=None):
    from sonoframe.operators import workflows

    return sorted((r.clip_id, r.ord, r.speaker, r.start_sec, r.end_sec, r.sampling_rate, str(r.path), r.channels) for r in workflows.conversation_segments(clips, own, read=read).collect())


def test_conversation_segments_outside_their_clip_raise(spark):
    from sonoframe.operators import workflows

    clips = spark.createDataFrame([("a", "p", 4, [[0.0] * 8])], "clip_id string, path string, sampling_rate int, channels array<array<double>>")
    for s, e in ((1.0, 2.5), (-1.0, 1.0)):
        with pytest.raises(Exception, match="outside its clip"):
            workflows.conversation_segments(clips, spark.createDataFrame([("a", 0, "x", s, e)], "clip_id string, ord int, speaker string, start_sec double, end_sec double")).collect()


# headers of WAV files


@pytest.mark.parametrize("before", ["fmt ", "data"])
@pytest.mark.parametrize("size", [4040, 4056, 4058, 4066, 4070, 9000])
def test_headers_beyond_4096_bytes(spark, tmp_path, before, size):
    import struct

    body = wav.encode([[0.5] * 12000], 8000)
    at = body.index(before.encode())
    chunk = b"LIST" + struct.pack("<I", size) + b"\0" * size
    (tmp_path / "a.wav").write_bytes(body[:at] + chunk + body[at:])
    (tmp_path / "b.wav").write_bytes(b"RIFF" + b"\0" * 9000)
    (tmp_path / "c.wav").write_bytes(body[:12] + chunk)
    got = {r.path[-5:]: tuple(r)[1:] for r in wav.read_headers(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": (8000, 1, 1.5), "b.wav": (None, None, None), "c.wav": (None, None, None)}
    clip = wav.read_clips(spark, str(tmp_path / "a.wav")).first()
    assert clip.sampling_rate == 8000 and len(clip.channels[0]) == 12000


def test_whole_vectors_in_queries(spark, tmp_path):
    from sonoframe.plans import registry

    rng = np.random.default_rng(6)
    vectors = [rng.normal(size=64).astype("float32") for _ in range(4)]
    spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.a_id, r.lag): r.r for r in registry.queries()["xcorr"](spark, str(tmp_path)).collect()}
    assert len(got) == 3 * 127
    for k, (a, b) in enumerate(zip(vectors, vectors[1:])):
        a, b = a.astype(float), b.astype(float)
        assert [got[k, i] for i in range(127)] == pytest.approx(list(np.correlate(a, b, "full") / np.sqrt((a @ a) * (b @ b))), abs=1e-6)
    items = {(r.vec_id, r.ord): r.item for r in registry.queries()["unbatch"](spark, str(tmp_path)).collect()}
    assert items == {(k, i): pytest.approx(float(x), abs=1e-6) for k, v in enumerate(vectors) for i, x in enumerate(v)}


def test_remove_level_of_a_deep_tree(spark):
    depth = 1100
    rows = [("c", "/" + "/".join(["0"] * (k + 1)), k, 0) for k in range(depth)]
    rows.append(("c", "/" + "/".join(["0"] * (depth - 1) + ["1"]), depth - 1, 1))
    nodes = spark.createDataFrame(rows, "clip_id string, node_path string, level int, ord int")
    got = tree.remove_level(nodes, 1).collect()
    assert len(got) == depth
    deepest = sorted((r.node_path, r.ord) for r in got if r.level == depth - 2)
    assert deepest == [("/" + "/".join(["0"] * (depth - 1)), 0), ("/" + "/".join(["0"] * (depth - 2) + ["1"]), 1)]


def test_join_on_hot_keys(spark):
    from sonoframe.plans.skew import join_one

    left = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 5 == 0 else f"k{i % 7}") for i in range(100)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k3", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "k", how).collect()))
        for most in (3, 30, 1000):
            assert sorted(map(str, join_one(left, right, "k", how, hot_rows=most).collect())) == want
    assert join_one(left.limit(0), right, "k", hot_rows=0).count() == 0


def test_intervals_of_any_size(spark):
    from sonoframe.operators.intervals import speaking_periods

    rows = [(1, "a", 0.0, 9e15), (1, "a", 5.0, 6.0), (2, "a", 1e12, 2e12), (2, "a", 1.5e12, 1e13), (2, "a", 1e13, 3e13), (2, "a", 5e13, 5e13 + 1), (3, "a", 0.0, float("inf")), (3, "a", 599.0, 600.0), (3, "a", 600.0, 1300.5), (3, "a", 1300.501, 1301.0)]
    df = spark.createDataFrame(rows, "clip_id bigint, speaker string, start_sec double, end_sec double")
    got = sorted((r.clip_id, r.kind, r.from_ms, r.to_ms) for r in speaking_periods(df).collect())
    assert got == [
        (1, "period", 0, 9 * 10**18), (2, "gap", 3 * 10**16, 5 * 10**16), (2, "period", 10**15, 3 * 10**16), (2, "period", 5 * 10**16, 5 * 10**16 + 1000),
        (3, "gap", 1300500, 1300501), (3, "period", 599000, 1300500), (3, "period", 1300501, 1301000),
    ]


@pytest.mark.parametrize("word, matrix_rows", [(62, 200), (2, 5), (62, 0)])
def test_common_time_against_brute_force(spark, monkeypatch, word, matrix_rows):
    monkeypatch.setattr(diarization, "WORD", word)
    monkeypatch.setattr(diarization, "MATRIX_ROWS", matrix_rows)
    monkeypatch.setattr(diarization, "BUCKET_MS", 7)
    rng = random.Random(word)

    def side(n):
        rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["A", "B", "C", "D", "E", None]), a := rng.randint(0, 60) / 1000, a + rng.randint(-1, 20) / 1000) for _ in range(n)]
        return rows, spark.createDataFrame([*rows, (4, "A", None, 1.0)], "clip_id bigint, speaker string, start_sec double, end_sec double")

    (a, ref), (b, hyp) = side(40), side(30)
    said = lambda rows, clip: {s: {t for c, x, p, q in rows if c == clip and x == s for t in range(round(p * 1000), round(q * 1000))} for s in "ABCDE"}
    want = {(c, x, y): len(t) for c in (1, 2, 3) for x, p in said(a, c).items() for y, q in said(b, c).items() if (t := p & q)}
    sets, names = diarization.speaking_together(diarization.boundaries(ref), diarization.boundaries(hyp))
    assert {(r.clip_id, r.r, r.h): r.ms for r in diarization.common_time(sets, names).collect()} == want
    for r in diarization.error_rate(ref, hyp).collect():
        x, y = said(a, r.clip_id), said(b, r.clip_id)
        counts = [(sum(t in s for s in x.values()), sum(t in s for s in y.values())) for t in range(100)]
        assert [round(v * 1000) for v in (r.false_alarm, r.missed, r.total)] == [sum(max(h - k, 0) for k, h in counts), sum(max(k - h, 0) for k, h in counts), sum(k for k, _ in counts)]
    assert diarization.error_rate(ref.limit(0), hyp.limit(0)).count() == 0
    assert {r.missed for r in diarization.error_rate(ref.limit(0), hyp).collect()} == {0.0}


def _many_speakers(spark, n):
    """A clip of ``n`` speakers, of whom neighbours overlap for a second; a hypothesis half a second later."""
    ref = spark.createDataFrame([(1, f"S{i:04}", i * 1.0, i + 2.0) for i in range(n)], "clip_id int, speaker string, start_sec double, end_sec double")
    return ref, ref.withColumns({"start_sec": F.col("start_sec") + 0.5, "end_sec": F.col("end_sec") + 0.5})


def test_error_parts_make_no_pairs(spark, data):
    from sonoframe.plans.queries_speech import der_components

    ref, hyp = _many_speakers(spark, 50)
    assert diarization.error_parts(ref, hyp).first() == diarization.error_rate(ref, hyp).select("clip_id", "false_alarm", "missed", "total").first()
    plan = der_components(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "maps(" not in plan  # neither mapping nor pairs


def test_assignment_of_many_speakers():
    rng = np.random.default_rng(3)
    n = 60
    m, at = np.zeros((n, n)), rng.permutation(n)
    m[np.arange(n), at] = 100.0
    m += rng.uniform(0, 1, (n, n)) * (rng.uniform(size=(n, n)) < 0.2)
    names = [f"{i:02}" for i in range(n)]
    for greedy in (False, True):
        assert diarization._assignment(m, names, names, greedy) == {names[at[i]]: names[i] for i in range(n)}


def test_rows_of_error_rates_do_not_widen_with_speakers(spark):
    import glob

    from sonoframe.plans.durable import shared_folder

    def widest(n):
        rows, rest = diarization.speaking_together(*map(diarization.boundaries, _many_speakers(spark, n)))
        return max(len(str(r)) for r in [*rows.collect(), *rest.collect()])

    assert widest(700) < widest(10) + 20
    files = f"{shared_folder(spark).removeprefix('file:')}/**/part-*"
    before = len(glob.glob(files, recursive=True))
    r = diarization.error_rate(*_many_speakers(spark, 700), greedy=True).first()
    assert len(glob.glob(files, recursive=True)) == before  # no copies of the lines on disk
    assert (r.false_alarm, r.missed, r.confusion, r.total) == (1.0, 1.0, 349.0, 1400.0)


def test_lines_of_error_rates_are_shuffled_once(spark, data):
    from sonoframe.plans.queries_speech import der_optimal

    ref = spark.createDataFrame([(1, "A", 10.0, 70.0), (1, "B", 50.0, 180.0), (1, "A", 60.0, 119.0)], "clip_id int, speaker string, start_sec double, end_sec double")
    near, far = ref.where("speaker = 'A'"), ref
    rows, rest = diarization.speaking_together(*map(diarization.boundaries, (near, near)))
    assert rest.count() == 0  # what ends in the next bucket needn't be carried there
    assert sorted({(r._bucket, r.at, r.till) for r in rows.collect()}) == [(0, 10_000, 60_000), (1, 0, 10_000), (1, 0, 59_000)]
    assert diarization.speaking_together(*map(diarization.boundaries, (far, near)))[1].count() > 0
    assert diarization.error_rate(far, near).first() == diarization.error_rate(far.union(far), near).first()
    r = diarization.error_rate(far, near).first()
    assert (r.false_alarm, r.missed, r.confusion, r.total, r.mapping) == (0.0, 130.0, 0.0, 239.0, {"A": "A"})
    plan = der_optimal(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [line_id" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("greedy", [False, True])
def test_mappings_of_many_clips(greedy):
    """The pairs that are mapped without an assignment are those of one."""
    from itertools import permutations

    rng = np.random.default_rng(5)
    pairs, want = [], []
    for c in range(300):
        m = rng.integers(0, [3, 9, 1000][c % 3], tuple(rng.integers(1, 5, 2)))
        pairs += [(c, i, j, m[i, j]) for i, j in np.argwhere(m)]
        got = diarization._assignment(m.astype(float), range(len(m)), range(len(m[0])), greedy)
        want.append(sum(m[i, j] for j, i in got.items()))
        if not greedy:
            wide = m if len(m) <= len(m[0]) else m.T
            assert want[-1] == max(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(len(wide[0])), len(wide)))
    c, i, j, ms = map(np.array, zip(*pairs, strict=True))
    taken = diarization._mapped(c, i, j, ms, 300, greedy)
    assert np.bincount(c[taken], weights=ms[taken], minlength=300).tolist() == want
    assert len({(a, b) for a, b in zip(c[taken], i[taken], strict=True)}) == len({(a, b) for a, b in zip(c[taken], j[taken], strict=True)}) == len(taken)
    assert len(diarization._mapped(c[:0], i[:0], j[:0], ms[:0], 2, greedy)) == 0


def test_pairs_of_many_buckets_are_added_up(spark, monkeypatch):
    """Speakers who all speak at once, bucket after bucket: what is held are the pairs, not the pairs of each bucket."""
    monkeypatch.setattr(diarization, "HELD_ROWS", 7)
    rows = [(1, f"S{i:02}", 60.0 * k + i / 100, 60.0 * k + 59) for k in range(5) for i in range(50)]
    ref = spark.createDataFrame(rows, "clip_id int, speaker string, start_sec double, end_sec double").coalesce(1)
    rows, rest = diarization.speaking_together(*[diarization.boundaries(ref)] * 2)
    got = {(r.r, r.h): r.ms for r in diarization.common_time(rows, rest).collect()}
    assert got == {(f"S{i:02}", f"S{j:02}"): 5 * (59_000 - 10 * max(i, j)) for i in range(50) for j in range(50)}
    r = diarization.error_rate(ref, ref).first()
    assert (r.confusion, r.error_rate, r.mapping) == (0.0, 0.0, {f"S{i:02}": f"S{i:02}" for i in range(50)})


@pytest.mark.parametrize("numbers", [None, 12])
def test_nearest_against_brute_force(spark, numbers):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (60, 4)).astype(float)
    v[7] = 0
    v[8] = v[9]
    rows = [(f"c{i:02}", x.tolist()) for i, x in enumerate(v)] + [("null", None)]
    df = spark.createDataFrame(rows, "clip_id string, vector array<double>").repartition(5)
    queries = df.withColumnRenamed("clip_id", "query_id").where("query_id LIKE 'c%' AND (query_id LIKE '%5' OR query_id IN ('c07', 'c08'))")
    got = [(r.query_id, r.rank, r.clip_id) for r in similarity.nearest(queries, df, 3, numbers).collect()]
    want = []
    for i in [5, 8, 15, 25, 35, 45, 55]:
        with np.errstate(invalid="ignore"):
            s = np.round((v / np.linalg.norm(v, axis=1, keepdims=True)) @ (v[i] / np.linalg.norm(v[i])), 12)
        order = sorted((j for j in range(60) if j != i and not np.isnan(s[j])), key=lambda j: (-s[j], j))[:3]
        want += [(f"c{i:02}", k + 1, f"c{j:02}") for k, j in enumerate(order)]
    assert sorted(got) == sorted(want)
    assert similarity.nearest(queries.limit(0), df, 3).count() == 0 and similarity.nearest(queries, df.limit(0), 3).count() == 0


def test_label_model_with_patterns_on_executors(spark, monkeypatch):
    rng = random.Random(2)
    rows = [tuple(rng.choice([1, 1, 0, -1]) if k else 1 - (i % 3 == 0) for k in range(4)) for i in range(200)]
    df = spark.createDataFrame(rows, "lf_a int, lf_b int, lf_c int, lf_d int")
    near = labeling.fit_label_model(df, df.columns, rounds=4)
    monkeypatch.setattr(labeling, "PATTERNS", 2)
    far = labeling.fit_label_model(df, df.columns, rounds=4)
    assert far[0] == pytest.approx(near[0]) and all(far[1][c] == pytest.approx(near[1][c]) for c in df.columns)
    assert labeling.fit_label_model(df.limit(0), df.columns)[0] == 0.5


def test_models_by_piece_window_and_pair(spark):
    from sonoframe.operators import models

    clips = spark.createDataFrame([("a", 4, [[1.0, 2.0, 3.0, 4.0, 5.0]]), ("b", 4, [[]]), ("c", 4, [[9.0]])], "clip_id string, sampling_rate int, channels array<array<double>>")
    twice = lambda _: lambda b: __import__("pandas").DataFrame({"out_channels": [[[2 * x for x in c[0]]] for c in b["channels"]], "out_rate": b["sampling_rate"].astype("int32")})
    shorter = lambda _: lambda b: __import__("pandas").DataFrame({"out_channels": [[list(c[0])[1:]] for c in b["channels"]], "out_rate": b["sampling_rate"].astype("int32")})
    clips16 = clips.withColumn("sampling_rate", F.lit(16_000))
    got = {r.clip_id: r.channels for r in models.enhance_in_pieces(clips16, twice, models.ModelRef("twice"), seconds=2 / 16_000, batch=2).collect()}
    assert got == {"a": [[2.0, 4.0, 6.0, 8.0, 10.0]], "b": [[]], "c": [[18.0]]}
    with pytest.raises(Exception, match="keeps length"):
        models.enhance_in_pieces(clips16, shorter, models.ModelRef("shorter")).collect()
    labels = lambda _: lambda b: __import__("pandas").DataFrame({"result": [[{"score": 0.1, "label": "x"}, {"score": float(len(c[0])), "label": "y"}] for c in b["channels"]]})
    rows = models.classify_windows(clips, labels, models.ModelRef("labels"), 0.5, top_k=5).orderBy("clip_id", "window_start").collect()
    assert [(r.clip_id, r.window_start, r.labels[0]) for r in rows] == [("a", k / 4, "y") for k in range(5)] + [("c", 0.0, "y")]
    a = clips.withColumn("pair_no", F.lit(1)).where("clip_id = 'a'")
    assert models.paired(a, a).first().target_id == "a"
    for bad in (a.limit(0), a.unionByName(a)):
        with pytest.raises(Exception, match="one target"):
            models.paired(a, bad).collect()
    with pytest.raises(Exception, match="no transcript"):
        models.require_transcripts(spark.createDataFrame([(" ",)], "text string")).collect()


def test_sources_of_any_size(spark, tmp_path):
    from sonoframe.operators.frames import numbered

    df = spark.createDataFrame([(i, f"n{i}", [float(i)]) for i in range(20)], "i int, s string, v array<double>").repartition(3)
    path = datasets.save_dataset(df, str(tmp_path), "t", "arrow")
    assert sorted(map(str, datasets.read_dataset(spark, path).collect())) == sorted(map(str, df.collect()))
    datasets.save_dataset(df.where("i < 5"), str(tmp_path), "t", "arrow")
    assert datasets.read_dataset(spark, path).count() == 5
    with pytest.raises(Exception):
        datasets.read_dataset(spark, str(tmp_path / "none.arrow")).count()
    assert files.audio_files(spark, str(tmp_path / "none")).count() == 0 and files.audio_files(spark, path).count() == 0
    with pytest.raises(ValueError):
        files.list_files(spark, str(tmp_path / "none"))
    assert {(r.i, r._no) for r in numbered(df, "i", ranges=3).collect()} == {(i, i) for i in range(20)}
    assert numbered(df.limit(0), "i").count() == 0


def test_nested_records_by_another_schema():
    fields = {"": {"items": "item"}, "item": {"parts": "part", "items": "item"}}
    payload = json.dumps({"items": [{"text": "a", "parts": [{"text": "b"}, None, "c"]}, {"items": {"text": "d"}}], "chunks": [{"text": "no"}]})
    assert [(k, p, t) for k, p, t, *_ in nested.shred(payload, fields)] == [("item", "/0", "a"), ("part", "/0/0", "b"), ("part", "/0/2", "c"), ("item", "/1", None), ("item", "/1/0", "d")]
    assert [t for _, _, t, *_ in nested.shred(payload)] == ["no"]


def test_references_of_models():
    from sonoframe.operators.models import ModelRef

    assert ModelRef("a/b") == ModelRef("a/b", "hub", "main")
    for bad in (("",), ("a", "nowhere"), ("a", "hub", " ")):
        with pytest.raises(ValueError):
            ModelRef(*bad)
