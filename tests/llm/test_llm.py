"""The operators of the subpackage against brute force, round trips and held-out accuracy, and in odd cases."""

import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe.llm import language, mixing, packing, shared, splits, turns
from sonoframe.llm.automaton import SuffixAutomaton
from sonoframe.llm.bytegru import ByteGru, encode
from sonoframe.llm.queries import QUERIES, SQL
from sonoframe.llm.tokens import token_count

CODES = {"CHI": "Child", "MOT": "Mother", "INV": "Investigator", "PAR": "Participant"}


@pytest.fixture(scope="module")
def parse():
    return turns.line_grammar(turns.Speakers(CODES))


# p1


@pytest.mark.parametrize(
    "text, speaker, at, words",
    [
        ("*PAR 02:\tso &-um (be)cause of the [door [very] slams] runnin(g) .", "PAR2", None, ["so", "(be)cause", "of", "the", "runnin(g)"]),
        ("<v Mtoher> oh ((inaudible)) -- um -- yes", "MOT", None, ["oh", "yes"]),
        ("[00:01:46] [INV] at 7:30 {breath} Erm... (0.8)", "INV", 106.0, ["at", "7:30"]),
        ("00:00:27,203 --> >> PAR #1: uh- hm, ♪ ♪ *clears throat*", "PAR1", 27.203, []),
        ("<41.86> [crosstalk] and and", None, 41.86, ["and", "and"]),
        ("we left \x1516287_20747\x15", None, 16.287, ["we", "left"]),
        ("[0m06s] yes (00:34)", None, 6.0, ["yes"]),
        ("the mother: no", None, None, ["the", "mother:", "no"]),
        ("[unclosed bracket", None, None, ["unclosed", "bracket"]),
        ("Investgiator : a", "INV", None, ["a"]),
        ("", None, None, []),
        (None, None, None, []),
    ],
)
def test_line_grammar(parse, text, speaker, at, words):
    got = parse(text)
    assert got[0] == speaker and got[2] == words
    assert got[1] == (pytest.approx(at) if at is not None else None)


def test_deep_and_long_lines(parse):
    assert parse("[" * 500 + "a" + "]" * 500)[2] is not None
    assert len(parse("word " * 20_000)[2]) == 20_000


def test_one_edit():
    assert turns.within_one_edit("mohter", "mother") and turns.within_one_edit("mothr", "mother") and turns.within_one_edit("mother", "mother")
    assert not turns.within_one_edit("other", "mothers") and not turns.within_one_edit("tomher", "mother")


TURN_LINES = "line_id bigint, clip_id bigint, text string, speaker string, start_sec double, end_sec double, extra string, _bucket int"


def brute_turns(rows, parse):
    by, out = defaultdict(list), []
    for line, clip, text, field, start, *_ in dict.fromkeys(rows):
        who, at, words = parse(text)
        by[clip].append((start if start is not None else at, line, who or turns.Speakers(CODES).of_field(field), len(words)))
    for clip, own in by.items():
        own.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        who, turn, no = None, None, 0
        for _, line, s, n in own:
            who = s or who
            if not n:
                continue
            if turn is None or turn[2] != who:
                no += 1
                turn = [clip, no, who, line, line, 0]
                out.append(turn)
            turn[4], turn[5] = line, turn[5] + n
    return sorted(map(str, map(tuple, out)))


@pytest.mark.parametrize("bucket", [3, 600])
def test_turns_against_brute_force(spark, parse, monkeypatch, bucket):
    monkeypatch.setattr(turns, "BUCKET_SEC", bucket)
    monkeypatch.setattr(turns, "BUCKET_IDS", bucket * 7)
    rng = random.Random(bucket)
    rows = []
    for i in range(300):
        text = rng.choice(["hello", "um", None, "", "*CHI:\tyes", "MOT: uh", "<v PAR 2> a b", "[00:00:0%d] x" % rng.randint(0, 9), "z"])
        rows.append((i, rng.choice([1, 1, 1, 2, None]), text, rng.choice([None, None, "INV", "[Child]"]), rng.choice([None, float(rng.randint(0, 20)), rng.choice([-5.0, 1e300, float("inf")])]), None, "x", 0))
    rows += rows[:9]
    codes = spark.createDataFrame(list(CODES.items()), "speaker_code string, role_name string")
    df = spark.createDataFrame(rows, TURN_LINES)
    got = turns.speaker_turns(df, codes).collect()
    assert sorted(str((r.clip_id, r.turn_no, r.speaker, r.first_line_id, r.last_line_id, r.n_words)) for r in got) == brute_turns(rows, parse)
    assert all(len(r.text.split()) == r.n_words for r in got)
    assert turns.speaker_turns(df.limit(0), codes).count() == 0


# p4


def uid(i):
    return f"{i:08x}-0000-4000-8000-{i:012x}"


def test_ids(spark):
    plain = uid(0xABC)
    odd = ["{" + plain.upper() + "}", "urn:uuid:" + plain, plain.replace("-", "_"), " " + plain + "\n", plain.replace("-", ""), "URN:UUID:" + plain]
    none = [None, "", "-", "unknown", "N/A", uid(0).replace("4", "0").replace("8", "0"), plain[:-1], plain + "0"]
    df = spark.createDataFrame([(x,) for x in odd + none], "x string")
    assert [r[0] for r in df.select(splits.plain_id(F.col("x"))).collect()] == [plain] * len(odd) + [None] * len(none)


def brute_components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up if find(x) != x}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("hub", f"s{i:03}") for i in range(80)]
    loose = [(f"n{rng.randint(0, 60):02}", f"n{rng.randint(0, 60):02}") for _ in range(40)]
    edges = chain + star + loose + loose[:5]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, ("x", None), (None, "y"), ("z", "z")], "child string, root string").repartition(5)
    assert {r.child: r.root for r in splits.connected(df).collect()} == brute_components(edges)
    assert splits.connected(df.limit(0)).count() == 0


def test_groups_and_splits(spark):
    rec = "clip_id bigint, participant_id string, session_id string, group_key string"
    rows = [(1, uid(5), uid(20), "x"), (2, uid(6), uid(20).upper(), "x"), (3, uid(7), "-", "x"), (4, None, "", "x"), (4, None, "", "x"), (5, None, uid(21), "x"), (6, uid(9), None, "x")]
    people = spark.createDataFrame([(uid(7), {"same_as": uid(8)}), (uid(9), {"same_as": uid(8)}), (uid(5), None)], "id string, metadata map<string,string>")
    sessions = spark.createDataFrame([(uid(21), {"continues": uid(20)})], "id string, metadata map<string,string>")
    groups = splits.related_groups(spark.createDataFrame(rows, rec), people, sessions)
    assert {r.clip_id: r.group_key for r in groups.collect()} == {1: uid(5), 2: uid(5), 5: uid(5), 3: uid(7), 6: uid(7), 4: None}
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, target_share double")
    assigned = splits.assign_splits(groups, targets)
    got = {r.clip_id: r.split_name for r in assigned.collect()}
    assert len(got) == 6 and got[1] == got[2] == got[5] and got[3] == got[6] != got[1]
    assert {r.split_name: r.n_clips for r in splits.split_report(assigned, targets).collect()} == {got[1]: 3, got[3]: 3}
    with pytest.raises(ValueError):
        splits.assign_splits(groups, targets.limit(0))


def one_by_one(sizes, shares):
    exact = [Fraction(repr(x)) for x in shares]
    total = sum(s * n for s, n in sizes)
    short, placed = [total * x / sum(exact) for x in exact], defaultdict(int)
    for s, n in sorted(sizes, reverse=True):
        for _ in range(n):
            i = max(range(len(short)), key=lambda k: (short[k], -k))
            short[i] -= s
            placed[s, i] += 1
    return dict(placed)


def test_bulk_greedy_equals_one_by_one():
    rng = random.Random(0)
    for k in range(300):
        sizes = [(s, rng.choice([1, 2, 3, rng.randint(1, 200)])) for s in rng.sample(range(1, 50), rng.randint(1, 6))]
        shares = rng.choice([[0.8, 0.1, 0.1], [1 / 3, 1 / 3, 1 / 3], [0.5, 0.0, 0.5], [rng.random() + 0.05 for _ in range(3)]])
        got = splits.greedy_quotas(sizes, shares)
        assert {(s, i): n for s, i, n in got} == one_by_one(sizes, shares), (sizes, shares)
    assert splits.greedy_quotas([], [1.0]) == []
    assert sum(n for *_, n in splits.greedy_quotas([(1, 10**12), (7, 3)], [0.8, 0.2])) == 10**12 + 3


def test_splits_with_hot_groups(spark, monkeypatch):
    monkeypatch.setattr("sonoframe.plans.skew.HOT_ROWS", 5)
    rows = [(i, "hot" if i % 2 else f"g{i % 7}" if i % 3 else None) for i in range(60)]
    groups = spark.createDataFrame(rows, "clip_id bigint, group_key string")
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, target_share double")
    got = {r.clip_id: r.split_name for r in splits.assign_splits(groups, targets).collect()}
    assert len(got) == 60
    by = defaultdict(set)
    for i, g in rows:
        by[g or i].add(got[i])
    assert all(len(x) == 1 for x in by.values()) and sorted(np.unique(list(got.values()), return_counts=True)[1]) == [30, 30]
    star = [("hub", f"s{i:03}") for i in range(80)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(90)]
    df = spark.createDataFrame(star, "child string, root string").repartition(7)
    assert {r.child: r.root for r in splits.connected(df).collect()} == brute_components(star)


# p5


def test_gradients():
    net = ByteGru(3, hidden=4)
    net.p = {k: v.astype("float64") for k, v in net.p.items()}
    codes, lengths, _ = encode(["hello", "wörld is", "abc"], 16)
    labels = np.array([0, 1, 2])
    _, grads = net.gradients(codes, lengths, labels)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        x = net.p[k][at]
        net.p[k][at] = x + 1e-4
        up = net.gradients(codes, lengths, labels)[0]
        net.p[k][at] = x - 1e-4
        down = net.gradients(codes, lengths, labels)[0]
        net.p[k][at] = x
        assert (up - down) / 2e-4 == pytest.approx(g[at], rel=1e-3, abs=1e-8)


def test_encode_covers_every_byte():
    texts = ["", "a" * 205, "é" * 50, "x"]
    codes, lengths, owner = encode(texts, 96)
    for i, t in enumerate(texts):
        assert b"".join(bytes(c[:n].astype("uint8")) for c, n, o in zip(codes, lengths, owner) if o == i) == t.encode()


WORDS = {
    "eng": "the frog took a red letter before we left and nobody was looking for the window with her sister".split(),
    "deu": "der frosch nahm einen roten brief bevor wir gingen und niemand suchte das fenster mit seiner schwester".split(),
    "tur": "kurbağa kırmızı mektubu biz gitmeden önce aldı ve kimse kız kardeşiyle pencereyi aramıyordu dün".split(),
}


def sentence(rng, lang, n=9):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def small_training():
    keep = language.STEPS, language.BATCH
    language.STEPS, language.BATCH = (60, 60), 32
    yield
    language.STEPS, language.BATCH = keep


def test_held_out_accuracy_with_wrong_labels(small_training):
    rng = random.Random(4)
    samples = []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        label = rng.choice(list(WORDS)) if rng.random() < 0.15 else lang
        samples += [(i, sentence(rng, lang), label) for _ in range(3)]
    model = language.LanguageModel.fit(samples)
    tests = [(lang, sentence(rng, lang, 6)) for lang in WORDS for _ in range(60)]
    tests += [(lang, language.bare(sentence(rng, lang, 6))) for lang in WORDS for _ in range(20)]
    scores = model.scores([language.plain(t.upper() if i % 5 == 0 else t) for i, (_, t) in enumerate(tests)])
    right = [model.codes[int(s.argmax())] == lang for s, (lang, _) in zip(scores, tests)]
    assert np.mean(right) > 0.97


def test_language_rows(spark, small_training):
    rng = random.Random(5)
    seg = lambda *texts: [(0.0, 1.0, t) for t in texts]
    rows = [(i, lang.upper() if i % 2 else {"eng": "English", "deu": "de_AT", "tur": " tr"}[lang], seg(sentence(rng, lang), sentence(rng, lang))) for i in range(150) for lang in [list(WORDS)[i % 3]]]
    rows = [(i, label, s) for i, (_, label, s) in enumerate(rows)]
    odd = [
        (900, "unknown", seg(sentence(rng, "deu", 12))),
        (901, "English", seg(sentence(rng, "tur", 12))),
        (902, "deu", seg(sentence(rng, "deu", 14), "♪", "[noise]", sentence(rng, "eng", 10))),
        (903, None, seg("...", "")),
        (904, None, None),
        (905, "eng", []),
        (906, "eng", [(0.0, 1.0, None)]),
        (None, "zz", seg(sentence(rng, "eng", 12))),
        (907, "eng", seg(sentence(rng, "eng", 4000))),
    ]
    kind = "transcription_id bigint, language_label string, segments array<struct<start_sec:double,end_sec:double,text:string>>, label_code string"
    df = spark.createDataFrame([(*r, "x") for r in rows + odd + odd[:3]], kind)
    table = spark.createDataFrame([("eng", "en", "English"), ("deu", "de", "German"), ("tur", "tr", "Turkish"), ("csb", None, "Kashubian")], "language_code string, alpha_2 string, language_name string")
    model = language.fit_language_model(df, table)
    again = language.fit_language_model(df.repartition(3), table)
    assert again is not model and all((again.net.p[k] == x).all() for k, x in model.net.p.items())  # fitted anew, to the same
    kept = language.LanguageModel.of_table(model.table(spark))
    assert kept.codes == model.codes and all((kept.net.p[k] == x).all() for k, x in model.net.p.items())
    found = language.language_segments(df, table, kept)
    got = {(r.transcription_id, r.seg_no): r.language_code for r in language.corrected_languages(found).collect()}
    assert {k: v for k, v in got.items() if k[0] is None or k[0] >= 900} == {(900, 0): "deu", (901, 0): "tur", (902, 1): "deu", (902, 4): "eng", (None, 0): "eng"}
    assert not [k for k in got if k[0] is not None and k[0] < 900]
    assert all(0 <= r.confidence <= 1 for r in found.collect())
    assert language.language_segments(df.limit(0), table, model).count() == 0
    assert language.language_segments(df, table, language.fit_language_model(df.limit(0), table)).count() > 0


# p6


def test_packing_patterns():
    rng = random.Random(1)
    for _ in range(30):
        capacity = rng.randint(1, 200)
        histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, capacity + 1), min(capacity, rng.randint(1, 20)))}
        packs = packing.shortest_pack_first(histogram, capacity)
        placed = defaultdict(int)
        for count, entries in packs:
            assert sum(n * k for n, k in entries) <= capacity and len({n for n, _ in entries}) == len(entries)
            for n, k in entries:
                placed[n] += count * k
        assert dict(placed) == histogram
        assert len(packs) <= 3 * len(histogram)
        # worst fit one by one, for comparison
        rooms: list[int] = []
        for n in sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True):
            i = max(range(len(rooms)), key=rooms.__getitem__, default=None)
            if i is not None and rooms[i] >= n:
                rooms[i] -= n
            else:
                rooms.append(capacity - n)
        assert sum(c for c, _ in packs) == len(rooms)
    with pytest.raises(ValueError):
        packing.shortest_pack_first({5: 1}, 4)


def test_packed_items(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 0, 3, 3, 3, 7, rng.randint(1, 60), None]) for _ in range(300)]
    df = spark.createDataFrame([(i // 2 if i < 4 else i, n, "x") for i, n in enumerate(sizes)], "item_id bigint, n_tokens int, _rank string")
    rows = packing.pack_items(df, {"small": 10, "large": 64}).collect()
    for name, capacity in (("small", 10), ("large", 64)):
        own = [r for r in rows if r.container_name == name]
        room = defaultdict(int)
        for r in own:
            room[r.container_no] += r.n_tokens
            assert r.first_token == r.piece_no * capacity and 0 <= r.n_tokens <= capacity
        assert max(room.values()) <= capacity and sum(room.values()) == sum(n or 0 for n in sizes)
        assert len(own) == sum(max(1, -(-(n or 0) // capacity)) for n in sizes)
        assert set(range(max(room) + 1)) == set(room)
    assert packing.pack_items(df.limit(0), {"a": 5}).count() == 0
    with pytest.raises(ValueError):
        packing.pack_items(df, {})


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("ab " * 50_000,)], "t string")
    got = [r[0] for r in df.select(token_count(spark, F.col("t"))).collect()]
    assert got[0] in (2, 3) and got[1:3] == [0, 0] and got[3] > 1 and got[4] >= 50_000


# p7


def test_shortages_go_to_siblings_before_ancestors():
    leaves = [(("a", "x"), 0.25, 10.0), (("a", "y"), 0.25, 100.0), (("b", "z"), 0.5, 1000.0)]
    assert mixing.spread_budget(100, leaves) == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    assert mixing.spread_budget(300, leaves) == {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 190}
    assert sum(mixing.spread_budget(9999, leaves).values()) == 1110


def mix_tables(spark):
    rng = random.Random(3)
    docs = [(i, s, lang, rng.randint(0, 40)) for i in range(600) for s, lang in [rng.choice([("notes", "eng"), ("notes", "deu"), ("forum", "eng"), ("forum", "eng"), ("rare", "eng")] if i % 9 else [("rare", "eng")])]]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, language string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "Notes ", 0.5, 2), ("m", "forum", 0.3, 2), ("m", "rare", 0.2, 3), ("m", "absent", 0.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    return docs, sized, targets


def test_mix_reaches_its_shares(spark):
    docs, sized, targets = mix_tables(spark)
    size = {d[0]: d[3] for d in docs}
    rooms = {s: sum(d[3] for d in docs if d[1] == s) for s in ("notes", "forum", "rare")}
    total = min(int(rooms[s] * k / w) for s, k, w in (("notes", 2, 0.5), ("forum", 2, 0.3), ("rare", 3, 0.2)))
    mixed = mixing.mix_sources(sized, targets, total)
    rows = mixed.collect()
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    assert all(0 < r.tokens_used <= size[r.doc_id] for r in rows)
    cut = [r for r in rows if r.tokens_used < size[r.doc_id]]
    assert len(cut) <= 4  # at most one per source and language
    for r in mixing.mix_report(mixed, sized, targets, total).collect():
        assert r.actual_share == pytest.approx(r.target_share, abs=0.002)
        assert (r.repeats or 0) <= r.max_repeats + 1e-9 and r.short_tokens <= 4 and r.from_siblings == 0 and r.from_ancestors <= 4
    again = mixing.mix_sources(sized.repartition(7), targets, total).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert max(r.epoch for r in rows) >= 1


def test_shortages_of_a_mix_go_to_siblings_before_ancestors(spark):
    docs = [(i, "A 1", "eng", 10) for i in range(40)] + [(100 + i, "a-2", "eng", 10) for i in range(5)] + [(200 + i, "b", "eng", 10) for i in range(55)]
    sized = spark.createDataFrame([(d, s.lower().replace(" ", "_").replace("-", "_"), lang, n) for d, s, lang, n in docs], "doc_id bigint, source string, language string, n_tokens bigint")
    kind = "mix_name string, source string, target_share double, max_repeats int"
    domains = spark.createDataFrame([("a 1", "A"), ("A_2", "A"), ("a_3", "A"), ("b", "B"), (None, "C"), ("c", None)], "source string, domain string")
    # of 1000 tokens a_1 should have 250, a_2 150 (has 50), a_3 100 (has none), b 500
    targets = spark.createDataFrame([("m", "a 1", 0.25, 1), ("m", "a_2", 0.15, 1), ("m", "a_3", 0.1, 5), ("m", "b", 0.5, 2)], kind)
    mixed = mixing.mix_sources(sized, targets, domains=domains)
    assert {r.source: r.t for r in mixed.groupBy("source").agg(F.sum("tokens_used").alias("t")).collect()} == {"a_1": 400, "a_2": 50, "b": 550}
    got = {r.source: r for r in mixing.mix_report(mixed, sized, targets, domains=domains).collect()}
    assert [(got[s].wanted_tokens, got[s].tokens_used, got[s].short_tokens, got[s].from_siblings, got[s].from_ancestors) for s in ("a_1", "a_2", "a_3", "b")] == [
        (250, 400, 0, 150, 0), (150, 50, 100, 0, 0), (100, 0, 100, 0, 0), (500, 550, 0, 0, 50),
    ]
    # a source without documents in a domain of its own gives to all; in its domain to its siblings
    for tree, want in ((domains, {"a_1": 200, "b": 200}), (None, {"a_1": 150, "b": 250})):
        targets = spark.createDataFrame([("m", "a_1", 0.3, 2), ("m", "a_3", 0.2, 1), ("m", "b", 0.5, 2)], kind)
        mixed = mixing.mix_sources(sized, targets, total=400, domains=tree)
        assert {r.source: r.t for r in mixed.groupBy("source").agg(F.sum("tokens_used").alias("t")).collect()} == want


def test_mix_with_a_given_total_and_without_rows(spark):
    docs, sized, targets = mix_tables(spark)
    used = mixing.mix_sources(sized, targets, total=1000).agg(F.sum("tokens_used")).first()[0]
    assert 990 <= used <= 1000
    most = mixing.mix_sources(sized, targets, total=10**9).groupBy("source").agg(F.sum("tokens_used").alias("t")).collect()
    for r in most:
        assert r.t == sum(d[3] for d in docs if d[1] == r.source) * (3 if r.source == "rare" else 2)
    assert mixing.mix_sources(sized.limit(0), targets).count() == 0
    assert mixing.mix_sources(sized, targets.limit(0)).count() == 0


# p8


def test_automaton_against_brute_force():
    rng = random.Random(6)
    for _ in range(40):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 25))) for _ in range(4)]
        auto = SuffixAutomaton()
        for t in texts:
            auto.add(t)
        span = rng.randint(1, 6)
        seen: dict = {}
        for t in [*texts, "".join(rng.choice("abc") for _ in range(30))]:
            for i, state in enumerate(auto.windows(t, span)):
                window = t[i + 1 - span : i + 1] if i + 1 >= span else None
                known = window is not None and any(window in x for x in texts)
                assert (state >= 0) == known
                if known:
                    assert seen.setdefault(window, state) == state
        assert len(set(seen.values())) == len(seen)


def brute_shared(docs, span):
    where = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            where[t[i : i + span]].add(d)
    pairs = {(a, b) for own in where.values() for a in own for b in own if a < b}
    chars = {}
    for d, t in docs:
        mark = bytearray(len(t or ""))
        for i in range(len(t or "") - span + 1):
            if len(where[t[i : i + span]]) > 1:
                mark[i : i + span] = b"\1" * span
        chars[d] = sum(mark)
    return pairs, chars


def some_documents(seed, span):
    rng = random.Random(seed)
    alphabet = "abcdé\n "
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    common = [text(rng.randint(span - 3, 4 * span)) for _ in range(8)]
    docs = []
    for i in range(70):
        parts = [text(rng.randint(0, 3 * span))]
        for _ in range(rng.randint(0, 2)):
            c = rng.choice(common)
            a = rng.randint(0, len(c) // 2)
            parts += [c[a:], text(rng.randint(0, span))]
        docs.append((i, "".join(parts)))
    docs += [(100 + i, docs[i][1]) for i in range(6)] + [(200, None), (201, ""), (202, "a" * (5 * span)), (203, "b" + "a" * (3 * span)), (204, " " * span), (205, common[0] * 3)]
    return docs


@pytest.mark.parametrize("seed, block, reference", [(0, 1000, 200_000), (1, 1000, 0), (2, 3, 0), (3, 3, 700), (4, 1000, 3000)])
def test_shared_spans_against_brute_force(spark, monkeypatch, seed, block, reference):
    monkeypatch.setattr(shared, "REFERENCE_CHARS", reference)
    monkeypatch.setattr(shared, "SHARD_CHARS", 300)
    monkeypatch.setattr("sonoframe.plans.skew.HOT_ROWS", 4 if block == 3 else 1_000_000)
    monkeypatch.setattr(shared, "BLOCK_PIECES", block)
    monkeypatch.setattr(shared, "BLOCK_DOCUMENTS", block)
    monkeypatch.setattr(shared, "STRETCH", 150 if seed == 1 else 1 << 20)
    span = 24
    docs = some_documents(seed, span)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, class string, n int")
    found = shared.SharedSpans(df, span)
    pairs, chars = brute_shared(docs, span)
    assert {(r.doc_id_a, r.doc_id_b) for r in found.pairs().collect()} == pairs
    assert {r.doc_id: r.shared_chars for r in shared.shared_parts(found).collect()} == chars
    text = dict(docs)
    links = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in found.links().collect()}
    same = lambda d: [x for x, t in docs if t == text[d] and t is not None and len(t) >= span] or [d]
    assert links == {d: (min(same(d)), len(same(d)), sum(d in p for p in pairs)) for d, _ in docs}
    cleaned = {r.doc_id: (r.text, r.removed_chars) for r in shared.without_repeats(found).collect()}
    assert cleaned[200] == (None, 0) and cleaned[0][1] == 0 and cleaned[100][0] == ""
    assert set(cleaned) == {d for d, _ in docs}


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    found = shared.SharedSpans(df)
    assert found.pairs().count() == 0 and found.links().count() == 0 and shared.shared_parts(found).count() == 0 and shared.without_repeats(found).count() == 0


# all queries run


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("p5")))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, data, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, found = QUERIES[name](spark, data), con.sql(SQL[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    at = [found.columns.index(c) for c in columns]
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())


def test_language_queries_run(spark, data, small_training):
    whole = QUERIES["p5_segments"](spark, data).collect()
    found = QUERIES["p5_found"](spark, data).collect()
    assert whole and len({(r.transcription_id, r.seg_no) for r in whole}) == len(whole) and all(0 <= r.confidence <= 1 for r in whole)
    own = {(r.transcription_id, r.seg_no): r for r in whole}
    assert {(r.transcription_id, r.seg_no, r.language_code) for r in found} == {
        (*k, r.language_code) for k, r in own.items() if (r.label_code != r.language_code if k[1] == 0 else r.n_languages > 1)
    }


def test_deep_and_long_notes_are_not_spoken():
    parse = turns.line_grammar(turns.Speakers(CODES))
    for depth in (3, 61, 5000):
        assert parse("so " + "[a (b {c <d " * depth + "> } ) ] " * depth + "then")[2] == ["so", "then"]
    assert parse("so *" + "laughs loudly " * 20 + "x* then")[2] == ["so", "then"]
    assert parse("so *laughs then")[2] == ["so", "laughs", "then"]
    assert parse("[" * 20_000 + " so")[2] == ["so"]
    assert parse("[a (b] so [c] then")[2] == ["a", "b", "so", "then"]
