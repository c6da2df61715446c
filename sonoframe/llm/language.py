"""Languages of texts whose label is missing, wrong or one of several."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.llm.bytegru import PAD, ByteGru, encode

#: Labelled segments per language that the network is fitted on, at most, and characters of the stretch of each, which
#: begins anywhere in the text.
SAMPLE_SEGMENTS, SAMPLE_CHARS = 3000, 160

#: Labelled documents per language that are added to the sample, at most, where there are documents, and stretches of each.
SAMPLE_DOCUMENTS, DOCUMENT_PIECES = 500, 4

#: Training: steps before and after wrongly labelled samples are sorted out, sequences per step, bytes of each.
STEPS, BATCH, WIDTH = (350, 2000), 96, 48

#: Share of bytes that are hidden in training.
BLANKED = 0.08

#: Nats a character by which the network must prefer another language to hold a sample's label for wrong.
WRONG = 1.2

#: Bytes of a row when the network is applied.
ROW = 96

#: Nats a character, and nats at most, by which another language must beat the text's main one to count as a switch.
SWITCH, SWITCH_MOST = 1.5, 50.0

NOTES = re.compile(r"\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>|[\d♪_]+")


def plain(text: str) -> str:
    """The words of a text in lower case: no bracketed notes, digits or repeated blanks."""
    kept = NOTES.sub(" ", text).lower()
    return " ".join(kept.split()) if any(c.isalpha() for c in kept) else ""


def bare(text: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("ı", "i").replace("ł", "l").replace("ø", "o")


def label_code(label: Column, languages: DataFrame) -> Column:
    """The code that a label denotes (a code, a two-letter code or a name, in any case, with or without a region), or
    null. ``languages`` is a dimension of a few rows; its names become a literal map."""
    known: dict[str, str] = {}
    for r in languages.select("language_code", "alpha_2", "language_name").orderBy("language_code").collect():
        for name in (r.language_code, r.alpha_2, r.language_name):
            if name:
                known.setdefault(name.strip().lower(), r.language_code)
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    text = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    return F.coalesce(F.try_element_at(names, text), F.try_element_at(names, F.regexp_replace(text, r"[-_].*$", "")))


def _stretch(text: Column, *seed: Column) -> Column:
    """SAMPLE_CHARS characters of a text from a place that the hash of ``seed`` gives; a shorter text whole."""
    places = F.greatest(F.length(text) - SAMPLE_CHARS + 1, F.lit(1))
    return F.substring(text, (F.pmod(F.xxhash64(*seed), places) + 1).cast("int"), F.lit(SAMPLE_CHARS))


def sample_segments(transcriptions: DataFrame, code: Column, per_language: int = SAMPLE_SEGMENTS) -> list[tuple[object, str, str]]:
    """(transcription_id, text, code) of at most ``per_language`` segments of each label, whole transcriptions first
    by hash of their ids; the only rows that the driver sees. Of a long segment one stretch, from anywhere in it."""
    rows = transcriptions.select("transcription_id", code.alias("code"), F.posexplode("segments").alias("at", "s")).where("code IS NOT NULL AND s.text IS NOT NULL")
    rows = rows.select("transcription_id", "at", "code", _stretch(F.col("s.text"), F.col("transcription_id"), F.col("at")).alias("text")).where(F.length("text") > 0)
    order = Window.partitionBy("code").orderBy(F.xxhash64("transcription_id"), "transcription_id", "at", "text")
    return [(r.transcription_id, r.text, r.code) for r in rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).collect()]


def sample_documents(documents: DataFrame, code: Column, per_language: int = SAMPLE_DOCUMENTS) -> list[tuple[object, str, str]]:
    """(key, text, code) of DOCUMENT_PIECES stretches, from anywhere in the text, of at most ``per_language`` documents of
    each label, by hash of their ids."""
    order = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    pieces = F.array_distinct(F.array(*[_stretch(F.col("text"), F.col("doc_id"), F.lit(i)) for i in range(DOCUMENT_PIECES)]))
    rows = documents.select("doc_id", code.alias("code"), pieces.alias("pieces")).where("code IS NOT NULL AND text IS NOT NULL AND text <> ''")
    rows = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
    return [(f"document {r.doc_id}", t, r.code) for r in rows.orderBy("code", "k").collect() for t in r.pieces]


class LanguageModel:
    """The fitted network and its classes."""

    def __init__(self, net: ByteGru, codes: list[str]) -> None:
        self.net, self.codes = net, codes

    @classmethod
    def fit(cls, samples: list[tuple[object, str, str]], seed: int = 7) -> LanguageModel:
        """Fits to labelled texts some of whose labels are wrong: after the first steps, those transcriptions are left
        out whose segments taken together are in another language than labelled, and of the others the segments that are
        clearly in another one; hard ones stay."""
        import numpy as np

        codes = sorted({c for *_, c in samples}) or ["und"]
        pool = sorted({(str(k), plain(t), codes.index(c)) for k, t, c in samples})
        pool = [x for x in pool if x[1]]
        without = {x[1]: bare(x[1]) for x in pool}
        model = cls(ByteGru(len(codes), seed=seed), codes)
        rng = np.random.default_rng(seed)

        def batches(steps: int, pool: list[tuple[str, str, int]]):
            for _ in range(steps):
                texts, labels = [], []
                for i in rng.integers(len(pool), size=BATCH):
                    _, text, label = pool[i]
                    text = without[text] if rng.random() < 0.4 else text
                    raw = text.encode()
                    size = int(rng.integers(14, WIDTH + 1))
                    at = int(rng.integers(max(len(raw) - size, 0) + 1))
                    texts.append(raw[at : at + size].decode("utf-8", "ignore"))
                    labels.append(label)
                kept = [i for i, t in enumerate(texts) if t]
                rows, lengths, _ = encode([texts[i] for i in kept], WIDTH * 2)
                rows[rng.random(rows.shape) < BLANKED] = PAD  # no single byte may decide
                yield rows, lengths, np.array([labels[i] for i in kept])

        if pool:
            model.net.train(batches(STEPS[0], pool), steps=sum(STEPS))
            scores = model.scores([t for _, t, _ in pool])
            whole: dict[str, object] = {}
            for (key, _, _), row in zip(pool, scores, strict=True):
                whole[key] = whole.get(key, 0) + row
            clean = [
                (key, text, label)
                for (key, text, label), row in zip(pool, scores, strict=True)
                if int(whole[key].argmax()) == label and row.max() - row[label] < WRONG * len(text)
            ]
            model.net.train(batches(STEPS[1], clean or pool), rate=0.005, steps=STEPS[1])
        return model

    def table(self, spark: SparkSession) -> DataFrame:
        """The fitted model as a table of a few rows: name, shape, numbers; the classes' codes have names alone."""
        rows = [(f"code {i}", [c], None) for i, c in enumerate(self.codes)]
        rows += [(k, [str(n) for n in x.shape], [float(v) for v in x.ravel()]) for k, x in self.net.p.items()]
        return spark.createDataFrame(rows, "name string, shape array<string>, numbers array<float>")

    @classmethod
    def of_table(cls, table: DataFrame) -> LanguageModel:
        """What :meth:`table` gave."""
        import numpy as np

        rows = {r.name: r for r in table.collect()}
        codes = [rows[f"code {i}"].shape[0] for i in range(sum(n.startswith("code ") for n in rows))]
        net = ByteGru(1, hidden=1)
        net.p = {k: np.array(r.numbers, dtype=np.float32).reshape([int(n) for n in r.shape]) for k, r in rows.items() if r.numbers is not None}
        return cls(net, codes)

    def scores(self, texts: list[str]):
        """(texts, classes): the positions' log-probabilities, those of one text added up; no position counts less
        than one in twenty, so that no single one decides."""
        import numpy as np

        total = np.zeros((len(texts), len(self.codes)), dtype=np.float64)
        rows, lengths, owner = encode(texts, ROW)
        order = np.argsort(lengths, kind="stable")  # rows of like length together: little padding
        for a in range(0, len(order), 512):
            part = order[a : a + 512]
            width = int(lengths[part].max())
            logs = np.maximum(self.net.log_probabilities(rows[part, :width], lengths[part]), -3.0)
            logs *= (np.arange(width) < lengths[part][:, None])[:, :, None]
            np.add.at(total, owner[part], logs.sum(axis=1))
        return total


def decide(scores, sizes) -> tuple[int, list[int], list[float]]:
    """Of one text: its main class, each segment's class, and their confidences, the main one's first.

    ``scores`` are the segments' summed log-probabilities, ``sizes`` their characters; a segment of size 0 has no
    words and takes no part (class -1). A segment leaves the language that most characters are in only if another one
    beats it clearly.
    """
    import numpy as np

    share = np.zeros(scores.shape[1])
    best = scores.argmax(axis=1)
    np.add.at(share, best, sizes)
    main = int(share.argmax())
    langs, sure = [], []
    for s, b, n in zip(scores, best, sizes, strict=True):
        if not n:
            langs.append(-1)
            sure.append(0.0)
            continue
        own = int(b) if s[b] - s[main] > min(SWITCH * n, SWITCH_MOST) else main
        mean = s / max(n, 1)
        e = np.exp(mean - mean.max())
        langs.append(own)
        sure.append(float(e[own] / e.sum()))
    share[:] = 0
    for k, n in zip(langs, sizes, strict=True):
        if k >= 0:
            share[k] += n
    main = int(share.argmax())
    weight = sum(n for k, n in zip(langs, sizes, strict=True) if k == main)
    confidence = sum(c * n for k, c, n in zip(langs, sure, sizes, strict=True) if k == main) / weight if weight else 0.0
    return main, langs, [confidence, *sure]


def fit_language_model(transcriptions: DataFrame, languages: DataFrame, documents: DataFrame | None = None, per_language: int = SAMPLE_SEGMENTS) -> LanguageModel:
    """The network fitted on the driver to a bounded sample of labelled segments (``per_language`` of each label, one
    stretch of SAMPLE_CHARS of each) and, if there are any, of labelled ``documents`` (doc_id, text, lang;
    SAMPLE_DOCUMENTS of each label, DOCUMENT_PIECES stretches of each).

    The same sample gives the same network. Nothing is kept between calls: who needs the model twice passes it on, or keeps
    its :meth:`LanguageModel.table`.
    """
    samples = sample_segments(transcriptions, label_code(F.col("language_label"), languages), per_language)
    if documents is not None:
        samples += sample_documents(documents, label_code(F.col("lang"), languages))
    return LanguageModel.fit(samples)


def language_segments(transcriptions: DataFrame, languages: DataFrame, model: LanguageModel) -> DataFrame:
    """transcription_id, seg_no, language_code, confidence, label_code, n_languages.

    seg_no 0 is the whole transcription, with the language that most characters of its segments are in; the others are
    its segments that have words, counted from 1. Transcriptions whose segments are null, empty or without words give
    no rows. label_code is what language_label denotes (null: nothing), n_languages how many languages the segments
    are in. ``model`` (:func:`fit_language_model`) is applied to every byte of every text. A redelivered row counts once.
    """
    code = label_code(F.col("language_label"), languages)
    shared = transcriptions.sparkSession.sparkContext.broadcast((model.net.p, model.codes))

    def batches(parts):
        import numpy as np
        import pandas as pd

        params, codes = shared.value
        net = ByteGru(1, hidden=1)
        net.p = params
        model = LanguageModel(net, codes)
        columns = ["transcription_id", "seg_no", "language_code", "confidence", "label_code", "n_languages"]
        for part in parts:
            texts = [[plain(t) if t else "" for t in (() if x is None else x)] for x in part["texts"]]
            flat = model.scores([t for own in texts for t in own])
            rows, at = [], 0
            for key, label, own in zip(part["transcription_id"], part["label_code"], texts, strict=True):
                scores, at = flat[at : at + len(own)], at + len(own)
                sizes = np.array([len(t.encode()) for t in own], dtype=np.int64)
                chars = np.array([len(t) for t in own], dtype=np.int64)
                if not sizes.sum():
                    continue
                main, langs, sure = decide(scores, chars)
                n = len({k for k in langs if k >= 0})
                rows.append((key, 0, codes[main], sure[0], label, n))
                rows += [(key, i, codes[k], sure[i], label, n) for i, k in enumerate(langs, 1) if k >= 0]
            yield pd.DataFrame(rows, columns=columns).astype({"transcription_id": "Int64"})

    wanted = transcriptions.select("transcription_id", code.alias("label_code"), F.transform("segments", lambda s: s["text"]).alias("texts"))
    # the network is the work here, so rows are spread evenly and not by bytes of input
    spread = wanted.repartition(max(int(transcriptions.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "transcription_id")
    schema = "transcription_id bigint, seg_no int, language_code string, confidence double, label_code string, n_languages int"
    return spread.mapInPandas(batches, schema).dropDuplicates(["transcription_id", "seg_no"])


def corrected_languages(found: DataFrame) -> DataFrame:
    """The rows of :func:`language_segments` that tell something new: the whole transcription where its label is
    missing or denotes another language, and the segments where they are in more than one."""
    untrue = F.col("label_code").isNull() | (F.col("label_code") != F.col("language_code"))
    return found.where(F.when(F.col("seg_no") == 0, untrue).otherwise(F.col("n_languages") > 1))
