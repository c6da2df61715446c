"""Operators that need a pretrained model.

Weights are not part of this library. One adapter runs an injected callable over Arrow batches; each operator is a
description of what goes in, what must hold of it, and what comes out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Kinds of models: of a hub, or of a library with names or files of its own.
MODEL_KINDS = ("hub", "speech", "diarization", "sentence", "synthesis", "torch", "torch_audio", "file")


@dataclass(frozen=True)
class ModelRef:
    """Which model: its kind, place or name, and revision; the key of the cache in each worker."""

    uri: str
    kind: str = "hub"
    revision: str = "main"

    def __post_init__(self) -> None:
        if self.kind not in MODEL_KINDS:
            raise ValueError(f"unknown kind of model {self.kind!r}")
        if not self.uri.strip():
            raise ValueError("a model needs a place or a name")
        if not self.revision.strip():
            raise ValueError("a model needs a revision")


@dataclass(frozen=True)
class Operator:
    """Columns that the callable gets and gives. Clips must be mono or of the given rate where it says so."""

    inputs: tuple[str, ...]
    outputs: str
    mono: bool = False
    rate: int | None = None


_LINES = "lines array<struct<text:string,speaker:string,start_sec:double,end_sec:double>>"
_RESULT = "result array<struct<score:double,label:string>>"
_CLIP = ("channels", "sampling_rate")
_AUDIO = "out_channels array<array<double>>, out_rate int"
_MARKS = "map<string,struct<x:double,y:double,z:double,visibility:double,confidence:double>>"

#: The operators by name.
OPERATORS = {
    "transcribe": Operator(_CLIP, _LINES, mono=True, rate=16_000),
    "transcribe_text_only": Operator(_CLIP, "text string", mono=True, rate=16_000),
    "diarize": Operator(_CLIP, _LINES, mono=True, rate=16_000),
    "voice_activity": Operator(_CLIP, _LINES, mono=True, rate=16_000),
    "classify": Operator(_CLIP, _RESULT, mono=True),
    "recognize_emotion": Operator(_CLIP, _RESULT, mono=True, rate=16_000),
    "speaker_embedding": Operator(_CLIP, "vector array<double>", mono=True, rate=16_000),
    "ssl_embedding": Operator(_CLIP, "layers array<array<array<double>>>", mono=True, rate=16_000),
    "text_embedding": Operator(("text",), "vector array<double>"),
    "text_embedding_layers": Operator(("text",), "layers array<array<array<double>>>"),
    "enhance": Operator(_CLIP, _AUDIO, mono=True, rate=16_000),
    "augment": Operator(_CLIP, _AUDIO),
    "synthesize": Operator(("text", "language"), _AUDIO),
    "clone_voice": Operator(("channels", "sampling_rate", "target_channels"), _AUDIO, mono=True),
    "objective_quality": Operator(_CLIP, "stoi double, pesq double, si_sdr double", mono=True, rate=16_000),
    "subjective_quality": Operator(("channels", "sampling_rate", "reference_channels"), "mos double", mono=True, rate=16_000),
    "functionals": Operator(_CLIP, "features map<string,double>"),
    "posteriorgram": Operator(_CLIP, "posteriorgram array<array<double>>", mono=True),
    "articulatory_features": Operator(_CLIP, "articulatory map<string,array<double>>", mono=True, rate=16_000),
    "articulatory_synthesis": Operator(("articulatory",), _AUDIO),
    "emissions": Operator(_CLIP, "emission array<array<double>>", mono=True, rate=16_000),
    "estimate_pose": Operator(("content",), f"individuals array<struct<individual_index:int,normalized_landmarks:{_MARKS},world_landmarks:{_MARKS}>>"),
    "demux_audio": Operator(("content",), _AUDIO),
    "decode_video": Operator(("content",), "frames array<binary>, frame_rate double"),
}

_loaded: dict[tuple, object] = {}


def apply_model(df: DataFrame, name: str, load: Callable[[ModelRef], Callable], model: ModelRef, batch: int | None = None) -> DataFrame:
    """``df`` with the output columns of operator ``name``.

    ``load`` makes the model from its reference, once per worker and reference; what it gives takes a pandas DataFrame
    of the input columns (at most ``batch`` rows) and returns one of the output columns, row by row in the same order;
    a different number of rows raises. Clips that break the operator's demands raise; df without rows gives none.
    """
    op = OPERATORS[name]
    rows = df
    if op.mono or op.rate:
        fine = F.lit(True)
        if op.mono:
            fine = fine & F.assert_true(F.size("channels") == 1, F.lit(f"{name} needs one channel")).isNull()
        if op.rate:
            fine = fine & F.assert_true(F.col("sampling_rate") == op.rate, F.lit(f"{name} needs {op.rate} Hz")).isNull()
        rows = rows.where(fine)
    given = [c.strip() for c in _names(op.outputs)]
    kept = [c for c in df.columns if c not in given]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c in kept), op.outputs])
    key = (name, model)

    def run(batches):
        import pandas as pd

        if key not in _loaded:
            _loaded[key] = load(model)
        call = _loaded[key]
        for part in batches:
            step = batch or max(len(part), 1)
            for a in range(0, len(part), step):
                own = part.iloc[a : a + step].reset_index(drop=True)
                made = call(own[list(op.inputs)])
                if len(made) != len(own):
                    raise ValueError(f"{name}: {len(made)} results for {len(own)} rows")
                yield pd.concat([own[kept], made[given].reset_index(drop=True)], axis=1)

    return rows.mapInPandas(run, schema)


def _names(schema: str) -> list[str]:
    """Column names of a DDL string with nested types."""
    names, depth, part = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            names.append(part.split()[0])
            part = ""
        else:
            part += c
    return names


def classify_windows(clips: DataFrame, load: Callable[[ModelRef], Callable], model: ModelRef, window_sec: float, hop_sec: float | None = None, top_k: int | None = None, batch: int = 32) -> DataFrame:
    """clip_id, window_start, window_end, win_length, hop_length, labels, scores of every window of the clips, best first,
    ``top_k`` of them if given (all where there are fewer). Windows of all clips go to the model in batches together; hops
    are half a window by default."""
    from sonoframe.operators import results

    rows = apply_model(results.classification_windows(clips, window_sec, hop_sec), "classify", load, model, batch)
    rows = rows.withColumn("result", results.result(results.labels(F.col("result")), results.scores(F.col("result"))))
    best = F.slice("result", 1, top_k) if top_k else F.col("result")
    return rows.select("clip_id", "window_start", "window_end", "win_length", "hop_length", results.labels(best).alias("labels"), results.scores(best).alias("scores"))


def enhance_in_pieces(clips: DataFrame, load: Callable[[ModelRef], Callable], model: ModelRef, seconds: float = 60.0, batch: int | None = None) -> DataFrame:
    """``clips`` with the channels that an enhancer gives: clips are cut into pieces of ``seconds``, enhanced piece by piece,
    and put together again in order. A clip without samples stays as it is. Results of another length or rate raise."""
    from sonoframe.operators import frames

    pieces = frames.even_segments(clips.select("clip_id", "sampling_rate", "channels"), seconds, pad_last=False)
    n = frames.n_samples(F.col("channels"))
    made = apply_model(pieces.where(n > 0), "enhance", load, model, batch)
    fine = F.assert_true((F.col("out_rate") == F.col("sampling_rate")) & (frames.n_samples(F.col("out_channels")) == n), F.lit("an enhancer keeps length and rate")).isNull()
    whole = made.where(fine).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", "out_channels"))).alias("_parts"))  # one clip is one row
    joined = F.array(F.flatten(F.transform("_parts", lambda p: F.get(p["out_channels"], F.lit(0)))))
    return clips.join(whole.select("clip_id", joined.alias("_whole")), "clip_id", "left").withColumn("channels", F.coalesce("_whole", "channels")).drop("_whole")


def paired(sources: DataFrame, targets: DataFrame, on: str = "pair_no") -> DataFrame:
    """``sources`` with target_channels and target_id, the clip of ``targets`` with the same ``on``; a source without a
    partner, or one with several, raises. For voice conversion and scores against a reference."""
    found = targets.groupBy(on).agg(F.count("*").alias("_n"), F.first("channels").alias("target_channels"), F.first("clip_id").alias("target_id"))
    rows = sources.join(found, on, "left")
    fine = F.assert_true(F.coalesce(F.col("_n"), F.lit(0)) == 1, F.lit("each source needs one target")).isNull()
    return rows.where(fine).drop("_n")


def require_transcripts(targets: DataFrame, column: str = "text") -> DataFrame:
    """``targets`` of which evaluating a row without a transcript raises."""
    fine = F.assert_true(F.coalesce(F.trim(column), F.lit("")) != "", F.lit("a target has no transcript")).isNull()
    return targets.where(fine)


def sanitized_lines(rows: DataFrame) -> DataFrame:
    """Lines of a recognizer with times made sound: starts below 0 are 0, ends before the start are the start."""
    start = lambda x: F.greatest(x["start_sec"], F.lit(0.0))
    fix = lambda x: x.withField("start_sec", F.when(x["start_sec"].isNotNull(), start(x))).withField("end_sec", F.when(x["end_sec"].isNotNull(), F.greatest(x["end_sec"], F.coalesce(start(x), F.lit(0.0)))))
    return rows.withColumn("lines", F.transform("lines", fix))


def parsed_diarization(rows: DataFrame, column: str = "raw") -> DataFrame:
    """lines of texts ``start end speaker``, sorted by start (null as 0)."""
    parts = F.transform(F.col(column), lambda s: F.split(F.trim(s), r"\s+"))
    made = F.transform(parts, lambda p: F.struct(F.lit(None).cast("string").alias("text"), F.get(p, F.lit(2)).alias("speaker"), F.get(p, F.lit(0)).try_cast("double").alias("start_sec"), F.get(p, F.lit(1)).try_cast("double").alias("end_sec")))
    order = F.array_sort(F.transform(made, lambda x: F.struct(F.coalesce(x["start_sec"], F.lit(0.0)).alias("k"), x.alias("x"))))
    return rows.withColumn("lines", F.transform(order, lambda o: o["x"]))


def as_voice(rows: DataFrame) -> DataFrame:
    """Diarization lines as voice activity."""
    return rows.withColumn("lines", F.transform("lines", lambda x: x.withField("speaker", F.lit("VOICE"))))


def energy_voice(clips: DataFrame, frame_sec: float = 0.025, threshold_db: float = -35.0) -> DataFrame:
    """clip_id, speaker, start_sec, end_sec: stretches of frames whose level is above the threshold against the
    loudest frame; a model-free stand-in for voice activity detection."""
    import pandas as pd

    def run(ch: pd.Series, hz: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for c, r in zip(ch, hz, strict=True):
            x = np.asarray(c[0], dtype="float64") if c is not None and len(c) else np.zeros(0)
            size = max(int(frame_sec * r), 1)
            n = len(x) // size
            if not n:
                out.append([])
                continue
            level = 10 * np.log10((x[: n * size].reshape(n, size) ** 2).mean(1) + 1e-12)
            loud = (level > level.max() + threshold_db) & (level > -100)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(int), [0]]))).reshape(-1, 2)
            out.append([{"start_sec": a * size / r, "end_sec": b * size / r} for a, b in edges])
        return pd.Series(out)

    run.__annotations__ = {"ch": pd.Series, "hz": pd.Series, "return": pd.Series}
    spans = F.pandas_udf(run, "array<struct<start_sec:double,end_sec:double>>")("channels", "sampling_rate")
    return clips.select("clip_id", F.explode(spans).alias("s")).select("clip_id", F.lit("VOICE").alias("speaker"), "s.start_sec", "s.end_sec")


def gain_and_noise(clips: DataFrame, gain_db: float = 0.0, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """A simple augmentation: all samples times a gain, plus uniform noise that follows from seed, clip and position."""
    factor = 10 ** (gain_db / 20)
    wave = lambda x, c, i: x * factor + (F.pmod(F.xxhash64(F.col("clip_id"), F.lit(seed), c, i), F.lit(1_000_003)) / 500_001.0 - 1.0) * noise
    return clips.withColumn("channels", F.transform("channels", lambda ch, c: F.transform(ch, lambda x, i: wave(x, c, i))))
