"""Classification results: labels with scores, best first. A result is an array of (score, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.operators.frames import windows_in_seconds


def result(labels: Column, scores: Column) -> Column:
    """Sorted by score, largest first; equal scores keep their order. Arrays of different length raise."""
    fine = F.assert_true(F.size(labels) == F.size(scores), F.lit("as many labels as scores are needed")).isNull()
    rows = F.transform(F.arrays_zip(scores.alias("score"), labels.alias("label")), lambda x, i: F.struct((-x["score"]).alias("k"), i.alias("i"), x["score"].alias("score"), x["label"].alias("label")))
    return F.when(fine, F.transform(F.array_sort(rows), lambda x: F.struct(x["score"].alias("score"), x["label"].alias("label"))))


def labels(r: Column) -> Column:
    return F.transform(r, lambda x: x["label"])


def scores(r: Column) -> Column:
    return F.transform(r, lambda x: x["score"])


def pairs(r: Column) -> Column:
    return F.transform(r, lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score")))


def top(r: Column) -> Column:
    return F.get(r, F.lit(0))


def top_label(r: Column) -> Column:
    return top(r)["label"]


def top_score(r: Column) -> Column:
    return top(r)["score"]


def top_k(r: Column, k: int = 1) -> Column:
    """The first k; k outside 1 .. number of labels raises."""
    fine = F.assert_true((F.lit(k) >= 1) & (F.size(r) >= k), F.lit(f"there is no top {k}")).isNull()
    return F.when(fine, F.slice(r, 1, k))


def top_k_labels(r: Column, k: int = 1) -> Column:
    return labels(top_k(r, k))


def top_k_scores(r: Column, k: int = 1) -> Column:
    return scores(top_k(r, k))


def from_json_list(text: Column) -> Column:
    """A result of a JSON list of objects with label and score; one that lacks either raises."""
    rows = F.from_json(text, "array<struct<label:string,score:double>>")
    fine = F.assert_true(~F.exists(rows, lambda x: x["label"].isNull() | x["score"].isNull()), F.lit("label and score are needed")).isNull()
    return F.when(fine, result(labels(rows), scores(rows)))


def classification_windows(clips: DataFrame, window_sec: float, hop_sec: float | None = None) -> DataFrame:
    """Windows for a classifier: hop half a window by default, at least one sample each, ends no later than the clip."""
    rows = windows_in_seconds(clips, window_sec, hop_sec or window_sec / 2, at_least_one=True, clip_ends=True)
    return rows.withColumns({"win_length": F.lit(window_sec), "hop_length": F.lit(hop_sec or window_sec / 2)})


def scene_segments(windows: DataFrame) -> DataFrame:
    """clip_id, label, start_sec, end_sec of windows with labels: the first label, ``unknown`` without one."""
    return windows.select("clip_id", F.coalesce(F.get("labels", F.lit(0)), F.lit("unknown")).alias("label"), "start_sec", "end_sec")


def emotion_kind(names: Column) -> Column:
    """What kind of emotion recognizer has these labels (fixed values): valence, continuous, discrete or unknown."""
    words = ["happy", "happiness", "joy", "angry", "anger", "sad", "sadness", "fear", "disgust", "surprise"]
    has = lambda w: F.array_contains(names, w)
    return (
        F.when(has("positive") & has("negative") & has("neutral"), "valence")
        .when(F.arrays_overlap(names, F.array(*map(F.lit, ["valence", "arousal", "dominance"]))), "continuous")
        .when(F.arrays_overlap(names, F.array(*map(F.lit, words))), "discrete")
        .otherwise("not_recognized")
    )
