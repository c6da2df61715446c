"""Poses of persons in images: image_id, individuals (array of individual_index, normalized_landmarks, world_landmarks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a landmark by model (fixed values).
LANDMARK_FIELDS = {"mp": ("x", "y", "z", "visibility"), "yolo": ("x", "y", "confidence")}


def individual(individuals: Column, index: int) -> Column:
    """The person at ``index`` (from 0); an index outside raises."""
    fine = F.assert_true((F.lit(index) >= 0) & (F.size(individuals) > index), F.lit(f"no individual {index}")).isNull()
    return F.when(fine, F.get(individuals, F.lit(index)))


def landmark(person: Column, name: str, world: bool = False) -> Column:
    """A landmark's coordinates; an unknown name raises."""
    marks = person["world_landmarks" if world else "normalized_landmarks"]
    fine = F.assert_true(F.map_contains_key(marks, name), F.lit(f"no landmark {name}")).isNull()
    return F.when(fine, F.try_element_at(marks, F.lit(name)))


def as_list(mark: Column, model: str) -> Column:
    """x, y, z, visibility or x, y, confidence."""
    return F.array(*[mark[f] for f in LANDMARK_FIELDS[model]])


def confident(individuals: Column, least: float = 0.5) -> Column:
    """Per person the normalized landmarks whose confidence or visibility is above ``least``."""
    sure = lambda _, m: F.coalesce(m["confidence"], m["visibility"], F.lit(0.0)) > least
    return F.transform(individuals, lambda p: F.map_filter(p["normalized_landmarks"], sure))


def require_image_shape(images: DataFrame, height: str = "height", width: str = "width", depth: str = "depth") -> DataFrame:
    """Only images of height x width x 3; another one raises."""
    fine = F.assert_true((F.col(height) > 0) & (F.col(width) > 0) & (F.col(depth) == 3), F.lit("images have three color planes")).isNull()
    return images.where(fine)


def frames_table(videos: DataFrame) -> DataFrame:
    """video_id, frame_no, at_sec, frame: a row per frame of videos with frames and frame_rate."""
    rows = videos.select("video_id", "frame_rate", F.posexplode("frames").alias("frame_no", "frame"))
    return rows.select("video_id", "frame_no", F.try_divide("frame_no", "frame_rate").alias("at_sec"), "frame")
