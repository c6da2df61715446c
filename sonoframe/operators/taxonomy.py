"""Trees of activities and the evaluations that belong to them; plain objects while a plan is built."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Evaluations of the root of each built-in tree (fixed values), metrics first.
ROOT_METRICS = (
    "proportion_clipped_metric",
    "proportion_silent_metric",
    "peak_snr_from_spectral_metric",
    "spectral_gating_snr_metric",
    "amplitude_modulation_depth_metric",
)
ROOT_CHECKS = (
    "high_proportion_clipped_check",
    "completely_silent_check",
    "very_low_peak_snr_from_spectral_check",
    "low_spectral_gating_snr_check",
    "very_low_amplitude_modulation_depth_check",
)

#: Activities of a voice assessment (fixed values): the children of each node.
VOICE_ACTIVITIES = {
    "human": [
        "breathing",
        "cough",
        "vocalization",
    ],
    "cough": [
        "audio_check_3",
        "respiration_and_cough_cough_1",
        "respiration_and_cough_cough_2",
        "voluntary_cough",
    ],
    "breathing": [
        "audio_check_4",
        "breath_sounds",
        "respiration_and_cough_breath_1",
        "respiration_and_cough_breath_2",
        "respiration_and_cough_five_breaths",
        "respiration_and_cough_three_quick_breaths",
    ],
    "respiration_and_cough_five_breaths": [
        "respiration_and_cough_five_breaths_1",
        "respiration_and_cough_five_breaths_2",
        "respiration_and_cough_five_breaths_3",
        "respiration_and_cough_five_breaths_4",
    ],
    "respiration_and_cough_three_quick_breaths": [
        "respiration_and_cough_three_quick_breaths_1",
        "respiration_and_cough_three_quick_breaths_2",
    ],
    "vocalization": [
        "speech",
        "non_speech",
    ],
    "speech": [
        "unscripted",
        "scripted",
    ],
    "unscripted": [
        "free_speech",
        "picture_description",
        "story_recall",
        "open_response",
        "productive_vocabulary",
        "animal_fluency",
        "random_item_generation",
    ],
    "productive_vocabulary": [
        "productive_vocabulary_1",
        "productive_vocabulary_2",
        "productive_vocabulary_3",
        "productive_vocabulary_4",
        "productive_vocabulary_5",
        "productive_vocabulary_6",
    ],
    "free_speech": [
        "free_speech_0",
        "free_speech_1",
        "free_speech_2",
        "free_speech_3",
    ],
    "scripted": [
        "passage_reading",
        "cape_v_sentences",
        "cinderella_story",
        "audio_check_1",
        "audio_check_2",
        "loudness",
        "diadochokinesis",
        "word_color_stroop",
    ],
    "passage_reading": [
        "caterpillar_passage",
        "rainbow_passage",
    ],
    "cape_v_sentences": [
        "cape_v_sentences_1",
        "cape_v_sentences_2",
        "cape_v_sentences_3",
        "cape_v_sentences_4",
        "cape_v_sentences_5",
        "cape_v_sentences_6",
    ],
    "diadochokinesis": [
        "diadochokinesis_ka",
        "diadochokinesis_pa",
        "diadochokinesis_ta",
        "diadochokinesis_pataka",
        "diadochokinesis_buttercup",
    ],
    "non_speech": [
        "phonation",
    ],
    "phonation": [
        "maximum_phonation_time",
        "prolonged_vowel",
        "glides",
    ],
    "maximum_phonation_time": [
        "maximum_phonation_time_1",
        "maximum_phonation_time_2",
        "maximum_phonation_time_3",
    ],
    "glides": [
        "glides_high_to_low",
        "glides_low_to_high",
    ],
}


@dataclass
class Taxonomy:
    """A node: its name, its own evaluations and its children by key."""

    name: str
    metrics: list[str] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    children: dict[str, Taxonomy] = field(default_factory=dict)
    parent: Taxonomy | None = field(default=None, repr=False, compare=False)

    def add(self, name: str, node: Taxonomy | None = None) -> Taxonomy:
        """Hangs ``node`` (a new one by default) under ``name``, instead of what was there."""
        node = node or Taxonomy(name)
        self.children[name] = node
        node.parent = self
        return node

    def walk(self, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Taxonomy]]:
        here = (*path, self.name)
        yield here, self
        for child in self.children.values():
            yield from child.walk(here)

    def path_to(self, name: str) -> list[str] | None:
        """Names from here to the first node of that name, depth first."""
        return next((list(path) for path, _ in self.walk() if path[-1] == name), None)

    def evaluations(self) -> list[str]:
        """Of this node and all below, metrics before checks in each, every one where it is met first."""
        return list(dict.fromkeys(e for _, node in self.walk() for e in (*node.metrics, *node.checks)))

    def pruned(self, name: str) -> Taxonomy | None:
        """Copies of the nodes from here to ``name`` alone; None without such a node."""
        if self.name == name:
            return Taxonomy(self.name, list(self.metrics), list(self.checks))
        for key, child in self.children.items():
            if below := child.pruned(name):
                copy = Taxonomy(self.name, list(self.metrics), list(self.checks))
                copy.add(key, below)
                return copy
        return None

    def evaluations_for(self, activity: str) -> list[str]:
        """The evaluations of the chain from the root to ``activity``; an unknown one raises."""
        chain = self.pruned(activity)
        if chain is None:
            raise ValueError(f"unknown activity {activity!r}")
        return chain.evaluations()

    def checks_for(self, activity: str) -> list[str]:
        return [e for e in self.evaluations_for(activity) if e.endswith("_check")]

    def table(self, spark: SparkSession) -> DataFrame:
        """node, parent, depth, ord, evaluations: the tree as rows."""
        rows = [(path[-1], path[-2] if len(path) > 1 else None, len(path) - 1, i, [*node.metrics, *node.checks]) for i, (path, node) in enumerate(self.walk())]
        return spark.createDataFrame(rows, "node string, parent string, depth int, ord int, evaluations array<string>")


def bioacoustic() -> Taxonomy:
    return Taxonomy("bioacoustic", list(ROOT_METRICS), list(ROOT_CHECKS))


def voice_assessment(root_name: str = "voice_assessment") -> Taxonomy:
    """The activities of a voice assessment; all inherit the evaluations of the root."""
    root = bioacoustic()
    root.name = root_name
    nodes = {"human": root.add("human")}
    for name, below in VOICE_ACTIVITIES.items():
        for child in below:
            nodes[child] = nodes[name].add(child)
    return root


def activity_evaluations(spark: SparkSession, tree: Taxonomy, activities: list[str]) -> DataFrame:
    """activity, ord, evaluation for each of ``activities``."""
    rows = [(a, i, e) for a in dict.fromkeys(activities) for i, e in enumerate(tree.evaluations_for(a))]
    return spark.createDataFrame(rows, "activity string, ord int, evaluation string")
