"""Schemas of the tables that operators take and give."""

from __future__ import annotations

#: One recording; ``channels`` holds one array of samples per channel, all of the same length.
CLIP = "clip_id string, path string, sampling_rate int, channels array<array<double>>, metadata map<string,string>"

#: One node of a script-line tree: the path of a node is its parent's path, a slash and its position (see operators.tree).
SCRIPT_LINE = "clip_id string, node_path string, level int, ord int, text string, speaker string, start_sec double, end_sec double"

#: One evaluation of one record, or of one of its windows (window_start null: of the whole record).
QC_LONG = "clip_id string, evaluation_name string, window_start double, window_end double, value double"

#: A vector of a record.
EMBEDDING = "clip_id string, model string, vector array<double>"

#: A node of an activity taxonomy and the evaluations that belong to it.
TAXONOMY = "node string, parent string, depth int, ord int, evaluations array<string>"
