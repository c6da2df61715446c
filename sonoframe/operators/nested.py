"""Nested records into flat tables whose rows know their record, their place and their parent.

Every element gets a Dewey path: its parent's path, a slash and its ordinal in the parent's list (or its key in
the parent's map). The parent link is the path cut at its last slash; the rows of one kind (one schema path) form
one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_COLUMNS = "record_id bigint, kind string, node_path string, text string, speaker string, start_sec double, end_sec double, score double"

#: Schema: which fields of a record (kind ""), and of each kind of element, hold child elements, and of which kind. Kinds
#: may hold their own kind.
Schema = dict[str, dict[str, str]]
CHILD_FIELDS: Schema = {
    "": {"chunks": "chunk", "segments": "segment"},
    "chunk": {"chunks": "chunk"},
    "segment": {"words": "word"},
    "word": {},
}


def latest_delivery(df: DataFrame, key: str, payload: list[str], at: str = "ingested_at") -> DataFrame:
    """One row per ``key``: ``payload`` of the row with the latest ``at``.

    A null ``at`` is earlier than any other; among equal ones the row with the larger hash counts, so that
    repeated rows and ties give the same row on every run. A null key is a key like any other.
    """
    at_or_first = F.coalesce(df[at], F.lit("0001-01-01").cast("timestamp"))
    value = F.struct(*[df[c].alias(c) for c in payload])
    order = F.struct(at_or_first.alias("at"), F.xxhash64(F.to_json(value)).alias("tie"))
    return df.groupBy(df[key].alias(key)).agg(F.max_by(value, order).alias("_row")).select(key, "_row.*")


_SPACE = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


def read_deep(text: str) -> object:
    """A JSON value nested as deeply as memory allows; the reader of the standard library gives up at some depth."""
    at, root = 0, []
    stack: list[tuple[object, str]] = [(root, "value")]  # containers that are open and what each waits for

    def put(value: object) -> None:
        holder, key = stack[-1][0], keys[-1]
        if isinstance(holder, list):
            holder.append(value)
        else:
            holder[key] = value

    keys: list[str] = [""]
    while True:
        at = _SPACE.match(text, at).end()
        holder, wait = stack[-1]
        c = text[at : at + 1]
        if holder is root and root:
            if c:
                raise ValueError("something follows the value")
            return root[0]
        if wait == "more":  # after an element
            if c == ",":
                stack[-1] = (holder, "value" if isinstance(holder, list) else "key")
                at += 1
                continue
            wait = "end"
        if c == ("]" if isinstance(holder, list) else "}") and wait in ("end", "first") and holder is not root:
            at += 1
            stack.pop()
            keys.pop()
            stack[-1] = (stack[-1][0], "more")
        elif wait == "end" or not c:
            raise ValueError("a container is not closed")
        elif isinstance(holder, dict) and wait in ("first", "key"):
            if c != '"':
                raise ValueError("a name is missing")
            keys[-1], at = scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("a colon is missing")
            at += 1
            stack[-1] = (holder, "value")
        elif c in "[{":
            inner: object = [] if c == "[" else {}
            put(inner)
            stack.append((inner, "first"))
            keys.append("")
            at += 1
        else:
            if c == '"':
                value, at = scanstring(text, at + 1, True)
            elif found := _PLAIN.match(text, at):
                value, at = json.loads(found[0]), found.end()
            else:
                raise ValueError("no value")
            put(value)
            stack[-1] = (holder, "more")


def _decode(value: object) -> object:
    """What a text holds as JSON, however often it was written into a text again."""
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except RecursionError:
            value = read_deep(value)
    return value


def _elements(value: object) -> list:
    """A child list: a list, one lone object, or either of them written as JSON text; anything else is empty."""
    try:
        value = _decode(value)
    except ValueError:
        return []
    return value if isinstance(value, list) else [] if value is None else [value]


def _number(value: object) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _times(node: dict) -> tuple[float | None, float | None]:
    both = node.get("timestamps", node.get("timestamp"))
    if isinstance(both, list) and len(both) == 2:
        return _number(both[0]), _number(both[1])
    return _number(node.get("start")), _number(node.get("end"))


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def shred(payload: str | None, fields: Schema = CHILD_FIELDS) -> Iterator[tuple]:
    """(kind, node_path, text, speaker, start, end, score) of each element that ``fields`` names, in document order."""
    try:
        top = _decode(payload) if payload is not None else None
    except ValueError:
        return
    if isinstance(top, list) and len(top) == 1:
        top = top[0]
    if not isinstance(top, dict):
        return
    stack: list[tuple[str, str, object]] = [("", "", top)]
    while stack:  # no recursion: depth is bounded by memory only
        kind, path, node = stack.pop()
        if kind:
            if isinstance(node, dict):
                start, end = _times(node)
                yield kind, path, _text(node.get("text", node.get("word"))), _text(node.get("speaker")), start, end, _number(node.get("score"))
            else:
                yield kind, path, _text(node), None, None, None, None
        if isinstance(node, dict):
            for field, child in reversed(fields.get(kind, {}).items()):
                below = _elements(node.get(field))
                stack.extend((child, f"{path}/{i}", x) for i, x in reversed(list(enumerate(below))) if x is not None)


def _shred_batches(batches, fields: Schema):
    import pandas as pd

    names = [c.split()[0] for c in NODE_COLUMNS.split(", ")]
    for batch in batches:
        rows = []
        for record, payload in zip(batch["record_id"], batch["payload"], strict=True):
            rows += [(record, *node) for node in shred(payload, fields)]
            if len(rows) >= 50_000:  # a batch of deep records must not pile up
                yield pd.DataFrame(rows, columns=names).astype({"record_id": "Int64"})
                rows = []
        yield pd.DataFrame(rows, columns=names).astype({"record_id": "Int64"})


def _place(df: DataFrame) -> DataFrame:
    """With parent_path and the element's own place, both cut from node_path."""
    parent = F.regexp_replace("node_path", "/[^/]*$", "")
    return df.withColumn("parent_path", parent).withColumn("place", F.substring_index("node_path", "/", -1))


def record_nodes(records: DataFrame, fields: Schema = CHILD_FIELDS) -> DataFrame:
    """A row per nested element of the JSON payloads of ``records``: chunks (at any depth), segments and words, or what
    ``fields`` says.

    ``records`` has record_id, payload and ingested_at. Of a record delivered several times the latest counts. A
    payload that is null, blank, not JSON, or no object gives no rows; JSON within a JSON text is read; a null,
    missing or unreadable child list is empty, a lone object a list of one; null elements keep their place but
    give no row. An element that is no object gives a row without values.
    """
    latest = latest_delivery(records, "record_id", ["payload"])
    return _place(latest.mapInPandas(lambda parts: _shred_batches(parts, fields), NODE_COLUMNS))


def pose_nodes(images: DataFrame) -> DataFrame:
    """A row per individual and per normalized landmark of ``images`` (image_id, individuals, ingested_at).

    image_id becomes record_id. Null individuals and landmarks give no row; a null map or array is empty.
    """
    latest = latest_delivery(images, "image_id", ["individuals"])
    people = latest.select(F.col("image_id").alias("record_id"), F.posexplode("individuals").alias("_at", "_one")).where("_one IS NOT NULL")
    people = people.withColumn("_path", F.concat(F.lit("/"), F.col("_at").cast("string")))
    nothing = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("struct<x:double,y:double,z:double,visibility:double,confidence:double>").alias("value"))
    marks = F.coalesce(F.map_entries("_one.normalized_landmarks"), F.array())
    # the individual itself goes first, as an entry without a name, so that one pass gives both tables
    rows = people.select("record_id", "_path", F.col("_one.individual_index").alias("individual_index"), F.explode(F.concat(F.array(nothing), marks)).alias("_mark"))
    own = F.col("_mark.key").isNull()
    rows = rows.where(own | F.col("_mark.value").isNotNull())
    return _place(
        rows.select(
            "record_id",
            F.when(own, "individual").otherwise("landmark").alias("kind"),
            F.when(own, F.col("_path")).otherwise(F.concat("_path", F.lit("/"), F.col("_mark.key"))).alias("node_path"),
            "individual_index",
            *[F.col(f"_mark.value.{c}").alias(c) for c in ("x", "y", "z", "visibility", "confidence")],
        )
    )


def node_table(nodes: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """The table of one kind of node: record_id, node_path, parent_path, place and ``columns``."""
    return nodes.where(F.col("kind") == kind).select("record_id", "node_path", "parent_path", "place", *columns)


def all_nodes(records: DataFrame, images: DataFrame) -> DataFrame:
    """record_id, kind, node_path, parent_path of every nested element of both tables."""
    columns: list[Column | str] = ["record_id", "kind", "node_path", "parent_path"]
    return record_nodes(records).select(*columns).unionByName(pose_nodes(images).select(*columns))
