"""Raw transcript lines into clean, ordered speaker turns."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.peg import but, choice, many, maybe, nested, node, seq, term

#: Seconds of one time bucket of a clip, and line ids of one bucket of its lines without time; see :func:`speaker_turns`.
BUCKET_SEC, BUCKET_IDS = 600, 10_000

#: Hesitation sounds, each letter as often as one likes.
HESITATION = re.compile(r"(?:u+h+m*|u+m+|e+r+m*|h+m+|m{2,}|a+h+m*|e+h+)")

LINE_COLUMNS = "clip_id bigint, line_id bigint, at_sec double, until_sec double, speaker string, n_words int, utterance string"


def within_one_edit(a: str, b: str) -> bool:
    """Whether one letter inserted, left out or replaced, or two neighbours swapped, makes ``a`` out of ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    swapped = a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :] if i + 1 < len(a) else a
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or swapped == b[i:]


class Speakers:
    """Canonical speakers: a code of ``codes`` (code -> role name) and the label's number without leading zeros."""

    LABEL = re.compile(r"([^\W\d_]+)[\s_#.-]*(\d*)")

    def __init__(self, codes: dict[str, str]) -> None:
        self.exact = {k.lower(): c for c, role in codes.items() for k in (c, role or c)}
        self.roles = [(role.lower(), c) for c, role in codes.items() if role and len(role) > 4]
        self.known = lru_cache(100_000)(self._known)

    def _known(self, label: str) -> str | None:
        found = self.LABEL.fullmatch(label.strip())
        if not found:
            return None
        name, number = found[1].lower(), found[2]
        code = self.exact.get(name)
        if code is None and len(name) > 4:
            near = {c for role, c in self.roles if within_one_edit(name, role)}
            code = near.pop() if len(near) == 1 else None
        return None if code is None else code + (number.lstrip("0") or "0" if number else "")

    def of_field(self, field: str | None) -> str | None:
        """The speaker that a speaker field names, whatever marks surround it; null if none."""
        return None if field is None else self.known(re.sub(r"^\s*(?:>>|<v\s)?[\s*\[<(]*|[\s:\])>]*$", "", field))


def line_grammar(speakers: Speakers):
    """The grammar of one raw line.

        line       <- blank (mark arrow?)* label? item* end
        label      <- '<v' name '>' / '*' name ':' / '>>' name ':' / '[' name ']' / name ':'
        item       <- run / mark / word / note / token / blank / any
        run        <- (letters mark* blank)+, plain words at once
        mark       <- bullet / '[' clock ']' / '(' clock ')' / '<' seconds '>' / clock of three parts
        note       <- '[' inner* ']' / '(' inner* ')' / '{' inner* '}' / '<' inner* '>' / '*' words '*' / music / '&' token
        inner      <- note / not a bracket
        word       <- (plain / '(' letters ')')+ with a letter or digit beside the brackets
    """
    blank = term(r"\s*")
    name = node("speaker", term(r"[^\W\d_]+(?:[ \t_#.-]*\d+)?"), lambda s: speakers.known(s) is not None)
    colon = term(r"\s*:")
    label = choice(
        seq(term(r"<v\s+"), name, term(r"\s*>:?")),
        seq(term(r"\*\s*"), name, colon),
        seq(term(r">>\s*"), name, colon),
        seq(term(r"\[\s*"), name, term(r"\s*\]:?")),
        seq(name, colon),
    )
    clock = node("clock", term(r"(?:\d+:)?\d+:\d\d(?:[.,]\d+)?"))
    spelled = node("spelled", term(r"(?=\d)(?:\d+h)?(?:\d+m)?(?:\d+(?:\.\d+)?s)?(?=\s*[\])>])"))
    three = node("clock", term(r"\d+:\d\d:\d\d(?:[.,]\d+)?(?![\w:])"))
    arrow = seq(blank, term(r"-->"), maybe(seq(blank, three)))
    mark = choice(
        node("bullet", term(r"\x15?\s*\d+_\d+\s*\x15|\x15\s*\d+_\d+|\d{2,}_\d{2,}(?!\S)")),
        seq(term(r"\[\s*"), choice(clock, spelled), term(r"\s*\]")),
        seq(term(r"\(\s*"), choice(clock, spelled), term(r"\s*\)")),
        seq(term(r"<\s*"), choice(clock, spelled, node("seconds", term(r"\d+(?:\.\d+)?"))), term(r"\s*>")),
        seq(three, maybe(arrow)),
    )
    flat = choice(term(r"\*(?=\w)[^*\n]+\*"), term(r"♪[^♪]*♪|[♪♫]+"), term(r"&\S+"))
    note = choice(nested({"[": "]", "(": ")", "{": "}", "<": ">"}, choice(flat, term(r"[^\[\](){}<>*]+"))), flat)
    plain = r"[^\s\[\](){}<>♪\x15]"
    word = node("token", seq(
        but(term(r"[&*]")),
        term(rf"{plain}*\w\(\w+\)(?:{plain}|\(\w+\))*|\(\w+\)(?=\w)(?:{plain}|\(\w+\))+|{plain}+"),
    ))
    run = node("run", term(r"(?:[^\W\d_]+(?:['’-][^\W\d_]+)*[.,!?;]*(?:\s+|\Z))+"))  # what word gives one by one
    item = choice(run, term(r"\s+"), mark, word, note, term(r"."))
    line = seq(blank, many(seq(mark, maybe(arrow), blank)), maybe(label), many(item))

    def seconds(kind: str, text: str) -> float:
        if kind == "bullet":
            return int(re.search(r"\d+", text)[0]) / 1000
        if kind == "spelled":
            return sum(float(n) * {"h": 3600, "m": 60, "s": 1}[u] for n, u in re.findall(r"([\d.]+)([hms])", text))
        total = 0.0
        for part in text.replace(",", ".").split(":"):
            total = total * 60 + float(part)
        return total

    @lru_cache(100_000)
    def spoken(token: str) -> bool:
        core = re.sub(r"^\W+|[\W_]+$", "", token)
        return bool(core) and not HESITATION.fullmatch(core.lower())

    def parse(text: str | None) -> tuple[str | None, float | None, list[str]]:
        """The line's speaker, the seconds of its first time mark, and its words."""
        speaker, at, words = None, None, []
        for kind, start, end, _ in line(text.rstrip(), 0)[1] if text else ():
            part = text[start:end]
            if kind == "speaker":
                speaker = speakers.known(part)
            elif kind == "run":
                words += filter(spoken, part.split())
            elif kind == "token":
                if spoken(part):
                    words.append(part)
            elif at is None:
                at = seconds(kind, part)
        return speaker, at, words

    return parse


def clean_lines(lines: DataFrame, speaker_codes: DataFrame) -> DataFrame:
    """A row per raw line: when it begins, the speaker that it names itself (or null), its words.

    ``lines`` has clip_id, line_id, text, speaker, start_sec and end_sec; ``speaker_codes``, a dimension of a few
    rows, speaker_code and role_name. A label in the text goes before the speaker field. A null, empty or blank text
    has no words. Redelivered rows count once.
    """
    codes = {r.speaker_code: r.role_name for r in speaker_codes.select("speaker_code", "role_name").collect()}

    def batches(parts):
        import pandas as pd

        speakers = Speakers(codes)
        parse = line_grammar(speakers)
        for part in parts:
            parsed = [parse(t) for t in part["text"]]
            start = part["start_sec"]
            yield pd.DataFrame(
                {
                    "clip_id": part["clip_id"].astype("Int64"),
                    "line_id": part["line_id"].astype("Int64"),
                    "at_sec": start.where(start.notna(), pd.Series([p[1] for p in parsed], index=part.index, dtype="float64")),
                    "until_sec": part["end_sec"],
                    "speaker": [p[0] or speakers.of_field(f) for p, f in zip(parsed, part["speaker"], strict=True)],
                    "n_words": pd.Series([len(p[2]) for p in parsed], index=part.index, dtype="int32"),
                    "utterance": [" ".join(p[2]) for p in parsed],
                }
            )

    wanted = lines.select("clip_id", "line_id", "text", "speaker", "start_sec", "end_sec")
    clean = wanted.mapInPandas(batches, LINE_COLUMNS)
    return clean.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("at_sec", "until_sec")})


def speaker_turns(lines: DataFrame, speaker_codes: DataFrame) -> DataFrame:
    """clip_id, turn_no (from 1), speaker, first_line_id, last_line_id, n_words, start_sec, end_sec and text: the turns
    of each clip.

    Lines are ordered by begin; those that begin together by line_id; those without any time follow in order of
    line_id. A line that names no speaker has the one of the line before, wordless lines included; before the first
    label the speaker is null. Lines without words are then dropped, and a longest run of lines of one speaker is a
    turn.

    A clip may hold a third of all rows, so its lines are spread over buckets of BUCKET_SEC, those without time over
    buckets of BUCKET_IDS line ids; only one row per bucket (its last speaker, its number of turns) goes through a
    window over the whole clip. Times so far off that buckets can't be told apart share one.
    """
    timed = F.when(F.col("at_sec").isNotNull(), F.floor(F.least(F.greatest(F.col("at_sec") / BUCKET_SEC, F.lit(-2e18)), F.lit(2e18))).cast("bigint"))
    bucket = F.coalesce(timed, F.lit(2**62) + F.expr(f"line_id div {BUCKET_IDS}"), F.lit(2**62 - 10**15))
    rows = clean_lines(lines, speaker_codes).distinct().withColumn("_bucket", bucket)
    place = F.struct(F.col("at_sec").isNull().alias("n"), F.col("at_sec").alias("a"), F.col("line_id").alias("l"))
    rows = rows.withColumn("_place", place)
    keys = ["clip_id", "_bucket"]
    local = Window.partitionBy(*keys).orderBy("_place")
    across = Window.partitionBy("clip_id").orderBy("_bucket")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)

    named = rows.groupBy(*keys).agg(F.max_by("speaker", F.when(F.col("speaker").isNotNull(), F.col("_place"))).alias("_named"))
    named = named.select(*keys, F.last("_named", ignorenulls=True).over(earlier).alias("_carried"))
    filled = F.last("speaker", ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, 0))
    rows = _with(rows.withColumn("speaker", filled), named, keys)
    rows = rows.withColumn("speaker", F.coalesce("speaker", "_carried")).drop("_carried").where("n_words > 0")

    # a change of speaker within the bucket; the bucket's first line is held against the bucket before
    first = F.row_number().over(local) == 1
    change = F.when(first, F.lit(0)).otherwise((~F.lag("speaker").over(local).eqNullSafe(F.col("speaker"))).cast("int"))
    rows = rows.withColumn("_change", change)
    buckets = rows.groupBy(*keys).agg(
        F.min_by("speaker", "_place").alias("_first"), F.max_by("speaker", "_place").alias("_last"), F.sum("_change").alias("_changes")
    )
    opens = F.lag(F.lit(1)).over(across).isNull() | ~F.lag("_last").over(across).eqNullSafe(F.col("_first"))
    buckets = buckets.withColumn("_opens", opens.cast("int"))
    before = F.coalesce(F.sum(F.col("_changes") + F.col("_opens")).over(earlier), F.lit(0)) + F.col("_opens")
    rows = _with(rows, buckets.select(*keys, before.alias("_before")), keys)
    running = F.sum("_change").over(local.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("turn_no", (F.col("_before") + running).cast("int"))
    return rows.groupBy("clip_id", "turn_no").agg(
        F.max("speaker").alias("speaker"),
        F.min_by("line_id", "_place").alias("first_line_id"),
        F.max_by("line_id", "_place").alias("last_line_id"),
        F.sum("n_words").cast("int").alias("n_words"),
        F.min("at_sec").alias("start_sec"),
        F.max(F.greatest("until_sec", "at_sec")).alias("end_sec"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "utterance"))), lambda x: x["utterance"]), " ").alias("text"),
    )


def _with(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``right``'s columns beside ``left``'s rows, null keys matching."""
    right = right.select(*[F.col(c).alias(f"_r{c}") if c in on else F.col(c) for c in right.columns])
    condition = left[on[0]].eqNullSafe(right[f"_r{on[0]}"])
    for c in on[1:]:
        condition = condition & left[c].eqNullSafe(right[f"_r{c}"])
    return left.join(right, condition, "left").drop(*[f"_r{c}" for c in on])
