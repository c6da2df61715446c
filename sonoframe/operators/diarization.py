"""Metrics of who speaks when, and scores of one diarization against another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.functions.arrow import arrow_column, signals
from sonoframe.operators.intervals import usable_intervals

VOICE = "VOICE"

#: Milliseconds of a time bucket; a clip with a third of all lines is as many tasks as it has buckets.
BUCKET_MS = 60_000


def speaker_ratio(lines: DataFrame) -> DataFrame:
    """clip_id, primary_speaker_ratio_metric: the longest speaker's share of all speaking time (overlaps count twice).

    Lines with a null speaker or time are skipped; a clip without usable lines has no row; a clip whose lines have no
    length has NaN.
    """
    usable = lines.where("speaker IS NOT NULL AND start_sec IS NOT NULL AND end_sec IS NOT NULL")
    each = usable.groupBy("clip_id", "speaker").agg(F.sum(F.col("end_sec") - F.col("start_sec")).alias("d"))
    ratio = F.coalesce(F.try_divide(F.max("d"), F.sum("d")), F.lit(float("nan")))
    return each.groupBy("clip_id").agg(ratio.alias("primary_speaker_ratio_metric"))


def voice_lines(vad: DataFrame | None, diarization: DataFrame | None) -> DataFrame:
    """Voice activity of clips: that of ``vad`` where a clip has any, else its diarization relabelled as voice."""
    if vad is None:
        return diarization.withColumn("speaker", F.lit(VOICE))
    if diarization is None:
        return vad
    rest = diarization.join(vad.select("clip_id").distinct(), "clip_id", "left_anti").withColumn("speaker", F.lit(VOICE))
    return vad.select("clip_id", "speaker", "start_sec", "end_sec").unionByName(rest.select("clip_id", "speaker", "start_sec", "end_sec"))


def voice_seconds(lines: DataFrame) -> DataFrame:
    """clip_id, voice_activity_detection_metric: seconds of lines of speaker VOICE, overlaps counted twice."""
    length = F.when(F.col("speaker") == VOICE, F.col("end_sec") - F.col("start_sec"))
    return lines.groupBy("clip_id").agg(F.coalesce(F.sum(length), F.lit(0.0)).alias("voice_activity_detection_metric"))


def voice_snr(channels: Column, rate: Column, lines: Column) -> Column:
    """Power of the samples within VOICE intervals (ends included) over that of the gaps, in dB; NaN if either has no
    samples or the gaps no power. ``lines`` is an array of (speaker, start_sec, end_sec); the first channel counts."""
    def spans(n, r, start, end, closed):
        """How many of the spans from ``start`` to ``end`` (``closed``: included) each of ``n`` samples is in."""
        import numpy as np

        def first(sec, after):
            """The first sample from ``sec`` on, or ``after`` it: an estimate, set right by the samples' own times."""
            i = np.clip(np.ceil(np.minimum(sec, n / r) * r), 0, n).astype("int64")
            past = (lambda k: k / r > sec) if after else (lambda k: k / r >= sec)
            i = np.where((i > 0) & past(i - 1), i - 1, i)
            return np.where((i < n) & ~past(i), i + 1, i)

        a, b = first(start, False), first(end, closed)
        edges = np.bincount(a, minlength=n + 1) - np.bincount(np.maximum(a, b), minlength=n + 1)
        return np.cumsum(edges[:n])

    def run(ch, hz, rows):
        import numpy as np
        import pyarrow as pa

        out = []
        for w, r, own in zip(signals(ch), hz.to_pylist(), rows.to_pylist(), strict=True):
            usable = [x for x in own or () if x["start_sec"] is not None and x["end_sec"] is not None]
            if w is None or not w.shape[1] or not usable:
                out.append(float("nan"))
                continue
            power = w[0] ** 2
            start, end = (np.array([x[k] for x in usable], dtype="float64") for k in ("start_sec", "end_sec"))
            is_voice = np.array([x["speaker"] == VOICE for x in usable])
            reach = np.maximum.accumulate(np.concatenate([[0.0], end]))
            gap = start > reach[:-1]
            voice = spans(len(power), r, start[is_voice], end[is_voice], True)
            noise = spans(len(power), r, np.append(reach[:-1][gap], np.nextafter(reach[-1], np.inf)), np.append(start[gap], np.inf), False)
            (v, v_n), (n, n_n) = ((np.dot(x, power), x.sum()) for x in (voice, noise))
            with np.errstate(divide="ignore"):
                out.append(float(10 * np.log10((v / v_n) / (n / n_n))) if v_n and n_n and n > 0 else float("nan"))
        return pa.array(out, pa.float64())

    return arrow_column(run, "double", channels, rate, lines)


def speech_metrics(clips: DataFrame, lines: DataFrame, names: list[str]) -> DataFrame:
    """``clips`` with the named metrics of their lines; a clip without lines has NaN (0 voice seconds)."""
    df = clips
    nan = F.lit(float("nan"))
    if "primary_speaker_ratio_metric" in names:
        df = df.join(speaker_ratio(lines), "clip_id", "left").withColumn("primary_speaker_ratio_metric", F.coalesce("primary_speaker_ratio_metric", nan))
    if "voice_activity_detection_metric" in names:
        df = df.join(voice_seconds(lines), "clip_id", "left").withColumn("voice_activity_detection_metric", F.coalesce("voice_activity_detection_metric", F.lit(0.0)))
    if "voice_signal_to_noise_power_ratio_metric" in names:
        rows = F.array_sort(F.collect_list(F.struct("start_sec", "end_sec", "speaker")))  # the lines of one clip
        df = df.join(lines.groupBy("clip_id").agg(rows.alias("_lines")), "clip_id", "left")
        df = df.withColumn("voice_signal_to_noise_power_ratio_metric", voice_snr(F.col("channels"), F.col("sampling_rate"), F.col("_lines"))).drop("_lines")
    return df


def silence_gaps(lines: DataFrame) -> DataFrame:
    """clip_id, gap_start, gap_end: the time before each line that no earlier line of the clip reaches. Within a bucket
    of time earlier lines are looked at; of the buckets before only the latest end goes through a window."""
    usable = lines.where("start_sec IS NOT NULL AND end_sec IS NOT NULL").select("clip_id", "start_sec", "end_sec")
    usable = usable.withColumn("_bucket", F.floor(F.col("start_sec") * 1000 / BUCKET_MS).cast("bigint"))
    across = Window.partitionBy("clip_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = usable.groupBy("clip_id", "_bucket").agg(F.max("end_sec").alias("_end"))
    ends = ends.select("clip_id", "_bucket", F.greatest(F.coalesce(F.max("_end").over(across), F.lit(0.0)), F.lit(0.0)).alias("_reach"))
    order = Window.partitionBy("clip_id", "_bucket").orderBy("start_sec", "end_sec").rowsBetween(Window.unboundedPreceding, -1)
    rows = usable.join(ends, ["clip_id", "_bucket"]).withColumn("gap_start", F.greatest("_reach", F.max("end_sec").over(order)))
    return rows.select("clip_id", "gap_start", F.col("start_sec").alias("gap_end")).where("gap_end > gap_start")


# diarization error rate


def boundaries(lines: DataFrame) -> DataFrame:
    """clip_id, speaker, from_ms, to_ms: when the lines of each speaker begin and end, to the millisecond. Lines with a
    null, and lines that do not end after they start, are left out."""
    return usable_intervals(lines.where("clip_id IS NOT NULL AND speaker IS NOT NULL"), [F.col("clip_id"), F.col("speaker")])


#: Rows that a bucket's stretches and pairs of speakers would make, from which they are multiplied out as matrices.
MATRIX_ROWS = 2000

#: Stretches of a bucket in a block of such a matrix.
WORD = 62

#: Rows of whole buckets that are worked on at once.
CHUNK_ROWS = 50_000

#: Sums that are held, or given on at once, before those of the same pair are added up.
HELD_ROWS = 500_000

#: What the milliseconds of a row of :func:`_together` are.
PAIR, FALSE_ALARM, MISSED, BOTH, TOTAL = range(5)


def speaking_together(reference: DataFrame, hypothesis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of both sides (:func:`boundaries`) by buckets of time, and what goes from one bucket of a clip to its
    next: clip_id, _bucket, side, speaker, at, till, n.

    A line that ends in the bucket where it begins, or in the one after it, is a row in each, with its times there. One
    that goes further is a row where it begins and one where it ends, whose other time is null. Times count from the start
    of the bucket. The second table has the ``n`` such lines of a speaker that go on when a bucket begins to have lines,
    and, with side 2, when the bucket after it does; it is empty, and costs no more than the one look at all times that
    this function takes for it, if no line goes further. Only buckets in which something happens exist.
    """
    both = reference.withColumn("side", F.lit(0)).unionByName(hypothesis.withColumn("side", F.lit(1)))
    first, last = F.expr(f"from_ms div {BUCKET_MS}"), F.expr(f"(to_ms - 1) div {BUCKET_MS}")
    none, length = F.lit(None).cast("bigint"), BUCKET_MS
    part = lambda bucket, at, till: F.struct(bucket.alias("_bucket"), at.alias("at"), till.alias("till"))
    at, till, zero, border = F.col("from_ms") - first * length, F.col("to_ms") - last * length, F.lit(0).cast("bigint"), F.lit(length).cast("bigint")
    parts = F.when(first == last, F.array(part(first, at, till)))
    parts = parts.when(last - first == 1, F.array(part(first, at, border), part(last, zero, till))).otherwise(F.array(part(first, at, none), part(last, none, till)))
    rows = both.select("clip_id", "side", "speaker", F.explode(parts).alias("_p")).select("clip_id", "_p._bucket", "side", "speaker", "_p.at", "_p.till", F.lit(1).cast("bigint").alias("n"))
    if (both.agg(F.max(last - first)).first()[0] or 0) < 2:
        return rows, rows.where("false")
    begins = rows.groupBy("clip_id", "_bucket").agg(F.min(F.least("at", "till")).alias("at"))
    begins = begins.select("clip_id", "_bucket", F.lit(-1).alias("side"), F.lit(None).cast("string").alias("speaker"), "at", none.alias("till"), F.lit(0).cast("bigint").alias("n"))
    going = rows.where("at IS NULL OR till IS NULL").groupBy("clip_id", "_bucket", "side", "speaker").agg(F.sum(F.when(F.col("till").isNull(), 1).otherwise(-1)).alias("n"))
    going = going.where("n <> 0").select("clip_id", "_bucket", "side", "speaker", none.alias("at"), none.alias("till"), "n")
    kinds = dict(rows.dtypes)

    def carry(batches):
        """Bucket by bucket of a clip: who goes on speaking."""
        import pyarrow as pa

        clip, bucket, opened = None, None, {}
        for batch in batches:
            out: list[tuple] = []
            for c, b, side, speaker, at, n in zip(*(batch.column(k).to_pylist() for k in ("clip_id", "_bucket", "side", "speaker", "at", "n")), strict=True):
                if side < 0:  # a bucket's first row
                    if c != clip:
                        clip, opened = c, {}
                    if opened:
                        out.append((c, bucket, 2, None, at + (b - bucket) * length, None, 0))
                        out += [(c, b, *who, at, None, k) for who, k in opened.items()]
                    bucket = b
                else:
                    k = opened.get((side, speaker), 0) + n
                    opened[side, speaker] = k
                    if not k:
                        del opened[side, speaker]
            fields = zip(*out, strict=True) if out else [[]] * 7
            kind = [batch.schema.field("clip_id").type, pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(fields, kind, strict=True)], names=["clip_id", "_bucket", "side", "speaker", "at", "till", "n"])

    steps = begins.unionByName(going).repartition("clip_id").sortWithinPartitions("clip_id", "_bucket", "side")
    carried = steps.mapInArrow(carry, f"clip_id {kinds['clip_id']}, _bucket bigint, side int, speaker string, at bigint, till bigint, n bigint")
    return rows, carried


def _whole(batches, keys: list[str], size: int):
    """Sorted batches as tables of about ``size`` rows, each of which holds all rows of its ``keys``."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < size:
            continue
        codes = [batch.column(k).dictionary_encode().indices.to_numpy() for k in keys]
        cuts = sum(c[1:] != c[:-1] for c in codes).nonzero()[0]
        if len(cuts):  # the last ones may go on
            at = int(cuts[-1]) + 1
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, at)])
            held, n = [batch.slice(at)], batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def _together(rows: DataFrame, carried: DataFrame, pairs: bool = True) -> DataFrame:
    """clip_id, kind, r, h, ms of what :func:`speaking_together` gave, a row per clip, kind and pair of speakers: PAIR, how
    long r and h speak at the same time (if ``pairs``); and, without speakers, FALSE_ALARM, MISSED, BOTH and TOTAL, the
    milliseconds of speech heard too much, too little, on both sides and in the reference.

    Buckets are independent of each other: lines become stretches of time in which the same speakers speak, and many
    speakers at the same time are multiplied out as matrices, so that they make no rows of their own."""
    kind, word, most, chunk, held = dict(rows.dtypes)["clip_id"], WORD, MATRIX_ROWS, CHUNK_ROWS, HELD_ROWS

    def found(batches):
        import numpy as np
        import pyarrow as pa

        def sums(*keys):
            """The different rows of ``keys``, and where each row is among them."""
            order = np.lexsort(keys[::-1])
            new = np.zeros(len(order), dtype=bool)
            for k in keys:
                new[1:] |= k[order][1:] != k[order][:-1]
            new[:1] = True
            where = np.empty(len(order), dtype="int64")
            where[order] = np.cumsum(new) - 1
            return [k[order[new]] for k in keys], where

        def running(values, new):
            """Running sums that begin anew where ``new`` is."""
            total = np.cumsum(values)
            start = np.flatnonzero(new)
            return total - np.repeat((total - values)[start], np.diff([*start, len(values)]))

        for table in _whole(batches, ["clip_id", "_bucket"], chunk):
            table = table.combine_chunks()
            encoded = [table.column(c).combine_chunks().dictionary_encode() for c in ("clip_id", "speaker")]
            clips, speakers = (x.dictionary for x in encoded)
            clip, speaker = (x.indices.fill_null(0).to_numpy().astype("int64") for x in encoded)
            bucket, side, n = (table.column(c).to_numpy() for c in ("_bucket", "side", "n"))
            new = np.ones(len(clip), dtype=bool)
            new[1:] = (clip[1:] != clip[:-1]) | (bucket[1:] != bucket[:-1])
            group = np.cumsum(new) - 1  # a bucket of a clip
            clip_of = clip[new]
            times = [table.column(c).combine_chunks() for c in ("at", "till")]
            there = [np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False)) for x in times]
            own = np.concatenate(there)
            at = np.concatenate([x.drop_null().to_numpy() for x in times])
            step = np.concatenate([n[there[0]], -n[there[1]]])
            # of each speaker: lines at a moment together, then where they begin and stop to speak
            (g, d, s, t), where = sums(group[own], side[own].astype("int64"), speaker[own], at)
            step = np.bincount(where, weights=step, minlength=len(g)).astype("int64")
            first = np.ones(len(g), dtype=bool)
            first[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1])
            count = running(step, first)
            turn = (count > 0).astype("int64") - (count - step > 0)
            keep = np.flatnonzero((turn != 0) | (d == 2))
            g, d, s, t, turn = g[keep], d[keep], s[keep], t[keep], turn[keep]
            # the stretches of a bucket, one after the other
            (sg, st), place = sums(g, t)
            change = [np.bincount(place, weights=turn * (d == k), minlength=len(sg)).astype("int64") for k in (0, 1)]
            first = np.ones(len(sg), dtype=bool)
            first[1:] = sg[1:] != sg[:-1]
            nr, nh = (running(x, first) for x in change)
            ms = np.zeros(len(sg), dtype="int64")
            ms[:-1] = np.where(first[1:], 0, st[1:] - st[:-1])
            names = len(speakers) + 1
            made: list[tuple] = []  # keys, milliseconds

            def key(i, k, r, h):
                return ((i * 5 + k) * names + r + 1) * names + h + 1  # noqa: B023

            def added(parts):
                """The different keys in their order, and the sum of each."""
                keys, ms = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(keys)
                keys = keys[order]
                new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                return keys[new], np.add.reduceat(ms[order], new)

            for k, x in ((FALSE_ALARM, np.maximum(nh - nr, 0)), (MISSED, np.maximum(nr - nh, 0)), (BOTH, np.minimum(nr, nh)), (TOTAL, nr)):
                total = np.zeros(len(clips), dtype="int64")
                np.add.at(total, clip_of[sg], x * ms)
                i = np.unique(clip_of[sg])
                made.append((key(i, k, -1, -1), total[i]))
            if pairs and len(g):
                # periods of speakers as stretches from..to; a period open at the end goes to the last one of the bucket
                order = np.lexsort((t, s, d, g))
                order = order[d[order] < 2]
                last = np.flatnonzero(np.append(first[1:], True))[sg_of(sg, g[order])]
                p, begin = place[order], turn[order] > 0
                follows = np.append((turn[order][1:] < 0) & begin[:-1], False)
                end = np.where(follows, np.append(p[1:], 0), last)[begin]
                pg, pd, ps, start = g[order][begin], d[order][begin], s[order][begin], p[begin]
                cost = np.bincount(sg, weights=np.maximum(nr, 1) * np.maximum(nh, 1), minlength=len(clip_of))
                i, r, h, x = few(np, pg, pd, ps, start, end, ms, cost[pg] <= most, clip_of)
                made.append((key(i, PAIR, r, h), x))
                many = np.flatnonzero(cost > most)
                edges = np.searchsorted(pg, many, "left"), np.searchsorted(pg, many, "right")
                limit = held
                for k, a, b in zip(many, *edges, strict=True):
                    r, h, x = matrix(np, pd[a:b], ps[a:b], start[a:b], end[a:b], ms)
                    made.append((key(clip_of[k], PAIR, r, h), x))
                    if sum(len(x) for x, _ in made) > limit:  # a clip's pairs come again in each of its buckets
                        made = [added(made)]
                        limit = max(held, 2 * len(made[0][0]))
            keys, total = added(made)
            name = lambda x: speakers.take(pa.array(np.maximum(x, 0), mask=x < 0))
            for a in range(0, len(keys), held):
                x, t = keys[a : a + held], total[a : a + held]
                x, h = np.divmod(x, names)
                x, r = np.divmod(x, names)
                i, k = np.divmod(x, 5)
                yield pa.RecordBatch.from_arrays([clips.take(pa.array(i)), pa.array(k.astype("int32")), name(r - 1), name(h - 1), pa.array(t)], names=["clip_id", "kind", "r", "h", "ms"])

    def sg_of(sg, g):
        """Which of the different buckets in ``sg`` each of ``g`` is."""
        import numpy as np

        return np.searchsorted(np.unique(sg), g)

    def few(np, pg, pd, ps, start, end, ms, own, clip_of):
        """A row for each speaker and stretch of either side that is met by one of the other side."""
        sides = []
        for k in (0, 1):
            at = np.flatnonzero(own & (pd == k))
            size = end[at] - start[at]
            stretch = np.repeat(start[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
            order = np.argsort(stretch, kind="stable")
            sides.append((stretch[order], np.repeat(ps[at], size)[order], np.repeat(pg[at], size)[order]))
        (x, r, group), (y, h, _) = sides
        a = np.searchsorted(y, x)
        size = np.searchsorted(y, x, "right") - a
        row = np.repeat(np.arange(len(x)), size)
        j = np.arange(size.sum()) + np.repeat(a - np.cumsum(size) + size, size)
        return clip_of[group[row]], r[row], h[j], ms[x[row]]

    def matrix(np, pd, ps, start, end, ms):
        """The same by products of matrices of stretches and speakers, a block of stretches at a time."""
        names, total = [np.unique(ps[pd == k]) for k in (0, 1)], 0.0
        column = [np.searchsorted(names[k], ps[pd == k]) for k in (0, 1)]
        for a in range(start.min(), end.max(), word):
            b = min(a + word, end.max())
            speak = []
            for k in (0, 1):
                steps = np.zeros((b - a + 1, len(names[k])))
                inside = (start[pd == k] < b) & (end[pd == k] > a)
                np.add.at(steps, (np.maximum(start[pd == k][inside], a) - a, column[k][inside]), 1)
                np.add.at(steps, (np.minimum(end[pd == k][inside], b) - a, column[k][inside]), -1)
                speak.append(np.cumsum(steps[:-1], axis=0))
            total = total + (speak[0] * ms[a:b, None]).T @ speak[1]
        i, j = np.nonzero(total)
        return names[0][i], names[1][j], total[i, j].astype("int64")

    together = rows.unionByName(carried).repartition("clip_id", "_bucket").sortWithinPartitions("clip_id", "_bucket")
    parts = together.mapInArrow(found, f"clip_id {kind}, kind int, r string, h string, ms bigint")
    return parts.groupBy("clip_id", "kind", "r", "h").agg(F.sum("ms").alias("ms"))


def common_time(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """clip_id, r, h, ms: how long each pair of speakers of a clip speaks at the same time; of what
    :func:`speaking_together` gave."""
    return _together(rows, carried).where(f"kind = {PAIR}").select("clip_id", "r", "h", "ms")


def _assignment(overlap, names_r: Sequence, names_h: Sequence, greedy: bool) -> dict:
    """Hypothesis speaker -> reference speaker with the largest overlap in sum (or taken greedily, largest first)."""
    import numpy as np

    if greedy:
        rows, columns = np.nonzero(overlap > 0)
        order = np.lexsort((rows, columns, -overlap[rows, columns]))
        got: dict[int, int] = {}
        taken: set[int] = set()
        for i, j in zip(rows[order].tolist(), columns[order].tolist(), strict=True):
            if j not in got and i not in taken:
                got[j] = i
                taken.add(i)
        return {names_h[j]: names_r[i] for j, i in got.items()}
    n = max(len(names_r), len(names_h))
    cost = np.zeros((n, n))
    cost[: len(names_r), : len(names_h)] = -overlap
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    way = np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):  # shortest augmenting paths with potentials
        match[0], j0 = i, 0
        low, used = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = reduced < low[free]
            low[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return {names_h[j - 1]: names_r[match[j] - 1] for j in range(1, n + 1) if j <= len(names_h) and match[j] <= len(names_r) and overlap[match[j] - 1, j - 1] > 0}


def _mapped(clip, r, h, overlap, clips: int, greedy: bool):
    """Which of the pairs, sorted by clip, the mappings of the ``clips`` take.

    Where each hypothesis speaker of a clip has one reference speaker with whom it speaks longest, and no two have the
    same (or so the other way round), that is the only best mapping, and the greedy one. The other clips are assigned.
    """
    import numpy as np

    at_r, at_h = clip * (r.max(initial=0) + 1) + r, clip * (h.max(initial=0) + 1) + h

    def longest(key, other):
        """The pair of most time of each key; for which clips they are the mapping."""
        order = np.lexsort((overlap, key))
        k, v = key[order], overlap[order]
        last = np.flatnonzero(np.append(k[1:] != k[:-1], True)) if len(k) else np.zeros(0, dtype="int64")
        top, sure = order[last], np.ones(clips, dtype=bool)
        tie = (last > 0) & (k[last - 1] == k[last]) & (v[last - 1] == v[last])
        _, where, n = np.unique(other[top], return_inverse=True, return_counts=True)
        sure[clip[top[tie | (n[where] > 1)]]] = False
        return top, sure

    by_h, sure = longest(at_h, at_r)
    by_r, too = longest(at_r, at_h)
    taken = [by_h[sure[clip[by_h]]], by_r[(too & ~sure)[clip[by_r]]]]
    for c in np.flatnonzero(~(sure | too)):
        a, b = np.searchsorted(clip, [c, c + 1])
        own_r, i = np.unique(r[a:b], return_inverse=True)
        own_h, j = np.unique(h[a:b], return_inverse=True)
        time, pair = np.zeros((len(own_r), len(own_h))), np.zeros((len(own_r), len(own_h)), dtype="int64")
        time[i, j], pair[i, j] = overlap[a:b], np.arange(a, b)
        got = _assignment(time, range(len(own_r)), range(len(own_h)), greedy)
        taken.append(pair[list(got.values()), list(got)])
    return np.concatenate(taken)


def error_parts(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """clip_id, false_alarm, missed, total of :func:`error_rate`, which need no mapping, so no pairs are made."""
    sums = _together(*speaking_together(boundaries(reference), boundaries(hypothesis)), pairs=False)
    return sums.groupBy("clip_id").agg(_seconds(FALSE_ALARM).alias("false_alarm"), _seconds(MISSED).alias("missed"), _seconds(TOTAL).alias("total"))


def _seconds(kind: int) -> Column:
    return F.sum(F.when(F.col("kind") == kind, F.col("ms"))) / 1000


def error_rate(reference: DataFrame, hypothesis: DataFrame, greedy: bool = False) -> DataFrame:
    """clip_id, false_alarm, missed, confusion, total, error_rate and mapping (hypothesis -> reference speaker).

    Overlapping speech counts, there is no collar, times are to the millisecond. The mapping maximizes the common time,
    or is greedy; it is null if none speak together. error_rate is null without reference speech. Only the common time of
    a clip's pairs of speakers goes into the mapping, which one task holds. As the mapping is one to one, what is right is
    the common time of mapped pairs.
    """
    sums = _together(*speaking_together(boundaries(reference), boundaries(hypothesis)))
    kind, chunk = dict(sums.dtypes)["clip_id"], CHUNK_ROWS

    def maps(batches):
        """The sums of each clip by kind, and its mapping: rows stay Arrow's, whatever the number of pairs."""
        import numpy as np
        import pyarrow as pa

        for table in _whole(batches, ["clip_id"], chunk):
            table = table.combine_chunks()
            encoded = table.column("clip_id").combine_chunks().dictionary_encode()
            clip, clips = encoded.indices.to_numpy().astype("int64"), encoded.dictionary
            of, ms = table.column("kind").to_numpy(), table.column("ms").to_numpy()
            sums = np.zeros((5, len(clips)), dtype="int64")
            for k in (FALSE_ALARM, MISSED, BOTH, TOTAL):
                np.add.at(sums[k], clip[of == k], ms[of == k])
            own = np.flatnonzero(of == PAIR)
            c, overlap, codes, names = clip[own], ms[own], [], []
            for side in ("r", "h"):
                x = table.column(side).combine_chunks().take(pa.array(own)).dictionary_encode()
                order = np.array(sorted(range(len(x.dictionary)), key=x.dictionary.to_pylist().__getitem__), dtype="int64")
                codes.append(np.argsort(order)[x.indices.to_numpy()])
                names.append(x.dictionary.take(pa.array(order)))
            taken = _mapped(c, codes[0], codes[1], overlap, len(clips), greedy)
            taken = taken[np.lexsort((codes[1][taken], c[taken]))]
            right = np.zeros(len(clips), dtype="int64")
            np.add.at(right, c[taken], overlap[taken])
            offsets = np.append(0, np.cumsum(np.bincount(c[taken], minlength=len(clips)))).astype("int32")
            mapping = pa.MapArray.from_arrays(pa.array(offsets), names[1].take(pa.array(codes[1][taken])), names[0].take(pa.array(codes[0][taken])))
            yield pa.RecordBatch.from_arrays([clips, *[pa.array(sums[k]) for k in (FALSE_ALARM, MISSED, BOTH, TOTAL)], pa.array(right), mapping], names=["clip_id", "false_alarm", "missed", "both", "total", "right", "mapping"])

    rows = sums.repartition("clip_id").sortWithinPartitions("clip_id").mapInArrow(maps, f"clip_id {kind}, false_alarm bigint, missed bigint, both bigint, total bigint, right bigint, mapping map<string,string>")
    seconds = {k: F.col(k) / 1000 for k in ("false_alarm", "missed", "both", "total", "right")}
    mapping = F.when(F.size("mapping") > 0, F.col("mapping")).alias("mapping")
    sums = rows.select("clip_id", seconds["false_alarm"].alias("false_alarm"), seconds["missed"].alias("missed"), F.round(seconds["both"] - seconds["right"], 9).alias("confusion"), seconds["total"].alias("total"), mapping)
    wrong = F.col("false_alarm") + F.col("missed") + F.col("confusion")
    return sums.withColumn("error_rate", F.try_divide(wrong, "total"))
