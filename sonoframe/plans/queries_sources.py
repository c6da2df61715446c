"""Registered queries on files, datasets, the catalog, and operators around models; and their SQL.

Queries on files write what they read, to a new place in the shared folder. Models are stand-ins whose results SQL can tell.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoframe.functions.arrays import transposed
from sonoframe.operators import alignment, checks, diarization, features, frames, metrics, models, pose, quality, results, taxonomy, tree
from sonoframe.operators.nested import latest_delivery
from sonoframe.plans.durable import scratch
from sonoframe.plans.queries_signal import RATE, clips, rounded
from sonoframe.plans.queries_speech import _LINES, lines
from sonoframe.sources import chat, datasets, files, wav
from sonoframe.sources.tables import load
from sonoframe.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(f, sql: str | None = None):
    QUERIES[f.__name__] = f
    if sql:
        SQL[f.__name__] = sql
    return f


_X = "WITH s AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)\n"


def _written(spark, d, bits: int = 16):
    """The folder of the clips as WAV files, one each."""
    place = files_path(scratch(spark, "clips"))
    named = clips(spark, d).withColumn("path", F.concat(F.lit(f"{place}/"), F.when(F.col("clip_id") % 2 == 0, "even").otherwise("odd"), F.lit("/clip "), F.col("clip_id").cast("string"), F.lit(".wav")))
    wav.save_clips(named.repartition(spark.sparkContext.defaultParallelism), bits).agg(F.sum("n_bytes")).collect()  # one number
    return place


def files_path(uri: str) -> str:
    """A local path without its scheme, as the readers give it."""
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def _read(spark, place: str):
    return [f"{place}/even", f"{place}/odd"]


def _number(path):
    return files.stem(path).substr(F.lit(6), F.lit(20)).cast("bigint")


def wav_samples(spark, d):
    """Clips written as WAV files of 16 bits and read again: every sample."""
    rows = wav.read_clips(spark, _read(spark, _written(spark, d)))
    rows = rows.select(_number(F.col("path")).alias("clip_id"), "sampling_rate", F.posexplode("channels").alias("channel", "c"))
    return rows.select("clip_id", "sampling_rate", "channel", F.posexplode("c").alias("pos", "x")).withColumn("x", F.round("x", 6))


_register(wav_samples, _X + "SELECT vec_id AS clip_id, 64 AS sampling_rate, 0 AS channel, pos, round(round_even(greatest(-1, least(1, x)) * 32767, 0) / 32768, 6) AS x FROM s")


def wav_stretches(spark, d):
    """A stretch of float WAV files: 0.25 s from 0.5 s on."""
    rows = wav.read_clips(spark, _read(spark, _written(spark, d, -32)), 0.5, 0.25)
    return rows.select(_number(F.col("path")).alias("clip_id"), F.posexplode(F.get("channels", F.lit(0))).alias("pos", "x")).withColumn("x", F.round("x", 6))


_register(wav_stretches, _X + "SELECT vec_id AS clip_id, pos - 32 AS pos, round(x, 6) AS x FROM s WHERE pos >= 32 AND pos < 48")


def wav_headers(spark, d):
    rows = wav.read_headers(spark, _read(spark, _written(spark, d)))
    return rows.select(_number(F.col("path")).alias("clip_id"), "sampling_rate", "n_channels", "duration_sec")


_register(wav_headers, "SELECT vec_id AS clip_id, 64 AS sampling_rate, 1 AS n_channels, len(embedding) / 64.0::DOUBLE AS duration_sec FROM embeddings")


def audio_listing(spark, d):
    """Audio files below a folder, whose other files don't count."""
    place = _written(spark, d)
    load(spark, d, "region").write.parquet(f"{place}/even/other")
    rows = files.audio_files(spark, place)
    return rows.select(F.substring("path", len(place) + 1, 1000).alias("path"), "length")


_register(audio_listing, "SELECT '/' || CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END || '/clip ' || vec_id || '.wav' AS path, 44 + 2 * len(embedding) AS length FROM embeddings")


def file_listing(spark, d):
    """Files with their types; hidden folders are left out."""
    place = _written(spark, d)
    wav.save_clips(clips(spark, d).where("clip_id < 3").withColumn("path", F.concat(F.lit(f"{place}/.hidden/"), F.col("clip_id").cast("string"), F.lit(".WAV")))).count()
    return files.list_files(spark, place, types=["audio"]).select(F.substring("path", len(place) + 1, 1000).alias("path"), "type")


_register(file_listing, "SELECT '/' || CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END || '/clip ' || vec_id || '.wav' AS path, 'audio' AS type FROM embeddings")


def existing_files(spark, d):
    """Of the paths asked for, those that are there; every third one asked for is not."""
    place = _written(spark, d)
    folder = F.when(F.col("clip_id") % 2 == 0, "even").otherwise("odd")
    asked = clips(spark, d).select("clip_id", F.concat(F.lit(f"{place}/"), folder, F.lit("/clip "), F.col("clip_id").cast("string"), F.when(F.col("clip_id") % 3 == 0, ".mp3").otherwise(".wav")).alias("path"))
    return files.existing(asked, files.listing(spark, _read(spark, place))).select("clip_id")


_register(existing_files, "SELECT vec_id AS clip_id FROM embeddings WHERE vec_id % 3 <> 0")


def verified_files(spark, d):
    """Checksums held against noted ones, of which every tenth is wrong and every fiftieth is of a file that is gone."""
    place = _written(spark, d)
    actual = files.checksums(spark, _read(spark, place))
    n = _number(F.col("path"))
    noted = actual.select(F.when(n % 50 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"), F.when(n % 10 == 0, F.reverse("checksum")).otherwise(F.col("checksum")).alias("checksum"))
    rows = files.verified(actual, noted)
    return rows.select(F.regexp_extract("path", r"clip (\d+)", 1).cast("bigint").alias("clip_id"), "ok")


_register(verified_files, "SELECT vec_id AS clip_id, vec_id % 10 <> 0 AS ok FROM embeddings")


def files_of_one_type(spark, d):
    """The recordings' files that are audio, which are all of one type."""
    paths = load(spark, d, "recordings").select(F.col("file_path").alias("path")).distinct()
    return files.one_type(paths.where(files.file_type(F.col("path")) == "audio"))


_register(files_of_one_type, "SELECT DISTINCT 'audio' AS type, file_path AS path FROM recordings WHERE lower(file_path) LIKE '%.wav' OR lower(file_path) LIKE '%.mp3'")


def dataset_round_trips(spark, d):
    """Customers written in each format and read again, and from a mirror by revision and split."""
    place, rows = scratch(spark, "datasets"), load(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    kinds = ["parquet", "json", "csv", "arrow"]
    back = [datasets.read_dataset(spark, datasets.save_dataset(rows, place, "customers", k)).withColumn("kind", F.lit(k)) for k in kinds]
    datasets.save_mirror(rows, place, "owner/customers", "v1", "train")
    back.append(datasets.read_mirror(spark, place, "owner/customers", "v1", "train").withColumn("kind", F.lit("mirror")))
    all_rows = back[0]
    for one in back[1:]:
        all_rows = all_rows.unionByName(one)
    return all_rows.select("kind", F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


_register(dataset_round_trips, "SELECT kind, CAST(c_custkey AS BIGINT) AS c_custkey, c_name, round(CAST(c_acctbal AS DOUBLE), 2) AS c_acctbal FROM customer, (VALUES ('parquet'), ('json'), ('csv'), ('arrow'), ('mirror')) t(kind)")


SAVED = ["crest_factor_metric", "root_mean_square_energy_metric"]


def saved_results(spark, d):
    """A report saved as tables, read again."""
    place = scratch(spark, "report")
    wide = rounded(metrics.with_metrics(clips(spark, d), SAVED).select("clip_id", *SAVED), ["clip_id"])
    quality.save_results(wide, quality.long_form(wide, ["clip_id"], SAVED), place)
    return spark.read.parquet(f"{place}/long").select("clip_id", "evaluation_name", "value")


_register(saved_results, """WITH s AS (SELECT vec_id AS clip_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), a AS (SELECT clip_id, max(abs(x)) AS top, sqrt(avg(x * x)) AS rms FROM s GROUP BY 1)
SELECT clip_id, 'crest_factor_metric' AS evaluation_name, round(top / rms, 6) AS value FROM a UNION ALL SELECT clip_id, 'root_mean_square_energy_metric', round(rms, 6) FROM a""")


# catalog


def catalog_sessions(spark, d):
    """Participants and sessions in one catalog; ids that are missing are made."""
    people = load(spark, d, "participants").select("id", "metadata").dropDuplicates(["id"])
    talks = load(spark, d, "sessions").select("id", "metadata").dropDuplicates(["id"]).unionByName(load(spark, d, "region").select(F.lit(" ").alias("id"), F.lit(None).cast("map<string,string>").alias("metadata")))
    found = datasets.Catalog().add("participants", people).add("sessions", talks)
    rows = found.participants.select(F.lit("participant").alias("what"), "id").unionByName(found.sessions.select(F.lit("session").alias("what"), "id"))
    return rows.groupBy("what").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("id"), F.lit("")) == "").alias("n_blank"))


_register(catalog_sessions, "SELECT 'participant' AS what, count(DISTINCT id) AS n, 0 AS n_blank FROM participants UNION ALL SELECT 'session', count(DISTINCT id) + (SELECT count(*) FROM region), 0 FROM sessions")


def catalog_exchange(spark, d):
    """Clips exported as tables and imported again, further columns folded into the metadata."""
    own = clips(spark, d).withColumns({"path": F.concat(F.lit("clip "), F.col("clip_id").cast("string")), "metadata": F.create_map(F.lit("half"), (F.col("clip_id") % 2).cast("string"))})
    out = datasets.Catalog().add_clips(own.drop("clip_id")).exported()
    out["audios"] = out["audios"].withColumn("device", F.lit("microphone"))
    back = datasets.Catalog.imported(out, transfer_metadata=True).clips
    return back.select("path", "sampling_rate", frames.n_samples(F.col("channels")).alias("n"), F.col("metadata")["half"].alias("half"), F.col("metadata")["device"].alias("device"), F.length("clip_id").alias("id_length"))


_register(catalog_exchange, "SELECT 'clip ' || vec_id AS path, 64 AS sampling_rate, CAST(len(embedding) AS INT) AS n, CAST(vec_id % 2 AS VARCHAR) AS half, 'microphone' AS device, 64 AS id_length FROM embeddings")


def content_ids(spark, d):
    """Equal samples have equal ids: clips and the same once more, in groups by id."""
    own = clips(spark, d).select("clip_id", datasets.content_id(F.col("channels"), F.col("sampling_rate")).alias("id"))
    return own.unionByName(own).groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("clip_id").alias("n_clips")).groupBy("n", "n_clips").agg(F.count("*").alias("n_ids"))


_register(content_ids, "SELECT 2 * k AS n, k AS n_clips, count(*) AS n_ids FROM (SELECT embedding, count(*) AS k FROM embeddings GROUP BY 1) GROUP BY k")


def chat_turns(spark, d):
    """Script lines written as CHAT files, a file per clip, and read again."""
    place = scratch(spark, "chat")
    said = F.array_join(F.filter(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", " ")), " +"), lambda w: (w != "") & ~w.isin("xxx", "yyy", "www")), " ")
    rows = load(spark, d, "transcript_lines").dropDuplicates(["line_id"]).select("clip_id", "line_id", said.alias("said")).where("said <> ''")
    line = F.concat(F.lit("*PAR:\tnever [/] "), "said", F.lit(" &-um .\x15"), F.col("line_id").cast("string"), F.lit("_"), (F.col("line_id") + 5).cast("string"), F.lit("\x15"))
    texts = rows.groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    texts = texts.select(F.concat(F.lit("@Begin\n@Comment:\tclip "), F.col("clip_id").cast("string"), F.lit("\n"), "body", F.lit("\n@End")).alias("value"))
    texts.repartition(8).write.text(place, lineSep="\n\n@@\n")
    files_ = chat.chat_lines(spark, place)
    return files_.select("speaker", "text", "start_sec", "end_sec")


_register(chat_turns, """WITH t AS (SELECT DISTINCT line_id, text FROM transcript_lines), w AS (SELECT line_id, list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), ' +'), lambda x: x <> '' AND x NOT IN ('xxx', 'yyy', 'www')) AS w FROM t)
SELECT 'PAR' AS speaker, array_to_string(w, ' ') || '.' AS text, line_id / 1000.0::DOUBLE AS start_sec, (line_id + 5) / 1000.0::DOUBLE AS end_sec FROM w WHERE len(w) > 0""")


# checks and reports


def checks_of_speech(spark, d):
    """The checks that look at lines or at the signal itself."""
    named = ["primary_speaker_ratio_metric", "voice_activity_detection_metric"]
    voices = lines(spark, d).withColumn("speaker", F.when(F.col("speaker") == "SPEAKER_00", "VOICE").otherwise(F.col("speaker")))
    rows = diarization.speech_metrics(clips(spark, d), voices, named)
    return rows.select("clip_id", *[checks.check_column(n.replace("_metric", "_check"), F.col(n)) for n in named], checks.length_zero_check(F.col("channels")))


_register(checks_of_speech, _LINES + """, v AS (SELECT clip_id, CASE WHEN speaker = 'SPEAKER_00' THEN 'VOICE' ELSE speaker END AS speaker, end_sec - start_sec AS s FROM d),
r AS (SELECT clip_id, CASE WHEN sum(s) > 0 THEN max(s) / sum(s) END AS r FROM (SELECT clip_id, speaker, sum(s) AS s FROM v WHERE speaker IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT clip_id, sum(CASE WHEN speaker = 'VOICE' THEN s ELSE 0 END) AS a FROM v GROUP BY 1)
SELECT vec_id AS clip_id, """ + f"""CASE WHEN r IS NULL THEN {"NULL" if checks.CHECKS["primary_speaker_ratio_check"].nan_is_null else "FALSE"} ELSE r {checks.CHECKS["primary_speaker_ratio_check"].op} {checks.CHECKS["primary_speaker_ratio_check"].bound} END AS primary_speaker_ratio_check,
coalesce(a, 0.0) {checks.CHECKS["voice_activity_detection_check"].op} {checks.CHECKS["voice_activity_detection_check"].bound} AS voice_activity_detection_check, len(embedding) = 0 AS audio_length_zero_check
FROM embeddings LEFT JOIN r ON r.clip_id = vec_id LEFT JOIN a ON a.clip_id = vec_id""")


def voice_snr(spark, d):
    """Power within and between lines; a clip's vector is repeated until the clip is as long as its lines."""
    voices = lines(spark, d).withColumn("speaker", F.when(F.col("speaker") == "SPEAKER_00", "VOICE").otherwise(F.col("speaker")))
    seconds = voices.groupBy("clip_id").agg(F.ceil(F.max("end_sec")).cast("int").alias("_s"))
    own = clips(spark, d).join(seconds, "clip_id", "left").withColumn("channels", F.array(F.flatten(F.array_repeat(F.get("channels", F.lit(0)), F.coalesce("_s", F.lit(0)) + 2)))).drop("_s")
    return rounded(diarization.speech_metrics(own, voices, ["voice_signal_to_noise_power_ratio_metric"]).select("clip_id", "voice_signal_to_noise_power_ratio_metric"), ["clip_id"])


_register(voice_snr, _LINES + """, e AS (SELECT vec_id AS clip_id, embedding AS w FROM embeddings), o AS (SELECT clip_id, speaker, start_sec, end_sec, greatest(coalesce(max(end_sec) OVER (PARTITION BY clip_id ORDER BY start_sec, end_sec, speaker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS reach FROM d),
size AS (SELECT clip_id, 64 * (CAST(ceil(max(end_sec)) AS BIGINT) + 2) AS n, max(end_sec) AS stop FROM d GROUP BY 1),
voice AS (SELECT clip_id, avg(y * y) AS v FROM (SELECT o.clip_id, CAST(w[i % 64 + 1] AS DOUBLE) AS y FROM (SELECT clip_id, unnest(range(CAST(ceil(start_sec * 64) AS BIGINT), CAST(floor(end_sec * 64) AS BIGINT) + 1)) AS i FROM o WHERE speaker = 'VOICE' OR speaker = 'SPEAKER_00') o JOIN e USING (clip_id)) GROUP BY 1),
gaps AS (SELECT clip_id, unnest(range(CAST(ceil(reach * 64) AS BIGINT), CAST(ceil(start_sec * 64) AS BIGINT))) AS i FROM o WHERE start_sec > reach UNION ALL SELECT clip_id, unnest(range(CAST(floor(stop * 64) AS BIGINT) + 1, n)) FROM size),
noise AS (SELECT clip_id, avg(y * y) AS z FROM (SELECT clip_id, CAST(w[i % 64 + 1] AS DOUBLE) AS y FROM gaps JOIN e USING (clip_id)) GROUP BY 1)
SELECT e.clip_id, round(CASE WHEN v IS NULL OR z IS NULL OR z = 0 THEN 'nan'::DOUBLE ELSE 10 * log10(v / z) END, 6) AS voice_signal_to_noise_power_ratio_metric FROM e LEFT JOIN voice USING (clip_id) LEFT JOIN noise USING (clip_id)""")


def flattened_records(spark, d):
    """Records of evaluations with a column for each wanted one."""
    rows = clips(spark, d).select("clip_id", F.concat(F.lit("clip "), F.col("clip_id").cast("string")).alias("path"), F.lit("speech").alias("activity"), F.create_map(F.lit("a"), F.col("clip_id") * 0.5, F.lit("b"), F.when(F.col("clip_id") % 2 == 0, 1.0)).alias("evaluations"))
    return quality.flatten_records(rows, ["a", "b", "c"])


_register(flattened_records, "SELECT vec_id AS clip_id, 'clip ' || vec_id AS path, 'speech' AS activity, vec_id * 0.5::DOUBLE AS a, CASE WHEN vec_id % 2 = 0 THEN 1.0::DOUBLE END AS b, CAST(NULL AS DOUBLE) AS c FROM embeddings")


def taxonomy_checks(spark, d):
    """Checks of each activity of the recordings, by inheritance."""
    root = taxonomy.voice_assessment()
    named = [node.name for _, node in root.walk()]
    rows = [(a, e) for a in sorted(set(named)) for e in root.checks_for(a)]
    table = spark.createDataFrame(rows, "activity string, check string")
    seen = load(spark, d, "recordings").select("activity").distinct()
    return seen.join(F.broadcast(table), "activity").groupBy("activity").agg(F.count("*").alias("n_checks"), F.min("check").alias("first_check"))


_NODES = ", ".join(f"('{node.name}')" for _, node in taxonomy.voice_assessment().walk())
_register(taxonomy_checks, f"SELECT DISTINCT activity, {len(taxonomy.ROOT_CHECKS)} AS n_checks, '{min(taxonomy.ROOT_CHECKS)}' AS first_check FROM recordings WHERE activity IN (SELECT * FROM (VALUES {_NODES}))")


# results, lines, posteriorgrams


def results_of_json(spark, d):
    """Results of a classifier as JSON lists, best first."""
    labels = F.array(*[F.lit(f"label {i:02}") for i in range(64)])
    text = F.to_json(F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.struct(F.get(labels, i).alias("label"), x.alias("score"))))
    rows = load(spark, d, "embeddings").select("vec_id", results.from_json_list(text).alias("r"))
    return rows.select("vec_id", F.posexplode("r").alias("rank", "x")).select("vec_id", "rank", "x.label", F.round("x.score", 6).alias("score"))


_register(results_of_json, _X + "SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, pos) - 1 AS INT) AS rank, 'label ' || lpad(CAST(pos AS VARCHAR), 2, '0') AS label, round(x, 6) AS score FROM s")


def emotion_kinds(spark, d):
    """The kind of recognizer whose labels are words of each document's first line of five."""
    words = F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " ")), " ")
    return load(spark, d, "documents").select("doc_id", results.emotion_kind(words).alias("kind"))


_register(emotion_kinds, """WITH w AS (SELECT doc_id, string_split(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')), ' ') AS w FROM documents)
SELECT doc_id, CASE WHEN list_has_all(w, ['positive', 'negative', 'neutral']) THEN 'valence' WHEN list_has_any(w, ['valence', 'arousal', 'dominance']) THEN 'continuous'
WHEN list_has_any(w, ['happy', 'happiness', 'joy', 'angry', 'anger', 'sad', 'sadness', 'fear', 'disgust', 'surprise']) THEN 'discrete' ELSE 'not_recognized' END AS kind FROM w""")


def frames_first(spark, d):
    """Matrices of 4 by 16 and 16 by 4, both with their 4 frames as rows."""
    flat = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(a - 1)), lambda i: F.slice(F.col("w"), i * b + 1, b))
    rows = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    rows = rows.withColumn("m", F.when(F.col("vec_id") % 2 == 0, flat(4, 16)).otherwise(transposed(flat(4, 16))))
    rows = rows.select("vec_id", F.posexplode(features.frame_major(F.col("m"), 16)).alias("frame", "r"))
    return rows.select("vec_id", "frame", F.posexplode("r").alias("phoneme", "x")).withColumn("x", F.round("x", 6))


_register(frames_first, _X + "SELECT vec_id, CAST(pos // 16 AS INT) AS frame, CAST(pos % 16 AS INT) AS phoneme, round(x, 6) AS x FROM s")


def nested_lines(spark, d):
    """Lists of lists of lines with one level of nesting less; what is null stays."""
    rows = load(spark, d, "transcriptions").dropDuplicates(["transcription_id"]).select("transcription_id", F.array(F.transform("segments", lambda s: s["text"]), F.lit(None).cast("array<string>")).alias("lines"))
    return tree.flattened(rows).select("transcription_id", F.posexplode("lines").alias("pos", "text"))


_register(nested_lines, """WITH t AS (SELECT transcription_id, any_value(segments) AS g FROM transcriptions GROUP BY 1), l AS (SELECT transcription_id, list_concat(CASE WHEN g IS NULL THEN [NULL] ELSE list_transform(g, lambda s: s.text) END, [NULL]) AS l FROM t)
SELECT transcription_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS text FROM l""")


def sentence_spans(spark, d):
    """Sentences of the texts, by their characters."""
    rows = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", F.posexplode(alignment.sentence_spans(F.col("text"))).alias("no", "s"))
    return rows.select("doc_id", "no", F.expr("substring(text, s.from_at + 1, s.to_at - s.from_at)").alias("sentence"))


_register(sentence_spans)


def alignable_lines(spark, d):
    """Lines that can be aligned: with a known character, beginning before the last end of their clip less one second."""
    rows = load(spark, d, "transcript_lines").dropDuplicates(["line_id"])
    longest = rows.groupBy("clip_id").agg((F.max("end_sec") - 1.0).alias("longest"))
    rows = rows.join(longest, "clip_id").where("start_sec IS NOT NULL AND longest IS NOT NULL")
    clean = alignment.clean_characters(F.coalesce("text", F.lit("")), ["A", "E", "I", "O", "U"])
    return rows.select("line_id", alignment.can_align(clean, F.col("start_sec"), F.col("longest")).alias("able"))


_register(alignable_lines, """WITH t AS (SELECT DISTINCT line_id, clip_id, text, start_sec, end_sec FROM transcript_lines), m AS (SELECT clip_id, max(end_sec) - 1.0 AS longest FROM t GROUP BY 1)
SELECT line_id, regexp_matches(upper(coalesce(text, '')), '[AEIOU]') AND start_sec < longest AS able FROM t JOIN m USING (clip_id) WHERE start_sec IS NOT NULL AND longest IS NOT NULL""")


def pose_landmarks(spark, d):
    """The nose of the first person of each image that has one, and the image's shape."""
    rows = latest_delivery(load(spark, d, "image_poses"), "image_id", ["pose_model", "individuals"])
    rows = rows.withColumns({"height": F.lit(480), "width": F.lit(640), "depth": F.lit(3)})
    first = F.get("individuals", F.lit(0))
    rows = pose.require_image_shape(rows).where(first.isNotNull() & F.coalesce(F.map_contains_key(first["normalized_landmarks"], "nose"), F.lit(False)))
    mark = pose.landmark(pose.individual(F.col("individuals"), 0), "nose")
    return rows.select("image_id", F.round(mark["x"], 6).alias("x"), F.round(mark["y"], 6).alias("y"))


_register(pose_landmarks, """WITH r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ingested_at DESC) AS k FROM image_poses), p AS (SELECT image_id, individuals[1] AS p FROM r WHERE k = 1)
SELECT image_id, round(p.normalized_landmarks['nose'].x, 6) AS x, round(p.normalized_landmarks['nose'].y, 6) AS y FROM p WHERE p IS NOT NULL AND map_contains(p.normalized_landmarks, 'nose')""")


def video_frames(spark, d):
    """Videos decoded by a stand-in (each byte of the text is a frame): a row per frame."""

    def decoder(_):
        import pandas as pd

        return lambda batch: pd.DataFrame({"frames": [[bytes([b]) for b in c] for c in batch["content"]], "frame_rate": 25.0})

    rows = load(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("video_id"), F.encode("n_name", "UTF-8").alias("content"))
    rows = pose.frames_table(models.apply_model(rows, "decode_video", decoder, models.ModelRef("bytes")))
    return rows.select("video_id", "frame_no", F.round("at_sec", 6).alias("at_sec"), F.decode("frame", "UTF-8").alias("frame"))


_register(video_frames, "WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS video_id, n_name, unnest(range(0, length(n_name))) AS k FROM nation) SELECT video_id, CAST(k AS INT) AS frame_no, round(k / 25.0::DOUBLE, 6) AS at_sec, n_name[k + 1] AS frame FROM n")


# operators around models: what goes in and what comes out of a stand-in


def _at_16k(spark, d):
    return clips(spark, d).withColumn("sampling_rate", F.lit(16_000))


def model_scenes(spark, d):
    """Windowed classification in batches: is a window louder on the whole above or below zero; both labels, best first."""

    def loader(_):
        import numpy as np
        import pandas as pd

        def call(batch):
            sums = [float(np.sum(c[0])) for c in batch["channels"]]
            return pd.DataFrame({"result": [[{"score": s, "label": "above"}, {"score": -s, "label": "below"}] for s in sums]})

        return call

    rows = models.classify_windows(clips(spark, d), loader, models.ModelRef("sums"), 0.5, top_k=1)
    return rows.select("clip_id", "window_start", "window_end", F.get("labels", F.lit(0)).alias("label"), F.round(F.get("scores", F.lit(0)), 5).alias("score"))


_register(model_scenes, _X + """, k AS (SELECT vec_id, k * 16 AS a, least(k * 16 + 32, 64) AS b FROM embeddings, (SELECT unnest(range(0, 4)) AS k)), t AS (SELECT k.vec_id, a, b, sum(x) AS t FROM k JOIN s ON s.vec_id = k.vec_id AND pos >= a AND pos < b GROUP BY 1, 2, 3)
SELECT vec_id AS clip_id, a / 64.0::DOUBLE AS window_start, b / 64.0::DOUBLE AS window_end, CASE WHEN t >= 0 THEN 'above' ELSE 'below' END AS label, round(abs(t), 5) AS score FROM t""")


def model_enhanced(spark, d):
    """Enhancement piece by piece: each piece less its own mean."""

    def loader(_):
        import numpy as np
        import pandas as pd

        return lambda batch: pd.DataFrame({"out_channels": [[(np.asarray(c[0]) - np.mean(c[0])).tolist()] for c in batch["channels"]], "out_rate": batch["sampling_rate"].astype("int32")})

    rows = models.enhance_in_pieces(_at_16k(spark, d), loader, models.ModelRef("means"), seconds=24 / 16_000, batch=7)
    return rows.select("clip_id", F.posexplode(F.get("channels", F.lit(0))).alias("pos", "x")).withColumn("x", F.round("x", 5))


_register(model_enhanced, _X + "SELECT vec_id AS clip_id, pos, round(x - avg(x) OVER (PARTITION BY vec_id, pos // 24), 5) AS x FROM s")


def model_transcripts(spark, d):
    """Transcription: a word per full eighth of a second that is above zero in sum; times out of order are made sound."""

    def loader(_):
        import pandas as pd

        def call(batch):
            out = []
            for c in batch["channels"]:
                out.append([{"text": f"word {i}", "speaker": None, "start_sec": i / 8 - 0.25, "end_sec": i / 8 - 0.125} for i in range(len(c[0]) // 8) if sum(c[0][i * 8 : i * 8 + 8]) > 0])
            return pd.DataFrame({"lines": out})

        return call

    rows = models.sanitized_lines(models.apply_model(_at_16k(spark, d), "transcribe", loader, models.ModelRef("words"), batch=16))
    return rows.select("clip_id", F.posexplode("lines").alias("pos", "l")).select("clip_id", "pos", "l.text", "l.start_sec", "l.end_sec")


_register(model_transcripts, _X + """, w AS (SELECT vec_id, pos // 8 AS i FROM s GROUP BY 1, 2 HAVING sum(x) > 0)
SELECT vec_id AS clip_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS INT) AS pos, 'word ' || i AS text, greatest(i / 8.0::DOUBLE - 0.25, 0) AS start_sec, greatest(i / 8.0::DOUBLE - 0.125, greatest(i / 8.0::DOUBLE - 0.25, 0)) AS end_sec FROM w""")


def model_diarization(spark, d):
    """Diarization as texts of start, end and speaker, parsed and taken as voice."""
    rows = clips(spark, d).select("clip_id", F.array(F.concat_ws(" ", F.lit("0.50 0.75"), F.concat(F.lit("S"), F.col("clip_id").cast("string"))), F.lit(" 0.0   0.25 A ")).alias("raw"))
    both = models.parsed_diarization(rows)
    rows = both.select("clip_id", F.lit("who").alias("kind"), F.posexplode("lines").alias("pos", "l")).unionByName(models.as_voice(both).select("clip_id", F.lit("voice").alias("kind"), F.posexplode("lines").alias("pos", "l")))
    return rows.select("clip_id", "kind", "pos", "l.speaker", "l.start_sec", "l.end_sec")


_register(model_diarization, """SELECT vec_id AS clip_id, kind, pos, CASE WHEN kind = 'voice' THEN 'VOICE' WHEN pos = 0 THEN 'A' ELSE 'S' || vec_id END AS speaker, CASE WHEN pos = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS start_sec, CASE WHEN pos = 0 THEN 0.25 ELSE 0.75 END::DOUBLE AS end_sec
FROM embeddings, (VALUES ('who'), ('voice')) k(kind), (VALUES (0), (1)) p(pos)""")


def model_conversion(spark, d):
    """Voice conversion of paired clips: each sample of the source times the target's at its place."""

    def loader(_):
        import numpy as np
        import pandas as pd

        return lambda batch: pd.DataFrame({"out_channels": [[(np.asarray(a[0]) * np.asarray(b[0])).tolist()] for a, b in zip(batch["channels"], batch["target_channels"], strict=True)], "out_rate": batch["sampling_rate"].astype("int32")})

    own = clips(spark, d).withColumn("pair_no", F.floor(F.col("clip_id") / 2))
    whole = own.groupBy("pair_no").agg(F.count("*").alias("k")).where("k = 2").select("pair_no")
    own = own.join(whole, "pair_no")
    rows = models.apply_model(models.paired(own.where("clip_id % 2 = 0"), own.where("clip_id % 2 = 1")), "clone_voice", loader, models.ModelRef("products"))
    return rows.select("clip_id", "target_id", F.posexplode(F.get("out_channels", F.lit(0))).alias("pos", "x")).withColumn("x", F.round("x", 6))


_register(model_conversion, _X + "SELECT a.vec_id AS clip_id, b.vec_id AS target_id, a.pos, round(a.x * b.x, 6) AS x FROM s a JOIN s b ON b.vec_id = a.vec_id + 1 AND a.pos = b.pos WHERE a.vec_id % 2 = 0")


def model_speech(spark, d):
    """Speech of texts, which must have words: a sample for each character, its code over 1000."""

    def loader(_):
        import pandas as pd

        return lambda batch: pd.DataFrame({"out_channels": [[[ord(c) / 1000 for c in t]] for t in batch["text"]], "out_rate": 16_000}).astype({"out_rate": "int32"})

    rows = models.require_transcripts(load(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("clip_id"), F.col("n_name").alias("text"), F.lit("eng").alias("language")))
    rows = models.apply_model(rows, "synthesize", loader, models.ModelRef("codes"))
    return rows.select("clip_id", F.posexplode(F.get("out_channels", F.lit(0))).alias("pos", "x"))


_register(model_speech, "WITH n AS (SELECT n_nationkey, n_name, unnest(range(0, length(n_name))) AS k FROM nation) SELECT CAST(n_nationkey AS BIGINT) AS clip_id, CAST(k AS INT) AS pos, ord(n_name[k + 1]) / 1000.0::DOUBLE AS x FROM n")


def model_text_vectors(spark, d):
    """Embeddings of texts: their characters and blanks."""

    def loader(_):
        import pandas as pd

        return lambda batch: pd.DataFrame({"vector": [[float(len(t)), float(t.count(" "))] for t in batch["text"]]})

    rows = models.apply_model(load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text_embedding", loader, models.ModelRef("counts"), batch=100)
    return rows.select("doc_id", F.get("vector", F.lit(0)).alias("n_chars"), F.get("vector", F.lit(1)).alias("n_blanks"))


_register(model_text_vectors, "SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS n_chars, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS DOUBLE) AS n_blanks FROM documents")


def model_layers(spark, d):
    """Layers of a self-supervised model (the clip in frames of 16, and their negatives), averaged over the frames."""

    def loader(_):
        import numpy as np
        import pandas as pd

        def call(batch):
            frames_ = [np.asarray(c[0]).reshape(-1, 16) for c in batch["channels"]]
            return pd.DataFrame({"layers": [[f.tolist(), (-f).tolist()] for f in frames_]})

        return call

    rows = models.apply_model(_at_16k(spark, d), "ssl_embedding", loader, models.ModelRef("frames"))
    mean = lambda layer: F.transform(transposed(layer), lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c))
    rows = rows.select("clip_id", F.posexplode("layers").alias("layer", "m")).select("clip_id", "layer", F.posexplode(mean(F.col("m"))).alias("pos", "x"))
    return rows.withColumn("x", F.round("x", 6))


_register(model_layers, _X + "SELECT vec_id AS clip_id, layer, CAST(pos % 16 AS INT) AS pos, round(avg(x) * CASE WHEN layer = 0 THEN 1 ELSE -1 END, 6) AS x FROM s, (VALUES (0), (1)) l(layer) GROUP BY vec_id, layer, pos % 16")


def model_scores(spark, d):
    """Objective quality, emotions, functionals and posteriorgrams, each from its own stand-in, side by side."""

    def scores(_):
        import numpy as np
        import pandas as pd

        return lambda batch: pd.DataFrame([(float(np.max(c[0])), float(np.min(c[0])), float(np.mean(c[0]))) for c in batch["channels"]], columns=["stoi", "pesq", "si_sdr"])

    def functionals(_):
        import numpy as np
        import pandas as pd

        return lambda batch: pd.DataFrame({"features": [{"range": float(np.ptp(c[0]))} for c in batch["channels"]]})

    rows = models.apply_model(_at_16k(spark, d), "objective_quality", scores, models.ModelRef("extremes"))
    rows = models.apply_model(rows, "functionals", functionals, models.ModelRef("range"))
    return rounded(rows.select("clip_id", "stoi", "pesq", "si_sdr", F.col("features")["range"].alias("span")), ["clip_id"])


_register(model_scores, _X + "SELECT vec_id AS clip_id, round(max(x), 6) AS stoi, round(min(x), 6) AS pesq, round(avg(x), 6) AS si_sdr, round(max(x) - min(x), 6) AS span FROM s GROUP BY 1")


def stream_chunk_samples(spark, d):
    """Every sample of the chunks of clips."""
    rows = windows.chunks(clips(spark, d), 0.3)
    return rows.select("clip_id", "chunk_no", F.posexplode(F.get("channels", F.lit(0))).alias("pos", "x")).withColumn("x", F.round("x", 6))


_register(stream_chunk_samples, _X + "SELECT vec_id AS clip_id, CAST(pos // 19 AS INT) AS chunk_no, CAST(pos % 19 AS INT) AS pos, round(x, 6) AS x FROM s")


# values of spectra: a discrete Fourier transform by join


def spectrogram_values(spark, d):
    """Power of each bin of the frames of 32 samples, the signal mirrored at its ends, a periodic Hann window."""
    rows = features.spectrogram(clips(spark, d), n_fft=32, hop=16).select("clip_id", F.posexplode("spectrogram").alias("bin", "r"))
    return rows.select("clip_id", "bin", F.posexplode("r").alias("frame", "power")).withColumn("power", F.round("power", 5))


_SPECTRUM = _X + """, f AS (SELECT unnest(range(0, 5)) AS frame), j AS (SELECT unnest(range(0, 32)) AS j), b AS (SELECT unnest(range(0, 17)) AS bin),
p AS (SELECT frame, j, frame * 16 + j - 16 AS q FROM f, j), z AS (SELECT s.vec_id, frame, j, x * (0.5 - 0.5 * cos(2 * pi() * j / 32)) AS y FROM p JOIN s ON pos = CASE WHEN q < 0 THEN -q WHEN q > 63 THEN 126 - q ELSE q END),
spec AS (SELECT vec_id, CAST(bin AS INT) AS bin, CAST(frame AS INT) AS frame, power(sum(y * cos(2 * pi() * bin * j / 32)), 2) + power(sum(y * sin(2 * pi() * bin * j / 32)), 2) AS power FROM z, b GROUP BY 1, 2, 3)
"""
_register(spectrogram_values, _SPECTRUM + "SELECT vec_id AS clip_id, bin, frame, round(power, 5) AS power FROM spec")


def mel_of_spectrograms(spark, d):
    """Mel filters over given spectrograms: what the filters over clips give."""
    own = clips(spark, d)
    there = features.mel_of_spectrograms(features.spectrogram(own, n_fft=32, hop=16), RATE, 12).select("clip_id", "mel_filter_bank")
    here = features.mel_spectrogram(own, n_fft=32, hop=16, n_mels=12).select("clip_id", "mel_spectrogram")
    gap = F.aggregate(F.flatten(F.zip_with("mel_filter_bank", "mel_spectrogram", lambda a, b: F.zip_with(a, b, lambda x, y: F.abs(x - y)))), F.lit(0.0), lambda m, x: F.greatest(m, x))
    return there.join(here, "clip_id").select("clip_id", F.size("mel_filter_bank").alias("n_mels"), (gap < 1e-9).alias("same"))


_register(mel_of_spectrograms, "SELECT vec_id AS clip_id, 12 AS n_mels, TRUE AS same FROM embeddings")


def mel_values(spark, d):
    """Power of twelve triangular filters on the mel scale."""
    rows = features.mel_spectrogram(clips(spark, d), n_fft=32, hop=16, n_mels=12).select("clip_id", F.posexplode("mel_spectrogram").alias("mel", "r"))
    return rows.select("clip_id", "mel", F.posexplode("r").alias("frame", "power")).withColumn("power", F.round("power", 5))


_MEL = _SPECTRUM + """, points AS (SELECT k, 700 * (power(10, k * 2595 * log10(1 + 32 / 700.0::DOUBLE) / 13 / 2595) - 1) AS f FROM (SELECT unnest(range(0, 14)) AS k)),
filters AS (SELECT CAST(a.k AS INT) AS mel, bin, greatest(0, least((bin * 2 - a.f) / (b.f - a.f), (c.f - bin * 2) / (c.f - b.f))) AS w FROM points a JOIN points b ON b.k = a.k + 1 JOIN points c ON c.k = a.k + 2, (SELECT unnest(range(0, 17)) AS bin)),
mels AS (SELECT vec_id, mel, frame, sum(w * power) AS power FROM spec JOIN filters USING (bin) GROUP BY 1, 2, 3)
"""
_register(mel_values, _MEL + "SELECT vec_id AS clip_id, mel, frame, round(power, 5) AS power FROM mels")


def mfcc_values(spark, d):
    """Five cepstral coefficients of the twelve filters, in decibels no lower than 80 under the loudest."""
    rows = features.mfcc(clips(spark, d), 5, 32, hop=16, n_mels=12).select("clip_id", F.posexplode("mfcc").alias("coefficient", "r"))
    return rows.select("clip_id", "coefficient", F.posexplode("r").alias("frame", "value")).withColumn("value", F.round("value", 4))


_register(mfcc_values, _MEL + """, db AS (SELECT vec_id, mel, frame, greatest(10 * log10(greatest(power, 1e-10)), max(10 * log10(greatest(power, 1e-10))) OVER (PARTITION BY vec_id) - 80) AS v FROM mels)
SELECT vec_id AS clip_id, CAST(k AS INT) AS coefficient, frame, round(sum(v * cos(pi() / 12 * (mel + 0.5) * k)) * sqrt(2 / 12.0::DOUBLE) * CASE WHEN k = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END, 4) AS value FROM db, (SELECT unnest(range(0, 5)) AS k) GROUP BY vec_id, k, frame""")


def pitch_tracks(spark, d):
    """Pitch of tones of 100 to 300 Hz, a second each: the median is the tone's, but for a sample of its period."""
    tones = load(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("clip_id"), (F.lit(100) + F.col("n_nationkey") * 8).cast("double").alias("hz"))
    wave = F.transform(F.sequence(F.lit(0), F.lit(7999)), lambda i: F.sin(F.lit(2 * 3.141592653589793) * F.col("hz") * i / 8000))
    rows = features.pitch(tones.select("clip_id", "hz", F.lit(8000).alias("sampling_rate"), F.array(wave).alias("channels")))
    middle = F.element_at(F.array_sort(F.filter("pitch", lambda x: x > 0)), F.greatest((F.size(F.filter("pitch", lambda x: x > 0)) / 2).cast("int"), F.lit(1)))
    return rows.select("clip_id", (F.abs(middle - F.col("hz")) <= F.col("hz") * F.col("hz") / 8000).alias("right"))


_register(pitch_tracks, "SELECT CAST(n_nationkey AS BIGINT) AS clip_id, TRUE AS right FROM nation")
