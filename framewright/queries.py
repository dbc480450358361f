"""The queries over the driver's tables, and the same in DuckDB's SQL.

The tables hold no video. embeddings stand for frames (64 numbers are one 8x8 coefficient block,
label is the media, vec_id the order), conversations for cues (times are made from text lengths),
pages for marked-up text, events for probe output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import fingerprint as fpf
from .functions import text as txt
from .functions import timeline as tl
from .operators import align, cues, fingerprints, keyframes
from .plans.commands import FilterSpec, list_line

FPS = 25


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- stand-in tables ---------------------------------------------------------------------


def fingerprint_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, vec_id, frame_id, fp): frames are numbered from 0 in each media."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("media_id"), "vec_id", fpf.from_coefficients(F.col("embedding")).alias("fp"))
    order = W.partitionBy("media_id").orderBy("vec_id")
    return rows.withColumn("frame_id", (F.row_number().over(order) - 1).cast("bigint"))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, fp) without numbering, for functions of one row: no shuffle."""
    return _table(spark, sf_dir, "embeddings").select("vec_id", fpf.from_coefficients(F.col("embedding")).alias("fp"))


_FP = """fp_raw AS (SELECT CAST(label AS VARCHAR) AS media_id, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings),
fp_med AS (SELECT *, (list_sort(c)[32] + list_sort(c)[33]) / 2.0 AS med FROM fp_raw),
fp_bits AS (SELECT media_id, vec_id, array_to_string(list_transform(c, lambda x: CASE WHEN x > med THEN '1' ELSE '0' END), '') AS bits FROM fp_med),
fps AS (SELECT media_id, vec_id, row_number() OVER (PARTITION BY media_id ORDER BY vec_id) - 1 AS frame_id, bits,
  CAST(list_sum(list_transform(range(1, 64), lambda i: CAST(substr(bits, CAST(i + 1 AS INTEGER), 1) AS HUGEINT) << (63 - i))) - CAST(substr(bits, 1, 1) AS HUGEINT) * 9223372036854775808 AS BIGINT) AS fp FROM fp_bits)"""


def cue_table(spark: SparkSession, sf_dir: str, gap: int = 700) -> DataFrame:
    """(media_id, cue_pos, cue_index, start_ms, end_ms, text): a cue lasts 40 ms a letter, with gaps between."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("media_id"), F.col("turn"), "text")
    order = W.partitionBy("media_id").orderBy("turn")
    size = F.length(F.coalesce("text", F.lit(""))) * 40
    rows = rows.withColumn("cue_pos", F.row_number().over(order) - 1).withColumn("size", size)
    end = F.sum(F.col("size") + gap).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.select(
        "media_id", F.col("cue_pos").cast("int").alias("cue_pos"), (F.col("cue_pos") + 1).cast("string").alias("cue_index"),
        (end - F.col("size")).cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms"), "text",
    )


_CUES = """cue_rows AS (SELECT CAST(conv_id AS VARCHAR) AS media_id, turn, text, length(coalesce(text, '')) * 40 AS size,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cue_pos FROM conversations),
cues AS (SELECT media_id, CAST(cue_pos AS INTEGER) AS cue_pos, CAST(cue_pos + 1 AS VARCHAR) AS cue_index, text,
  CAST(sum(size + 700) OVER w - size AS BIGINT) AS start_ms, CAST(sum(size + 700) OVER w AS BIGINT) AS end_ms
  FROM cue_rows WINDOW w AS (PARTITION BY media_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""


def _frame_sql(ms: str) -> str:
    return f"CAST(trunc((CAST({ms} // 3600000 * 3600 + {ms} % 3600000 // 60000 * 60 + {ms} % 60000 // 1000 AS DOUBLE) + CAST({ms} % 1000 AS DOUBLE) / 1000.0::DOUBLE) * 25.0::DOUBLE) AS BIGINT)"


def film_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, n): each conversation's film is as long as its cues."""
    return cue_table(spark, sf_dir).groupBy("media_id").agg(tl.time_to_frame(F.max("end_ms")).alias("n"))


def shown_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, frame_id, fp): the frames of each conversation's film, which are many for each row of lengths: hence the parts."""
    parts = max(96, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frames = film_lengths(spark, sf_dir).repartition(parts, "media_id").select("media_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("frame_id"))
    return frames.withColumn("fp", F.col("frame_id") * 7919 + F.length("media_id"))


_SHOWN = f"""shown_n AS (SELECT media_id, {_frame_sql('max(end_ms)')} AS n FROM cues GROUP BY media_id),
spans0 AS (SELECT c.*, {_frame_sql('start_ms')} AS fs, {_frame_sql('end_ms')} AS fe, n FROM cues c JOIN shown_n USING (media_id)),
spans1 AS (SELECT *, max(greatest(0, fs - 1, fe - 1)) OVER (PARTITION BY media_id ORDER BY cue_pos ROWS UNBOUNDED PRECEDING) AS e0 FROM spans0),
spans2 AS (SELECT *, coalesce(lag(e0) OVER (PARTITION BY media_id ORDER BY cue_pos), 0) AS prev FROM spans1),
spans3 AS (SELECT *, greatest(prev, fs - 1) AS s0 FROM spans2),
spans4 AS (SELECT *, CASE WHEN prev > fs OR s0 > n - 1 THEN 'stop' WHEN s0 > fe OR e0 > n - 1 THEN 'tail' ELSE 'ok' END AS kind FROM spans3),
spans5 AS (SELECT *, min(CASE WHEN kind <> 'ok' THEN cue_pos END) OVER (PARTITION BY media_id) AS cut FROM spans4),
emitted AS (SELECT media_id, cue_pos, cue_index, unnest(CASE WHEN kind = 'tail' THEN range(s0, n) ELSE list_append(range(s0, e0 + 1), e0) END) AS frame_id,
  unnest(range(0, CASE WHEN kind = 'tail' THEN n - s0 ELSE e0 - s0 + 2 END)) AS emit_seq
  FROM spans5 WHERE cut IS NULL OR cue_pos < cut OR (cue_pos = cut AND kind = 'tail'))"""


def _cue_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues.cue_fingerprints(cue_table(spark, sf_dir), shown_frames(spark, sf_dir), lengths=film_lengths(spark, sf_dir))


# ---- queries -----------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(f"WITH {_FP} SELECT count(DISTINCT fp) AS n_distinct FROM fps")
def fp_distinct_count(spark, d):
    return fingerprints.distinct_count(hashed(spark, d))


@query(f"WITH {_FP} SELECT fp, count(*) AS n FROM fps GROUP BY fp")
def fp_histogram(spark, d):
    return fingerprints.histogram(hashed(spark, d))


@query(f"WITH {_FP} SELECT vec_id, bits AS fp_bits FROM fps")
def fp_bits(spark, d):
    return hashed(spark, d).select("vec_id", fpf.to_bits(F.col("fp")).alias("fp_bits"))


@query(f"WITH {_FP} SELECT vec_id, printf('%016x', fp) AS fp_hex FROM fps")
def fp_hex(spark, d):
    return hashed(spark, d).select("vec_id", fpf.to_hex(F.col("fp")).alias("fp_hex"))


@query(f"WITH {_FP} SELECT vec_id, ltrim(bits, '0') AS short_bits, '0x' || printf('%x', fp) AS short_hex, fp AS fp_again, printf('%016x', fp) AS raw_hex FROM fps")
def fp_roundtrip(spark, d):
    hex_text = fpf.to_short_hex(F.col("fp"))
    return hashed(spark, d).select(
        "vec_id", fpf.hex_to_binary_text(hex_text).alias("short_bits"), hex_text.alias("short_hex"), fpf.from_hex(hex_text).alias("fp_again"), F.lower(F.hex(fpf.to_bytes(F.col("fp")))).alias("raw_hex")
    )


@query(f"WITH {_FP} SELECT vec_id, length(replace(bits, '0', '')) AS n_bits FROM fps")
def fp_popcount(spark, d):
    return hashed(spark, d).select("vec_id", fpf.popcount(F.col("fp")).alias("n_bits"))


@query(f"WITH {_FP}, p AS (SELECT *, lag(bits) OVER (PARTITION BY media_id ORDER BY vec_id) AS before FROM fps) SELECT media_id, frame_id, hamming(bits, before) AS distance FROM p WHERE before IS NOT NULL")
def fp_hamming_previous(spark, d):
    return fingerprints.distance_to_previous(fingerprint_table(spark, d)).select("media_id", "frame_id", "distance")


@query(f"""WITH {_FP}, ch AS (SELECT vec_id, unnest(string_split(printf('%016x', fp), '')) AS ch FROM fps),
p AS (SELECT vec_id, ch, count(*) / 16.0 AS p FROM ch WHERE ch <> '' GROUP BY vec_id, ch) SELECT vec_id, round(-sum(p * ln(p)), 9) + 0.0 AS entropy FROM p GROUP BY vec_id""")
def fp_entropy(spark, d):
    return hashed(spark, d).select("vec_id", F.round(fpf.entropy(fpf.to_hex(F.col("fp"))), 9).alias("entropy"))


def with_flips(frames: DataFrame) -> DataFrame:
    """Fingerprints (vec_id, fp), and of each one with 0 to 9 of its low 63 bits turned, by vec_id."""
    place = lambda j: F.pmod(F.col("vec_id") * 7 + j * 13, F.lit(63)).cast("int")
    bits = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda j: F.when(j < F.col("vec_id") % 10, F.call_function("shiftleft", F.lit(1).cast("bigint"), place(j))).otherwise(F.lit(0).cast("bigint")))
    mask = F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))
    return frames.select("fp").unionByName(frames.select(F.col("fp").bitwiseXOR(mask).alias("fp")))


@query(f"""WITH {_FP}, turned AS (SELECT xor(fp, CAST(coalesce(list_sum(list_transform(range(vec_id % 10), lambda j: CAST(1 AS HUGEINT) << CAST((vec_id * 7 + j * 13) % 63 AS INTEGER))), 0) AS BIGINT)) AS fp FROM fps),
one AS (SELECT fp FROM fps UNION SELECT fp FROM turned) SELECT a.fp AS a, b.fp AS b, CAST(bit_count(xor(a.fp, b.fp)) AS BIGINT) AS distance
FROM one a JOIN one b ON a.fp < b.fp WHERE bit_count(xor(a.fp, b.fp)) <= 7""")
def fp_near_pairs(spark, d):
    return fingerprints.near_pairs(with_flips(hashed(spark, d)), 7)


_KEYFRAMES = """, ordered AS (SELECT media_id, frame_id, fp, bits, row_number() OVER (PARTITION BY media_id ORDER BY frame_id) AS k FROM fps WHERE length(replace(bits, '0', '')) >= 16),
walk AS (SELECT media_id, k, frame_id, fp, bits AS last, true AS kept FROM ordered WHERE k = 1
  UNION ALL SELECT o.media_id, o.k, o.frame_id, o.fp, CASE WHEN hamming(o.bits, w.last) >= 32 THEN o.bits ELSE w.last END, hamming(o.bits, w.last) >= 32 FROM walk w JOIN ordered o ON o.media_id = w.media_id AND o.k = w.k + 1)"""


@query(f"WITH RECURSIVE {_FP}{_KEYFRAMES} SELECT media_id, frame_id + 1 AS id_frame, frame_id, fp FROM walk WHERE kept")
def important_frames(spark, d):
    return keyframes.keyframes(fingerprint_table(spark, d), 32, 16)


@query(f"""WITH RECURSIVE {_FP}{_KEYFRAMES}, kept AS (SELECT media_id, frame_id, printf('%016x', fp) AS fp_hex FROM walk WHERE kept),
ch AS (SELECT media_id, frame_id, fp_hex, unnest(string_split(fp_hex, '')) AS ch FROM kept), p AS (SELECT media_id, frame_id, fp_hex, ch, count(*) / 16.0 AS p FROM ch WHERE ch <> '' GROUP BY ALL)
SELECT media_id, frame_id, fp_hex, round(-sum(p * ln(p)), 9) + 0.0 AS entropy FROM p GROUP BY media_id, frame_id, fp_hex""")
def important_frames_entropy(spark, d):
    found = keyframes.described(keyframes.keyframes(fingerprint_table(spark, d), 32, 16))
    return found.select("media_id", "frame_id", "fp_hex", F.round("entropy", 9).alias("entropy"))


@query(f"WITH RECURSIVE {_FP}{_KEYFRAMES}, kept AS (SELECT media_id, frame_id FROM walk WHERE kept) SELECT media_id, frame_id, vec_id, fp FROM fps SEMI JOIN kept USING (media_id, frame_id)")
def keyframe_frames(spark, d):
    frames = fingerprint_table(spark, d)
    return keyframes.frames_of(keyframes.keyframes(frames, 32, 16).drop("fp").withColumn("fp", F.lit(None)), frames.withColumnRenamed("fp", "own")).select("media_id", "frame_id", "vec_id", F.col("own").alias("fp"))


@query(f"WITH {_FP} SELECT media_id, frame_id, '0x' || printf('%x', fp) AS fp_hex FROM fps WHERE frame_id < 10")
def frame_head10(spark, d):
    return fingerprints.head(fingerprint_table(spark, d), 10)


@query(f"WITH {_FP} SELECT media_id, frame_id, fp FROM fps WHERE frame_id BETWEEN 5 AND 40")
def frame_range(spark, d):
    return fingerprint_table(spark, d).where(tl.frame_range(F.col("frame_id"), 5, 40)).select("media_id", "frame_id", "fp")


@query(f"""WITH {_FP} SELECT media_id, '2' || chr(10) || count(*) || chr(10) || '64' || chr(10) || '0' || chr(10) || '1' || chr(10) || string_agg(bits, chr(10) ORDER BY first_at) AS value
FROM (SELECT media_id, ltrim(bits, '0') AS bits, min(frame_id) AS first_at FROM fps WHERE frame_id < 50 GROUP BY media_id, ltrim(bits, '0')) GROUP BY media_id""")
def instance_file(spark, d):
    from .sources.fingerprints import instance_lines

    return instance_lines(fingerprint_table(spark, d), 50)


@query(f"WITH {_FP} SELECT media_id, frame_id, fp FROM fps")
def fp_file_roundtrip(spark, d):
    from .sources.fingerprints import explode_records, pack_records

    return explode_records(pack_records(fingerprint_table(spark, d)))


@query(f"WITH {_FP}, s AS (SELECT media_id, count(*) AS n FROM fps GROUP BY media_id) SELECT media_id, md5('/films/' || media_id) AS media_key, n FROM s")
def media_keys(spark, d):
    from .sources.fingerprints import media_key

    sizes = _table(spark, d, "embeddings").groupBy(F.col("label").cast("string").alias("media_id")).agg(F.count("*").alias("n"))
    return sizes.select("media_id", media_key(F.concat(F.lit("/films/"), "media_id")).alias("media_key"), "n")


@query(f"""WITH {_FP}, p AS (SELECT CAST(media_id AS BIGINT) AS file_pos, frame_id, fp FROM fps)
SELECT file_pos, frame_id, fp, row_number() OVER (ORDER BY file_pos, frame_id) - 1 AS new_frame_id FROM p""")
def media_concat(spark, d):
    parts = fingerprint_table(spark, d).select(F.col("media_id").cast("bigint").alias("file_pos"), "frame_id", "fp")
    return fingerprints.concat_media(parts).select("file_pos", "frame_id", "fp", "new_frame_id")


def _inputs(spark, d) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").alias("file_pos"), F.col("lang").alias("vcodec"), F.lit("aac").alias("acodec"), F.col("source").alias("scale"))


@query("""WITH f AS (SELECT min_by(lang, doc_id) AS v, min_by(source, doc_id) AS s, count(*) AS n FROM documents),
x AS (SELECT doc_id, CASE WHEN lang IS DISTINCT FROM v THEN 'vcodec' WHEN source IS DISTINCT FROM s THEN 'scale' END AS differs FROM documents, f)
SELECT count(*) >= 2 AS enough, count(differs) = 0 AS homogeneous, min_by(differs, doc_id) FILTER (WHERE differs IS NOT NULL) AS differs, min(doc_id) FILTER (WHERE differs IS NOT NULL) AS file_pos FROM x""")
def media_homogeneous(spark, d):
    from .sources.media import homogeneous

    return homogeneous(_inputs(spark, d))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def probe_json_entry(spark, d):
    """An entry of the first stream of probe output made of each event's properties."""
    from .sources.media import parse_entries, stream_entry

    raw = F.concat(F.lit('{"streams":['), "props", F.lit(',{"k":"-1"}]}'))
    return _table(spark, d, "events").select("event_id", stream_entry(parse_entries(raw), 0, "k").try_cast("bigint").alias("k"))


@query("""SELECT event_id, (event_id % 7 + 1) * 320 || 'x' || (event_id % 5 + 1) * 200 AS scale, 'h26' || event_id % 6 AS vcodec, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'aac' END AS acodec FROM events WHERE event_id % 11 <> 0""")
def probe_streams(spark, d):
    """Scale and codecs out of probe output made for each event; every eleventh is broken and not valid."""
    from .sources.media import codec, parse_probe, valid_media, video_scale

    e = F.col("event_id")
    audio = F.when(e % 3 == 0, "").otherwise(',{"codec_type":"audio","codec_name":"aac"}')
    raw = F.concat(F.lit('{"streams":[{"codec_type":"video","codec_name":"h26'), e % 6, F.lit('","width":'), (e % 7 + 1) * 320, F.lit(',"height":'), (e % 5 + 1) * 200, F.lit("}"), audio, F.lit("]}"))
    media = _table(spark, d, "events").select("event_id", F.when(e % 11 == 0, "no such file").otherwise(raw).alias("probe"))
    s = parse_probe(F.col("probe"))
    return valid_media(media).select("event_id", video_scale(s).alias("scale"), codec(s, "video").alias("vcodec"), codec(s, "audio").alias("acodec"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS DOUBLE) / (24000.0 / 1001.0) WHEN 1 THEN CAST(event_id AS DOUBLE) / 25.0 END AS t FROM events""")
def frame_pts(spark, d):
    rate = F.element_at(F.array(F.lit("24000/1001"), F.lit("25/1"), F.lit("25/0"), F.lit("unknown")), (F.col("event_id") % 4 + 1).cast("int"))
    return _table(spark, d, "events").select("event_id", tl.frame_time(F.col("event_id"), rate).alias("t"))


@query("""SELECT user_id, event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t_rebased, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS n FROM events""")
def time_rebase(spark, d):
    events = _table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return fingerprints.rebase(events, "t", "user_id", "event_id").select("user_id", "event_id", "t_rebased", "n")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), n AS (SELECT user_id, sum(c) AS n FROM c GROUP BY user_id)
SELECT user_id, round(greatest(-sum(c / n * ln(c / n)), 0.0), 9) AS entropy FROM c JOIN n USING (user_id) GROUP BY user_id""")
def label_entropy(spark, d):
    found = fingerprints.group_entropy(_table(spark, d, "events"), ["user_id"], "event_type")
    return found.select("user_id", F.round("entropy", 9).alias("entropy"))


@query(f"WITH {_CUES} SELECT media_id, cue_pos, {_frame_sql('start_ms')} AS fs, {_frame_sql('end_ms')} AS fe, {_frame_sql('end_ms')} / 25.0::DOUBLE AS seconds FROM cues")
def cue_frames(spark, d):
    return cues.with_frames(cue_table(spark, d)).select("media_id", "cue_pos", "fs", "fe", tl.frame_to_seconds(F.col("fe")).alias("seconds"))


@query(f"WITH {_CUES} SELECT media_id, cue_pos, start_ms + 18160 AS start_ms, end_ms + 18160 AS end_ms FROM cues")
def cue_shift(spark, d):
    return cues.shift_cues(cue_table(spark, d), F.lit(18_160)).select("media_id", "cue_pos", "start_ms", "end_ms")


@query(f"WITH {_CUES} SELECT media_id, cue_pos, CAST(round_even(start_ms * (25.0::DOUBLE / 23.9::DOUBLE), 0) AS BIGINT) AS start_ms, CAST(round_even(end_ms * (25.0::DOUBLE / 23.9::DOUBLE), 0) AS BIGINT) AS end_ms FROM cues")
def cue_rescale(spark, d):
    ratio = 25.0 / 23.9
    return cue_table(spark, d).select("media_id", "cue_pos", tl.rescale(F.col("start_ms"), ratio).alias("start_ms"), tl.rescale(F.col("end_ms"), ratio).alias("end_ms"))


@query(f"""WITH {_CUES}, late AS (SELECT media_id, cue_pos, start_ms + 4321 AS start_ms FROM cues)
SELECT a.media_id, CAST(a.cue_pos - 2 AS INTEGER) AS pos, a.start_ms AS left_ms, b.start_ms AS right_ms, a.start_ms - b.start_ms AS difference_ms FROM late a JOIN cues b ON a.media_id = b.media_id AND a.cue_pos - 2 = b.cue_pos WHERE b.cue_pos < 100""")
def cue_align_offset(spark, d):
    own = cue_table(spark, d)
    return cues.pair_by_offset(cues.shift_cues(own, F.lit(4321)), own, 2, 100).select("media_id", F.col("pos").cast("int").alias("pos"), "left_ms", "right_ms", "difference_ms")


@query(f"""WITH {_CUES}, late AS (SELECT media_id, cue_pos, start_ms * 2 + 900 AS start_ms, end_ms * 2 + 900 AS end_ms FROM cues),
s AS (SELECT media_id, min_by(a.start_ms, a.cue_pos) - min_by(b.start_ms, b.cue_pos) AS delta FROM cues a JOIN late b USING (media_id, cue_pos) GROUP BY media_id)
SELECT media_id, cue_pos, start_ms + delta AS start_ms, end_ms + delta AS end_ms FROM late JOIN s USING (media_id)""")
def cue_sync(spark, d):
    own = cue_table(spark, d).select("media_id", "cue_pos", "start_ms", "end_ms")
    late = own.select("media_id", "cue_pos", (F.col("start_ms") * 2 + 900).alias("start_ms"), (F.col("end_ms") * 2 + 900).alias("end_ms"))
    return cues.shift_to_first_cue(late, own)


@query(f"WITH {_CUES}, {_SHOWN} SELECT media_id, cue_pos, cue_index, frame_id, frame_id * 7919 + length(media_id) AS fp, emit_seq FROM emitted")
def subtitle_fingerprints(spark, d):
    return _cue_fp(spark, d).withColumn("emit_seq", F.col("emit_seq").cast("bigint"))


@query(f"WITH {_CUES}, {_SHOWN} SELECT media_id, cue_pos, frame_id, emit_seq + 1 AS rn, emit_seq // 8 AS line FROM emitted")
def cue_rows_of_8(spark, d):
    return cues.rows_of(_cue_fp(spark, d), 8).select("media_id", "cue_pos", "frame_id", F.col("rn").cast("bigint").alias("rn"), "line")


@query(f"WITH {_CUES}, {_SHOWN} SELECT media_id, cue_pos, min_by(frame_id, emit_seq) AS first_frame, count(*) AS n_rows FROM emitted GROUP BY media_id, cue_pos")
def cue_first_frame(spark, d):
    return cues.first_frames(_cue_fp(spark, d))


@query(f"""WITH {_CUES}, {_SHOWN}, s AS (SELECT *, unnest(range(fs, least(fe, n - 1) + 1)) AS frame_id FROM spans0) SELECT media_id, cue_pos, frame_id FROM s""")
def cue_frames_clean(spark, d):
    return cues.cue_fingerprints(cue_table(spark, d), shown_frames(spark, d), mode="clean").select("media_id", "cue_pos", "frame_id")


@query(f"""WITH {_CUES}, t AS (SELECT *, cue_index || chr(10) || printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' ||
printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || chr(10) || text || chr(10) AS block FROM cues)
SELECT media_id, string_agg(block, chr(10) ORDER BY cue_pos) AS value FROM t GROUP BY media_id""")
def subtitle_file(spark, d):
    from .sources.subtitles import render_cues

    return render_cues(cue_table(spark, d))


@query(f"WITH {_CUES} SELECT media_id, cue_pos, cue_index, start_ms, end_ms FROM cues")
def subtitle_roundtrip(spark, d):
    from .sources.subtitles import parse_subtitles, render_cues

    lines = cue_table(spark, d).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    return parse_subtitles(render_cues(lines)).select("media_id", "cue_pos", "cue_index", "start_ms", "end_ms")


@query("SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS text FROM pages")
def text_clean_html(spark, d):
    return _table(spark, d, "pages").select("page_id", txt.clean_html(F.col("html")).alias("text"))


@query("SELECT page_id, replace(html, chr(10), ' ') AS line FROM pages")
def text_one_line(spark, d):
    return _table(spark, d, "pages").select("page_id", txt.one_line(F.col("html")).alias("line"))


@query("SELECT page_id, CASE WHEN contains(html, '<body') THEN split_part(split_part(html, '<body', 2), '<', 1) ELSE '' END AS found FROM pages")
def page_scrape(spark, d):
    return _table(spark, d, "pages").select("page_id", txt.after_marker(F.col("html"), "<body").alias("found"))


@query("SELECT page_id, url_encode(url) AS quoted FROM pages")
def url_quote(spark, d):
    return _table(spark, d, "pages").select("page_id", txt.quote_url(F.col("url")).alias("quoted"))


#: The entities that the pages hold, &amp; last so that nothing is unescaped twice; without its semicolon it counts too.
@query("""SELECT page_id, regexp_replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') AS text FROM pages""")
def html_unescape(spark, d):
    return _table(spark, d, "pages").select("page_id", txt.unescape_html(F.col("html")).alias("text"))


def _lines(spark, d) -> DataFrame:
    return cue_table(spark, d).select("media_id", "cue_pos", txt.one_line(F.col("text")).alias("line"))


@query(f"WITH {_CUES} SELECT media_id, CAST(cue_pos // 3 AS BIGINT) AS chunk, string_agg(replace(text, chr(10), ' '), '#' ORDER BY cue_pos) AS packed, count(*) AS n FROM cues WHERE text IS NOT NULL GROUP BY ALL")
def text_chunks(spark, d):
    return align.chunks(_lines(spark, d), "media_id", "cue_pos", "line", 3).select("media_id", "chunk", txt.pack(F.col("items")).alias("packed"), F.size("items").cast("bigint").alias("n"))


@query(f"""WITH {_CUES}, g AS (SELECT media_id, CAST(cue_pos // 3 AS BIGINT) AS chunk, list(replace(text, chr(10), ' ') ORDER BY cue_pos) AS l FROM cues GROUP BY ALL)
SELECT media_id, chunk, array_to_string(list_concat(l, list_transform(range(3 - len(l)), lambda i: 'x')), '#') AS packed FROM g""")
def text_chunks_padded(spark, d):
    return align.chunks(_lines(spark, d), "media_id", "cue_pos", "line", 3, fill="x").select("media_id", "chunk", txt.pack(F.col("items")).alias("packed"))


@query(f"""WITH {_CUES}, z AS (SELECT media_id, cue_pos, unnest(list_zip(string_split(replace(text, chr(10), ' '), ' '), string_split(cue_index || ' a b', ' '), true)) AS p FROM cues WHERE text IS NOT NULL)
SELECT media_id, cue_pos, p[1] AS source, p[2] AS target FROM z""")
def zip_texts(spark, d):
    pairs = align.zip_shortest(txt.unpack(F.col("line"), " "), F.split(F.concat("cue_index", F.lit(" a b")), " "))
    rows = cue_table(spark, d).where("text is not null").withColumn("line", txt.one_line(F.col("text")))
    return rows.select("media_id", "cue_pos", F.explode(pairs).alias("p")).select("media_id", "cue_pos", "p.source", "p.target")


_LE = "array_to_string(list_transform(string_split(source_text, ' '), lambda w: CASE w WHEN 'the' THEN 'le' WHEN 'of' THEN 'de' ELSE w END), ' ')"


@query(f"WITH {_CUES}, t AS (SELECT media_id, cue_pos, replace(text, chr(10), ' ') AS source_text FROM cues) SELECT media_id, cue_pos, source_text, {_LE} AS target_text FROM t")
def translate_stub(spark, d):
    return align.translated(cue_table(spark, d), {"the": "le", "of": "de"})


@query(f"WITH {_CUES}, t AS (SELECT media_id, cue_pos, replace(text, chr(10), ' ') AS source_text FROM cues) SELECT media_id, CAST(cue_pos AS BIGINT) AS cue_pos, source_text, {_LE} AS target_text FROM t")
def translate_chunks(spark, d):
    return align.translated_in_chunks(cue_table(spark, d), 15, words={"the": "le", "of": "de"})


def _titles(spark, d, size: int = 256) -> DataFrame:
    """Every benchmark text, whole, with every supplier: a text meets the blocks of about size names one by one, by the block's number."""
    names = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("title"))
    blocks = max(1, -(-names.count() // size))
    names = names.withColumn("block", F.pmod(F.xxhash64("pos"), F.lit(blocks)).cast("int"))
    texts = _table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return texts.repartition(4 * blocks, "item_id", "block").join(names, "block")


@query("""WITH c AS (SELECT item_id, s_suppkey AS pos, s_name AS title, -levenshtein(regexp_replace(text, '[^ -~]', '?', 'g'), regexp_replace(s_name, '[^ -~]', '?', 'g')) AS score FROM benchmark, supplier)
SELECT item_id, pos, title, score FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) = 1""")
def title_best_match(spark, d):
    """By edits; a letter beyond ASCII counts as '?' on either side, so that letters and bytes are one."""
    plain = lambda c: F.regexp_replace(c, "[^ -~]", "?")
    score = -F.levenshtein(plain("query"), plain("title")).cast("bigint")
    return align.best_match(_titles(spark, d), "item_id", "pos", score, "title")


@query()
def title_fuzzy_match(spark, d):
    scored = _titles(spark, d).withColumn("s", txt.similarity(F.col("query"), F.col("title")))
    return align.best_match(scored, "item_id", "pos", F.col("s"), "title")


@query("SELECT p_partkey, 'scale=w=' || p_size || ':h=' || p_size * 2 AS spec, 'file ''' || p_name || '''' || chr(10) AS line, p_size || 'x' || p_size * 2 AS scale FROM part")
def filter_string(spark, d):
    spec = FilterSpec("scale").with_option("w", F.col("p_size")).with_option("h", F.col("p_size") * 2)
    return _table(spark, d, "part").select("p_partkey", spec.as_column().alias("spec"), list_line(F.col("p_name")).alias("line"), F.concat_ws("x", "p_size", F.col("p_size") * 2).alias("scale"))


@query(f"""WITH {_FP}, s AS (SELECT media_id, count(*) AS n FROM fps GROUP BY media_id) SELECT media_id, 'gte(n\\,' || n // 4 || ')*lte(n\\,' || n // 2 || ')' AS expr, n // 2 - n // 4 + 1 AS n_frames FROM s""")
def select_expression(spark, d):
    frames = fingerprint_table(spark, d)
    n = frames.groupBy("media_id").agg(F.count("*").alias("n")).select("media_id", F.expr("n div 4").alias("a"), F.expr("n div 2").alias("b"))
    expr = F.format_string(tl.select_expression(0, 1).replace(",0)", ",%d)").replace(",1)", ",%d)"), "a", "b")
    kept = frames.join(n, "media_id").where(F.col("frame_id").between(F.col("a"), F.col("b")))
    return kept.groupBy("media_id", expr.alias("expr")).agg(F.count("*").alias("n_frames"))


_BASIS = "2 * cos(pi() * k * (2 * x + 1) / 64.0::DOUBLE)"


@query(f"""WITH tone AS (SELECT vec_id, list_transform(embedding, lambda v: CAST((CAST(floor(v * 1000.0::FLOAT) AS BIGINT) % 256 + 256) % 256 AS DOUBLE)) AS t FROM embeddings),
rows2 AS (SELECT vec_id, l, list_sum(list_transform(range(32), lambda x: {_BASIS.replace("k", "l")} * t[x + 1])) AS r0, list_sum(list_transform(range(32), lambda x: {_BASIS.replace("k", "l")} * t[x + 33])) AS r1 FROM tone, range(8) g(l)),
lines AS (SELECT k, list_sum(list_transform(range(0, 32, 2), lambda x: {_BASIS})) AS even, list_sum(list_transform(range(1, 32, 2), lambda x: {_BASIS})) AS odd FROM range(8) g(k)),
c AS (SELECT vec_id, k * 8 + l AS i, round(even * r0 + odd * r1, 6) AS c FROM rows2, lines), m AS (SELECT vec_id, median(c) AS m FROM c GROUP BY vec_id)
SELECT vec_id, CAST(sum(CASE WHEN c > m AND i > 0 THEN CAST(1 AS HUGEINT) << CAST(63 - i AS INTEGER) ELSE 0 END) - sum(CASE WHEN c > m AND i = 0 THEN 9223372036854775808 ELSE 0 END) AS BIGINT) AS fp FROM c JOIN m USING (vec_id) GROUP BY vec_id""")
def frame_phash(spark, d):
    """Perceptual hashes of 32x32 grey frames made from the embeddings."""
    from .functions.phash import phash

    tone = F.transform("embedding", lambda x: F.pmod(F.floor(x * 1000), F.lit(256)))
    gray = F.unhex(F.array_join(F.flatten(F.array_repeat(F.transform(tone, lambda t: F.lpad(F.hex(t), 2, "0")), 16)), ""))
    return _table(spark, d, "embeddings").select("vec_id", phash(gray).alias("fp"))


@query(f"WITH {_FP} SELECT fp, count(*) AS n FROM fps GROUP BY fp")
def stream_histogram(spark, d):
    """The histogram over a stream of fingerprint files, run to its end."""
    return _streamed(spark, d, "histogram")


@query(f"WITH RECURSIVE {_FP}{_KEYFRAMES} SELECT media_id, frame_id + 1 AS id_frame, frame_id, fp FROM walk WHERE kept")
def stream_keyframes(spark, d):
    """Keyframes over a stream of fingerprint files, run to its end."""
    return _streamed(spark, d, "keyframes")


def _streamed(spark: SparkSession, d: str, what: str) -> DataFrame:
    import uuid

    from .streaming.keyframes import streaming_histogram, streaming_keyframes

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    shared = shared or spark.conf.get("spark.sql.warehouse.dir")
    root = f"{shared}/framewright-stream-{uuid.uuid4().hex}"
    table = fingerprint_table(spark, d).select("media_id", "frame_id", "fp")
    table.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{root}/in")
    out = streaming_histogram(stream) if what == "histogram" else streaming_keyframes(stream, 32, 16)
    if what == "histogram":
        # update mode: a fingerprint's last count is its largest
        run = out.writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("append").parquet(f"{root}/out"))
    else:
        run = out.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
    run.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(out.schema).parquet(f"{root}/out")
    return done.groupBy("fp").agg(F.max("n").alias("n")) if what == "histogram" else done
