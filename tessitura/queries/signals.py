"""Array columns and rendered-item quality: ``embeddings`` as signals and vectors, ``lineitem`` and ``events`` as timings."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import arrays as A
from ..functions.numbers import seconds_of
from ..operators import quality as Z
from ..plans import packaging as Package
from ..session import work_folder, written
from ..sources.readers import read_delimited, read_loose_records
from ..sources.tables import balanced, read_table
from .registry import query
from .scores import rounded

FR = 4


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings")


FRAMES = """fr AS (SELECT vec_id, (i // 4) AS frame, sqrt(avg(x * x)) AS rms FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY ALL),
    db AS (SELECT vec_id, frame, 20 * log10(greatest(rms, 1e-10)) AS db FROM fr)"""


@query("n1_frame_levels", f"WITH {FRAMES} SELECT vec_id, frame::INT AS frame, round(db, 6) AS db FROM db")
def n1_frame_levels(spark, sf):
    v = vectors(spark, sf).select("vec_id", F.posexplode(A.frame_levels(F.col("embedding"), F.lit(FR))).alias("frame", "db"))
    return rounded(v)


@query("w11_internal_silence", f"""WITH {FRAMES}, s AS (SELECT vec_id, frame, db < -19 AS silent FROM db), e AS (SELECT vec_id, min(frame) AS a, max(frame) AS b FROM s WHERE NOT silent GROUP BY 1),
    g AS (SELECT s.vec_id, frame - row_number() OVER (PARTITION BY s.vec_id ORDER BY frame) AS island FROM s JOIN e USING (vec_id) WHERE silent AND frame BETWEEN a AND b),
    r AS (SELECT vec_id, count(*) AS run FROM g GROUP BY vec_id, island), m AS (SELECT vec_id, max(run) AS run FROM r GROUP BY 1)
    SELECT v.vec_id, round(CASE WHEN e.vec_id IS NULL THEN len(embedding) // 4 ELSE coalesce(m.run, 0) END * 4 / 100.0, 6)::DOUBLE AS silence_s FROM embeddings v LEFT JOIN e USING (vec_id) LEFT JOIN m USING (vec_id)""")
def w11_internal_silence(spark, sf):
    s = A.longest_internal_silence(F.col("embedding"), F.lit(100), 0.04, -19.0)
    return rounded(vectors(spark, sf).select("vec_id", s.cast("double").alias("silence_s")))


@query("n2_peak_normalize", """SELECT vec_id, round((x / greatest(0.01, max(abs(x)) OVER (PARTITION BY vec_id)))::FLOAT::DOUBLE, 5) AS x, i::INT AS i
    FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)""")
def n2_peak_normalize(spark, sf):
    v = vectors(spark, sf).select("vec_id", F.posexplode(A.peak_normalize(F.col("embedding"))).alias("i", "x"))
    return v.select("vec_id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


@query("n3_fit_frames", """SELECT vec_id, CASE WHEN label % 2 = 0 THEN 70 ELSE 60 END AS samples, round(list_sum(embedding[1:60])::DOUBLE, 4) AS head,
    round(CASE WHEN label % 2 = 0 THEN list_sum(embedding[61:64])::DOUBLE ELSE 0 END, 4) AS tail FROM embeddings""")
def n3_fit_frames(spark, sf):
    fitted = A.fit_frames(F.col("embedding"), F.when(F.col("label") % 2 == 0, 7).otherwise(6), 10)
    v = vectors(spark, sf).select("vec_id", fitted.alias("x"))
    return v.select("vec_id", F.size("x").alias("samples"), F.round(A.total(F.slice("x", 1, 60)), 4).alias("head"),
                    F.round(F.when(F.size("x") > 60, A.total(F.slice("x", 61, 10))).otherwise(0.0), 4).alias("tail"))


@query("n4_j12_similarity_to_reference", """WITH r AS (SELECT label, vec_id, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5),
    m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM r) GROUP BY ALL),
    n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY 1),
    x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)
    SELECT vec_id, label, round(sum(x * m / norm) / sqrt(sum(x * x)), 6) AS similarity FROM x JOIN m USING (label, i) JOIN n USING (label) GROUP BY ALL""")
def n4_j12_similarity_to_reference(spark, sf):
    v = vectors(spark, sf)
    refs = Z.reference_vectors(v, ["label"], ["vec_id"], "embedding", 5)
    return rounded(v.join(refs, "label").select("vec_id", "label", A.dot(A.unit(F.col("embedding")), F.col("reference")).alias("similarity")))


@query("n5_contour_correlation", """WITH a AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
    p AS (SELECT a.vec_id, a.x, b.x AS y FROM a JOIN a b ON b.vec_id = a.vec_id + 1 AND a.i = b.i WHERE a.x > 0 AND b.x > 0)
    SELECT vec_id, CASE WHEN count(*) < 16 THEN 'too_few_voiced' ELSE 'ok' END AS status, round(CASE WHEN count(*) >= 16 THEN corr(x, y) END, 5) AS correlation FROM p GROUP BY 1""")
def n5_contour_correlation(spark, sf):
    voiced = F.transform("embedding", lambda x: F.when(x > 0, x.cast("double")).otherwise(float("nan")))
    a = vectors(spark, sf).select("vec_id", voiced.alias("a"))
    pairs = a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    r = A.contour_correlation(F.col("a"), F.col("b"), 16)
    return pairs.select("vec_id", r["status"].alias("status"), F.round(r["correlation"], 5).alias("correlation"))


@query("n6_pitch_range", """WITH t AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
    s AS (SELECT label, vec_id, i, CASE WHEN x > 0 THEN 12 * log2((x * 1000 + 60) / 100) END AS st FROM t),
    d AS (SELECT label, st, abs(st - lag(st) OVER (PARTITION BY vec_id ORDER BY i)) AS step FROM s)
    SELECT label, round(quantile_cont(st, 0.9) - quantile_cont(st, 0.1), 5) AS range_st, round(quantile_cont(step, 0.5), 5) AS step_st, round(100 * pow(2, quantile_cont(st, 0.5) / 12), 4) AS median_hz FROM d GROUP BY 1""")
def n6_pitch_range(spark, sf):
    from ..operators.ordering import exact_quantiles
    track = F.transform("embedding", lambda x: F.when(x > 0, x.cast("double") * 1000 + 60).otherwise(float("nan")))
    st = vectors(spark, sf).select("label", A.semitones(track).alias("st"))
    tones = exact_quantiles(st.select("label", F.explode("st").alias("v")), ["label"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    steps = exact_quantiles(st.select("label", F.explode(A.step_sizes(F.col("st"))).alias("v")), ["label"], "v", {"step_st": 0.5})
    return tones.join(steps, "label").select("label", F.round(F.col("p90") - F.col("p10"), 5).alias("range_st"), F.round("step_st", 5).alias("step_st"),
                                             F.round(100 * F.pow(F.lit(2.0), F.col("p50") / 12), 4).alias("median_hz"))


@query("n7_speech_span", """WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
    fr AS (SELECT vec_id, i // 4 AS f, 10 * log10(avg(x * x) + 1e-12) AS db FROM t GROUP BY ALL), q AS (SELECT vec_id, quantile_cont(db, 0.95) AS loud, quantile_cont(db, 0.10) AS quiet FROM fr GROUP BY 1),
    m AS (SELECT vec_id, f FROM fr JOIN q USING (vec_id) WHERE db > quiet + 0.4 * (loud - quiet))
    SELECT vec_id, count(*) AS speech_frames, max(f) - min(f) + 1 AS active_frames FROM m GROUP BY 1""")
def n7_speech_span(spark, sf):
    mask = vectors(spark, sf).select("vec_id", A.speech_mask(A.energy_levels(F.col("embedding"), F.lit(FR))).alias("m"))
    return mask.select("vec_id", A.count_true(F.col("m")).cast("bigint").alias("speech_frames"), A.active_span(F.col("m")).cast("bigint").alias("active_frames"))


@query("n8_top_label", """SELECT event_id, CASE WHEN value >= event_id % 97 AND value >= 20 THEN 'a' WHEN event_id % 97 >= 20 THEN 'b' ELSE 'c' END AS top FROM events""")
def n8_top_label(spark, sf):
    scores = F.create_map(F.lit("a"), F.col("value"), F.lit("b"), (F.col("event_id") % 97).cast("double"), F.lit("c"), F.lit(20.0))
    return read_table(spark, sf, "events").select("event_id", A.top_label(scores).alias("top"))


@query("c18_rescaled_durations", """WITH d AS (SELECT vec_id, label, unnest(range(0, 64)) AS i, (vec_id * 7 + unnest(range(0, 64)) * 13) % 15 AS d FROM embeddings),
    c AS (SELECT vec_id, i, sum(d) OVER (PARTITION BY vec_id ORDER BY i) AS s, (CASE WHEN label % 2 = 0 THEN 16000 ELSE 24000 END) AS rate FROM d),
    b AS (SELECT vec_id, i, ((2 * s * 22050 + rate) // (2 * rate))::BIGINT AS edge FROM c)
    SELECT vec_id, i::INT AS i, edge - coalesce(lag(edge) OVER (PARTITION BY vec_id ORDER BY i), 0) AS frames FROM b""")
def c18_rescaled_durations(spark, sf):
    d = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.col("vec_id") * 7 + i * 13) % 15)
    out = A.rescale_durations(d, F.when(F.col("label") % 2 == 0, 16000).otherwise(24000))
    return vectors(spark, sf).select("vec_id", F.posexplode(out).alias("i", "frames"))


@query("c20_ctc_collapse", """WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
    s AS (SELECT vec_id, i, CASE WHEN x > 0.1 THEN 2 WHEN x > 0 THEN 1 ELSE 0 END AS c FROM t), l AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM s)
    SELECT vec_id, list(c ORDER BY i)::INT[] AS ids FROM l WHERE c <> 0 AND (p IS NULL OR p <> c) GROUP BY 1""")
def c20_ctc_collapse(spark, sf):
    ids = F.transform("embedding", lambda x: F.when(x > 0.1, 2).when(x > 0, 1).otherwise(0))
    out = vectors(spark, sf).select("vec_id", A.ctc_collapse(ids, 0).alias("ids"))
    return out.filter(F.size("ids") > 0)


# Stand-in timings: document words as symbols, their first letter as ID and their length as frames.
TIMED = """w AS (SELECT doc_id, lang, string_split(regexp_replace(lower(text), '[^\\p{L} ]', '', 'g'), ' ') AS words FROM documents),
    t AS (SELECT doc_id, lang, unnest(words) AS word FROM w), sym AS (SELECT doc_id, lang, unicode(word) AS symbol, ln(1 + length(word)) AS x FROM t WHERE word <> '')"""


# First letters that count as symbols: the Latin letters of the table's languages.
LETTER_IDS = list(range(97, 123)) + list(range(0xDF, 0x100))


def timings(spark: SparkSession, sf: str) -> DataFrame:
    """Padded symbol and duration arrays per document."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L} ]", ""), " "), lambda w: w != "")
    d = balanced(read_table(spark, sf, "documents").select("doc_id", "lang", "text")).select(
        F.col("doc_id").alias("id"), F.col("lang").alias("teacher"), words.alias("w"))
    pad = lambda inner, first, last: F.concat(F.array(F.lit(first), F.lit(0)), F.flatten(F.transform("w", lambda w: F.array(inner(w), F.lit(0)))), F.array(F.lit(last)))
    return d.select("id", "teacher", pad(F.ascii, 1, 2).alias("ids"), pad(F.char_length, 9, 9).alias("durations"))


@query("w9_c19_duration_outliers", f"""WITH {TIMED}, st AS (SELECT lang, symbol, avg(x) AS m, stddev_pop(x) AS sd FROM sym GROUP BY ALL HAVING count(*) >= 30 AND min(x) < max(x)),
    z AS (SELECT doc_id, max((x - m) / sd) AS z FROM sym JOIN st USING (lang, symbol) GROUP BY 1) SELECT doc_id AS id, round(z, 6) AS z FROM z WHERE z > 3.0""")
def w9_c19_duration_outliers(spark, sf):
    return rounded(Z.duration_outliers(timings(spark, sf), LETTER_IDS, 3.0, 30))


@query("w10_drop_reasons", f"""WITH {TIMED}, st AS (SELECT lang, symbol, avg(x) AS m, stddev_pop(x) AS sd FROM sym GROUP BY ALL HAVING count(*) >= 30 AND min(x) < max(x)),
    z AS (SELECT doc_id, max((x - m) / sd) AS z FROM sym JOIN st USING (lang, symbol) GROUP BY 1 HAVING max((x - m) / sd) > 3.0)
    SELECT d.doc_id AS id, CASE WHEN z.z IS NOT NULL THEN 'duration_outlier' ELSE 'internal_silence' END AS reason, round(CASE WHEN z.z IS NOT NULL THEN z.z ELSE n_chars / 1000.0 END, 6)::DOUBLE AS value
    FROM documents d LEFT JOIN z USING (doc_id) WHERE z.z IS NOT NULL OR n_chars / 1000.0 > 5""")
def w10_drop_reasons(spark, sf):
    outliers = Z.duration_outliers(timings(spark, sf), LETTER_IDS, 3.0, 30)
    items = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return rounded(Z.drop_reasons(items, outliers, F.col("n_chars") / 1000.0, 5.0))


PACKING = Package.PackagingOptions(duration_z=3.0, min_symbol_count=30, max_silence_s=5.0, shard_bytes=60_000, flag_fraction=0.2, seed=7)
PACKED = f"""{TIMED}, st AS (SELECT lang, symbol, avg(x) AS m, stddev_pop(x) AS sd FROM sym GROUP BY ALL HAVING count(*) >= 30 AND min(x) < max(x)),
    z AS (SELECT doc_id FROM sym JOIN st USING (lang, symbol) GROUP BY 1 HAVING max((x - m) / sd) > 3.0),
    dr AS (SELECT doc_id, CASE WHEN doc_id IN (FROM z) THEN 'duration_outlier' WHEN n_chars / 1000.0 > 5 THEN 'internal_silence' END AS reason FROM documents)"""


def packaged(spark: SparkSession, sf: str) -> str:
    """Documents as rendered items, checked, packed and written; returns the folder."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = timings(spark, sf).withColumnRenamed("id", "doc_id").join(d, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("x").alias("audio"), F.col("lang").alias("language"), F.col("lang").alias("espeak"), F.col("source").alias("speaker"),
        F.lit("clean").alias("condition"), F.col("ids").alias("phoneme_ids"), "durations", F.lit("t").alias("text"), "teacher", F.lit(1.0).alias("weight"),
        (F.col("n_chars") / 15).alias("seconds"))
    folder = work_folder(spark, "package")
    items = written(rows, "rendered")
    Package.write_package(Package.package(items, LETTER_IDS, F.col("seconds") * 15 / 1000.0, F.round(F.col("seconds") * 15), PACKING), folder)
    return folder


@query("packing_flow_shards", f"""WITH RECURSIVE {PACKED}, o AS (SELECT doc_id::VARCHAR AS id, n_chars AS size, row_number() OVER w AS rank, sum(n_chars) OVER w AS tot FROM documents JOIN dr USING (doc_id)
      WHERE reason IS NULL WINDOW w AS (ORDER BY sha256(concat_ws(':', 7, doc_id)), doc_id::VARCHAR)),
    starts AS (SELECT min(rank) AS rank, 0 AS shard FROM o HAVING count(*) > 0 UNION ALL
      SELECT (SELECT min(greatest(n.rank, s.rank + 1)) FROM o n WHERE n.tot > a.tot - a.size + 60000), s.shard + 1 FROM starts s JOIN o a ON a.rank = s.rank
      WHERE EXISTS (SELECT 1 FROM o n WHERE n.rank > s.rank AND n.tot > a.tot - a.size + 60000)),
    m AS (SELECT o.id, o.rank, max(s.shard) AS shard FROM o JOIN starts s ON s.rank <= o.rank GROUP BY ALL)
    SELECT 'shard-' || lpad(shard::VARCHAR, 5, '0') AS shard, count(*) AS records, min(id::BIGINT) AS lowest, max(id::BIGINT) AS highest FROM m GROUP BY shard""")
def packing_flow_shards(spark, sf):
    """The whole flow, read back from its files."""
    back = read_loose_records(spark, f"{packaged(spark, sf)}/shards/*/*.json")
    k = F.col("id").cast("bigint")
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("records"), F.min(k).alias("lowest"), F.max(k).alias("highest")).withColumn(
        "shard", F.regexp_replace("shard", "^shard=", ""))


@query("packing_flow_report", f"""WITH {PACKED} SELECT lang AS teacher, count(*) AS rendered, count_if(reason IS NULL) AS kept, count_if(reason = 'duration_outlier') AS duration_outlier,
    count_if(reason = 'internal_silence') AS internal_silence, printf('%.3f', sum(n_chars) FILTER (reason IS NULL) / 15 / 3600) AS kept_hours,
    count_if(reason IS NOT NULL) / count(*) > 0.2 AS flagged FROM documents JOIN dr USING (doc_id) GROUP BY 1""")
def packing_flow_report(spark, sf):
    rows = read_delimited(spark, f"{packaged(spark, sf)}/reports/filter", "teacher string, rendered bigint, kept bigint, kept_hours string, duration_outlier bigint, "
                          "internal_silence bigint, unaligned bigint, flagged boolean", exact=True)
    return rows.select("teacher", "rendered", "kept", "duration_outlier", "internal_silence", "kept_hours", "flagged")


@query("c21_seconds", """SELECT l_orderkey, l_linenumber, round_even(least(l_partkey * 100 / (16000.0::DOUBLE + l_linenumber), 30), 4) AS seconds FROM lineitem""")
def c21_seconds(spark, sf):
    return read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", seconds_of(F.col("l_partkey") * 100, F.lit(16000) + F.col("l_linenumber"), cap=30).alias("seconds"))


METRICS = {"voice": "c_name", "espeak": "concat('n', CAST(c_nationkey AS STRING), '-x')", "sample_rate": "CASE WHEN c_custkey % 5 = 0 THEN 16000 ELSE 22050 END",
           "bandwidth_khz": "CAST(c_custkey % 12 AS DOUBLE)", "snr_db": "CAST(c_custkey % 61 AS DOUBLE)", "f0_range_st": "c_acctbal / 1000", "phonemes_per_s": "abs(c_acctbal) / 500"}


@query("a27_voice_flags", "WITH m AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in METRICS.items()).replace("STRING", "VARCHAR") + """ FROM customer),
    r AS (SELECT split_part(espeak, '-', 1) AS lang, quantile_cont(phonemes_per_s, 0.5) AS rate FROM m GROUP BY 1), t AS (SELECT quantile_cont(snr_db, 0.15) AS snr, quantile_cont(f0_range_st, 0.15) AS rng FROM m)
    SELECT voice, concat_ws('; ', CASE WHEN sample_rate < 22050 THEN '16 kHz' WHEN bandwidth_khz < 8.5 THEN 'band-limited' END, CASE WHEN snr_db < snr THEN 'noisy?' END,
      CASE WHEN f0_range_st < rng THEN 'monotone?' END, CASE WHEN phonemes_per_s < 0.8 * rate THEN 'slow?' END, CASE WHEN phonemes_per_s > 1.2 * rate THEN 'fast?' END) AS flags
    FROM m JOIN r ON r.lang = split_part(m.espeak, '-', 1), t""")
def a27_voice_flags(spark, sf):
    m = read_table(spark, sf, "customer").select(*[F.expr(e).alias(c) for c, e in METRICS.items()])
    return Z.voice_flags(m).select("voice", "flags")


@query("a28_speaker_medians", """SELECT user_id, round(quantile_cont(value, 0.5), 6) AS value, round(quantile_cont(event_id % 1000, 0.5), 6) AS place FROM events GROUP BY 1""")
def a28_speaker_medians(spark, sf):
    e = read_table(spark, sf, "events").select("user_id", "value", (F.col("event_id") % 1000).alias("place"))
    return rounded(Z.medians(e, ["user_id"], ["value", "place"]))
