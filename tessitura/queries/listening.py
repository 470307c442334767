"""Listening material and preference statistics over ``supplier``, ``customer`` and ``orders``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import unit_hash
from ..operators import listening as L
from ..operators import stats as St
from ..sources.tables import read_table
from . import sql as Q
from .registry import query


def voices(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "supplier").select(
        F.concat(F.lit("n"), (F.col("s_nationkey") % 5).cast("string")).alias("lang"), F.col("s_name").alias("voice"), F.abs("s_acctbal").alias("rate"), "s_suppkey")


VOICES = "v AS (SELECT 'n' || (s_nationkey % 5) AS lang, s_name AS voice, abs(s_acctbal) AS rate, s_suppkey FROM supplier)"
PAIRS = f"""{VOICES}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws(':', 9, voice))) AS at FROM v),
    p AS (SELECT a.lang, a.voice AS a, b.voice AS b FROM r a JOIN r b ON a.lang = b.lang AND b.at BETWEEN a.at + 1 AND a.at + 6)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return L.neighbour_pairs(voices(spark, sf), "lang", "voice", 6, seed=9)


@query("j9_same_group_pairs", f"WITH {PAIRS} SELECT * FROM p")
def j9_same_group_pairs(spark, sf):
    return pairs(spark, sf)


QUEUE = f"""{PAIRS}, sw AS (SELECT lang, CASE WHEN {Q.unit("concat_ws(':', 4, 'side', a, b)")} < 0.5 THEN b ELSE a END AS a,
      CASE WHEN {Q.unit("concat_ws(':', 4, 'side', a, b)")} < 0.5 THEN a ELSE b END AS b, 'same language' AS kind FROM p),
    rp AS (SELECT lang, b AS a, a AS b, kind || ', repeat' AS kind FROM sw QUALIFY row_number() OVER (ORDER BY sha256(concat_ws(':', '4:repeat', a, b)), a, b) <= floor((SELECT count(*) FROM sw) * 0.1)),
    q AS (SELECT *, row_number() OVER (ORDER BY sha256(concat_ws(':', '4:queue', a, b, kind)), a, b, kind) - 1 AS id FROM (SELECT * FROM sw UNION ALL SELECT * FROM rp))"""


def queue(spark: SparkSession, sf: str) -> DataFrame:
    return L.pair_queue(pairs(spark, sf), seed=4)


@query("w22_pair_queue", f"WITH {QUEUE} SELECT lang, a, b, kind, id FROM q")
def w22_pair_queue(spark, sf):
    return queue(spark, sf)


@query("w21_tempo_pairs", f"""WITH {VOICES}, o AS (SELECT lang, voice, rate, row_number() OVER (PARTITION BY lang ORDER BY rate, voice) AS at FROM v WHERE rate > 0),
    bands(band, low, high, n) AS (VALUES (0, 1.25, 9.0, 8), (1, 1.10, 1.20, 6), (2, 1.0, 1.04, 6)),
    f AS (SELECT s.lang, band, n, s.voice AS slow, q.voice AS fast, q.rate / s.rate AS ratio, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY s.lang, band) AS fitting
      FROM o s JOIN o q ON q.lang = s.lang AND q.at > s.at JOIN bands ON q.rate >= s.rate * low::DOUBLE AND q.rate < s.rate * high::DOUBLE WINDOW w AS (PARTITION BY s.lang, band ORDER BY s.at, q.at)),
    d AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY sha256(concat_ws(':', 2, band, lang))) AS place FROM f
      WHERE k = least(floor({Q.unit("concat_ws(':', 2, 'pair', band, lang)")} * fitting)::BIGINT, fitting - 1)),
    c AS (SELECT *, {Q.unit("concat_ws(':', 2, 'side', slow, fast)")} < 0.5 AS side FROM d WHERE place <= n),
    p AS (SELECT lang, band, fitting, round(ratio, 2) AS ratio, CASE WHEN side THEN slow ELSE fast END AS a, CASE WHEN side THEN fast ELSE slow END AS b,
      CASE WHEN ratio < 1.04 THEN 'close' WHEN side THEN 'B' ELSE 'A' END AS expect FROM c)
    SELECT *, row_number() OVER (ORDER BY sha256(concat_ws(':', '2:queue', a, b, band)), a, b, band) - 1 AS id FROM p""")
def w21_tempo_pairs(spark, sf):
    return L.tempo_pairs(voices(spark, sf), "lang", "voice", "rate", seed=2)


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in answers: a hash decides, the expected side by the rates."""
    u = unit_hash(6, F.col("a"), F.col("b"), F.col("kind"))
    rate = voices(spark, sf).select(F.col("voice"), F.col("rate"))
    a, b = (rate.select(F.col("voice").alias(s), F.col("rate").alias(f"r{s}")) for s in "ab")
    ratio = F.greatest("ra", "rb") / F.least("ra", "rb")
    return queue(spark, sf).join(a, "a").join(b, "b").select(
        "a", "b", "lang", F.when(u < 0.4, "A").when(u < 0.8, "B").otherwise("tie").alias("answer"),
        F.when(F.col("kind").contains("repeat"), F.lit(None)).when(ratio < 1.1, "close").when(F.col("ra") > F.col("rb"), "A").otherwise("B").alias("expect"))


ANSWERS = f"""{QUEUE}, u AS (SELECT q.*, {Q.unit("concat_ws(':', 6, q.a, q.b, kind)")} AS u, x.rate AS ra, y.rate AS rb FROM q JOIN v x ON x.voice = q.a JOIN v y ON y.voice = q.b),
    an AS (SELECT a, b, lang, CASE WHEN u < 0.4 THEN 'A' WHEN u < 0.8 THEN 'B' ELSE 'tie' END AS answer,
      CASE WHEN contains(kind, 'repeat') THEN NULL WHEN greatest(ra, rb) / least(ra, rb) < 1.1 THEN 'close' WHEN ra > rb THEN 'A' ELSE 'B' END AS expect FROM u)"""


@query("e13_listener_consistency", f"""WITH {ANSWERS}, w AS (SELECT least(a, b) AS x, greatest(a, b) AS y, CASE answer WHEN 'tie' THEN 'tie' WHEN 'A' THEN a ELSE b END AS won FROM an),
    g AS (SELECT count(*) AS n, count(DISTINCT won) AS k FROM w GROUP BY x, y) SELECT count(*) AS repeated, count_if(k = 1) AS agree FROM g WHERE n > 1""")
def e13_listener_consistency(spark, sf):
    return St.listener_consistency(answers(spark, sf))


@query("e14_metric_agreement", f"""WITH {ANSWERS} SELECT count_if(expect <> 'close') AS clear, count_if(expect <> 'close' AND answer = expect) AS agree,
    count_if(expect = 'close') AS close, count_if(expect = 'close' AND answer = 'tie') AS heard_tie FROM an""")
def e14_metric_agreement(spark, sf):
    return St.metric_agreement(answers(spark, sf))


@query("e12_preference_strengths")
def e12_preference_strengths(spark, sf):
    return St.preference_strengths(answers(spark, sf), tolerance=1e-7).select("key", F.round("strength", 5).alias("strength"), "played")


MANIFEST = """m AS (SELECT 'v' || (c_custkey // 3) AS voice, '0' AS speaker, 'l' || ((c_custkey // 3) % 7) || '-x' AS espeak, (c_custkey % 3) AS idx, '/' || c_name AS file FROM customer)"""


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    third = F.floor(F.col("c_custkey") / 3).cast("bigint")
    return read_table(spark, sf, "customer").select(
        F.concat(F.lit("v"), third.cast("string")).alias("voice"), F.lit("0").alias("speaker"),
        F.concat(F.lit("l"), (third % 7).cast("string"), F.lit("-x")).alias("espeak"), (F.col("c_custkey") % 3).alias("idx"), F.concat(F.lit("/"), "c_name").alias("file"))


@query("w23_verdict_page", f"""WITH {MANIFEST}, f AS (SELECT *, split_part(espeak, '-', 1) AS lang, voice || '|' || speaker AS key FROM m WHERE idx = 0),
    s AS (SELECT lang, count(*) AS voices FROM f GROUP BY 1), g AS (SELECT lang, voices, row_number() OVER (ORDER BY voices DESC, lang) AS page FROM s)
    SELECT page, lang, voices, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws(':', 11, key)), key) - 1 AS place, key, file FROM f JOIN g USING (lang)""")
def w23_verdict_page(spark, sf):
    return L.verdict_page(manifest(spark, sf), seed=11)


@query("w24_spaced_speakers", f"""WITH r AS (SELECT s_nationkey, s_name, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS rn, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
    SELECT s_nationkey, regexp_replace(s_name, '[/ ]', '_', 'g') AS speaker, s_suppkey AS sid FROM r WHERE rn % greatest(n // 4, 1) = 0 AND rn // greatest(n // 4, 1) < 4""")
def w24_spaced_speakers(spark, sf):
    return L.spaced_speakers(read_table(spark, sf, "supplier").select("s_nationkey", "s_name", "s_suppkey"), "s_nationkey", "s_name", "s_suppkey")


@query("w25_verdict_clips", """WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS idx FROM documents)
    SELECT 'run1~' || source || '~' || lang AS voice, '0' AS speaker, lang AS espeak, idx, 'run1~' || source || '~' || lang || '__0__' || idx || '.wav' AS file FROM r WHERE idx < 3""")
def w25_verdict_clips(spark, sf):
    rows = read_table(spark, sf, "documents").select(
        F.col("source").alias("voice"), F.lit("0").alias("speaker"), F.col("lang").alias("espeak"), F.col("doc_id").alias("idx"), F.col("doc_id").cast("string").alias("path"), F.lit("").alias("text"))
    return L.verdict_clips(rows, "run1").select("voice", "speaker", "espeak", F.col("idx").cast("bigint").alias("idx"), "file")


@query("w26_blind_groups", f"""WITH i AS (SELECT source AS voice, '0' AS speaker, lang AS language, doc_id::VARCHAR AS item FROM documents),
    s AS (SELECT *, {Q.unit("concat_ws(':', 8, 'side', voice || '|' || speaker, language, item)")} < 0.5 AS first FROM i)
    SELECT voice, language, item, 'ab|' || voice || '|0|' || language || '|' || item AS id, CASE WHEN first THEN 'A' ELSE 'B' END AS original_side,
      CASE WHEN first THEN 'o' ELSE 'c' END || item AS a, CASE WHEN first THEN 'c' ELSE 'o' END || item AS b,
      row_number() OVER (PARTITION BY voice, language ORDER BY sha256(concat_ws(':', 8, item)), item) - 1 AS place FROM s""")
def w26_blind_groups(spark, sf):
    item = F.col("doc_id").cast("string")
    items = read_table(spark, sf, "documents").select(
        F.col("source").alias("voice"), F.lit("0").alias("speaker"), F.col("lang").alias("language"), item.alias("item"), F.lit("").alias("text"),
        F.concat(F.lit("o"), item).alias("original"), F.concat(F.lit("c"), item).alias("candidate"))
    return L.ab_groups(items, 8).select("voice", "language", "item", "id", "original_side", "a", "b", "place")


@query("a30_best_speakers", """WITH c AS (SELECT o_custkey AS sp, o_orderkey AS clip, o_totalprice AS score, (o_orderkey % 12)::DOUBLE AS len, o_custkey % 2 AS gender FROM orders),
    t AS (SELECT * FROM c WHERE len BETWEEN 4 AND 10 QUALIFY row_number() OVER (PARTITION BY sp ORDER BY score DESC, clip) <= 3),
    m AS (SELECT sp, gender, sum(score) / 3 AS mean FROM t GROUP BY ALL HAVING count(*) = 3), g AS (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY mean DESC, sp DESC) AS rn FROM m)
    SELECT sp, gender, round(mean, 4) AS mean_score, row_number() OVER (ORDER BY mean DESC, sp DESC) AS place FROM g WHERE rn <= 2 QUALIFY place <= 3""")
def a30_best_speakers(spark, sf):
    clips = read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("sp"), F.col("o_orderkey").alias("clip"), F.col("o_totalprice").alias("score"),
        (F.col("o_orderkey") % 12).cast("double").alias("len"), (F.col("o_custkey") % 2).alias("gender"))
    return L.pick_speakers(clips, "sp", "gender", "score", F.col("len"), "clip").select("sp", "gender", F.round("mean_score", 4).alias("mean_score"), "place")


RECORDS = """rec AS (SELECT o_orderkey::VARCHAR AS id, 'c' || (o_custkey % 60) || CASE WHEN o_custkey % 2 = 0 THEN '.s' ELSE '' END AS speaker, 'e' || (o_custkey % 4) AS espeak, 't' || o_orderkey AS text, '/t/' || o_orderkey AS path, o_orderkey FROM orders),
    ren AS (SELECT id, speaker, o_orderkey AS "order", '/s/' || id AS path FROM rec WHERE o_orderkey % 50 = 0)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    speaker = F.concat(F.lit("c"), (F.col("o_custkey") % 60).cast("string"), F.when(F.col("o_custkey") % 2 == 0, ".s").otherwise(""))
    return read_table(spark, sf, "orders").select(k.alias("id"), speaker.alias("speaker"), F.concat(F.lit("e"), (F.col("o_custkey") % 4).cast("string")).alias("espeak"),
                                                  F.concat(F.lit("t"), k).alias("text"), F.concat(F.lit("/t/"), k).alias("path"), "o_orderkey")


@query("j11_render_manifests", f"""WITH {RECORDS}, oth AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY id) AS rn FROM rec WHERE id NOT IN (SELECT id FROM ren) AND speaker IN (SELECT speaker FROM ren)),
    ref AS (SELECT * FROM oth WHERE rn <= 10), st AS (SELECT speaker, count(*) AS n FROM ref GROUP BY 1),
    num AS (SELECT ren.id, ren.speaker, ren.path AS rp, rec.path, coalesce(n, 0) + row_number() OVER (PARTITION BY ren.speaker ORDER BY "order") - 1 AS idx FROM ren JOIN rec USING (id) LEFT JOIN st ON st.speaker = ren.speaker),
    u AS (SELECT 'student' AS side, speaker, idx, rp AS file, true AS r FROM num UNION ALL SELECT 'teacher', speaker, idx, path, true FROM num UNION ALL SELECT 'teacher', speaker, rn - 1, path, false FROM ref)
    SELECT side, split_part(speaker, '.', 1) AS voice, CASE WHEN contains(speaker, '.') THEN 's' ELSE '0' END AS speaker, idx, file,
      CASE WHEN r THEN 'teacher/' || split_part(speaker, '.', 1) || '|' || CASE WHEN contains(speaker, '.') THEN 's' ELSE '0' END END AS reference_voice FROM u""")
def j11_render_manifests(spark, sf):
    rec = records(spark, sf)
    renders = rec.filter("o_orderkey % 50 = 0").select("id", "speaker", F.col("o_orderkey").alias("order"), F.concat(F.lit("/s/"), "id").alias("path"))
    student, teacher = L.render_manifests(rec.drop("o_orderkey"), renders, 10)
    both = student.withColumn("side", F.lit("student")).unionByName(teacher.withColumn("side", F.lit("teacher")))
    return both.select("side", "voice", "speaker", "idx", "file", "reference_voice")


@query("j17_evaluation_plan", f"""WITH {RECORDS}, sp AS (SELECT DISTINCT espeak AS language, speaker FROM rec), ch AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY language ORDER BY speaker) <= 4),
    tx AS (SELECT espeak AS language, text, row_number() OVER (PARTITION BY espeak ORDER BY o_orderkey) - 1 AS idx FROM rec WHERE o_orderkey % 7 = 0 QUALIFY idx < 5),
    rf AS (SELECT speaker, id, row_number() OVER (PARTITION BY speaker ORDER BY id) - 1 AS idx FROM rec WHERE speaker IN (SELECT speaker FROM ch) QUALIFY idx < 10)
    SELECT 'student' AS part, ch.speaker, tx.text AS item, tx.idx FROM ch JOIN tx USING (language) UNION ALL SELECT 'reference', speaker, id, idx FROM rf""")
def j17_evaluation_plan(spark, sf):
    rec = records(spark, sf).withColumn("language", F.col("espeak"))
    held = rec.filter("o_orderkey % 7 = 0").select("language", "text", F.col("o_orderkey").alias("rank"))
    student, refs = L.evaluation_plan(rec, held, 4, 5, 10)
    a = student.select(F.lit("student").alias("part"), "speaker", F.col("text").alias("item"), F.col("idx").cast("bigint").alias("idx"))
    return a.unionByName(refs.select(F.lit("reference").alias("part"), "speaker", F.col("id").alias("item"), F.col("idx").cast("bigint").alias("idx")))
