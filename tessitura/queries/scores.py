"""Score rows (from ``lineitem`` and ``orders``) and metric-against-verdict statistics (from ``labels`` and ``documents``)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import unit_hash
from ..operators import scoring as R
from ..operators import stats as St
from ..session import work_folder
from ..sources import readers as D
from ..sources.tables import read_table
from . import sql as Q
from .registry import query

# Stand-in score rows: flag, status and line number as voice, language and speaker.
SCORES = {
    "voice": "l_returnflag", "speaker": "CAST(l_linenumber AS STRING)", "espeak": "l_linestatus",
    "idx": "CAST(l_orderkey AS INT)", "text": "concat('p', CAST(l_partkey % 500 AS STRING))",
    "path": "concat('/', CAST(l_orderkey AS STRING))", "duration_s": "l_quantity",
    "cpu_s": "CASE WHEN l_discount > 0 THEN l_extendedprice / 100000 END",
    "cer_edits": "CASE WHEN l_discount <> 0.03 THEN l_linenumber END",
    "cer_chars": "CASE WHEN l_discount <> 0.05 THEN CAST(l_quantity AS INT) END",
    "per_edits": "CAST(l_suppkey % 5 AS INT)", "per_units": "CAST(l_quantity AS INT)",
    "per_seen_edits": "CAST(l_suppkey % 3 AS INT)", "per_seen_units": "CASE WHEN l_tax > 0.02 THEN CAST(l_quantity AS INT) END",
    "per_unseen_edits": "CAST(l_partkey % 3 AS INT)", "per_unseen_units": "CAST(l_partkey % 7 AS INT)",
    "lid_target": "1 - l_discount", "speaker_similarity": "CASE WHEN l_tax > 0.01 THEN l_tax * 10 END",
    "f0_corr": "l_discount * 10 - l_tax", "UTMOS": "1 + l_tax * 40", "SIG": "1 + l_discount * 30",
    "BAK": "l_quantity / 10", "OVRL": "CASE WHEN l_quantity > 5 THEN l_quantity / 11 END", "P808": "l_extendedprice / 30000",
}
SCORES_SQL = "scores AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in SCORES.items()).replace("STRING", "VARCHAR") + " FROM lineitem)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").select(*[F.expr(e).alias(c) for c, e in SCORES.items()])


def pooled_sql(a: str, b: str, where: str = "true") -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL AND {where}"
    return f"(sum({a}) FILTER ({both}))::DOUBLE / nullif(sum({b}) FILTER ({both}), 0)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


SUMMARY_SQL = ", ".join(
    [f"round({pooled_sql(a, b)}, 6) AS {r}" for r, (a, b) in R.RATES.items()]
    + [f"round(avg({m}), 6) AS {m}" for m in R.MEANS]
    + ["round(min(UTMOS), 6) AS UTMOS_min",
       "round(sum(cpu_s) FILTER (cpu_s IS NOT NULL) / sum(duration_s) FILTER (cpu_s IS NOT NULL), 6) AS cpu_s_per_audio_s"])


@query("a6_score_summary", f"WITH {SCORES_SQL} SELECT voice, speaker, espeak, count(*) AS n, {SUMMARY_SQL} FROM scores GROUP BY ALL")
def a6_score_summary(spark, sf):
    return rounded(R.summarize(scores(spark, sf)))


@query("a4_a5_pooled_rate_and_mean", f"""WITH {SCORES_SQL} SELECT voice, round({pooled_sql('cer_edits', 'cer_chars')}, 9) AS cer,
    round(avg(speaker_similarity), 9) AS similarity FROM scores GROUP BY voice""")
def a4_a5_pooled_rate_and_mean(spark, sf):
    return rounded(scores(spark, sf).groupBy("voice").agg(
        R.pooled_rate("cer").alias("cer"), F.avg("speaker_similarity").alias("similarity")), 9)


@query("a7_clip_means", """SELECT event_type AS voice, (user_id % 5)::VARCHAR AS speaker, count(*) AS n_clips,
    round_even(avg(value), 4) AS value, round_even(min(value), 4) AS value_min FROM events GROUP BY ALL""")
def a7_clip_means(spark, sf):
    clips = read_table(spark, sf, "events").select(
        F.col("event_type").alias("voice"), (F.col("user_id") % 5).cast("string").alias("speaker"), "value")
    return R.clip_means(clips, ["value"], "value")


@query("s8_score_table", f"""WITH {SCORES_SQL} SELECT voice, count(*) AS n, count(cer_edits) AS with_edits, round(sum(BAK), 3) AS bak, count(OVRL) AS with_ovrl,
    round(sum(CASE WHEN cer_chars <> 0 THEN cer_edits / cer_chars END), 6) AS rate_sum FROM scores GROUP BY voice""")
def s8_score_table(spark, sf):
    """Score rows written as a file and read back: absent values stay null, rates are computed anew."""
    folder, kinds = work_folder(spark, "scores"), D.columns_of(R.SCORE_SCHEMA)
    rows = scores(spark, sf)
    D.write_scores(rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]), folder)
    return D.read_scores(spark, folder).groupBy("voice").agg(
        F.count(F.lit(1)).alias("n"), F.count("cer_edits").alias("with_edits"), F.round(F.sum("BAK"), 3).alias("bak"), F.count("OVRL").alias("with_ovrl"),
        F.round(F.sum(R.row_rate("cer")), 6).alias("rate_sum"))


@query("f16_rows_of_a_voice", f"""WITH {SCORES_SQL} SELECT voice, speaker, espeak, count(*) AS n, round(avg(UTMOS), 6) AS utmos
    FROM scores WHERE voice = 'A' AND espeak = 'F' GROUP BY ALL""")
def f16_rows_of_a_voice(spark, sf):
    rows = R.select_rows(scores(spark, sf), voice="A", espeak="F")
    return rows.groupBy("voice", "speaker", "espeak").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("UTMOS"), 6).alias("utmos"))


SEED = {
    "voice": "o_orderpriority", "speaker": "o_orderstatus", "espeak": "'xx'", "idx": "CAST(o_orderkey AS INT)",
    "duration_s": "o_totalprice / 100000", "cer_edits": "CAST(o_orderkey % {m} AS INT)", "cer_chars": "CAST(o_custkey % 40 AS INT)",
    "per_edits": "CAST(o_custkey % {m} AS INT)", "per_units": "CAST(o_orderkey % 30 + 1 AS INT)",
    "UTMOS": "1 + o_totalprice / {d}", "SIG": "CASE WHEN o_orderkey % {m} > 1 THEN o_totalprice / {d} END",
}
SEED_NULL = {"per_seen_edits": "INT", "per_seen_units": "INT", "per_unseen_edits": "INT", "per_unseen_units": "INT", "lid_target": "DOUBLE",
             "speaker_similarity": "DOUBLE", "f0_corr": "DOUBLE", "BAK": "DOUBLE", "OVRL": "DOUBLE", "P808": "DOUBLE"}


def seed_columns(m: int, d: int) -> dict[str, str]:
    return {c: e.format(m=m, d=d) for c, e in SEED.items()} | {c: f"CAST(NULL AS {t})" for c, t in SEED_NULL.items()}


def seed_rows(spark: SparkSession, sf: str, m: int, d: int) -> DataFrame:
    return read_table(spark, sf, "orders").select(*[F.expr(e).alias(c) for c, e in seed_columns(m, d).items()])


def seed_sql(name: str, m: int, d: int) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in seed_columns(m, d).items()) + " FROM orders)"


def _spread_sql() -> str:
    lines = []
    for m in ("cer", "per", "UTMOS", "SIG", "duration_s"):
        if m in R.RATES:
            a, b = R.RATES[m]
            va, vb = pooled_sql(f"a.{a}", f"a.{b}"), pooled_sql(f"b.{a}", f"b.{b}")
            ra, rb = (f"(CASE WHEN {s}.{b} <> 0 THEN {s}.{a} / {s}.{b} END)" for s in "ab")
        else:
            va, vb, ra, rb = f"avg(a.{m})", f"avg(b.{m})", f"a.{m}", f"b.{m}"
        lines.append(f"""SELECT a.voice, a.speaker, a.espeak, count(*) AS n, '{m}' AS metric, round({va}, 6) AS seed_a,
            round({vb}, 6) AS seed_b, round(avg(abs({ra} - {rb})), 6) AS mean_abs_sentence_diff,
            round(abs({va} - {vb}), 6) AS abs_diff FROM a JOIN b USING (voice, speaker, espeak, idx) GROUP BY ALL""")
    return f"WITH {seed_sql('a', 4, 200000)}, {seed_sql('b', 5, 210000)} " + " UNION ALL ".join(lines)


@query("a31_j7_seed_spread", _spread_sql())
def a31_j7_seed_spread(spark, sf):
    return rounded(R.seed_spread(seed_rows(spark, sf, 4, 200000), seed_rows(spark, sf, 5, 210000)))


@query("u4_unmatched_keys", """WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A'),
    b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R')
    SELECT k, 'first' AS side FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
    UNION ALL SELECT k, 'second' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def u4_unmatched_keys(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag")
    return R.unmatched_keys(rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag = 'R'"), ["k"])


@query("a26_j8_compare_systems", f"""WITH {SCORES_SQL}, su AS (SELECT voice, speaker, espeak, {SUMMARY_SQL} FROM scores GROUP BY ALL),
    s AS (SELECT * FROM su WHERE espeak = 'F'), t AS (SELECT * FROM su WHERE espeak = 'O'),
    l AS (SELECT s.voice, s.speaker, unnest([{{m: 'cer', s: 'student', v: s.cer}}, {{m: 'cer', s: 'teacher', v: t.cer}},
        {{m: 'UTMOS', s: 'student', v: s.UTMOS}}, {{m: 'UTMOS', s: 'teacher', v: t.UTMOS}}], recursive := true)
      FROM s LEFT JOIN t USING (voice, speaker))
    SELECT m AS metric, s AS system, count(v) AS n, round(avg(v), 5) AS mean, round(quantile_cont(v, 0.5), 5) AS median FROM l GROUP BY ALL""")
def a26_j8_compare_systems(spark, sf):
    summary = rounded(R.summarize(scores(spark, sf)))
    both = R.compare_systems(summary.filter("espeak = 'F'"), summary.filter("espeak = 'O'"), ["cer", "UTMOS"])
    return rounded(both, 5)


@query("a26_share_over_limit", f"""WITH {SCORES_SQL} SELECT count(*) AS n,
    round(avg(CASE WHEN coalesce(speaker_similarity, 0) >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share FROM scores""")
def a26_share_over_limit(spark, sf):
    return rounded(R.share_at_least(scores(spark, sf), "speaker_similarity", 0.5))


@query("a26_lowest_and_highest", """WITH v AS (SELECT o_orderkey, o_totalprice FROM orders),
    lo AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM v),
    hi AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS place FROM v)
    SELECT *, 'lowest' AS "end" FROM lo WHERE place <= 8 UNION ALL SELECT *, 'highest' FROM hi WHERE place <= 6""")
def a26_lowest_and_highest(spark, sf):
    return R.extremes_by(read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 8, 6, ["o_orderkey"])


VERDICTS_SQL = """verdicts AS (SELECT doc_id, lang, CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS human,
    CASE WHEN toxic = 0 THEN 'pass' ELSE 'fail' END AS audio, n_chars::DOUBLE AS m1,
    (length(text) - length(replace(text, ' ', ''))) / length(text) AS m2 FROM labels JOIN documents USING (doc_id))"""


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    marks = read_table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("human"),
        F.when(F.col("toxic") == 0, "pass").otherwise("fail").alias("audio"))
    spaces = F.char_length("text") - F.char_length(F.replace("text", F.lit(" "), F.lit("")))
    metrics = read_table(spark, sf, "documents").select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("m1"), (spaces / F.char_length("text")).alias("m2"))
    return St.join_verdicts(marks, metrics, ["doc_id"])


@query("j5_verdicts_with_scores", f"WITH {VERDICTS_SQL} SELECT doc_id, lang, human, audio, m1, round(m2, 9) AS m2 FROM verdicts")
def j5_verdicts_with_scores(spark, sf):
    return rounded(verdicts(spark, sf).select("doc_id", "lang", "human", "audio", "m1", "m2"), 9)


@query("w12_language_z", f"""WITH {VERDICTS_SQL} SELECT doc_id, round(coalesce((m1 - avg(m1) OVER w) / nullif(stddev_pop(m1) OVER w, 0), 0), 6) AS m1_langz,
    round(coalesce((m2 - avg(m2) OVER w) / nullif(stddev_pop(m2) OVER w, 0), 0), 6) AS m2_langz FROM verdicts WINDOW w AS (PARTITION BY lang)""")
def w12_language_z(spark, sf):
    return rounded(St.with_language_z(verdicts(spark, sf), ["m1", "m2"]).select("doc_id", "m1_langz", "m2_langz"))


@query("w13_extremes", f"""WITH {VERDICTS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY m1, doc_id) AS rn, count(*) OVER () AS n FROM verdicts),
    k AS (SELECT *, greatest(1, round_even(0.15 * n, 0))::BIGINT AS k FROM r)
    SELECT round(avg((human = 'pass')::INT) FILTER (rn > n - k), 6) AS top_pass_rate,
      round(avg((human = 'fail')::INT) FILTER (rn <= k), 6) AS bottom_fail_rate, max(k) AS extreme_n FROM k""")
def w13_extremes(spark, sf):
    return rounded(St.extremes(verdicts(spark, sf), [], "m1", "doc_id", F.col("human") == "pass"))


@query("w14_disagreements", f"""WITH {VERDICTS_SQL}, z AS (SELECT *, coalesce((m1 - avg(m1) OVER w) / nullif(stddev_pop(m1) OVER w, 0), 0) AS z,
      (row_number() OVER (ORDER BY m1, doc_id) - 1) / (count(*) OVER () - 1) AS pct, count(*) OVER w AS lang_rows FROM verdicts WINDOW w AS (PARTITION BY lang)),
    f AS (SELECT *, row_number() OVER (ORDER BY z DESC, doc_id) AS place FROM z WHERE lang_rows >= 3 AND human = 'fail'),
    p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id) AS place FROM z WHERE lang_rows >= 3 AND human = 'pass'),
    u AS (SELECT *, 'model_high_verdict_fail' AS kind FROM f WHERE place <= 10 UNION ALL SELECT *, 'model_low_verdict_pass' FROM p WHERE place <= 10)
    SELECT kind, place, doc_id, lang, human, audio, round(m1, 3) AS score, round(pct, 2) AS global_percentile, round(z, 2) AS lang_z, lang_rows FROM u""")
def w14_disagreements(spark, sf):
    rows = St.with_language_z(verdicts(spark, sf), ["m1"])
    out = St.disagreements(rows, "m1", "m1_langz", "doc_id", "human", 10)
    return out.select("kind", "place", "doc_id", "lang", "human", "audio", F.round("m1", 3).alias("score"),
                      F.round("global_percentile", 2).alias("global_percentile"), F.round("m1_langz", 2).alias("lang_z"), "lang_rows")


@query("e1_e2_within_language_auc", f"""WITH {VERDICTS_SQL}, pairs AS (SELECT a.lang, CASE WHEN a.m1 > b.m1 THEN 1.0 WHEN a.m1 = b.m1 THEN 0.5 ELSE 0.0 END AS win
      FROM verdicts a JOIN verdicts b ON a.lang = b.lang AND a.human = 'pass' AND b.human = 'fail')
    SELECT 'within' AS kind, count(*) AS pairs, round(sum(win) / count(*), 9)::DOUBLE AS auc FROM pairs""")
def e1_e2_within_language_auc(spark, sf):
    rows = verdicts(spark, sf)
    inside = rows.join(St.groups_with_both(rows, "lang", "human"), "lang", "left_semi")
    out = St.pooled_auc(inside, [], ["lang"], "m1", F.col("human") == "pass")
    return out.select(F.lit("within").alias("kind"), "pairs", F.round("auc", 9).alias("auc"))


@query("e1_global_auc", f"""WITH {VERDICTS_SQL}, long AS (SELECT human, unnest([{{metric: 'm1', v: m1}}, {{metric: 'm2', v: m2}}], recursive := true) FROM verdicts),
    pairs AS (SELECT a.metric, CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0.0 END AS win FROM long a JOIN long b
      ON a.metric = b.metric AND a.human = 'pass' AND b.human = 'fail')
    SELECT metric, count(*) AS pairs, round(sum(win) / count(*), 9)::DOUBLE AS auc FROM pairs GROUP BY metric""")
def e1_global_auc(spark, sf):
    long = St.unpivot_metrics(verdicts(spark, sf), ["doc_id", "human"], ["m1", "m2"])
    return rounded(St.pooled_auc(long, ["metric"], [], "value", F.col("human") == "pass"), 9)


@query("e3_bootstrap_interval")
def e3_bootstrap_interval(spark, sf):
    rows = verdicts(spark, sf)
    inside = rows.join(St.groups_with_both(rows, "lang", "human"), "lang", "left_semi")
    return St.bootstrap_auc(inside, [], ["lang"], "m1", F.col("human") == "pass", 200, seed=0)


@query("e4_full_evaluation")
def e4_full_evaluation(spark, sf):
    return rounded(St.evaluate(verdicts(spark, sf), ["m1", "m2"], "doc_id", draws=50), 3)
