"""Pass criteria over stand-in score rows from ``lineitem``: even orders are the originals, odd ones the candidate."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import criteria as C
from ..session import work_folder
from ..sources import readers as D
from ..sources.tables import read_table
from .registry import query

CELLS = {
    "voice": "l_returnflag", "speaker": "'0'", "espeak": "concat('e', CAST(l_suppkey % 4 AS STRING))", "text": "concat('p', CAST(l_partkey % 300 AS STRING))",
    "path": "CAST(l_orderkey AS STRING)", "cer_edits": "CASE WHEN l_tax > 0.01 THEN l_linenumber END", "cer_chars": "CAST(l_quantity AS INT) + 20",
    "per_edits": "l_linenumber", "per_units": "CAST(l_quantity AS INT) + 10", "UTMOS": "2.5 + l_discount * 10", "lid_target": "1 - l_tax",
    "speaker_similarity": "CASE WHEN l_discount > 0.02 THEN 0.6 + l_tax * 3 END",
}


def inputs(spark: SparkSession, sf: str) -> C.Inputs:
    li = read_table(spark, sf, "lineitem")
    rows = li.select("l_orderkey", *[F.expr(e).alias(c) for c, e in CELLS.items()]).withColumn(
        "speaker_reference", F.concat(F.lit("ref/"), "voice", F.lit("|0")))
    lineup = spark.createDataFrame([("A", "0", "e0"), ("N", "0", "e1"), ("R", "0", "e2")], "voice string, speaker string, language string")
    languages = spark.createDataFrame([("e0", "w0", "v0"), ("e1", None, "v1"), ("e2", "w2", "v2"), ("e3", "w3", None)], "espeak string, whisper string, voxlingua string")
    seen = li.select(F.col("l_returnflag").alias("voice"), F.lit("0").alias("speaker"), F.expr(CELLS["espeak"]).alias("espeak")).distinct()
    human = seen.select("voice", "speaker", "espeak", F.when(F.col("voice") == "R", "fail").otherwise("pass").alias("human"))
    verdicts = seen.filter("espeak <> 'e3'").select("voice", "speaker", F.col("espeak").alias("language"), F.when(F.col("espeak") == "e1", "fail").otherwise("pass").alias("human"))
    ab = li.filter("l_returnflag <> 'R'").select(
        F.col("l_returnflag").alias("voice"), F.lit("0").alias("speaker"), F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("B").alias("original_side"),
        F.when(F.col("l_linenumber") % 3 == 0, "tie").when(F.col("l_quantity") > 25, "A").otherwise("B").alias("answer"))
    ratings = li.filter("l_quantity > 45").select(
        F.lit("me").alias("listener"), F.expr(CELLS["espeak"]).alias("language"), F.col("l_returnflag").alias("voice"), F.lit("0").alias("speaker"),
        F.col("l_orderkey").cast("string").alias("item"), (F.col("l_linenumber") % 5 + 1).cast("int").alias("score"), F.when(F.col("l_partkey") % 50 == 0, "n").otherwise("").alias("note"))
    runtime = read_table(spark, sf, "nation").select(F.when(F.col("n_nationkey") == 0, "base").otherwise(F.col("n_name")).alias("variant"), (1.0 + F.col("n_nationkey") * 0.09).alias("ratio"))
    return C.Inputs(lineup, languages, rows.filter("l_orderkey % 2 = 0"), rows.filter("l_orderkey % 2 = 1"), human, ("e0", "e9"), "e3", ("N", "0"),
                    verdicts, ab, ratings, runtime)


def shown(results: DataFrame) -> DataFrame:
    return results.select("test", "voice", "language", F.round("measured", 6).alias("measured"), F.round("reference", 6).alias("reference"), "threshold", "status", "note")


BASE = "sc AS (SELECT l_orderkey, " + ", ".join(f"{e} AS {c}" for c, e in CELLS.items()).replace("STRING", "VARCHAR") + """ FROM lineitem),
    o AS (SELECT * FROM sc WHERE l_orderkey % 2 = 0), c AS (SELECT * FROM sc WHERE l_orderkey % 2 = 1),
    lineup AS (SELECT * FROM (VALUES ('A', 'e0', 'w'), ('N', 'e1', NULL), ('R', 'e2', 'w')) t(voice, espeak, whisper))"""


def pooled(e: str, u: str) -> str:
    return f"(sum({e}) FILTER ({e} IS NOT NULL AND {u} IS NOT NULL)) / nullif(sum({u}) FILTER ({e} IS NOT NULL AND {u} IS NOT NULL), 0)::DOUBLE"


def status(value: str, passes: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'not_measured' WHEN coalesce({passes}, false) THEN 'pass' ELSE 'fail' END"


def line(test: str, voice: str, lang: str, measured: str, reference: str, threshold: str, st: str, note: str) -> str:
    return f"SELECT '{test}' AS test, {voice} AS voice, {lang} AS language, round(({measured})::DOUBLE, 6) AS measured, round(({reference})::DOUBLE, 6) AS reference, '{threshold}' AS threshold, {st} AS status, {note} AS note"


OWN = f"""WITH {BASE}, oc AS (SELECT c.* FROM c JOIN lineup USING (voice, espeak)), oo AS (SELECT o.* FROM o JOIN lineup USING (voice, espeak)),
    sc2 AS (SELECT voice, espeak, count(*) AS n, {pooled('cer_edits', 'cer_chars')} AS cer, avg(UTMOS) AS ut FROM oc WHERE (voice, text) IN (SELECT (voice, text) FROM oo) GROUP BY ALL),
    so2 AS (SELECT voice, {pooled('cer_edits', 'cer_chars')} AS cer, avg(UTMOS) AS ut FROM oo WHERE (voice, text) IN (SELECT (voice, text) FROM oc) GROUP BY 1),
    sim AS (SELECT voice, avg(speaker_similarity) AS s FROM oc GROUP BY 1),
    ab AS (SELECT l_returnflag AS voice, count(*) AS n, avg(CASE WHEN l_linenumber % 3 = 0 THEN 0.5 WHEN (l_quantity > 25) = (l_linenumber % 2 = 0) THEN 1.0 ELSE 0.0 END) AS p FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
    j AS (SELECT l.voice, l.espeak, l.whisper, sc2.n, sc2.cer AS cc, so2.cer AS oc, sc2.ut AS cu, so2.ut AS ou, s, ab.n AS abn, p FROM lineup l LEFT JOIN sc2 USING (voice) LEFT JOIN so2 USING (voice) LEFT JOIN sim USING (voice) LEFT JOIN ab USING (voice))
    {line('own: blind A/B vs original', "voice || '|0'", 'espeak', 'p', 'NULL', '<= 0.6 over >= 30 answers', "CASE WHEN p <= 0.6 THEN 'pass' ELSE 'fail' END", "abn || ' answers'")} FROM j WHERE abn > 0
    UNION ALL {line('own: blind A/B vs original', "voice || '|0'", 'espeak', 'NULL', 'NULL', '<= 0.6', "'not_measured'", "''")} FROM j WHERE abn IS NULL
    UNION ALL {line('own: Whisper CER vs original', "voice || '|0'", 'espeak', 'cc', 'oc', '<= original + 0.02', status('cc', 'cc <= oc + 0.02'), "n || ' shared sentences'")} FROM j WHERE whisper IS NOT NULL
    UNION ALL {line('own: Whisper CER vs original', "voice || '|0'", 'espeak', 'NULL', 'NULL', '<= original + 0.02', "'not_applicable'", "'language not on the Whisper allow-list'")} FROM j WHERE whisper IS NULL
    UNION ALL {line('own: speaker similarity to original', "voice || '|0'", 'espeak', 's', 'NULL', '>= 0.8', status('s', 's >= 0.8'), "''")} FROM j
    UNION ALL {line('own: UTMOS vs original (recording quality only)', "voice || '|0'", 'espeak', 'cu', 'ou', '>= original - 0.1', status('cu', 'cu >= ou - 0.1'), "''")} FROM j
    UNION ALL {line('own: human enough (verdict page)', "voice || '|0'", 'espeak', 'NULL', 'NULL', 'passes if the original passed', "CASE WHEN voice = 'R' THEN 'pass' WHEN espeak = 'e1' THEN 'fail' ELSE 'pass' END", "CASE WHEN voice = 'R' THEN 'original failed the human pass' WHEN espeak = 'e1' THEN 'new model: fail' ELSE 'new model: pass' END")} FROM j"""


@query("e5_e10_e15_own_language", OWN)
def e5_e10_e15_own_language(spark, sf):
    return shown(C.own_language(inputs(spark, sf)))


CROSS = f"""WITH {BASE}, ab AS (SELECT c.*, l.espeak AS own FROM c JOIN lineup l USING (voice) WHERE c.espeak <> l.espeak),
    lid AS (SELECT voice, espeak, avg(lid_target) AS cl FROM ab GROUP BY ALL), ol AS (SELECT espeak, avg(lid_target) AS ol FROM o GROUP BY 1),
    cp AS (SELECT a.voice, a.espeak, b.voice AS ov, a.text FROM (SELECT DISTINCT voice, espeak, text FROM ab) a JOIN (SELECT DISTINCT voice, espeak, text FROM o) b USING (espeak, text)),
    ocer AS (SELECT cp.voice, cp.espeak, ov, {pooled('cer_edits', 'cer_chars')} AS r FROM cp JOIN o ON o.voice = ov AND o.espeak = cp.espeak AND o.text = cp.text GROUP BY ALL),
    best AS (SELECT * FROM ocer QUALIFY row_number() OVER (PARTITION BY voice, espeak ORDER BY r, ov) = 1),
    ccer AS (SELECT b.voice, b.espeak, ov, r, count(*) AS n, {pooled('cer_edits', 'cer_chars')} AS cr FROM best b JOIN cp USING (voice, espeak, ov) JOIN ab ON ab.voice = b.voice AND ab.espeak = b.espeak AND ab.text = cp.text GROUP BY ALL),
    j AS (SELECT * FROM lid LEFT JOIN ol USING (espeak) LEFT JOIN ccer USING (voice, espeak)),
    cb AS (SELECT espeak, max(m) AS cb FROM (SELECT voice, espeak, avg(UTMOS) AS m FROM c GROUP BY ALL) GROUP BY 1), ob AS (SELECT espeak, max(m) AS ob FROM (SELECT voice, espeak, avg(UTMOS) AS m FROM o GROUP BY ALL) GROUP BY 1),
    sim AS (SELECT voice, avg(speaker_similarity) AS s FROM ab GROUP BY 1),
    rat AS (SELECT count(*) AS n, avg(l_linenumber % 5 + 1) AS m FROM lineitem WHERE l_quantity > 45 AND l_suppkey % 4 = 0)
    {line('cross: language-ID confidence', "voice || '|0'", 'espeak', 'cl', 'ol', '>= originals - 0.1', status('cl', 'cl >= ol - 0.1'), "''")} FROM j WHERE espeak <> 'e3'
    UNION ALL {line('cross: language-ID confidence', "voice || '|0'", 'espeak', 'NULL', 'NULL', '>= originals - 0.1', "'not_applicable'", "'no VoxLingua107 label for the language'")} FROM j WHERE espeak = 'e3'
    UNION ALL {line('cross: Whisper CER vs best original', "voice || '|0'", 'espeak', 'cr', 'r', '<= best original + 0.02', status('cr', 'cr <= r + 0.02'), "'best original ' || ov || '|0, ' || n || ' shared sentences'")} FROM j WHERE espeak <> 'e1'
    UNION ALL {line('cross: Whisper CER vs best original', "voice || '|0'", 'espeak', 'NULL', 'NULL', '<= best original + 0.02', "'not_applicable'", "'language not on the Whisper allow-list'")} FROM j WHERE espeak = 'e1'
    UNION ALL {line('cross: some lineup voice human enough', "'*'", 'espeak', "CASE WHEN espeak = 'e3' THEN NULL WHEN espeak = 'e1' THEN 0 ELSE 3 END", 'NULL', 'one passes where an original passed', "CASE espeak WHEN 'e3' THEN 'not_measured' WHEN 'e1' THEN 'fail' ELSE 'pass' END", "CASE WHEN espeak IN ('e1', 'e3') THEN '' ELSE 'A|0 N|0 R|0' END")} FROM cb
    UNION ALL {line('cross: best lineup UTMOS vs best original (within language)', "'*'", 'espeak', 'cb', 'ob', '>= best original', status('cb', 'cb >= ob'), "''")} FROM cb JOIN ob USING (espeak)
    UNION ALL {line('cross: speaker similarity to own-language output', "voice || '|0'", "'*'", 's', 'NULL', '>= 0.7 mean', status('s', 's >= 0.7'), "''")} FROM sim
    UNION ALL {line('cross: native rating', "'*'", "'e0'", 'm', 'NULL', '>= 3.5 mean; no sound consistently wrong (read the notes)', status('m', 'm >= 3.5'), "n || ' ratings'")} FROM rat
    UNION ALL {line('cross: native rating', "'*'", "'e9'", 'NULL', 'NULL', '>= 3.5 mean; no sound consistently wrong (read the notes)', "'not_measured'", "'0 ratings'")}"""


@query("e6_cross_language", CROSS)
def e6_cross_language(spark, sf):
    return shown(C.cross_language(inputs(spark, sf)))


WEAK = f"""WITH {BASE}, ref AS (SELECT * FROM o WHERE voice = 'N' AND espeak = 'e3'), wk AS (SELECT * FROM c WHERE espeak = 'e3'), sh AS (SELECT * FROM wk WHERE text IN (SELECT text FROM ref)),
    w AS (SELECT voice, avg(UTMOS) AS w FROM wk GROUP BY 1), ow AS (SELECT c.voice, avg(UTMOS) AS ow FROM c JOIN lineup USING (voice, espeak) GROUP BY 1), m AS (SELECT voice, count(*) AS n, {pooled('per_edits', 'per_units')} AS p FROM sh GROUP BY 1),
    r AS (SELECT t.voice, {pooled('per_edits', 'per_units')} AS r FROM (SELECT DISTINCT voice, text FROM sh) t JOIN ref ON ref.text = t.text GROUP BY 1), j AS (SELECT * FROM w JOIN ow USING (voice) JOIN m USING (voice) JOIN r USING (voice))
    {line('weak: UTMOS vs own-language UTMOS', "voice || '|0'", "'e3'", 'w', 'ow', '>= own language - 0.2', status('w', 'w >= ow - 0.2'), "''")} FROM j
    UNION ALL {line('weak: phoneme error vs reference', "voice || '|0'", "'e3'", 'p', 'r', '<= N|0 + 0.05', status('p', 'p <= r + 0.05'), "n || ' shared sentences'")} FROM j"""


@query("e7_weak_language", WEAK)
def e7_weak_language(spark, sf):
    return shown(C.weak_language(inputs(spark, sf)))


RUNTIME = f"""{line('runtime: CPU per audio second vs medium voice', 'variant', "'*'", 'ratio', 'NULL', '<= X', status('ratio', "ratio <= lim"), "''").replace("'<= X'", "'<= ' || CASE WHEN variant = 'base' THEN '1.1' ELSE '2.0' END")}
    FROM (SELECT CASE WHEN n_nationkey = 0 THEN 'base' ELSE n_name END AS variant, 1.0::DOUBLE + n_nationkey * 0.09::DOUBLE AS ratio, CASE WHEN n_nationkey = 0 THEN 1.1 ELSE 2.0 END::DOUBLE AS lim FROM nation)"""


@query("e8_runtime", RUNTIME)
def e8_runtime(spark, sf):
    return shown(C.runtime(inputs(spark, sf)))


@query("e9_a18_status_counts", f"""WITH r AS (SELECT status FROM ({OWN}) UNION ALL SELECT status FROM ({CROSS}) UNION ALL SELECT status FROM ({WEAK}) UNION ALL SELECT status FROM ({RUNTIME})),
    s AS (SELECT unnest(['pass', 'fail', 'not_measured', 'not_applicable']) AS status) SELECT s.status, count(r.status) AS n FROM s LEFT JOIN r USING (status) GROUP BY 1""")
def e9_a18_status_counts(spark, sf):
    return C.status_counts(C.evaluate(inputs(spark, sf)))


@query("e11_needs_ears", f"""WITH r AS (SELECT * FROM ({OWN}) UNION ALL SELECT * FROM ({CROSS})),
    n AS (SELECT CASE WHEN contains(test, 'human enough') THEN 'human enough?' WHEN contains(test, 'A/B') THEN 'blind A/B' WHEN contains(test, 'native rating') THEN 'native rating' END AS task, voice, language,
      CASE WHEN contains(test, 'human enough') THEN test WHEN contains(test, 'A/B') THEN coalesce(nullif(note, ''), 'no answers') ELSE note END AS why FROM r WHERE status = 'not_measured'),
    q AS (SELECT voice, espeak, avg(UTMOS) AS m FROM (SELECT l_returnflag AS voice, 'e' || (l_suppkey % 4) AS espeak, 2.5 + l_discount * 10 AS UTMOS FROM lineitem WHERE l_orderkey % 2 = 1) GROUP BY ALL HAVING avg(UTMOS) < 2.9)
    SELECT task, voice, language, why FROM n WHERE task IS NOT NULL
    UNION ALL SELECT 'read note: sound clearly wrong?', l_returnflag || '|0', 'e' || (l_suppkey % 4), 'n' FROM lineitem WHERE l_quantity > 45 AND l_partkey % 50 = 0
    UNION ALL SELECT 'carried-over narrow band or crackle?', v || '|0', 'e3', 'weak-language test' FROM (SELECT unnest(['A', 'N', 'R']) AS v)
    UNION ALL SELECT 're-listen: low recording quality', voice || '|0', espeak, 'UTMOS ' || printf('%.2f', m) || ' < 2.9' FROM q""")
def e11_needs_ears(spark, sf):
    i = inputs(spark, sf)
    return C.needs_ears(i, C.evaluate(i)).select("task", "voice", "language", "why")


@query("s23_f15_tagged_verdicts", """SELECT doc_id, source AS voice, lang AS language, CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS human
    FROM labels JOIN documents USING (doc_id) WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0""")
def s23_f15_tagged_verdicts(spark, sf):
    k = F.col("doc_id")
    rows = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id").select(
        F.when(k % 4 == 0, F.concat(F.lit("other~"), "source", F.lit("~"), "lang")).when(k % 5 == 0, F.col("source")).otherwise(
            F.concat(F.lit("run1~"), "source", F.lit("~"), "lang")).alias("voice"),
        k.cast("string").alias("speaker"), F.when(k % 7 == 0, "").when(F.col("quality") == 1, "pass").otherwise("fail").alias("human"))
    folder = work_folder(spark, "verdicts")
    rows.write.option("header", True).option("emptyValue", "").csv(folder)
    return D.read_verdicts(spark, folder, "run1").select(F.col("speaker").cast("bigint").alias("doc_id"), "voice", "language", "human")
