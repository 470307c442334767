"""Sentence selection and text functions over ``documents`` and ``benchmark``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..functions.hashing import int_hash, unit_hash
from ..functions.text import WordLimits
from ..operators import ordering as O
from ..operators import selection as S
from ..plans import corpus as C
from ..session import work_folder, written
from ..sources import sentences as T
from ..sources.tables import read_table, split_sentences
from . import sql as Q
from .registry import query

LIMITS = WordLimits(4, 25)
PER_LANGUAGE = {"de": 20}
OPTIONS = C.SelectionOptions(LIMITS, PER_LANGUAGE, held_out=20, train=1000)
HIGH = "(CASE WHEN lang = 'de' THEN 20 ELSE 25 END)"
SPELL = r"regexp_matches(sentence, '^[\p{L}\p{M} ,;:''’()-]*$')"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return split_sentences(documents(spark, sf).select("doc_id", "lang", "source", "text"))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return S.classify(sentences(spark, sf).drop("source"), LIMITS)


def pool(spark: SparkSession, sf: str) -> DataFrame:
    return S.keep_first(classified(spark, sf))


@query("selection_report", f"""WITH {Q.sentences()}, {Q.kept(HIGH)},
    pool AS (SELECT *, {SPELL} AS usable FROM kept),
    held AS (SELECT lang, hash FROM pool WHERE usable QUALIFY row_number() OVER (PARTITION BY lang ORDER BY hash) <= 20),
    {Q.sentences('benchmark', 'item_id', 'bench')},
    blocked AS (SELECT hash FROM held UNION SELECT sha1({Q.key('sentence')}) FROM bench)
    SELECT lang, count(*) FILTER (NOT usable) AS untokenizable,
        count(*) FILTER ((lang, hash) IN (SELECT (lang, hash) FROM held)) AS held_out,
        count(*) FILTER (usable AND hash NOT IN (SELECT hash FROM blocked)) AS train_pool,
        least(count(*) FILTER (usable AND hash NOT IN (SELECT hash FROM blocked)), 1000) AS train
    FROM pool GROUP BY lang""")
def selection_report(spark, sf):
    return C.selection_report(documents(spark, sf), read_table(spark, sf, "benchmark"), OPTIONS)


@query("f1_class_filter", f"""WITH {Q.sentences()}
    SELECT lang, coalesce({Q.reason()}, 'kept') AS reason, count(*) AS n FROM sent GROUP BY ALL""")
def f1_class_filter(spark, sf):
    return classified(spark, sf).groupBy("lang", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


@query("f2_word_limits", f"""WITH {Q.sentences()}
    SELECT lang, coalesce({Q.reason('4', HIGH)}, 'kept') AS reason, count(*) AS n FROM sent GROUP BY ALL""")
def f2_word_limits(spark, sf):
    return S.classify(sentences(spark, sf), LIMITS, PER_LANGUAGE).groupBy(
        "lang", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("f3_f7_single_tests", f"""WITH {Q.sentences()} SELECT lang, count_if({Q.DIGIT}) AS digit, count_if({Q.URL}) AS url,
    count_if({Q.SYMBOL}) AS symbol, count_if({Q.ABBREVIATION}) AS abbreviation, count_if({Q.MIXED}) AS mixed_script
    FROM sent GROUP BY lang""")
def f3_f7_single_tests(spark, sf):
    s = F.col("sentence")
    return sentences(spark, sf).groupBy("lang").agg(
        F.count_if(s.rlike(X.DIGIT)).alias("digit"), F.count_if(s.rlike(X.URL)).alias("url"),
        F.count_if(s.rlike(X.SYMBOL)).alias("symbol"), F.count_if(X.is_abbreviation(s)).alias("abbreviation"),
        F.count_if(X.is_mixed_script(s)).alias("mixed_script"))


@query("f8_kept_sentences", f"""WITH {Q.sentences()}, {Q.kept()}
    SELECT lang, hash, doc_id, pos::INT AS pos, sentence FROM kept""")
def f8_kept_sentences(spark, sf):
    return pool(spark, sf).select("lang", "hash", "doc_id", "pos", "sentence")


@query("f8_reject_counts", f"""WITH {Q.sentences()}, {Q.kept()},
    dup AS (SELECT lang, count(*) - count(DISTINCT hash) AS n FROM classified WHERE reason IS NULL GROUP BY lang)
    SELECT lang, reason, count(*) AS n FROM classified WHERE reason IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 'duplicate', n FROM dup WHERE n > 0""")
def f8_reject_counts(spark, sf):
    return S.reject_counts(classified(spark, sf))


@query("f9_earlier_filter", f"""WITH {Q.sentences()}, ok AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) AS rank
    FROM sent WHERE NOT regexp_matches(sentence, '\\p{{Nd}}')
      AND NOT regexp_matches(sentence, 'https?://|www\\.|\\.com([^\\p{{L}}\\p{{N}}_]|$)|\\.org([^\\p{{L}}\\p{{N}}_]|$)|@')
      AND NOT (lang = 'fr' AND regexp_matches(sentence, '[A-Za-z]')) AND {Q.WORDS} >= 4)
    SELECT lang, doc_id, pos::INT AS pos, rank FROM ok WHERE rank <= 400""")
def f9_earlier_filter(spark, sf):
    script = F.when(F.col("lang") == "fr", "Cyrl").otherwise("Latn")
    kept = sentences(spark, sf).filter(X.corpus_keep(F.col("sentence"), script)).select("lang", "doc_id", "pos")
    top = O.top_rows(kept, ["lang"], [F.col("doc_id"), F.col("pos")], 400, spread=F.col("doc_id"), rank="rank")
    return top.select("lang", "doc_id", "pos", "rank")


@query("f12_length_range", """SELECT lang, count(*) FILTER (n_chars BETWEEN 100 AND 5000) AS kept,
    count(*) FILTER (n_chars NOT BETWEEN 100 AND 5000) AS dropped,
    round(coalesce(sum(n_chars) FILTER (n_chars NOT BETWEEN 100 AND 5000), 0) / 3600.0, 6) AS dropped_hours
    FROM documents GROUP BY lang""")
def f12_length_range(spark, sf):
    from ..operators.records import length_range_report
    return length_range_report(documents(spark, sf).select("lang", F.col("n_chars").alias("seconds")), 100, 5000)


@query("f13_first_by_length", """SELECT source, doc_id, rank FROM (SELECT source, doc_id,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE n_chars BETWEEN 200 AND 2000) WHERE rank <= 3""")
def f13_first_by_length(spark, sf):
    usable = documents(spark, sf).filter(F.col("n_chars").between(200, 2000)).select("source", "doc_id")
    return O.top_rows(usable, ["source"], [F.col("doc_id")], 3, spread=F.col("doc_id"), rank="rank").select(
        "source", "doc_id", "rank")


@query("f14_lower_quartile", f"""WITH {Q.sentences()}, r AS (SELECT lang, doc_id, pos, row_number() OVER
    (PARTITION BY lang ORDER BY length(sentence), doc_id, pos) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM sent)
    SELECT lang, doc_id, pos::INT AS pos, rn - n // 4 AS rank FROM r WHERE rn > n // 4""")
def f14_lower_quartile(spark, sf):
    s = sentences(spark, sf)
    return S.from_lower_quartile(s.select("lang", "doc_id", "pos", "sentence"), ["lang"], F.char_length("sentence"),
                                 ["doc_id", "pos"]).select("lang", "doc_id", "pos", "rank")


@query("w1_hash_hold_out", f"""WITH {Q.sentences()}, {Q.kept()}
    SELECT lang, hash, sentence FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY hash) <= 50""")
def w1_hash_hold_out(spark, sf):
    return S.held_out(pool(spark, sf), 50).select("lang", "hash", "sentence")


@query("w2_validation_split", """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha1(doc_id::VARCHAR)) <= 40
    THEN 'validation' ELSE 'train' END AS split FROM documents""")
def w2_validation_split(spark, sf):
    return S.split_by_hash(documents(spark, sf).select("doc_id"), "doc_id", 40)


@query("w20_hash_seeds", f"""SELECT doc_id, {Q.unit("concat_ws(':', 7, lang, doc_id)")} AS unit,
    ('0x' || substr(sha256(concat_ws(':', 7, lang, doc_id)), 1, 8))::BIGINT AS seed FROM documents""")
def w20_hash_seeds(spark, sf):
    return documents(spark, sf).select(
        "doc_id", unit_hash(7, F.col("lang"), F.col("doc_id")).alias("unit"), int_hash(7, F.col("lang"), F.col("doc_id")).alias("seed"))


@query("j4_leak_guard", f"""WITH {Q.sentences()}, {Q.kept()}, {Q.sentences('benchmark', 'item_id', 'bench')},
    held AS (SELECT hash FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY hash) <= 50)
    SELECT lang, count(*) AS n, min(hash) AS first_hash FROM kept WHERE hash NOT IN (SELECT hash FROM held)
      AND hash NOT IN (SELECT sha1({Q.key('sentence')}) FROM bench) GROUP BY lang""")
def j4_leak_guard(spark, sf):
    p = written(pool(spark, sf).select("lang", "hash"), "pool")  # read twice
    free = S.leak_guard(p, S.held_out(p, 50), C.forbidden_texts(read_table(spark, sf, "benchmark")))
    return free.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("first_hash"))


@query("j6_u5_shared_texts", f"""WITH {Q.sentences()}, k AS (SELECT *, {Q.key('sentence')} AS text FROM sent),
    a AS (SELECT * FROM k WHERE source = 'src1'), b AS (SELECT * FROM k WHERE source = 'src2')
    SELECT 'a' AS side, doc_id, pos::INT AS pos FROM a WHERE text IN (SELECT text FROM b)
    UNION ALL SELECT 'b', doc_id, pos::INT FROM b WHERE text IN (SELECT text FROM a)""")
def j6_u5_shared_texts(spark, sf):
    from ..operators.scoring import common_texts
    keyed = sentences(spark, sf).select("source", "doc_id", "pos", X.dedup_key(F.col("sentence"), True).alias("text"))
    a, b = common_texts(keyed.filter("source = 'src1'"), keyed.filter("source = 'src2'"), "text")
    return a.select(F.lit("a").alias("side"), "doc_id", "pos").unionByName(b.select(F.lit("b").alias("side"), "doc_id", "pos"))


@query("j16_held_out_per_language", f"""WITH {Q.sentences()}, {Q.kept()}, run AS (SELECT DISTINCT lang FROM documents WHERE source = 'src3'),
    h AS (SELECT lang, hash, row_number() OVER (PARTITION BY lang ORDER BY hash) AS rank FROM kept)
    SELECT lang, hash, rank FROM h JOIN run USING (lang) WHERE rank <= 25""")
def j16_held_out_per_language(spark, sf):
    run = documents(spark, sf).filter("source = 'src3'").select("lang").distinct()
    held = O.top_rows(pool(spark, sf).join(run, "lang"), ["lang"], [F.col("hash")], 25, spread=F.col("hash"), rank="rank")
    return held.select("lang", "hash", "rank")


@query("s7_u1_merged_sources", f"""WITH {Q.sentences()}, {Q.sentences('benchmark', 'item_id', 'bench')},
    u AS (SELECT lang, 'table' AS origin, sentence FROM sent UNION ALL SELECT 'en', 'files', sentence FROM bench)
    SELECT lang, origin, count(*) AS n, sum(length(sentence))::BIGINT AS chars FROM u GROUP BY ALL""")
def s7_u1_merged_sources(spark, sf):
    from ..sources.sentences import merge_sources
    table = sentences(spark, sf).select("lang", F.lit("table").alias("origin"), "sentence")
    bench = split_sentences(read_table(spark, sf, "benchmark")).select(
        F.lit("en").alias("lang"), F.lit("files").alias("origin"), "sentence")
    return merge_sources(table, bench).groupBy("lang", "origin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("sentence")).alias("chars"))


@query("c1_c2_text_identity", f"""WITH {Q.sentences()} SELECT doc_id, pos::INT AS pos, {Q.key('sentence')} AS key,
    sha1({Q.key('sentence')}) AS hash FROM sent""")
def c1_c2_text_identity(spark, sf):
    return sentences(spark, sf).select(
        "doc_id", "pos", X.dedup_key(F.col("sentence"), True).alias("key"), X.text_hash(F.col("sentence"), True).alias("hash"))


@query("c3_ids", f"""WITH {Q.sentences()} SELECT doc_id, pos::INT AS pos,
    source || '.' || lang AS speaker_key, source || '.' || lang || '-' || substr(sha1({Q.key('sentence')}), 1, 12) || '-r' || pos % 3 AS utterance_id,
    source || '.' || lang || '.p' || lpad((pos % 7)::VARCHAR, 3, '0') AS job_id FROM sent""")
def c3_ids(spark, sf):
    from ..operators.planning import job_id, speaker_key, utterance_id
    s = sentences(spark, sf)
    k = speaker_key(F.col("source"), F.col("lang"))
    return s.select("doc_id", "pos", k.alias("speaker_key"),
                    utterance_id(k, X.text_hash(F.col("sentence"), True), F.col("pos") % 3).alias("utterance_id"),
                    job_id(k, F.col("pos") % 7).alias("job_id"))


@query("c4_asr_text", f"""WITH {Q.sentences()} SELECT doc_id, pos::INT AS pos,
    trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize(sentence)), 'ß', 'ss'), '[\\p{{P}}\\p{{S}}\\p{{Z}}]', ' ', 'g'), '{Q.WS}', ' ', 'g')) AS normal
    FROM sent""")
def c4_asr_text(spark, sf):
    return sentences(spark, sf).select("doc_id", "pos", X.normalize_text(F.col("sentence")).alias("normal"))


@query("c23_letter_count", """SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters FROM documents""")
def c23_letter_count(spark, sf):
    return documents(spark, sf).select("doc_id", X.letter_count(F.col("text")).cast("bigint").alias("letters"))


@query("c22_file_label", """SELECT page_id, CASE WHEN strpos(substr(base, 2), '.') > 0 THEN regexp_replace(base, '(.)\\.[^.]*$', '\\1') ELSE base END
    || '-' || substr(sha1(url), 1, 8) AS label
    FROM (SELECT page_id, url, regexp_extract(url, '([^/]*)/?$', 1) AS base FROM pages)""")
def c22_file_label(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", X.file_label(F.col("url")).alias("label"))


@query("a32_selection_counts", f"""WITH {Q.sentences()}, {Q.kept()}, pool AS (SELECT *, {SPELL} AS usable FROM kept),
    held AS (SELECT lang, hash FROM pool WHERE usable QUALIFY row_number() OVER (PARTITION BY lang ORDER BY hash) <= 10)
    SELECT lang, count_if(NOT usable) AS untokenizable, least(10, count_if(usable)) AS held_out,
      count_if(usable AND hash NOT IN (SELECT hash FROM held)) AS train_pool,
      least(200, count_if(usable AND hash NOT IN (SELECT hash FROM held))) AS train FROM pool GROUP BY lang""")
def a32_selection_counts(spark, sf):
    p = pool(spark, sf).withColumn("usable", C.letter_symbols(F.col("sentence")).isNotNull())
    held = S.held_out(p.filter("usable"), 10)
    return S.selection_counts(p, held, held, 200)


@query("w15_greedy_coverage")
def w15_greedy_coverage(spark, sf):
    p = pool(spark, sf).withColumn("symbols", C.letter_symbols(F.col("sentence"))).select("lang", "hash", "sentence", "symbols")
    p = written(p, "pool")  # read by every pass and by the join
    return S.greedy_order(p, 40).join(p.select("lang", "hash", "sentence"), ["lang", "hash"])


@query("s16_selection_lists", f"""WITH {Q.sentences()}, {Q.kept()}, r AS (SELECT lang, sentence, row_number() OVER (PARTITION BY lang ORDER BY hash) AS rank FROM kept),
    c AS (SELECT lang, count(*) AS pool FROM kept GROUP BY 1)
    SELECT lang, CASE WHEN rank <= 20 THEN 'held_out' ELSE 'train' END AS list, count(*) AS n, sum(length(sentence))::BIGINT AS chars, max(pool) AS pool FROM r JOIN c USING (lang) GROUP BY ALL""")
def s16_selection_lists(spark, sf):
    """The chosen sentences as text files by language and list, the counts as JSON; both read back."""
    folder = work_folder(spark, "selection")
    p = written(pool(spark, sf).select("lang", "hash", "sentence"), "pool")  # read for the ranks, their offsets and the counts
    ranked = S.hash_ordered(p, ["lang"], "hash", "rank")
    listed = ranked.withColumn("list", F.when(F.col("rank") <= 20, "held_out").otherwise("train"))
    T.write_selection(listed, p.groupBy("lang").agg(F.count(F.lit(1)).alias("pool")), folder)
    counts = spark.read.schema("lang string, pool bigint").json(f"{folder}/stats")
    return spark.read.text(f"{folder}/lists").join(counts, "lang").groupBy("lang", "list").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("value")).alias("chars"), F.max("pool").alias("pool"))


@query("f14_run_of_voice", """WITH v AS (SELECT DISTINCT CASE n_nationkey % 5 WHEN 0 THEN 'en-us' WHEN 1 THEN 'es-419' WHEN 2 THEN 'fr' WHEN 3 THEN 'xx-yy' ELSE 'de' END AS espeak FROM nation),
    r AS (SELECT DISTINCT lang FROM documents)
    SELECT espeak, coalesce(a.lang, b.lang) AS lang FROM v LEFT JOIN r a ON a.lang = espeak LEFT JOIN r b ON b.lang = split_part(espeak, '-', 1) WHERE coalesce(a.lang, b.lang) IS NOT NULL""")
def f14_run_of_voice(spark, sf):
    k = F.col("n_nationkey") % 5
    voices = read_table(spark, sf, "nation").select(
        F.when(k == 0, "en-us").when(k == 1, "es-419").when(k == 2, "fr").when(k == 3, "xx-yy").otherwise("de").alias("espeak"))
    return S.run_of_voice(voices, documents(spark, sf))
