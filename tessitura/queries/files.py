"""File formats: tables of the given data written, read back with their checks, and counted."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.symbols import char_class
from ..operators import catalog as C
from ..operators import packing as P
from ..operators import records as R
from ..session import work_folder
from ..sources import readers as D
from ..sources import sentences as T
from ..sources.tables import read_table
from . import sql as Q
from .registry import query
from .symbols import BIGRAMS, CHARS, REF, alphabet, bigrams
from .text import pool


@query("s9_pair_counts_file", f"WITH {CHARS}, {BIGRAMS} SELECT first, second, sum(n)::BIGINT AS \"count\" FROM big GROUP BY ALL")
def s9_pair_counts_file(spark, sf):
    folder = work_folder(spark, "pairs")
    D.write_pair_counts(bigrams(spark, sf).groupBy("first", "second").agg(F.sum("n").alias("count")), folder)
    return D.read_pair_counts(spark, folder)


@query("s11_voice_lists", """SELECT s_name AS voice, CASE s_suppkey % 3 WHEN 0 THEN 'mms' WHEN 1 THEN 'mimic3' ELSE 'piper' END AS kind, CASE WHEN s_suppkey % 3 < 2 THEN 'n' || s_nationkey END AS espeak,
    CASE s_suppkey % 3 WHEN 0 THEN '/box/' || s_suppkey || '/t.txt' ELSE '/box/' || s_suppkey || '/m.mnn' END AS path FROM supplier""")
def s11_voice_lists(spark, sf):
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    at = lambda name: F.concat(F.lit("/lap/"), k, F.lit("/" + name))
    spec = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("mms:n"), n, F.lit(":"), at("m.mnn"), F.lit("|"), at("t.txt"))).when(
        F.col("s_suppkey") % 3 == 1, F.concat(F.lit("mimic3:n"), n, F.lit(":"), at("m.onnx.json"))).otherwise(at("m.onnx.json"))
    lines = read_table(spark, sf, "supplier").select(F.concat("s_name", F.lit("\t"), spec).alias("value"))
    parsed = C.parse_voice_lists(lines, "/lap", "/box")
    return parsed.select("voice", "kind", "espeak", F.when(F.col("kind") == "mms", F.col("paths")["tokens"]).otherwise(F.try_element_at("paths", F.lit("mnn"))).alias("path"))


@query("s5_s6_manifest_file", """SELECT 'v' || (c_custkey % 40) AS voice, c_custkey::VARCHAR AS speaker, 'n' || c_nationkey AS espeak, c_name || ' ' || c_mktsegment AS text,
    round(abs(c_acctbal), 2) AS cpu_s FROM customer""")
def s5_s6_manifest_file(spark, sf):
    folder = work_folder(spark, "manifest")
    rows = read_table(spark, sf, "customer").select(
        F.concat(F.lit("v"), (F.col("c_custkey") % 40).cast("string")).alias("voice"), F.col("c_custkey").cast("string").alias("speaker"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("espeak"), F.lit(0).alias("idx"), F.concat("c_name", F.lit(".wav")).alias("file"),
        F.lit(22050).alias("sample_rate"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"), F.abs("c_acctbal").alias("cpu_s"))
    D.write_manifest(rows, folder)
    return D.read_manifest(spark, folder).select("voice", "speaker", "espeak", "text", F.round("cpu_s", 2).alias("cpu_s"))


VOCAB = R.Vocabulary(10, 0, 1, 2)


@query("s1_s2_s14_shard_files", """SELECT lang AS language, count(*) AS records, count(DISTINCT doc_id) AS ids, sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS timed FROM documents GROUP BY 1""")
def s1_s2_s14_shard_files(spark, sf):
    folder = work_folder(spark, "shards")
    ids = F.array(*[F.lit(x) for x in (1, 0, 5, 0, 2)])
    docs = read_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("x").alias("audio"), F.col("lang").alias("language"), F.col("lang").alias("espeak"), F.col("source").alias("speaker"),
        F.lit("clean").alias("condition"), ids.alias("phoneme_ids"), F.when(F.col("doc_id") % 2 == 0, F.array_repeat(F.lit(1), 5)).alias("durations"), F.col("text"),
        F.col("source").alias("teacher"), F.lit(1.0).alias("weight"), F.col("n_chars").alias("size"))
    D.write_shards(P.assign_shards(docs, "id", "size", 1_000_000, seed=1).drop("size", "shard_order"), folder)
    back = D.read_valid_shards(spark, f"{folder}/*/*.json", VOCAB)
    loose = D.read_loose_records(spark, f"{folder}/*/*.json").select("id")
    return back.join(loose, "id").groupBy("language").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("id").alias("ids"), F.count("durations").alias("timed"))


@query("s7_sentence_table_file", f"WITH {Q.sentences()}, {Q.kept()} SELECT lang, count(*) AS n, sum(length(sentence))::BIGINT AS chars FROM kept GROUP BY 1")
def s7_sentence_table_file(spark, sf):
    folder = work_folder(spark, "sentences")
    pool(spark, sf).select("lang", F.lit("app"), "sentence").write.option("sep", "\t").option("quote", "").csv(folder)
    return T.read_sentence_table(spark, folder).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query("s21_phonemized_file", f"""WITH {REF} SELECT lang AS run, count(*) AS rows, sum(len(list_filter(regexp_extract_all(text, '(?s).'), lambda x: list_contains(known, x))))::BIGINT AS tokens
    FROM documents, (SELECT list(c) AS known FROM ref) GROUP BY 1""")
def s21_phonemized_file(spark, sf):
    """Documents as phonemized lines: the tokens are the characters that the benchmark's alphabet has."""
    folder, letters = work_folder(spark, "phonemized"), alphabet(spark, sf)
    rows = read_table(spark, sf, "documents").select(
        F.col("lang").alias("run"), F.col("doc_id").cast("int").alias("idx"), F.col("text").alias("phonemes"),
        F.regexp_extract_all("text", F.lit(f"([{char_class(letters)}])"), 1).alias("tokens"))
    rows.write.json(folder)
    return D.read_phonemized(spark, folder, letters).groupBy("run").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size("tokens")).alias("tokens"))


def _delimited(rows, folder: str, sep: str = "\t"):
    rows.write.option("header", True).option("sep", sep).option("emptyValue", "").csv(folder)
    return folder


@query("s3_tab_table_file", """SELECT n_name AS locale, r_name AS language FROM nation JOIN region ON n_regionkey = r_regionkey""")
def s3_tab_table_file(spark, sf):
    folder = work_folder(spark, "tab")
    n, r = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.explode(F.array(
        F.concat_ws("\t", "n_name", "r_name"), F.concat(F.lit("# key "), F.col("n_nationkey").cast("string")))).alias("value"))
    rows.write.text(f"{folder}/body")
    lines = spark.read.text(f"{folder}/body").select(F.lit(1).alias("turn"), "value").unionByName(spark.range(1).select(F.lit(0).alias("turn"), F.lit("locale\tlanguage").alias("value")))
    lines.repartition(1).sortWithinPartitions("turn").select("value").write.text(f"{folder}/table")  # a dimension: one row a nation, its header first
    return D.read_tab_table(spark, f"{folder}/table").select("locale", "language")


@query("s17_languages_file", """SELECT 'c' || c_custkey AS espeak, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS whisper, CASE WHEN c_custkey % 5 > 0 THEN 'n' || c_nationkey END AS voxlingua FROM customer""")
def s17_languages_file(spark, sf):
    c = F.col("c_custkey")
    rows = read_table(spark, sf, "customer").select(
        F.concat(F.lit("c"), c.cast("string")).alias("espeak"), F.when(c % 3 > 0, F.col("c_mktsegment")).alias("whisper"),
        F.when(c % 5 > 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("voxlingua"))
    return D.read_languages(spark, _delimited(rows, work_folder(spark, "languages")))


@query("s24_held_out_file", """SELECT lang AS espeak, doc_id::INT AS idx, source || ' ' || doc_id AS text FROM documents""")
def s24_held_out_file(spark, sf):
    rows = read_table(spark, sf, "documents").select(F.col("lang").alias("espeak"), F.col("doc_id").cast("int").alias("idx"),
                                                     F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("text"))
    return D.read_held_out(spark, _delimited(rows, work_folder(spark, "held-out")))


@query("s24_voices_file", "SELECT s_name AS voice, s_nationkey::VARCHAR AS speaker FROM supplier")
def s24_voices_file(spark, sf):
    rows = read_table(spark, sf, "supplier").select(F.col("s_name").alias("voice"), F.col("s_nationkey").cast("string").alias("speaker"))
    return D.read_voices(spark, _delimited(rows, work_folder(spark, "voices")))


@query("s22_ab_items_file", """SELECT 'v' || (p_partkey % 20) AS voice, '0' AS speaker, 'n' || (p_partkey % 7) AS language, p_partkey::VARCHAR AS item, p_name AS text, 'o/' || p_partkey AS original, 'c/' || p_partkey AS candidate FROM part""")
def s22_ab_items_file(spark, sf):
    k = F.col("p_partkey")
    named = lambda head, value: F.concat(F.lit(head), value.cast("string"))
    rows = read_table(spark, sf, "part").select(
        named("v", k % 20).alias("voice"), F.lit("0").alias("speaker"), named("n", k % 7).alias("language"), k.cast("string").alias("item"),
        F.col("p_name").alias("text"), named("o/", k).alias("original"), named("c/", k).alias("candidate"))
    return D.read_ab_items(spark, _delimited(rows, work_folder(spark, "ab-items")))


@query("s22_rating_items_file", """SELECT 'n' || (p_partkey % 7) AS language, 'v' || (p_partkey % 20) AS voice, '0' AS speaker, p_partkey::VARCHAR AS item, p_name AS text, 'f/' || p_partkey AS file FROM part""")
def s22_rating_items_file(spark, sf):
    k = F.col("p_partkey")
    named = lambda head, value: F.concat(F.lit(head), value.cast("string"))
    rows = read_table(spark, sf, "part").select(
        named("n", k % 7).alias("language"), named("v", k % 20).alias("voice"), F.lit("0").alias("speaker"), k.cast("string").alias("item"),
        F.col("p_name").alias("text"), named("f/", k).alias("file"))
    return D.read_rating_items(spark, _delimited(rows, work_folder(spark, "rating-items")))


HOST = "mirror.example.org"


def catalogue_index(spark, sf):
    """Parts as catalogue files: most mirrored, some only upstream, some known twice."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("models/"), k.cast("string"), F.lit(".onnx"))
    file = lambda url, size: F.to_json(F.struct(F.create_map(k.cast("string"), F.struct(F.array(F.struct(
        url.alias("url"), path.alias("mirrorPath"), size.alias("sizeBytes"))).alias("files"))).alias("packs"))).alias("value")
    part = read_table(spark, sf, "part")
    up = F.concat(F.lit("https://up.example.net/"), path)
    source = part.filter(k % 3 != 0).select(file(up, F.col("p_size")))
    mirror = part.filter(k % 4 == 0).select(file(F.concat(F.lit(f"https://{HOST}/"), path), k * 10))
    extra = part.filter(k % 6 == 0).select(path.alias("path"), F.concat(F.lit("https://more.example.com/"), path).alias("url"), F.lit(0).alias("size"))
    return C.url_index(source, mirror, extra, HOST)


INDEX = f"""p AS (SELECT p_partkey AS k, p_size, 'models/' || p_partkey || '.onnx' AS path FROM part),
    ix AS (SELECT path, list_filter([CASE WHEN k % 4 = 0 OR k % 3 <> 0 THEN 'https://{HOST}/' || path END, CASE WHEN k % 3 <> 0 THEN 'https://up.example.net/' || path END,
      CASE WHEN k % 6 = 0 THEN 'https://more.example.com/' || path END], lambda x: x IS NOT NULL) AS urls, nullif(CASE WHEN k % 4 = 0 AND k > 0 THEN k * 10 WHEN k % 3 <> 0 THEN p_size END, 0) AS size
      FROM p WHERE k % 4 = 0 OR k % 3 <> 0 OR k % 6 = 0)"""


@query("s10_url_index", f"WITH {INDEX} SELECT path, array_to_string(urls, ' ') AS urls, size::BIGINT AS size FROM ix")
def s10_url_index(spark, sf):
    return catalogue_index(spark, sf).select("path", F.array_join("urls", " ").alias("urls"), F.col("size").cast("bigint").alias("size"))


@query("j14_required_files", f"WITH {INDEX} SELECT p.path, array_to_string(ix.urls, ' ') AS urls, ix.urls IS NULL AS missing FROM p LEFT JOIN ix USING (path)")
def j14_required_files(spark, sf):
    required = read_table(spark, sf, "part").select(F.concat(F.lit("models/"), F.col("p_partkey").cast("string"), F.lit(".onnx")).alias("path"))
    return C.plan_fetch(required, catalogue_index(spark, sf)).select("path", F.array_join("urls", " ").alias("urls"), "missing")
