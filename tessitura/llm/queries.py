"""The registered queries: each applies one operator, with production parameters, to its whole table."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import read_table
from . import associations, bpe, decontam, divergence, hmm, interactions, licenses, repair, rules, sharding, simhash, suffixes, warc
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

#: Bytes of a shard in op6; the operator's own default is 128 MiB, for corpora larger than the test tables.
SHARD_BYTES = 1 << 20
#: Fixed values of the byte-level vocabulary: its size with the special token, and the id that ends a document.
VOCABULARY, END_ID = 50_257, 2


@query("op2_warc_records", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM f
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = warc.archive_round_trip(read_table(spark, sf_dir, "pages"), with_data=False)
    return chunks.filter("last").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


@query("op6_extendible_shards", f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
    lpad(to_binary(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::UBIGINT), 60, '0') AS bits FROM documents),
t AS (SELECT l.depth, substr(d.bits, 1, l.depth) AS prefix, sum(d.n_bytes) AS shard_bytes, count(*) AS shard_docs
    FROM d, (SELECT unnest(range(0, 61)) AS depth) l GROUP BY 1, 2),
m AS (SELECT d.doc_id, d.n_bytes, d.bits, min(t.depth) AS depth FROM d JOIN t
    ON t.prefix = substr(d.bits, 1, t.depth) AND t.shard_bytes <= {SHARD_BYTES} GROUP BY 1, 2, 3)
SELECT m.doc_id, m.n_bytes, CASE WHEN m.depth = 0 THEN '-' ELSE substr(m.bits, 1, m.depth) END AS shard, m.depth,
  t.shard_bytes, t.shard_docs FROM m JOIN t ON t.depth = m.depth AND t.prefix = substr(m.bits, 1, m.depth)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    rows = sharding.shard(docs, "doc_id", F.col("size"), SHARD_BYTES).drop("size")
    totals = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
    return rows.join(totals, "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


@query("op4_rule_ledger", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
g AS (SELECT r, i, list_slice(w, i, i + 2) AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    len([x FOR x IN w IF regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')])::BIGINT AS n_letter_words
    FROM d JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 3 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 10 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_letter_words < 80 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 64 ELSE 0 END) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letter_words, fail_bits::INTEGER AS fail_bits,
  fail_bits & 3 > 0 AS base_failed, fail_bits = 0 AS kept FROM b
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = rules.apply_policy(rules.apply_policy(rows, "base", "base_kept"), "v1")
    return judged.select("doc_id", *rules.MEASURES, "fail_bits", (~F.col("base_kept")).alias("base_failed"), "kept")


@query("op8_prefix_join", r"""
WITH words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS g, least(len(w), 10) AS l
    FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM words WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l),
h AS (SELECT r, i, l, item_id FROM (SELECT r, i, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS g FROM p) JOIN win USING (g, l)),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS k FROM (SELECT DISTINCT r, i, l FROM h)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, 'null') AS x FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = decontam.contamination(docs, read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op7_anchor_covering")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def _template_rows() -> str:
    """The templates as rows of a SQL VALUES list: number, label, words, offset and words of the key."""
    quoted = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    return ", ".join(f"({t}, '{x.label}', {quoted(x.words)}, {x.at}, {quoted(x.key)})" for t, x in enumerate(licenses.BASE + licenses.MORE))


@query("op5_rare_token_index", rf"""
WITH t(t, label, words, off, key) AS (VALUES {_template_rows()}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
f AS (SELECT r, t, label, i, words, w, i - off AS start FROM p JOIN t ON w[i] = key[1] WHERE list_slice(w, i, i + len(key) - 1) = key),
s AS (SELECT r, t, label, i, len([1 FOR x, k IN words IF list_contains(list_slice(w, greatest(1, start + k - 3), greatest(0, start + k + 1)), x)])::DOUBLE / len(words) AS share FROM f),
g AS (SELECT r, count(*) FILTER (WHERE t < 3) AS n_base, min(i) FILTER (WHERE t < 3) - 1 AS first_word, max(i) FILTER (WHERE t < 3) - 1 AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE t < 3) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN g USING (r)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text")))
    base = F.filter("found", lambda x: x["template"] < len(licenses.BASE))
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(F.transform(base, lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["word"])).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"))


@query("op3_hidden_markov")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(read_table(spark, sf_dir, "documents"))


@query("op10_re_pair_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = repair.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, VOCABULARY, END_ID, ids=False)
    return rows.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.encode(docs, path, public_tokenizers.PATTERN, keep_text=False, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op1_sparse_suffixes", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents)),
g AS (SELECT r, doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
s AS (SELECT r, doc_id, i - 1 AS y FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
c AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY r ORDER BY y) <= 50 THEN 0 ELSE 1 END AS new FROM s),
k AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY y) AS span FROM c)
SELECT doc_id, min(y) AS start_word, max(y) + 50 AS end_word, max(y) + 50 - min(y) AS n_words FROM k GROUP BY r, doc_id, span
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per repeated passage and document; documents without one have no row."""
    rows = suffixes.repeated_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = rows.select("doc", F.explode(F.arrays_zip("starts", "ends")).alias("s"))
    return spans.select(F.when(F.col("doc") != F.lit(-(1 << 63)), F.col("doc")).alias("doc_id"), F.col("s.starts").alias("start_word"),
                        F.col("s.ends").alias("end_word"), (F.col("s.ends") - F.col("s.starts")).alias("n_words"))


#: Fixed values of op11: the listed rules.
LISTED = (associations.Rule("block", "net/"), associations.Rule("allow", "example.net/en/"), associations.Rule("block", "example.com/de/"),
          associations.Rule("allow", "org/fr/"))


@query("op11_association_rules", r"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM u),
l(host_rule, path_rule, says) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
b AS (SELECT r, arg_max(host_rule || path_rule, length(host_rule || path_rule)) AS rule, arg_max(says, length(host_rule || path_rule)) AS says
    FROM h JOIN l ON (host = host_rule OR suffix(host, '.' || host_rule)) AND prefix(path, path_rule) GROUP BY r),
d AS (SELECT h.r, page_id, host, path, rule, says, list_distinct([('host:' || x) FOR x IN string_split(host, '.') IF x <> '']
    || [('path:' || regexp_replace(x, '[0-9]+', '#', 'g')) FOR x IN string_split(path, '/') IF x <> '']
    || [('query:' || string_split(x, '=')[1]) FOR x IN string_split(query, '&') IF string_split(x, '=')[1] <> '']) AS tokens FROM h LEFT JOIN b USING (r)),
m AS (SELECT greatest(1, ceil(0.01 * count(*))) AS least FROM d WHERE rule IS NOT NULL),
f AS (SELECT t FROM (SELECT unnest(tokens) AS t FROM d WHERE rule IS NOT NULL) GROUP BY t HAVING count(*) >= (SELECT least FROM m)),
k AS (SELECT r, says, list_sort(list_intersect(tokens, ts)) AS w FROM d, (SELECT coalesce(list(t), []) AS ts FROM f) WHERE rule IS NOT NULL),
s AS (SELECT says, [w[j] FOR j IN range(1, len(w) + 1) IF (c >> (j - 1)) & 1 = 1] AS w FROM (SELECT says, w, unnest(range(1, (1 << len(w))::BIGINT)) AS c FROM k)),
n AS (SELECT w, count(*) AS n_w, count(*) FILTER (WHERE says = 'block') AS n_block, count(*) FILTER (WHERE says = 'allow') AS n_allow FROM s GROUP BY w),
x AS (SELECT w, 'block' AS said, n_block AS n, n_block::DOUBLE / n_w AS conf FROM n UNION ALL SELECT w, 'allow', n_allow, n_allow::DOUBLE / n_w FROM n),
y AS (SELECT * FROM x WHERE n >= (SELECT least FROM m) AND conf >= 0.9),
z AS (SELECT d.r, said, row_number() OVER (PARTITION BY d.r ORDER BY conf DESC, n DESC, len(w), array_to_string(w, ' ')) AS place
    FROM d JOIN y ON list_has_all(d.tokens, y.w) WHERE d.rule IS NULL)
SELECT page_id, host, path, rule, coalesce(says, said, 'allow') AS verdict FROM d LEFT JOIN (SELECT * FROM z WHERE place = 1) USING (r)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a listed rule decides are the labelled ones: ``labels`` tells of documents, not of pages."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return associations.judge(pages, LISTED).select("page_id", "host", "path", "rule", "verdict")


@query("op12_retracted_audit", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM m GROUP BY part, mask),
a(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS fs, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM a, a b, a c, a d, a e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT array_to_string(fs, '') AS filter_order, step, fs[step] AS f, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
    FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
q AS (SELECT part, filter_order, step, f, sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN x ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM q
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    return interactions.audit(interactions.audit_stream(spark, f"{sf_dir.rstrip('/')}/documents.parquet", labels))


@query("op13_divergence_cube", r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, total FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, m.n, 1 + (1000000000::HUGEINT * (m.n + 2)) // (sum(m.n) OVER (PARTITION BY lang, source) + 2 * v.v) AS p,
    1 + (1000000000::HUGEINT * (total + 2)) // (v.n + 2 * v.v) AS q FROM m JOIN v USING (lang)),
e AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term)
    WHERE a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(e.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value, rank::INT AS rank FROM z WHERE part = 'pair' OR rank <= 10
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents").select("text", "lang", "source"))
