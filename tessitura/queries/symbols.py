"""Symbol statistics and tokens, with characters of ``documents`` as symbols and ``benchmark`` as reference alphabet."""
from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import align as A
from ..functions import symbols as Y
from ..functions import text as X
from ..operators import coverage as V
from ..operators import records as R
from ..operators import tokens as K
from ..session import written
from ..sources.tables import balanced, read_table, split_sentences
from . import sql as Q
from .registry import query
from .text import sentences

def texts(spark: SparkSession, sf: str) -> DataFrame:
    return balanced(read_table(spark, sf, "documents").select("doc_id", "lang", "text")).select(
        "doc_id", F.col("lang").alias("run"), X.collapse(F.col("text")).alias("text"))


def alphabet(spark: SparkSession, sf: str) -> list[str]:
    """Distinct characters of the benchmark texts; their number is bounded by Unicode, whatever the table holds."""
    found = read_table(spark, sf, "benchmark").select(F.explode(Y.characters(X.collapse(F.col("text")))).alias("c")).distinct()
    return sorted(r[0] for r in found.collect())


TEXTS = f"t AS (SELECT doc_id, lang AS run, {Q.collapse('text')} AS text FROM documents)"
REF = f"ref AS (SELECT DISTINCT unnest(regexp_extract_all({Q.collapse('text')}, '(?s).')) AS c FROM benchmark)"
CHARS = f"""{TEXTS}, {REF}, ch0 AS (SELECT doc_id, run, unnest(regexp_extract_all(text, '(?s).')) AS symbol, unnest(range(0, len(regexp_extract_all(text, '(?s).')))) AS pos FROM t),
    ch AS (SELECT ch0.*, ref.c IS NOT NULL AS known FROM ch0 LEFT JOIN ref ON ref.c = symbol)"""


def cat(s: str) -> str:
    return f"""CASE WHEN {s} IN ('^', '$', '_') THEN 'special' WHEN regexp_matches({s}, '^\\p{{Nd}}$') THEN 'tone_digit'
        WHEN regexp_matches({s}, '^[\\p{{Mn}}\\p{{Lm}}↑↓]$') THEN 'supra_diacritic' WHEN regexp_matches({s}, '^[\\p{{P}}\\p{{Z}}\\p{{S}}]$') THEN 'punct_space'
        WHEN regexp_matches({s}, '^\\p{{L}}$') THEN 'phoneme' END"""


COUNTS = f"WITH {CHARS}, cnt AS (SELECT run, symbol, known, count(*) AS n FROM ch GROUP BY ALL), cc AS (SELECT *, {cat('symbol')} AS category FROM cnt WHERE known)"
BIGRAMS = f"""kept AS (SELECT doc_id, run, pos, symbol, {cat('symbol')} AS category FROM ch WHERE known),
    rel AS (SELECT *, lead(symbol) OVER w AS next, lead(category) OVER w AS next_category FROM kept WHERE category IN ('phoneme', 'punct_space', 'special')
      AND symbol NOT IN ('↑', '↓') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    big AS (SELECT run, symbol AS first, next AS second, count(*) AS n FROM rel WHERE category = 'phoneme' AND next_category = 'phoneme' GROUP BY ALL)"""


def categorized(spark: SparkSession, sf: str) -> DataFrame:
    counts = V.symbol_counts(V.piece_counts(texts(spark, sf), "run", "text"), alphabet(spark, sf))
    return V.with_category(counts.filter("known"))


def bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return V.bigram_counts(V.piece_counts(texts(spark, sf), "run", "text"), alphabet(spark, sf))


@query("a8_symbol_counts", COUNTS + " SELECT run, symbol, known, n FROM cnt")
def a8_symbol_counts(spark, sf):
    return V.symbol_counts(V.piece_counts(texts(spark, sf), "run", "text"), alphabet(spark, sf)).select("run", "symbol", "known", "n")


@query("a8_inword_markers", f"""WITH {CHARS}, nb AS (SELECT *, lag(symbol) OVER w AS before, lead(symbol) OVER w AS after FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT run, symbol, count(*) AS n FROM nb WHERE known AND {cat('symbol')} = 'punct_space' AND symbol NOT IN ('↑', '↓') AND before IS NOT NULL AND after IS NOT NULL
      AND NOT regexp_matches(symbol, '[\\s\\p{{Z}}]') AND NOT regexp_matches(before, '[\\s\\p{{Z}}]') AND NOT regexp_matches(after, '[\\s\\p{{Z}}]') GROUP BY ALL""")
def a8_inword_markers(spark, sf):
    return V.inword_markers(V.piece_counts(texts(spark, sf), "run", "text"), alphabet(spark, sf))


@query("a9_c10_category_shares", COUNTS + """ SELECT run, symbol, category, n, round(n / sum(n) OVER (PARTITION BY run, category), 9) AS share FROM cc""")
def a9_c10_category_shares(spark, sf):
    return V.shares(categorized(spark, sf), ["run", "category"]).select("run", "symbol", "category", "n", F.round("share", 9).alias("share"))


@query("a10_bigrams", f"WITH {CHARS}, {BIGRAMS} SELECT run, first, second, n FROM big")
def a10_bigrams(spark, sf):
    return bigrams(spark, sf)


@query("a12_pooled_mass", COUNTS + """, s AS (SELECT run, symbol, n / sum(n) OVER (PARTITION BY run) AS share FROM cc WHERE category = 'phoneme')
    SELECT symbol, round(sum(share) / (SELECT count(DISTINCT run) FROM s), 9) AS mass FROM s GROUP BY 1""")
def a12_pooled_mass(spark, sf):
    shares = V.shares(categorized(spark, sf).filter("category = 'phoneme'"), ["run"])
    return V.pooled_mass(shares, shares, ["symbol"]).select("symbol", F.round("mass", 9).alias("mass"))


@query("a13_run_table", COUNTS + f""", {BIGRAMS}
    SELECT t.run, count(*) AS sentences, (SELECT coalesce(sum(n), 0)::BIGINT FROM cc WHERE cc.run = t.run AND category = 'phoneme') AS phoneme_tokens,
      (SELECT count(*) FROM cc WHERE cc.run = t.run AND category = 'phoneme') AS phoneme_types, (SELECT count(*) FROM cc WHERE cc.run = t.run AND category = 'supra_diacritic') AS supra_types,
      (SELECT coalesce(sum(n), 0)::BIGINT FROM cc WHERE cc.run = t.run AND category = 'tone_digit') AS tone_mark_tokens,
      (SELECT coalesce(sum(n), 0)::BIGINT FROM cc WHERE cc.run = t.run AND symbol IN ('^', '$', '_')) AS bos_eos_pad_tokens,
      (SELECT coalesce(sum(n), 0)::BIGINT FROM cnt WHERE cnt.run = t.run AND NOT known) AS dropped_chars, (SELECT count(*) FROM big WHERE big.run = t.run) AS phoneme_bigram_types
    FROM t GROUP BY t.run""")
def a13_run_table(spark, sf):
    pieces, ref = V.piece_counts(texts(spark, sf), "run", "text"), alphabet(spark, sf)
    counts = V.symbol_counts(pieces, ref)
    return V.run_table(texts(spark, sf), "run", V.with_category(counts.filter("known")), counts.filter("NOT known"), V.bigram_counts(pieces, ref))


@query("a14_rare_symbols", COUNTS + """, u AS (SELECT * FROM cc WHERE category IN ('phoneme', 'supra_diacritic')),
    g AS (SELECT symbol, any_value(category) AS category, count(*) FILTER (run <> 'en') AS n_main_runs, count(*) AS n_all_runs, string_agg(run || ':' || n, ' ' ORDER BY n DESC, run) AS runs_with_counts FROM u GROUP BY 1)
    SELECT symbol, 'U+' || lpad(upper(to_hex(unicode(symbol))), 4, '0') AS codepoint, category, n_main_runs, n_all_runs, runs_with_counts FROM g WHERE n_main_runs <= 2 OR n_all_runs <= 2""")
def a14_rare_symbols(spark, sf):
    return V.rare_symbols(categorized(spark, sf), F.col("run") != "en")


@query("a15_c13_u2_symbol_table", COUNTS + """, r AS (SELECT c AS symbol, row_number() OVER (ORDER BY c COLLATE C) - 1 AS id FROM ref)
    SELECT symbol, 'U+' || lpad(upper(to_hex(unicode(symbol))), 4, '0') AS codepoint, any_value(category) AS category, count(DISTINCT run) AS voices_with_symbol, true AS in_reference FROM cc GROUP BY symbol""".replace(
        ", r AS (SELECT c AS symbol, row_number() OVER (ORDER BY c COLLATE C) - 1 AS id FROM ref)", ""))
def a15_c13_u2_symbol_table(spark, sf):
    maps = categorized(spark, sf).select(F.col("run").alias("voice"), "symbol")
    reference = spark.createDataFrame([(c, i) for i, c in enumerate(alphabet(spark, sf))], "symbol string, id int")
    return V.symbol_table(maps, reference).drop("id")


@query("j15_map_differences", COUNTS + """, r AS (SELECT DISTINCT symbol, unicode(symbol) AS id FROM cc WHERE category = 'phoneme'),
    m AS (SELECT DISTINCT run AS voice, symbol, unicode(symbol) + CASE WHEN run = 'fr' AND symbol IN ('a', 'b') THEN 1 ELSE 0 END AS id FROM cc WHERE category IN ('phoneme', 'tone_digit')),
    f AS (SELECT coalesce(m.voice, w.voice) AS voice, coalesce(m.symbol, w.symbol) AS symbol, m.id, w.id AS ref_id
      FROM m FULL JOIN (SELECT voice, r.* FROM (SELECT DISTINCT voice FROM m) CROSS JOIN r) w ON m.voice = w.voice AND m.symbol = w.symbol)
    SELECT voice, count(id) AS n_symbols, count_if(id IS NULL OR ref_id IS NULL OR id <> ref_id) = 0 AS same_as_reference,
      coalesce(string_agg(symbol, ' ' ORDER BY symbol COLLATE C) FILTER (ref_id IS NULL), '') AS extra_vs_reference,
      coalesce(string_agg(symbol, ' ' ORDER BY symbol COLLATE C) FILTER (id IS NULL), '') AS missing_vs_reference,
      coalesce(string_agg(symbol, ' ' ORDER BY symbol COLLATE C) FILTER (id <> ref_id), '') AS id_conflicts FROM f GROUP BY voice""".replace(" COLLATE C", ""))
def j15_map_differences(spark, sf):
    c = categorized(spark, sf)
    reference = c.filter("category = 'phoneme'").select("symbol", F.ascii("symbol").alias("id")).distinct()
    shifted = F.when((F.col("run") == "fr") & F.col("symbol").isin("a", "b"), 1).otherwise(0)
    maps = c.filter("category IN ('phoneme', 'tone_digit')").select(F.col("run").alias("voice"), "symbol", (F.ascii("symbol") + shifted).alias("id"))
    return V.map_differences(maps, reference)


def cover(spark: SparkSession, sf: str, objective: str) -> DataFrame:
    c = written(categorized(spark, sf), "symbols")
    of = lambda name: V.shares(c.filter(F.col("category") == name), ["run"]).select("run", "symbol", "share")
    pairs = V.shares(written(bigrams(spark, sf), "bigrams"), ["run"]).select("run", F.concat("first", "second").alias("symbol"), "share")
    return V.greedy_cover(of("phoneme"), pairs, of("supra_diacritic"), objective)


@query("w16_greedy_cover_types")
def w16_greedy_cover_types(spark, sf):
    return cover(spark, sf, "types")


@query("w17_steps_to_reach")
def w17_steps_to_reach(spark, sf):
    return V.steps_to_reach(cover(spark, sf, "mass"), "types_cov", (0.99, 0.999, 1.0))


# --- tokens: a letter table built by rule ------------------------------------------------------------------------

ACCENTS = "̧̀́̂̃̈"
LETTERS = [chr(c) for c in range(ord("a"), ord("z") + 1)]
KEYS = ["_", "^", "$", " ", ",", ";", ":", ".", "!", "?", *LETTERS, "ß", *ACCENTS]


def letter_table() -> K.TokenTable:
    kind = lambda k: ("special" if k in "_^$" else "space" if k == " " else "punctuation" if k in ",;:.!?" else
                      "diacritic" if k in ACCENTS else "vowel" if k in "aeiou" else "consonant")
    return K.TokenTable({k: i for i, k in enumerate(KEYS)}, {k: kind(k) for k in KEYS}, frozenset({"en", "de", "fr", "es"}), reserved="_^$")


TABLE = letter_table()
LIST = "['" + "', '".join(KEYS) + "']"


def decomposed(text: str) -> str:
    """SQL for the canonical decomposition of the Latin-1 letters whose accents the table has."""
    for c in map(chr, range(0xE0, 0x100)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and parts[1] in ACCENTS:
            text = f"replace({text}, '{c}', '{parts}')"
    return text


# Every sentence; ids is null where a character is not in the table. words: runs of letters, accents left out.
SPOKEN = f"""{Q.sentences()}, low AS (SELECT doc_id, lang, pos, {decomposed('lower(nfc_normalize(sentence))')} AS s FROM sent),
    tk0 AS (SELECT *, regexp_matches(s, '^[a-zß ,;:.!?{ACCENTS}]*$') AS fine FROM low),
    tk AS (SELECT *, CASE WHEN fine THEN [list_position({LIST}, x) - 1 FOR x IN regexp_extract_all(s, '(?s).')] END AS ids,
      CASE WHEN fine THEN regexp_extract_all(regexp_replace(s, '[{ACCENTS}]', '', 'g'), '[a-zß]+') END AS words FROM tk0)"""


def spoken(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(spark, sf).select("doc_id", "lang", "pos", F.lower("sentence").alias("s"))


def tokenized(spark: SparkSession, sf: str) -> DataFrame:
    return K.tokenize(spoken(spark, sf), TABLE, "s", "lang")


@query("t1_t2_tokenize", f"""WITH {SPOKEN} SELECT doc_id, pos::INT AS pos, ids::INT[] AS ids FROM tk""")
def t1_t2_tokenize(spark, sf):
    return tokenized(spark, sf).select("doc_id", "pos", F.col("tokens.ids").alias("ids"))


@query("t1_errors", f"""WITH {SPOKEN} SELECT lang, CASE WHEN fine THEN 'none' ELSE 'unknown_symbol' END AS error, count(*) AS n, sum(len(ids))::BIGINT AS tokens,
    count(DISTINCT nullif(regexp_extract(s, '[^a-zß ,;:.!?{ACCENTS}]'), '')) AS chars FROM tk GROUP BY ALL""")
def t1_errors(spark, sf):
    t = K.tokenize(spoken(spark, sf), TABLE, "s", "lang")
    return t.groupBy("lang", F.coalesce("tokens.error", F.lit("none")).alias("error")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens.ids")).alias("tokens"), F.count_distinct("tokens.char").alias("chars"))


@query("t3_phonetic_sets", f"""WITH {SPOKEN} SELECT doc_id, pos::INT AS pos, list_sort(list_distinct([x FOR x IN ids IF x >= 10]))::INT[] AS symbols FROM tk""")
def t3_phonetic_sets(spark, sf):
    return tokenized(spark, sf).select("doc_id", "pos", K.phonetic_set(F.col("tokens.ids"), TABLE).alias("symbols"))


@query("t5_c12_units", f"""WITH {SPOKEN}
    SELECT doc_id, pos::INT AS pos, len(words) AS words, CASE WHEN fine THEN coalesce(list_sum([length(x) FOR x IN words]), 0)::BIGINT END AS units FROM tk""")
def t5_c12_units(spark, sf):
    words = K.reference_words(K.keys_of(F.col("phoneme_ids"), TABLE), TABLE)["words"]
    held = tokenized(spark, sf).select("doc_id", "pos", F.when(F.col("phoneme_ids").isNotNull(), words).alias("w"))
    return held.select("doc_id", "pos", F.when(F.col("w").isNotNull(), F.size("w")).cast("bigint").alias("words"), F.aggregate(
        "w", F.lit(0).cast("bigint"), lambda a, w: a + F.size(w)).alias("units"))


@query("a11_training_pairs", f"""WITH {SPOKEN}, w AS (SELECT unnest(words) AS word FROM tk WHERE fine),
    p AS (SELECT word, unnest(range(1, greatest(length(word), 1))) AS i FROM w)
    SELECT substr(word, i, 1) AS first, substr(word, i + 1, 1) AS second, count(*) AS "count" FROM p GROUP BY ALL""")
def a11_training_pairs(spark, sf):
    return K.training_pairs(tokenized(spark, sf).filter(F.col("tokens.error").isNull()), TABLE)


@query("j18_pair_status", f"""WITH {SPOKEN}, w AS (SELECT doc_id, pos, unnest(words) AS word, unnest(range(0, len(words))) AS wi FROM tk WHERE fine),
    c AS (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w WHERE word <> ''),
    tr AS (SELECT DISTINCT substr(word, i, 1) AS f, substr(word, i + 1, 1) AS s2 FROM c WHERE i < length(word) AND doc_id % 2 = 0),
    u AS (SELECT doc_id, pos, wi, i, (i > 1 AND (substr(word, i - 1, 1), substr(word, i, 1)) NOT IN (SELECT (f, s2) FROM tr))
      OR (i < length(word) AND (substr(word, i, 1), substr(word, i + 1, 1)) NOT IN (SELECT (f, s2) FROM tr)) AS unseen FROM c WHERE doc_id % 2 = 1)
    SELECT doc_id, count(*) AS units, count_if(unseen) AS unseen FROM u GROUP BY 1""")
def j18_pair_status(spark, sf):
    fine = written(tokenized(spark, sf).filter(F.col("tokens.error").isNull()).select(
        "doc_id", "pos", K.reference_words(K.keys_of(F.col("phoneme_ids"), TABLE), TABLE, bases=True)["words"].alias("words")), "units")
    trained = K.pair_counts(fine.filter("doc_id % 2 = 0"), "words")
    rows = fine.filter("doc_id % 2 = 1").select(F.struct("doc_id", "pos").alias("key"), "words")
    status = K.unit_pair_status(rows, "key", "words", trained)
    return status.groupBy(F.col("key.doc_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("units"), F.count_if(~F.col("seen")).alias("unseen"))


@query("c11_symbol_classes", COUNTS + f""" SELECT symbol, any_value(CASE WHEN symbol IN ('^', '$', '_', ' ', ',', ';', ':', '.', '!', '?') THEN 'transparent' WHEN regexp_matches(symbol, '^[a-zß]$') THEN 'phone'
    WHEN regexp_matches(symbol, '^\\p{{Nd}}$') THEN 'transparent' WHEN regexp_matches(symbol, '^[\\p{{Mn}}\\p{{Lm}}]$') THEN 'mark' WHEN regexp_matches(symbol, '^\\p{{L}}$') THEN 'phone'
    ELSE 'transparent' END) AS class, sum(n)::BIGINT AS n FROM cnt GROUP BY 1""")
def c11_symbol_classes(spark, sf):
    counts = V.symbol_counts(V.piece_counts(texts(spark, sf), "run", "text"), alphabet(spark, sf))
    return counts.groupBy("symbol").agg(F.sum("n").alias("n")).select("symbol", K.symbol_class(F.col("symbol"), TABLE, True).alias("class"), "n")


@query("v6_compare_ids", f"""WITH {SPOKEN}, r AS (SELECT doc_id || '-' || pos AS id, lang AS teacher, pos % 10 = 0 AND fine AS changed FROM tk)
    SELECT teacher, count(*) AS records, count_if(changed) AS differing, array_to_string((list(id ORDER BY id) FILTER (changed))[1:3], ' ') AS first_ids FROM r GROUP BY teacher""")
def v6_compare_ids(spark, sf):
    fresh = written(tokenized(spark, sf).select(
        F.concat_ws("-", "doc_id", "pos").alias("id"), F.col("lang").alias("teacher"), "pos", "phoneme_ids"), "fresh-ids", "zstd")
    stored = fresh.withColumn("phoneme_ids", F.when(F.col("pos") % 10 == 0, F.reverse("phoneme_ids")).otherwise(F.col("phoneme_ids")))
    return R.compare_ids(stored, fresh)


@query("v10_parseable_rows", f"""WITH {SPOKEN} SELECT lang, CASE WHEN fine THEN 'kept' ELSE 'rejected' END AS part, count(*) AS n FROM tk GROUP BY ALL""")
def v10_parseable_rows(spark, sf):
    kept, rejected = K.parseable(spoken(spark, sf), TABLE, "s", "lang")
    both = kept.select("lang", F.lit("kept").alias("part")).unionByName(rejected.select("lang", F.lit("rejected").alias("part")))
    return both.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))


OLD_MAPS = {"full": {k: i for i, k in enumerate(KEYS)}, "letters": {k: i for i, k in enumerate(KEYS[:36]) if k not in "qx,"}}


@query("t4_a17_lossy_maps", f"""WITH {SPOKEN}, maps(voice, keys) AS (VALUES ('full', {LIST}), ('letters', list_filter({LIST}[1:36], lambda k: k NOT IN ('q', 'x', ',')))),
    c AS (SELECT voice, keys, trim(s) AS s FROM tk, maps),
    d AS (SELECT voice, s <> '' AND len([w FOR w IN string_split(s, ' ') IF w <> '' AND NOT list_contains(keys, w)]) = 0 AS split,
      [x FOR x IN regexp_extract_all(s, '(?s).') IF NOT list_contains(keys, x)] AS lost FROM c),
    n AS (SELECT voice, x, count(*) AS n FROM (SELECT voice, unnest(lost) AS x FROM d) GROUP BY ALL),
    g AS (SELECT voice, count(*) AS sentences, count_if(len(lost) > 0 OR split) AS lossy_sentences FROM d GROUP BY voice)
    SELECT g.*, coalesce((SELECT string_agg(x || ':' || n, ' ' ORDER BY n DESC, x) FROM n WHERE n.voice = g.voice), '') AS dropped_chars FROM g""")
def t4_a17_lossy_maps(spark, sf):
    """Every sentence under both maps; equal sentences are replayed once."""
    rows = spoken(spark, sf).groupBy("s", "lang").agg(F.count(F.lit(1)).alias("times")).withColumn("voice", F.explode(F.array(F.lit("full"), F.lit("letters"))))
    return K.lossy_report(K.remap(rows, TABLE, OLD_MAPS, "s", "voice", "lang"), "voice", "times")


# --- alignment over consecutive turns ----------------------------------------------------------------------------

def turns(spark: SparkSession, sf: str) -> DataFrame:
    t = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    pairs = t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("ref"), "hyp")
    return balanced(pairs)


TURNS = """p AS (SELECT a.conv_id, a.turn, a.text AS ref, b.text AS hyp FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
NORMAL = "trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '[\\p{{P}}\\p{{S}}\\p{{Z}}]', ' ', 'g'), '" + Q.WS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"


def one_byte(s: str) -> str:
    """DuckDB counts edits by byte, so letters of several bytes become capitals, which the normal form has not."""
    return f"translate({s}, 'äçèéêíñóöüáúàâîïôûëœæ', 'ABCDEFGHIJKLMNOPQRSTU')"


@query("c5_c9_character_errors", f"""WITH {TURNS}, n AS (SELECT conv_id, turn, {one_byte(NORMAL.format('ref'))} AS r, {one_byte(NORMAL.format('hyp'))} AS h FROM p)
    SELECT conv_id, turn, levenshtein(r, h) AS edits, length(r) AS length, round(levenshtein(r, h) / nullif(length(r), 0), 9) AS rate FROM n""")
def c5_c9_character_errors(spark, sf):
    t = turns(spark, sf).select("conv_id", "turn", X.normalize_text(F.col("ref")).alias("r"), X.normalize_text(F.col("hyp")).alias("h"))
    e = A.edit_count(F.col("r"), F.col("h"))
    return t.select("conv_id", "turn", e["edits"].cast("bigint").alias("edits"), e["length"].cast("bigint").alias("length"),
                    F.round(A.error_rate(e["edits"], e["length"]), 9).alias("rate"))


@query("c6_alignment", f"""WITH {TURNS}, n AS (SELECT conv_id, turn, {one_byte(NORMAL.format('ref'))} AS r, {one_byte(NORMAL.format('hyp'))} AS h FROM p)
    SELECT conv_id, turn, levenshtein(r, h) AS edits, length(r) AS ref_units, length(h) AS hyp_units FROM n""")
def c6_alignment(spark, sf):
    t = turns(spark, sf).select("conv_id", "turn", Y.characters(X.normalize_text(F.col("ref"))).alias("r"), Y.characters(X.normalize_text(F.col("hyp"))).alias("h"))
    steps = t.select("conv_id", "turn", A.align(F.col("r"), F.col("h")).alias("steps"))
    n = lambda test: F.size(F.filter("steps", test)).cast("bigint")
    return steps.select("conv_id", "turn", n(lambda s: s["op"] != "match").alias("edits"), n(lambda s: s["ref"].isNotNull()).alias("ref_units"),
                        n(lambda s: s["hyp"].isNotNull()).alias("hyp_units"))


@query("c7_c8_unit_edits")
def c7_c8_unit_edits(spark, sf):
    clean = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L} ]", "")
    words = lambda c: F.transform(F.filter(F.split(c, " "), lambda w: w != ""), lambda w: F.transform(
        Y.characters(w), lambda x: F.struct(x.alias("base"), F.lit("").alias("marks"))))
    t = turns(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("key"), words(clean(F.col("ref"))).alias("ref"), words(clean(F.col("hyp"))).alias("hyp")).filter(F.size(F.flatten("ref")) > 0)
    trained = K.pair_counts(t, "hyp")
    edits = t.select("key", A.unit_edits(K.labels(F.flatten("ref")), K.labels(F.flatten("hyp"))).alias("edits"))
    return K.split_by_pair_status(edits, "key", "edits", K.unit_pair_status(t, "key", "ref", trained))
