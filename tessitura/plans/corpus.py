"""The corpus selection flow: sentences, class filter, first copies, hold-out, leak guard, counts."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import WordLimits, text_hash
from ..operators import selection as S
from ..session import written
from ..sources.tables import split_sentences

# Characters a letter-level symbol table can represent.
SPELLABLE = r"^[\p{L}\p{M} ,;:'’()-]*+$"


@dataclass(frozen=True)
class SelectionOptions:
    limits: WordLimits = WordLimits()
    max_by_language: dict[str, int] = field(default_factory=dict)
    held_out: int = 20
    train: int = 1000


def letter_symbols(sentence: Column) -> Column:
    """Distinct lower-case letters as sorted code points; null where the text has a character without a symbol."""
    letters = F.array_distinct(F.regexp_extract_all(F.lower(sentence), F.lit(r"(\p{L})"), 1))
    return F.when(sentence.rlike(SPELLABLE), F.array_sort(F.transform(letters, F.ascii)))


def sentence_pool(documents: DataFrame, options: SelectionOptions) -> DataFrame:
    """Accepted first copies with hash and symbols, one row per language and text."""
    sentences = split_sentences(documents.select("doc_id", "lang", "text"))
    kept = S.keep_first(S.classify(sentences, options.limits, options.max_by_language))
    return kept.withColumn("symbols", letter_symbols(F.col("sentence")))


def forbidden_texts(benchmark: DataFrame) -> DataFrame:
    return split_sentences(benchmark.select("item_id", "text")).select(text_hash(F.col("sentence"), True).alias("hash"))


def select_sentences(documents: DataFrame, benchmark: DataFrame, options: SelectionOptions):
    """(pool, held-out rows, training candidates). The pool is written once: what follows reads it several times."""
    pool = written(sentence_pool(documents, options), "pool")
    usable = pool.filter(F.col("symbols").isNotNull())
    held = S.held_out(usable, options.held_out)
    return pool, held, S.leak_guard(usable, held, forbidden_texts(benchmark))


def selection_report(documents: DataFrame, benchmark: DataFrame, options: SelectionOptions) -> DataFrame:
    """Counts per language. The pool's identities are written once: three later steps read them, the text only once."""
    pool = sentence_pool(documents, options).select("lang", "hash", F.col("symbols").isNotNull().alias("usable"))
    pool = written(pool, "pool")
    held = S.held_out(pool.filter("usable"), options.held_out)
    blocked = held.select("hash").unionByName(forbidden_texts(benchmark))
    return S.selection_counts(pool, held, blocked, options.train)
