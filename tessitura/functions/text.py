"""Text identity, normalization and the sentence class filter."""
from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# What counts as white space when a text is split into words.
# The nested class with the outer bounds lets most characters pass after a few tests.
_BLANK = r"[\x{9}-\x{d}\x{1c}-\x{20}[\x{85}-\x{3000}&&[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
WHITESPACE = f"{_BLANK}+"
# Runs that are not already one space.
ODD_SPACE = f" {_BLANK}++|[{_BLANK}&&[^ ]]{_BLANK}*+"

# Reject reasons, in the order they are tested.
REASONS = ("too_short", "too_long", "digit", "url", "symbol", "abbreviation", "mixed_script")
DUPLICATE = "duplicate"

# Patterns of the class filter.
DIGIT = r"\p{N}"
URL = r"(?iu)https?://|www\.|\.(?:com|org|net|edu|gov)(?![\p{L}\p{N}_])|@"
SYMBOL = r"[#%&*/\\_|~\[\]{}<>§¶†‡•@^`=+\p{S}]"
LETTER_DOT_LETTER = r"(?<!\p{L})\p{L}\.\p{L}"
SHORT_CAPITAL_DOT = r"(?<!\p{L})[\p{L}&&\p{IsUppercase}]\p{L}{0,2}\.\s"
STARTS_UPPER = r"^\P{L}*+[\p{L}&&\p{IsUppercase}]"
DOT_THEN_LOWER = r"\.\s+[\p{L}&&\p{IsLowercase}]"
ALL_CAPS_WORD = (
    r"(?<!\S)(?:[^\s[\p{L}&&[\p{IsLowercase}\p{IsUppercase}]]]*+[\p{L}&&\p{IsUppercase}]){2}"
    r"[^\s[\p{L}&&\p{IsLowercase}]]*+(?!\S)"
)


@dataclass(frozen=True)
class WordLimits:
    min_words: int = 4
    max_words: int = 25


def _java_class(points: list[int], leaf: int = 4) -> str:
    """Sorted code points as the inside of a Java character class, contiguous runs merged.

    Java tests the members of a class one after the other, so runs are nested in halves, each guarded by its outer bounds: a
    character is settled after some log2(runs) tests. ASCII stands first.
    """
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1 and p != 0x80:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    show = lambda first, last: f"\\x{{{first:x}}}" if first == last else f"\\x{{{first:x}}}-\\x{{{last:x}}}"

    def nested(part: list[list[int]]) -> str:
        if len(part) <= leaf:
            return "".join(show(*r) for r in part)
        halves = (part[:len(part) // 2], part[len(part) // 2:])
        return "".join(f"[{show(h[0][0], h[-1][1])}&&[{nested(h)}]]" for h in halves)

    return "".join(f"[{nested(part)}]" for part in ([r for r in runs if r[1] < 0x80], [r for r in runs if r[0] >= 0x80]) if part)


@lru_cache(maxsize=1)
def latin_letters() -> str:
    """Letters whose Unicode character name begins with LATIN (narrower than the Latin script)."""
    points = [
        c for c in range(sys.maxunicode + 1)
        if unicodedata.category(chr(c))[0] == "L" and unicodedata.name(chr(c), "").startswith("LATIN")
    ]
    return _java_class(points)


@lru_cache(maxsize=1)
def _plain_folding() -> str:
    """Characters for which lower-casing already is NFC plus case folding, whatever stands next to them."""
    second = set()
    for c in range(0x3200):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(int(parts[1], 16))
    ranges = [*range(0x20, 0x530), *range(0x2010, 0x2028), *range(0x3041, 0x3097), *range(0x30A1, 0x30FB),
              *range(0x4E00, 0xA000), *range(0xAC00, 0xD7A4)]
    points = []
    for p in ranges:
        c = chr(p)
        if (
            unicodedata.category(c) not in ("Cn", "Cc") and unicodedata.combining(c) == 0 and p not in second
            and unicodedata.is_normalized("NFC", c) and c.casefold() == c.lower() and len(c.lower()) == 1
            and p != 0x3A3  # capital sigma lower-cases by context
        ):
            points.append(p)
    return _java_class(points)


def collapse(text: Column) -> Column:
    """White space trimmed and collapsed to single spaces."""
    return F.trim(F.regexp_replace(text, ODD_SPACE, " "))


def word_count(collapsed: Column) -> Column:
    return F.when(collapsed == "", F.lit(0)).otherwise(F.size(F.split(collapsed, " ")))


def _each(texts: pa.Array, form: Callable[[str], str]) -> pa.Array:
    return texts if texts.null_count == len(texts) else pa.array([None if t is None else form(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _fold_nfc(texts: pa.Array) -> pa.Array:
    return _each(texts, lambda t: unicodedata.normalize("NFC", t).casefold())


@F.arrow_udf(T.StringType())
def _fold_nfkc(texts: pa.Array) -> pa.Array:
    return _each(texts, lambda t: unicodedata.normalize("NFKC", t).casefold())


@F.arrow_udf(T.StringType())
def _nfd(texts: pa.Array) -> pa.Array:
    return _each(texts, lambda t: unicodedata.normalize("NFD", t))


def dedup_key(text: Column, collapsed: bool = False) -> Column:
    """Identity of a text: NFC, case folded, white space collapsed (``collapsed``: it already is).

    Rows of characters that lower-casing settles stay in the JVM; only the others visit the Python worker
    (it receives null for every row of the first kind).
    """
    plain = text if collapsed else collapse(text)
    easy = plain.rlike(f"^[{_plain_folding()}]*+$")
    return F.when(easy, F.lower(plain)).otherwise(collapse(_fold_nfc(F.when(~easy, plain))))


def text_hash(text: Column, collapsed: bool = False) -> Column:
    return F.sha1(dedup_key(text, collapsed).cast("binary"))


def normalize_text(text: Column) -> Column:
    """Form in which a text is compared with recognizer output: NFKC, case folded, P/S/Z to spaces."""
    ascii_only = text.rlike(r"^[\x00-\x7f]*+$")
    folded = F.when(ascii_only, F.lower(text)).otherwise(_fold_nfkc(F.when(~ascii_only, text)))
    return collapse(F.regexp_replace(folded, r"[\p{P}\p{S}\p{Z}]", " "))


def teacher_string(phonemes: Column) -> Column:
    """Trimmed and canonically decomposed, the form the token table reads."""
    edges = F.concat(F.left(phonemes, F.lit(1)), F.right(phonemes, F.lit(1)))
    trimmed = F.when(edges.rlike(_BLANK), F.regexp_replace(phonemes, f"^{WHITESPACE}|{WHITESPACE}$", "")).otherwise(phonemes)
    ascii_only = trimmed.rlike(r"^[\x00-\x7f]*+$")
    return F.when(ascii_only, trimmed).otherwise(_nfd(F.when(~ascii_only, trimmed)))


def is_abbreviation(text: Column) -> Column:
    return (
        text.rlike(LETTER_DOT_LETTER) | text.rlike(SHORT_CAPITAL_DOT)
        | (text.rlike(STARTS_UPPER) & text.rlike(DOT_THEN_LOWER)) | text.rlike(ALL_CAPS_WORD)
    )


def is_mixed_script(text: Column) -> Column:
    latin = latin_letters()
    return text.rlike(f"[{latin}]") & text.rlike(f"[\\p{{L}}&&[^{latin}]]")


def reject_reason(collapsed: Column, min_words, max_words) -> Column:
    """First reason of ``REASONS`` that applies to an already collapsed text, else null."""
    words = word_count(collapsed)
    tests = (
        words < min_words, words > max_words, collapsed.rlike(DIGIT), collapsed.rlike(URL),
        collapsed.rlike(SYMBOL), is_abbreviation(collapsed), is_mixed_script(collapsed),
    )
    reason = F.lit(None).cast("string")
    for name, test in reversed(list(zip(REASONS, tests, strict=True))):
        reason = F.when(test, name).otherwise(reason)
    return reason


def letter_count(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"\P{L}", ""))


# Scripts written without spaces between words.
SPACELESS_SCRIPTS = ("Hans", "Hant", "Jpan", "Thai")


def corpus_keep(line: Column, script: Column, min_words: int = 4, min_chars: int = 12) -> Column:
    """Earlier corpus filter: no decimal digits or links, no ASCII letters outside Latin script, long enough."""
    link = r"https?://|www\.|\.com(?![\p{L}\p{N}_])|\.org(?![\p{L}\p{N}_])|@"
    long_enough = F.when(script.isin(*SPACELESS_SCRIPTS), F.char_length(line) >= min_chars).otherwise(
        word_count(collapse(line)) >= min_words)
    foreign = (script != "Latn") & line.rlike("[A-Za-z]")
    return ~line.rlike(r"\p{Nd}") & ~line.rlike(link) & ~foreign & long_enough


def file_label(path: Column) -> Column:
    """``<stem>-<8 hex digits of the path's SHA-1>``: clip names repeat across folders."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)/?$", 1), r"(?<=.)\.[^.]*$", "")
    return F.concat(stem, F.lit("-"), F.substring(F.sha1(path.cast("binary")), 1, 8))
