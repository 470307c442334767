"""Symbol categories and classes, code-point notation, pieces and adjacent pairs of a symbol string."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Categories, and the runs in which the open-mid vowel letter is a tone mark.
CATEGORIES = ("phoneme", "supra_diacritic", "punct_space", "tone_digit", "special")
TONE_EPSILON_RUNS = ("cmn", "vi", "yue", "th")
TONE_EPSILON = "ɜ"


def category(symbol: Column, run: Column | None = None) -> Column:
    """Category of a one-character symbol; a character outside the scheme is an error."""
    plain = (
        F.when(symbol.rlike(r"^[\^$_]$"), "special").when(symbol.rlike(r"^[\p{Nd}²³¹⁰-⁹₀-₉]$"), "tone_digit")
        .when(symbol.rlike(r"^[\p{Mn}\p{Lm}↑↓]$"), "supra_diacritic").when(symbol.rlike(r"(?s)^[\p{P}\p{Z}\p{S}]$"), "punct_space")
        .when(symbol.rlike(r"^\p{L}$"), "phoneme").otherwise(F.raise_error(F.concat(F.lit("no category for symbol "), F.hex(symbol)))))
    if run is None:
        return plain
    return F.when((symbol == TONE_EPSILON) & run.isin(*TONE_EPSILON_RUNS), "tone_digit").otherwise(plain)


def code_point(text: Column) -> Column:
    """``U+0041`` notation, characters separated by spaces."""
    return F.array_join(F.transform(characters(text), lambda c: F.format_string("U+%04X", F.ascii(c))), " ")


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)


def pieces(text: Column) -> Column:
    """The text cut after every space; each piece keeps its space, so neighbours inside a word stay together."""
    return F.split(text, "(?<= )")


def char_class(symbols: Iterable[str]) -> str:
    """One-character symbols as the inside of a regular-expression class."""
    return "".join(f"\\x{{{ord(s):x}}}" for s in sorted(symbols))


def adjacent_pairs(symbols: Column, keep, breaks) -> Column:
    """Adjacent kept symbols with nothing but transparent symbols between them; a break separates."""
    relevant = F.filter(symbols, lambda c: keep(c) | breaks(c))
    n = F.size(relevant)
    zipped = F.when(n > 1, F.zip_with(F.slice(relevant, F.lit(1), n - 1), F.slice(relevant, F.lit(2), n - 1),
                                      lambda a, b: F.struct(a.alias("first"), b.alias("second"))))
    return F.filter(zipped, lambda p: keep(p["first"]) & keep(p["second"]))


def inner_markers(symbols: Column, marker) -> Column:
    """Symbols that are markers and have a non-blank neighbour on both sides."""
    n = F.size(symbols)
    blank = lambda c: c.rlike(r"^[\s\p{Z}]$")
    return F.filter(symbols, lambda c, i: (i > 0) & (i < n - 1) & marker(c) & ~blank(F.coalesce(F.try_element_at(symbols, i), F.lit(" ")))
                    & ~blank(F.coalesce(F.try_element_at(symbols, i + 2), F.lit(" "))))
