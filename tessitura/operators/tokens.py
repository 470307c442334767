"""Token table, context-rule tokenization, replay of older symbol maps, and phone units.

The table is a parameter (its JSON file); nothing of it is built in. Tokenization works on the code points of a whole Arrow
batch: each rule is a few vector operations over them, so no step is taken per row or character in Python.
"""
from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from ..functions.arrays import let
from ..functions.symbols import char_class
from ..functions.text import teacher_string
from ..session import written
from .ordering import grouped_scan, position_bucket
from .records import body

# Classes of table keys that carry no phonetic content, and what the other classes are for scoring.
NON_PHONETIC = ("special", "space", "punctuation")
PHONE_CLASSES, BOUNDARY_CLASSES, SILENT_CLASSES = ("vowel", "consonant"), ("space", "punctuation"), ("tone", "legacy", "special")
PROSODIC, TIE = "ˈˌ↓↑", "͡"


@dataclass(frozen=True)
class ContextRule:
    char: str
    token: str
    languages: tuple[str, ...]
    prev_chars: str = ""
    prev_classes: tuple[str, ...] = ()
    skip_classes: tuple[str, ...] = ()
    next_chars: str = ""


@dataclass(frozen=True)
class TokenTable:
    ids: dict[str, int]
    classes: dict[str, str]
    languages: frozenset[str]
    rules: tuple[ContextRule, ...] = ()
    unsupported: dict[str, str] = field(default_factory=dict)
    clause: str = ",;:.!?"
    reserved: str = ""
    pad: str = "_"
    bos: str = "^"
    eos: str = "$"

    def __post_init__(self) -> None:
        if sorted(self.ids.values()) != list(range(len(self.ids))):
            raise ValueError("token ids must be dense and unique")
        unknown = {l for r in self.rules for l in r.languages} - self.languages
        if unknown:
            raise ValueError(f"rules name languages outside the table: {sorted(unknown)}")

    @classmethod
    def from_json(cls, text: str) -> TokenTable:
        raw = json.loads(text)
        rules = []
        for r in raw["rules"]:
            c = r["context"]
            rules.append(ContextRule(r["char"], r["token"], tuple(r["languages"]), "".join(c.get("prev_chars", ())),
                                     tuple(c.get("prev_classes", ())), tuple(c.get("skip_classes", ())), "".join(c.get("next_chars", ()))))
        return cls({t["key"]: t["id"] for t in raw["tokens"]}, {t["key"]: t["class"] for t in raw["tokens"]}, frozenset(raw["languages"]),
                   tuple(rules), dict(raw["unsupported_languages"]), "".join(raw["clause_punctuation"]), "".join(raw["reserved"]),
                   raw["pad"], raw["bos"], raw["eos"])

    def of_classes(self, *names: str) -> str:
        return "".join(k for k, c in self.classes.items() if c in names and len(k) == 1)

    @cached_property
    def phones(self) -> str:
        return self.of_classes(*PHONE_CLASSES)

    @cached_property
    def marks(self) -> str:
        return "".join(c for c in self.of_classes("modifier", "diacritic") if c not in PROSODIC and c != TIE)

    @cached_property
    def boundaries(self) -> str:
        return self.of_classes(*BOUNDARY_CLASSES)

    @cached_property
    def phonetic_ids(self) -> list[int]:
        return sorted(i for k, i in self.ids.items() if self.classes[k] not in NON_PHONETIC)


TOKENS = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("error", T.StringType()),
    T.StructField("at", T.IntegerType()), T.StructField("char", T.StringType())])


class _Scanner:
    """Tokens of a whole batch at once: arrays over its code points, a few operations a rule, none a row."""

    def __init__(self, table: TokenTable) -> None:
        self.table = table
        self.every, self.plain = (np.full(0x110000, -1, np.int32) for _ in range(2))
        for key, number in table.ids.items():
            if len(key) == 1:
                self.every[ord(key)] = number
                self.plain[ord(key)] = -1 if key in table.reserved else number
        points = lambda chars: np.array(sorted(map(ord, set(chars))), np.int64)
        self.clause = points(table.clause)
        self.rules = []
        for r in table.rules:
            skip = table.of_classes(*r.skip_classes)
            before = points(set(r.prev_chars + table.of_classes(*r.prev_classes)) - set(skip)) if r.prev_chars or r.prev_classes else None
            self.rules.append((points(r.char), table.ids[r.token], set(r.languages), before, points(skip), points(r.next_chars)))

    def ids(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, languages: list[str | None]) -> np.ndarray:
        """One ID per code point, -1 where nothing fits: clause punctuation before a pause, then the rules in order, then
        punctuation before a blank, then the character itself."""
        row, ends = np.repeat(np.arange(len(lengths)), lengths), (starts + lengths - 1)[lengths > 0]

        def following(x: np.ndarray) -> np.ndarray:
            after = np.append(x[1:], -1)
            after[ends] = -1
            return after

        after = following(codes)
        then = following(after)
        clause, found = np.isin(codes, self.clause), np.full(len(codes), -1, np.int32)
        strong = clause & ((after == -1) | ((after == 32) & ((then == -1) | (then == 32))))
        found[strong] = self.every[codes[strong]]
        for chars, token, spoken, before, skip, behind in self.rules:
            fits = np.fromiter((x in spoken for x in languages), bool, len(languages))
            at = np.flatnonzero(np.isin(codes, chars) & (found < 0) & fits[row])
            if before is not None and len(at):
                kept = np.maximum.accumulate(np.where(np.isin(codes, skip), -1, np.arange(len(codes)))) if len(skip) else np.arange(len(codes))
                previous = np.where(at > 0, kept[at - 1], -1)
                at = at[(previous >= starts[row[at]]) & np.isin(codes[previous], before)]
            found[at[np.isin(after[at], behind)] if len(behind) else at] = token
        weak = clause & (after == 32) & (found < 0)
        found[weak] = self.every[codes[weak]]
        return np.where(found < 0, self.plain[codes], found)

    def batch(self, texts: pa.Array, languages: pa.Array) -> pa.StructArray:
        strings, spoken = texts.to_pylist(), languages.to_pylist()
        joined = "".join(x or "" for x in strings)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.fromiter((len(x or "") for x in strings), np.int64, len(strings))
        starts = np.cumsum(lengths) - lengths
        found = self.ids(codes, starts, lengths, spoken)
        normal = joined.isascii() or unicodedata.is_normalized("NFD", joined)
        known = {x: x in self.table.languages and x not in self.table.unsupported for x in set(spoken)}
        error: list[str | None] = [
            "no_text" if x is None else "unsupported_language" if not known[l] else "not_nfd" if not normal and not unicodedata.is_normalized("NFD", x) else None
            for x, l in zip(strings, spoken)]
        bad = np.flatnonzero(found < 0)
        rows, first = np.unique(np.searchsorted(starts, bad, "right") - 1, return_index=True)
        place: dict[int, int] = {r: int(p - starts[r]) for r, p in zip(rows.tolist(), bad[first].tolist()) if error[r] is None}
        for r in place:
            error[r] = "unknown_symbol"
        fine = np.fromiter((e is None for e in error), bool, len(error))
        offsets = np.concatenate(([0], np.cumsum(np.where(fine, lengths, 0)))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[np.repeat(fine, lengths)]), mask=pa.array(~fine))
        return pa.StructArray.from_arrays(
            [ids, pa.array(error, pa.string()), pa.array([place.get(k) for k in range(len(error))], pa.int32()),
             pa.array([strings[k][place[k]] if k in place else None for k in range(len(error))], pa.string())], names=["ids", "error", "at", "char"])


def tokenizer(table: TokenTable):
    """Column function (symbol string, language) -> struct(ids, error, at, char): one ID per character.

    ``error`` is null, ``no_text``, ``unsupported_language``, ``not_nfd`` or ``unknown_symbol`` (at that index and character).
    It is marked as not deterministic, so that Spark does not move filters on it below it and compute it twice.
    """
    held: list[_Scanner] = []

    def tokens(texts: pa.Array, languages: pa.Array) -> pa.Array:
        if not held:
            held.append(_Scanner(table))
        return held[0].batch(texts, languages)

    return F.arrow_udf(tokens, TOKENS).asNondeterministic()


def padded(ids: Column, table: TokenTable) -> Column:
    """``[bos, pad, (id, pad)*, eos]``."""
    pad = F.lit(table.ids[table.pad])
    return F.concat(F.array(F.lit(table.ids[table.bos]), pad), F.flatten(F.transform(ids, lambda x: F.array(x, pad))), F.array(F.lit(table.ids[table.eos])))


def tokenize(rows: DataFrame, table: TokenTable, text: str, language: str) -> DataFrame:
    """Adds ``tokens`` (the struct above, of the trimmed NFD string) and the padded ``phoneme_ids`` (null on error)."""
    t = rows.withColumn("tokens", tokenizer(table)(teacher_string(F.col(text)), F.col(language)))
    return t.withColumn("phoneme_ids", F.when(F.col("tokens.error").isNull(), padded(F.col("tokens.ids"), table)))


def phonetic_set(ids: Column, table: TokenTable) -> Column:
    """Distinct phonetic IDs in order; null stays null."""
    return F.array_sort(F.array_intersect(ids, F.array(*[F.lit(i) for i in table.phonetic_ids])))


def table_checks(tokens: DataFrame) -> DataFrame:
    return tokens.agg(((F.max("id") + 1 == F.count_distinct("id")) & (F.count(F.lit(1)) == F.count_distinct("id"))).alias("dense"),
                      F.count(F.lit(1)).alias("tokens"))


REPLAY = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("dropped", T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("char", T.StringType())]))),
    T.StructField("whitespace_split", T.BooleanType())])


def replayer(maps: dict[str, dict[str, int]], pad: str = "_", bos: str = "^", eos: str = "$"):
    """Column function (string, voice): what an older voice map makes of it, by longest match with skipped characters.

    A string all of whose blank-separated words are keys is read word by word (a quirk the older runtime has).
    """
    held: dict[str, _Replay] = {}

    def batch(texts: pa.Array, voices: pa.Array) -> pa.Array:
        strings, spoken = texts.to_pylist(), voices.to_pylist()
        order, parts = [], []
        for voice in dict.fromkeys(spoken):
            if voice not in held:
                held[voice] = _Replay(maps[voice], maps[voice][pad], maps[voice][bos], maps[voice][eos])
            at = [k for k, v in enumerate(spoken) if v == voice]
            order += at
            parts.append(held[voice].batch([strings[k] for k in at]))
        if len(parts) < 2:
            return parts[0] if parts else pa.array([], pa.struct(_REPLAY_FIELDS))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.array(order, np.int64), kind="stable")))

    return F.arrow_udf(batch, REPLAY)


_DROPPED_FIELDS = [("index", pa.int32()), ("char", pa.string())]
_REPLAY_FIELDS = [("ids", pa.list_(pa.int32())), ("dropped", pa.list_(pa.struct(_DROPPED_FIELDS))), ("whitespace_split", pa.bool_())]


class _Replay:
    """What one voice map makes of a batch of strings: by array operations over their code points. Strings with a key of several
    characters in them, or read word by word, are scanned one at a time."""

    def __init__(self, known: dict[str, int], fill: int, first: int, last: int) -> None:
        self.known, self.fill, self.first, self.last = known, fill, first, last
        self.pattern = re.compile("|".join(map(re.escape, sorted(known, key=len, reverse=True))) + "|(.)", re.DOTALL)
        long = [re.escape(k) for k in known if len(k) > 1]
        self.long = re.compile("|".join(long)) if long else None
        self.found = np.full(0x110000, -1, np.int64)
        for k, i in known.items():
            if len(k) == 1:
                self.found[ord(k)] = i

    def _scan(self, text: str, split: bool) -> tuple[list[int], list[int]]:
        if split:
            return [self.known[w] for w in text.split()], []
        found, dropped = [], []
        for m in self.pattern.finditer(text):
            if m.lastindex:
                dropped.append(m.start())
            else:
                found.append(self.known[m.group()])
        return found, dropped

    def _is_split(self, text: str) -> bool:
        first = text.split(None, 1)[:1]
        return bool(first) and first[0] in self.known and all(w in self.known for w in text.split())

    def batch(self, strings: list[str]) -> pa.StructArray:
        split = [self._is_split(x) for x in strings]
        apart = {k: self._scan(x, s) for k, (x, s) in enumerate(zip(strings, split)) if s or self.long is not None and self.long.search(x)}
        plain = ["" if k in apart else x for k, x in enumerate(strings)]
        lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        row, starts = np.repeat(np.arange(len(plain)), lengths), np.cumsum(lengths) - lengths
        values, lost = self.found[codes], self.found[codes] < 0
        rows, ids = row[~lost], values[~lost]
        lost_rows, lost_at = row[lost], np.flatnonzero(lost) - starts[row[lost]]
        if apart:
            rows = np.concatenate([rows, *[np.full(len(f), k, np.int64) for k, (f, _) in apart.items()]])
            ids = np.concatenate([ids, *[np.array(f, np.int64) for f, _ in apart.values()]])
            lost_rows = np.concatenate([lost_rows, *[np.full(len(d), k, np.int64) for k, (_, d) in apart.items()]])
            lost_at = np.concatenate([lost_at, *[np.array(d, np.int64) for _, d in apart.values()]])
            order, lost_order = np.argsort(rows, kind="stable"), np.argsort(lost_rows, kind="stable")
            rows, ids, lost_rows, lost_at = rows[order], ids[order], lost_rows[lost_order], lost_at[lost_order]
        n = np.bincount(rows, minlength=len(strings))
        ends = np.cumsum(2 * n + 3)
        padded_ids = np.full(int(ends[-1]) if len(ends) else 0, self.fill, np.int32)
        padded_ids[ends - 1], padded_ids[ends - 2 * n - 3] = self.last, self.first
        inside = np.arange(len(rows)) - (np.cumsum(n) - n)[rows]
        padded_ids[(ends - 2 * n - 3)[rows] + 2 + 2 * inside] = ids
        chars = [strings[k][i] for k, i in zip(lost_rows.tolist(), lost_at.tolist())]
        dropped = pa.StructArray.from_arrays([pa.array(lost_at, pa.int32()), pa.array(chars, pa.string())], fields=[pa.field(*f) for f in _DROPPED_FIELDS])
        offsets = lambda counts: pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        return pa.StructArray.from_arrays([
            pa.ListArray.from_arrays(offsets(2 * n + 3), pa.array(padded_ids)),
            pa.ListArray.from_arrays(offsets(np.bincount(lost_rows, minlength=len(strings))), dropped), pa.array(split, pa.bool_())],
            fields=[pa.field(*f) for f in _REPLAY_FIELDS])


def remap(rows: DataFrame, table: TokenTable, maps: dict[str, dict[str, int]], text: str, voice: str, language: str) -> DataFrame:
    """Adds ``teacher`` (replay), ``phoneme_ids`` (new IDs) and ``aligned``: whether positions correspond one to one."""
    out = tokenize(rows, table, text, language).withColumn("teacher", replayer(maps)(teacher_string(F.col(text)), F.col(voice)))
    return out.withColumn("aligned", (F.size("teacher.dropped") == 0) & ~F.col("teacher.whitespace_split"))


def remap_ids(rows: DataFrame, table: TokenTable, old_map: dict[str, int], ids: str, language: str, pad: str = "_", bos: str = "^", eos: str = "$") -> DataFrame:
    """New IDs of a stored older sequence; a sequence that is not ``[bos, pad, (id, pad)*, eos]`` is an error."""
    from .records import Vocabulary, bad_layout
    vocab = Vocabulary(max(old_map.values()) + 1, old_map[pad], old_map[bos], old_map[eos])
    back = F.create_map(*[x for k, v in old_map.items() for x in (F.lit(v), F.lit(k))])
    text = F.when(bad_layout(F.col(ids), vocab), F.raise_error(F.lit("not a [bos, pad, (id, pad)*, eos] sequence"))).otherwise(
        F.array_join(F.transform(body(F.col(ids)), lambda i: F.try_element_at(back, i)), ""))
    t = rows.withColumn("_text", text)
    return t.withColumn("tokens", tokenizer(table)(F.col("_text"), F.col(language))).withColumn(
        "phoneme_ids", padded(F.col("tokens.ids"), table)).drop("_text")


def lossy_report(remapped: DataFrame, voice: str, times: str | None = None) -> DataFrame:
    """Per voice: sentences, lossy ones, and dropped characters by falling frequency. ``times``: how often a row's sentence
    occurs, where equal ones were counted before."""
    n = F.lit(1) if times is None else F.col(times)
    n = n.cast("bigint")
    none = F.lit(0).cast("bigint")
    # One entry for the sentence (no character) and one for each dropped character, so that rows are read once.
    entry = lambda char, m, lossy: F.struct(char.cast("string").alias("char"), m.alias("n"), lossy.alias("lossy"))
    whole = F.array(entry(F.lit(None), n, F.when(F.col("aligned"), none).otherwise(n)))
    entries = F.concat(whole, F.transform("teacher.dropped", lambda d: entry(d["char"], n, none)))
    counts = remapped.select(voice, F.inline(entries)).groupBy(voice, "char").agg(F.sum("n").alias("n"), F.sum("lossy").alias("lossy"))
    sentence, listed = F.col("char").isNull(), F.array_sort(F.collect_list(F.when(F.col("char").isNotNull(), F.struct((-F.col("n")).alias("m"), "char"))))
    named = F.array_join(F.transform(listed, lambda x: F.concat(x["char"], F.lit(":"), (-x["m"]).cast("string"))), " ")
    return counts.groupBy(voice).agg(F.sum(F.when(sentence, F.col("n"))).alias("sentences"), F.sum(F.when(sentence, F.col("lossy"))).alias("lossy_sentences"),
                                     named.alias("dropped_chars"))


# --- phone units ---------------------------------------------------------------------------------------------------

def keys_of(ids: Column, table: TokenTable, without_specials: bool = True) -> Column:
    """Table keys of stored IDs; padding, start and end left out; an unknown ID is an error."""
    names = F.array(*[F.lit(k) for k in sorted(table.ids, key=table.ids.get)])
    specials = [table.ids[k] for k in (table.pad, table.bos, table.eos)]
    # The pad, every second item, is left out first: by a loop in generated code, not by a lambda.
    inner = F.filter(F.array_remove(ids, specials[0]), lambda i: ~i.isin(*specials[1:])) if without_specials else ids
    return F.transform(inner, lambda i: F.coalesce(F.get(names, i.cast("int")), F.raise_error(F.concat(F.lit("unknown phoneme id "), i.cast("string")))))


def _units(word: Column, phone: str, mark: str) -> Column:
    found = F.regexp_extract_all(word, F.lit(f"({phone}{mark}*+)"), 1)
    marks = lambda u: F.array_join(F.array_sort(F.regexp_extract_all(F.substr(u, F.lit(2)), F.lit("(?s)(.)"), 1)), "")
    return F.transform(found, lambda u: F.struct(
        F.substring(u, 1, 1).alias("base"), F.when(F.char_length(u) > 1, marks(u)).otherwise("").alias("marks")))


def _class(chars: str) -> str:
    return f"[{char_class(chars)}]" if chars else "(?!)"


def reference_words(keys: Column, table: TokenTable, bases: bool = False) -> Column:
    """Struct (words, malformed): words of units (base, sorted marks) from one utterance's table keys; with ``bases`` a word is
    the text of its bases, a character a unit.

    Stress, ties, tones and older symbols do not count; blanks and punctuation end a word; a mark without a phone
    before it, or a special token, makes the string malformed.
    """
    phone, mark, edge = (_class(c) for c in (table.phones, table.marks, table.boundaries))
    counted, special = sorted({*table.phones, *table.marks, *table.boundaries}), [k for k, c in table.classes.items() if c == "special"]

    def parsed(keys: Column, heard: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(heard, mark, "") if bases else heard, edge), lambda w: w != "")
        malformed = heard.rlike(f"(?:^|{edge}){mark}") | (F.arrays_overlap(keys, F.array(*map(F.lit, special))) if special else F.lit(False))
        return let(malformed, lambda bad: F.struct(F.when(~bad, words if bases else F.transform(words, lambda w: _units(w, phone, mark))).alias("words"), bad.alias("malformed")))

    return let(keys, lambda held: let(F.array_join(F.filter(held, lambda k: k.isin(*counted)), ""), lambda heard: parsed(held, heard)))


def recognized_units(text: Column, table: TokenTable) -> Column:
    """Units of recognizer output, which may hold characters the table lacks; marks without a phone are ignored."""
    single = char_class([k for k in table.ids if len(k) == 1])
    phone = f"[{char_class(table.phones)}[\\p{{L}}&&[^\\p{{Lm}}]&&[^{single}]]]"
    mark = f"[{char_class(table.marks)}[[\\p{{Mn}}\\p{{Lm}}]&&[^{single}]]]"
    heard = F.array_join(F.regexp_extract_all(text, F.lit(f"({phone}|{mark})"), 1), "")
    return _units(heard, phone, mark)


def symbol_class(char: Column, table: TokenTable, recognized: bool = False) -> Column:
    """phone, mark, boundary or transparent; recognizer output has no boundaries and may leave the table."""
    edge = "transparent" if recognized else "boundary"
    known = F.when(char.rlike(f"^{_class(table.phones)}$"), "phone").when(char.rlike(f"^{_class(table.marks)}$"), "mark").when(
        char.rlike(f"^{_class(table.boundaries)}$"), edge).when(char.isin(*table.ids), "transparent")
    if not recognized:
        return known
    other = F.when(char.rlike(r"^\p{Nd}$"), "transparent").when(char.rlike(r"^[\p{Mn}\p{Lm}]$"), "mark").when(char.rlike(r"^\p{L}$"), "phone").otherwise("transparent")
    return F.coalesce(known, other)


def labels(units: Column) -> Column:
    return F.transform(units, lambda u: F.concat(u["base"], u["marks"]))


def word_pairs(words: Column) -> Column:
    """Adjacent base phones inside words, as an array of (first, second)."""
    one = lambda w: F.when(F.size(w) > 1, F.zip_with(
        F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.struct(a["base"].alias("first"), b["base"].alias("second"))))
    return F.flatten(F.filter(F.transform(words, one), lambda p: p.isNotNull()))


def _of_bases(rows: DataFrame, words: str) -> bool:
    return isinstance(rows.select(words).schema[0].dataType.elementType, T.StringType)


def pair_counts(rows: DataFrame, words: str) -> DataFrame:
    """(first, second, count) over all rows, of words of units or of bases: equal words are counted first and paired once."""
    forms = rows.select(F.explode(words).alias("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    word = F.transform(F.split("_word", ""), lambda u: F.struct(u.alias("base"))) if _of_bases(rows, words) else F.col("_word")
    return forms.select("_n", F.inline(word_pairs(F.array(word)))).groupBy("first", "second").agg(F.sum("_n").alias("count"))


def training_pairs(records: DataFrame, table: TokenTable, ids: str = "phoneme_ids") -> DataFrame:
    return pair_counts(records.select(reference_words(keys_of(F.col(ids), table), table)["words"].alias("words")), "words")


#: Trained pairs up to which every row tests its own; more are joined.
MOST_PAIRS = 20_000


def _is_known(first: Column, second: Column, known: list[Row]) -> Column:
    """True if the pair is among ``known``; a first phone of one character and the second name a pair as they stand."""
    short, long = [r[0] + r[1] for r in known if len(r[0]) == 1], [f"{len(r[0])}:{r[0]}{r[1]}" for r in known if len(r[0]) != 1]
    among = lambda name, names: name.isin(*names) if names else F.lit(False)
    n = F.char_length(first)
    return F.coalesce(F.when(n == 1, among(F.concat(first, second), short)).otherwise(among(F.concat(n.cast("string"), F.lit(":"), first, second), long)), F.lit(False))


def _seen(bases: Column, known: list[Row]) -> Column:
    """Per unit of a word whether the pair with the unit before it and the pair with the unit behind it are both known."""
    n = F.size(bases)
    near = F.zip_with(F.slice(bases, F.lit(1), n - 1), F.slice(bases, F.lit(2), n - 1), lambda a, b: _is_known(a, b, known))
    edge = F.array(F.lit(True))
    whole = let(near, lambda x: F.zip_with(F.concat(edge, x), F.concat(x, edge), lambda a, b: a & b))
    return F.when(n > 1, whole).when(n == 1, edge).otherwise(F.array().cast("array<boolean>"))


def unit_pair_status(rows: DataFrame, key: str, words: str, trained: DataFrame) -> DataFrame:
    """(key, unit, seen): per unit in order whether every within-word pair it belongs to occurs in training, for words of units or
    of bases.

    Pairs of an alphabet are few, so every row looks its own up, without a shuffle; only beyond ``MOST_PAIRS`` trained pairs each
    unit's pairs are joined with them.
    """
    pairs = written(trained.filter(F.col("count") > 0).select("first", "second").distinct(), "trained-pairs")
    texts = _of_bases(rows, words)
    if pairs.count() > MOST_PAIRS:
        units = F.transform(words, lambda w: F.transform(F.split(w, ""), lambda u: F.struct(u.alias("base")))) if texts else F.col(words)
        return _joined_pair_status(rows.select(key, units.alias(words)), key, words, pairs)
    known = pairs.filter("first IS NOT NULL AND second IS NOT NULL").select("first", "second").collect()
    status = F.flatten(F.transform(words, lambda w: let(F.split(w, "") if texts else F.transform(w, lambda u: u["base"]), lambda x: _seen(x, known))))
    return rows.select(key, F.posexplode(status).alias("unit", "seen")).withColumn("unit", F.col("unit").cast("bigint"))


def _joined_pair_status(rows: DataFrame, key: str, words: str, pairs: DataFrame) -> DataFrame:
    placed = rows.select(key, F.posexplode(words).alias("_w", "_units")).select(
        key, "_w", F.posexplode("_units").alias("_u", "_unit"), F.size("_units").alias("_n"), "_units")
    near = placed.select(key, "_w", "_u", F.explode(F.array_compact(F.array(
        F.when(F.col("_u") > 0, F.struct(F.try_element_at("_units", F.col("_u"))["base"].alias("first"), F.col("_unit.base").alias("second"))),
        F.when(F.col("_u") < F.col("_n") - 1, F.struct(F.col("_unit.base").alias("first"), F.try_element_at("_units", F.col("_u") + 2)["base"].alias("second")))))).alias("_p"))
    seen = pairs.withColumn("_known", F.lit(True))
    unseen = near.select(key, "_w", "_u", "_p.first", "_p.second").join(seen, ["first", "second"], "left").groupBy(key, "_w", "_u").agg(
        F.max(F.col("_known").isNull()).alias("_unseen"))
    numbered = placed.select(key, "_w", "_u").join(unseen, [key, "_w", "_u"], "left")
    ranked = grouped_scan(numbered, [key], [F.col("_w"), F.col("_u")], position_bucket(F.col("_w"), 1000), rank="_n")
    return ranked.select(key, (F.col("_n") - 1).alias("unit"), (~F.coalesce("_unseen", F.lit(False))).alias("seen"))


def split_by_pair_status(edits: DataFrame, key: str, edits_column: str, status: DataFrame) -> DataFrame:
    """Per key: edits and units of seen and of unseen pairs; a length mismatch is an error.

    A key's units meet again as one array, so edits and status are joined by key, not by unit.
    """
    held = status.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("unit", "seen"))).alias("_status"))
    each = edits.select(key, F.col(edits_column).alias("_edits")).filter(F.size("_edits") > 0)
    placed = F.forall(F.transform("_status", lambda x, i: (x["unit"] == i) & x["seen"].isNotNull()), lambda fits: fits)
    whole = F.coalesce((F.size("_edits") == F.size("_status")) & placed, F.lit(False)) & ~F.exists("_edits", lambda e: e.isNull())
    both = F.when(whole, F.zip_with("_edits", "_status", lambda e, s: F.struct(e.cast("bigint").alias("edits"), s["seen"].alias("seen")))).otherwise(
        F.raise_error(F.lit("per-unit edits do not match the reference units")))
    none = F.lit(0).cast("bigint")
    total = lambda units, seen: F.aggregate(units, none, lambda a, u: a + F.when(u["seen"] == F.lit(seen), u["edits"]).otherwise(none))
    names = ["per_seen_edits", "per_seen_units", "per_unseen_edits", "per_unseen_units"]
    sums = let(both, lambda units: let(F.size(F.filter(units, lambda u: u["seen"])).cast("bigint"), lambda n: F.struct(*[
        v.alias(k) for k, v in zip(names, (total(units, True), n, total(units, False), F.size(units) - n))])))
    return each.join(held, key, "full_outer").select(key, sums.alias("_sums")).groupBy(key).agg(*[F.sum(f"_sums.{k}").alias(k) for k in names])


def parseable(rows: DataFrame, table: TokenTable, text: str, language: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): rows whose symbol string forms well-formed units; unsupported languages are kept."""
    t = tokenize(rows, table, text, language)
    names = F.when(F.col("tokens.error").isNull(), keys_of(F.col("tokens.ids"), table, without_specials=False))
    marked = t.withColumn("_bad", (F.coalesce(F.col("tokens.error"), F.lit("")) != "unsupported_language") & (
        F.col("tokens.error").isNotNull() | F.coalesce(reference_words(names, table)["malformed"], F.lit(True))))
    marked = written(marked.select(*rows.columns, "_bad"), "parseable")  # both parts read it
    return marked.filter(~F.col("_bad")).drop("_bad"), marked.filter(F.col("_bad")).drop("_bad")
