"""Who renders what: speaker choice, hours, tempo, utterance order, jobs and budgets."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import hash_bucket, hex_hash, unit_hash
from .checks import require_empty
from ..session import written
from .ordering import SALTS, exact_quantiles, grouped_scan


@dataclass(frozen=True)
class Selection:
    voices: frozenset[str] = frozenset()
    exclude_voices: frozenset[str] = frozenset()
    exclude_speakers: frozenset[str] = frozenset()
    exclude_espeak: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Hours:
    by_tier: dict[str, float]
    lineup: float = 0.0
    lineup_speakers: frozenset[str] = frozenset()
    by_voice: dict[str, float] = field(default_factory=dict)
    by_speaker: dict[str, float] = field(default_factory=dict)
    cap_seconds: float | None = None


def speaker_key(voice: Column, speaker: Column) -> Column:
    return F.when(speaker.isNull(), voice).otherwise(F.concat_ws(".", voice, speaker))


def utterance_id(key: Column, text_hash: Column, render: Column) -> Column:
    return F.concat(key, F.lit("-"), F.substring(text_hash, 1, 12), F.lit("-r"), render.cast("string"))


def job_id(key: Column, part: Column) -> Column:
    return F.format_string("%s.p%03d", key, part.cast("int"))


def _in(column: str, values: frozenset[str]) -> Column:
    return F.col(column).isin(*sorted(values)) if values else F.lit(False)


def unknown_names(speakers: DataFrame, selection: Selection) -> DataFrame:
    """Configured voices and speaker keys that no row of the catalogue carries."""
    spark = speakers.sparkSession
    asked = [("voice", v) for v in sorted(selection.voices | selection.exclude_voices)]
    asked += [("key", k) for k in sorted(selection.exclude_speakers)]
    requested = spark.createDataFrame(asked, "kind string, name string")
    known = speakers.select(F.lit("voice").alias("kind"), F.col("voice").alias("name")).unionByName(
        speakers.select(F.lit("key").alias("kind"), F.col("key").alias("name")))
    return requested.subtract(known)


def selected(speakers: DataFrame, selection: Selection, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(speakers to render, recorded-speech speakers left to the corpus loaders)."""
    if strict:
        require_empty(unknown_names(speakers, selection), "selection names voices or speakers not in the catalogue")
    chosen = speakers.filter(
        (F.col("tier") != "excluded") & ~_in("voice", selection.exclude_voices) & ~_in("key", selection.exclude_speakers)
        & ~_in("espeak", selection.exclude_espeak) & (_in("voice", selection.voices) if selection.voices else F.lit(True)))
    return chosen.filter(F.col("source_kind") != "corpus"), chosen.filter(F.col("source_kind") == "corpus")


def _lookup(column: str, table: dict[str, float]) -> Column:
    if not table:
        return F.lit(None).cast("double")
    literal = F.create_map(*[F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v))])
    return F.try_element_at(literal, F.col(column))


def hours_for(hours: Hours, capped: bool = False) -> Column:
    """Hours of a speaker: line-up, then speaker, then voice, then tier."""
    value = F.when(_in("key", hours.lineup_speakers), F.lit(float(hours.lineup))).otherwise(
        F.coalesce(_lookup("key", hours.by_speaker), _lookup("voice", hours.by_voice), _lookup("tier", hours.by_tier)))
    return F.least(value, F.lit(hours.cap_seconds / 3600)) if capped and hours.cap_seconds is not None else value


def tempo_factors(speakers: DataFrame, policy: str) -> DataFrame:
    """(key, tempo): rate over the median rate of the language's good speakers, 1.0 where there is none.

    ``raise_slow`` never goes above 1. Excluded speakers and speakers without a rate get no row.
    """
    good = speakers.filter((F.col("tier") == "good") & F.col("articulation_rate").isNotNull())
    medians = exact_quantiles(good, ["language"], "articulation_rate", {"target": 0.5})
    rated = speakers.filter((F.col("tier") != "excluded") & F.col("articulation_rate").isNotNull())
    ratio = F.col("articulation_rate") / F.col("target")
    factor = {"raise_slow": F.least(F.lit(1.0), ratio), "match_median": ratio}[policy]
    return rated.join(medians, "language", "left").select(
        "key", F.when(F.col("target").isNull(), F.lit(1.0)).otherwise(factor).alias("tempo"))


def jobs_for(speakers: DataFrame, tempo: DataFrame, hours: Hours, part_hours: float, strict: bool = True) -> DataFrame:
    """One row per job: ceil(hours / part) equal budgets per speaker, after the cap."""
    if strict:
        require_empty(speakers.join(tempo, "key", "left_anti").select("key"), "no articulation rate, cannot set the tempo")
    seconds = hours_for(hours) * 3600
    if hours.cap_seconds is not None:
        seconds = F.least(seconds, F.lit(float(hours.cap_seconds)))
    planned = speakers.join(tempo, "key").withColumn("_seconds", seconds).withColumn(
        "parts", F.greatest(F.lit(1), F.ceil(F.col("_seconds") / (part_hours * 3600))).cast("int"))
    jobs = planned.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return jobs.withColumn("budget_seconds", F.col("_seconds") / F.col("parts")).withColumn(
        "job_id", job_id(F.col("key"), F.col("part"))).drop("_seconds")


def plan_report(speakers: DataFrame, hours: Hours) -> DataFrame:
    """Speakers and capped hours per language."""
    return speakers.withColumn("hours", hours_for(hours, capped=True)).groupBy("language").agg(
        F.count(F.lit(1)).alias("speakers"), F.sum("hours").alias("hours"))


def longest_first(jobs: DataFrame, speed: dict[str, float]) -> DataFrame:
    """Adds ``expected_seconds`` (budget over the source's real-time factor) and sorts by it, largest first."""
    return jobs.withColumn("expected_seconds", F.col("budget_seconds") / _lookup("source_kind", speed)).orderBy(
        F.desc("expected_seconds"), "job_id")


# Real-time factor of one job by kind of source.
REALTIME = {"piper": 13.0, "kokoro": 4.2, "kokoro_ja": 4.2, "mms": 4.7, "coqui": 25.0, "mimic3": 23.0, "glowtts": 3.2}


def _pairs_below(speakers: DataFrame, rest: DataFrame, seed: int) -> DataFrame:
    """(key, text, rank, _digest) of the pairs whose digest lies below their speaker's ``_bound``.

    Every pair's digest is computed once, inside the join; only those below the bound leave it. Sentences are dealt out over
    salts, so that a language's pairs are spread over many tasks.
    """
    salted = rest.withColumn("_salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)))
    copies = speakers.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    digest = hex_hash(seed, F.col("key"), F.col("text"))
    below = (F.substring(digest, 1, 13) < F.col("_bound")) | (F.col("_bound") == _EVERYTHING)
    return copies.join(salted, ["espeak", "_salt"]).filter(below).select("key", "text", "rank", digest.alias("_digest"))


# Above any 13 hex digits.
_EVERYTHING = "g"


def _bounds(speakers: DataFrame, slack: float) -> DataFrame:
    """Per speaker the hex digits below which, with room to spare, as many digests fall as are asked for."""
    wanted = F.col("_wanted") + F.lit(slack) * F.sqrt(F.col("_wanted") + 1.0) + slack
    share = wanted / F.col("_rest")
    digits = F.lpad(F.lower(F.hex(F.floor(F.least(share, F.lit(1.0)) * float(16**13 - 1)).cast("bigint"))), 13, "0")
    return speakers.withColumn("_bound", F.when(share >= 1, F.lit(_EVERYTHING)).otherwise(digits))


#: Rows of speakers x sentences that are put in order at a time: so many a sentence, and so many at least.
ROUND_SHARE, ROUND_ROWS = 4, 2_000_000
#: Buckets of a speaker: thousands of ranks of the core below, leading hex digits of the rest above.
CORE_BUCKETS, BUCKET_BITS = 2**20, 21


def _hex_below(share: float) -> str:
    """``unit_hash(...) < share`` in hex digits: the least 16 digits whose fraction, as a double, is not below ``share``."""
    low, high = 0, 2**64
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if float(middle) / 2**64 < share else (low, middle)
    return _EVERYTHING if low == 2**64 else f"{low:016x}"


def _numbered(speakers: DataFrame) -> DataFrame:
    """(key, espeak, _who): speakers with a dense number for each key."""
    keys = speakers.select(F.col("key").alias("_key")).distinct().withColumn("_digest", hex_hash("speaker", F.col("_key")))
    numbers = grouped_scan(keys, [], [F.col("_digest")], hash_bucket(F.col("_digest")), rank="_who").select("_key", "_who")
    return speakers.select("key", "espeak").join(numbers, F.col("key").eqNullSafe(F.col("_key"))).drop("_key")


def _rounds_of(speakers: DataFrame, sentences: DataFrame, core: int, seed: int, second_fraction: float, cycles: int, columns: Sequence[str]) -> DataFrame:
    """Every utterance of the first ``cycles`` rounds: a row for each speaker and sentence is put in order once, for all rounds.

    Such a row holds the numbers that its place needs and ``columns``; the speaker's key comes with the totals of earlier buckets.
    Digests are compared by their first 96 bits, then by rank.
    """
    key, text, rank = F.col("key"), F.col("text"), F.col("rank")
    cores, zero = F.coalesce(rank <= core, F.lit(False)), F.lit(0).cast("bigint")
    copies = speakers.withColumn("_salt", F.explode(F.sequence(zero, F.lit(SALTS - 1).cast("bigint"))))
    crossed = copies.join(sentences.withColumn("_salt", F.pmod(F.xxhash64("text"), F.lit(SALTS))), ["espeak", "_salt"])
    hexed = crossed.withColumn("_hex", F.when(~cores, F.substring(hex_hash(seed, key, text), 1, 24)))
    bucket = F.when(cores, F.least(F.floor(rank / 1000).cast("bigint"), F.lit(CORE_BUCKETS - 1))).otherwise(
        CORE_BUCKETS + F.conv(F.substring("_hex", 1, 3), 16, 10).cast("bigint"))
    below = F.lit(_hex_below(second_fraction))
    takes = {f"_takes_{c}": F.when(F.substring(hex_hash(seed, key, text, F.lit(c), "second"), 1, 16) < below, 2).otherwise(1).cast("bigint") for c in range(cycles)}
    placed = hexed.select(((F.col("_who") * 2**BUCKET_BITS) + bucket).alias("_cell"), F.unhex("_hex").alias("_place"), rank.alias("_rank"),
                          *[v.alias(n) for n, v in takes.items()], *columns)
    cells = placed.groupBy("_cell").agg(*[F.sum(n).alias(f"_all{n}") for n in takes]).withColumn("_who", F.shiftright("_cell", BUCKET_BITS))
    group = Window.partitionBy("_who")
    before = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("_cell", "_who", *[F.coalesce(F.sum(f"_all{n}").over(before), zero).alias(f"_before{n}") for n in takes],
                           *[F.sum(f"_all{n}").over(group).alias(f"_all{n}") for n in takes]).join(speakers.select("_who", "key").distinct(), "_who").drop("_who")
    running = Window.partitionBy("_cell").orderBy("_place", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.select("*", *[F.sum(n).over(running).alias(f"_to{n}") for n in takes]).join(offsets, "_cell")
    rounds, start = [], zero
    for c, n in enumerate(takes):
        first = start + F.col(f"_before{n}") + F.col(f"_to{n}") - F.col(n)
        one = lambda copy, at, c=c: F.struct(F.lit(c).alias("cycle"), F.lit(2 * c + copy).alias("render"), at.alias("position"))
        rounds.append(F.when(F.col(n) == 2, F.array(one(0, first), one(1, first + 1))).otherwise(F.array(one(0, first))))
        start = start + F.col(f"_all{n}")
    return run.select("key", *columns, F.inline(F.concat(*rounds)))


def _whole_rounds(speakers: DataFrame, sentences: DataFrame, core: int, seed: int, second_fraction: float, cycles: int, columns: Sequence[str],
                  each: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    who = written(_numbered(speakers), "speakers")
    if each is None:
        return _rounds_of(who, sentences, core, seed, second_fraction, cycles, columns)
    n = F.count(F.lit(1))
    lines = sentences.groupBy("espeak").agg(n.alias("_lines"))
    rows, most = who.groupBy("espeak").agg(n.alias("_n")).join(lines, "espeak").agg(
        F.coalesce(F.sum(F.col("_n") * F.col("_lines")), F.lit(0)), F.coalesce(F.sum("_lines"), F.lit(0))).first()
    turns = max(1, -(-rows // max(ROUND_ROWS, ROUND_SHARE * most)))
    parts = [written(each(_rounds_of(who.filter(F.col("_who") % turns == k), sentences, core, seed, second_fraction, cycles, columns)), "rounds")
             for k in range(turns)]
    return reduce(DataFrame.unionByName, parts)


def utterance_order(speakers: DataFrame, sentences: DataFrame, core: int, seed: int, second_fraction: float, cycles: int | None = None,
                    columns: Sequence[str] = ("espeak", "text"), each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The first ``need`` utterances of each speaker's endless sequence, with 0-based ``position``, ``cycle`` and ``render``.

    ``sentences`` (espeak, rank, text) is in coverage order: the first ``core`` come first for everyone, the rest in a
    per-speaker hash order; a hashed share of renders is followed by a second one, and a new cycle begins when all are used.
    ``speakers`` has key, espeak and ``need``, the most its budget can use (see ``needed``); with ``cycles`` the result is the first
    so many rounds whole, and no ``need`` is asked for. Then ``columns`` names what the rows keep of ``sentences`` (a number for the
    text makes them narrow), and ``each`` is given the utterances of some whole speakers at a time: what it makes of them is written
    before the next speakers' rows are made, so the disk never holds all speakers x sentences.

    A speaker that needs m of n sentences of the rest only takes pairs whose digest lies below a bound for m of n; where the
    bound turns out too low, it is doubled for these speakers. So rows grow with what is needed, not with speakers x sentences.
    """
    if cycles is not None:
        kept = written(sentences.select(*dict.fromkeys(["espeak", "rank", "text", *columns])), "sentences", "zstd")
        return _whole_rounds(speakers, kept, core, seed, second_fraction, cycles, columns, each)
    sentences = written(sentences.select("espeak", "rank", "text"), "sentences")
    key, text = F.col("key"), F.col("text")
    sizes = sentences.groupBy("espeak").agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("rank") > core).alias("_rest"))
    asked = written(speakers.select("key", "espeak", F.col("need").cast("bigint").alias("need")).join(sizes, "espeak").withColumn(
        "_wanted", F.least("_rest", F.greatest(F.lit(0).cast("bigint"), F.col("need") - (F.col("_all") - F.col("_rest"))))), "speakers")
    rest = sentences.filter(F.col("rank") > core).select("espeak", "rank", "text")
    open_, found, slack = asked.filter("_wanted > 0"), None, 4.0
    while True:
        new = written(_pairs_below(_bounds(open_, slack), rest, seed), "rest")
        enough = open_.join(new.groupBy("key").agg(F.count(F.lit(1)).alias("_found")), "key", "left").withColumn(
            "_enough", F.coalesce("_found", F.lit(0)) >= F.col("_wanted")).select("key", "_enough")
        done = new.join(enough.filter("_enough"), "key", "left_semi")
        found = done if found is None else found.unionByName(done)
        open_ = open_.join(enough.filter("NOT _enough"), "key", "left_semi")
        if open_.isEmpty():
            break
        open_, slack = written(open_, "speakers"), slack * 2
    head = asked.join(sentences.filter(F.col("rank") <= core).select("espeak", "rank", "text"), "espeak").filter(F.col("rank") <= F.col("need")).select(
        "key", "espeak", "need", "_all", "text", "rank", F.lit(0).alias("_rest"), F.format_string("%064d", F.col("rank").cast("bigint")).alias("_place"))
    tail = found.join(asked.select("key", "espeak", "need", "_all"), "key").select(
        "key", "espeak", "need", "_all", "text", "rank", F.lit(1).alias("_rest"), F.col("_digest").alias("_place"))
    cycles = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("need") - 1) / F.col("_all")).cast("bigint"))
    rounds = head.unionByName(tail).filter("need > 0").select("*", F.explode(cycles).alias("cycle"))
    second = unit_hash(seed, key, text, F.col("cycle"), "second") < second_fraction
    copies = rounds.select("*", F.explode(F.when(second, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    bucket = F.concat_ws("-", F.format_string("%06d", F.col("cycle")), F.col("_rest").cast("string"),
                         F.when(F.col("_rest") == 1, F.substring("_place", 1, 3)).otherwise(F.substring("_place", 1, 61)))
    order = [F.col("cycle"), F.col("_rest"), F.col("_place"), F.col("rank"), F.col("copy")]
    out = grouped_scan(copies, ["key"], order, bucket, rank="_rank").filter(F.col("_rank") <= F.col("need"))
    return out.select("key", "espeak", "text", F.col("cycle").cast("int").alias("cycle"), (2 * F.col("cycle") + F.col("copy")).cast("int").alias("render"),
                      (F.col("_rank") - 1).alias("position"))


def needed(budget_seconds: Column, parts: Column, least_seconds: float) -> Column:
    """Utterances of a speaker that jobs of this budget can use, if none lasts less than ``least_seconds``: each part takes
    until its budget is full."""
    return (parts * F.ceil(budget_seconds / F.lit(float(least_seconds)))).cast("bigint")


def part_of(position: Column, parts: Column) -> tuple[Column, Column]:
    """Part that takes a position of the sequence, and the position inside that part."""
    return (position % parts).cast("int"), F.floor(position / parts).cast("bigint")


def takes_within_budget(takes: DataFrame, keys: list[str], order: list[Column], bucket: Column, seconds: str,
                        budget: Column) -> DataFrame:
    """Rows whose earlier rows of the same job add up to less than the budget; ``before`` is that sum.

    Lengths are summed as whole microseconds, so neither the order of partial sums nor the subtraction loses bits.
    """
    micros = F.round(F.col(seconds).cast("double") * 1_000_000).cast("bigint")
    run = grouped_scan(takes, keys, order, bucket, sums={"_through": micros})
    before = F.col("_through") - micros
    return run.withColumn("before", before / 1_000_000.0).filter(before < F.round(budget.cast("double") * 1_000_000).cast("bigint")).drop("_through")
