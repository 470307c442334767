"""Text-table readers and writers with fixed columns: nothing is inferred, missing columns and bad cells fail."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.numbers import fixed
from ..operators.checks import CheckError, require_empty, require_unique
from ..operators.records import RECORD_SCHEMA, Vocabulary, parse_records
from ..operators.scoring import RATES, SCORE_SCHEMA, row_rate


def columns_of(schema: str) -> dict[str, str]:
    """``name type, ...`` as a dict (types without commas inside)."""
    return dict(part.strip().split(" ", 1) for part in schema.split(", "))


def read_delimited(spark: SparkSession, path, required: str, optional: str = "", sep: str = "\t", quoted: bool = False,
                   comment: str | None = None, exact: bool = False, non_empty: Sequence[str] | None = None, placed: bool = False) -> DataFrame:
    """A headed table by column name: required and optional columns typed, other columns ignored (or refused).

    Cells are read as strings and cast, so a malformed number is an error; empty cells are null. ``non_empty`` names
    the required columns that may not be empty (all of them by default). With ``placed`` rows have their ``position``.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("enforceSchema", False).option("mode", "FAILFAST")
    if not quoted:
        reader = reader.option("quote", "")
    if comment:
        reader = reader.option("comment", comment)
    raw = reader.csv(path)
    need, may = columns_of(required), columns_of(optional) if optional else {}
    absent = [c for c in need if c not in raw.columns]
    if absent or (exact and raw.columns != list(need)):
        raise CheckError(f"{path}: columns {raw.columns}, expected {list(need)}")
    filled = list(need) if non_empty is None else list(non_empty)
    cells = []
    for c, kind in need.items():
        cell = F.col(f"`{c}`")
        if c in filled:
            cell = F.when(cell.isNull(), F.raise_error(F.lit(f"{path}: empty {c}"))).otherwise(cell)
        cells.append(cell.cast(kind).alias(c))
    cells += [(F.col(f"`{c}`") if c in raw.columns else F.lit(None)).cast(kind).alias(c) for c, kind in may.items()]
    return raw.select(*cells, *([file_position().alias("position")] if placed else []))


def file_position() -> Column:
    """Place of a row of a file source, rising in file order: the file, the byte where the row's part of the file begins, and a
    number that rises inside the part. Rules on the first or last row of a table order by it, however the file was split."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def read_tab_table(spark: SparkSession, path) -> DataFrame:
    """Headed tab table with ``#`` comment lines; every column a string."""
    return spark.read.option("header", True).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)


TIER_SCHEMA = "lang string, espeak string, voice string, speaker string, human string, audio string, tier string, condition string, weight double"


def check_domain(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Fails the job on a value outside the list, when the column is read."""
    value = F.col(column)
    bad = value.isNull() | ~value.isin(*allowed)
    return df.withColumn(column, F.when(bad, F.raise_error(
        F.concat(F.lit(f"{column}: unexpected value "), F.coalesce(value, F.lit("(empty)"))))).otherwise(value))


def read_tiers(spark: SparkSession, path) -> DataFrame:
    from ..operators.catalog import TIERS
    from ..operators.ids import CONDITIONS
    rows = read_delimited(spark, path, TIER_SCHEMA, "articulation_rate double", sep=",", quoted=True)
    for column, allowed in (("human", ("pass", "fail")), ("audio", ("pass", "fail")), ("tier", TIERS), ("condition", CONDITIONS)):
        rows = check_domain(rows, column, allowed)
    return require_unique(rows, "voice", "speaker", what="(voice, speaker) tier rows")


MANIFEST_SCHEMA = "voice string, speaker string, espeak string, idx int, file string, sample_rate int, text string"
MANIFEST_OPTIONAL = "espeak_phonemes string, reference_wav string, reference_voice string, cpu_s double"


def read_manifest(spark: SparkSession, path) -> DataFrame:
    """Scoring manifest; duplicate utterances fail."""
    rows = read_delimited(spark, path, MANIFEST_SCHEMA, MANIFEST_OPTIONAL)
    return require_unique(rows, "voice", "speaker", "espeak", "idx", what="utterances")


def write_manifest(rows: DataFrame, path: str) -> None:
    """Column order of the manifest; optional columns only where present; tabs and newlines in text refused."""
    head = ["voice", "speaker", "espeak", "idx", "file", "sample_rate"]
    counted = [c for c in ("phonemes",) if c in rows.columns]
    optional = [c for c in columns_of(MANIFEST_OPTIONAL) if c in rows.columns]
    checked = [c for c in ("text", "espeak_phonemes") if c in rows.columns]
    for c in checked:
        rows = rows.withColumn(c, F.when(F.col(c).rlike("[\t\n]"), F.raise_error(
            F.concat(F.lit(f"{c} contains a tab or newline: "), F.col("file")))).otherwise(F.col(c)))
    rows.select(*head, *counted, "text", *optional).write.mode("errorifexists").option("header", True).option(
        "sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def read_scores(spark: SparkSession, path) -> DataFrame:
    """Score rows: an empty cell is null, the rate columns are ignored."""
    return read_delimited(spark, path, SCORE_SCHEMA, sep=",", quoted=True,
                          non_empty=["espeak", "idx", "duration_s", "voice", "speaker"])


def write_scores(rows: DataFrame, path: str) -> None:
    """Score rows plus the rates, for reading only; floats with six significant digits."""
    kinds = columns_of(SCORE_SCHEMA)
    shown = lambda c, kind: F.format_string("%.6g", c) if kind == "double" else c.cast("string")
    cells = [F.when(F.col(c).isNotNull(), _six_digits(F.col(c)) if k == "double" else shown(F.col(c), k)).alias(c) for c, k in kinds.items()]
    cells += [F.when(row_rate(r).isNotNull(), _six_digits(row_rate(r))).alias(r) for r in RATES]
    rows.select(*cells).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def _six_digits(value: Column) -> Column:
    """Six significant digits without padding zeros (plain notation)."""
    magnitude = F.when(value == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(value)))).cast("int")
    scale = F.pow(F.lit(10.0), 5 - magnitude)
    kept = F.bround(value * scale, 0) / scale
    return F.regexp_replace(kept.cast("string"), r"\.0$", "")


PAIR_SCHEMA = "first string, second string, count bigint"


def write_pair_counts(counts: DataFrame, path: str) -> None:
    """Pairs by falling count, then by pair."""
    counts.select("first", "second", "count").orderBy(F.desc("count"), "first", "second").write.mode(
        "errorifexists").option("header", True).option("sep", "\t").option("quote", "").csv(path)


def read_pair_counts(spark: SparkSession, path) -> DataFrame:
    return require_unique(read_delimited(spark, path, PAIR_SCHEMA), "first", "second", what="pairs")


def read_languages(spark: SparkSession, path) -> DataFrame:
    """Language dimension; an empty cell means the metric does not apply."""
    rows = read_delimited(spark, path, "espeak string, whisper string, voxlingua string", exact=True, non_empty=["espeak"])
    return require_unique(rows, "espeak", what="languages")


def read_held_out(spark: SparkSession, path) -> DataFrame:
    rows = read_delimited(spark, path, "espeak string, idx int, text string", exact=True)
    return require_unique(rows, "espeak", "idx", what="held-out sentences")


def read_voices(spark: SparkSession, path) -> DataFrame:
    return read_delimited(spark, path, "voice string, speaker string", exact=True)


def read_ab_items(spark: SparkSession, path) -> DataFrame:
    schema = "voice string, speaker string, language string, item string, text string, original string, candidate string"
    return require_unique(read_delimited(spark, path, schema, exact=True), "voice", "speaker", "item", what="A/B items")


def read_rating_items(spark: SparkSession, path) -> DataFrame:
    schema = "language string, voice string, speaker string, item string, text string, file string"
    return require_unique(read_delimited(spark, path, schema, exact=True), "language", "voice", "speaker", "item", what="rating items")


def read_ab_answers(spark: SparkSession, path) -> DataFrame:
    schema = "listener string, voice string, speaker string, item string, original_side string, answer string"
    rows = read_delimited(spark, path, schema, sep=",", quoted=True)
    return check_domain(check_domain(rows, "original_side", ("A", "B")), "answer", ("A", "B", "tie"))


def read_ratings(spark: SparkSession, path) -> DataFrame:
    schema = "listener string, language string, voice string, speaker string, item string, score int"
    rows = read_delimited(spark, path, schema, "note string", sep=",", quoted=True)
    return rows.withColumn("score", F.when(~F.col("score").between(1, 5), F.raise_error(F.lit("score outside 1-5"))).otherwise(
        F.col("score"))).withColumn("note", F.coalesce("note", F.lit("")))


def read_verdicts(spark: SparkSession, path, tag: str) -> DataFrame:
    from ..operators.criteria import tagged_verdicts
    rows = read_delimited(spark, path, "voice string, speaker string", "human string", sep=",", quoted=True, placed=True)
    return tagged_verdicts(rows, tag)


def read_original_human(spark: SparkSession, path) -> DataFrame:
    return read_delimited(spark, path, "voice string, speaker string, human string, espeak string", sep=",", quoted=True, placed=True)


def read_runtime(spark: SparkSession, path) -> DataFrame:
    return read_delimited(spark, path, "variant string, ratio double", exact=True)


# --- shard manifests ---------------------------------------------------------------------------------------------

def read_shard_lines(spark: SparkSession, paths) -> DataFrame:
    """Non-blank manifest lines with their file, shard folder and ``position``."""
    lines = _all_lines(spark, paths).filter(F.trim("value") != "")
    return lines.withColumn("shard", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))


def _all_lines(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), file_position().alias("position"))


def read_shards(spark: SparkSession, paths, vocab: Vocabulary) -> DataFrame:
    """Parsed manifest records with ``problems``; see ``validated`` for the split."""
    return parse_records(read_shard_lines(spark, paths), vocab)


def read_valid_shards(spark: SparkSession, paths, vocab: Vocabulary) -> DataFrame:
    """Strict read: a bad line or a repeated ID fails, naming file and line."""
    from ..operators.records import duplicate_ids, validated
    good, bad = validated(read_shards(spark, paths, vocab))
    if not bad.isEmpty():
        require_empty(number_lines(bad, _all_lines(spark, paths)).limit(20).select("file", "line", "problems"), "malformed records")
    require_empty(duplicate_ids(good), "record IDs repeat")
    return good.drop("value", "position")


def number_lines(rejected: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds the 1-based ``line`` in its file of each rejected line: lines of earlier parts of the file, and its place in its own.

    ``lines`` are all lines of the same read with their ``position``; only one row per part of a file is held.
    """
    parts = lines.groupBy("file", F.col("position.block").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("position.row").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counted = parts.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    found = rejected.withColumn("block", F.col("position.block")).join(counted, ["file", "block"])
    return found.withColumn("line", (F.col("before") + F.col("position.row") - F.col("first") + 1).cast("int")).drop("block", "first", "before")


def read_loose_records(spark: SparkSession, paths) -> DataFrame:
    """The looser view: known fields only, others ignored, equal list lengths; malformed lines fail with their file."""
    lines = read_shard_lines(spark, paths)
    parsed = lines.withColumn("_r", F.from_json("value", RECORD_SCHEMA, {"mode": "FAILFAST"}))
    required = [c for c in columns_of(RECORD_SCHEMA.replace("array<int>", "array")) if c != "durations"]
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(f"_r.{c}").isNull()
    lengths = F.col("_r.durations").isNotNull() & (F.size("_r.durations") != F.size("_r.phoneme_ids"))
    checked = parsed.withColumn("_r", F.when(missing | lengths, F.raise_error(
        F.concat(F.lit("bad record in "), F.col("file")))).otherwise(F.col("_r")))
    return checked.select("_r.*", "file", "shard")


def write_shards(items: DataFrame, path: str) -> None:
    """One folder per shard of JSON lines, the audio path rewritten to the shard's own; refuses an existing target."""
    rows = items.withColumn("audio", F.concat(F.lit("audio/"), F.col("id"), F.lit(".flac")))
    rows.withColumn("shard", F.format_string("shard-%05d", F.col("shard").cast("bigint"))).repartition("shard").write.mode(
        "errorifexists").option("ignoreNullFields", False).partitionBy("shard").json(path)


def write_reports(teachers: DataFrame, speakers: DataFrame, path: str) -> None:
    """Filter report per teacher and hours per speaker, hours with three decimals."""
    hours = lambda df: df.withColumn("kept_hours", fixed(F.col("kept_hours"), 3))
    for name, df in (("filter", teachers), ("speakers", speakers)):
        hours(df).coalesce(1).write.mode("errorifexists").option("header", True).option("sep", "\t").csv(f"{path}/{name}")


PHONEMIZED = "run string, idx int, phonemes string, tokens array<string>"


def read_phonemized(spark: SparkSession, paths, reference: Sequence[str]) -> DataFrame:
    """Phonemized JSON lines; the stored tokens must be the string's characters that the reference alphabet has."""
    from ..functions.symbols import char_class, characters
    rows = spark.read.schema(PHONEMIZED).option("mode", "FAILFAST").json(paths)
    replay = characters(F.regexp_replace("phonemes", f"[^{char_class(reference)}]", ""))
    same = replay.eqNullSafe(F.col("tokens"))
    return rows.withColumn("tokens", F.when(same, F.col("tokens")).otherwise(F.raise_error(
        F.concat(F.lit("tokens differ from a replay: "), F.col("run"), F.lit(" "), F.col("idx").cast("string")))))
