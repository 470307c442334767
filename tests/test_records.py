import json
import random

import pytest
from pyspark.sql import functions as F

from tessitura.operators import checks, criteria as C, records as R
from tessitura.sources import readers as S

VOCAB = R.Vocabulary(60, 4, 2, 3)


def record(seed=0, **changes):
    rng = random.Random(seed)
    inner = [x for _ in range(rng.randint(0, 6)) for x in (rng.randint(5, 59), 4)]
    ids = [2, 4, *inner, 3]
    made = {"id": f"r{seed}", "audio": f"part{seed % 3}/clip{seed}.flac", "language": rng.choice(["nl", "pt-BR", "fi"]), "espeak": "nl", "speaker": f"p{seed % 5}",
            "condition": rng.choice(R.CONDITIONS), "phoneme_ids": ids, "durations": [rng.randint(1, 9) for _ in ids] if seed % 4 else None,
            "text": "tekst" * (seed % 3), "teacher": "maker", "weight": rng.choice([0.25, 1, 3.5])}
    return made | changes


def breakers(rng, whole):
    """(expected problem, changed record): for each field every way to break its rule."""
    ids, n = whole["phoneme_ids"], len(whole["phoneme_ids"])
    swap = lambda i, x: {"phoneme_ids": ids[:i] + [x] + ids[i + 1:]}
    some = [rng.randint(1, 9) for _ in ids]
    out = [(f, {f: x}) for f in ("id", "espeak", "speaker", "teacher") for x in ("", None, rng.randint(1, 9), ["x"])]
    out += [("audio", {"audio": x}) for x in ("", "/" + whole["audio"], "a/../b.flac", None)]
    out += [("language", {"language": x}) for x in ("", "nl.be", None)]
    out += [("condition", {"condition": x}) for x in ("studio", "", None)]
    out += [("weight", {"weight": x}) for x in (0, -rng.random(), "1", False, None)] + [("text", {"text": x}) for x in (None, 5)]
    out += [("phoneme_ids", c) for c in (swap(0, 3), swap(n - 1, 2), swap(1, 5), swap(n - 2, 60) if n > 3 else swap(1, 60), {"phoneme_ids": ids + [4]}, {"phoneme_ids": [2]},
                                         {"phoneme_ids": []}, {"phoneme_ids": "ids"}, swap(0, -1), swap(1, None), swap(1, 4.5))]
    out += [("durations", {"durations": x}) for x in (some[1:], some + [1], [0] * n, [-1] + some[1:], "none", {"a": 1})]
    return out + [("fields", {"more": 1}), ("json", {"weight": float("nan")}), ("json", {"weight": float("-inf")})]


def parse(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string").repartition(3)
    return {r["n"]: r for r in R.parse_records(df, VOCAB).collect()}


def test_made_records_are_valid(spark):
    made = [record(k) for k in range(40)]
    rows = parse(spark, [json.dumps(x) for x in made])
    for n, x in enumerate(made):
        assert rows[n]["problems"] == [] and {f: rows[n][f] for f in R.FIELDS} == x


def test_every_broken_field_is_named(spark):
    cases = [(want, record(seed) | change) for seed in (1, 6, 9) for want, change in breakers(random.Random(seed), record(seed))]
    missing = [("fields", {k: v for k, v in record(2).items() if k != f}) for f in R.FIELDS]
    rows = parse(spark, [json.dumps(x) for _, x in cases + missing] + ["", "{", "7"])
    for n, (want, x) in enumerate(cases + missing):
        assert want in rows[n]["problems"], (want, x, rows[n]["problems"])
    assert all(rows[len(cases) + len(missing) + k]["problems"] for k in range(3))


def test_shards_round_trip_and_strict_read(spark, tmp_path):
    items = spark.createDataFrame([(i % 2, *[record(1, id=str(i), audio=f"audio/{i}.flac")[f] for f in R.FIELDS]) for i in range(4)], "shard long, " + R.RECORD_SCHEMA)
    S.write_shards(items, str(tmp_path / "shards"))
    back = S.read_valid_shards(spark, str(tmp_path / "shards/*/*.json"), VOCAB)
    assert sorted(r["audio"] for r in back.collect()) == [f"audio/{i}.flac" for i in range(4)]
    assert S.read_loose_records(spark, str(tmp_path / "shards/*/*.json")).count() == 4
    with pytest.raises(Exception, match="already exists"):
        S.write_shards(items, str(tmp_path / "shards"))
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "manifest.jsonl").write_text(json.dumps(record()) + "\n\n{\n")
    with pytest.raises(checks.CheckError, match=", 3, "):
        S.read_valid_shards(spark, str(tmp_path / "m/*.jsonl"), VOCAB)
    (tmp_path / "m" / "manifest.jsonl").write_text((json.dumps(record()) + "\n") * 2)
    with pytest.raises(checks.CheckError, match="repeat"):
        S.read_valid_shards(spark, str(tmp_path / "m/*.jsonl"), VOCAB)


@pytest.fixture
def small_splits(spark):
    """Files are read in parts of about 150 bytes, several parts to a task."""
    sizes = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "3"}
    before = {k: spark.conf.get(k, None) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_errors_name_file_and_line_of_split_files(spark, tmp_path, small_splits):
    rng, wrong = random.Random(3), {}
    for name in ("b.jsonl", "a.jsonl"):
        lines = [json.dumps(record(id=f"{name}{i}")) if rng.random() < 0.9 else rng.choice(["{", "", "   ", "[]"]) for i in range(60)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        wrong |= {(name, i): x for i, x in enumerate(lines, 1) if x.strip() and x[-1] != "}"}
    bad = R.validated(S.read_shards(spark, str(tmp_path / "*.jsonl"), VOCAB))[1]
    got = {(r["file"].split("/")[-1], r["line"]): r["value"] for r in S.number_lines(bad, S._all_lines(spark, str(tmp_path / "*.jsonl"))).collect()}
    assert got == wrong and len(got) > 3
    with pytest.raises(checks.CheckError, match="malformed"):
        S.read_valid_shards(spark, str(tmp_path / "*.jsonl"), VOCAB)


def test_verdicts_keep_the_order_of_their_file(spark, tmp_path, small_splits):
    """The first verdict of a voice counts, the last of an original, as they stand in the file."""
    rng, first, last = random.Random(5), {}, {}
    rows = [(f"v{rng.randint(0, 9)}", rng.choice(["pass", "fail"])) for _ in range(120)]
    for v, human in rows:
        first.setdefault(v, human)
        last[v] = human
    (tmp_path / "new.csv").write_text("voice,speaker,human\n" + "".join(f"t~{v}~xx,0,{h}\n" for v, h in rows))
    (tmp_path / "old.csv").write_text("voice,speaker,human,espeak\n" + "".join(f"{v},0,{h},xx\n" for v, h in rows))
    new, old = S.read_verdicts(spark, str(tmp_path / "new.csv"), "t"), S.read_original_human(spark, str(tmp_path / "old.csv"))
    assert new.rdd.getNumPartitions() > 3
    assert {r["voice"]: r["h"] for r in new.repartition(5).groupBy("voice").agg(C._at_end(new, "human", F.min_by, F.min).alias("h")).collect()} == first
    assert {r["voice"]: r["h"] for r in old.repartition(5).groupBy("voice").agg(C._at_end(old, "human", F.max_by, F.max).alias("h")).collect()} == last


def test_score_rows_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("v", "0", "de", 0, "a", "/a", 1.5, 1, 10), ("v", "0", "de", 1, "b", "/b", 2.0, 9, 30), ("v", "0", "de", 2, "c", "/c", 2.0, None, None)],
                                 "voice string, speaker string, espeak string, idx int, text string, path string, duration_s double, per_edits int, per_units int")
    kinds = S.columns_of(S.SCORE_SCHEMA)
    full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    S.write_scores(full, str(tmp_path / "rows"))
    back = S.read_scores(spark, str(tmp_path / "rows"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in full.collect()}
    from tessitura.operators.scoring import summarize
    line = summarize(back).first()
    assert line["per"] == pytest.approx(0.25) and line["cer"] is None and line["n"] == 3 and line["UTMOS_min"] is None


def test_manifest_reads_and_refuses(spark, tmp_path):
    head = "voice\tspeaker\tespeak\tidx\tfile\tsample_rate\ttext\tcpu_s\textra\n"
    path = tmp_path / "m.tsv"
    path.write_text(head + 'v\t0\tde\t0\ta.wav\t22050\tDas "ist.\t\tx\n')
    row = S.read_manifest(spark, str(path)).first()
    assert row["text"] == 'Das "ist.' and row["cpu_s"] is None and row["reference_wav"] is None
    path.write_text(head + "v\t0\tde\t0\ta.wav\t22050\tDas.\t\tx\n" * 2)
    with pytest.raises(checks.CheckError):
        S.read_manifest(spark, str(path))
    path.write_text("voice\tspeaker\n")
    with pytest.raises(checks.CheckError):
        S.read_manifest(spark, str(path))
    path.write_text(head + "v\t\tde\t0\ta.wav\t22050\tDas.\t\tx\n")
    with pytest.raises(Exception, match="empty speaker"):
        S.read_manifest(spark, str(path)).collect()
    rows = spark.createDataFrame([("v", "0", "de", 0, "a.wav", 22050, "a\tb")], S.MANIFEST_SCHEMA)
    with pytest.raises(Exception, match="tab or newline"):
        S.write_manifest(rows, str(tmp_path / "bad"))
    S.write_manifest(rows.withColumn("text", F.lit("a b")), str(tmp_path / "good"))
    assert S.read_manifest(spark, str(tmp_path / "good")).first()["text"] == "a b"


def test_small_tables(spark, tmp_path):
    def file(text):
        p = tmp_path / "t"
        p.write_text(text)
        return str(p)
    assert S.read_tab_table(spark, file("# note\nlocale\tlanguage\nes_ES\tes\n")).collect()[0]["language"] == "es"
    assert [tuple(r) for r in S.read_languages(spark, file("espeak\twhisper\tvoxlingua\nde\tde\t\n")).collect()] == [("de", "de", None)]
    with pytest.raises(checks.CheckError):
        S.read_languages(spark, file("espeak\twhisper\tvoxlingua\nde\ta\tb\nde\ta\tb\n"))
    tiers = "lang,espeak,voice,speaker,human,audio,tier,condition,weight,articulation_rate\nes,es,v,F,pass,pass,{},clean,1.0,\n"
    assert S.read_tiers(spark, file(tiers.format("good"))).first()["articulation_rate"] is None
    with pytest.raises(Exception, match="unexpected value"):
        S.read_tiers(spark, file(tiers.format("best"))).collect()
    with pytest.raises(Exception, match="unexpected value"):
        S.read_ab_answers(spark, file("listener,voice,speaker,item,original_side,answer\nme,v,0,1,A,C\n")).collect()
    assert S.read_runtime(spark, file("variant\tratio\nbase\t1.08\n")).first()["ratio"] == 1.08
    got = S.read_verdicts(spark, file('lang,voice,speaker,human,audio\n"es","run1~v~es-419","0","pass",""\n"es","v","0","fail",""\n'), "run1").collect()
    assert [tuple(r)[:4] for r in got] == [("v", "0", "es-419", "pass")]
    pairs = spark.createDataFrame([("a", "b", 3), ("b", "a", 5), ("a", "a", 3)], S.PAIR_SCHEMA)
    S.write_pair_counts(pairs, str(tmp_path / "pairs"))
    assert {tuple(r) for r in S.read_pair_counts(spark, str(tmp_path / "pairs")).collect()} == {("a", "b", 3), ("b", "a", 5), ("a", "a", 3)}


def test_long_arrays_are_checked_without_a_step_per_item(spark):
    """No lambda over durations in the plan; other arrays than those of small ints give what the variant gives."""
    long = [2, 4, *[x for k in range(150_000) for x in (5 + k % 55, 4)], 3]
    whole = record(1) | {"phoneme_ids": long, "durations": [1] * len(long)}
    lines = [whole, whole | {"phoneme_ids": long[:-2] + [5, 3]}, whole | {"durations": [1] * (len(long) - 1) + [-1]}, whole | {"phoneme_ids": "[2,4,3]", "durations": None},
             record(2, phoneme_ids=[2, 4, 1 << 31, 4, 3]), record(2, phoneme_ids=[2, None, 3], durations=[1, None, 1]), record(2, durations=[1 << 70])]
    got = parse(spark, [json.dumps(x) for x in lines])
    assert [got[k]["problems"] for k in range(len(lines))] == [
        [], ["phoneme_ids"], ["durations"], ["phoneme_ids"], ["phoneme_ids", "durations"], ["phoneme_ids", "durations"], ["durations"]]
    assert got[0]["phoneme_ids"] == long and got[3]["phoneme_ids"] is None and got[4]["phoneme_ids"] == [2, 4, None, 4, 3]
    assert got[5]["phoneme_ids"] == [2, None, 3] and got[5]["durations"] == [1, None, 1] and got[6]["durations"] is None
    plan = R.parse_records(spark.createDataFrame([("{}",)], "value string"), VOCAB)._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan and "aggregate(" not in plan


@pytest.mark.parametrize("ids, bad", [([2, 4, 9, 4, 3], False), ([2, 4, 60, 4, 3], True), ([2, 4, None, 4, 3], None), ([2, None, 9, 4, 3], None),
                                      ([2, None, 9, 5, 3], True), ([2, 4, None, -1, 3], True), ([], True), (None, None), ([None] * 3, None)])
def test_layout_with_unknown_items(spark, ids, bad):
    assert spark.createDataFrame([(ids,)], "ids array<int>").select(R.bad_layout(F.col("ids"), VOCAB)).first()[0] is bad


@pytest.mark.parametrize("durations, bad", [([1, 0, 2], False), ([0, 0, 0], True), ([3, -3, 0], True), ([0, None, 0], None), ([1, None, -1], True),
                                            ([None] * 3, None), ([1, None], True), ([], True), (None, False)])
def test_durations_with_unknown_items(spark, durations, bad):
    row = spark.createDataFrame([([2, 4, 3], durations)], "ids array<int>, d array<int>")
    assert row.select(R.bad_durations(F.col("d"), F.col("ids"))).first()[0] is bad
