import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tessitura.operators import catalog as C, checks, records as R
from tessitura.sources import sentences as T
from tessitura.streaming import ingest as I

VOCAB = R.Vocabulary(175, 0, 1, 2)


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.splitlines()], "value string")


def made_voice(rng, k):
    """A line of a voice list below /from and what it means below /to."""
    name, code = f"voice{k}", rng.choice(["xx", "yy-1", "zz"])
    file = lambda ending: f"{rng.choice(['p', 'q/r'])}/{k}{ending}"
    kind = rng.choice(["piper", "kokoro", "mms", "coqui", "glowtts", "mimic3", "kokoro_ja"])
    if kind in ("piper", "mimic3"):
        f = file("")
        paths = {"config": f"/to/{f}.onnx.json", "mnn": f"/to/{f}.mnn"} | ({"onnx": f"/to/{f}.onnx"} if kind == "piper" else {})
        return name, f"/from/{f}.onnx.json" if kind == "piper" else f"{kind}:{code}:/from/{f}.onnx.json", kind, None if kind == "piper" else code, paths
    if kind == "kokoro":
        return f"kokoro-{name}", f"{kind}:{code}", kind, code, {"voice": name}
    if kind == "kokoro_ja":
        f = file(".dic")
        return f"kokoro-{name}", f"{kind}:{code}:/from/{f}", kind, code, {"voice": name, "dict_path": f"/to/{f}"}
    names = {"mms": ("model", "tokens"), "coqui": ("model", "config"), "glowtts": ("model", "vocoder", "lexicon")}[kind]
    files = [file(f".{n}") for n in names]
    return name, f"{kind}:{code}:" + "|".join(f"/from/{f}" for f in files), kind, code, {n: f"/to/{f}" for n, f in zip(names, files)}


def test_voice_lists_equal_what_they_were_made_from(spark):
    rng = random.Random(41)
    made = [made_voice(rng, k) for k in range(80)]
    text = "".join(f"{name}\t{spec}\n" + "\n" * (rng.random() < 0.1) for name, spec, *_ in made)
    got = {r["voice"]: (r["kind"], r["espeak"], r["paths"]) for r in C.parse_voice_lists(lines(spark, text), "/from", "/to").collect()}
    assert got == {name: tuple(rest) for name, _, *rest in made} and len({m[2] for m in made}) == 7
    for _, spec, kind, *_ in made[:12]:
        if kind not in ("piper", "kokoro"):
            for bad, why in ((spec.replace("/from/", "/off/"), "not under"), (spec.replace(kind, "nothing", 1), "unknown engine"), (spec + "|/from/one/more|/from/two", "unknown engine")):
                with pytest.raises(Exception, match=why):
                    C.parse_voice_lists(lines(spark, f"n\t{bad}"), "/from", "/to").collect()


def test_speakers_take_their_configuration(spark):
    """Made configurations of one or many speakers; then every voice with one fault must be refused."""
    rng, configs, rows, want = random.Random(42), [], [], {}
    for k in range(25):
        many, voice, code, region = rng.random() < 0.5, f"w{k}", rng.choice(["xx", "xx-9"]), rng.choice(["xx_AA", "xx_BB", None])
        ids = {f"n{i}": i * 2 for i in range(rng.randint(2, 5))} if many else None
        raw = {"audio": {"sample_rate": 16000}, "espeak": {"voice": code}, "num_speakers": len(ids or "1"), "phoneme_id_map": {"_": [0]}}
        raw |= ({"language": {"code": region}} if region else {}) | ({"speaker_id_map": ids} if many else {}) | ({"phoneme_type": "text"} if k % 3 else {})
        configs.append((voice, json.dumps(raw)))
        speaker = rng.choice(list(ids)) if many else "0"
        rows.append(("g", code, voice, speaker, "good", "clean", 1.0, None))
        want[f"{voice}.{speaker}" if many else voice] = (ids[speaker] if many else None, {"xx_AA": "xx", "xx_BB": "xx-9"}.get(region, code), "piper")
    rows += [("g", "yy", "engine1", "0", "good", "clean", 1.0, None), ("g", "yy", "read aloud", "0", "good", "clean", 1.0, None)]
    want |= {"engine1": (None, "yy", "mms"), "read aloud": (None, "yy", "corpus")}
    parsed = C.parse_voice_configs(spark.createDataFrame(configs, "voice string, value string"))
    assert {r["voice"]: r["phoneme_type"] for r in parsed.collect()} == {v: "text" if "phoneme_type" in c else "espeak" for v, c in configs}
    engines = spark.createDataFrame([("engine1", "mms", "yy")], "voice string, kind string, espeak string")
    regions = spark.createDataFrame([("xx_AA", "xx"), ("xx_BB", "xx-9")], "locale string, language string")
    frame = lambda x: spark.createDataFrame(x, "lang string, espeak string, voice string, speaker string, tier string, condition string, weight double, articulation_rate double")
    got = {r["key"]: (r["sid"], r["language"], r["source_kind"]) for r in C.build_speakers(frame(rows), parsed, engines, regions).collect()}
    assert got == want
    faults = [(*r[:3], "nobody", *r[4:]) for r in rows[:26]] + [(r[0], "other", *r[2:]) for r in rows[:26]]
    refused = C.build_speakers(frame(faults), parsed, engines, regions, strict=False)
    assert refused.filter("problem IS NULL").count() == 0 and refused.count() == len(faults)
    with pytest.raises(checks.CheckError):
        C.build_speakers(frame(rows + faults[:1]), parsed, engines, regions)


def test_urls_and_required_files(spark):
    mirror = {"packs": {"a": {"files": [{"url": "https://cdn.test/v/v.onnx", "sizeBytes": 0}, {"url": "https://other.test/x", "sizeBytes": 1}]}}}
    source = {"packs": {"a": {"files": [{"url": "https://up.test/v.onnx", "mirrorPath": "v/v.onnx", "sizeBytes": 7}, {"url": "https://up.test/none", "sizeBytes": 1},
                                        {"url": "https://up.test/t", "mirrorPath": "az/tokens.txt", "sizeBytes": 3}, {"url": "https://up.test/m", "mirrorPath": "az/model.mnn", "sizeBytes": 3}]}}}
    one = lambda d: spark.createDataFrame([(json.dumps(d),)], "value string")
    index = C.url_index(one(source), one(mirror), spark.createDataFrame([("dict/m.bin", "https://e.test/m", "5")], "path string, url string, size string"), "cdn.test")
    got = {r["path"]: r for r in index.collect()}
    assert got["v/v.onnx"]["urls"] == ["https://cdn.test/v/v.onnx", "https://up.test/v.onnx"] and got["v/v.onnx"]["size"] == 7
    assert got["dict/m.bin"]["size"] == 5 and "x" not in got
    sources = C.parse_voice_lists(lines(spark, "p\t/b/v/v.onnx.json\nmms-az\tmms:az:/b/az/model.mnn|/b/az/tokens.txt\nkokoro-k\tkokoro_ja:ja:/b/dict/m.bin\n"), "/b", "")
    need = C.required_files(spark.createDataFrame([("p",), ("mms-az",), ("kokoro-k",)], "voice string"), sources.withColumn(
        "paths", F.transform_values("paths", lambda k, v: F.ltrim(v, F.lit("/")))), index, "kokoro/voices.bin")
    plan = {r["path"]: r["missing"] for r in C.plan_fetch(need, index).collect()}
    assert plan == {"v/v.onnx.json": True, "v/v.onnx": False, "v/v.mnn": True, "az/model.onnx": True, "az/tokens.txt": False, "kokoro/voices.bin": True, "dict/m.bin": False}


def test_keys(spark):
    df = spark.createDataFrame([("v|0", True), ("v", False), ("|0", False), ("v|0|1", False)], "k string, ok boolean").select(C.parse_voice_key(F.col("k"), False).isNotNull(), "ok")
    assert all(a == b for a, b in df.collect())
    with pytest.raises(Exception, match="not '<set>"):
        spark.createDataFrame([("v|0",)], "k string").select(C.parse_reference_key(F.col("k"))).collect()


def test_sentence_sources(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("es\tes\tHola a \"todos\n")
    for part in ("dev", "devtest"):
        (tmp_path / part).mkdir()
        (tmp_path / part / f"spa_Latn.{part}").write_text(f"linea {part}\n")
    table = T.read_sentence_table(spark, str(tmp_path / "s.tsv"))
    files = T.read_parallel_texts(spark, str(tmp_path), spark.createDataFrame([("es", "spa_Latn")], "lang string, code string"))
    assert {r["text"] for r in T.merge_sources(table, files).collect()} == {'Hola a "todos', "linea dev", "linea devtest"}


def test_manifest_stream_equals_batch(spark, tmp_path):
    good = {"id": "a", "audio": "a.flac", "language": "es", "espeak": "es", "speaker": "s", "condition": "clean", "phoneme_ids": [1, 0, 9, 0, 2], "durations": None,
            "text": "", "teacher": "t", "weight": 1}
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for n in range(3):
        (source / f"m{n}.jsonl").write_text("".join(json.dumps(good | {"id": f"{n}-{i}", "weight": i}) + "\n" for i in range(4)))
        I.ingest_manifests(spark, str(source), VOCAB, out + "/valid", out + "/bad", out + "/state").awaitTermination()
    batch, rejected = R.validated(R.parse_records(spark.read.text(str(source)), VOCAB))
    assert {r["id"] for r in spark.read.parquet(out + "/valid").collect()} == {r["id"] for r in batch.collect()} and batch.count() == 9
    assert spark.read.parquet(out + "/bad").count() == rejected.count() == 3


def test_manifest_backlog_is_taken_in_bounded_batches(spark, tmp_path):
    good = {"audio": "a.flac", "language": "es", "espeak": "es", "speaker": "s", "condition": "clean", "phoneme_ids": [1, 0, 9, 0, 2], "durations": [1, 2, 3, 4, 5],
            "text": "", "teacher": "t", "weight": 1.5}
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for n in range(3):
        lines = [json.dumps(good | {"id": f"{n}-{i}", **({"phoneme_ids": [7]} if i == 1 else {})}) for i in range(3)] + ["{", "  "]
        (source / f"m{n}.jsonl.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    I.ingest_manifests(spark, str(source), VOCAB, out + "/valid", out + "/bad", out + "/state", batch_bytes=1).awaitTermination()
    valid, bad = spark.read.parquet(out + "/valid"), spark.read.parquet(out + "/bad")
    assert sorted(p.name for p in (tmp_path / "out" / "valid").iterdir()) == ["batch=0", "batch=1", "batch=2"]
    assert sorted(tuple(r) for r in valid.select("id", "phoneme_ids", "durations", "batch").collect()) == sorted(
        (f"{n}-{i}", [1, 0, 9, 0, 2], [1, 2, 3, 4, 5], next(r["batch"] for r in valid.collect() if r["id"] == f"{n}-0")) for n in range(3) for i in (0, 2))
    assert sorted((r["value"][:1], len(r["value"]) > 1, r["problems"]) for r in bad.collect()) == sorted(
        [("{", False, ["json"])] * 3 + [("{", True, ["phoneme_ids", "durations"])] * 3)


def test_step_windows_over_micro_batches(spark, tmp_path):
    """Windows of 7 steps of three runs whose steps land in five files, against a plain loop; the rest waits."""
    rng = random.Random(6)
    clock, steps, want, open_ = {}, [], [], {}
    for k in range(150):
        run = rng.choice(["hot", "hot", "a", "b"])
        begin = clock.get(run, 100.0 + rng.random())
        clock[run] = end = begin + rng.uniform(0.1, 2)
        steps.append((run, k, begin, end, rng.randint(1, 32), rng.random(), rng.choice([0.0, 0.05])))
    for run, k, begin, end, samples, wait, excluded in steps:
        w = open_.setdefault(run, [begin, 0, 0.0, 0.0, 0.0])
        w[1:] = [w[1] + 1, w[2] + samples, w[3] + wait, w[4] + excluded]
        if w[1] == 7:
            seconds = end - w[0] - w[4]
            want.append((run, w[0], end, 7, 7 / seconds, w[2] / seconds, w[3] / seconds))
            open_[run] = [end, 0, 0.0, 0.0, 0.0]
    kind = "run string, step long, t_begin double, t_end double, samples int, wait double, excluded double"
    for n in range(5):
        part = steps[30 * n:30 * n + 30]
        rng.shuffle(part)
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = I.run_available(I.step_windows(stream, "run", 7), "windows", "append", I.ON_DISK).collect()
    assert [tuple(r)[:1] + tuple(map(pytest.approx, tuple(r)[1:])) for r in sorted(got)] == sorted(want) and len(want) > 15


def test_queries_and_sql_pair_up():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 140


def test_training_view(spark, tmp_path):
    from tessitura.operators.sampling import EpochOptions
    from tessitura.plans import training_view as V
    rows = [(str(i), i, "es" if i % 3 else "de", "es" if i % 3 else "de", f"s{i % 4}", [1, 0, 9, 0, 2], [2, 2, 2, 2, 2], 2560 if i else 10, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, position int, language string, espeak string, speaker string, phoneme_ids array<int>, durations array<int>, num_samples int, weight double")
    o = V.ViewOptions(1000, 256, 1.0, 5.0, 5, EpochOptions(4, 6, 2, 2, 1, 3, 2))
    view = V.prepare(df, o)
    assert view["items"].count() == 39 and {r["language"]: r["id"] for r in view["languages"].collect()} == {"es": 0, "de": 1}
    held = {r["id"] for r in view["split"].filter("split = 'validation'").collect()}
    batches = V.epoch_batches(view, o, view["pairs"])
    V.write_epoch(batches, str(tmp_path / "epoch"))
    back = spark.read.parquet(str(tmp_path / "epoch"))
    assert len(held) == 5 and back.count() == 24 and not held & {r["id"] for r in back.collect()}
    assert {(r["epoch"], r["rank"]) for r in back.select("epoch", "rank").distinct().collect()} == {(3, 0), (3, 1)}
    with pytest.raises(checks.CheckError):
        V.prepare(df.withColumn("durations", F.array(F.lit(1))), o)


def test_phonemized_replay(spark, tmp_path):
    from tessitura.sources import readers as D
    path = tmp_path / "p.jsonl"
    path.write_text(json.dumps({"run": "de", "idx": 0, "phonemes": "a#b", "tokens": ["a", "b"]}) + "\n")
    assert D.read_phonemized(spark, str(path), ["a", "b"]).count() == 1
    with pytest.raises(Exception, match="replay"):
        D.read_phonemized(spark, str(path), ["a", "#"]).collect()
