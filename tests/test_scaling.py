"""Work that must stay whole and grow with the rows: alignment, pair status, replay of maps, whole rounds of utterances."""
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import align as A
from tessitura.operators import planning as L
from tessitura.operators import tokens as K


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_steps_are_arrays_and_cheapest():
    rng = random.Random(31)
    for n in (0, 1, 64, 300):
        a, b = ([rng.choice("abcd ") for _ in range(rng.randint(n // 2, n))] for _ in range(2))
        ops, refs, hyps = A._steps(a, b)
        assert all(isinstance(x, np.ndarray) for x in (ops, refs, hyps)) and (ops > 0).sum() == edit_distance(a, b)
        assert refs[refs >= 0].tolist() == list(range(len(a))) and hyps[hyps >= 0].tolist() == list(range(len(b)))
        assert all((a[i] == b[j]) == (o == 0) for o, i, j in zip(ops, refs, hyps) if i >= 0 and j >= 0)


def test_alignment_of_nulls_and_empty_sides(spark):
    df = spark.createDataFrame([(0, None, ["a"]), (1, ["a"], None), (2, [], ["a"]), (3, ["a"], []), (4, [], [])], "i int, r array<string>, h array<string>")
    got = [r["s"] and [tuple(s) for s in r["s"]] for r in df.select("i", A.align(F.col("r"), F.col("h")).alias("s")).orderBy("i").collect()]
    assert got == [None, None, [("insert", None, 0)], [("delete", 0, None)], []]


WORDS = "key string, words array<array<struct<base:string,marks:string>>>"


def status_rows(spark, rng):
    rows = [(f"k{n}", [[(rng.choice("uvwx"), "") for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(0, 4))]) for n in range(25)]
    trained = spark.createDataFrame([("u", "v", 2), ("v", "w", 1), ("w", "w", 0), ("x", "u", 4)], "first string, second string, count long")
    return spark.createDataFrame(rows, WORDS), trained


def test_pair_status_needs_no_shuffle_and_equals_the_join(spark, monkeypatch):
    df, trained = status_rows(spark, random.Random(5))
    near = K.unit_pair_status(df, "key", "words", trained)
    assert "Exchange" not in plan(near)
    found = sorted(map(tuple, near.collect()))
    monkeypatch.setattr(K, "MOST_PAIRS", 0)
    assert found == sorted(map(tuple, K.unit_pair_status(df, "key", "words", trained).collect())) and len(found) > 40


def test_split_joins_by_key(spark):
    df, trained = status_rows(spark, random.Random(6))
    edits = df.select("key", F.transform(F.flatten("words"), lambda u: F.lit(1)).alias("edits"))
    split = K.split_by_pair_status(edits, "key", "edits", K.unit_pair_status(df, "key", "words", trained))
    assert re.findall(r"Join \[([^\]]*)\]", plan(split)) and all("unit" not in keys for keys in re.findall(r"Join \[([^\]]*)\]", plan(split)))
    assert all(r["per_seen_edits"] == r["per_seen_units"] and r["per_unseen_edits"] == r["per_unseen_units"] for r in split.collect())
    with pytest.raises(Exception, match="do not match"):
        K.split_by_pair_status(edits.withColumn("edits", F.concat("edits", F.array(F.lit(1)))), "key", "edits", K.unit_pair_status(df, "key", "words", trained)).collect()


def letters():
    keys = ["_", "^", "$", " ", *"abc"]
    kind = lambda k: "special" if k in "_^$" else "space" if k == " " else "vowel"
    return K.TokenTable({k: i for i, k in enumerate(keys)}, {k: kind(k) for k in keys}, frozenset({"en"}), reserved="_^$")


def test_a_filter_on_tokens_does_not_tokenize_twice(spark):
    t = K.tokenize(spark.createDataFrame([("ab c", "en"), ("a#", "en")], "s string, l string"), letters(), "s", "l")
    fine = t.filter(F.col("tokens.error").isNull()).select("phoneme_ids")
    assert plan(fine).count("[tokens(") == 1 and len(fine.collect()) == 1


def plain_replay(known, text):
    words = text.split()
    if words and all(w in known for w in words):
        return [1, 0, *[x for w in words for x in (known[w], 0)], 2], [], True
    ids, dropped, at = [1, 0], [], 0
    while at < len(text):
        key = next((k for k in sorted(known, key=len, reverse=True) if text.startswith(k, at)), None)
        if key is None:
            dropped.append((at, text[at]))
        else:
            ids += [known[key], 0]
        at += len(key or "x")
    return [*ids, 2], dropped, False


def test_replay_equals_a_plain_scan(spark):
    rng = random.Random(12)
    single = {"_": 0, "^": 1, "$": 2, " ": 3, "a": 4, "b": 5}
    maps = {"single": single, "long": single | {"ab": 6, "cab": 7}}
    rows = [(i, "".join(rng.choice("aabbc é\U0001f600") for _ in range(rng.randint(0, 9))), rng.choice(list(maps))) for i in range(300)]
    rows += [(300, "a b", "single"), (301, "ab a", "long"), (302, "ab a", "single"), (303, "", "long")]
    df = spark.createDataFrame(rows, "i int, t string, v string").repartition(3)
    got = {r["i"]: (r["r"]["ids"], [tuple(d) for d in r["r"]["dropped"]], r["r"]["whitespace_split"])
           for r in df.select("i", K.replayer(maps)(F.col("t"), F.col("v")).alias("r")).collect()}
    assert got == {i: plain_replay(maps[v], t) for i, t, v in rows}


def test_lossy_report_reads_its_rows_once(spark):
    known = {"_": 0, "^": 1, "$": 2, " ": 3, "a": 4}
    df = spark.createDataFrame([("a b#", "v", "en", 2), ("aa", "v", "en", 3), ("a a", "v", "en", 5), ("aa", "w", "en", 1)], "s string, v string, l string, n int")
    report = K.lossy_report(K.remap(df, letters(), {"v": known, "w": known}, "s", "v", "l"), "v", "n")
    assert plan(report).count("Scan") == 1
    assert sorted(map(tuple, report.collect())) == [("v", 10, 7, "#:2 b:2"), ("w", 1, 0, "")]


@pytest.mark.parametrize("core,share,cycles", [(7, 0.35, 2), (0, 0.0, 1), (400, 0.5, 3)])
def test_whole_rounds_equal_a_plain_loop(spark, core, share, cycles):
    tongue = {"p1": "nl", "p2": "nl", "p3": "fi", "p4": "xx"}
    lines = {"nl": [f"nl line {i}" for i in range(131)], "fi": [f"fi line {i}" for i in range(23)], "xx": []}
    sentences = spark.createDataFrame([(lang, i + 1, t) for lang, ts in lines.items() for i, t in enumerate(ts)], "espeak string, rank int, text string").repartition(3)
    who = spark.createDataFrame(list(tongue.items()), "key string, espeak string")
    sha = lambda *parts: hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()
    want = []
    for k, lang in tongue.items():
        order, mine = lines[lang][:core] + sorted(lines[lang][core:], key=lambda t: sha(3, k, t)), []
        for cycle in range(cycles):
            for t in order:
                twice = int(sha(3, k, t, cycle, "second")[:16], 16) / 2**64 < share
                mine += [(cycle, 2 * cycle + copy, t) for copy in range(1 + twice)]
        want += [(k, p, *x) for p, x in enumerate(mine)]
    got = L.utterance_order(who, sentences, core, 3, share, cycles=cycles).select("key", "position", "cycle", "render", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("share,most", [(1, 1), (2, 1), (4, 10**9)])
def test_speakers_in_turns_equal_all_at_once(spark, monkeypatch, share, most):
    monkeypatch.setattr(L, "ROUND_SHARE", share)
    monkeypatch.setattr(L, "ROUND_ROWS", most)
    lines = [("nl", i + 1, f"nl line {i}", i) for i in range(61)] + [("fi", i + 1, f"fi line {i}", 100 + i) for i in range(9)]
    sentences = spark.createDataFrame(lines, "espeak string, rank int, text string, line bigint").repartition(3)
    who = spark.createDataFrame([(f"p{k}", "nl" if k % 3 else "fi") for k in range(11)] + [("p1", "nl"), (None, "fi")], "key string, espeak string")
    calls, text = [], {x[3]: x[2] for x in lines}

    def each(rows):
        calls.append(rows.columns)
        return rows.select("key", "position", "render", "line")

    got = L.utterance_order(who, sentences, 5, 3, 0.3, cycles=2, columns=("line",), each=each).collect()
    want = L.utterance_order(who, sentences, 5, 3, 0.3, cycles=2).select("key", "position", "render", "text").collect()
    assert len(calls) == {1: 8, 2: 4, 4: 1}[share] and all("text" not in c for c in calls)
    place = lambda x: (x[0] or "", *x[1:])
    assert sorted(((r["key"], r["position"], r["render"], text[r["line"]]) for r in got), key=place) == sorted(map(tuple, want), key=place)


def test_parts_of_speakers_in_turns(spark, monkeypatch, tmp_path):
    from tessitura.queries.planning import w4_parts

    words = ["river", "stone", "green", "paper", "quiet", "lamp", "door", "seven"]
    rng = random.Random(4)
    docs = [(k, ". ".join(" ".join(rng.choices(words, k=6)) for _ in range(7)), rng.choice(["en", "fr"]), f"src{k % 5}", 200) for k in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    whole = sorted(map(tuple, w4_parts(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(L, "ROUND_ROWS", 1)
    monkeypatch.setattr(L, "ROUND_SHARE", 1)
    asked, before = [], L._rounds_of
    monkeypatch.setattr(L, "_rounds_of", lambda who, *rest: asked.append(who.count()) or before(who, *rest))
    assert sorted(map(tuple, w4_parts(spark, str(tmp_path)).collect())) == whole
    assert len(asked) > 3 and sum(asked) == len({(d[3], d[2]) for d in docs})
    assert {(r[0], r[1]) for r in whole} == {(f"{d[3]}.{d[2]}", p) for d in docs for p in range(3)} and all(r[4] for r in whole)


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0 - 2.0**-53, 1.0, 1.5])
def test_hex_bound_is_the_unit_hash_bound(share):
    bound = L._hex_below(share)
    near = [int(bound, 16) + d for d in (-2049, -1024, -1, 0, 1, 1024)] if bound != "g" else []
    for v in [0, 1, 2**63, 2**64 - 1025, 2**64 - 1, *near]:
        if 0 <= v < 2**64:
            assert (f"{v:016x}" < bound) == (float(v) / 2**64 < share)


def test_written_tables_leave_no_shuffle_files(spark):
    from tessitura.session import DROP_SHUFFLES, written

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in f}
    before, setting = shuffled(), spark.conf.get(DROP_SHUFFLES, None)
    table = written(spark.range(5000).groupBy((F.col("id") % 77).alias("k")).agg(F.sum("id").alias("s")), "sums")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert table.count() == 77 and spark.conf.get(DROP_SHUFFLES, None) == setting


def test_ids_are_compared_in_one_pass(spark):
    from tessitura.operators import records as R

    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def counted(x):
        seen.add(1)
        return x

    old = [("a", "t", [1, 2]), ("b", "t", [1, None, 2]), ("c", "t", [12]), ("d", "t", None), ("e", "u", []), ("f", "u", None), ("g", "u", [3]), (None, "u", [4]), ("h", None, [5]),
           ("i", "t", [7]), ("i", "t", [8])]
    new = [("a", [1, 2]), ("b", [1, 2]), ("c", [1, 2]), ("d", None), ("e", None), ("f", []), ("g", [3]), ("i", [7]), ("i", [9]), ("j", [1])]
    records = spark.createDataFrame(old, "id string, teacher string, phoneme_ids array<int>").withColumn("phoneme_ids", counted.asNondeterministic()("phoneme_ids"))
    fresh = spark.createDataFrame(new, "id string, phoneme_ids array<int>")
    got = {r["teacher"]: (r["records"], r["differing"], r["first_ids"]) for r in R.compare_ids(records, fresh).collect()}
    assert got == {"t": (8, 5, "b c i"), "u": (4, 3, "e f"), None: (1, 1, None)}
    assert seen.value == len(old)


def test_epoch_reads_its_items_once_and_keeps_its_plan_short(spark):
    from tessitura.operators import sampling as P

    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(x):
        seen.add(1)
        return x

    rows = [(k, "abcd"[k % 4], 1.0, 2.0, 10 * k) for k in range(400)]
    items = spark.createDataFrame(rows, "id bigint, lang string, weight double, seconds double, length bigint").withColumn("length", counted.asNondeterministic()("length"))
    epoch = P.plan_epoch(items, P.EpochOptions(8, 12, 4, 3, 1))
    got = epoch.collect()
    assert len(got) == 12 * 8 and all(r["length"] == 10 * r["id"] and r["lang"] == "abcd"[r["id"] % 4] for r in got)
    assert seen.value == len(rows)
    assert plan(epoch).count("Exchange") < 40


@pytest.mark.parametrize("most", [20_000, 3])
def test_words_of_bases_give_the_pairs_of_words_of_units(spark, monkeypatch, most):
    from tessitura.queries.symbols import TABLE

    monkeypatch.setattr(K, "MOST_PAIRS", most)
    rng = random.Random(8)
    texts = ["".join(rng.choice("aabbce\u0301\u0327 ß,  ") for _ in range(rng.randint(0, 14))) for _ in range(120)] + ["\u0301a", "a \u0301", "", "a_b", "e\u0301\u0327a"]
    rows = spark.createDataFrame([(k, list(t)) for k, t in enumerate(texts)], "key int, keys array<string>")
    words = lambda **how: rows.select("key", K.reference_words(F.col("keys"), TABLE, **how).alias("w")).select("key", "w.*")
    units, bases = words(), words(bases=True)
    want = {r["key"]: (r["malformed"], r["words"] and ["".join(u["base"] for u in w) for w in r["words"]]) for r in units.collect()}
    assert {r["key"]: (r["malformed"], r["words"]) for r in bases.collect()} == want
    assert sum(m for m, _ in want.values()) > 5 and {"a", "c", "ß", "e"} < set("".join(w for _, ws in want.values() for w in ws or []))
    pairs = sorted(map(tuple, K.pair_counts(units, "words").collect()))
    assert sorted(map(tuple, K.pair_counts(bases, "words").collect())) == pairs and len(pairs) > 3
    trained = spark.createDataFrame(pairs[::2], "first string, second string, count long")
    status = [sorted(map(tuple, K.unit_pair_status(x.filter("words IS NOT NULL"), "key", "words", trained).collect())) for x in (units, bases)]
    assert status[0] == status[1] and {s for _, _, s in status[0]} == {True, False}


def test_sentences_are_classified_and_tokenized_once(spark, tmp_path):
    """Reject counts and both parts of parseable rows take one run over their input, counted by an accumulator."""
    from tessitura.operators import selection as S
    from tessitura.operators import tokens as K
    from tessitura.queries.symbols import TABLE

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    texts = ["one two three four", "one two three four", "One two three four", "too short", "a b c 4", "x y z w"]
    rows = spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id bigint, lang string, sentence string")
    passed = rows.withColumn("sentence", counted.asNondeterministic()("sentence"))
    got = {(r["lang"], r["reason"]): r["n"] for r in S.reject_counts(S.classify(passed)).collect()}
    assert got == {("en", "too_short"): 1, ("en", "digit"): 1, ("en", "duplicate"): 2}
    assert seen.value == len(texts)
    kept, rejected = K.parseable(passed.withColumn("sentence", F.lower("sentence")), TABLE, "sentence", "lang")
    assert (kept.count(), rejected.count()) == (5, 1)
    assert seen.value == 2 * len(texts)
