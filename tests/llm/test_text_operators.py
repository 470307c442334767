"""Rules, licences, decontamination, BPE and token files against plain versions of themselves."""
from __future__ import annotations

import base64
import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import re

from tessitura.llm import bpe, decontam, licenses, repair, rules
from tessitura.llm.common import letter_words

from .common import CLASH, awkward, prose, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_rules_against_plain_counts(spark):
    rows = awkward()
    got = rules.apply_policy(rules.ledger(table(spark, rows, extra=CLASH)), "v1").collect()
    assert len(got) == len(rows)
    for r in got:
        w = words_of(r.text)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in (r.text or "").split("\n") if words_of(x)]
        want = dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=sum(c in "#*$%&|<>" for c in r.text or ""),
                    n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(inside), n_lines=len(lines),
                    n_letter_words=sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in w))
        assert {k: r[k] for k in want} == want
        bits = sum(1 << k for k, rule in enumerate(rules.RULES.values()) if eval(rule, {}, want))  # noqa: S307  the rules are SQL and Python alike
        assert r.fail_bits == bits and r.kept == (bits == 0)


def test_ablations_count_what_only_one_rule_rejects(spark):
    rows = rules.ledger(table(spark, awkward()))
    bits = [r.fail_bits for r in rows.collect()]
    got = {r.rule: (r.n_failed, r.n_only) for r in rules.ablations(rows).collect()}
    for k, rule in enumerate(rules.RULES):
        assert got[rule] == (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits))


def test_empty_tables(spark):
    none = table(spark, [])
    for frame in (rules.ledger(none), licenses.scan(none), decontam.contamination(none, none.withColumnRenamed("doc_id", "item_id")),
                  bpe.decode(bpe.encode(none, RANKS, public_tokenizers.PATTERN), RANKS)):
        assert frame.collect() == []


def test_licences_against_search_of_all_places(spark):
    rows = awkward() + [(20, "CC-BY; cc by\nGNU General Public License. All  rights reserved all rights reserved"),
                        (21, "Permission is hereby granted, free of charge, to any person obtaining a copy"), (22, "rights reserved all"), (23, "by cc by cc by"),
                        (24, "redistribution and use in source and binary forms with or just without any modification are permitted provided that the conditions"),
                        (25, "licensed under that apache license version 2 0 apache apache license"), (26, "public license general public license lesser general gnu")]
    for r in licenses.scan(table(spark, rows, extra=CLASH)).collect():
        w = letter_words((r.text or "").encode())
        want = []
        for t, x in enumerate(licenses.BASE + licenses.MORE):
            for k in range(len(w) - len(x.key) + 1):
                if tuple(w[k:k + len(x.key)]) == x.key:
                    same = sum(any(0 <= k - x.at + i + d < len(w) and w[k - x.at + i + d] == v for d in range(-2, 3)) for i, v in enumerate(x.words))
                    want.append((x.label, t, k, same / len(x.words)))
        assert sorted(map(tuple, r.found), key=str) == sorted(want, key=str) and r.n_words == len(w)


@pytest.mark.parametrize("block", [200_000, 7])
def test_contamination_against_all_windows(spark, block):
    bench = [(1, prose(50, 40)), (2, "short item"), (3, None), (4, ""), (None, prose(51, 12)), (5, prose(52, 10)), (5, prose(52, 10)), (6, "the the the the")]
    rows = awkward() + [(30, prose(60, 20) + " " + prose(50, 25) + " , " + prose(61, 9)), (31, "a SHORT, item short item"), (32, prose(52, 9)), (33, prose(52, 10)),
                        (34, "the " * 50), (35, prose(51, 12))]
    items = table(spark, bench).select("doc_id", "text").withColumnRenamed("doc_id", "item_id")
    windows = collections.defaultdict(set)
    for i, text in bench:
        w = letter_words((text or "").encode())
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add(str(i) if i is not None else "null")
    for r in decontam.contamination(table(spark, rows, extra=CLASH), items, block=block).collect():
        w, hit, names = letter_words((r.text or "").encode()), set(), set()
        for key, of in windows.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k:k + len(key)]) == key:
                    hit |= set(range(k, k + len(key)))
                    names |= of
        assert sorted(p for a, b in zip(r.starts, r.ends) for p in range(a, b)) == sorted(hit)
        assert list(r["items"]) == sorted(names) and r.n_words == len(w)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("most", [bpe.DICTIONARY, 3])
def test_bpe_equals_the_library(spark, tiktoken_encoding, most):
    rows = awkward() + [(40, "<|endoftext|> !!!!! !!"), (41, "ab" * 400), (42, "\n" * 700 + " a")]
    got = bpe.decode(bpe.encode(table(spark, rows, extra=CLASH), RANKS, public_tokenizers.PATTERN, most=most), RANKS).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == tiktoken_encoding.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")


def test_fold_and_heap_agree_on_every_byte(spark, tiktoken_encoding):
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 2, 3, 9, 40, 100)] + [b"!!", b"aaaaaaa", bytes(range(256))]
    rows = spark.createDataFrame([(w,) for w in words], "w binary").select("w", bpe.fold(bpe.F.col("w"), RANKS).alias("ids")).collect()
    for r in rows:
        want = tiktoken_encoding._core_bpe.encode_single_piece(bytes(r.w))
        assert list(r.ids) == want == bpe.merged_long(bytes(r.w), RANKS)


def test_bpe_plans_do_not_hold_the_rank_map(spark):
    """Neither as text that the driver keeps nor as a column that rows carry."""
    got = bpe.encode(table(spark, awkward()), RANKS, public_tokenizers.PATTERN, keep_text=False)
    plans = got._jdf.queryExecution()
    assert len(plans.toString()) < 100_000
    assert "_ranks" not in plans.sparkPlan().toString()


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = [x for x in awkward() if x[0] is not None] + [(60, "͸ unassigned"), (61, "word " * 3000)]
    frame = repair.token_files(table(spark, rows, extra=CLASH), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 50_257, 2)
    got = sorted(frame.collect(), key=lambda r: r.start)
    assert [r.key for r in got] == sorted(i for i, _ in rows)
    at = 0
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    for r in got:
        ids = texts[r.key].pop()
        assert (r.start, r.n_tokens, list(r.ids)) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert repair.token_files(table(spark, []), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 50_257, 2).collect() == []


def test_token_files_equal_the_unchanged_library_on_added_tokens(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(1, "<|endoftext|>"), (2, "a  <|endoftext|> b<|endoftext|>\n\n c"), (3, "<|endoftext |> <|endoftext|"), (4, "after"), (5, "x<|endoftext|><|endoftext|>\u0378")]
    got = sorted(repair.token_files(table(spark, rows, extra=CLASH), path, public_tokenizers.PATTERN, 50_257, 2).collect(), key=lambda r: r.start)
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for _, t in rows]
    assert [list(r.ids) for r in got] == want and want[0] == [50_256, 2]
    assert [r.start for r in got] == [sum(map(len, want[:k])) for k in range(len(want))]


@pytest.mark.parametrize("first", [300, 70_000])
def test_grammar_gives_back_any_span(tmp_path, first):
    rng = np.random.default_rng(1)
    sizes = np.array([1, 500, 1, 3000, 7, 2])
    ids = (rng.zipf(1.5, sizes.sum()) % 299).astype(np.int64)
    ids[600:900] = 5
    grammar = repair.compress(ids, sizes, first, rounds=5, most=40, least=2)
    assert len(grammar.rules) and len(grammar.symbols) < len(ids)
    path = tmp_path / "x.rpg"
    path.write_bytes(b"".join(repair.packed([1, None, 3, 4, 5, 6], sizes, grammar)))
    with path.open("rb") as f:
        shard = repair.Shard(f)
        ends = np.cumsum(sizes)
        for i, (end, size) in enumerate(zip(ends, sizes)):
            assert (shard.document(i) == ids[end - size:end]).all()
        for a, b in ((0, 1), (10, 500), (499, 2000), (2999, 3000), (0, 3000)):
            assert (shard.span(3, a, b) == ids[ends[2] + a:ends[2] + b]).all()
        assert [k for k, _ in shard.documents()] == [1, None, 3, 4, 5, 6]


def test_library_takes_many_pieces_a_call(monkeypatch):
    """Pieces in groups get the ids that each gets alone, also with the mark, an added token or letters of any script in them."""
    import tokenizers
    from tessitura.llm import pieces as P

    path, calls = public_tokenizers.path("byte_bpe_50k.json"), []
    real = tokenizers.Tokenizer
    plain = real.from_file(path)

    class Counted:
        def __init__(self, inner):
            object.__setattr__(self, "inner", inner)

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def __setattr__(self, name, value):
            setattr(self.inner, name, value)

        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return self.inner.encode_batch_fast(texts, **options)

    class Files:
        from_file = staticmethod(lambda path: Counted(real.from_file(path)))

    words = [f" {x}{i}" for i in range(150) for x in ("word", "Straße", "слово", "漢字", "\u0378 x", "a b\n\n c ")]
    texts = ["", P.MARK, f"a{P.MARK}b", "<|endoftext|>", "a<|endoftext|> b", "<|", "endoftext", "|>", "'s", "\n", "\r\n\t", "\x1c", "\0", "\u2028 ", *words, "", " "]
    monkeypatch.setattr(tokenizers, "Tokenizer", Files)
    got = P.library_encode(path)(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert sum(calls) < len(texts) / 10
    assert P.library_encode(path)([]) == []


def test_batches_are_joined_whole():
    from tessitura.llm import pieces as P

    rows = [[f"p{i}"] * (i % 4) for i in range(3000)]
    batches = [pa.RecordBatch.from_pydict({"pieces": pa.array(rows[k:k + 50], pa.list_(pa.string()))}) for k in range(0, 3000, 50)]
    for least in (1, 5000, 1 << 30):
        joined = list(P.gathered_batches(iter(batches), least))
        assert [r for b in joined for r in b.column("pieces").to_pylist()] == rows and all(b.nbytes >= least for b in joined[:-1])
    assert len(joined) == 1 and not list(P.gathered_batches(iter([])))


def test_grammar_of_nothing():
    grammar = repair.compress(np.empty(0, np.int64), np.empty(0, np.int64), 10)
    assert len(grammar.symbols) == 0 and hashlib.sha256(b"".join(repair.packed([], np.empty(0, np.int64), grammar)))
