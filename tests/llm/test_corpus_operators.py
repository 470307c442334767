"""Repeats, near-duplicates, archives, shards, language model and the pipeline against plain versions of themselves."""
from __future__ import annotations

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest
import re
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessitura.llm import graph, hmm, sharding, simhash, suffixes, warc
from tessitura.llm.common import blank_words
from tessitura.session import work_folder

from .common import CLASH, awkward, prose, table


def marked_words(rows, later_only):
    """Per (id, text): words inside a 50-word window that occurs elsewhere (or before, in order of id and place)."""
    docs = sorted({(i if i is not None else -(1 << 63), t or "") for i, t in rows}, key=lambda x: x[0])
    where = collections.defaultdict(list)
    for i, t in docs:
        w = blank_words(t.encode())
        for k in range(len(w) - 49):
            where[tuple(w[k:k + 50])].append((i, t, k))
    out = collections.defaultdict(set)
    for places in where.values():
        for i, t, k in (places[1:] if later_only else places if len(places) > 1 else []):
            out[i, t] |= set(range(k, k + 50))
    return out


def passages():
    common, other = prose(90, 70), prose(91, 55)
    rows = [(100 + k, f"{prose(200 + k, 20 + k)} {common} {prose(300 + k, 25)}") for k in range(40)]
    rows += [(200, common), (201, f"{common} {other} {common}"), (202, other + " " + prose(5, 10)), (203, " ".join(common.split()[:49])), (204, "again " * 130),
             (205, prose(6, 300) + " " + prose(8, 400))]
    return rows


@pytest.mark.parametrize("partitions", [1, 7])
def test_repeats_equal_all_windows(spark, partitions):
    rows = awkward() + passages()
    want = marked_words(rows, False)
    got = {}
    for r in suffixes.repeated_spans(table(spark, rows, partitions)).collect():
        got.setdefault(r.doc, []).append(sorted(p for a, b in zip(r.starts, r.ends) for p in range(a, b)))
    by_id = collections.defaultdict(list)
    for (i, _), places in want.items():
        by_id[i].append(sorted(places))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by_id.items()}


def barely_apart(words, changed):
    """Whether, of a text with one changed word and its copy, a matched suffix begins over 50 words after the one matched
    before it, but the first window it is the minimiser of does not."""
    hashes = suffixes.Hashes([w.encode() for w in words])
    places, first = np.unique(hashes.minimisers(), return_index=True)
    met = lambda n: (places + n <= len(words)) & ((places > changed) | (places + n <= changed))
    kept, whole = met(20), met(50)[met(20)]
    places, first = places[kept], first[kept]
    return bool((whole[1:] & whole[:-1] & (places[:-1] <= first[1:]) & (first[1:] - places[:-1] <= 50) & (places[1:] - places[:-1] > 50)).any())


def test_one_changed_word_loses_no_leading_words(spark):
    rng, rows, close = np.random.default_rng(12), [], 0
    for k in range(20_000):
        words, changed = [f"w{x}" for x in rng.integers(0, 50_000, 170)], int(rng.integers(55, 115))
        hit = barely_apart(words, changed)
        close += hit
        if hit or k < 200:
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:changed], "changed", *words[changed + 1:]]))]
        if close == 6:
            break
    assert close
    got = collections.defaultdict(set)
    for r in suffixes.repeated_spans(table(spark, rows)).collect():
        got[r.doc] |= {p for a, b in zip(r.starts, r.ends) for p in range(a, b)}
    assert got == {i: places for (i, _), places in marked_words(rows, False).items()}


def test_cut_texts_keep_one_copy(spark):
    rows = list(dict.fromkeys(x for x in awkward() if x[0] is not None)) + passages()
    # Of equal (id, text) rows and of texts that share an id the order is that of a hash, so ids are unique here.
    seen = set()
    rows = [x for x in rows if not (x[0] in seen or seen.add(x[0]))]
    want = marked_words(rows, True)
    got = {r.doc_id: r for r in suffixes.drop_repeats(table(spark, rows, extra=tuple(c for c in CLASH if c != "cut_words"))).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        gone = want.get((i, t or ""), set())
        assert got[i].cut_words == len(gone)
        if not gone:
            assert got[i].text == t
        else:
            assert got[i].text.encode().lower().split() == [w for k, w in enumerate(blank_words(t.encode())) if k not in gone]
    assert not marked_words([(r.doc_id, r.text) for r in got.values() if r.doc_id != 204], True)
    assert suffixes.drop_repeats(table(spark, [])).collect() == []


def test_every_window_of_a_passage_has_its_minimiser_inside():
    hashes = suffixes.Hashes(blank_words(prose(1, 500).encode()))
    places = hashes.minimisers()
    assert ((places >= np.arange(len(places))) & (places < np.arange(len(places)) + suffixes.GRAMS)).all() and len(set(places)) < len(places) / 8


def plain_fingerprint(words, k):
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_equal_all_pairs(spark):
    rows = [x for x in awkward() if x[0] is not None and x[0] != 8]
    rows += [(300 + k, " ".join(w for j, w in enumerate(prose(70, 900).split()) if j != k * 13)) for k in range(30)]
    rows = list(dict(rows).items())
    prints = {i: plain_fingerprint(blank_words((t or "").encode()), 4) for i, t in rows}
    group = {i: i for i in prints}
    for _ in prints:
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: (r.fp % (1 << 64), r.component) for r in simhash.near_duplicates(table(spark, rows, extra=CLASH)).collect()}
    assert got == {i: (prints[i], group[i]) for i in prints}
    assert len(set(group.values())) < len(group)
    assert simhash.near_duplicates(table(spark, [])).collect() == []


def test_hot_anchors_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3)
    values = {int(b) ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in (0, 1, 2, 3) for _ in range(60)}
    nodes = spark.createDataFrame([(v, [v], 0) for v in values], "node bigint, prints array<bigint>, fine bigint")
    roots = {r.node: r.root for r in graph.components(simhash.links(nodes)).collect()}
    group = {v: v for v in values}
    for _ in range(6):
        for a, b in itertools.combinations(values, 2):
            if (a ^ b).bit_count() <= 4:
                group[a] = group[b] = min(group[a], group[b])
    assert {v: roots.get(v, v) for v in values} == group


def edited_copies():
    """Copies of a few texts with words changed in bunches and apart: similarities on both sides of 0.8, in any number of bits."""
    rng, rows = np.random.default_rng(11), []
    for base in range(12):
        words = prose(800 + base, int(rng.integers(60, 260)), 4000).split()
        for copy in range(9):
            own, edits = list(words), int(rng.integers(1, 3 + len(words) // 30))
            at = rng.choice(len(words), edits, replace=False) if copy % 2 else np.arange(edits) + int(rng.integers(0, len(words) - edits))
            for place in at:
                own[place] = f"edit{base}x{copy}x{place}"
            rows.append((base * 100 + copy, " ".join(own)))
    return rows


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_near_copies_equal_all_similarities(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = edited_copies() + [(2000, None), (2001, ""), (2002, "one two"), (2003, "one two"), (2004, "one two three")]
    sets = {}
    for i, t in rows:
        w = blank_words((t or "").encode())
        sets[i] = {tuple(w[a:a + 5]) for a in range(max(1, len(w) - 4))}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    bits = {i: plain_fingerprint(blank_words((t or "").encode()), 5) for i, t in rows}
    apart = {p: (bits[p[0]] ^ bits[p[1]]).bit_count() for p in like}
    assert any(like[p] >= 0.8 and apart[p] > 12 for p in like) and any(like[p] < 0.8 and apart[p] <= 12 for p in like)
    group = {i: i for i in sets}
    for _ in range(9):
        for (a, b), x in like.items():
            if x >= 0.8:
                group[a] = group[b] = min(group[a], group[b])
    assert {r.doc_id: r.component for r in simhash.near_copies(table(spark, rows, extra=CLASH)).collect()} == group
    assert len(set(group.values())) > 20 and simhash.near_copies(table(spark, [])).collect() == []


def test_anchors_meet_whenever_four_bits_differ():
    rng = np.random.default_rng(4)
    for _ in range(500):
        a = int(rng.integers(0, 1 << 63))
        b = a ^ sum(1 << int(k) for k in rng.choice(63, 4, replace=False))
        block, anchor, row = simhash.replicas(np.array([a, b], np.int64))
        sides = [{(x, y) for x, y, z in zip(block, anchor, row) if z == s} for s in (0, 1)]
        assert sides[0] & sides[1]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 5000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{1000 + k: 1000 for k in range(50)}}


PAGES = [(1, "http://a/ b\r\nX: y", "x" * 1000), (2, None, "x" * 1000), (3, "u", None), (4, "u", ""), (5, "u", "y" * 99), (6, "u", "y" * 99), (7, "u", "é" * 5000),
         (None, "u", "x" * 1000), (0, "u", "é" * 5000), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (9, "u", "z" * 512)]


@pytest.mark.parametrize("chunk", [256, 1 << 18])
def test_archives_give_back_every_payload(spark, chunk):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2)).repartition(3)
    rows = warc.archive_round_trip(pages, chunk).collect()
    first = {}
    for i, _, html in PAGES:
        if len((html or "").encode()) >= 100 and i is not None:
            first[html] = min(first.get(html, i), i)
    got = collections.defaultdict(list)
    for key, part in itertools.groupby(rows, lambda r: r.page_id):
        got[key] += list(part)
    ends = sorted(((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in rows if r["last"]), key=str)
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        known = first.get(html)
        revisit = known is not None and i != known
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", known if revisit else None))
    assert ends == sorted(want, key=str)
    for i, html in ((1, "x" * 1000), (0, "é" * 5000)):
        parts = sorted(got[i], key=lambda r: r.chunk_no)
        assert b"".join(bytes(r.data) for r in parts) == html.encode() and max(r.n_bytes for r in parts) <= chunk
        at = b""
        for r in parts:
            at += bytes(r.data)
            assert r.digest == hashlib.sha256(at).hexdigest() and r.upto_bytes == len(at)
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def test_damaged_archives_are_noticed(spark):
    import gzip
    import io
    import pathlib
    import urllib.parse

    folder = work_folder(spark, "warc-test")
    pages = spark.createDataFrame([(1, "u", "payload " * 50)], "page_id bigint, url string, html string")
    manifest = warc.write_archives(warc.chunk_rows(warc.record_rows(pages)), folder)
    data = gzip.decompress((pathlib.Path(urllib.parse.urlparse(folder).path) / manifest.first()["file"]).read_bytes())
    assert list(warc.record_chunks(io.BytesIO(data), 64, True))
    for broken in (data[:-100], data.replace(b"payload payload", b"payload Payload", 1), b"x" + data):
        with pytest.raises(ValueError):
            list(warc.record_chunks(io.BytesIO(broken), 64, True))


def test_shards_are_shortest_fitting_prefixes(spark):
    rows = [(k, "x" * (k % 90)) for k in range(800)] + [(None, None), (3, "y" * 700), (2000, "z" * 5000)]
    limit = 1500
    got = sharding.shard(table(spark, rows, extra=("n_bytes", "shard", "depth")), "doc_id", F.octet_length("text"), limit).collect()
    assert len(got) == len(rows)
    bits = lambda i: f"{int(hashlib.md5(('null' if i is None else str(i)).encode()).hexdigest()[:15], 16):060b}"
    total = collections.Counter()
    for i, t in rows:
        for d in range(61):
            total[bits(i)[:d]] += len(t or "")
    for r in got:
        fits = [d for d in range(61) if total[bits(r.doc_id)[:d]] <= limit]
        if fits:
            assert (r.shard, r.depth) == (bits(r.doc_id)[:fits[0]] or "-", fits[0])
        else:
            assert r.shard.startswith(bits(r.doc_id)) and r.n_bytes > limit
    assert sharding.shard(table(spark, []), "doc_id", F.octet_length("text"), limit).collect() == []


def test_one_key_over_the_limit_gets_pages(spark):
    rows = [(1, "x" * (1 + k % 40)) for k in range(300)] + [(1, "w" * 900)]
    got = sharding.shard(table(spark, rows, 5), "doc_id", F.octet_length("text"), 200).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.n_bytes
    assert len(got) == len(rows) and all(v <= 200 or v == 900 for v in sizes.values()) and len(sizes) < 100


def plain_forward(model, seq):
    p = sum(model.start[s] * model.emit[seq[0], s] * rest for s in range(len(model.start)) for rest in [tail(model, seq, 1, s)])
    return math.log(p)


def tail(model, seq, k, s):
    return 1.0 if k == len(seq) else sum(model.move[s, u] * model.emit[seq[k], u] * tail(model, seq, k + 1, u) for u in range(len(model.start)))


def test_forward_and_expected_counts_equal_sums_over_all_paths():
    rng = np.random.default_rng(5)
    states, classes = 2, 5
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))
    texts = [rng.integers(0, classes, n).astype(np.uint16) for n in (1, 4, 7, 7, 2)]
    data = [t.tobytes() for t in texts]
    assert np.allclose(hmm.log_likelihoods(model, data), [plain_forward(model, t) for t in texts])
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
    for t in texts:
        paths = list(itertools.product(range(states), repeat=len(t)))
        weights = np.array([model.start[p[0]] * np.prod([model.emit[c, s] for c, s in zip(t, p)]) * np.prod([model.move[a, b] for a, b in zip(p, p[1:])]) for p in paths])
        for p, w in zip(paths, weights / weights.sum()):
            starts[p[0]] += w
            for a, b in zip(p, p[1:]):
                moves[a, b] += w
            for c, s in zip(t, p):
                emits[c, s] += w
    for got, want in zip(hmm.expected_counts(model, data), (starts, moves, emits)):
        assert np.allclose(got, want)


@pytest.mark.parametrize("dictionary", [hmm.DICTIONARY, 20])
def test_scores(spark, dictionary):
    rows = awkward() + [(1000 + k, prose(k % 5 + 40, 60, 30) if k % 2 else prose(k, 50, 3000).upper()) for k in range(120)]
    got = hmm.score_documents(table(spark, rows, extra=CLASH), dictionary=dictionary, own=10).collect()
    assert len(got) == len(rows)
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)})) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(w := tokens(t)), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) and all(r.score < 0 for r in got)


def test_scores_do_not_depend_on_the_dictionary(spark):
    rows = [(k, prose(k, 40, 500)) for k in range(60)]
    a, b = ({r.doc_id: r.score for r in hmm.score_documents(table(spark, rows), dictionary=d, own=5).collect()} for d in (10_000, 30))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)
    assert hmm.score_documents(table(spark, [])).collect() == []


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Each stage by a plain rule on its own input; columns stay, whatever their names."""
    item = prose(77, 30)
    rows = awkward() + passages() + [(400, prose(71, 400)), (401, prose(71, 400) + " tail"), (402, prose(72, 300) + " " + item), (403, item), (404, prose(73, 200))]
    docs = table(spark, rows, extra=CLASH)
    bench = table(spark, [(1, item), (2, None)]).select(F.col("doc_id").alias("item_id"), "text")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    for name, fn in corpus_pipeline.STAGES[:-1]:
        assert fn(spark, docs, str(tmp_path)).schema.names == docs.schema.names, name
        assert fn(spark, docs.limit(0), str(tmp_path)).collect() == []
    kept = {r.doc_id for r in stage["quality_rules"](spark, docs, str(tmp_path)).collect()}
    assert {400, 401, 402, 404} <= kept and not {1, 2, 3, 4, 5, 9, 11, -5} & kept
    apart = collections.Counter(r.doc_id for r in stage["simhash_near_dedup"](spark, docs, str(tmp_path)).collect())
    assert max(n for i, n in apart.items() if i is not None) == 1 and apart[None] == 2 and 400 in apart and 401 not in apart and 404 in apart and 7 not in apart and 6 not in apart and None in apart
    cut = stage["suffix_array_dedup"](spark, docs.filter("doc_id >= 100"), str(tmp_path)).collect()
    assert not marked_words([(r.doc_id, r.text) for r in cut if r.doc_id != 204], True) and all(r.n_chars == len(r.text) for r in cut)
    assert 200 not in {r.doc_id for r in cut} and 404 in {r.doc_id for r in cut}
    clean = {r.doc_id for r in stage["benchmark_decontamination"](spark, docs, str(tmp_path)).collect()}
    assert {i for i, _ in rows} - clean == {402, 403}
    last = stage["byte_level_bpe"](spark, docs, str(tmp_path)).collect()
    texts = collections.Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert collections.Counter(r.decoded_sha256 for r in last) == texts


def test_run_chains_the_stages(spark, tmp_path):
    rows = passages() + [(500 + k, prose(500 + k, 120)) for k in range(10)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, [(1, prose(503, 40))]).select(F.col("doc_id").alias("item_id"), "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {500 + k for k in range(10)} - got == {503} and 204 not in got
