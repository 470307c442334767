"""Url rules, the filter audit and source divergences against plain versions of themselves."""
from __future__ import annotations

import collections
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessitura.llm import associations, divergence, interactions
from tessitura.llm.common import blank_words

from .common import SCHEMA, awkward, prose, table

RULES = [associations.Rule("block", "net/"), associations.Rule("allow", "example.net/en/"), associations.Rule("block", "example.com/de/"),
         associations.Rule("allow", "org/fr/")]
URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "https://A.EXAMPLE.Net/en/1?x=1#y", "https://a.example.net/EN/1", "ftp://b.example.com/de/",
        "http://xnet/de/", "http://org/fr/?#", "http://a..b.org/fr/a//b///12", "x://y://net/de/", "http://h?q=1&q=2&=3&r", "http://u#f?x", "http://é.org/fr/ü"]


def made_urls(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [f"http://{rng.choice(['a.', 'b.', 'farm.', ''])}example.{rng.choice(['net', 'com', 'org', 'net'])}/{rng.choice(['en', 'de', 'fr'])}/"
            f"{rng.randint(0, 99)}{rng.choice(['', '?ref=x&page=2', '#top', '/', '/farm/9.html'])}" for _ in range(n)]


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path, query = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest).groups()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    tokens = {f"host:{x}" for x in host.split(".") if x} | {"path:" + re.sub("[0-9]+", "#", x) for x in path.split("/") if x}
    return host, path, tokens | {f"query:{x.split('=')[0]}" for x in (query or "").split("&") if x.split("=")[0]}


def listed(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.where), default=None)


def mined(labelled, support, confidence):
    least, n, said = max(1, math.ceil(support * len(labelled))), collections.Counter(), collections.Counter()
    for tokens, verdict in labelled:
        for k in range(1, len(tokens) + 1):
            for c in itertools.combinations(sorted(tokens), k):
                n[c] += 1
                said[c, verdict] += 1
    return sorted((-m / n[c], -m, len(c), " ".join(c), v, set(c)) for (c, v), m in said.items() if m >= least and m / n[c] >= confidence)


@pytest.mark.parametrize("support,confidence,partitions", [(0.02, 0.9, 1), (0.1, 0.6, 5)])
def test_urls_equal_all_rules(spark, support, confidence, partitions):
    urls = URLS + made_urls(3, 150) + URLS[4:8] * 3
    rows = [(k // 2, u, f"own {k}", "own") for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, other string, verdict string").repartition(partitions)
    got = associations.judge(pages, RULES, mining=associations.Mining(support, confidence)).collect()
    judged = [(*parts(u), listed(*parts(u)[:2])) for u in urls]
    rules = mined([(t, r.verdict) for *_, t, r in judged if r], support, confidence)
    want = []
    for (page, u, other, _), (host, path, tokens, rule) in zip(rows, judged):
        best = next((r for r in rules if r[5] <= tokens), None) if rule is None else None
        want.append((page, u or "", other, host, path, rule.where if rule else None, rule.verdict if rule else best[4] if best else "allow", best[3] if best else None))
    assert sorted((r.page_id, r.url or "", r.other, r.host, r.path, r.rule, r.verdict, r.mined) for r in got) == sorted(want, key=lambda x: x[:3])
    assert any(w[7] for w in want) and {w[6] for w in want if w[7]} == {"block", "allow"}


def test_labels_of_ones_own_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://bad.x/"), (2, "http://good.x/"), (3, None)], "page_id long, url string")
    labels = spark.createDataFrame([("http://bad.y/", "block"), ("http://good.z/q", "allow"), ("http://bad.z/", "block"), ("http://good.z/", "unsure")], "url string, verdict string")
    got = {r.page_id: (r.verdict, r.mined) for r in associations.judge(pages, [], labels).collect()}
    assert got == {1: ("block", "host:bad"), 2: ("allow", "host:good"), 3: ("allow", None)}
    assert [r.verdict for r in associations.judge(pages, [], labels.limit(0)).collect()] == ["allow"] * 3
    assert associations.judge(pages.limit(0), RULES).count() == 0
    with pytest.raises(ValueError):
        associations.judge(pages.drop("url"), RULES)


def plain_mask(text):
    words = blank_words(None) if not text else re.findall(r"[^\x20\x09-\x0D]+", text)
    return ((len(words) < 200) + 2 * (100 * len(set(words)) < 50 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text or "")) > 2 * len(text or ""))
            + 8 * bool(re.search(r"[#$%&*|]", text or "")))


def plain_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    cells = collections.Counter()
    for i, t, s in docs:
        good, toxic = any(q == 1 for d, q, _ in labels if d == i and i is not None), any(x == 1 for d, _, x in labels if d == i and i is not None)
        cells[s or "", plain_mask(t) + 16 * (i is not None and i > first[t or ""]), good, toxic] += 1
    out = {}
    for part in {p for p, *_ in cells}:
        mine, removed_by = {k[1:]: n for k, n in cells.items() if k[0] == part}, collections.Counter()
        for order in itertools.permutations("ABCDE"):
            gone = 0
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                here = {k: n for k, n in mine.items() if k[0] & bit and not k[0] & gone}
                out[part, "".join(order), step] = [
                    sum(n for k, n in mine.items() if not k[0] & (gone | bit)), sum(here.values()),
                    sum(n for k, n in mine.items() if k[0] & bit and k[0] & gone), sum(n for k, n in mine.items() if k[0] == bit),
                    sum(n for k, n in here.items() if k[1]), sum(n for k, n in here.items() if k[2])]
                removed_by[f] += sum(here.values())
                gone |= bit
        for (p, order, step), values in out.items():
            if p == part:
                values.append(removed_by[order[step - 1]])
    return out


def audit_cases():
    rng = random.Random(4)
    texts = [prose(50 + k, rng.choice([10, 220, 400]), rng.choice([30, 400])) + rng.choice(["", " $", " ABCDEFGHIJKLMNOPQR" * 9]) for k in range(14)] + ["", None]
    docs = [(900 - k, rng.choice(texts), rng.choice(["s", "hot", "hot", None])) for k in range(160)]
    docs += [(i, t, f"s{k % 2}") for k, (i, t) in enumerate(awkward())] + [(None, texts[0], "s"), (None, texts[0], "hot"), (3, texts[1], "hot"), (3, texts[1], "s"), (3, texts[1], "s")]
    labels = [(i, rng.randint(0, 1), rng.choice([0, 0, 1, None])) for i in range(700, 860)] + [(800, 0, 0), (800, 1, 1), (None, 1, 1), (3, 1, 0)]
    return docs, labels


@pytest.mark.parametrize("files,batches", [(6, 3), (1, 4), (6, 6)])
def test_audit_equals_all_orders(spark, tmp_path, files, batches):
    docs, labels = audit_cases()
    path = str(tmp_path / "documents.parquet")
    for k in range(files):
        kind = "doc_id long, text string, source string, mask string, part string, digest string"
        part = spark.createDataFrame([(*d, "own", "own", "own") for d in docs[k::files]], kind)
        part.coalesce(1).write.mode("append").parquet(path)
    deltas = interactions.audit_stream(spark, path, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), batches)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in interactions.audit(deltas).collect()}
    assert got == plain_audit(docs, labels)
    assert files == 1 or deltas.agg(F.sum("retracted")).first()[0] > 0


def test_audit_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(interactions.audit_stream(spark, str(tmp_path / "documents.parquet"), labels)).count() == 0


def plain_divergence(docs, least):
    words = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    have, count, whole, groups = collections.Counter(), collections.Counter(), collections.Counter(), {(g or "", s or "") for _, g, s in docs}
    for t, lang, source in docs:
        for w, n in collections.Counter(words(t)).items():
            have[lang or "", w] += 1
            count[lang or "", source or "", w] += n
            whole[lang or "", w] += n
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for (g, w), n in have.items() if g == lang and n >= least]
        share = lambda n: {w: 1 + 10**9 * (n(w) + 2) // (sum(map(n, kept)) + 2 * len(kept)) for w in kept}
        q, mine = share(lambda w: whole[lang, w]), sorted(s for g, s in groups if g == lang)
        p = {s: share(lambda w, s=s: count[lang, s, w]) for s in mine}
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pair = [(o, sum(apart(p[s][w], p[o][w]) for w in kept)) for o in mine if o != s]
            term = [(w, apart(p[s][w], q[w])) for w in kept if count[lang, s, w] and p[s][w] > q[w]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= 10]
    return sorted(out)


@pytest.mark.parametrize("groups_of,terms_of,least", [(2, 3, 2), (1, 4096, 3), (32, 7, 2), (32, 4096, 500)])
def test_divergence_equals_all_pairs(spark, groups_of, terms_of, least):
    rng = random.Random(groups_of)
    docs = [(rng.choice(["", None, "A a Ünï日 a", prose(rng.randint(0, 9), rng.randint(1, 60), 40)]), rng.choice(["x", "y", "y", None, "lone"]), rng.choice(["hot", "hot", "b", "c", "é", None]))
            for _ in range(90)]
    docs += [("solitary words", "one", "only"), (None, "mute", "a"), ("", "mute", "b"), ("w" * 5000, "x", "hot"), ("w" * 5000, "x", "b")]
    df = spark.createDataFrame([(*d, "own", "own") for d in docs], "text string, lang string, source string, n string, value string").repartition(3)
    got = sorted(map(tuple, divergence.audit(df, least, groups_of, terms_of).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == plain_divergence(docs, least)


def test_divergence_of_no_rows_and_shares(spark):
    assert divergence.audit(table(spark, []).limit(0)).count() == 0
    rng = random.Random(1)
    cases = [(n := rng.randint(0, 10**rng.randint(1, 15)), max(2 * n + 4, rng.randint(1, 9 * 10**15))) for _ in range(200)]
    df = spark.createDataFrame(cases, "n long, size long").select("*", divergence.share(F.col("n"), F.col("size")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.n + 2) // r["size"] for r in df.collect())
