"""Greedy cover of runs against a plain loop over sets."""
import random

import pytest

from tessitura.operators import coverage as V


def made(seed):
    """Shares of symbols per run, three tables; some runs hold nothing new, one has no pairs at all."""
    rng, tables = random.Random(seed), []
    for name, alphabet in (("types", "abcdefghij"), ("pairs", ["ab", "bc", "cd", "de", "ef", "gh"]), ("marks", "123")):
        rows = {}
        for run in range(6):
            own = [s for s in alphabet if rng.random() < (0.3 if run % 2 else 0.7)] if not (run == 3 and name == "pairs") else []
            weights = [rng.randint(1, 9) for _ in own]
            rows[f"r{run}"] = {s: w / sum(weights) for s, w in zip(own, weights)}
        tables.append(rows)
    return tables


def plain(tables, objective):
    runs = [r for r in tables[0] if tables[0][r]]
    mass = [{s: sum(t[r].get(s, 0.0) for r in runs) / len(runs) for r in runs for s in t[r]} for t in tables]
    covered, out = [set(), set(), set()], []
    while len(out) < len(runs):
        def worth(r):
            new = set(tables[0][r]) - covered[0]
            own, pair = round(sum(mass[0][s] for s in new), 12), round(sum(mass[1][s] for s in set(tables[1][r]) - covered[1]), 12)
            return (len(new), own, pair, r) if objective == "types" else (own, len(new), pair, r)
        best = max((r for r in runs if r not in [x[0] for x in out]), key=worth)
        before = [len(c) for c in covered]
        for c, t in zip(covered, tables):
            c |= set(t[best])
        out.append((best, [(len(c) - b, len(c) / len(m) if m else None, sum(m[s] for s in c)) for c, b, m in zip(covered, before, mass)]))
    return out


@pytest.mark.parametrize("seed,objective", [(1, "types"), (1, "mass"), (2, "types"), (5, "mass")])
def test_greedy_cover_equals_a_plain_loop(spark, seed, objective):
    tables = made(seed)
    frames = [spark.createDataFrame([(r, s, x) for r, own in t.items() for s, x in own.items()], "run string, symbol string, share double").repartition(3) for t in tables]
    steps = V.greedy_cover(*frames, objective)
    got, want = sorted(steps.collect(), key=lambda r: r["k"]), plain(tables, objective)
    assert [(r["k"], r["run"]) for r in got] == [(k, run) for k, (run, _) in enumerate(want, 1)]
    for r, (_, parts) in zip(got, want):
        for name, (new, share, mass) in zip(("types", "pairs", "marks"), parts):
            assert (r[f"new_{name}"], r[f"{name}_cov"], r[f"{name}_mass_cov"]) == (new, pytest.approx(share), pytest.approx(mass))
    reached = {r["threshold"]: r["k"] for r in V.steps_to_reach(steps, "types_cov", (0.5, 0.9, 1.0)).collect()}
    assert reached == {t: next(k for k, (_, p) in enumerate(want, 1) if p[0][1] >= t - 1e-12) for t in (0.5, 0.9, 1.0)}
