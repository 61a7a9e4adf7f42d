"""Components, cycles and greedy groups against plain versions."""

from __future__ import annotations

import random

import pytest

from quarry.operators import duplicates, graph


def plain_components(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            for n in nodes:
                if a in reach[n] and b not in reach[n]:
                    reach[n].add(b)
                    moved = True
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("local", [10**6, 0])
def test_strong_components(spark, local):
    rng = random.Random(3)
    edges = [(rng.randint(0, 24), rng.randint(0, 24)) for _ in range(34)] + [(100, 101), (101, 102), (102, 100), (200, 200), (300, 301)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = plain_components(set(edges))
    assert {r.node: r.component for r in graph.strong_components(df, local).collect()} == want
    size = {c: sum(v == c for v in want.values()) for c in want.values()}
    assert {r.node for r in graph.in_cycle(df, local).collect()} == {n for n in want if size[want[n]] > 1 or (n, n) in edges}
    assert graph.strong_components(df.limit(0), local).count() == 0


@pytest.mark.parametrize("local", [10**6, 0])
def test_levels(spark, local):
    edges = [(1, 2), (2, 3), (1, 3), (4, 3), (3, 5), (6, 7), (7, 6), (7, 8), (9, 9), (5, 10)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.level for r in graph.levels(df, local).collect()} == {1: 0, 4: 0, 2: 1, 3: 2, 5: 3, 10: 4}
    assert graph.levels(df.limit(0), local).count() == 0


def test_a_long_ring_stays_linear(spark):
    n = 50000
    ring = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    assert graph.in_cycle(ring).count() == n


def test_leader_groups(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(40)}
    near = {x: {b if a == x else a for a, b in pairs if x in (a, b)} for x in range(30)}
    want, taken = {}, set()
    for x in sorted({n for p in pairs for n in p}):
        if x in taken:
            continue
        want[x] = x
        for y in near[x]:
            if y > x and y not in taken:
                taken.add(y)
                want[y] = x
    got = {r.member: r.leader for r in duplicates.leader_groups(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert got == want


def test_token_windows_merge(spark):
    body = [str(i) for i in range(60)]
    df = spark.createDataFrame([("a", body), ("b", ["x", *body]), ("c", body[:40])], "path string, tokens array<string>")
    windows = duplicates.token_windows(df, ["path"], "tokens", 50)
    assert {(r.path, r.start) for r in windows.collect()} == {("a", i) for i in range(1, 12)} | {("b", i) for i in range(1, 13)}
    merged = duplicates.merged_instances(windows, ["path"], 50).collect()
    assert len(merged) == 22 and {r.tokens for r in merged} == {50}
