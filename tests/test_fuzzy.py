"""Near names against the distances of all pairs."""

from __future__ import annotations

import random

from quarry.operators import joins


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_near_names_are_all_found(spark):
    rng = random.Random(9)
    names = {"".join(rng.choice("abcd_") for _ in range(rng.randint(1, 14))) for _ in range(60)}
    for n in list(names):
        for _ in range(3):
            own = list(n)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
            names.add("".join(own))
    rows = spark.createDataFrame([(n,) for n in sorted(names)], "n string")
    found = {(r.n, r.c): r.distance for r in joins.fuzzy_pairs(rows, rows.withColumnRenamed("n", "c"), "n", "c").collect()}
    want = {(a, b): d for a in names for b in names if 1 <= (d := distance(a, b)) <= 3 and min(len(a), len(b)) >= 1}
    lost = {p for p in want if p not in found and min(map(len, p)) > 3}
    assert not lost and all(want[p] == d for p, d in found.items() if p in want)
