"""Clustering in whole numbers against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

from landmatch.llm import lloyd

SCHEMA = "vec_id long, embedding array<double>, cluster string, id string"


def plain(rows, k, rounds, dimensions, scale):
    kept = [(i, v) for i, v, *_ in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[int(x) * scale if abs(x) >= 2**60 else math.floor(x * scale) for x in v] for _, v in kept]
    digest = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    order = sorted(range(len(kept)), key=lambda j: (digest(kept[j][0]), kept[j][1]))
    centroids = [whole[j] for j in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(q)[1] for q in whole]
        for c in set(of):
            mine = [q for q, o in zip(whole, of, strict=True) if o == c]
            centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [near(q) for q in whole]
    fits = lambda x: x if x < 1 << 63 else None
    inertia = {c: sum(d for d, o in last if o == c) for _, c in last}
    return sorted(((i, c, fits(d), fits(inertia[c]), fits(sum(inertia.values())), ",".join(map(str, centroids[c]))) for (i, _), (d, c) in zip(kept, last, strict=True)), key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted((tuple(r) for r in lloyd.cluster(df, **options).collect()), key=repr)


@pytest.mark.parametrize("wide", [1.0, 1e7, 1e30])
def test_against_plain_python(spark, wide):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * (wide if rng.random() < 0.3 else 1) for _ in range(4)], "x", "y") for i in range(200)]
    rows += [(3, rows[3][1], "x", "y")] * 2  # repeated
    rows += [(1000, None, "", ""), (1001, [1.0, None, 2.0, 3.0], "", ""), (1002, [1.0, 2.0], "", ""), (1003, [float("nan"), 1.0, 1.0, 1.0], "", ""), (1004, [float("inf"), 1.0, 1.0, 1.0], "", ""), (None, [0.5, 0.5, 0.5, 0.5], "", "")]
    options = {"k": 7, "rounds": 3, "dimensions": 4, "scale": 64}
    assert found(spark, rows, **options) == plain(rows, **options)


def test_ties_few_vectors_and_none(spark):
    options = {"k": 5, "rounds": 2, "dimensions": 2, "scale": 1}
    same = [(i, [1.0, 2.0], "", "") for i in range(6)]
    got = found(spark, same, **options)
    assert got == plain(same, **options)
    assert {r[1] for r in got} == {0}
    two = [(1, [0.0, 0.0], "", ""), (2, [4.0, 0.0], "", "")]
    assert found(spark, two, **options) == plain(two, **options)
    assert found(spark, [], **options) == []


def test_limbs_add_up():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.randrange(-(2 ** rng.randrange(1, 200)), 2 ** rng.randrange(1, 200))
        assert sum(v << lloyd.LIMB * k for k, v in enumerate(lloyd.limbs(x))) == x
        assert all(abs(v) <= 1 << lloyd.LIMB for v in lloyd.limbs(x))
