import hashlib
import math
import random

import pytest
from pyspark.sql import types as T

from docintake.llm.centroids import clustered

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        # names that the operator uses for columns of its own
        *[T.StructField(n, T.StringType()) for n in ("v", "dots", "cluster", "distance", "digest")],
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(i, v, *"abcde") for i, v in rows], SCHEMA)


def brute(rows, k=16, rounds=3, seed=1, dims=64, scale=64):
    """Every distance anew in Python integers."""
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(whole, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
        return [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in whole]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(whole, found, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    of = {n: sum(d for d, c in found if c == n) for n in range(len(centroids))}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, of[c], sum(of.values()), digests[c]) for (i, _), (d, c) in zip(whole, found, strict=True)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_rows(n, seed=4, wide=1.0):
    r = random.Random(seed)
    middles = [[r.gauss(0, 0.2) for _ in range(64)] for _ in range(5)]
    return [(i, [float.fromhex(float(x).hex()) for x in single(r.gauss(m, 0.05) * wide for m in r.choice(middles))]) for i in range(n)]


def single(values):
    """Values that a 32-bit float holds."""
    import numpy as np

    return np.array(list(values), np.float32).astype(float).tolist()


@pytest.mark.parametrize("wide", [1.0, 20_000.0])
def test_against_brute_force(spark, wide):
    rows = random_rows(300, wide=wide)
    assert rows_of(clustered(table(spark, rows))) == sorted(brute(rows), key=str)


def test_hard_rows(spark):
    rows = random_rows(60)
    same = rows[0][1]
    rows += [(1000 + n, same) for n in range(200)]  # one vector makes up most rows
    rows += [(5, rows[7][1]), (5, rows[7][1]), (5, rows[9][1]), (None, rows[3][1]), (None, rows[4][1])]
    bad = [
        (90, None), (91, []), (92, same[:63]), (93, same + [0.0]), (94, same[:63] + [None]), (95, same[:63] + [math.nan]),
        (96, [math.inf] + same[1:]), (97, [-math.inf] + same[1:]),
    ]
    assert rows_of(clustered(table(spark, rows + bad))) == sorted(brute(rows + bad), key=str)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = random_rows(5)
    assert rows_of(clustered(table(spark, rows))) == sorted(brute(rows), key=str)
    assert clustered(table(spark, [])).collect() == []
    assert clustered(table(spark, [(1, None)])).collect() == []


def test_ties_and_other_sizes(spark):
    rows = [(n, [float(n % 3), float(n % 2), 0.0]) for n in range(50)]
    got = rows_of(clustered(table(spark, rows), k=4, rounds=5, seed=7, dims=3, scale=2))
    assert got == sorted(brute(rows, k=4, rounds=5, seed=7, dims=3, scale=2), key=str)


def test_distances_that_fit_no_long(spark):
    rows = random_rows(20)
    huge = [(500, [1e30] * 64), (501, [3e6] * 64)]
    assert rows_of(clustered(table(spark, rows + huge))) == sorted(brute(rows), key=str)
    near = [(n, [2.0**20 * (-1) ** n] * 64) for n in range(40)]
    assert all(r.inertia is None or r.inertia >= 0 for r in clustered(table(spark, near), k=1, rounds=1).collect())
