import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.llm import negatives


@pytest.mark.parametrize("dim,largest", [(1, 3), (64, 256), (64, 40_000), (1500, 5000), (3000, 2_000_000)])
def test_scores_are_exact(dim, largest):
    rng = np.random.default_rng(dim)
    a, b = (rng.integers(-largest, largest + 1, (n, dim)) for n in (7, 9))
    a[0], b[0], b[1] = largest, largest, -largest  # the largest possible scores
    want = np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a])
    bound = dim * largest**2
    assert (negatives.exact_scores(a.astype(np.int32), b.astype(np.int32), bound) == want).all()
    for p in negatives.primes(dim, bound):
        assert (p // 2) ** 2 * min(dim, 1024) < 1 << 24


def brute(rows, n_positive=5, n_negative=10):
    ok = {}
    for key, v, label in rows:
        if key is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        one = (label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        ok[key] = min(ok.get(key, one), one)
    sizes = [len(x) for _, x in ok.values()]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), s))
    ok = {k: r for k, r in ok.items() if len(r[1]) == dim}
    out = []
    for anchor in (k for k in ok if k % 100 == 0):
        score = {k: sum(a * b for a, b in zip(x, ok[anchor][1], strict=True)) for k, (_, x) in ok.items() if k != anchor}
        order = sorted(score, key=lambda k: (-score[k], k))
        for p in [k for k in order if ok[k][0] == ok[anchor][0]][:n_positive]:
            found = [k for k in order if ok[k][0] != ok[anchor][0] and 30 * score[p] <= 100 * score[k] <= 90 * score[p]]
            out += [(anchor, p, i + 1, k, score[p], score[k]) for i, k in enumerate(found[:n_negative])]
    return sorted(out)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(9)
    spread = rng.normal(size=(6, 20))
    rows = [(i, [float(np.float32(x)) for x in spread[i % 6] + rng.normal(size=20) * 0.7], int(rng.integers(0, 4)))
            for i in range(700)]
    rows += [(700 + i, rows[3][1], i % 3) for i in range(150)]  # equal vectors, ties
    rows += [(9000, [0.0] * 20, 1), (9001, None, 1), (9002, [float("nan")] * 20, 1), (9003, [1.0] * 19 + [None], 2),
             (9004, [float("inf")] * 20, 0), (9005, rows[0][1], None), (None, rows[0][1], 1), (9100, [1.0, 2.0], 1), (9200, [], 0),
             (300, rows[300][1], rows[300][2]), (301, rows[7][1], 3)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr(
        "*", "1 AS id", "2 AS x", "3 AS rank", "4 AS ids", "true AS asked", "5 AS positive_id").repartition(5)


def found(df):
    return sorted(tuple(r) for r in df.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("blocks", [(2 << 20, 1 << 17), (2000, 300)])
def test_against_brute_force(spark, points, blocks, batches):
    got = found(negatives.mine(frame(spark, points), F.col("vec_id") % 100 == 0, block_bytes=blocks[0], anchor_bytes=blocks[1]))
    want = brute(points)
    assert want and got == want


def test_without_broadcast(spark, points):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = found(negatives.mine(frame(spark, points), F.col("vec_id") % 100 == 0, block_bytes=3000, anchor_bytes=200))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == brute(points)


def test_nothing_to_mine(spark, points):
    asked = F.col("vec_id") % 100 == 0
    assert negatives.mine(frame(spark, points).where("false"), asked).count() == 0
    assert negatives.mine(frame(spark, points), F.lit(None).cast("boolean")).count() == 0
    assert negatives.mine(frame(spark, [(0, [1.0], 1), (1, [1.0], 2)]), asked).count() == 0  # no positives


def test_scores_beyond_the_range(spark):
    with pytest.raises(ValueError):
        negatives.mine(frame(spark, [(0, [3e7] * 4, 1), (1, [1.0] * 4, 1)]), F.lit(True))
