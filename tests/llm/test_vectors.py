import numpy as np
import pytest

from waybill.llm import vectors


def exact(rows, k):
    ok = {}
    for key, v in rows:
        if key is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[key] = np.array(v, float)
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        score = (x * ok[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), float(score[i])) for i in order]
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=24)]) for i in range(600)]
    rows += [(600 + i, rows[3][1]) for i in range(80)]
    bad = [(700, None), (701, [0.0] * 24), (702, [float("nan")] * 24), (703, [1.0] * 23 + [None]), (704, [float("inf")] * 24),
           (None, rows[0][1]), (720, [])]
    return rows + bad


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "2 AS x", "3 AS list")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_all_lists_probed_is_exact(spark, points, batches):
    df = frame(spark, points)
    got = found(vectors.search(df, df.where("vec_id % 20 = 0"), k=20, list_rows=100, block_rows=64, sure=8.0))
    want = exact(points, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (_, a), (_, b) in zip(got[q], want[q], strict=True))


def test_recall_when_probing_few_lists(spark, points):
    df = frame(spark, points)
    got = found(vectors.search(df, df.where("vec_id % 20 = 0"), k=20, list_rows=60, min_probes=8))
    want = exact(points, 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q, centre = rng.normal(size=(2000, 64)), rng.normal(size=(20, 64)), rng.normal(size=64) * 0.1
    turn = vectors.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    about, width = vectors.estimate(q, *vectors.encode(x, centre, turn), centre, turn, 3.0)
    assert (np.abs(about - q @ x.T) <= width).mean() > 0.99


def test_fewer_candidates_than_asked(spark):
    rows = [(i, [1.0, float(i)]) for i in (0, 20, 21)]
    df = frame(spark, rows)
    assert {q: len(v) for q, v in found(vectors.search(df, df.where("vec_id % 20 = 0"))).items()} == {0: 2, 20: 2}
    assert vectors.search(df.where("false"), df.where("false")).count() == 0
