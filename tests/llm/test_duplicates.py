import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import random_text
from waybill.llm import jaccard, repeats

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def repeats_by_force(rows, length):
    seen, out = set(), {}
    for key, text in rows:
        data = (text or "").encode()
        steps = np.zeros(len(data) + 1, np.int64)
        for p in range(len(data) - length + 1):
            s = data[p: p + length]
            if s in seen:
                steps[p] += 1
                steps[p + length] -= 1
            seen.add(s)
        gone = np.cumsum(steps[:-1]) > 0
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[key] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(4)
    shared = [random_text(rng, n) for n in (99, 100, 101, 140, 300)]
    rows = [None, "", "a" * 99, "a" * 100, "a" * 101, "ab" * 400, "a" * 3000 + random_text(rng, 50) + "a" * 300,
            ("xyz" * 30 + "q") * 40, random_text(rng, 60, "ab") * 30]
    for _ in range(50):
        rows.append("".join(rng.choice([random_text(rng, rng.randint(1, 150)), rng.choice(shared), rng.choice(shared)[10:],
                                        rng.choice(shared)[:-15]]) for _ in range(rng.randint(1, 8))))
    return list(enumerate(rows + [rows[20]] * 15))


def test_repeats_against_brute_force(spark, passages, batches):
    docs = spark.createDataFrame(passages, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert got == repeats_by_force(passages, 100)


def test_repeats_split_over_many_buckets(spark, passages):
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        docs = spark.createDataFrame(passages[:40], "doc_id bigint, text string")
        got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {k: v[1] for k, v in repeats_by_force(passages[:40], 100).items()}


def test_blocks_of_a_long_text_do_not_depend_on_pieces():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 110, 20_000).astype(np.uint8)
    whole, cut = repeats.blocks_of(raw, 100), repeats.blocks_of(raw, 100, step=1 << 11)
    assert np.array_equal(whole["first"], cut["first"]) and np.array_equal(whole["whole"], cut["whole"])


def test_multikey_sort_is_a_sort():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 4, 500) for _ in range(4)]
    assert np.array_equal(repeats.multikey_sort(keys), np.lexsort(keys[::-1]))


def test_repeats_of_odd_rows(spark, odd, odd_rows):
    got = repeats.remove_repeats(odd, length=50)
    assert set(odd.columns) - {"text"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[1][0].n_removed == by_id[1][1].n_removed
    assert by_id[8][0].n_removed > 0.9 * by_id[8][0].n_bytes
    assert by_id[2][0].n_bytes == 0 and by_id[3][0].kept_text == ""
    assert repeats.remove_repeats(odd.where("false")).count() == 0


def classes_by_force(rows, n, percent):
    sets = {}
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets[key] = frozenset(tuple(words[i: i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()
    lowest = {k: k for k in sets}

    def find(x):
        while lowest[x] != x:
            x = lowest[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                lowest[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.fixture(scope="module")
def near_copies():
    rng = random.Random(9)
    vocabulary = [random_text(rng, rng.randint(1, 9), "abcdefgh") for _ in range(60)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    rows = [None, "", " \n ", "one", "One", "a b c", "A b  c", "a b c d"]
    for size in (6, 7, 9, 12, 30, 120, 400):
        base = words(size)
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                at = rng.randrange(len(copy))
                copy[at: at + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[at], rng.choice(vocabulary)]])
            rows.append(rng.choice([" ", "\n"]).join(copy))
    rows += [" ".join(words(rng.randint(1, 80))) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 60), (2, 40)])
def test_classes_against_brute_force(spark, near_copies, n, percent):
    docs = spark.createDataFrame(near_copies, "doc_id bigint, text string").repartition(4)
    rows = jaccard.link_texts(docs, n=n, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == classes_by_force(near_copies, n, percent)


def test_classes_when_groups_are_small(spark, near_copies, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_SETS", 3)
    docs = spark.createDataFrame(near_copies, "doc_id bigint, text string")
    rows = jaccard.link_texts(docs, n=4, percent=85, sample_at_least=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == classes_by_force(near_copies, 4, 85)


def test_a_long_chain_is_one_class(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    from waybill.llm.common import Scratch

    got = {r.node: r.component for r in jaccard.connect(edges, Scratch(spark)).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500


def test_classes_of_odd_rows(spark, odd, odd_rows):
    rows = jaccard.link_texts(odd).collect()
    assert len(rows) == len(odd_rows)
    got = {r.doc_id: r.component_id for r in rows}
    assert got[1] == 1 and got[2] == 2 and got[3] == 3 and got[8] == 4
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6] + ([7] if got[7] == 7 else [])
    assert ids.count(None) == 2
    assert jaccard.link_texts(odd.where("false")).count() == 0


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(3)
    for _ in range(50):
        members, asked = np.arange(10, 22), [int(a) for a in rng.choice(np.arange(10, 40), 12, replace=False)]
        hits = [(i, np.flatnonzero(rng.random(12) < 0.15)) for i in range(12)]

        def classes(edges):
            parent = {v: v for v in [*members.tolist(), *asked]}
            for a, b in edges:
                low, high = sorted((parent[a], parent[b]))
                parent = {v: low if p == high else p for v, p in parent.items()}
            return parent

        every = [(asked[i], int(members[m])) for i, hit in hits for m in hit if asked[i] != members[m]]
        some = list(jaccard.forest(members, asked, iter(hits)))
        assert set(some) <= set(every) and classes(some) == classes(every)
        assert len(some) < len(members) + len(asked)
