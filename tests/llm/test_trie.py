import hashlib
import random
import re
import zlib

import pytest

from waybill.llm import trie


def turns_of(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn, role or "", text or ""))

    def place(t):  # null first; ties by the digest of the turn
        return (t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest())

    return {c: [(r, x) for _, r, x in sorted(ts, key=place)] for c, ts in out.items()}


def rebuilt(turns):
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def brute(convs):
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = set()
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        words = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(node)))
        out.add((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), len(leaves), words,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "1 AS node", "2 AS shard", "'x' AS digest", "3 AS position", "4 AS words", "5 AS h").repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "d  e\tf", "", None, "ü x y"]))
            for c in rng.sample(range(-60, 200), 150) for t in range(rng.randint(1, 5))]
    rows += [(c, 0, "user", "the one that all say") for c in range(300, 400)]  # a hot turn
    rows += [(c, t, "user", "a b") for c in range(400, 440) for t in range(6)]  # copies
    rows += [(7001, t, "r", f"w {t % 3}") for t in range(300)]  # a long one
    rows += [(None, 0, "user", "x"), (8000, None, "user", "no number"), (8000, 0, None, None), (8000, 0, None, None),
             (8001, 1, "a", "tie one"), (8001, 1, "b", "tie two"), (8002, 0, "user:", "x"), (8003, 0, "user", ":x"),
             (8004, 0, "user", "long " * 60_000)]
    return rows


@pytest.mark.parametrize("shard", [(1, 10), (7, 1000), (2048, 65_536)])
def test_trie_against_brute_force(spark, rows, shard, batches):
    turns = trie.ordered_turns(frame(spark, rows))
    ones = turns.unionByName(turns.selectExpr("conv_id", "0L AS position", "NULL AS digest", "0L AS words").distinct())
    got = [tuple(r) for r in trie.prefix_trie(ones, *shard).collect()]
    want = brute(turns_of(rows))
    assert len(got) == len(want) and set(got) == want


def test_rebuilt_conversations(spark, rows):
    got = [tuple(r) for r in trie.prefix_trie(trie.branched(trie.ordered_turns(frame(spark, rows))), 16, 300).collect()]
    want = brute(rebuilt(turns_of(rows)))
    assert len(got) == len(want) and set(got) == want


def test_empty(spark, rows):
    empty = frame(spark, rows).where("false")
    assert trie.prefix_trie(trie.branched(trie.ordered_turns(empty))).count() == 0
    assert trie.prefix_trie(trie.branched(trie.ordered_turns(frame(spark, [(None, 1, "a", "b")])))).count() == 0
    only = trie.prefix_trie(trie.branched(trie.ordered_turns(frame(spark, [(1, 0, None, None)])))).collect()
    assert [r.depth for r in only] == [0]  # its first three turns are those of conversation 0, which is not there
