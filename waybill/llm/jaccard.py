"""Similarity classes by word n-gram Jaccard, with a token-group matrix.

Two texts link when ``100 * |A and B| >= percent * |A or B|`` over their sets of word n-grams; a class is what links
connect.  Every link between different texts counts, but not every pair has to be formed:

1. Texts with equal sets are one *set*; only its smallest id goes on.
2. Tokens are ordered once for all sets: tokens frequent in a sample last, then longest first, then by hash.  Any order is
   right; this one puts tokens that unrelated texts share by chance at the end.  Different sets that link share at least
   ``matches`` tokens among their first n - ceil(percent n / 100) + matches, for matches up to percent / (100 - percent).
   Only these are indexed, and only tokens of two sets or more are kept.
3. *Groups.*  A token's leader is its smallest set.  A set joins the family of the leader it shares most tokens with, and
   is compared with it; what links to its leader is done within its family.  A family is cut into groups of like size
   with a bounded number of tokens.
4. *Token-group matrix.*  For each group the union of its indexed tokens is stored.  A set that is not linked to its leader
   asks all groups of its family in its size range; any set asks groups of other families in its size range whose union
   holds at least ``matches`` of its indexed tokens.  A group is opened only if the union of its full sets holds percent of the
   asking set; then exact overlaps with all members are counted.  A block of opened group and asking sets gives out a spanning
   forest of its links, which connects the same and has fewer rows than the block has sets.
5. Links are joined to classes by alternating stars.

Tokens are 64-bit hashes of n-grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, map_texts, shingle_hashes, word_hashes, word_spans

#: Most shared indexed tokens asked for.
MOST_MATCHES = 4
#: Ids from here on stand for rows with a null key.
NULL_IDS = 1 << 62
GROUP_SETS, GROUP_TOKENS = 256, 1 << 20


def row_id(key: str, text: str) -> Column:
    """The key, or for a null key a number above all keys that follows from the text."""
    made = F.xxhash64(F.col(f"`{text}`")).bitwiseAND(F.lit(NULL_IDS - 1)) + F.lit(NULL_IDS)
    return F.coalesce(F.col(f"`{key}`").cast("bigint"), made)


def token_set(data: bytes, n: int) -> np.ndarray:
    """The set of a text as sorted hashes."""
    return np.unique(shingle_hashes(word_hashes(data, lower=True), n))


def set_hash(tokens: np.ndarray) -> int:
    """64-bit name of a set (signed)."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def matches(percent: int) -> int:
    """How many indexed tokens two different sets that link share at the least."""
    return min(MOST_MATCHES, least_overlap(percent))


def least_overlap(percent: int) -> int:
    """Fewest common tokens of two different sets that link: c / (c + 1) is the most that c can reach."""
    return max(1, -(-percent // (100 - percent))) if percent < 100 else 1 << 30


def indexed_tokens(data: bytes, n: int, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens (sorted) and those to be indexed, in the common order."""
    starts, ends = word_spans(np.frombuffer(data, np.uint8))
    tokens = shingle_hashes(word_hashes(data, lower=True), n)
    if not len(starts):
        return tokens, tokens
    sizes = np.concatenate(([0], np.cumsum(ends - starts)))
    n = min(n, len(starts))
    length = sizes[n:] - sizes[:-n]
    unique, first = np.unique(tokens, return_index=True)
    m = len(unique)
    if m < least_overlap(percent):  # sets this small only link to equal ones
        return unique, unique[:0]
    late = np.zeros(m, bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, unique), len(frequent) - 1)
        late = frequent[at] == unique
    order = np.lexsort((unique, -length[first], late))
    keep = m + (-percent * m // 100) + matches(percent)
    return unique, unique[order[: min(keep, m)]]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def links(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    return 100 * common >= percent * (a + b - common)


def frequent_tokens(docs: DataFrame, n: int, text: str, sample_rows: int, at_least: int, most: int) -> np.ndarray:
    """Tokens of at least ``at_least`` of at most ``sample_rows`` sampled texts, the ``most`` commonest.

    They only steer the order of tokens, never the result.
    """
    total = docs.count()
    picked = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample_rows / max(total, 1))) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, np.ndarray] = {}
            for t in batch.column(0).to_pylist():
                s = token_set(t, n)
                seen[set_hash(s)] = s
            if seen:
                tokens, counts = np.unique(np.concatenate(list(seen.values())), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

    rows = (
        picked.select(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).mapInArrow(run, "token bigint, n bigint")
        .groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)
        .orderBy(F.desc("n"), "token").limit(most).toPandas())
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def _compare_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (token, set_id): rows of tokens that two sets or more hold, with the token's first set."""
    token = leader = previous = held = None
    for batch in batches:
        c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(c[0]):
            continue
        fresh = np.ones(len(c[0]), bool)
        fresh[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
        fresh[0] = (token, previous) != (c[0][0], c[1][0])
        c = [x[fresh] for x in c]
        if not len(c[0]):
            continue
        new = np.ones(len(c[0]), bool)
        new[1:] = c[0][1:] != c[0][:-1]
        new[0] = token != c[0][0]
        if new[0]:
            held = None
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        first = np.where(group >= 0, c[1][starts[np.maximum(group, 0)]] if len(starts) else 0, 0)
        if not new[0]:
            first[group < 0] = leader
        size = np.bincount(group + 1, minlength=len(starts) + 1)
        several = np.where(group < 0, True, size[group + 1] > 1)
        out = [[x[several] for x in c] + [first[several]]]
        if not new[0] and held is not None:
            out.insert(0, [np.array([v]) for v in (*held, held[1])])
            held = None
        for part in out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=["token", "set_id", "n", "leader"])
        if len(starts):
            i = starts[-1]
            leader = c[1][i]
            held = tuple(x[i] for x in c) if size[-1] == 1 else None
        token, previous = c[0][-1], c[1][-1]


def _body(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _text(body: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(body)


def open_group(members: list[np.ndarray], queries: Iterator[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query whose overlap with the union of the members allows it: its number and the members it links to."""
    sizes = np.array([len(m) for m in members])
    flat = np.concatenate(members)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(members)), sizes)[order]
    union, start, count = np.unique(flat[order], return_index=True, return_counts=True)
    for i, q in enumerate(queries):
        at = np.minimum(np.searchsorted(union, q), len(union) - 1)
        at = at[union[at] == q]
        if 100 * len(at) < percent * len(q):
            continue
        n = count[at]
        where = np.repeat(start[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(owner[where], minlength=len(members))
        yield i, np.flatnonzero(links(common, sizes, len(q), percent))


def forest(members: np.ndarray, asked: list[int], hits: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Of the links between asking sets and members, as many as connect the same: fewer than there are sets in the block.

    ``hits`` gives the number of an asking set and the places of the members it links to.
    """
    tree = np.arange(len(members))
    place = {m: i for i, m in enumerate(members.tolist())}
    for i, hit in hits:
        own = place.get(asked[i])
        trees, first = np.unique(tree[hit], return_index=True)
        for t, at in zip(trees.tolist(), hit[first].tolist(), strict=True):
            if own is None or t != tree[own]:
                yield asked[i], int(members[at])
        if own is not None:
            trees = np.union1d(trees, tree[own])
        if len(trees) > 1:
            tree[np.isin(tree, trees)] = trees[0]


def connect(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node that each node of ``edges (a, b)`` reaches, by alternating stars."""
    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def lowest(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))

    def large_star(e: DataFrame) -> DataFrame:
        two = both(e)
        return two.join(lowest(two).select("a", "m"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        return down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(
            F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.put(edges.select("a", "b").where("a <> b").distinct(), "edges0")
    seen = state(now)
    for i in range(1, most_rounds + 1):
        if not seen[0]:
            break
        now = scratch.put(small_star(large_star(now).where("a <> b").distinct()).distinct(), f"edges{i}")
        scratch.drop(f"edges{i - 1}")
        new = state(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError("classes did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def link_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80,
               sample_rows: int = 4000, sample_at_least: int = 4, most_frequent: int = 100_000) -> DataFrame:
    """``key, n_shingles, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest key reachable by links, the row's own included.  A null text, or one without words,
    has no shingles and links to nothing; neither do null texts to each other.  A text with fewer than ``n`` words is one
    shingle.  Repeated rows are rows of their own and linked, having equal sets; texts that share a key are one node.  A
    null key counts as larger than all others (keys are below 2^62) and is given back as null.  An empty table gives an
    empty result; further columns are ignored.
    """
    out = classes_by_id(docs.select(row_id(key, text).alias("id"), F.col(f"`{text}`").alias("text")), n, percent,
                        sample_rows, sample_at_least, most_frequent)
    return out.select(*[F.when(F.col(a) < NULL_IDS, F.col(a)).alias(b) for a, b in (
        ("id", key), ("n_shingles", "n_shingles"), ("component_id", "component_id"))])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose key names their class; of rows that share a key one stays."""
    narrow = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_id(key, text).alias("id"))
    classes = classes_by_id(docs.select(row_id(key, text).alias("id"), F.col(f"`{text}`").alias("text")), n, percent)
    kept = narrow.join(classes.where("id = component_id").select("id").distinct(), "id", "left_semi")
    if not narrow.groupBy("id").count().where("count > 1").isEmpty():
        kept = kept.groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*")


def classes_by_id(base: DataFrame, n: int, percent: int, sample_rows: int = 4000, sample_at_least: int = 4,
                  most_frequent: int = 100_000) -> DataFrame:
    """``id, n_shingles, component_id`` for every row of ``base (id, text)``."""
    spark = base.sparkSession
    scratch = Scratch(spark)

    def name_sets(keys: list, texts: list[bytes]) -> dict:
        sets = [token_set(t, n) for t in texts]
        return {"id": keys, "n": [len(s) for s in sets], "set_id": [set_hash(s) for s in sets]}

    named = scratch.put(map_texts(base, name_sets, "id bigint, n int, set_id bigint", "id"), "sets")
    first = named.where("n > 0").groupBy("set_id").agg(F.min("id").alias("rep"), F.first("n").alias("n"))

    shared = spark.sparkContext.broadcast(frequent_tokens(base, n, "text", sample_rows, sample_at_least, most_frequent))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, out = set(), []
            for t in batch.column(0).to_pylist():
                tokens, some = indexed_tokens(t, n, percent, shared.value)
                if len(some) and (name := set_hash(tokens)) not in seen:
                    seen.add(name)
                    out.append((some.view(np.int64), np.full(len(some), name), np.full(len(some), len(tokens), np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                                 names=["token", "set_id", "n"])

    binary = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    postings = base.select(binary).mapInArrow(index, "token bigint, set_id bigint, n int")
    lists = scratch.put(
        postings.repartition("token").sortWithinPartitions("token", "set_id").mapInArrow(
            _compare_lists, "token bigint, set_id bigint, n int, leader bigint"), "lists")

    # Families: the leader a set shares most tokens with; sets without one are families of their own.
    votes = lists.where("set_id <> leader").groupBy("set_id", "leader").agg(F.count("*").alias("c")).where(
        F.col("c") >= matches(percent))
    joined = votes.groupBy("set_id").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("leader"))
    sizes = lists.groupBy("set_id").agg(F.first("n").alias("n"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.05)))).cast("int").alias("band")
    families = sizes.join(joined, "set_id", "left").select(
        "set_id", "n", "leader", F.coalesce("leader", "set_id").alias("family"), band)
    families = scratch.put(families, "families")
    counts = families.groupBy("family", "band").agg(F.count("*").alias("in_band"), F.max("n").alias("top"))
    whole = families.groupBy("family").agg(F.count("*").alias("in_family"))
    room = F.greatest(F.lit(1), F.least(F.lit(GROUP_SETS), F.floor(F.lit(GROUP_TOKENS) / F.col("top"))))
    placed = scratch.put(
        families.join(counts, ["family", "band"]).join(whole, "family").select(
            "set_id", "n", "leader", "family", "band", "in_family",
            F.pmod(F.xxhash64("set_id"), F.ceil(F.col("in_band") / room)).cast("int").alias("chunk")), "placed")
    group = F.xxhash64("family", "band", "chunk").alias("grp")

    # Other families: the token-group matrix, asked by the smaller family.
    rows = lists.select("token", "set_id").join(placed, "set_id")
    matrix = rows.select("token", "family", "in_family", "band", group).distinct()
    asking = rows.select("token", "set_id", F.col("n").alias("qn"), F.col("family").alias("qf"), F.col("in_family").alias("qs"),
                         F.col("band").alias("qband"))
    reach = int(np.ceil(np.log(100 / percent) / np.log(1.05))) + 1
    other = (
        asking.join(matrix, "token")
        .where((F.col("qf") != F.col("family")) & (F.abs(F.col("qband") - F.col("band")) <= reach)
               & (F.struct("qs", "qf") < F.struct("in_family", "family")))
        .groupBy("set_id", "grp").agg(F.count("*").alias("c")).where(F.col("c") >= matches(percent)).select("set_id", "grp"))
    other = scratch.put(other, "other")

    # Texts that are needed at all, once, by set.
    stars = placed.where("leader IS NOT NULL").select("set_id", "leader")
    groups = placed.select(group, "set_id")
    needed = (
        stars.select("set_id").unionByName(stars.select(F.col("leader").alias("set_id"))).unionByName(other.select("set_id"))
        .unionByName(groups.join(other.select("grp").distinct(), "grp", "left_semi").select("set_id")).distinct())
    wanted = first.join(needed, "set_id", "left_semi").select("set_id", F.col("rep").alias("id"))

    def compress(keys: list, texts: list[bytes]) -> dict:
        return {"id": keys, "body": [_body(t) for t in texts]}

    bodies = map_texts(base, compress, "id bigint, body binary", "id")
    # an id may stand for several texts: the set tells which
    again = bodies.join(wanted, "id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [set_hash(token_set(_text(b), n)) == s for s, b in zip(
                batch.column("set_id").to_pylist(), batch.column("body").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    texts = scratch.put(again.select("set_id", "body").mapInArrow(check, "set_id bigint, body binary")
                        .dropDuplicates(["set_id"]), "texts")

    # Stars: every set against its leader.
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([token_set(_text(b), n) for b in batch.column(i).to_pylist()] for i in (2, 3))
            ok = [bool(links(overlap(x, y), len(x), len(y), percent)) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())],
                                             names=["set_id", "leader", "linked"])

    pairs = stars.join(texts, "set_id").join(
        texts.select(F.col("set_id").alias("leader"), F.col("body").alias("leader_body")), "leader")
    starred = scratch.put(pairs.select("set_id", "leader", "body", "leader_body").mapInArrow(
        compare, "set_id bigint, leader bigint, linked boolean"), "stars")

    # Sets without a link to their leader ask all groups of their family in reach.
    lonely = placed.join(starred.where(~F.col("linked")).select("set_id"), "set_id", "left_semi").select(
        "set_id", "family", F.col("band").alias("qband"))
    own = lonely.join(placed.select("family", "band", group).distinct(), "family").where(
        F.abs(F.col("qband") - F.col("band")) <= reach).select("set_id", "grp")
    asks = own.unionByName(other).distinct().withColumn("salt", F.lit(0))
    load = asks.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(1000)).cast("int").alias("salts"))
    asks = asks.drop("salt").join(load, "grp").select("grp", "set_id", F.pmod(
        F.xxhash64("set_id"), F.col("salts")).cast("int").alias("salt"))
    held = groups.join(load, "grp").select("grp", "set_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    left = held.join(texts, "set_id").select("grp", "salt", F.col("set_id").alias("member"), "body")
    right = asks.join(texts.withColumnRenamed("set_id", "asker"), F.col("set_id") == F.col("asker")).select(
        F.col("grp").alias("grp2"), F.col("salt").alias("salt2"), "asker", F.col("body").alias("body2"))

    def open_one(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"a": [], "b": []}
        if len(members) and len(queries):
            ids = members["member"].to_numpy(np.int64)
            asked = queries["asker"].tolist()
            sets = [token_set(_text(b), n) for b in members["body"]]
            hits = open_group(sets, (token_set(_text(b), n) for b in queries["body2"]), percent)
            for a, b in forest(ids, asked, hits):
                out["a"].append(a)
                out["b"].append(b)
        return pd.DataFrame(out, dtype="int64")

    opened = scratch.put(left.groupBy("grp", "salt").cogroup(right.groupBy("grp2", "salt2")).applyInPandas(
        open_one, "a bigint, b bigint"), "opened")

    found = opened.unionByName(starred.where("linked").select(F.col("set_id").alias("a"), F.col("leader").alias("b")))
    reps = first.select("set_id", "rep")
    edges = (
        found.join(reps.withColumnsRenamed({"set_id": "a", "rep": "ra"}), "a")
        .join(reps.withColumnsRenamed({"set_id": "b", "rep": "rb"}), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    classes = connect(edges, scratch)
    by_set = first.join(classes, first["rep"] == classes["node"], "left").select(
        "set_id", F.coalesce("component", "rep").alias("component_id"))
    return named.join(by_set, "set_id", "left").select(
        "id", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
