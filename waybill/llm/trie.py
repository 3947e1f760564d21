"""Trie of conversation prefixes by vertical bitmaps.

A node is a distinct sequence of first turns; its members are the conversations that start with it.  Conversations are
sorted by id and cut into shards of consecutive ones.  A shard indexes every (position, turn) by the bitset of the
conversations that have this turn there.  Going down depth first, the bitset of a node intersected with the postings of
the next position gives its children; popcounts give the members, and the members that have no further turn end there.

Shards are joined by the digest of a node's turns.  A node is owned by the shard of its smallest member.  Every
conversation below a node passes through it, so the owner of a node also knows all nodes above: sums over a subtree are
sums of each shard's own nodes over intervals of its depth-first order, added up by node.  The number of steps does not
depend on the depth, and a prefix shared by a third of all conversations is one row for each shard.

Turns are compared by the SHA-256 of role and text, prefixes by a 128-bit chain of these; texts never leave the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

_ROOT = bytes(16)
_LOCAL = ("shard bigint, at bigint, stop bigint, parent_at bigint, node binary, depth bigint, words bigint, conv_id bigint, "
          "n bigint, inner boolean, ends string")


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; nulls are empty, and the length of the role keeps role and text apart."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """``conv_id, position, digest, words`` of every turn, positions from 1.

    Null turn numbers come first; equal ones are ordered by the digest of the turn.  Rows without a conversation take no
    part; repeated rows are turns of their own.
    """
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"),
        turn_digest(F.col(role), F.col(text)).alias("digest"), word_count(F.col(text)).alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("bigint").alias("position"), "digest", "words")


def shard_nodes(convs: list[int], turns: list[list[tuple[bytes, int]]]) -> dict[str, list]:
    """The nodes of one shard in depth-first order; ``convs`` ascend, ``turns`` are their digests and words."""
    postings: dict[tuple[int, bytes], int] = {}
    lengths: dict[int, int] = {}
    for i, own in enumerate(turns):
        bit = 1 << i
        for at, (digest, _) in enumerate(own):
            postings[at, digest] = postings.get((at, digest), 0) | bit
        lengths[len(own)] = lengths.get(len(own), 0) | bit
    out: dict[str, list] = {n.split()[0]: [] for n in _LOCAL.split(", ")}
    stack = [((1 << len(convs)) - 1, 0, -1, _ROOT, 0)]
    while stack:
        bits, depth, above, node, words = stack.pop()
        at = len(out["at"])
        ended = bits & lengths.get(depth, 0)
        left = bits ^ ended
        inner = bool(left)
        while left:
            first = (left & -left).bit_length() - 1
            digest, size = turns[first][depth]
            child = bits & postings[depth, digest]
            left &= ~child
            stack.append((child, depth + 1, at, hashlib.blake2b(node + digest, digest_size=16).digest(), size))
        ends = []
        while ended:
            low = ended & -ended
            ends.append(str(convs[low.bit_length() - 1]))
            ended ^= low
        for name, value in (
                ("shard", convs[0]), ("at", at), ("parent_at", above), ("node", node), ("depth", depth), ("words", words),
                ("conv_id", convs[(bits & -bits).bit_length() - 1]), ("n", bits.bit_count()), ("inner", inner),
                ("ends", ",".join(ends) or None)):
            out[name].append(value)
    sizes = np.ones(len(out["at"]), np.int64)
    for i in range(len(sizes) - 1, 0, -1):
        sizes[out["parent_at"][i]] += sizes[i]
    out["stop"] = (np.arange(len(sizes)) + sizes).tolist()
    return out


def shard_tries(turns: DataFrame, shard_convs: int, shard_turns: int) -> DataFrame:
    """The nodes of all shards; a shard has at most ``shard_convs`` conversations and, unless a single one has more,
    about ``shard_turns`` turns.  Conversations without turns have a row of position 0."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(turns.sparkSession.createDataFrame([], _LOCAL).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs: list[int] = []
        of: list[list[tuple[bytes, int]]] = []
        held = 0

        def give() -> pa.RecordBatch:
            out = shard_nodes(convs, of)
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

        for batch in batches:
            for conv, position, digest, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not convs or conv != convs[-1]:
                    if len(convs) >= shard_convs or held >= shard_turns:
                        yield give()
                        convs, of, held = [], [], 0
                    convs.append(conv)
                    of.append([])
                if position > 0:
                    of[-1].append((digest, words))
                    held += 1
        if convs:
            yield give()

    return (turns.select("conv_id", "position", "digest", "words").repartitionByRange("conv_id")
            .sortWithinPartitions("conv_id", "position").mapInArrow(run, _LOCAL))


def end_digests(local: DataFrame) -> DataFrame:
    """``node, ends_sha256``: digest of the members that end at a node, ascending, comma-joined.

    Shards are ranges of ids, so their lists follow each other; they are fed to the digest one by one as they arrive
    sorted, and a task holds one of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        done: list[tuple[bytes, str]] = []

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
                names=["node", "ends_sha256"])

        for batch in batches:
            for at, _, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != node:
                    if digest is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
            yield give()
            done.clear()
        if digest is not None:
            done.append((node, digest.hexdigest()))
            yield give()

    return (local.where(F.col("ends").isNotNull()).select("node", "shard", "ends").repartition("node")
            .sortWithinPartitions("node", "shard").mapInArrow(run, "node binary, ends_sha256 string"))


def _own_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """What one shard's own nodes add to the figures of all its nodes."""
    rows = rows.sort_values("at")
    at, stop, above = (rows[c].to_numpy(np.int64) for c in ("at", "stop", "parent_at"))
    own = rows["own"].to_numpy(bool)

    def below(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(np.where(own, values, 0))))
        return total[stop] - total[at]

    children = np.bincount(above[own & (above >= 0)], minlength=len(rows))
    first = rows["conv_id"].to_numpy(np.int64)
    return pd.DataFrame({
        "node": rows["node"], "conv_id": first, "depth": rows["depth"],
        "parent_conv_id": pd.array(np.where(above >= 0, first[above], 0), "Int64").copy(),
        "n_convs": rows["n_convs"], "n_children": children,
        "n_leaves": below((~rows["inner"].to_numpy(bool)).astype(np.int64)),
        "saved_tokens": below(rows["words"].to_numpy(np.int64) * (rows["n_convs"].to_numpy(np.int64) - 1)),
    })


def prefix_trie(turns: DataFrame, shard_convs: int = 2048, shard_turns: int = 65_536) -> DataFrame:
    """The trie of ``turns`` (``conv_id, position, digest, words``), a row for each node.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (over the subtree, words of the last turn for each member but one) and ``ends_sha256``.
    Conversations without turns have a row of position 0.  Positions only order a conversation's turns; equal ones are
    repeats of unknown order, so give each its own.  An empty table has no node, not even a root.  A conversation is
    held by one task with some 100 bytes a turn; what else a task holds is bounded by the two parameters.
    """
    scratch = Scratch(turns.sparkSession)
    local = scratch.put(shard_tries(turns, shard_convs, shard_turns), "local")
    # Of a node: all members, the smallest one, its shard, and whether anything follows in any shard.
    whole = local.groupBy("node").agg(
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("first"), F.min("shard").alias("owner"),
        F.max("inner").alias("any_inner"))
    known = local.select("shard", "at", "stop", "parent_at", "node", "depth", "words").join(whole, "node").select(
        "shard", "at", "stop", "parent_at", "node", "depth", "words", F.col("first").alias("conv_id"), "n_convs",
        F.col("any_inner").alias("inner"), (F.col("owner") == F.col("shard")).alias("own"))
    sums = known.groupBy("shard").applyInPandas(
        _own_sums, "node binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
                   "n_leaves bigint, saved_tokens bigint")
    parent = F.when(F.col("depth") > 0, F.col("parent_conv_id"))
    nodes = sums.groupBy("node", "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs").agg(
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    return nodes.join(end_digests(local), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def branched(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt on the head of another: the first h turns of conversation c - c % ``group``, then the own
    turns after the h-th, with h the checksum of c modulo ``most``; with a row of position 0 for each conversation.

    A conversation that is shorter or not there gives what it has.  A head is of less than ``most`` turns and is asked
    for by less than 2 * ``group`` conversations, so no key of the join is hot.
    """
    convs = turns.groupBy("conv_id").count().select(
        "conv_id", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).alias("h"))
    own = turns.join(convs, "conv_id").where(F.col("position") > F.col("h")).select("conv_id", "position", "digest", "words")
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("position") < most)).select(
        F.col("conv_id").alias("base"), "position", "digest", "words")
    taken = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base").where(
        F.col("position") <= F.col("h")).select("conv_id", "position", "digest", "words")
    roots = convs.select("conv_id", F.lit(0).cast("bigint").alias("position"), F.lit(None).cast("binary").alias("digest"),
                         F.lit(0).cast("bigint").alias("words"))
    return own.unionByName(taken).unionByName(roots)
