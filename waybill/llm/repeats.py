"""Repeated byte strings, removed with a distributed suffix array.

Asked for: every byte covered by a string of ``length`` bytes that also starts earlier (smaller document, or the same
document at a smaller offset).  The strings are the suffixes of all texts, cut after ``length`` bytes; one is repeated if
its predecessor in suffix order has the same bytes.  Sorting one suffix for every byte of a corpus would move ``length``
bytes for each, so most are decided before the sort, without any loss:

1. *Blocks.*  In every window of ``length`` bytes the k-gram of smallest hash is its anchor; equal windows have equal
   anchors.  Consecutive windows with one anchor are a block, about one for 36 bytes.  An anchor that occurs once in the
   corpus rules out all its windows.  Of blocks that are equal as a whole, all but the first are repeats, and only the
   first goes on.  This is decided within a batch already where it can be, so a passage that a third of all documents
   hold reaches a partition only once for each batch.
2. *Suffixes.*  Blocks whose anchor also stands in a different block (the ends of shared passages, places of an edit) are
   expanded to suffixes.  Sampled splitters range-partition these by their leading bytes, then the rest and the place;
   as the place is part of the order, any number of equal suffixes splits over buckets.  A bucket is sorted by multikey
   quicksort: by the leading bytes, and only what ties there by the next key.  Neighbours are compared, the first of a
   bucket with the last of the bucket before.

Beyond the leading eight bytes strings are compared by 64-bit fingerprints.  Texts are moved twice, compressed: to expand
blocks and to cut the repeats out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import _BASE, _BYTE_VALUE, Scratch, mix

GRAM = 32
TWIN = 1 << 40  # offsets of the n-th different text of one id start at n * TWIN
LAST_ID = (1 << 63) - 1


def rolling(raw: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` bytes, by doubling; the raw polynomial, to be mixed by the caller."""
    part, size, acc, have = _BYTE_VALUE[raw], 1, None, 0
    while True:
        if n & size:
            if acc is None:
                acc, have = part, size
            else:
                long = len(raw) - have - size + 1
                acc = acc[:long] * np.uint64(pow(_BASE, size, 1 << 64)) + part[have: have + long]
                have += size
        if have == n:
            return acc
        long = len(raw) - 2 * size + 1
        part = part[:long] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size: size + long]
        size *= 2


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size:]) if size < width else h


def blocks_of(raw: np.ndarray, length: int, gram: int = GRAM, step: int = 1 << 20) -> dict[str, np.ndarray]:
    """Blocks of one text: anchor hash, first window, hash of all bytes, and ``info`` (see ``pack_info``).

    Windows are told apart by the smallest hash within them; the low bits of a hash hold its place, ascending and
    descending, so that a block in which the smallest hash stands more than once is seen (``loops``): only there can two
    windows of one block be equal.  Long texts are worked through in pieces that end at block ends.
    """
    out: list[tuple] = []
    start, total, width = 0, len(raw) - length + 1, length - gram + 1
    bits = np.uint64(step.bit_length() + 1)
    low_bits = (np.uint64(1) << bits) - np.uint64(1)
    while start < total:
        end = min(total, start + step)
        piece = raw[start: end + length - 1]
        h = mix(rolling(piece, gram))
        place = np.arange(len(h), dtype=np.uint64)
        top = h & ~low_bits
        up = sliding_min(top | place, width)
        down = sliding_min(top | (low_bits - place), width)
        low = up & ~low_bits
        cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
        first = np.concatenate(([0], cuts))
        until = np.concatenate((cuts, [len(low)]))
        if end < total and len(first) > 1:  # the last block may go on: it is taken up again with the next piece
            first, until = first[:-1], until[:-1]
        leftmost = (up[first] & low_bits).astype(np.int64)
        rightmost = (low_bits - (down[until - 1] & low_bits)).astype(np.int64)
        powers = np.full(len(piece), _BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[piece] * powers, out=sums[1:])
        back = np.full(len(piece) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)

        def span(a: np.ndarray, b: np.ndarray, sums: np.ndarray = sums, back: np.ndarray = back) -> np.ndarray:
            return mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))

        n, half = until - first, (length - gram) // 2
        left = span(np.maximum(leftmost - half, 0), leftmost + gram)
        right = span(leftmost, np.minimum(leftmost + gram + half, len(piece)))
        info = pack_info(n, leftmost - first, leftmost != rightmost, left, right)
        out.append((h[leftmost], first + start, span(first, until - 1 + length) ^ mix(n.astype(np.uint64)), info))
        start += int(until[-1])
    return dict(zip(("anchor", "first", "whole", "info"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True))


def pack_info(n: np.ndarray, lead: np.ndarray, loops: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In 64 bits: number of windows (24), bytes before the anchor (7), loops (1), fingerprints of both halves (16 each).

    The left half is the anchor and what stands half a window's rest before it, the right half likewise after it.
    """
    u = np.uint64
    return (n.astype(u) << u(40) | np.minimum(lead, 127).astype(u) << u(33) | loops.astype(u) << u(32)
            | (left >> u(48)) << u(16) | right >> u(48))


def unpack_info(info: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of windows, bytes before the anchor, loops."""
    bits = info.view(np.uint64)
    return ((bits >> np.uint64(40)).astype(np.int64), (bits >> np.uint64(33) & np.uint64(127)).astype(np.int64),
            (bits >> np.uint64(32) & np.uint64(1)).astype(bool))


def multikey_sort(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key, then, only within what still ties, by the next, and so on."""
    order = np.argsort(keys[0], kind="stable")
    ties = np.zeros(max(len(order) - 1, 0), bool)
    ties[:] = keys[0][order][1:] == keys[0][order][:-1]
    for key in keys[1:]:
        if not ties.any():
            break
        inside = np.concatenate((ties, [False])) | np.concatenate(([False], ties))
        at = np.flatnonzero(inside)
        run = np.cumsum(np.concatenate(([True], ~ties)))[at]
        rows = order[at]
        rows = rows[np.lexsort((key[rows], run))]
        order[at] = rows
        ties = ties & (key[order][1:] == key[order][:-1])
    return order


def _signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def _pack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _first_rows(columns: dict[str, np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In an order by (anchor, whole, id, at): where an anchor starts, and where a block not seen before starts."""
    a, w = columns["anchor"][order], columns["whole"][order]
    new_anchor = np.concatenate(([True], a[1:] != a[:-1]))
    return new_anchor, new_anchor | np.concatenate(([True], w[1:] != w[:-1]))


BLOCK = "anchor bigint, whole bigint, id bigint, at bigint, info bigint, repeat boolean"
FOUND = "id bigint, at bigint, info bigint, want tinyint"


def _find_blocks(length: int, gram: int):
    """Blocks of a batch of texts; those that repeat an earlier block of the batch are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for id_, twin, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(text) >= length:
                    b = blocks_of(np.frombuffer(text, np.uint8), length, gram)
                    b["id"] = np.full(len(b["info"]), id_, np.int64)
                    b["at"] = b.pop("first") + twin * TWIN
                    parts.append(b)
            if not parts:
                continue
            c = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
            order = np.lexsort((c["at"], c["id"], c["whole"], c["anchor"]))
            _, fresh = _first_rows(c, order)
            repeat = np.empty(len(order), bool)
            repeat[order] = ~fresh
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (_signed(c["anchor"]), _signed(c["whole"]), c["id"], c["at"], _signed(c["info"]),
                                       repeat)], names=[p.split()[0] for p in BLOCK.split(", ")])

    return run


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (anchor, whole, id, at): repeats of blocks (want 0), and first blocks to expand (want > 0).

    An anchor's rows may span batches.  Carried over are the keys of the last row, whether its anchor has shown several
    different blocks, and, while it has not, the first of them.
    """
    last: tuple | None = None
    several_so_far, held = False, None

    def rows(part: dict[str, np.ndarray], want: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(part["id"]), pa.array(part["at"]), pa.array(part["info"]), pa.array(want.astype(np.int8))],
            names=["id", "at", "info", "want"])

    def some(c: dict[str, np.ndarray], pick: np.ndarray) -> dict[str, np.ndarray]:
        return {n: v[pick] for n, v in c.items()}

    for batch in batches:
        c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        known = c["repeat"]
        if known.any():
            part = some(c, known)
            yield rows(part, np.zeros(len(part["id"])))
            c = some(c, ~known)
        if not len(c["id"]):
            continue
        new_anchor, fresh = _first_rows(c, np.arange(len(c["id"])))
        goes_on = last is not None and last[0] == c["anchor"][0]
        if goes_on:
            new_anchor[0], fresh[0] = False, last[1] != c["whole"][0]
        else:
            several_so_far, held = False, None
        part = some(c, ~fresh)
        yield rows(part, np.zeros(len(part["id"])))
        group = np.cumsum(new_anchor) - (0 if goes_on else 1)
        kinds = np.bincount(group, fresh, minlength=int(group[-1]) + 1)
        if goes_on:
            kinds[0] += 2 if several_so_far else 1
            if kinds[0] > 1 and held is not None:
                yield rows(held, np.full(1, 3))
                held = None
        f = np.flatnonzero(fresh)
        _, _, loops = unpack_info(c["info"][f])
        pick = f[(kinds[group[f]] > 1) | loops]
        if len(pick):
            part = some(c, pick)
            want = _wanted_halves(group[pick], part["info"])
            # a group that is not whole in this batch, and blocks that repeat within themselves, are expanded in full
            partial = (group[pick] == group[-1]) | (goes_on & (group[pick] == 0)) | unpack_info(part["info"])[2]
            yield rows(part, np.where(partial, 3, want))
        if group[-1] > 0 or not goes_on:
            held = None
        if kinds[-1] == 1 and (group[-1] > 0 or not goes_on):
            i = f[group[f] == group[-1]]
            held = None if unpack_info(c["info"][i])[2][0] else some(c, i)
        several_so_far = bool(kinds[-1] > 1)
        last = (c["anchor"][-1], c["whole"][-1])


def _wanted_halves(group: np.ndarray, info: np.ndarray) -> np.ndarray:
    """4, plus 1 (left half) and 2 (right half) where another block of the same anchor has a like half."""
    out = np.full(len(group), 4, np.int64)
    bits = info.view(np.uint64)
    for flag, shift in ((1, 16), (2, 0)):
        half = (bits >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.int64)
        _, inverse, counts = np.unique(group.astype(np.int64) << 16 | half, return_inverse=True, return_counts=True)
        out += np.where(counts[inverse] > 1, flag, 0)
    return out


SUFFIX = "lead bigint, rest bigint, id bigint, at bigint"


def _expand(length: int, gram: int, step: int = 1 << 20):
    """Suffixes of the blocks of each text: leading 8 bytes (as a number that sorts alike), fingerprint, place."""
    half = (length - gram) // 2

    def starts(at: np.ndarray, info: np.ndarray, want: np.ndarray) -> np.ndarray:
        n, lead, loops = unpack_info(info)
        at, n, lead, want = at & (TWIN - 1), n, lead, np.where(loops, 3, want)
        at, lead, want = np.repeat(at, n), np.repeat(lead, n), np.repeat(want, n)
        step_ = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        offset = lead - step_  # bytes of the window before its anchor
        keep = ((want & 1 > 0) | (offset < half)) & ((want & 2 > 0) | (offset > half)) | (want == 3)
        return np.sort((at + step_)[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("blocks")
            ends, values = blocks.offsets.to_numpy(), blocks.values
            at_, info_, want_ = (values.field(n).to_numpy(zero_copy_only=False) for n in ("at", "info", "want"))
            for i, (id_, twin, body) in enumerate(zip(
                    *(batch.column(n).to_pylist() for n in ("id", "twin", "body")), strict=True)):
                raw, part = np.frombuffer(_unpack(body), np.uint8), slice(ends[i], ends[i + 1])
                todo = starts(at_[part], info_[part], want_[part])
                for a, b in zip(cut := np.append(np.searchsorted(todo, np.arange(0, len(raw), step)), len(todo)), cut[1:],
                                strict=False):
                    if a == b:
                        continue
                    at = todo[a:b]
                    base = at[0]
                    piece = raw[base: at[-1] + length]
                    word = np.zeros(len(at), np.uint64)
                    for k in range(8):
                        word = word << np.uint64(8) | piece[at - base + k].astype(np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(word ^ np.uint64(1 << 63))), pa.array(_signed(mix(rolling(piece, length))[at - base])),
                         pa.array(np.full(len(at), id_, np.int64)), pa.array(at + twin * TWIN)],
                        names=["lead", "rest", "id", "at"])

    return run


COMPARED = "edge int, bucket int, lead bigint, rest bigint, id bigint, at bigint"


def _compare_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: sort, and give out every suffix that equals its predecessor (edge 0), the first (1) and the last (2)."""
    from pyspark import TaskContext

    parts = list(batches)
    if not sum(p.num_rows for p in parts):
        return
    c = {n: np.concatenate([p.column(n).to_numpy(zero_copy_only=False) for p in parts]) for n in ("lead", "rest", "id", "at")}
    order = multikey_sort([c["lead"], c["rest"], c["id"], c["at"]])
    lead, rest = c["lead"][order], c["rest"][order]
    again = order[1:][(lead[1:] == lead[:-1]) & (rest[1:] == rest[:-1])]
    pick = np.concatenate((again, order[:1], order[-1:]))
    edge = np.zeros(len(pick), np.int32)
    edge[-2:] = 1, 2
    bucket = np.full(len(pick), TaskContext.get().partitionId(), np.int32)
    yield pa.RecordBatch.from_arrays(
        [pa.array(edge), pa.array(bucket), *[pa.array(c[n][pick]) for n in ("lead", "rest", "id", "at")]],
        names=[p.split()[0] for p in COMPARED.split(", ")])


def with_places(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with ``id`` (null keys last) and ``twin``, which numbers the different texts of one id from 0."""
    placed = docs.withColumn("id", F.coalesce(F.col(key).cast("bigint"), F.lit(LAST_ID)))
    again = placed.groupBy("id").count().where("count > 1").select("id")
    if again.isEmpty():
        return placed.withColumn("twin", F.lit(0))
    placed = placed.withColumn("text_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    twins = placed.join(again, "id", "left_semi").select("id", "text_hash").distinct().withColumn(
        "twin", F.row_number().over(Window.partitionBy("id").orderBy("text_hash")) - 1)
    return placed.join(twins, ["id", "text_hash"], "left").withColumn("twin", F.coalesce("twin", F.lit(0))).drop("text_hash")


def _compressed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with column ``body``, the zstd-compressed text, in place of ``text``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    source = docs.withColumn("body", F.coalesce(F.col(text).cast("binary"), F.lit(b""))).drop(text)
    arrow = to_arrow_schema(source.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array([_pack(t) for t in c.to_pylist()], f.type) if f.name == "body" else c.cast(f.type)
                       for c, f in zip(batch.columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(run, source.schema)


def find_repeats(placed: DataFrame, text: str, length: int, gram: int, scratch: Scratch) -> DataFrame:
    """``id, twin, spans``: for every text with repeats, where removed strings start (high 40 bits of a number) and how
    many follow one another (low 24 bits)."""
    spark = placed.sparkSession
    texts = placed.select("id", "twin", F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))
    if "text_hash" in placed.columns or placed.select("twin").where("twin > 0").limit(1).count():
        texts = texts.dropDuplicates(["id", "twin"])
    blocks = texts.mapInArrow(_find_blocks(length, gram), BLOCK)
    dealt = blocks.repartition(F.when(F.col("repeat"), F.xxhash64("id", "at")).otherwise(F.col("anchor")))
    found = scratch.put(dealt.sortWithinPartitions("anchor", "whole", "id", "at").mapInArrow(_compare_blocks, FOUND), "blocks")

    twin = F.shiftright("at", 40).cast("int").alias("twin")
    wanted = found.where("want > 0").groupBy("id", twin).agg(F.collect_list(F.struct("at", "info", "want")).alias("blocks"))
    body = _compressed(texts.withColumnRenamed("body", "raw_text"), "raw_text")
    suffixes = body.join(wanted, ["id", "twin"]).select("id", "twin", "body", "blocks").mapInArrow(_expand(length, gram), SUFFIX)
    n = found.where("want > 0").agg(F.sum(F.shiftrightunsigned("info", 40))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n) // 1_000_000))
    compared = scratch.put(
        suffixes.repartitionByRange(buckets, "lead", "rest", "id", "at").mapInArrow(_compare_suffixes, COMPARED), "suffixes")

    # Across boundaries: two rows for each bucket reach the driver.
    edges = {(r["bucket"], r["edge"]): r for r in compared.where("edge > 0").collect()}
    again, before = [], None
    for bucket in sorted({b for b, _ in edges}):
        first, end = edges[bucket, 1], edges[bucket, 2]
        if before is not None and (before["lead"], before["rest"]) == (first["lead"], first["rest"]):
            again.append((first["id"], first["at"], 1))
        before = end
    one = F.lit(1).cast("bigint")
    runs = (
        found.where("want = 0").select("id", "at", F.shiftrightunsigned("info", 40).alias("n"))
        .unionByName(compared.where("edge = 0").select("id", "at", one.alias("n")))
        .unionByName(spark.createDataFrame(again, "id bigint, at bigint, n bigint")))
    return runs.groupBy("id", twin).agg(
        F.collect_list(F.shiftleft("at", 24).bitwiseOR(F.col("n"))).alias("spans"))


def removed_mask(size: int, at: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """True for the bytes covered by strings that start at ``at`` .. ``at + n - 1``."""
    steps = np.bincount(at, minlength=size + 1) - np.bincount(at + n - 1 + length, minlength=size + 1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, gram: int = GRAM,
                   digest_only: bool = False) -> DataFrame:
    """Every row with ``n_bytes, n_removed, n_spans, kept_sha256`` and, unless ``digest_only``, ``kept_text``.

    ``n_spans`` counts maximal removed runs.  ``kept_text`` is what is left, without the pieces of characters that a cut
    went through (the digest is of the bytes as they are).  A null text is empty; texts shorter than ``length`` lose
    nothing.  Rows that repeat id and text count once and get the same result; different texts of one id are ordered by
    their hash.  Null keys come after all others.  All other columns of ``docs`` are passed on, except that columns named
    like a result are replaced; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    results_ = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    rest = [c for c in docs.columns if c != text and (c == key or c.lower() not in results_)]
    narrow = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("columns"), F.col(f"`{key}`").alias("_key"),
                         F.col(f"`{text}`").alias("_text"))
    placed = with_places(narrow, "_key", "_text").drop("_key")
    spans = find_repeats(placed, "_text", length, gram, scratch)
    joined = _compressed(placed, "_text").join(spans, ["id", "twin"], "left")
    results = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (
        "" if digest_only else ", kept_text string")
    from pyspark.sql.types import StructType

    schema = StructType([joined.schema["columns"], *StructType.fromDDL(results).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in list(arrow)[1:]}
            spans = batch.column("spans")
            ends, found = spans.offsets.to_numpy(), spans.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for i, body in enumerate(batch.column("body").to_pylist()):
                data = _unpack(body)
                kept, removed, runs = data, 0, 0
                if ends[i + 1] > ends[i]:
                    own_ = found[ends[i]: ends[i + 1]]
                    gone = removed_mask(len(data), (own_ >> np.uint64(24)).astype(np.int64),
                                        (own_ & np.uint64((1 << 24) - 1)).astype(np.int64), length)
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                values = (len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
                for name, value in zip(out, values, strict=False):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("columns").cast(arrow.field(0).type), *[pa.array(v, arrow.field(n).type) for n, v in out.items()]],
                schema=arrow)

    return joined.select("columns", "body", "spans").mapInArrow(run, schema).select(
        "columns.*", *[f.name for f in schema.fields[1:]])
