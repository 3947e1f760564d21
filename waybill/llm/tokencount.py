"""Token counts by overlap resynchronisation.

Texts up to ``whole_chars`` are encoded at once.  Longer ones are cut into chunks that reach ``overlap`` characters back
into their predecessor; every chunk is a row of its own, so one huge document is spread over many tasks.  Each chunk is
encoded with offsets.  Two neighbours are spliced at a position of their overlap where both begin a pre-token.

Why such a position is proven: pre-tokens are matched from left to right, and what is matched from a position on depends
only on the text from there on.  In the left chunk a match that ends before the chunk's end has seen the character that
ended it, so it is the same in the whole text; its successor starts at a true boundary.  The right chunk may start within
a pre-token, but from a true boundary on it goes through the same matches as the whole text.  Merges never cross
pre-tokens, so the tokens before (left) and after (right) add up.  An added special string that the left chunk's end cuts
lies behind its last ``guard`` characters, which are not used.

Where the overlap has no common boundary (one run of letters longer than the overlap), the document is encoded again with
overlaps four times as wide, until it aligns or the overlap is the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_texts
from .vocab import json_encoder, json_tokenizer

CHUNK_SCHEMA = ("row_key bigint, chunk int, n_chunks int, n_tokens bigint, head_at array<int>, head_index array<int>, "
                "tail_at array<int>, tail_index array<int>")


def boundaries(tokenizer, text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Token count of a text, and where pre-tokens begin: character positions and token indices."""
    e = tokenizer.encode(text, add_special_tokens=False)
    words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    if not len(words):
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (words[1:] < 0))))
    offsets = e.offsets
    return len(words), np.array([offsets[i][0] for i in fresh], np.int64), fresh


def splice(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[int, int] | None:
    """Token indices (left, right) of the last common boundary, given positions on one scale; None without any."""
    common, i, j = np.intersect1d(left[0], right[0], return_indices=True)
    return (int(left[1][i[-1]]), int(right[1][j[-1]])) if len(common) else None


def count_resynchronised(tokenizer, text: str, chunk: int, overlap: int, guard: int) -> int:
    """Token count of one text from overlapping chunks, widening the overlap where neighbours do not align."""
    while overlap < len(text):
        total, at, previous = 0, 0, None
        for start in range(0, len(text), chunk):
            origin, end = max(0, start - overlap), min(len(text), start + chunk)
            n, where, index = boundaries(tokenizer, text[origin:end])
            where = where + origin
            if previous is not None:
                found = splice(previous, (where[where < start], index[where < start]))
                if found is None or found[0] < at:
                    break
                total, at = total + found[0] - at, found[1]
            tail = (where >= end - overlap) & (where < end - guard)
            previous = (where[tail], index[tail])
        else:
            return total + n - at
        overlap *= 4
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024,
                 chunk: int = 16_384, overlap: int = 256, guard: int = 64) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit, n_chunks`` for every row.

    A null text counts as empty (0 tokens).  Repeated rows and null keys are kept row by row.  Further columns of ``docs``
    are ignored.  ``chunk`` must be larger than ``overlap``, ``overlap`` larger than ``guard``, and ``guard`` larger than
    any special string.
    """
    spark = docs.sparkSession
    whole_chars = 2 * chunk
    base = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def whole(keys: list, texts: list[bytes]) -> dict:
        encoder = json_encoder(path)
        return {key: keys, "n_bytes": [len(t) for t in texts], "n_chunks": [1] * len(keys),
                "n_tokens": [len(encoder.ids(t.decode("utf-8", "replace"))) // 4 for t in texts]}

    kind = base.schema[key].dataType.simpleString()
    small = map_texts(base.where(F.char_length("text") <= whole_chars), whole,
                      f"{key} {kind}, n_bytes bigint, n_chunks int, n_tokens bigint", key)

    # A long text's rows are told apart by a hash of key and text; equal rows have equal counts, so they share the work.
    long = base.where(F.char_length("text") > whole_chars).withColumn(
        "row_key", F.xxhash64(F.col(key), F.col("text")))
    n_chunks = F.ceil(F.char_length("text") / F.lit(chunk)).cast("int")
    pieces = (
        long.select("row_key", "text", n_chunks.alias("n_chunks"))
        .select("row_key", "n_chunks", "text", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))
        .select("row_key", "n_chunks", "chunk",
                F.greatest(F.lit(0), F.col("chunk") * chunk - overlap).alias("origin"),
                F.least(F.char_length("text"), (F.col("chunk") + 1) * chunk).alias("until"), "text")
        .select("row_key", "n_chunks", "chunk", "origin", "until",
                F.substring(F.col("text"), F.col("origin") + 1, F.col("until") - F.col("origin")).alias("part"))
        .repartition(F.col("row_key"), F.col("chunk")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = json_tokenizer(path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n, where, index = boundaries(tokenizer, r["part"])
                where = where + r["origin"]
                start = r["chunk"] * chunk
                head = where < start
                tail = (where >= r["until"] - overlap) & (where < r["until"] - guard)
                out.append({"row_key": r["row_key"], "chunk": r["chunk"], "n_chunks": r["n_chunks"], "n_tokens": n,
                            "head_at": where[head].tolist(), "head_index": index[head].tolist(),
                            "tail_at": where[tail].tolist(), "tail_index": index[tail].tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=chunk_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    chunk_arrow = to_arrow_schema(spark.createDataFrame([], CHUNK_SCHEMA).schema)
    encoded = pieces.mapInArrow(encode, CHUNK_SCHEMA).dropDuplicates(["row_key", "chunk"])

    # Splice: the last common boundary of each pair of neighbours, as positions in both id sequences.
    w = Window.partitionBy("row_key").orderBy("chunk")
    both = encoded.withColumns({"left_at": F.lag("tail_at").over(w), "left_index": F.lag("tail_index").over(w)})
    at = F.array_max(F.array_intersect("left_at", "head_at"))
    both = both.withColumns({
        "enter": F.when(F.col("chunk") == 0, 0).otherwise(
            F.element_at("head_index", F.array_position("head_at", at).cast("int"))),
        "leave_left": F.element_at("left_index", F.array_position("left_at", at).cast("int"))})
    both = both.withColumn("leave", F.coalesce(F.lead("leave_left").over(w), F.col("n_tokens")))
    spliced = both.groupBy("row_key").agg(
        F.sum(F.col("leave") - F.col("enter")).alias("n_tokens"), F.max("n_chunks").alias("n_chunks"),
        (F.count_if(F.col("enter").isNull() | (F.col("leave") < F.col("enter"))) == 0).alias("aligned"))

    def widen(keys: list, texts: list[bytes], counts: list, aligned: list, sizes: list) -> dict:
        tokenizer = json_tokenizer(path)
        return {key: keys, "n_bytes": [len(t) for t in texts], "n_chunks": sizes, "n_tokens": [
            n if ok else count_resynchronised(tokenizer, t.decode("utf-8", "replace"), chunk, overlap * 4, guard)
            for t, n, ok in zip(texts, counts, aligned, strict=True)]}

    # Only texts that did not align travel to the second pass with their text; the others carry their size alone.
    joined = long.join(spliced, "row_key")
    sure = joined.where("aligned").select(
        F.col(key), F.octet_length("text").cast("bigint").alias("n_bytes"), F.col("n_chunks"), F.col("n_tokens"))
    rest = map_texts(joined.where(~F.col("aligned")), widen,
                     f"{key} {kind}, n_bytes bigint, n_chunks int, n_tokens bigint", key,
                     more=("n_tokens", "aligned", "n_chunks"))
    return small.unionByName(sure).unionByName(rest).withColumn("over_limit", F.col("n_tokens") > limit)
