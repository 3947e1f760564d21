import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from waybill.llm import bpecodec, packing, tokencount, vocab

JSON = vocab.default_path("byte_bpe_50k.json")
RANKS = vocab.default_path("byte_bpe_multi_50k.tiktoken")
LETTERS = ["a", "Bc", " ", "  ", "\n", "\t", "é", "1", "23", "'s", "'ll", "!", "...", "<|endoftext|>", "\xa0", "　", "日本",
           "🙂", "\x1c", " ", "<|endo", "ſ", "\0", "x y", "foo bar"]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]


@pytest.fixture(scope="module")
def tiktoken_like():
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_parts_give_the_librarys_ids(odd_texts):
    encoder, tokenizer = vocab.json_encoder(JSON), vocab.json_tokenizer(JSON)
    for t in odd_texts:
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_codec_is_the_rank_librarys_and_round_trips(odd_texts, tiktoken_like):
    codec = bpecodec.codec(RANKS, public_tokenizers.PATTERN)
    for t in odd_texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == tiktoken_like.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()


def test_codec_columns(spark, odd, odd_rows, tiktoken_like, batches):
    rows = bpecodec.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()
    expected = sorted((str(k), hashlib.sha256(np.array(tiktoken_like.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest())
                      for k, t, *_ in odd_rows)
    assert sorted((str(r.doc_id), r.ids_sha256) for r in rows) == expected
    assert all(r.exact for r in rows)


def test_encode_then_decode(spark, odd, odd_rows):
    ids = bpecodec.encode(odd, RANKS, public_tokenizers.PATTERN)
    back = bpecodec.decode(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t, *_ in odd_rows)


@pytest.mark.parametrize("chunk,overlap", [(400, 128), (1000, 66)])
def test_counts_of_chunks_are_counts_of_wholes(spark, odd, odd_rows, chunk, overlap):
    tokenizer = vocab.json_tokenizer(JSON)
    got = tokencount.count_tokens(odd, JSON, chunk=chunk, overlap=overlap, guard=64, limit=50).collect()
    expected = sorted((str(k), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids))
                      for k, t, *_ in odd_rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 50) for r in got)


def test_overlaps_widen_where_nothing_aligns(spark):
    rng = random.Random(5)
    texts = ["a" * 5000, "ab " * 900, "".join(rng.choice(LETTERS) for _ in range(3000)), "x" * 700 + " y" * 600 + "z" * 900,
             "\n" * 3000, "<|endoftext|>" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokenizer = vocab.json_tokenizer(JSON)
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, JSON, chunk=200, overlap=80, guard=64).collect()}
    assert got == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for t in texts:
        assert tokencount.count_resynchronised(tokenizer, t, 200, 80, 64) == len(
            tokenizer.encode(t, add_special_tokens=False).ids)


def test_packing_loses_nothing(spark, odd, odd_rows, batches):
    tokenizer = vocab.json_tokenizer(JSON)
    rows = packing.pack_documents(odd, JSON, size=512, group_rows=4, fan_in=2).collect()
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    ids = [(str(k), tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for k, t, *_ in odd_rows]
    expected = []
    for k, i in ids:
        first = len(i) % 512 or 512
        starts = [0, *range(first, len(i), 512)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(i)], strict=True)):
            expected.append((k, piece, a, b - a, zlib.crc32(np.array(i[a:b], "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)


def test_packing_is_tight(spark):
    rng = random.Random(1)
    sizes = [min(2047, 1 + int(rng.expovariate(1 / 300))) for _ in range(4000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)],
                                   "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    used = packing.pack(pieces, 2048, group_rows=500, fan_in=2).select("sequence_id").distinct().count()
    assert used <= -(-sum(sizes) // 2048) + 2


def test_best_fit_takes_the_tightest_room():
    assert packing.best_fit(np.array([6, 5, 4, 3]), 10).tolist() == [0, 1, 0, 1]
    assert packing.best_fit(np.array([10, 10]), 10).tolist() == [0, 1]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(empty, JSON).count() == 0
    assert tokencount.count_tokens(empty, JSON).count() == 0
    assert bpecodec.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_pieces_that_never_share_a_bin_leave_in_the_first_round(spark):
    """No group grows: nothing fits beside a piece of over half a sequence, so no round follows."""
    pieces = spark.range(3000).selectExpr(
        "id AS doc_id", "0 AS piece", "0L AS start", "1100L AS length", "0L AS ids_crc32")
    rows = packing.pack(pieces, 2048, group_rows=200, fan_in=2, most_rows=300).collect()
    assert len({r.sequence_id for r in rows}) == 3000 and {r.sequence_id >> 56 for r in rows} == {0}


def test_bound_of_a_group_ends_the_tree(spark):
    pieces = spark.range(4000).selectExpr(
        "id AS doc_id", "0 AS piece", "0L AS start", "CASE WHEN id % 400 = 0 THEN 900L ELSE 1100L END AS length",
        "0L AS ids_crc32")
    rows = packing.pack(pieces, 2048, group_rows=400, fan_in=8, most_rows=1000).collect()
    assert len(rows) == 4000 and {r.sequence_id >> 56 for r in rows} <= {0, 1}
    fills = {}
    for r in rows:
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in fills.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048


def test_many_tiny_pieces_share_a_sequence(spark):
    pieces = spark.range(50_000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "1L AS length", "0L AS ids_crc32")
    rows = packing.pack(pieces, 2048, group_rows=10_000).collect()
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(places) == 50_000 and len({s for s, _ in places}) == -(-50_000 // 2048)
