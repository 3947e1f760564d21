"""Helpers shared by the operators: tables, bounded Arrow batches, written intermediate tables, hashed words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bounds of one Arrow batch handed to Python; a single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Python worker holds of its input at a time, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Intermediate tables, written as Parquet below the shared folder that ``spark.checkpoint.dir`` names.

    Lost executors re-read these files instead of recomputing what came before.  Where the setting is unset (tests on
    one machine), a temporary folder is used.
    """

    def __init__(self, spark: SparkSession):
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="waybill-checkpoint-")
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext.getCheckpointDir()
        self.spark, self.root = spark, f"{base.rstrip('/')}/waybill-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # Nothing reads the shuffle files of this write again, so they go when it ends.
        before = self.spark.conf.get(_FREE_SHUFFLES)
        self.spark.conf.set(_FREE_SHUFFLES, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Free the space of a table that nothing reads any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_texts(df: DataFrame, fn: Callable[[list, list], dict], schema: str, key: str = "doc_id",
              text: str = "text", more: Iterable[str] = ()) -> DataFrame:
    """Apply ``fn(keys, texts, *more)`` to Arrow batches; ``texts`` are bytes, null texts are ``b""``.

    Only the named columns reach Python, so further columns of the input, whatever their names, are never touched.
    """
    names = [n.split()[0] for n in schema.split(", ")]
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = fn(*columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow)

    picked = df.select(F.col(key), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text_bytes"),
                       *[F.col(c) for c in more])
    return picked.mapInArrow(run, schema)


def append_figures(df: DataFrame, fn: Callable[[list], dict], schema: str, text: str = "text") -> DataFrame:
    """Column ``row`` with all columns of ``df`` as they are, and the figures ``fn(texts)`` gives, without a shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    source = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                       F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text_bytes"))
    target = StructType([source.schema["row"], *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow.field(0).type), *[pa.array(out[f.name], f.type) for f in list(arrow)[1:]]],
                schema=arrow)

    return source.mapInArrow(run, target)


# --- words ----------------------------------------------------------------------------------------------------------

#: Bytes that part words: space and the controls 0x09-0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process; ``lower`` folds A-Z.

    Bytes are worked through in blocks of about 1 MiB, cut between words, so that memory beyond the text itself stays
    bounded.
    """
    raw = np.frombuffer(data, np.uint8)
    starts, ends = word_spans(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    if lower:
        raw = _LOWER[raw]
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        left = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, left + _BLOCK)))
        right = ends[last - 1]
        up, down = _power_table(right - left + 1)
        sums = np.zeros(right - left + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[raw[left:right]] * up[: right - left], out=sums[1:])
        s, e = starts[first:last] - left, ends[first:last] - left
        out[first:last] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        first = last
    return mix(out)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, in order; with fewer words, of the whole sequence as one."""
    if not len(words):
        return words
    if len(words) < n:
        n = len(words)
    acc = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        acc = acc * np.uint64(0xD1342543DE82EF95) + words[i: len(words) - n + 1 + i]
    return mix(acc + np.uint64(n))
