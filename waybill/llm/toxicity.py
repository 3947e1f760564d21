"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two models, toxic and ordinary, read a text as words framed by a start and an end mark.  Each takes its highest-order
counts from its own class and backs off to lower orders whose continuation counts both classes share.  An expression too
rare to be counted in one class therefore gets nearly the same likelihood from both, while a familiar stem with an unseen
ending still tells.  The score compares the two log-likelihoods, normalised by the number of words.  Words whose two
likelihoods differ by less than ``margin`` nats count as undecided (0): their small differences are the noise of finite
counts, which over a long text would drown a few telling words.

Counting n-grams and continuations is Spark grouping over all labelled rows of the learning folds.  What scoring needs is
folded into count arrays of a fixed number of slots by a checksum of the n-gram, so the broadcast model has a size set by
``slots`` and not by the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, append_figures, map_texts

#: White space, ASCII digits and punctuation part words.
_PARTS = bytes(32 if i < 128 and not chr(i).isalpha() else i for i in range(256))
START, END = "\x02", "\x03"
#: Words a worker remembers the score of before it starts afresh.
MEMORY_WORDS = 400_000


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_PARTS).split()


def fold(key: str = "doc_id", folds: int = 5) -> Column:
    """Fold of a document, from the checksum of its id as text; null for a null id."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


class Slots:
    """Kneser-Ney counts in arrays of a fixed number of slots per order."""

    def __init__(self, order: int, slots: int, discount: float):
        self.order, self.slots, self.discount = order, slots, discount
        # Highest order, by class: n-gram counts, context totals, context types.  Lower orders are shared.
        self.top = np.zeros((2, slots), np.float32)
        self.top_total, self.top_types = np.zeros((2, slots), np.float32), np.zeros((2, slots), np.float32)
        self.low = {n: np.zeros(slots, np.float32) for n in range(1, order)}
        self.low_total = {n: np.zeros(slots, np.float32) for n in range(1, order)}
        self.low_types = {n: np.zeros(slots, np.float32) for n in range(1, order)}

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Per word: log-likelihood under the toxic model minus that under the ordinary one."""
        n, mask, crc = self.order, self.slots - 1, zlib.crc32
        gram: list[int] = []
        context: list[int] = []
        lows: list[list[int]] = [[] for _ in range(1, n)]
        contexts: list[list[int]] = [[] for _ in range(1, n)]
        starts = [crc(START.encode() * k) for k in range(n)]
        sizes = []
        for word in words:
            text = framed(word.decode("utf-8", "replace"), n)
            raw, m = text.encode(), len(text) - n + 1
            at = range(len(text) + 1) if len(raw) == len(text) else [0, *accumulate(len(c.encode()) for c in text)]
            sizes.append(m)
            shorter = [0] * m  # checksums of the (k - 1)-grams that end at each place
            for k in range(1, n + 1):
                found = [crc(raw[at[i - k]: at[i]]) for i in range(n, n + m)]
                # the context of a k-gram is the (k - 1)-gram that ends one place before
                before = [starts[k - 1], *shorter[:-1]] if k > 1 else shorter
                (lows[k - 1] if k < n else gram).extend(found)
                (contexts[k - 1] if k < n else context).extend(before)
                shorter = found
        if not gram:
            return np.zeros(len(words))
        p = np.full(len(gram), 1e-4)
        for k in range(1, n):
            p = self._step(self.low[k], self.low_total[k], self.low_types[k], np.array(lows[k - 1]) & mask,
                           np.array(contexts[k - 1]) & mask, p)
        g, c = np.array(gram) & mask, np.array(context) & mask
        by_class = [np.log(self._step(self.top[y], self.top_total[y], self.top_types[y], g, c, p)) for y in (0, 1)]
        ends = np.cumsum(sizes)
        total = np.concatenate(([0.0], np.cumsum(by_class[1] - by_class[0])))
        return total[ends] - total[ends - np.array(sizes)]

    def _step(self, counts, totals, types, at, context, backoff) -> np.ndarray:
        total = totals[context].astype(float)
        d = self.discount
        seen = np.maximum(counts[at] - d, 0.0)
        share = np.where(total > 0, np.minimum(d * types[context] / np.maximum(total, 1e-9), 1.0), 1.0)
        return np.where(total > 0, np.minimum(seen / np.maximum(total, 1e-9), 1.0), 0.0) + share * backoff


def framed(word: str, order: int) -> str:
    return START * (order - 1) + word + END


def gram_counts(learning: DataFrame, label: str, order: int, text: str = "text") -> DataFrame:
    """``gram, n0, n1``: counts of every character n-gram of the words, by class, over all rows of ``learning``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # words first: a batch has far fewer different words than words
        for batch in batches:
            words: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words[y].update(words_of(t or ""))
            grams: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for y, counter in words.items():
                for word, n in counter.items():
                    chars = framed(word.decode("utf-8", "replace"), order)
                    for i in range(len(chars) - order + 1):
                        grams[y][chars[i: i + order]] += n
            every = list(grams[0].keys() | grams[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string()), pa.array([grams[0][g] for g in every], pa.int64()),
                 pa.array([grams[1][g] for g in every], pa.int64())], names=["gram", "n0", "n1"])

    picked = learning.select(F.col(label).cast("int"), F.col(text))
    return picked.mapInArrow(run, "gram string, n0 bigint, n1 bigint").groupBy("gram").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def learn(grams: DataFrame, order: int, slots: int, discount: float = 0.75) -> Slots:
    """Fold the n-gram table into slots.  Each collected table has at most ``slots`` rows."""
    model = Slots(order, slots, discount)

    def slot(column: str) -> Column:
        return F.crc32(F.col(column).cast("binary")).bitwiseAND(F.lit(slots - 1)).alias("slot")

    def fill(rows: DataFrame, key: str, targets: dict[str, np.ndarray]) -> None:
        got = rows.groupBy(slot(key)).agg(*[F.sum(n).alias(n) for n in targets]).toPandas()
        for name, target in targets.items():
            target[got["slot"].to_numpy(np.int64)] = got[name].to_numpy(np.float32)

    fill(grams, "gram", {"n0": model.top[0], "n1": model.top[1]})
    head = grams.select(F.expr(f"left(gram, {order - 1})").alias("context"), "n0", "n1",
                        (F.col("n0") > 0).cast("int").alias("t0"), (F.col("n1") > 0).cast("int").alias("t1"))
    fill(head, "context", {"n0": model.top_total[0], "n1": model.top_total[1], "t0": model.top_types[0],
                           "t1": model.top_types[1]})
    longer = grams.select("gram")
    for k in range(order - 1, 0, -1):
        # A shorter n-gram counts by how many different characters it continues, in both classes together.
        lower = longer.select(F.expr(f"right(gram, {k})").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        fill(lower, "gram", {"n": model.low[k]})
        fill(lower.select(F.expr(f"left(gram, {k - 1})").alias("context"), "n", F.lit(1).alias("t")), "context",
             {"n": model.low_total[k], "t": model.low_types[k]})
        longer = lower.select("gram")
    return model


def calibrate(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Logistic curve through counts of ordinary (n0) and toxic (n1) texts at log-ratio ``x``, lightly regularised."""
    total = n0 + n1
    if not n0.sum() or not n1.sum():
        return -1e-9, 1.0
    w = np.array([np.log(n1.sum() / n0.sum()), 1.0])
    design = np.stack((np.ones_like(x), x), axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n1 - total * p) - np.array([0.0, 1e-3]) * w
        step = np.linalg.solve((design * (total * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 1e-3]), gradient)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def parts_of(texts: list[bytes], size: int = 1 << 18) -> Iterator[list[tuple[int, bytes]]]:
    """``texts`` with their numbers in parts of about ``size`` bytes; a longer text comes in pieces cut at blanks."""
    part, held = [], 0
    for i, text in enumerate(texts):
        start = 0
        while start < len(text):
            stop = text.find(b" ", start + size)
            stop = stop if stop >= 0 else len(text)
            part.append((i, text[start:stop]))
            held += stop - start
            start = stop
            if held >= size:
                yield part
                part, held = [], 0
    if part:
        yield part


def scorer(model, margin: float):
    """A function from texts to their numbers of words and log-likelihood ratios per word; remembers words by worker."""
    known: dict[bytes, float] = {}

    def learn(words: set[bytes]) -> None:
        if len(known) + len(words) > MEMORY_WORDS:
            known.clear()
        new = list(words)
        for i in range(0, len(new), 2000):
            scores = model.value.word_scores(new[i: i + 2000])
            scores[np.abs(scores) < margin] = 0.0
            known.update(zip(new[i: i + 2000], scores.tolist(), strict=True))

    def run(texts: list[bytes]) -> tuple[list[int], list[float]]:
        sizes, totals = [0] * len(texts), [0.0] * len(texts)
        for part in parts_of(texts):  # the words of a bounded part of all texts are held at a time
            rows = [(i, words_of(t.decode("utf-8", "replace"))) for i, t in part]
            new = {w for _, ws in rows for w in ws if w not in known}
            if new:
                # after a fresh start the words met before are new as well
                learn(new if len(known) + len(new) <= MEMORY_WORDS else {w for _, ws in rows for w in ws})
            for i, ws in rows:
                sizes[i] += len(ws)
                totals[i] += sum(map(known.__getitem__, ws))
        return sizes, [t / max(n, 1) for t, n in zip(totals, sizes, strict=True)]

    return run


def score_texts(docs: DataFrame, model, key: str, text: str, margin: float) -> DataFrame:
    """``key, n_tokens, ratio``: words of every row, and the log-likelihood ratio per word (0 for a text without words)."""
    kind, score = docs.schema[key].dataType.simpleString(), scorer(model, margin)

    def run(keys: list, texts: list[bytes]) -> dict:
        return {key: keys} | dict(zip(("n_tokens", "ratio"), score(texts), strict=True))

    return map_texts(docs, run, f"{key} {kind}, n_tokens bigint, ratio double", key, text)


def marked_rows(labels: DataFrame, key: str, label: str) -> DataFrame:
    """``label_key, label``: one row for each labelled key; of several labels the largest counts."""
    return labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("label_key")).agg(
        F.max(label).cast("int").alias("label"))


def learn_model(docs: DataFrame, marked: DataFrame, key: str, text: str, order: int, slots: int, folds: int,
                scratch: Scratch):
    """Broadcast model from all labelled rows outside the first and last fold."""
    learning = marked.where(fold("label_key", folds).between(1, folds - 2))
    # One way of joining at every size: what is shuffled follows the input.
    texts = docs.select(F.col(key), F.col(text)).join(
        learning.hint("merge"), F.col(key) == F.col("label_key")).select("label", F.col(text))
    grams = scratch.put(gram_counts(texts, "label", order, text), "grams")
    return docs.sparkSession.sparkContext.broadcast(learn(grams, order, slots))


def fit_curve(scored: DataFrame, marked: DataFrame, key: str, folds: int) -> Column:
    """Score over ``ratio``, fitted on the last fold: from at most 4,001 bins of the ratio."""
    step = 1e-3
    bins = (
        scored.join(marked.where(fold("label_key", folds) == folds - 1), F.col(key) == F.col("label_key"))
        .groupBy(F.round(F.least(F.greatest(F.col("ratio"), F.lit(-2.0)), F.lit(2.0)) / step).cast("int").alias("bin"))
        .agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).toPandas())
    shift, slope = calibrate(bins["bin"].to_numpy(float) * step, bins["n0"].to_numpy(float), bins["n1"].to_numpy(float))
    return 1 / (1 + F.exp(-(F.lit(shift) + F.lit(slope) * F.col("ratio"))))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
             order: int = 4, slots: int = 1 << 20, margin: float = 5.0, folds: int = 5) -> DataFrame:
    """``key, n_tokens, ratio, held_out, score, predicted`` for every row of ``docs``.

    Fold 0 is never learned from; the last fold calibrates the score, the others give the counts.  Empty and null texts
    get the score of a ratio of 0.  Rows with a null key are scored and count as held out.  Repeated rows are scored row
    by row; null labels are ignored, and of several labels of one key the largest counts.  Without labelled rows of both
    classes the score is 0.5 at a ratio of 0.  Further columns of either table are ignored; an empty table gives an empty
    result.
    """
    scratch = Scratch(docs.sparkSession)
    marked = marked_rows(labels, key, label)
    model = learn_model(docs, marked, key, text, order, slots, folds, scratch)
    scored = scratch.put(score_texts(docs, model, key, text, margin), "scored")
    score = fit_curve(scored, marked, key, folds)
    return scored.select(
        F.col(key), "n_tokens", "ratio", F.coalesce(fold(key, folds) == 0, F.lit(True)).alias("held_out"),
        score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                  order: int = 4, slots: int = 1 << 20, margin: float = 5.0, folds: int = 5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``classify`` does not predict to be toxic."""
    scratch = Scratch(docs.sparkSession)
    marked = marked_rows(labels, key, label)
    model = learn_model(docs, marked, key, text, order, slots, folds, scratch)
    score = scorer(model, margin)
    scored = append_figures(docs, lambda texts: dict(zip(("n_tokens", "ratio"), score(texts), strict=True)),
                            "n_tokens bigint, ratio double", text)
    curve_rows = docs.select(F.col(key), F.col(text)).join(
        marked.where(fold("label_key", folds) == folds - 1).hint("merge"), F.col(key) == F.col("label_key"), "left_semi")
    curve = fit_curve(score_texts(curve_rows, model, key, text, margin), marked, key, folds)
    return scored.where(curve < 0.5).select("row.*")
