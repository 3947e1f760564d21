"""Language of texts by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent n-grams, a text's profile the list of its own.  Both are compared by
rank: each n-gram of the text counts by how far out of place it stands in the language's list, and by the length of the
list where it is not in it at all.  The language with the smallest sum is the answer.

N-grams are runs of up to three letters of a lower-cased text; everything that is not a letter parts words, and one blank
stands at each end of a word.  Three code points of 21 bits fill a 64-bit number, so n-grams are compared exactly.  Counts
come from every learning row; they are combined in each task before they are grouped, so a language that holds most rows
costs no more in any one task.  What reaches the driver is ``profile`` n-grams for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_texts
from .toxicity import fold

#: Characters that are worked on at a time.
_BLOCK = 1 << 19
#: N-grams a task holds before it hands their counts on.
_HELD = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of about ``_BLOCK`` characters, cut where a word ends if the word allows it."""
    start = 0
    while start < len(text):
        stop = min(start + _BLOCK, len(text))
        while stop < len(text) and stop < start + 2 * _BLOCK and text[stop].isalpha():
            stop += 1
        yield text[start:stop]
        start = stop


def _tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    grams, at = np.unique(grams, return_inverse=True)
    return grams, np.bincount(at, weights=counts, minlength=len(grams)).astype(np.int64)


def ngrams(text: str, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, as numbers in ascending order, and their counts; without letters, none.

    Runs of three are negative numbers, runs of two have bit 42 set, letters are their code points.  A run of over a
    million letters without a break is taken as several words.
    """
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for piece in _pieces(text):
        codes = np.frombuffer(piece.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        framed = np.zeros(len(codes) + 2, np.int64)
        framed[1:-1] = np.where(_letters()[codes], codes, 0)
        found = [framed[framed > 0]]
        if longest > 1:
            a, b = framed[:-1], framed[1:]
            found.append(((a << 21) | b)[(a | b) > 0] | (1 << 42))
        if longest > 2:
            a, b, c = framed[:-2], framed[1:-1], framed[2:]
            found.append(-((((a << 21) | b) << 21) | c)[b > 0])
        parts.append(np.unique(np.concatenate(found), return_counts=True))
        if len(parts) > 8:
            parts = [_tally(parts)]
    return _tally(parts)


def ranked(grams: np.ndarray, counts: np.ndarray, profile: int) -> np.ndarray:
    """The ``profile`` most frequent n-grams, most frequent first, ties to the smaller number."""
    if len(grams) > 4 * profile:  # at least the count of the last place
        bar = np.partition(counts, len(counts) - profile)[len(counts) - profile]
        grams, counts = grams[counts >= bar], counts[counts >= bar]
    return grams[np.lexsort((grams, -counts))[:profile]]


def count_ngrams(learning: DataFrame, lang: str, text: str = "text", longest: int = 3) -> DataFrame:
    """``lang, gram, n``: counts over all rows of ``learning``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: dict[str, list[str]] = {}
        size = 0

        def count(name: str) -> None:
            held.setdefault(name, []).append(ngrams("\n".join(waiting.pop(name)), longest))
            if len(held[name]) > 8:
                held[name] = [_tally(held[name])]

        def give() -> Iterator[pa.RecordBatch]:
            for name in list(waiting):
                count(name)
            for name in list(held):
                grams, counts = _tally(held.pop(name))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                    names=["lang", "gram", "n"])

        for batch in batches:
            for name, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.setdefault(name, []).append(t)
                size += len(t)
                if size > _BLOCK:
                    for each in list(waiting):
                        count(each)
                    size = 0
                    if sum(len(g) for parts in held.values() for g, _ in parts) > _HELD:
                        yield from give()
        yield from give()

    picked = learning.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string"), F.col(text))
    return picked.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(learning: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, profile: int = 400,
                   max_languages: int = 2000) -> dict[str, np.ndarray]:
    """The ranked n-grams of every language of ``learning``.

    At most ``max_languages`` times ``profile`` rows reach the driver; with more languages an error says so, as a column
    of that many values holds something else.  Null languages and null texts are not learned from; a language whose
    texts have no letter has no profile.
    """
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    rows = (
        count_ngrams(learning, lang, text, longest).withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= profile).select("lang", "rank", "gram").limit(max_languages * profile + 1).toPandas())
    if len(rows) > max_languages * profile:
        raise ValueError(f"more than {max_languages} languages in column {lang}")
    return {name: part.sort_values("rank")["gram"].to_numpy(np.int64) for name, part in rows.groupby("lang")}


class Profiles:
    """Languages in the order of their names, with the ranks of all their n-grams in one table."""

    def __init__(self, profiles: dict[str, np.ndarray], longest: int, profile: int):
        self.names, self.longest, self.profile = sorted(profiles), longest, profile
        self.grams = np.unique(np.concatenate([profiles[n] for n in self.names] or [np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int32)  # the last row is of no n-gram
        for i, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[name]), i] = np.arange(len(profiles[name]))

    def distances(self, text: str) -> np.ndarray | None:
        """Out-of-place distance to every language, from 0 to 1; None for a text without letters."""
        mine = ranked(*ngrams(text, self.longest), self.profile)
        if not len(mine):
            return None
        at = np.searchsorted(self.grams, mine)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == mine, at, len(self.grams)) if len(self.grams) else at
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, self.profile, np.abs(theirs - np.arange(len(mine))[:, None]))
        return apart.sum(axis=0, dtype=np.int64) / (len(mine) * self.profile)

    def best(self, text: str) -> tuple[str, float]:
        distances = self.distances(text) if self.names else None
        if distances is None:
            return UNKNOWN, 0.0
        i = int(distances.argmin())
        return self.names[i], float(1.0 - distances[i])


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], key: str = "doc_id", text: str = "text",
             longest: int = 3, profile: int = 400) -> DataFrame:
    """``key, lang_pred, score`` for every row of ``docs``.

    ``score`` is 1 minus the distance as a share of the largest possible one.  Of equally near languages the first by
    name is taken.  Null and empty texts, and those without a letter, get ``und`` and 0, as does every text when no
    language was learned.  Texts are read whole, in blocks.  Rows with a null key and repeated rows are answered row by
    row; further columns are ignored; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, longest, profile))

    def run(keys: list, texts: list[bytes]) -> dict:
        found = [model.value.best(t.decode("utf-8", "replace")) for t in texts]
        return {key: keys, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_texts(docs, run, f"{key} {docs.schema[key].dataType.simpleString()}, lang_pred string, score double", key, text)


def predict_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4,
                      held_out: int = 2, longest: int = 3, profile: int = 400) -> DataFrame:
    """``key, held_out, lang_pred, score`` for every row of ``docs``.

    Profiles are learned from the rows whose fold (checksum of the key) is not ``held_out``; a null key is held out.
    Nulls, ties, repeats and empty tables: see ``identify``.
    """
    learning = docs.where(fold(key, folds) != held_out).select(F.col(lang), F.col(text))
    found = identify(docs, learn_profiles(learning, lang, text, longest, profile), key, text, longest, profile)
    return found.select(F.col(key), F.coalesce(fold(key, folds) == held_out, F.lit(True)).alias("held_out"),
                        "lang_pred", "score")
