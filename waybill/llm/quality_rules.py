"""Weak supervision of text quality.

Rules look at plain figures of a text and vote bad (-1), good (+1) or abstain (0).  No rule is trusted as such:
expectation-maximisation over the vote patterns of all documents estimates how often each rule votes each way on good and
on bad text, and a document is kept by its posterior probability of being good, not by passing every rule.

Only the counts of vote patterns reach the driver, at most 3^rules of them, whatever the number of documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, append_figures, map_texts, shingle_hashes, word_hashes, word_spans

SYMBOLS = b"#*$%&|<>"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_plain", "n_shouted",
           "n_stutter", "n_marks", "n_varied")
#: Words of the shortest stretch in which different words are counted.
STRETCH = 200


def text_figures(data: bytes, window: int = 8) -> dict[str, int]:
    """Figures of one text, given as UTF-8.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that repeat an earlier line),
    n_repeat_words (words in windows of ``window`` words found twice or more, the first included), n_lines (lines with a
    word), n_plain (words of letters, at most one closing mark), n_shouted (words without small letters), n_stutter
    (words equal to the one before), n_marks (exclamation and question marks), n_varied (different words of each stretch, all
    stretches added up; a text is parted evenly into stretches of 200 words or more).  Repeats are
    found by 64-bit hashes of words.
    """
    raw = np.frombuffer(data, np.uint8)
    counts = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, np.int64)
    hashes = word_hashes(data)
    n = len(hashes)
    chars = int(counts[:0x80].sum() + counts[0xC0:].sum())
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    out = {"n_words": n, "word_chars": chars - int(counts[9:14].sum() + counts[32]),
           "n_symbols": int(counts[list(SYMBOLS)].sum()), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
           "n_marks": int(counts[33] + counts[63]), "n_stutter": int((hashes[1:] == hashes[:-1]).sum()),
           "n_varied": _varied(hashes), "n_repeat_words": 0, "n_plain": 0, "n_shouted": 0}
    if n >= window:
        runs = shingle_hashes(hashes, window)
        order = np.argsort(runs, kind="stable")
        same = runs[order][1:] == runs[order][:-1]
        if same.any():
            twice = np.zeros(len(runs), np.int64)
            twice[order[1:][same]] = 1
            twice[order[:-1][same]] = 1
            cover = np.cumsum(np.concatenate((twice, np.zeros(window, np.int64))))
            cover[window:] -= cover[:-window].copy()
            out["n_repeat_words"] = int((cover[:n] > 0).sum())
    if n:
        out["n_plain"], out["n_shouted"] = _word_shapes(raw)
    return out


def _varied(hashes: np.ndarray) -> int:
    """Different words of each stretch, added up; stretches are even parts of STRETCH words or more."""
    cuts = np.linspace(0, len(hashes), max(1, len(hashes) // STRETCH) + 1).astype(np.int64)
    return sum(len(set(hashes[a:b].tolist())) for a, b in zip(cuts, cuts[1:], strict=False))


#: Bytes whose word shapes are looked at in one go.
_BLOCK = 1 << 18

#: Classes of bytes: 1 white space, 2 letter (bytes of longer characters count as letters), 4 small letter,
#: 8 mark that may close a word.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 6
_CLASS[128:] = 2
_CLASS[[33, 39, 41, 44, 45, 46, 58, 59, 63, 34]] = 8


def _word_shapes(raw: np.ndarray) -> tuple[int, int]:
    """Plain and shouted words, in blocks that are cut between words."""
    starts, ends = word_spans(raw)
    plain = shouted = first = 0
    while first < len(starts):
        left = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, left + _BLOCK)))
        kind = _CLASS[raw[left: ends[last - 1]]]
        s, e = starts[first:last] - left, ends[first:last] - left

        def within(flag: np.ndarray, s: np.ndarray = s, e: np.ndarray = e) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
            return total[e] - total[s]

        letters, small, size = within(kind & 2 > 0), within(kind & 4 > 0), e - s
        closed = (kind[e - 1] == 8).astype(np.int64)
        plain += int(((letters >= 1) & (letters + closed >= size)).sum())
        shouted += int(((letters >= 2) & (small == 0) & (raw[starts[first:last]] < 128)).sum())
        first = last
    return plain, shouted


def figures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and FIGURES for every row; a null or empty text has zeros throughout."""
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list[bytes]) -> dict:
        rows = [text_figures(t) for t in texts]
        return {key: keys} | {n: [r[n] for r in rows] for n in FIGURES}

    return map_texts(docs, run, f"{key} {kind}, " + ", ".join(f"{n} bigint" for n in FIGURES), key, text)


def base_failed() -> Column:
    """Too short, or more than 30 % of the words in repeated windows: no rule is asked."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by rule; every share is of words or lines, so no rule depends on a text's length."""
    def share(name: str, of: str = "n_words") -> Column:
        return F.col(name) / F.greatest(F.col(of), F.lit(1))

    return {
        "plain_words": _vote(share("n_plain") < 0.75, share("n_plain") >= 0.93),
        "symbols": _vote(share("n_symbols") > 0.15, F.lit(False)),
        "shouting": _vote(share("n_shouted") > 0.4, share("n_shouted") < 0.1),
        "marks": _vote(share("n_marks") > 0.3, F.lit(False)),
        "stutter": _vote(share("n_stutter") > 0.2, share("n_stutter") < 0.02),
        "repeated_lines": _vote(share("n_dup_lines", "n_lines") > 0.3, F.col("n_dup_lines") == 0),
        "repeated_words": _vote(share("n_repeat_words") > 0.15, F.col("n_repeat_words") == 0),
        "word_length": _vote((share("word_chars") < 2.5) | (share("word_chars") > 14),
                             share("word_chars").between(3.5, 9.5)),
        "variety": _vote(share("n_varied") < 0.2, F.lit(False)),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, strength: float = 20.0) -> dict:
    """Vote probabilities given good and bad text, by expectation-maximisation with fixed prior counts.

    ``patterns`` has one row per vote pattern, one column per rule.  ``strength`` prior documents per class keep the
    classes from changing places and rules that hardly vote from running to 0 or 1.
    """
    votes = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    prior = {"good": np.array([0.02, 0.38, 0.60]), "bad": np.array([0.35, 0.35, 0.30])}
    table = {c: np.tile(p, (patterns.shape[1], 1)) for c, p in prior.items()}
    share_good = 0.85
    for _ in range(rounds):
        post = posterior(patterns, table, share_good)
        for c, weight in (("good", counts * post), ("bad", counts * (1 - post))):
            seen = np.einsum("p,pjv->jv", weight, votes) + strength * prior[c]
            table[c] = seen / seen.sum(axis=1, keepdims=True)
        new = (float((counts * post).sum()) + 0.85 * strength) / (counts.sum() + strength)
        if abs(new - share_good) < 1e-9:
            break
        share_good = new
    return {"table": table, "share_good": share_good}


def weights(table: dict[str, np.ndarray]) -> np.ndarray:
    """Log-odds a vote adds, (rules, 3): never against the vote's own sense, and none for an abstention."""
    w = np.log(table["good"] / table["bad"])
    w[:, 0], w[:, 1], w[:, 2] = np.minimum(w[:, 0], 0), 0, np.maximum(w[:, 2], 0)
    return w


def posterior(patterns: np.ndarray, table: dict[str, np.ndarray], share_good: float) -> np.ndarray:
    w = weights(table)
    odds = np.log(share_good / (1 - share_good)) + w[np.arange(patterns.shape[1]), patterns + 1].sum(axis=1)
    return 1 / (1 + np.exp(-odds))


def learn(figures_: DataFrame) -> tuple[float, dict[str, tuple[float, float]]]:
    """Prior log-odds and, by rule, the log-odds of a bad and of a good vote, from the figures of all documents."""
    known = rules()
    names = [f"vote_{n}" for n in known]
    rows = (
        figures_.where(~base_failed()).select(*[v.alias(f"vote_{n}") for n, v in known.items()])
        .groupBy(*names).count().collect())  # at most 3^len(rules)
    patterns = np.array([r[:-1] for r in rows], np.int64).reshape(len(rows), len(names))
    model = fit(patterns, np.array([r[-1] for r in rows], float))
    prior = float(np.log(model["share_good"] / (1 - model["share_good"])))
    return prior, {n: (w[0], w[2]) for n, w in zip(known, weights(model["table"]).tolist(), strict=True)}


def p_good(model: tuple[float, dict[str, tuple[float, float]]]) -> Column:
    """Posterior probability of good text, over the figures; null where the base test fails."""
    odds, known = F.lit(model[0]), rules()
    for name, (bad, good) in model[1].items():
        odds = odds + F.when(known[name] == -1, bad).when(known[name] == 1, good).otherwise(0.0)
    return F.when(~base_failed(), 1 / (1 + F.exp(-odds)))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_at: float = 0.5) -> DataFrame:
    """``key``, FIGURES, ``base_failed``, ``p_good`` and ``kept`` for every row.

    A null or empty text has zero figures and fails the base test (``p_good`` null, ``kept`` false).  Repeated rows and
    null keys are judged row by row.  An empty table gives an empty result.  Further columns are ignored.
    """
    seen = Scratch(docs.sparkSession).put(figures(docs, key, text), "figures")
    out = seen.withColumns({"base_failed": base_failed(), "p_good": p_good(learn(seen))})
    return out.select(key, *FIGURES, "base_failed", "p_good",
                      (F.coalesce(F.col("p_good"), F.lit(0.0)) >= keep_at).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judge`` keeps."""
    def run(texts: list[bytes]) -> dict:
        rows = [text_figures(t) for t in texts]
        return {n: [r[n] for r in rows] for n in FIGURES}

    schema = ", ".join(f"{n} bigint" for n in FIGURES)
    figures_ = Scratch(docs.sparkSession).put(append_figures(docs.select(text), run, schema, text).select(*FIGURES), "figures")
    judged = append_figures(docs, run, schema, text).where(F.coalesce(p_good(learn(figures_)), F.lit(0.0)) >= keep_at)
    return judged.select("row.*")
