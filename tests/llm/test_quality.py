import collections
import random
import re
import zlib

import numpy as np
import pytest

from waybill.llm import licenses, quality_rules, resampling, toxicity

WORD = r"[^\x20\x09-\x0D]+"


def figures_by_force(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i: i + 8]) for i in range(len(words) - 7)]
    count, marked = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            marked.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked))


def test_figures_against_brute_force(spark, odd, odd_rows, batches):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "ça", "d\n", "#x", "\x0b", "e f"]) for _ in range(n)) for n in range(0, 80)]
    for t in [*texts, *(r[1] for r in odd_rows)]:
        f = quality_rules.text_figures((t or "").encode())
        assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"]) == figures_by_force(t)
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == len(odd_rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)
    assert not any(r.kept for r in rows if r.base_failed)
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.judge(odd.where("false")).count() == 0


def test_maximisation_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    votes = np.where(good[:, None], rng.choice([-1, 0, 1], (20_000, 5), p=[0.02, 0.3, 0.68]),
                     rng.choice([-1, 0, 1], (20_000, 5), p=[0.6, 0.3, 0.1]))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit(patterns, counts.astype(float))
    assert abs(model["share_good"] - 0.8) < 0.02
    assert np.abs(model["table"]["bad"][:, 0] - 0.6).max() < 0.05
    judged = quality_rules.posterior(votes, model["table"], model["share_good"]) >= 0.5
    assert (judged == good).mean() > 0.98


def test_no_bad_vote_no_rejection():
    """Where all text is good, nothing without a bad vote is rejected."""
    patterns, counts = np.array([[1, 1, 1], [0, 1, 1], [0, 0, 0]]), np.array([900.0, 90.0, 10.0])
    model = quality_rules.fit(patterns, counts)
    assert (quality_rules.posterior(patterns, model["table"], model["share_good"]) >= 0.5).all()


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(6)
    syllables = ["an", "ter", "mo", "li", "sha", "ver", "on", "ti"]
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(max(2, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(["zgrumpf", "quorbel", "zgrumpf" + rng.choice(syllables)]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), 1))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "an ter")], "doc_id bigint, text string")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (5, None, 0)], "doc_id bigint, toxic int, quality int")


def test_toxicity_on_held_out_rows(insults, batches):
    docs, labels = insults
    rows = toxicity.classify(docs, labels, slots=1 << 16).collect()
    assert len(rows) == 603 and all(0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.doc_id is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in known)
    held = [r for r in known if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    assert all(r.predicted == 0 for r in rows if r.doc_id in (1000, 1001))
    kept = toxicity.keep_ordinary(docs, labels, slots=1 << 16)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == 0 for r in rows)


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = toxicity.classify(odd, none, slots=1 << 10).collect()
    assert len(rows) == odd.count() and all(r.predicted == 0 for r in rows)
    assert toxicity.classify(odd.where("false"), none, slots=1 << 10).count() == 0


def test_kneser_ney_by_hand(spark):
    """Continuation counts of a tiny corpus, and likelihoods that sum to one over the alphabet."""
    rows = spark.createDataFrame([(0, "aba ab"), (1, "cab")], "label int, text string")
    grams = toxicity.gram_counts(rows, "label", 2)
    model = toxicity.learn(grams, 2, 1 << 12)
    at = lambda g: zlib.crc32(g.encode()) & ((1 << 12) - 1)
    assert (model.top[0][at("ab")], model.top[1][at("ab")]) == (2, 1)
    assert model.low[1][at("b")] == 1 and model.low[1][at("a")] == 3  # a follows the start mark, b and c
    assert model.top_total[0][at("a")] == 3 and model.top_types[0][at("a")] == 2


def test_importance_prefers_the_target(spark, odd, batches):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["good", "fine", "nice"] if i % 2 else ["junk", "spam", "fine"]) for _ in range(40)))
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = resampling.select(docs, docs.where("doc_id % 2 = 1 AND doc_id < 200"), k=150, n_buckets=1 << 12).collect()
    chosen = [r.doc_id for r in got if r.selected]
    assert len(chosen) == 150 and all(i % 2 for i in chosen)
    top = sorted((r.noisy for r in got), reverse=True)[149]
    assert all(r.selected == (r.noisy >= top - 1e-5) for r in got)
    assert resampling.select(odd, odd, share=0.5, n_buckets=256).count() == odd.count()
    assert resampling.select(odd.where("false"), odd, share=0.5, n_buckets=256).count() == 0


def test_gumbel_sampling_follows_importance(spark):
    from pyspark.sql import functions as F

    n = 40_000
    weights = spark.range(n).withColumn("w", F.log(F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0)))
    noisy = weights.withColumn("place", resampling.ordered(F.col("w") + resampling.gumbel("id", 5)))
    bar = resampling.kth_largest(noisy, "place", 400)
    chosen = noisy.where(F.col("place") >= bar)
    assert abs(chosen.count() - 400) <= 1
    assert abs(chosen.where("id % 2 = 0").count() / 400 - 0.75) < 0.08


@pytest.mark.parametrize("k", [1, 2, 5, 6])
def test_kth_largest(spark, k):
    values = spark.createDataFrame([(v,) for v in (-(1 << 62), -5, -5, 0, 7, 1 << 61)], "place bigint")
    assert resampling.kth_largest(values, "place", k) == sorted(
        (-(1 << 62), -5, -5, 0, 7, 1 << 61), reverse=True)[k - 1]
    assert resampling.kth_largest(values, "place", 7) is None


def test_licenses_against_brute_force(spark, odd, odd_rows):
    extra = [(20, "Intro line\nLicensed under the Apache License, Version 2.0.\nmore"), (21, "released UNDER the MIT license"),
             (22, "Released under the MIT"), (23, licenses.TEMPLATES["MIT-grant"].replace(", ", ",\n"))]
    docs = spark.createDataFrame([(r[0], r[1]) for r in odd_rows] + extra, "doc_id bigint, text string")

    def expected(text):
        flat = re.sub("[^a-z0-9\n]+", " ", (text or "").lower())
        blocks = [b for b in [*flat.split("\n"), flat.replace("\n", " ")] if len(b.split()) >= 2]
        names, best, hits = set(), None, 0
        for b in blocks:
            grams, hit = set(licenses.bigrams(b)), False
            for name, t in licenses.TEMPLATES.items():
                other = set(licenses.bigrams(t))
                dice = 2 * len(grams & other) / (len(grams) + len(other))
                if dice >= 0.8:
                    hit = True
                    names.add(name)
                    best = min(best or (0.0, ""), (-dice, name))
            hits += hit
        return len(blocks), hits, ",".join(sorted(names)), best and best[1]

    got = sorted((str(r.doc_id), r.n_blocks, r.n_hits, r.licenses, r.best_license or "") for r in licenses.scan(docs).collect())
    want = sorted((str(k), a, b, c, d or "") for k, t in [*[(r[0], r[1]) for r in odd_rows], *extra]
                  for a, b, c, d in [expected(t)])
    assert got == want
    plan = licenses.scan(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange hash" not in plan
    assert licenses.scan(odd.where("false")).count() == 0


def test_variety_does_not_depend_on_length(spark):
    """A text of few different words gets the same share of them, however long it is."""
    shares = []
    for n in (300, 3000, 30_000):
        f = quality_rules.text_figures(" ".join(f"w{i % 9}" for i in range(n)).encode())
        shares.append(f["n_varied"] / f["n_words"])
    assert max(shares) < 0.05
    plain = quality_rules.text_figures(" ".join(f"w{i}" for i in range(5000)).encode())
    assert plain["n_varied"] == plain["n_words"] == 5000


def test_word_shapes_do_not_depend_on_blocks(monkeypatch):
    text = ("Plain words, SHOUTED ones AND x1 2y ünd ÄÖ " * 200).encode()
    whole = quality_rules.text_figures(text)
    monkeypatch.setattr(quality_rules, "_BLOCK", 64)
    assert quality_rules.text_figures(text) == whole


def test_scores_do_not_depend_on_parts(monkeypatch):
    texts = [b"", b"one", b"aa bb cc " * 50, b"dd" * 500 + b" ee", b"ff gg"]
    for size in (1, 7, 100, 1 << 18):
        whole = [b""] * len(texts)
        for part in toxicity.parts_of(texts, size):
            for i, t in part:
                whole[i] += t
        assert whole == texts
