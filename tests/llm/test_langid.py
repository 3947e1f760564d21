import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from checks.compare import compare, oracle_connection
from waybill.llm import langid


def grams_of(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        framed = f" {word} "
        out.update(word)
        out.update(framed[i: i + 2] for i in range(len(framed) - 1))
        out.update(framed[i: i + 3] for i in range(len(framed) - 2))
    return out


def number(gram):
    codes = [0 if c == " " else ord(c) for c in gram]
    if len(codes) == 1:
        return codes[0]
    if len(codes) == 2:
        return (codes[0] << 21 | codes[1]) + (1 << 42)
    return -(codes[0] << 42 | codes[1] << 21 | codes[2])


def ranked(counter, profile):
    return [g for g, _ in sorted(counter.items(), key=lambda kv: (-kv[1], number(kv[0])))[:profile]]


def brute(rows, profile):
    counts = {}
    for key, text, lang in rows:
        if key is not None and lang is not None and text is not None and zlib.crc32(str(key).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(grams_of(text))
    places = {n: {g: i for i, g in enumerate(ranked(c, profile))} for n, c in counts.items() if c}
    out = []
    for key, text, _ in rows:
        mine = ranked(grams_of(text or ""), profile)
        held = key is None or zlib.crc32(str(key).encode()) % 4 == 2
        if not mine or not places:
            out.append((key, held, "und", 0.0))
            continue
        d, name = min((sum(abs(i - p[g]) if g in p else profile for i, g in enumerate(mine)), n) for n, p in places.items())
        out.append((key, held, name, 1.0 - d / (len(mine) * profile)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr(
        "*", "lang AS lang_pred", "text AS gram", "1 AS n", "2 AS rank", "0.5 AS score", "true AS held_out").repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    stems = {"aa": ["ther", "ing", "wat", "ön"], "bb": ["lich", "schü", "tz", "ung"], "cc": ["ция", "ста", "пере", "ку"]}
    rows = [(i, " ".join("".join(rng.choice(stems[n], 2)) for _ in range(rng.integers(1, 30))), str(n))
            for i, n in enumerate(rng.choice(list(stems), 120))]
    long = " ".join("".join(rng.choice(stems["bb"], 3)) for _ in range(90_000))  # more than one block
    rows = [(i, str(t), n) for i, t, n in rows]
    return rows + [(500, None, "aa"), (501, "", "bb"), (502, "12 !? \n", "cc"), (503, "thering", None), (503, "thering", None),
                   (None, "lichung", "bb"), (504, long, "bb"), (505, "a", "aa"), (506, "İstanbul ﬁne ǅ", "aa"), (None, None, None)]


def test_against_brute_force(spark, rows, batches):
    got = langid.predict_languages(frame(spark, rows), profile=60).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 60)


def test_counts_do_not_depend_on_blocks(rows, monkeypatch):
    texts = [t for _, t, _ in rows if t]
    monkeypatch.setattr(langid, "_BLOCK", 50)
    for t in texts[-12:]:
        grams, counts = langid.ngrams(t[:5000], 3)
        assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == {number(g): n for g, n in grams_of(t[:5000]).items()}


def test_nothing_learned(spark, rows):
    df = frame(spark, rows)
    assert {(r.lang_pred, r.score) for r in langid.identify(df, {}).collect()} == {("und", 0.0)}
    assert langid.predict_languages(df.where("false")).count() == 0


def test_too_many_languages(spark):
    df = frame(spark, [(i, "text", f"l{i}") for i in range(40)])
    with pytest.raises(ValueError):
        langid.learn_profiles(df, profile=2, max_languages=3)


def test_held_out_accuracy(spark, sf_dir):
    found = entry.queries()["op11_language_profiles"](spark, sf_dir).where("held_out").join(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found) > 0


@pytest.mark.parametrize("name", ["op9_license_scan", "op11_language_profiles", "op12_prefix_trie", "op13_hard_negatives"])
def test_queries_match_sql(spark, sf_dir, name):
    _, problem, _ = compare(spark, oracle_connection(sf_dir), name, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert problem is None, problem
