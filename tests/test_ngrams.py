import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lectern.operators import ngrams as NG
from lectern.plans import queries as Q


def plain_grams(word):
    m = f"_{word}_"
    return [m[i:i + n] for n in NG.SIZES for i in range(len(m) - n + 1)]


DOCS = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, "the dog and the cat", "en"),
        (4, "das haus und der garten", "de"), (5, "the house", None), (6, "12 !!", "en"), (7, None, "de"), (8, "", None)]


def test_grams(spark):
    got = spark.createDataFrame([("ab",), ("é",), ("日本語",)], "w string").select("w", NG.grams(F.col("w")).alias("g")).collect()
    for r in got:
        assert Counter(r.g) == Counter(plain_grams(r.w))


def test_posteriors_against_plain(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    counts = NG.word_counts(df)
    langs = NG.languages(df)
    assert langs == ["de", "en"]
    weights, head = NG.fit(counts, df, langs)
    got = {r.doc_id: r for r in NG.detect(counts, df, weights, head, langs).collect()}
    n, seen = defaultdict(Counter), Counter()
    for _, text, lang in DOCS:
        if lang:
            seen[lang] += 1
            for w in (text or "").split():
                if w.isalpha():
                    n[lang].update(plain_grams(w))
    size = len(set(n["de"]) | set(n["en"]))
    for i, text, _ in DOCS:
        grams = [g for w in (text or "").split() if w.isalpha() for g in plain_grams(w)]
        if not grams:
            assert (got[i].lang_detected, got[i].n_grams, got[i].margin) == ("unknown", 0, None)
            continue
        s = {x: math.log(seen[x] / sum(seen.values()))
             + sum(math.log((n[x][g] + NG.ALPHA) / (n[x].total() + NG.ALPHA * size)) for g in grams) for x in langs}
        best = max(langs, key=s.get)
        assert got[i].lang_detected == best and got[i].n_grams == len(grams)
        assert got[i].margin == pytest.approx(abs(s["de"] - s["en"]) / len(grams))


def test_words_of_rows_as_counts(spark, monkeypatch):
    """Scores in the tasks, in joins beyond the bound, and of single counts: all the same."""
    df = spark.createDataFrame([*DOCS, (1, "die Katze der the", "de"), (None, "the cat", "en"), (9, "zzz日本 qq", None)],
                               "doc_id long, text string, lang string").repartition(3)
    lists = NG.word_lists(df)
    assert "hashpartitioning" not in lists._jdf.queryExecution().executedPlan().toString()
    langs = NG.languages(df)
    got = []
    for counts, held in ((NG.word_counts(df), 0), (lists, 0), (lists, 1 << 17)):
        monkeypatch.setattr(NG, "HELD_GRAMS", held)
        weights, head = NG.fit(counts, df, langs)
        assert counts is not lists or (NG._held(weights, head) is None) == (not held)
        got.append(sorted((r.doc_id or 0, r.lang_detected, r.n_grams, -1 if r.margin is None else round(r.margin, 9))
                          for r in NG.detect(counts, df, weights, head, langs).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == len(DOCS) + 3


def test_held_out_accuracy(spark):
    rows = Q.REGISTRY["language_ngrams_accuracy"](spark, SF_SMALL).collect()
    assert rows and sum(r.n_right for r in rows) / sum(r.n_docs for r in rows) > .95
