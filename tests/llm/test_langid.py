"""Language identification against plain code lengths, on held-out rows and on odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawmill.llm import langid, queries
from lawmill.sources.tables import table


def plain_length(text, tree, kept):
    """Bits of a text: ``tree`` has counts by context, ``kept`` the contexts that may be used."""

    def full(context):
        """The distribution of a context over all bytes, by the definition."""
        if context not in memo:
            below = full(context[1:]) if context else [1 / 256] * 256
            counts = tree.get(context, {}) if context in kept else {}
            if not counts:
                memo[context] = below
            else:
                whole = sum(counts.values()) + len(counts)
                rest = sum(p for b, p in enumerate(below) if b not in counts)
                memo[context] = [counts[b] / whole if b in counts else len(counts) / whole * below[b] / rest for b in range(256)]
        return memo[context]

    memo, bits, data = {}, 0.0, b"\0\0\0" + text.encode()
    for at in range(3, len(data)):
        context = data[at - 3 : at]
        while context not in kept:
            context = context[1:]
        bits -= math.log2(full(context)[data[at]])
    return bits


def test_code_lengths_against_plain_trees(spark):
    random.seed(1)
    texts = [(lang, "".join(random.choice(letters) for _ in range(random.randrange(0, 60)))) for lang, letters in (("a", "aab é"), ("b", "abcd ")) for _ in range(40)]
    model = langid.fit(spark.createDataFrame([*texts, ("a", texts[0][1]), (None, "zzz"), ("c", None), ("c", "")], "lang string, text string"))
    assert model.names == ["a", "b"]
    trees = {"a": {}, "b": {}}
    for lang, text in set(texts):
        data = b"\0\0\0" + text.encode()
        for at in range(3, len(data)):
            for k in range(4):
                trees[lang].setdefault(data[at - k : at], Counter())[data[at]] += 1
    total = Counter({c: sum(sum(t.get(c, {}).values()) for t in trees.values()) for c in {*trees["a"], *trees["b"]}})
    kept = {c for c, n in total.items() if n >= langid.LEAST or not c} | {b""}
    asked = ["", "a", "abba é", "dcba", "ß", "zzzzz", "ab" * 500, "\0a"]
    got = langid.Scorer(model).lengths(asked) / langid.UNIT
    want = [[plain_length(t, trees[x], kept) for x in "ab"] for t in asked]
    assert np.allclose(got, want, atol=2e-5 * 1000)
    assert np.allclose(np.exp2(-langid.Scorer(model).costs.reshape(-1, 256, 2) / langid.UNIT).sum(axis=1), 1, atol=1e-3)  # each context's chances add up


def test_parts_of_long_texts(monkeypatch):
    random.seed(2)
    grams = np.array([random.randrange(1 << 32) for _ in range(500)], np.int64)
    scorer = langid.Scorer(langid.build(["x", "y"], grams, np.random.default_rng(0).integers(0, 9, (500, 2))))
    texts = ["".join(random.choice("abé\0 z") for _ in range(n)) for n in (0, 5, 0, 3000, 1, 77, 0)]
    whole = scorer.lengths(texts)
    monkeypatch.setattr(langid, "SLICE_BYTES", 50)
    assert (scorer.lengths(texts) == whole).all()
    assert (np.concatenate([scorer.lengths([t]) for t in texts]) == whole).all()


@pytest.mark.parametrize("folder, least", [("/root/testdata/sf0.001", 0.9), ("/root/testdata/sf0.01", 0.95)])
def test_op12_held_out(spark, folder, least):
    got = queries.op12_language(spark, folder)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    judged = got.join(table(spark, folder, "documents").select("doc_id", "lang", "text"), "doc_id")
    assert judged.filter("score < 0 or score > 1 or lang_pred is null").count() == 0
    rows = judged.filter("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("hit")).collect()
    assert sum(r["hit"] for r in rows) >= least * len(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(spark.createDataFrame([("x", "abc abc"), ("y", "xyz xyz")], "lang string, text string"))
    docs = odd_docs.withColumn("lang_pred", F.lit(1)).withColumn("text", F.when(F.col("doc_id") == 4, F.repeat(F.lit("abc "), 40000)).otherwise(F.col("text")))
    got = langid.identify(docs, model)
    assert sorted(got.columns) == sorted([*docs.columns, "lang_score"])
    rows = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in got.filter("doc_id is not null").collect()}
    assert rows[2] == rows[3] == rows[5] == rows[6] == ("und", 0.0) and rows[4] == ("x", 1.0) and rows[1][0] == "x"
    assert langid.identify(no_docs, model).count() == 0
    nothing = langid.fit(spark.createDataFrame([], "lang string, text string"))
    assert {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}
