import random
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_llm_queries import plain_score

from lawmill.llm import spm, toxicity
from lawmill.sources.tables import table


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
        assert docs.columns == table(spark, sf_dir, "documents").columns, name
    assert docs.count() < before
    clean = table(spark, sf_dir, "documents").join(labels.filter("toxic = 0"), "doc_id").count()
    assert docs.join(labels.filter("toxic = 0"), "doc_id").count() > 0.6 * clean
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.filter(~F.col("lossless")).count() == 0 and last.count() == docs.count()


def test_run_equals_its_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    ids = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert ids and len(ids) == out.count()
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=spm.TOKENIZER)
    whole = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    same = sum(model.encode(whole[d]) == i for d, i in ids.items())
    assert same > 0.5 * len(ids)  # most texts lose no line


def brute_lines(docs):
    """Line dedup in plain Python: (doc_id, text) to texts."""
    white = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(white))
    holders = {}
    for doc, text in docs.items():
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(doc)
    gone = lambda doc, line: len(holders.get(key(line), ())) >= 5 and doc != max(holders[key(line)])
    return {doc: "\n".join(line for line in text.split("\n") if not gone(doc, line)) for doc, text in docs.items()}


def brute_groups(docs):
    """The smallest doc_id of each group of 5-word Jaccard of 0.8 or more, all pairs compared."""
    sets = {}
    for doc, text in docs.items():
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
        width = min(5, len(words))
        sets[doc] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()
    root = {d: d for d in docs}
    ids = sorted(docs)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if root[a] != root[b] and 5 * both >= 4 * either:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return {d for d, r in root.items() if d == r}


def brute_contaminated(docs, items):
    """Documents of which some alignment with an item is equal in four fifths of it or in a best stretch of 13 tokens."""
    word = re.compile(r"\w+")
    found, codes = set(), {}
    numbers = lambda text: np.array([codes.setdefault(w, len(codes)) for w in word.findall(text.lower())], int)
    listed = [numbers(t) for t in items if t]
    for doc, text in docs.items():
        tokens = numbers(text)
        for item in (i for i in listed if len(i) >= 4):
            padded = np.concatenate([np.full(len(item), -1), tokens, np.full(len(item), -1)])
            equal = np.lib.stride_tricks.sliding_window_view(padded, len(item)) == item
            for line in equal[equal.sum(axis=1) >= min(13, -(-4 * len(item) // 5))]:
                gain, count, best = 0, 0, (0, 0)
                for same in line:
                    gain, count = (gain + 1, count + 1) if same else (gain - 4, count)
                    gain, count = (gain, count) if gain > 0 else (0, 0)
                    best = max(best, (gain, count), key=lambda x: x[0])
                if best[1] >= 13 or 5 * line.sum() >= 4 * len(item):
                    found.add(doc)
    return found


def test_pipeline_against_brute_force(spark, sf_dir):
    """Every stage on what the stage before kept, from the first table to the ids."""
    import sentencepiece

    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    docs = {d: t for d, t in docs.items() if plain_score(t, model)[2] < 0.5}
    docs = brute_lines(docs)
    kept = brute_groups(docs)
    docs = {d: t for d, t in docs.items() if d in kept}
    bad = brute_contaminated(docs, [r["text"] for r in table(spark, sf_dir, "benchmark").collect()])
    docs = {d: t for d, t in docs.items() if d not in bad}
    library = sentencepiece.SentencePieceProcessor(model_file=spm.TOKENIZER)
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {d: r["ids"] for d, r in out.items()} == {d: library.encode(t) for d, t in docs.items()}
    assert bad and all(r["lossless"] and r["n_ids"] == len(r["ids"]) for r in out.values())


def test_odd_rows_pass_through(spark, odd_docs, sf_dir):
    docs = odd_docs.withColumn("lang", F.lit("en"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.filter("doc_id = 4").count() == 1
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    rows = last(spark, docs, sf_dir).collect()
    assert len(rows) == docs.count() and all((r["ids"] is None) == (r["n_ids"] is None) for r in rows)
    assert last(spark, docs.limit(0), sf_dir).count() == 0


def test_run_on_odd_and_empty_tables(spark, odd_docs, sf_dir, tmp_path):
    for name, docs in (("odd", odd_docs.withColumn("lang", F.lit("en"))), ("none", odd_docs.withColumn("lang", F.lit("en")).limit(0))):
        root = str(tmp_path / name)
        docs.write.parquet(f"{root}/documents.parquet")
        for other in ("labels", "benchmark"):
            table(spark, sf_dir, other).limit(0 if name == "none" else 1000).write.parquet(f"{root}/{other}.parquet")
        out = corpus_pipeline.run(spark, root)
        ids = sorted((r["doc_id"] for r in out.collect()), key=str)
        # 1 twice, as its rows are one document; 2, 3, 5 and 6 have no words and are one group; rows without an id stay
        assert ids == ([1, 1, 2, 4, None, None] if name == "odd" else []), name


def test_near_copies_from_four_fifths_on_go(spark, sf_dir):
    """Against all pairs: copies with changed words, from a similarity near 1 to far below 0.8, and a chain."""
    rng = random.Random(6)
    texts, words = [], [f"w{i}" for i in range(5000)]
    for number in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([30, 90, 300]))]
        texts.append(text)
        for _ in range(40 if number == 0 else number % 4):
            text = list(text if number % 2 else texts[-1])
            for at in rng.sample(range(len(text)), max(1, len(text) // rng.choice([30, 50, 100]))):
                text[at] = rng.choice(words)
            texts.append(text)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, sf_dir).collect()}
    assert kept == {i for i, r in enumerate(root) if i == r} and len(kept) < len(texts) - 40
