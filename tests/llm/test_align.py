"""Alignment against the tokenizers on whole texts and plain counting; spilled runs against one dictionary."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawmill.llm import align, queries
from lawmill.sources.tables import table


@pytest.fixture(scope="module")
def tokenizers():
    return align.Tokenizers(align.TOKENIZER_A, align.TOKENIZER_B)


def plain(rows, tokenizers):
    """What the contract says, from whole texts."""
    out, holders = [], defaultdict(set)
    for k, (doc_id, text) in enumerate(rows):
        a = tokenizers.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tokenizers.b.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(tokenizers.bytes_a[i] for i in a) != want or b"".join(tokenizers.bytes_b[i] for i in b) != want:
            a, b = [], []
        ends_a, ends_b = (list(np.cumsum([len(t[i]) for i in ids])) for t, ids in ((tokenizers.bytes_a, a), (tokenizers.bytes_b, b)))
        groups, links, x, y = [], Counter(), 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[x:i], b[y:j]))
            links.update((p, q) for p in a[x:i] for q in b[y:j])
            x, y = i, j
        for pair in links:
            holders[pair].add(k)
        written = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(written.encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (a, _), docs in holders.items():
        most[a] = max(most[a], len(docs))
    return sorted(
        (
            (d, n_a, n_b, g, sum(links.values()), sum(n for p, n in links.items() if len(holders[p]) == most[p[0]]), sum(n * len(holders[p]) for p, n in links.items()), sha)
            for d, n_a, n_b, g, links, sha in out
        ),
        key=repr,
    )


ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "\n\n", "x\t y", "don't we'll I'M", "<|endoftext|> <s> </s> <0x41>", "▁a", "a▁ b c", "naïve café", "日本語のテキスト です", "😀😀 👩‍👩‍👧",
    "a" * 1000, "ab" * 3000, " a   b c", "a\x00b \x1f c", "1234567 89 0", "=" * 300 + " " + "-" * 77, "the the the the", "the the", "é" * 501, "\r\n x", "ÀÈ ùû", "a \x1c b", "x" + " " * 90 + "y",
]


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_odd_texts(spark, tokenizers):
    random.seed(5)
    rows = [(k if k % 7 else None, t) for k, t in enumerate([*ODD, *ODD])]
    rows += [(k, "".join(random.choice("ab é\n\t  the日_0'▁") for _ in range(random.randrange(1, 80)))) for k in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit(1)).withColumn("n_a", F.lit("x"))
    assert got(align.align(docs)) == plain(rows, tokenizers)
    assert align.align(docs.limit(0)).count() == 0


def test_op11_on_whole_table(spark, sf_dir, tokenizers, monkeypatch):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = plain(rows, tokenizers)
    assert got(queries.op11_alignment(spark, sf_dir)) == want


def test_many_runs_and_a_short_memory(tokenizers, monkeypatch):
    """Runs of a few documents, a memo that is forgotten, heads that are spilled often: the same counts."""
    monkeypatch.setattr(align, "REMEMBERED", 5)
    monkeypatch.setattr(align, "SPILL_ROWS", 40)
    monkeypatch.setattr(align, "BLOCK_ROWS", 16)
    texts = [t or "" for t in ODD] + ["the cat sat", "the dog sat on the cat", "cat dog"] * 5
    aligner = align.Aligner(tokenizers)
    runs = [align.make_run(str(k), list(range(k, k + 4)), texts[k : k + 4], aligner, 7) for k in range(0, len(texts), 4)]
    counter, want = align.SpillCounter(), Counter()
    for run in runs:
        for _, n_pairs, n_records, heads, body in run[-1]:
            gaps, n = align._unframed(heads, 2)
            counter.add(np.cumsum(gaps), n)
            want.update(dict(zip(np.cumsum(gaps).tolist(), n.tolist())))
            assert len(gaps) == n_pairs and n.sum() == n_records == len(align._unframed(body, 2)[0])
    pairs, coded = align.with_best(counter.counts())
    assert len(counter.runs) > 3 and dict(zip(pairs.tolist(), (coded >> 1).tolist())) == want
    most = defaultdict(int)
    for pair, n in want.items():
        most[pair >> 20] = max(most[pair >> 20], n)
    assert all((c & 1) == (c >> 1 == most[p >> 20]) for p, c in zip(pairs.tolist(), coded.tolist()))


def test_a_group_of_many_tokens(tokenizers, monkeypatch):
    """Links of groups over the bound are counted by distinct ids, with the same numbers."""
    texts = [t for t in ODD if t]
    one = align.make_run("r", list(range(len(texts))), texts, align.Aligner(tokenizers), 3)
    monkeypatch.setattr(align, "MANY", 1)
    assert align.make_run("r", list(range(len(texts))), texts, align.Aligner(tokenizers), 3) == one
