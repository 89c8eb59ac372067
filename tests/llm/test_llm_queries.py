"""Contract queries against SQL, brute force or an exact round trip, on the smallest tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import same_rows

from lawmill.llm import decontam, queries, simhash, spm, tiff, toxicity, urlrules
from lawmill.sources.tables import table


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(name, spark, sf_dir, duck):
    ours, theirs = same_rows(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])
    assert ours == theirs


def brute_components(ids, prints):
    prints = np.array(prints, np.uint64)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i, doc in enumerate(ids):
        groups.setdefault(find(i), []).append(doc)
    return {doc: min(g) for g in groups.values() for doc in g}


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(grams))


def test_op4_against_brute_force(spark, sf_dir):
    got = queries.op4_simhash(spark, sf_dir).toPandas()
    docs = table(spark, sf_dir, "documents").toPandas()
    prints = [plain_fingerprint(t) for t in docs.text]
    assert dict(zip(got.doc_id, got.fingerprint)) == {d: f"{p:016x}" for d, p in zip(docs.doc_id, prints)}
    assert dict(zip(got.doc_id, got.component_id)) == brute_components(docs.doc_id.tolist(), prints)


def test_links_keep_every_component(spark):
    rng = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):  # chains of near fingerprints, at every distance up to six
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(x)
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    from lawmill.llm.components import connected_components

    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = brute_components(signed, prints)
    assert {s: roots.get(s, s) for s in signed} == want


def test_op5_round_trip_of_controls(spark, sf_dir):
    row = queries.op5_chat(spark, sf_dir).filter("conv_id = -1").collect()[0]
    text = "<|im_end|><|im_start|>assistant ok"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text)
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_op9_reads_back_the_payload(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op9_tiff(spark, sf_dir).collect()}
    for doc in table(spark, sf_dir, "documents").collect():
        raw = doc["text"].encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        row = got[doc["doc_id"]]
        assert (row["n_bytes"], row["payload_bytes"]) == (len(raw), len(payload))
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest() and row["tail_crc32"] == zlib.crc32(payload[-64:])
        stored = tiff.store_text(doc["text"], zlib.crc32(raw) % len(tiff.LAYOUTS))
        assert (row["media_bytes"], row["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        feature = dict(x.split("=") for x in row["feature"].split(";"))
        samples = np.frombuffer(payload, np.uint8).astype(float)
        assert int(feature["rows"]) * 64 == len(payload) and int(feature["pages"]) == -(-len(payload) // (64 * 4096))
        assert abs(float(feature["mean"].replace(",", "")) - samples.mean()) < 1e-5 and abs(float(feature["deviation"]) - samples.std()) < 1e-5


def test_op9_writes_each_file_once(spark, sf_dir):
    """The bytes that are hashed are the bytes that are read: one call of the writer in the plan."""
    plan = queries.op9_tiff(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.count("_text_to_tiff(") for line in plan.splitlines() if "ArrowEvalPython" in line) == 1


def test_op8_equals_the_library(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=spm.TOKENIZER)
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    for row in queries.op8_sentencepiece(spark, sf_dir).collect():
        assert row["ids"] == model.encode(texts[row["doc_id"]]) and row["lossless"]


def test_encoder_equals_the_library_on_odd_texts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=spm.TOKENIZER)
    encoder = spm.Encoder(spm.load_vocabulary())
    rng = random.Random(8)
    parts = ["a", "b", "e", "th", "in", "er", " ", "  ", "   ", "the", "▁", "\n", "\t", "é", "ß", "漢", "😀", "\x00", "1", "22", ".", "ing", "tion"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", " ", " " * 33 + "x", "é" * 400, "the" * 500]
    assert [x.tolist() for x in encoder.encode(texts)] == model.encode(texts)
    assert [x.tolist() for x in encoder.encode(texts[:50])] == model.encode(texts[:50])  # from what it remembers


def test_long_words_equal_the_library_and_take_little_time():
    """Words without blanks: base64-like, one letter, syllables, characters in no piece; five times as long, less than fifteen times the time."""
    import time

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=spm.TOKENIZER)
    encoder = spm.Encoder(spm.load_vocabulary())
    rng = random.Random(11)
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "a", ["th", "er", "ing", "tion"], "漢字仮名交文", ["é", "x", "漢", "😀", "ab"]):
        took = []
        for n in (4_000, 20_000):
            text = "".join(rng.choice(letters) for _ in range(n))
            began = time.time()
            got = encoder.encode([text])[0].tolist()
            took.append(time.time() - began)
            assert got == model.encode(text)
        assert took[1] < 15 * max(took[0], 0.1), (letters, took)


def test_op2_against_exact_search(spark, sf_dir):
    word = re.compile(r"\w+")
    items = {r["item_id"]: word.findall(r["text"].lower()) for r in table(spark, sf_dir, "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_decontamination(spark, sf_dir).collect()}
    whole = set()
    for doc in table(spark, sf_dir, "documents").collect():
        text = " " + " ".join(word.findall(doc["text"].lower())) + " "
        whole |= {(doc["doc_id"], i) for i, w in items.items() if " " + " ".join(w) + " " in text}
    assert whole and whole <= got


def brute_overlap(doc, item):
    """Whether any alignment is equal in four fifths of the item or has 13 equal tokens in its best stretch (+1 and -4 a token)."""
    for shift in range(1 - len(item), len(doc)):
        gain = matched = total = 0
        best = (0, 0)
        for k in range(max(0, -shift), min(len(item), len(doc) - shift)):
            same = doc[shift + k] == item[k]
            gain, matched, total = (gain + 1, matched + 1, total + 1) if same else (gain - 4, matched, total)
            if gain <= 0:
                gain = matched = 0
            elif gain > best[0]:
                best = (gain, matched)
        if best[1] >= 13 or 5 * total >= 4 * len(item):
            return True
    return False


def test_overlaps_against_brute_force(spark):
    """Two-sided: copies of items of 4 to 60 tokens with up to two fifths of their tokens replaced, whole and cut."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    items = {n: [rng.choice(words) for _ in range(n)] for n in range(4, 61)}
    docs = {}
    for n, item in items.items():
        for k in range(0, 2 * n // 5 + 1, max(1, n // 12)):
            copy = list(item)
            for at in rng.sample(range(n), k):
                copy[at] = "other"
            if k % 3 == 2:
                copy = copy[n // 3 :]
            docs[len(docs)] = [rng.choice(words) for _ in range(rng.randint(0, 30))] + copy + [rng.choice(words) for _ in range(rng.randint(0, 30))]
    want = {(d, i) for d, doc in docs.items() for i, item in items.items() if brute_overlap(doc, item)}
    found = decontam.find_contamination(
        spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string"),
    )
    got = {(r["doc_id"], c["item_id"]) for r in found.collect() for c in r["contamination"]}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 150
    assert {(d, i) for d, i in want if i < decontam.SHORT} <= got


def test_recall_by_length():
    """Random substitution of a fifth of an item: at least 0.95 share a seed, all of the short ones."""
    rng = np.random.default_rng(2)
    for n in (*range(4, 30), 40, 60):
        item = rng.integers(0, 1 << 62, n).astype(np.uint64)
        wanted = [decontam.seeds(item, mask, number) for number, mask in decontam.masks_of(n)]
        found, turns = 0, 400
        for _ in range(turns):
            copy = item.copy()
            copy[rng.choice(n, n // 5, replace=False)] = rng.integers(0, 1 << 62, n // 5)
            found += any((decontam.seeds(copy, mask, number) == w).any() for (number, mask), w in zip(decontam.masks_of(n), wanted))
        assert found == turns if n < decontam.SHORT else found >= 0.95 * turns, (n, found)


def test_benchmark_blocks_agree(spark, sf_dir):
    docs, benchmark = (table(spark, sf_dir, n) for n in ("documents", "benchmark"))
    one, many = (decontam.find_contamination(docs, benchmark, n).select("doc_id", "contamination") for n in (10**6, 300))
    flat = lambda df: {r["doc_id"]: sorted(map(tuple, r["contamination"])) for r in df.collect()}
    assert flat(one) == flat(many)


def test_op1_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels.filter("doc_id % 3 > 0"))
    scored = toxicity.score(docs.join(labels.filter("doc_id % 3 = 0"), "doc_id"), model).select("toxic", "toxicity.*").toPandas()
    right = (scored.toxic_probability >= 0.5) == (scored.toxic > 0)
    assert right.mean() > 0.97 and (scored.severity[scored.toxic > 0].mean() > scored.severity[scored.toxic == 0].mean() + 1)
    assert model.thresholds == sorted(model.thresholds)


def plain_score(text, model):
    """Expected severity, likeliest grade and P(grade > 0) of a text, word by word."""
    import math

    import xxhash

    total = 0.0
    for word in set(re.findall(r"\w+", (text or "").lower())):
        for name in [word] + [word[:n] + "*" for n in (3, 4, 5, 6, 7) if len(word) >= n]:
            total += model.weights.get(xxhash.xxh3_64_intdigest(name.encode()) - 2**63, 0.0)
    over = [1 / (1 + math.exp(min(60, max(-60, t - total)))) for t in model.thresholds]
    each = [a - b for a, b in zip([1.0, *over], [*over, 0.0])]
    return sum(over), each.index(max(each)), over[0]


def test_op1_scores_against_plain_sums(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.weights and len(model.thresholds) == 3
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, sf_dir).collect()}
    for doc in docs.collect():
        severity, grade, probability = plain_score(doc["text"], model)
        row = got[doc["doc_id"]]
        assert abs(row["severity"] - severity) < 1e-6 and row["grade"] == grade and row["toxic"] == (probability >= 0.5)


def test_op1_fit_is_the_likeliest():
    """No small change of a weight or threshold raises the penalised likelihood of the fitted model."""
    rng = np.random.default_rng(4)
    n, features = 400, 12
    held = rng.random((n, features)) < 0.3
    true = np.r_[2.0, -2.0, 1.0, np.zeros(features - 3)]
    grade = (rng.logistic(size=n)[:, None] < (held @ true)[:, None] - np.array([0.5, 1.5, 2.5])).sum(axis=1)
    row, column = np.nonzero(held)
    weights, cuts = toxicity.fit_ordinal(row, column, features, grade, l1=0.002, steps=4000)

    def value(w, t):
        score = held @ w
        low, high = np.r_[-np.inf, t][grade], np.r_[t, np.inf][grade]
        inside = 1 / (1 + np.exp(low - score)) - 1 / (1 + np.exp(high - score))
        return np.log(inside).mean() - 0.002 * np.abs(w).sum()

    best = value(weights, cuts)
    for k in range(features + 3):
        for step in (-0.05, 0.05):
            w, t = weights.copy(), cuts.copy()
            (w if k < features else t)[k if k < features else k - features] += step
            assert value(w, t) <= best + 1e-6, k
    assert weights[0] > 1 > -1 > weights[1]


def brute_listed(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, kind) for kind, h, p in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_op3_against_brute_force(spark, sf_dir):
    got = queries.op3_url_rules(spark, sf_dir).collect()
    urls = {r["page_id"]: r["url"] for r in table(spark, sf_dir, "pages").collect()}
    assert len(got) == len(urls)
    for row in got:
        host, path, rule, verdict = brute_listed(urls[row["page_id"]])
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == (verdict or ("block" if row["mined_confidence"] else "allow"))


def test_mined_rules_against_counting(spark):
    rows = [(f"https://bad.example.com/x/{i}", True) for i in range(30)] + [(f"https://bad.example.com/y/{i}?id=1", False) for i in range(30)]
    rows += [(f"https://good{i}.example.org/x/{i}", False) for i in range(40)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    rules = urlrules.mine_rules(df, 0.1, 0.8)
    found = {tuple(r["items"]): (round(r["support"], 3), round(r["confidence"], 3)) for r in rules.collect()}
    assert found[("host=bad.example.com", "path=x")] == (0.3, 1.0) and ("path=x",) not in found and ("host=bad.example.com",) not in found
    judged = urlrules.judge_urls(df.select("url"), rules, listed=()).collect()
    assert {r["verdict"] for r in judged if "bad" in r["url"] and "/x/" in r["url"]} == {"block"}
    assert {r["verdict"] for r in judged if "good" in r["url"] or "/y/" in r["url"]} == {"allow"}


def brute_rules(rows, min_count=5, min_confidence=0.8):
    """Minimal confident token sets, by counting every subset; of tokens held by the same rows the longest stands for all."""
    from itertools import combinations

    holders = {}
    for at, (tokens, _) in enumerate(rows):
        for t in tokens:
            holders.setdefault(t, set()).add(at)
    best = {}
    for t, rows_of in holders.items():
        if sum(rows[r][1] for r in rows_of) >= min_count:
            best[frozenset(rows_of)] = max(best.get(frozenset(rows_of), ""), t, key=lambda x: (len(x), x))
    sets = {s for tokens, bad in rows if bad for n in range(1, 6) for s in combinations(sorted(set(tokens) & set(best.values())), n)}
    sure = {}
    for s in sets:
        held = set.intersection(*(holders[t] for t in s))
        bad = sum(rows[r][1] for r in held)
        if bad >= min_count and bad / len(held) >= min_confidence:
            sure[s] = (bad, len(held))
    return {s: v for s, v in sure.items() if not any(set(o) < set(s) for o in sure)}


def test_mined_rules_and_verdicts_against_brute_force(spark):
    rng = random.Random(5)
    urls = []
    for _ in range(300):
        host = rng.choice(["a.com", "b.com", "c.b.com", "d.org"])
        url = f"http://{host}/{rng.choice('xyz')}/{rng.choice(['1', '22', 'q'])}" + rng.choice(["", "?k=1", "?k=1&j=2", "?j=3"])
        urls.append((url, rng.random() < (0.95 if host == "b.com" and "/x/" in url or "j=" in url and "/y/" in url else 0.1)))
    df = spark.createDataFrame(urls, "url string, bad boolean")
    tokens = [(r["t"], r["bad"]) for r in df.select(urlrules.url_tokens(df["url"]).alias("t"), "bad").collect()]
    want = brute_rules(tokens)
    rules = urlrules.mine_rules(df)
    got = {tuple(r["items"]): (round(r["support"] * 300), round(r["confidence"], 6)) for r in rules.collect()}
    assert got == {s: (bad, round(bad / held, 6)) for s, (bad, held) in want.items()} and got
    blocked = {r["url"] for r in urlrules.judge_urls(df.select("url"), rules, listed=()).filter("verdict = 'block'").collect()}
    assert blocked == {u for (u, _), (t, _) in zip(urls, tokens) if any(set(s) <= set(t) for s in want)}


def test_long_urls_and_few_labels_mine_quickly(spark):
    """Urls of 40 query keys, any of which may be left out, and a table of 20 labels of which no five agree."""
    rng = random.Random(6)
    keys = [f"k{i}" for i in range(40)]
    rows = [("http://a.com/?" + "&".join(rng.sample(keys, 36)), True) for _ in range(60)] + [(f"http://b{i}.com/{i}", False) for i in range(60)]
    rules = urlrules.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    assert 0 < rules.count() < 100 and max(len(r["items"]) for r in rules.collect()) <= urlrules.MAX_TOKENS
    few = [(f"http://h{i}.net/p{chr(97 + i)}?q{i}=1", i % 5 == 0) for i in range(20)]
    assert urlrules.mine_rules(spark.createDataFrame(few, "url string, bad boolean")).count() == 0


def wide_urls():
    """Urls of some 15 query keys: 14 that part bad from good better than a and b do, which are a rule together only; long rows hold it mostly."""
    rng = random.Random(7)
    urls = []
    for i in range(160):
        bad = i % 4 == 0
        both, keys = bad and i % 8 == 0, [f"decoy{k}" for k in range(14) if rng.random() < (0.95 if bad else 0.32)]
        keys += ["a", "b"] if both else [rng.choice("ab")] if rng.random() < 0.6 else []
        urls.append((f"http://h{i}.com/?" + "&".join(keys), bad))
    return urls


def test_rules_on_tokens_beyond_the_fit(spark):
    """The rule on a and b is on none of the tokens that the fit gets; all rules are those of counting every set, wherever the fit ends."""
    urls = wide_urls()
    df = spark.createDataFrame(urls, "url string, bad boolean")
    tokens = [(r["t"], r["bad"]) for r in df.select(urlrules.url_tokens(df["url"]).alias("t"), "bad").collect()]
    want = brute_rules(tokens)
    assert ("query=a", "query=b") in want and max(map(len, want)) < 5, sorted(map(len, want))
    for cut in ({}, {"max_tokens": 3}):
        rules = urlrules.mine_rules(df, **cut)
        got = {tuple(r["items"]): (round(r["support"] * len(urls)), round(r["confidence"], 6)) for r in rules.collect()}
        assert got == {s: (bad, round(bad / held, 6)) for s, (bad, held) in want.items()}
    pages = spark.createDataFrame([("http://new.com/?a&b",), ("http://new.com/?a&c",)], "url string")
    judged = {r["url"]: r["verdict"] for r in urlrules.judge_urls(pages, rules, listed=()).collect()}
    assert judged == {"http://new.com/?a&b": "block", "http://new.com/?a&c": "allow"}


def test_mined_rules_on_labels_kept_out(spark):
    """Held out: no clean page blocked by more than chance, on the larger table."""
    pages, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("pages", "labels"))
    known = pages.join(labels.select(labels["doc_id"].alias("page_id"), (labels["quality"] == 0).alias("bad")), "page_id")
    rules = urlrules.mine_rules(known.filter("page_id % 4 > 0").select("url", "bad"))
    judged = urlrules.judge_urls(known.filter("page_id % 4 = 0"), rules, listed=()).select("bad", "verdict").toPandas()
    assert ((judged.verdict == "block") & ~judged.bad).mean() < 0.02
