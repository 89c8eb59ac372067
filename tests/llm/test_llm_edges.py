"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from lawmill.llm import chat, components, decontam, licenses, linededup, secret_scan, simhash, spm, tiff, toxicity, urlrules


def test_linededup(spark, odd_docs, no_docs):
    out = linededup.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, odd_docs.select("doc_id", "text").collect()))
    assert linededup.dedup_lines(no_docs).count() == 0
    line = "A common line of more than forty characters, for all"
    rows = [(i, f"{i}\n  {line}\t\n{line.lower()}" if i % 2 else line.upper()) for i in range(1, 6)] + [(None, line), (5, line)]
    twice = spark.createDataFrame([(1, f"{line}\nx\n{line}"), (1, f"x\n{line}\ny"), *((i, line) for i in range(2, 6))], "doc_id long, text string")
    got = {(r["doc_id"], *r["_kept"]) for r in linededup.drop_repeated_lines(twice).collect()}
    assert got == {(1, "x"), (1, "x", "y"), (2,), (3,), (4,), (5, line)}  # rows of one doc_id lose their own lines
    got = linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = [(r["doc_id"], r["_kept"]) for r in got.collect()]
    assert all(len(k) == (1 if d and d % 2 else 0) for d, k in kept if d != 5)
    assert sorted(len(k) for d, k in kept if d == 5) == [1, 3]
    few = linededup.drop_repeated_lines(spark.createDataFrame(rows[:4], "doc_id long, text string"))
    assert all(r["_kept"] == r["_lines"] for r in few.collect())
    short = linededup.drop_repeated_lines(spark.createDataFrame([(i, "x" * 39) for i in range(9)], "doc_id long, text string"))
    assert all(r["_kept"] == r["_lines"] for r in short.collect())


def test_many_rows_without_an_id_take_little_time(spark):
    """Their dropped lines aren't gathered in one row; each loses its own shared lines."""
    import time

    lines = [f"{k} a line that many rows share, of more than forty characters" for k in range(20)]
    rows = [(None, "\n".join([f"own {n}", *lines])) for n in range(2000)] + [(k, "\n".join(lines)) for k in range(6)]
    began = time.time()
    got = linededup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "_kept").collect()
    assert sorted(r["_kept"][0] for r in got if r["doc_id"] is None) == sorted(f"own {n}" for n in range(2000))
    assert all(len(r["_kept"]) == 1 for r in got if r["doc_id"] is None)
    assert {r["doc_id"]: len(r["_kept"]) for r in got if r["doc_id"] is not None} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 20}
    assert time.time() - began < 40


def test_simhash(spark, odd_docs, no_docs):
    groups = simhash.near_duplicate_groups(odd_docs)
    rows = [tuple(r) for r in groups.collect()]
    assert len(rows) == odd_docs.count()
    assert {d: c for d, f, c in rows if f == 0} == {2: 2, 3: 2, 5: 2, None: 2, 6: 2}
    assert simhash.near_duplicate_groups(no_docs).count() == 0
    kept = simhash.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, [1, 1, 2, 4, None, None]))


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (None, 3), (500, 501), (900, 900)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    star = [(0, i) for i in range(1, 3000)]
    assert components.connected_components(spark.createDataFrame(star, "a long, b long")).filter("root = 0").count() == 3000
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_secrets(spark, odd_docs, no_docs):
    rows = [
        (1, "a", "é password = 'abcdef123456789' x", ), (2, "b", 'TOKEN="copied0123456789abcdef01"'), (3, "c", "token: copied0123456789abcdef01"), (8, "f", "token: copied0123456789abcdef01"), (9, "g", "secret=copied-once-0123456"), (10, "h", "secret=copied-once-0123456"),
        (4, "d", "secret=token: abcdefgh"), (5, "d", "AKIA" + "Q" * 16 + " AKIA" + "Q" * 15), (6, None, "api_key=ab"), (7, "e", "0123456789abcdef01234567"),
    ]
    got = {r["doc_id"]: r["t"] for r in secret_scan.scan_secrets(spark.createDataFrame([(a, c, b) for a, b, c in rows], "doc_id long, text string, source string")).select("doc_id", secret_scan.span_text(F.col("spans")).alias("t")).collect()}
    assert got[1] == "assign:2:29,owned:14:29"
    assert got[2] == "assign:0:31" and got[3] == "assign:0:31" and got[8] == "assign:0:31"  # three owners
    assert got[9] == "assign:0:26,owned:7:26" and got[10] == got[9]  # one copy elsewhere
    assert got[4] == "" and got[6] == "" and got[5] == "access:0:20,owned:0:20" and got[7] == "hex:0:24,owned:0:24"
    odd = secret_scan.scan_secrets(odd_docs)
    assert odd.count() == odd_docs.count() and odd.filter(F.size("spans") > 0).count() == 0
    assert secret_scan.scan_secrets(no_docs).count() == 0
    assert secret_scan.scan_secrets(odd_docs.drop("source")).count() == odd_docs.count()


def test_secret_copies_of_one_owner_stay_owned(spark):
    df = spark.createDataFrame([(i, "password=abcdefghijkl", "s" if i < 9 else None) for i in range(9)], "doc_id long, text string, source string")
    assert {secret_scan.OWNED in r["t"] for r in secret_scan.scan_secrets(df).select(secret_scan.span_text(F.col("spans")).alias("t")).collect()} == {True}


def test_secret_copied_widely_inside_one_owner(spark):
    rows = [(i, "x password=abcdefghijkl y", "hot") for i in range(secret_scan.MAX_DOCUMENTS + 1)] + [(100 + i, "secret=mnopqrstuvwx", "hot") for i in range(secret_scan.MAX_DOCUMENTS)]
    rows += rows[-1:] * 30  # repeated rows are one document
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["t"] for r in secret_scan.scan_secrets(df).select("doc_id", secret_scan.span_text(F.col("spans")).alias("t")).collect()}
    assert {secret_scan.OWNED in t for d, t in got.items() if d < 100} == {False} and {secret_scan.OWNED in t for d, t in got.items() if d >= 100} == {True}


def seconds(df):
    import time

    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_time_grows_with_the_input(spark):
    """Many turns, matches, or shared lines in one row: eight times as many take less than 24 times as long."""
    turns = lambda n: spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")

    def chats(n):
        done = chat.format_conversations(turns(n))
        return done.select(F.size(chat.read_turns(F.col("formatted"))), F.length(chat.read_loss(F.col("formatted"), F.col("loss"))))

    secrets = lambda n: secret_scan.base_matches(spark.sql(f"SELECT 1L AS doc_id, 's' AS source, repeat('token=abcdefgh ', {n}) AS text"))
    text = "array_join(transform(sequence(1, {n}), x -> concat('a line that many documents share, number ', x)), '\n')"
    lines = lambda n: linededup.drop_repeated_lines(spark.range(6).selectExpr("id AS doc_id", text.format(n=n) + " AS text"))
    for make, small in ((chats, 5000), (secrets, 5000), (lines, 2500)):
        seconds(make(10))
        assert seconds(make(8 * small)) < 24 * max(0.4, seconds(make(small))), make
    kept = {r["doc_id"]: len(r["_kept"]) for r in lines(300).collect()}
    assert kept == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 300}


def test_chat(spark):
    rows = [
        (1, 2, "user", "b"), (1, 1, "user", "a<|im_sep|>\\2 \\0 <|"), (1, 3, "assistant", None), (1, 4, "assistant", "é\n<|im_end|>\n"), (1, 4, "assistant", "é\n<|im_end|>\n"),
        (2, None, None, None), (None, 1, "as\nsist<|ant\\1", "x"), (3, 1, "assistant", "<"), (3, 2, "user", "|im_end|>"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("head", F.lit(1))
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    turns = {k: [tuple(t) for t in r["t"]] for k, r in got.items()}
    assert turns[1] == [("user", "a<|im_sep|>\\2 \\0 <|"), ("user", "b"), ("assistant", ""), ("assistant", "é\n<|im_end|>\n"), ("assistant", "é\n<|im_end|>\n")]
    assert turns[2] == [("", "")] and turns[None] == [("as\nsist<|ant\\1", "x")] and turns[3] == [("assistant", "<"), ("user", "|im_end|>")]
    assert got[1]["l"] == "é\n<|im_end|>\n" * 2 and got[3]["l"] == "<" and got[2]["l"] == ""
    assert got[1]["formatted"].count("<|im_start|>") == 2  # adjacent turns of a role are one block
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_decontamination(spark, odd_docs, no_docs):
    item = " ".join(f"word{i}" for i in range(20))
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "few plain words here"), (1, item)], "item_id long, text string")
    docs = odd_docs.unionByName(odd_docs.limit(1).withColumn("doc_id", F.lit(77).cast("long")).withColumn("text", F.lit(f"x {item.upper()}! few plain, words here")))
    out = decontam.find_contamination(docs, benchmark)
    assert sorted(out.columns) == sorted(docs.columns)
    hits = {r["doc_id"]: [tuple(c) for c in r["contamination"]] for r in out.collect() if r["contamination"]}
    assert hits == {77: [(1, 1, 20, 20), (1, 1, 20, 20), (4, 21, 4, 4)]}  # by item_id; a repeated item is reported each time
    tiny = spark.createDataFrame([(9, "few"), (8, "plain words"), (7, "  ")], "item_id long, text string")
    assert decontam.find_contamination(docs, tiny).filter(F.size("contamination") > 0).count() == 0  # too short to tell
    assert decontam.find_contamination(no_docs, benchmark).count() == 0
    assert decontam.find_contamination(odd_docs, benchmark.limit(0)).filter(F.size("contamination") > 0).count() == 0


def test_toxicity(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    assert model == toxicity.Model()  # too few rows of a class
    assert {tuple(r["toxicity"]) for r in toxicity.score(odd_docs, model).collect()} == {(0.0, 0, 0.0)}
    assert toxicity.score(no_docs, model).count() == 0 and toxicity.fit(no_docs, labels.limit(0)) == toxicity.Model()
    rows = [(i, ("scum " if i % 2 else "") + f"plain text number {i % 7}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    graded = toxicity.fit(df, df.select("doc_id", "toxic", (F.col("toxic") * 2).alias("grade")))
    got = toxicity.score(odd_docs.unionByName(df.select("doc_id", "text"), allowMissingColumns=True), graded).select("text", "toxicity.*").collect()
    assert all((r["toxic_probability"] >= 0.5) == ("scum" in (r["text"] or "")) for r in got)


def test_sentencepiece(spark, odd_docs, no_docs):
    vocabulary = spm.load_vocabulary()
    docs = odd_docs.unionByName(odd_docs.limit(1).withColumn("doc_id", F.lit(78).cast("long")).withColumn("text", F.lit("x" * 5000 + "é漢😀\x00 \t")))
    rows = spm.decode(spm.encode(docs, vocabulary), vocabulary).select("text", "ids", "decoded").collect()
    assert all(r["decoded"] == r["text"] for r in rows)
    assert all((r["ids"] is None) == (r["text"] is None) for r in rows) and [r["ids"] for r in rows if r["text"] == ""] == [[]]
    assert spm.decode(spm.encode(no_docs, vocabulary), vocabulary).count() == 0


def test_ids_outside_the_vocabulary_decode_to_null(spark):
    vocabulary = spm.load_vocabulary()
    most = len(vocabulary.pieces)
    rows = [(0, [-1]), (1, [5, most]), (2, [-2, 300]), (3, []), (4, None), (5, [most - 1])]
    got = {r["n"]: r["decoded"] for r in spm.decode(spark.createDataFrame(rows, "n int, ids array<int>"), vocabulary).collect()}
    assert [got[k] for k in range(5)] == [None, None, None, "", None] and got[5] is not None


def test_equal_letters_take_little_time():
    import time

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=spm.TOKENIZER)
    encoder = spm.Encoder(spm.load_vocabulary())
    texts = ["a" * 100_000, "ab" * 40_000, "=" * 30_000, "x " + "la" * 3000 + " y", "é" * 5000, "日" * 4000]
    encoder.encode(["warm up"])
    began = time.time()
    got = encoder.encode(texts)
    assert time.time() - began < 6
    assert [g.tolist() for g in got] == library.encode(texts)


def test_tiff_codecs():
    import random

    import numpy as np

    rng = random.Random(9)
    for size in (0, 1, 127, 128, 129, 4000, 9000):
        for data in (bytes(rng.getrandbits(8) for _ in range(size)), b"a" * size, bytes(rng.choice(b"ab") for _ in range(size))):
            assert tiff.unpack_bits(tiff.pack_bits(data), size) == data
            assert tiff.lzw_decode(tiff.lzw_encode(data), size) == data
    page = np.arange(70 * 50, dtype=np.uint8).reshape(70, 50)
    for compression in (tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS):
        for predictor in (1, 2):
            for tile in (None, 16):
                pages = tiff.read_tiff(tiff.write_tiff([page, page[:5]], compression, predictor, tile, 16))
                assert [p["pixels"] for p in pages] == [page.tobytes(), page[:5].tobytes()] and pages[0]["tiled"] == bool(tile)


def foreign_tiff(order, width, height, strips, tags=(), samples=1):
    """A TIFF put together by hand: values of two bytes, the directory last."""
    import struct

    body, places = b"", []
    for strip in strips:
        places.append(8 + len(body))
        body += strip
    entries = [(256, width), (257, height), (258, 8), (262, 1), (277, samples), *tags]
    lists = {273: places, 279: [len(s) for s in strips]} if not any(t == 322 for t, _ in tags) else {324: places, 325: [len(s) for s in strips]}
    directory = {}
    for tag, value in entries:
        directory[tag] = struct.pack(order + "HHI", tag, 3, 1) + struct.pack(order + "HH", value, 0)
    for tag, values in lists.items():
        packed = struct.pack(f"{order}{len(values)}H", *values)
        if len(packed) > 4:
            place = struct.pack(order + "I", 8 + len(body))
            body += packed
        else:
            place = packed.ljust(4, b"\0")
        directory[tag] = struct.pack(order + "HHI", tag, 3, len(values)) + place
    head = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8 + len(body))
    return head + body + struct.pack(order + "H", len(directory)) + b"".join(directory[t] for t in sorted(directory)) + b"\0\0\0\0"


def test_foreign_tiffs():
    """Files not made by the own writer: big-endian, the LZW and PackBits codes of the format's own description, RGB, tiles."""
    import zlib

    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    lzw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    rgb = bytes(range(24))
    predicted = bytes([10, 20, 30, 1, 1, 1, 1, 1, 1, 1, 1, 1])
    for order in "<>":
        one = lambda *a, **k: tiff.read_tiff(foreign_tiff(order, *a, **k))[0]["pixels"]  # noqa: B023, E731
        assert one(9, 1, [lzw], [(259, 5)]) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
        assert one(24, 1, [packed], [(259, 32773)]) == plain
        assert one(4, 2, [rgb[:12], rgb[12:]], [(278, 1)], samples=3) == rgb
        assert one(4, 1, [zlib.compress(predicted)], [(259, 8), (317, 2)], samples=3) == bytes([10, 20, 30, 11, 21, 31, 12, 22, 32, 13, 23, 33])
        tiles = [bytes([n]) * 256 for n in range(4)]
        page = one(20, 17, tiles, [(322, 16), (323, 16)])
        assert page[:20] == bytes([0] * 16 + [1] * 4) and page[16 * 20 :] == bytes([2] * 16 + [3] * 4)


def test_bad_tiffs_give_errors(spark):
    import struct
    import zlib

    huge = foreign_tiff("<", 65535, 65535, [b"x" * 20], [(259, 8)])
    bomb = foreign_tiff("<", 8, 8, [zlib.compress(bytes(50_000_000))[:60_000]], [(259, 8)])
    wide = bytearray(foreign_tiff("<", 4, 4, [bytes(16)]))
    at = wide.index(struct.pack("<HHI", 279, 3, 1))
    wide[at : at + 8] = struct.pack("<HHI", 279, 4, 0xFFFFFFFF)
    loop = bytearray(foreign_tiff("<", 4, 4, [bytes(16)]))
    loop[-4:] = loop[4:8]
    files = [huge, bomb, bytes(wide), bytes(loop), b"", b"II", b"MM\0*" + b"\xff" * 40, foreign_tiff(">", 4, 4, [b"\xff" * 9], [(259, 5)]), foreign_tiff(">", 4, 4, [bytes(9)])]
    rows = spark.createDataFrame([(n, bytearray(f)) for n, f in enumerate(files)], "n int, media binary")
    got = {r["n"]: r for r in tiff.explode_pages(rows).collect()}
    assert got[1]["pixels"] == bytes(64) and got[1]["error"] is None and got[3]["pixels"] == bytes(16)
    assert all(got[n]["error"] and got[n]["page"] is None for n in (0, 2, 4, 5, 6, 7, 8))


def test_many_directories_are_bounded_by_the_file():
    """Directories that share one strip, values or each other's bytes may not make more than the file's size allows."""
    import struct
    import zlib

    side = 2000
    packed = zlib.compress(bytes(side * side), 9)
    head, body = b"II*\0" + struct.pack("<I", 8 + len(packed)), packed
    entries = ((256, 4, side), (257, 4, side), (258, 3, 8), (259, 3, 8), (273, 4, 8), (278, 4, side), (279, 4, len(packed)))

    def chained(n, extra=b"", more=()):
        out, all_entries = head + body + extra, sorted((*entries, *more))
        for k in range(n):
            size = 6 + 12 * len(all_entries)
            out += struct.pack("<H", len(all_entries)) + b"".join(struct.pack("<HHII", t, kind, 1, v) if t != 320 else struct.pack("<HHII", *v) for t, kind, v in all_entries)
            out += struct.pack("<I", len(out) + 4 if k + 1 < n else 0)
            assert size == 6 + 12 * len(all_entries)
        return out

    assert len(tiff.read_tiff(chained(2))) == 2
    for bad in (chained(30), chained(3000)):
        with pytest.raises(ValueError, match="samples in"):
            tiff.read_tiff(bad)
    small = ((256, 4, 1), (257, 4, 1), (259, 3, 1), (273, 4, 8), (278, 4, 1), (279, 4, 1))
    table = bytes(4000)
    out = b"II*\0" + struct.pack("<I", 8 + len(table)) + table
    for _ in range(200):  # each directory states the same table as values
        rows = [struct.pack("<HHII", t, kind, 1, v) for t, kind, v in small] + [struct.pack("<HHII", 65000, 1, len(table), 8)]
        out += struct.pack("<H", len(rows)) + b"".join(rows) + struct.pack("<I", len(out) + 6 + 12 * len(rows))
    with pytest.raises(ValueError, match="values"):
        tiff.read_tiff(out)


def test_page_rows(spark):
    """One row per page of a text of three pages, in each layout."""
    text = "".join(chr(97 + k % 26) for k in range(64 * 4096 * 2 + 70))
    docs = spark.createDataFrame([(n, text) for n in range(len(tiff.LAYOUTS))], "layout int, text string")
    rows = tiff.explode_pages(docs.select("layout", tiff.text_to_tiff(F.col("text"), F.col("layout")).alias("media"))).orderBy("layout", "page").collect()
    assert [(r["layout"], r["page"], r["height"]) for r in rows] == [(n, p, h) for n in range(4) for p, h in enumerate((4096, 4096, 2))]
    assert {r["compression"] for r in rows} == {tiff.LZW, tiff.PACKBITS, tiff.DEFLATE} and [r["tiled"] for r in rows] == [False] * 9 + [True] * 3
    for n in range(4):
        assert b"".join(r["pixels"] for r in rows if r["layout"] == n) == tiff.payload_of(text)


def test_tiff_rows(spark, odd_docs, no_docs):
    media = odd_docs.withColumn("media", tiff.text_to_tiff(F.col("text")))
    bad = odd_docs.limit(1).withColumn("doc_id", F.lit(79).cast("long")).withColumn("media", F.lit(b"II*\0").cast("binary"))
    none = bad.withColumn("doc_id", F.lit(80).cast("long")).withColumn("media", F.lit(None).cast("binary"))
    pages = tiff.explode_pages(media.unionByName(bad).unionByName(none))
    assert len(pages.columns) == len(set(pages.columns))
    rows = {r["doc_id"]: r for r in pages.collect()}
    assert rows[79]["error"] and rows[79]["page"] is None and rows[80]["error"] is None and rows[80]["page"] is None
    assert rows[3]["pixels"] == b"\0" * 64 and rows[4]["height"] * 64 >= 200000 - 64 * 4096
    assert tiff.explode_pages(no_docs.withColumn("media", tiff.text_to_tiff(F.col("text")))).count() == 0


def test_licenses(spark, odd_docs, no_docs):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License. You may obtain a copy of the License at x"),
        (2, "x. All  rights reserved! y"), (3, "This text is about a license."), (4, "RELEASED UNDER THE MIT LICENSE.\nLicensed under CC BY-NC 4.0."), (5, "released under the mit license and more"),
        (6, "Licensed under the Apache License, Version 2.0.\nreleased under the MIT license\nYou may not use this file except in compliance with the License."),
    ]
    out = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["licenses"] == ["Apache-2.0"] and len(out[1]["license_sentences"]) == 3
    assert (out[2]["licenses"], out[2]["license_verdict"]) == (["Proprietary"], "restricted")
    assert out[3]["license_verdict"] == "none" and out[5]["licenses"] == ["MIT"]  # known sentences count inside longer ones
    assert (out[4]["licenses"], out[4]["license_verdict"]) == (["MIT", "CC-BY-NC-4.0"], "restricted")
    assert out[6]["licenses"] == ["Apache-2.0", "MIT"]
    assert licenses.scan_licenses(odd_docs).filter("license_verdict <> 'none'").count() == 0
    assert licenses.scan_licenses(no_docs).count() == 0
    odd = licenses.scan_licenses(odd_docs)
    assert len(odd.columns) == len(set(odd.columns)) and odd.count() == odd_docs.count()
    long = spark.createDataFrame([(1, "word " * 300_000 + "\n\nReleased under the MIT License.\n" + "word\n\n" * 50_000)], "doc_id long, text string")
    assert licenses.scan_licenses(long).first()["licenses"] == ["MIT"]


MIT = """MIT License

Copyright (c) 2020 X

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
BSD_2 = """Copyright (c) 2020, X. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions.
"""
AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS WARRANTIES ARE DISCLAIMED."""
NAME = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from this software.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_standard_license_texts(spark):
    """Texts as they stand in source files: wrapped, behind comment marks, one after the other."""
    texts = {
        "MIT": MIT, "BSD-2-Clause": BSD_2 + AS_IS, "BSD-3-Clause": BSD_2 + NAME + AS_IS, "Apache-2.0": APACHE,
        "GPL-3.0": GPL.format(":", ", either version 3 of the License,"[:1], 3), "GPL-2.0": GPL.format(";", ";", 2), "MPL-2.0": MPL,
    }
    rows = []
    for name, text in texts.items():
        rows += [(name, text)] + [(name, "\n".join(mark + line for line in text.split("\n"))) for mark in ("# ", " * ", "// ")]
    rows.append(("BSD-3-Clause,MIT,BSD-2-Clause", "\n\n".join([BSD_2 + NAME + AS_IS, MIT, BSD_2 + AS_IS])))
    rows += [("MIT", "This project is licensed under the MIT License."), ("Proprietary", "Copyright 2020 X, all rights reserved."), ("", "We like licenses and copyright.")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "want string, text string")).collect()
    assert [(r["want"], ",".join(r["licenses"])) for r in got] == [(r["want"], r["want"]) for r in got]


def test_license_names_tags_and_negations(spark):
    want = {
        "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0", "SPDX-License-Identifier: MIT-0": "MIT-0",
        "Licensed under the BSD 3-Clause License.": "BSD-3-Clause", "Licensed under the GPLv3.": "GPL-3.0", "GNU GPL v3": "GPL-3.0", "ISC License": "ISC", "Apache 2.0 license": "Apache-2.0",
        "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "This is WTFPL.": "WTFPL", "Released under the PSF License": "PSF-2.0", "Distributed under the Artistic License 2.0": "Artistic-2.0", "Licensed under the Unicode License v3": "Unicode-3.0",
        "This is not licensed under the MIT License.": "", "It isn't released under the BSD license": "", "No longer distributed under the GPLv3": "", "We admit limits. Not licensed.": "", "mit": "", "under the bridge": "",
        "Available under the\n  MIT License, not under another.": "MIT", "Licensed under CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0", "SPDX-License-Identifier: 0BSD": "0BSD", "released\nunder the BSD 2-clause license": "BSD-2-Clause",
    }
    got = {r["text"]: r for r in licenses.scan_licenses(spark.createDataFrame([(k,) for k in want], "text string")).collect()}
    assert {k: ",".join(r["licenses"]) for k, r in got.items()} == want
    assert got["This is not licensed under the MIT License."]["license_verdict"] == "unknown"


def test_license_files_of_the_system(spark):
    import os

    want = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}
    folder = "/usr/share/common-licenses"
    rows = [(name, open(f"{folder}/{file}").read()) for file, name in want.items() if os.path.exists(f"{folder}/{file}")]
    if rows:
        got = licenses.scan_licenses(spark.createDataFrame(rows, "want string, text string")).collect()
        assert [(r["want"], r["want"] in r["licenses"]) for r in got] == [(r["want"], True) for r in got]


def test_urls(spark):
    urls = ["https://A.Example.COM/en/7?x#y", "http://x.example.com/en/1", "ftp://com/en/", "no url", None, "http://example.net", "http://notexample.net/de/8", "http://example.net/de/8", "a://b://c/en/", "http://h.org/es/?q", "HTTP://X.com#/en/", "http://x.com/en/\nz"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("tokens", F.lit(1)).withColumn("key", F.lit(1))
    rules = urlrules.mine_rules(df.select("url", F.lit(None).cast("boolean").alias("bad")))
    assert rules.count() == 0
    rows = urlrules.judge_urls(df, rules).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == 13
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[1] == ("x.example.com", "/en/1", "com/en/", "block")
    assert got[2] == ("com", "/en/", "com/en/", "block") and got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5] == ("example.net", "", None, "allow") and got[6] == ("notexample.net", "/de/8", "net/de/", "allow") and got[7][3] == "block"
    assert got[8] == ("b:", "//c/en/", None, "allow") and got[9] == ("h.org", "/es/", "org/es/", "block") and got[10] == ("x.com", "", None, "allow")
    assert got[11] == ("x.com", "/en/\nz", "com/en/", "block")
    assert urlrules.judge_urls(df.limit(0), rules).count() == 0
