"""Archives by member against whole reading."""

import random
import zipfile

from lawmill.sources import archives, records


def built(tmp_path, name, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", method) as z:
        for file, body in members:
            z.writestr(file, body)
    return tmp_path / f"{name}.zip"


def rows(df):
    return sorted((tuple(r) for r in df.select("run", "file", "line_no", "line").collect()), key=repr)


def test_by_member_equals_whole(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice(["a", "é", "\n", "\r\n", "\r", "\x0b", " ", "日本", " "]) for _ in range(rng.randrange(400)))
    members = [(f"{k}.txt", text().encode()) for k in range(60)] + [("bad.txt", b"x\xff\xfey\n\xe2\x82"), ("empty.txt", b""), ("a/b.txt", b"no"), ("c.log", b"no")]
    for name, method in (("deflated", zipfile.ZIP_DEFLATED), ("stored", zipfile.ZIP_STORED)):
        built(tmp_path, name, members, method)
    built(tmp_path, "odd", [("x.txt", b"line\n" * 50_000)])
    spoilt = bytearray(built(tmp_path, "spoilt", [("p.txt", b"fine\n" * 100), ("q.txt", b"gone\n" * 100)]).read_bytes())
    spoilt[40:44] = b"\xff\xff\xff\xff"
    (tmp_path / "spoilt.zip").write_bytes(spoilt)
    (tmp_path / "cut.zip").write_bytes((tmp_path / "stored.zip").read_bytes()[:300])
    whole = rows(records.read_run_archives(spark, str(tmp_path)))
    assert ("cut", None, None, None) in whole and ("spoilt", "p.txt", None, None) in whole and sum(r[0] == "odd" for r in whole) == 50_000
    monkeypatch.setattr(archives, "PIECE", 7)
    assert rows(records.read_run_archives(spark, str(tmp_path), whole_bytes=0)) == whole


def test_members_of_one_archive_are_read_by_many_tasks(spark, tmp_path):
    built(tmp_path, "many", [(f"{k}.txt", b"x\n" * 10) for k in range(200)])
    found = records.read_run_archives(spark, str(tmp_path), whole_bytes=0)
    parts = found.rdd.glom().map(lambda part: len({r["file"] for r in part})).collect()
    assert sum(parts) == 200 and sum(n > 0 for n in parts) >= 4 and found.count() == 2000


def test_lines_in_pieces():
    text = "a\r\nb\rc\n\n\x85d é"
    data = text.encode()
    for size in range(1, 6):
        assert list(archives.lines_of(data[k : k + size] for k in range(0, len(data), size))) == text.splitlines()
    assert list(archives.lines_of(iter([]))) == [] and list(archives.lines_of(iter([b"\n"]))) == [""]
