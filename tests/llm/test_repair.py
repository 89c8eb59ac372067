"""Conversation repair against SQL (with the other queries), brute force and long conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lawmill.llm import repair

COST = {"K": 0, "R": 2, "D": 3, "I": 2}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_text, turn_text = (" " if x is None else str(x) for x in (conv, turn))
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def judged(rows):
    """(initial, must be deleted, 1 if truncated) of each row."""
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying edits in order of cost and initials, without the library's recursion."""
    import heapq

    marks = judged(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        if (at, roles[-2:], len(roles) > 0) in done:
            continue
        done.add((at, roles[-2:], len(roles) > 0))
        moves = [("I", 2, at, r, (r, "")) for r in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at][2], rows[at][3], marks[at][1]
            moves.append(("D", 3, at + 1, None, None))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                moves.append(("K", more, at + 1, role, (role, text)))
                moves += [("R", 2 + more, at + 1, r, (r, text)) for r in ("user", "assistant")]
        for letter, paid, to, role, line in moves:
            new = roles + (role[:1] or "?") if role is not None else roles
            if re.fullmatch("(s|s?(ua)*u?)?", new):
                heapq.heappush(heap, (cost + paid, audit + letter, to, new, (*out, line) if line else out))


def got_of(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r["conv_id"]: r for r in repair.digests(repair.repair(turns)).collect()}


def test_small_conversations_against_search(spark):
    random.seed(3)
    rows = []
    for conv in [None, *range(300)]:
        for k in range(random.randrange(1, 6)):
            turn = random.choice([None, k, k, k, 1])
            rows.append((conv, turn, random.choice(["user", "assistant", "system", "user", "tool", None, ""]), random.choice(["Yes.", "no", " ", "", None, "ok!", "Hm?", "é…"])))
    got = got_of(spark, rows)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in plain if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        cost, audit, out = cheapest(own)
        assert (got[conv]["cost"], got[conv]["audit"]) == (cost, audit), own
        assert got[conv]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        marks = judged(own)
        for name in ("blank", "duplicate", "truncated"):
            assert got[conv][name] == sum(m[1] == name for m in marks)
        assert got[conv]["illegal"] == sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))


@pytest.mark.parametrize("kind", ["mixed", "users", "blanks"])
def test_long_conversations_in_segments(spark, kind, monkeypatch):
    """Segments of 16 rows, solved in passes, give what one segment gives."""
    random.seed(7)
    roles = {"mixed": ["user", "assistant", "user", "tool"], "users": ["user"], "blanks": ["user", "assistant"]}[kind]
    texts = {"mixed": ["a{}.", "b{}", " ", "same."], "users": ["u{}."], "blanks": [" ", " ", " ", " ", "x{}."]}[kind]
    rows = [(conv, k, random.choice(roles), random.choice(texts).format(k)) for conv, n in ((1, 700), (2, 333), (3, 5)) for k in range(n)]
    whole = got_of(spark, rows)
    monkeypatch.setattr(repair, "BLOCK_BITS", 4)
    assert got_of(spark, rows) == whole
    edits = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for conv in (1, 2, 3):
        lines = [r for r in repair.repaired_turns(edits).collect() if r["conv_id"] == conv]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in sorted(lines, key=lambda r: r["at"])))


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in [None, *range(60)] for r, x in ((None, "A. b!"), ("assistant", None))]
    got = repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, plain_damage(rows)))


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, at long, edit string")
    assert repair.digests(repair.repair(none)).count() == 0
