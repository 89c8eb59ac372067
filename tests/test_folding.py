"""Log folding against a walk line by line."""

import random
import re

import pytest

from lawmill.operators import folding


def walk(lines):
    out, group, start, past, left = [], None, -1, None, 0
    for place, line in enumerate(lines):
        if left:
            kind, left = "warning", 0 if re.match(r"  [^ ]", line) else left - 1
        elif re.match(r"/[^ ]*:[0-9]+: [A-Za-z_]+Warning: ", line):
            kind, left = "warning", 20
        else:
            kind = "routine" if re.match(r"\d\d:\d\d:\d\d INFO", line) else "other"
        if kind == "other":
            group = None
        elif kind == "warning":
            if group is None:
                group, start = place, start if past is None else past
        else:
            second = int(line[:2]) * 3600 + int(line[3:5]) * 60 + int(line[6:8])
            if group is None or second < start or second - start >= 300:
                group, start = place, second
            past = second
        out.append(group)
    return out


def log(rng, n, jitter, other, warn):
    lines, clock = [], rng.randrange(86400)
    while len(lines) < n:
        draw = rng.random()
        if draw < other:
            lines.append(rng.choice(["ERROR x", "", "  indented", "12:00:00 WARNING y"]))
        elif draw < other + warn:
            lines.append("/lib/a.py:10: DeprecationWarning: old")
            lines += rng.choice([["  warnings.warn()"], [], ["    more"] * rng.randrange(30), ["   text", "/b.py:1: UserWarning: inside", "  end"], ["12:00:00 INFO inside"] * 25])
        else:
            clock = (clock + rng.choice([0, 0, 1, 2, 60, 299, 300]) - (rng.randrange(400) if rng.random() < jitter else 0)) % 86400
            lines.append(f"{clock // 3600:02d}:{clock // 60 % 60:02d}:{clock % 60:02d} INFO x")
    return lines[:n]


@pytest.mark.parametrize("block", [4096, 16])
def test_folds_equal_a_walk(spark, monkeypatch, block):
    monkeypatch.setattr(folding, "BLOCK", block)
    rng = random.Random(block)
    logs = [log(rng, rng.randrange(1, 260), j, o, w) for j in (0, 0.1, 0.6) for o in (0, 0.05, 0.3) for w in (0, 0.02, 0.2)]
    logs += [["00:04:58 INFO a"], ["/x.py:1: XWarning: a", "  b", "00:04:58 INFO a", "00:04:59 INFO a"], ["/x.py:1: XWarning: a", "  b", "00:04:59 INFO a"], ["other"]]
    rows = [(f"r{k}", at * 3 + 7, line) for k, lines in enumerate(logs) for at, line in enumerate(lines)]
    rng.shuffle(rows)
    got = folding.fold_routine(spark.createDataFrame(rows, "run string, place int, line string"), "run", "place").collect()
    found = {(r["run"], r["place"]): r["fold"] for r in got}
    want = {(f"r{k}", at * 3 + 7): None if g is None else g * 3 + 7 for k, lines in enumerate(logs) for at, g in enumerate(walk(lines))}
    assert len(got) == len(want) and found == want


def test_one_long_run_is_spread_over_tasks(spark):
    """Half of all lines are one run without a break; no partition holds more than its share of blocks."""
    n = 60_000
    lines = [f"{t // 3600 % 24:02d}:{t // 60 % 60:02d}:{t % 60:02d} INFO x" for t in (k * 2 - (90 if k % 1000 == 0 else 0) + 200 for k in range(n))]
    docs = spark.createDataFrame([("long", k, x) for k, x in enumerate(lines)], "run string, place int, line string")
    assert [r["fold"] for r in folding.fold_routine(docs, "run", "place").orderBy("place").collect()] == walk(lines)


def test_no_lines(spark):
    assert folding.fold_routine(spark.createDataFrame([], "run string, place int, line string"), "run", "place").count() == 0
    nulls = spark.createDataFrame([("a", 1, None), ("a", 2, "")], "run string, place int, line string")
    assert [r["fold"] for r in folding.fold_routine(nulls, "run", "place").collect()] == [None, None]


def test_rounds_leave_the_plan_small(spark):
    """Spark's estimate of a join is the product of both sides': were it kept from round to round, it would have thousands of digits."""
    steps = spark.range(600).selectExpr("'a' AS k", "id AS n", "id + 1 AS to")
    found = folding.reachable(spark.createDataFrame([("a", 0)], "k string, n long"), steps, ["k", "n"])
    assert found.count() == 601
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64
