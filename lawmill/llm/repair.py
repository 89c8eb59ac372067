"""Conversation structure repair by rank-convergence parallel Viterbi.

The rows of a conversation, in the order of their turns, get the cheapest edits after which the role initials read
``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant turn 2; blank and
duplicate rows must be deleted, truncated rows that stay cost 1 more. Of equally cheap edits the ones with the
ASCII-least string of initials are taken. In each state one role only may come next by Rerole or Insert, so a string of
initials names one repair.

Order: turn (nulls first), then role, then the MD5 of the text; rows equal in all of them are alike.

Method: narrow rows (no texts) are range-partitioned and sorted, and numbered. Blocks of 2 to the ``BLOCK_BITS`` numbers are cut at
conversations; such a segment is the unit of work, so that a conversation of any length is spread over tasks. Every
segment runs the backward recursion from a speculative cost vector at its end. The vectors of a conversation's segments
are then stitched from the last one on: where a segment was run from a vector that differs from the true one only by a
constant, its result holds; all others are run again, at once, until their vectors differ from an earlier run's only by a
constant, and the stitching is repeated. A segment is run at most once from each vector, of which there are a few dozen,
so the passes don't grow with a conversation. The stitched backward costs then drive a forward trace that takes the
least initial at each step.

What grows with one conversation in one task: its segments' vectors (one row for each block), and the last step,
which streams the conversation's rows in order with the edits beside them, in bounded memory.

Defined results: null role, text, and null ids or turns where they are written out, are one space; null conv_ids are one
conversation; empty and blank texts are deleted; ties and repeated rows are duplicates if role and text are equal, else
stand in the order above; very long texts are streamed, one at a time; an empty table gives no rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.session import materialise

BLOCK_BITS = 12
WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
MAY_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
NEXT = (2, 2, 3, 2)  # where Rerole and Insert lead
NEXT_ROLE = ("user", "user", "assistant", "user")
END = (0, 4, 2, 0)  # what is still to pay after the last row
INITIALS = "suax"
FAULTS = ("blank", "duplicate", "truncated", None)
CODES = "abcdefghijklmnop"  # four roles for each fault in turn

EDITS = "conv_id long, at long, turn long, edit string, fault string, old_role string, role string, text string"
RUNS = "conv_id long, seg long, vector string, out string, exits string"
STITCHED = "conv_id long, seg long, vector string, earlier string, known string, entry int"
TRACED = "conv_id long, seg long, turn long, role string, md5 string, text string, codes string"
DIGEST = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


# --- the recursion of one segment -------------------------------------------------------------------------------------


class Automaton:
    """Steps between cost vectors, each worked out once. Vectors are kept with their least cost at zero."""

    def __init__(self):
        self.steps: dict[tuple, tuple] = {}
        self.moves: dict[tuple, tuple] = {}

    def back(self, vector: tuple, code: str) -> tuple[tuple, int]:
        """The vector before a row, from the one behind it, and the constant taken off."""
        known = self.steps.get((vector, code))
        if known is None:
            costs = [self._row_cost(vector, code, q) for q in range(4)]
            for _ in range(4):
                costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
            low = min(costs)
            known = self.steps[vector, code] = (tuple(c - low for c in costs), low)
        return known

    @staticmethod
    def _choices(vector: tuple, code: str, q: int) -> list[tuple[str, int, int]]:
        """(initial, cost to the end, next state) of the edits of a row, by their initials."""
        fault, role = divmod(CODES.index(code), 4)
        found = [("D", DELETE + vector[q], q)]
        if fault > 1:
            more = int(fault == 2)
            if (to := MAY_KEEP[INITIALS[role]].get(q)) is not None:
                found.append(("K", KEEP + more + vector[to], to))
            found.append(("R", REROLE + more + vector[NEXT[q]], NEXT[q]))
        return found

    def _row_cost(self, vector: tuple, code: str, q: int) -> int:
        return min(cost for _, cost, _ in self._choices(vector, code, q))

    def move(self, vector: tuple, code: str, q: int) -> tuple[str, int]:
        """The least initials that take a row on from state ``q``, inserts before it included, and the next state."""
        known = self.moves.get((vector, code, q))
        if known is None:
            before, low = self.back(vector, code)
            at, letters = q, ""
            while True:
                due = before[at] + low
                best = [(a, to) for a, cost, to in self._choices(vector, code, at) if cost == due]
                if INSERT + before[NEXT[at]] == before[at]:
                    best.append(("I", NEXT[at]))
                letter, to = min(best)
                letters, at = letters + letter, to
                if letter != "I":
                    break
            known = self.moves[vector, code, q] = (letters, at)
        return known

    def run(self, codes: str, end: tuple, earlier: tuple | None = None, known: tuple | None = None) -> tuple:
        """The vector before the first row. With an earlier run's end vector and its result, only until both agree."""
        new = end
        for code in reversed(codes):
            if earlier is not None:
                if new == earlier:
                    return known
                earlier = self.back(earlier, code)[0]
            new = self.back(new, code)[0]
        return new

    def vectors(self, codes: str, end: tuple) -> list[tuple]:
        """The vector behind each row."""
        out = [end]
        for code in reversed(codes[1:]):
            out.append(self.back(out[-1], code)[0])
        return out[::-1]

    def exits(self, codes: str, end: tuple) -> tuple[int, ...]:
        """The state behind the last row for each state before the first."""
        states = (0, 1, 2, 3)
        for code, vector in zip(codes, self.vectors(codes, end)):
            states = tuple(self.move(vector, code, q)[1] for q in states)
        return states

    def trace(self, codes: str, end: tuple, q: int, last: bool) -> str:
        """Initials of the edits of a segment entered in state ``q``."""
        letters = []
        for code, vector in zip(codes, self.vectors(codes, end)):
            edit, q = self.move(vector, code, q)
            letters.append(edit)
        return "".join(letters) + ("I" * (END[q] // INSERT) if last else "")


_automaton = Automaton()


def _text(vector: tuple) -> str:
    return ",".join(map(str, vector))


def _vector(text: str) -> tuple:
    return tuple(map(int, text.split(",")))


def _columns(batch: pa.RecordBatch, names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names.split()))


def _run_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUNS: segments run from the vector at their end."""
    for batch in batches:
        outs, exits = [], []
        for codes, vector, earlier, known in _columns(batch, "codes vector earlier known"):
            end = _vector(vector)
            outs.append(_text(_automaton.run(codes, end, *((_vector(earlier), _vector(known)) if earlier else ()))))
            exits.append(_text(_automaton.exits(codes, end)))
        kept = [batch.column(n) for n in ("conv_id", "seg", "vector")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(outs, pa.string()), pa.array(exits, pa.string())], ["conv_id", "seg", "vector", "out", "exits"])


def _stitch(runs: pd.DataFrame) -> pd.DataFrame:
    """For each segment of one conversation: the vector at its end as far as known, an earlier run where it has to be run
    from that vector, and the state in which it is entered once nothing is to be run."""
    done = {(seg, vector): (out, exits) for seg, vector, out, exits in runs[["seg", "vector", "out", "exits"]].itertuples(False)}
    earlier: dict[int, tuple[str, str]] = {seg: (vector, out) for (seg, vector), (out, _) in done.items()}
    vector, rows, open_ = _text(END), [], 0
    for seg in sorted(earlier, reverse=True):
        if (seg, vector) in done:
            rows.append([seg, vector, None, None, None])
            vector = done[seg, vector][0]
        else:
            open_ += 1
            rows.append([seg, vector, *earlier[seg], None])
            vector = earlier[seg][1]
    if not open_:
        state = 0
        for row in reversed(rows):
            row[4] = state
            state = _vector(done[row[0], row[1]][1])[state]
    out = pd.DataFrame(rows, columns=["seg", "vector", "earlier", "known", "entry"]).astype({"entry": "Int32"})
    out.insert(0, "conv_id", pd.array([runs["conv_id"].iloc[0]] * len(out), "Int64"))
    return out


def _trace_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _columns(batch, "codes vector entry last")
        edits = pa.array([_automaton.trace(codes, _vector(vector), entry, last) for codes, vector, entry, last in rows], pa.string())
        kept = ["conv_id", "seg", "turn", "role", "md5"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), edits, batch.column("codes")], [*kept, "text", "codes"])


# --- rows, segments, stitching ----------------------------------------------------------------------------------------


def written(value: Column | str) -> Column:
    """The value as text, null as one space."""
    return F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """The damaged rows: by the checksum of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its text, 2 takes its
    ``.!?`` out, 3 repeats it, 4 makes the user its role."""
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn"))) % 20
    text, role = written("text"), written("role")
    return (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"))
        .filter("_kind <> 0")
        .withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
        .withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .drop("_kind", "_copy")
    )


def _segments(rows: DataFrame) -> DataFrame:
    """(conv_id, seg, codes, turn, role, md5, last, alone): the runs of a block's rows in one conversation, in order of ``seg``."""
    stripped = F.rtrim(F.col("text"), F.lit(WHITE))
    role = F.left("role", F.lit(1))
    narrow = rows.select(
        "conv_id",
        "turn",
        "role",
        F.md5("text").alias("md5"),
        F.when(stripped == "", 0).when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), 3).otherwise(2).alias("fault"),
        F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3).alias("kind"),
        F.monotonically_increasing_id().alias("salt"),  # parts rows that are alike
    )
    order = ["conv_id", "turn", "role", "md5", "salt"]
    numbered = materialise(narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))
    firsts = numbered.groupBy("conv_id", "role", "md5").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when((F.col("fault") > 0) & F.col("first").isNull(), 1).otherwise(F.col("fault"))
    coded = numbered.join(firsts, "pos", "left").withColumn("code", F.substring(F.lit(CODES), fault * 4 + F.col("kind") + 1, F.lit(1)))
    cut = coded.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(
        F.min("pos").alias("seg"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("codes"),
        F.min_by(F.struct("turn", "role", "md5"), "pos").alias("key"),
    )
    cut = materialise(cut.select("conv_id", "seg", "codes", "key.*"))
    ends = cut.groupBy("conv_id").agg(F.max("seg").alias("end"), F.count(F.lit(1)).alias("n"))
    found = cut.join(ends, cut["conv_id"].eqNullSafe(ends["conv_id"])).drop(ends["conv_id"])
    return found.withColumn("last", F.col("seg") == F.col("end")).withColumn("alone", F.col("n") == 1).drop("end", "n")


def _edits_of(segments: DataFrame) -> DataFrame:
    """(conv_id, seg, turn, role, md5, text, codes): each segment's initials of edits as ``text``."""
    end = F.lit(_text(END))
    alone = segments.filter("alone").select("*", end.alias("vector"), F.lit(0).alias("entry"))
    several = segments.filter(~F.col("alone"))
    none = F.lit(None).cast("string")
    todo = several.select("conv_id", "seg", "codes", end.alias("vector"), none.alias("earlier"), none.alias("known"))
    runs = materialise(todo.mapInArrow(_run_segments, RUNS))
    while True:
        stitched = materialise(
            runs.groupBy("conv_id").applyInPandas(_stitch, STITCHED)
        )
        again = stitched.filter(F.col("earlier").isNotNull())
        if again.isEmpty():
            break
        todo = again.drop("conv_id", "entry").join(several.select("conv_id", "seg", "codes"), "seg")
        runs = materialise(runs.unionByName(todo.mapInArrow(_run_segments, RUNS)))
    solved = several.join(stitched.select("seg", "vector", "entry"), "seg")
    return alone.unionByName(solved).mapInArrow(_trace_segments, TRACED)


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, pa.int64() if kind == "long" else pa.string()) for n, kind in (x.split() for x in schema.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations in order, with the edits of a segment before the segment's first row at the latest."""
    schema = _arrow(EDITS)
    waiting: deque[tuple[str, str]] = deque()
    conv, begun, state, at, held, rows = None, False, 0, 0, ("", "", 0, 0), []

    def inserted() -> None:
        nonlocal state, at
        rows.append((conv, at, None, "I", None, None, NEXT_ROLE[state], ""))
        state, at = NEXT[state], at + 1

    def next_edit() -> tuple[str, str]:
        """The next edit that isn't an insert, and its row's code; inserts before it are written."""
        nonlocal held
        while True:
            letters, codes, i, k = held
            if i == len(letters):
                held = (*waiting.popleft(), 0, 0)
            elif letters[i] == "I":
                held = (letters, codes, i + 1, k)
                inserted()
            else:
                held = (letters, codes, i + 1, k + 1)
                return letters[i], codes[k]

    def close() -> None:
        nonlocal state, at, held
        for _ in range(held[2], len(held[0])):  # what is left are inserts
            inserted()
        state, at, held = 0, 0, ("", "", 0, 0)

    for batch in batches:
        for owner, turn, kind, role, text, codes in _columns(batch, "conv_id turn kind role text codes"):
            if not begun or owner != conv:
                close()
                conv, begun = owner, True
            if kind == 0:
                waiting.append((text, codes))
                continue
            edit, code = next_edit()
            fault, initial = divmod(CODES.index(code), 4)
            new = None
            if edit == "K":
                new, state = role, MAY_KEEP[INITIALS[initial]][state]
            elif edit == "R":
                new, state = NEXT_ROLE[state], NEXT[state]
            rows.append((conv, at, turn, edit, FAULTS[fault], role, new, text))
            at += 1
        if rows:
            yield _batch(rows, schema)
            rows.clear()
    if begun:
        close()
    if rows:
        yield _batch(rows, schema)


def repair(turns: DataFrame) -> DataFrame:
    """One row per edit of ``turns`` (conv_id, turn, role, text), whole conversations in one partition and in order of ``at``:
    the row's turn, role and fault as they were, the edit's initial, the role it has then (null if deleted), its text."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), written("role").alias("role"), written("text").alias("text"))
    edits = _edits_of(_segments(rows)).select("conv_id", "turn", "role", "md5", F.lit(0).alias("kind"), "seg", "text", "codes")
    whole = rows.select("conv_id", "turn", "role", F.md5("text").alias("md5"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("seg"), "text", F.lit(None).cast("string").alias("codes"))
    ordered = edits.unionByName(whole).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "md5", "kind", "seg")
    return ordered.select("conv_id", "turn", "kind", "role", "text", "codes").mapInArrow(_apply, EDITS)


def repaired_turns(edits: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the conversations after repair."""
    return edits.filter("edit <> 'D'").select("conv_id", "at", "role", "text")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(DIGEST)
    conv, begun, out, s = None, False, [], {}

    def new() -> dict:
        return {
            "faults": dict.fromkeys(FAULTS, 0), "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False,
            "low": None, "high": None, "turns": 0, "initial": None,
        }

    def close() -> None:
        gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
        f = s["faults"]
        out.append((conv, gaps, f["blank"], f["duplicate"], f["truncated"], s["illegal"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest()))

    for batch in batches:
        for owner, turn, edit, fault, old, role, text in _columns(batch, "conv_id turn edit fault old_role role text"):
            if not begun or owner != conv:
                if begun:
                    close()
                conv, begun, s = owner, True, new()
            s["audit"].append(edit)
            s["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (fault == "truncated" and edit != "D")
            if edit != "D":
                s["sha"].update((("\n" if s["any"] else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                s["any"] = True
            if edit != "I":
                s["faults"][fault] += 1
                if s["initial"] is not None and s["initial"] + old[:1] not in ("su", "ua", "au"):
                    s["illegal"] += 1
                s["initial"] = old[:1]
                if turn is not None and turn != s["high"]:
                    s["low"], s["high"], s["turns"] = turn if s["low"] is None else s["low"], turn, s["turns"] + 1
        if out:
            yield _batch(out, schema)
            out.clear()
    if begun:
        close()
        yield _batch(out, schema)


def digests(edits: DataFrame) -> DataFrame:
    """One row per conversation of what ``repair`` gives, read in its order, without a shuffle."""
    return edits.mapInArrow(_digest, DIGEST)
