"""Locale noise filters: rule sets written as text, compiled to one expression.

Rule sets are a parameter; the package brings those of all locales as a data file (``default_rule_sets``). Their text uses the notation of the blueprint's rule table: ``="x"`` equals, ``^"x"``
starts with, ``~"x"`` contains, ``bytes < n`` compares the UTF-8 length; AND binds tighter than OR; rules are
parted by `` ; ``. Any hit, or any listed class, removes the log. A locale without a set keeps everything.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.functions.records import canonical_classes

TEST = re.compile(r'([=^~])"((?:[^"\\]|\\.)*)"|bytes\s*<\s*(\d+)')


@dataclass(frozen=True)
class RuleSet:
    classes: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()


def _test(text: str, description: Column) -> Column:
    found = TEST.fullmatch(text.strip())
    if not found:
        raise ValueError(f"not a test: {text!r}")
    kind, value, size = found.groups()
    if size:
        return F.octet_length(description) < int(size)
    return {"=": description == value, "^": description.startswith(value), "~": description.contains(value)}[kind]


def _split(text: str, word: str) -> list[str]:
    """Parts between a word that stands outside quotes and brackets."""
    parts, depth, quoted, last, at = [], 0, False, 0, 0
    while at < len(text):
        char = text[at]
        if char == '"':
            quoted = not quoted
        elif not quoted and char in "()":
            depth += 1 if char == "(" else -1
        elif not quoted and not depth and text.startswith(word, at):
            parts.append(text[last:at])
            last = at + len(word)
            at = last
            continue
        at += 1
    return [*parts, text[last:]]


def compile_rule(text: str, description: Column) -> Column:
    """A rule's text as a boolean expression."""
    if len(either := _split(text, " OR ")) > 1:
        out = compile_rule(either[0], description)
        for part in either[1:]:
            out = out | compile_rule(part, description)
        return out
    if len(both := _split(text, " AND ")) > 1:
        out = compile_rule(both[0], description)
        for part in both[1:]:
            out = out & compile_rule(part, description)
        return out
    text = text.strip()
    if text.startswith("(") and text.endswith(")"):
        return compile_rule(text[1:-1], description)
    return _test(text, description)


def _alternatives(text: str) -> list[list[tuple[str, str]]]:
    """A rule as alternatives of (kind, value) tests that hold together."""
    if len(either := _split(text, " OR ")) > 1:
        return [tests for part in either for tests in _alternatives(part)]
    if len(both := _split(text, " AND ")) > 1:
        out: list[list[tuple[str, str]]] = [[]]
        for part in both:
            out = [a + b for a in out for b in _alternatives(part)]
        return out
    text = text.strip()
    if text.startswith("(") and text.endswith(")"):
        return _alternatives(text[1:-1])
    kind, value, size = TEST.fullmatch(text).groups()
    return [[("<" if size else kind, size or value)]]


def noise(rule_set: RuleSet, description: Column, classes: Column) -> Column:
    """Whether a log is noise under one rule set; null parts never hit."""
    hit = F.lit(False)
    if rule_set.classes:
        hit = hit | F.coalesce(F.arrays_overlap(classes, F.array(*map(F.lit, rule_set.classes))), F.lit(False))
    for rule in rule_set.rules:
        hit = hit | F.coalesce(compile_rule(rule, description), F.lit(False))
    return hit


def parse_rule_table(lines) -> dict[str, RuleSet]:
    """Rule sets from a table of ``| locale | file | size | classes | rules |`` rows, as in the blueprint."""
    found: dict[str, RuleSet] = {}
    for line in lines:
        cells = [c.strip() for c in line.strip().strip("|").split(" | ")]
        if len(cells) != 5 or not re.fullmatch(r"[a-z]{2,3}", cells[0]):
            continue
        mark = re.compile(r"\s*\(:\d+\)\s*$")
        classes = mark.sub("", cells[3])
        rules = tuple(mark.sub("", r).strip() for r in cells[4].split(" ; ") if TEST.search(r))
        found[cells[0]] = RuleSet(tuple(c.strip() for c in classes.split(",") if re.search(r"[a-z]", c)), rules)
    return found


def read_rule_sets(text: str) -> dict[str, RuleSet]:
    """Rule sets from text: ``[locale]`` lines, each followed by its ``class x`` and ``rule y`` lines; ``#`` starts a remark."""
    found: dict[str, tuple[list[str], list[str]]] = {}
    classes, tests = [], []
    for line in text.splitlines():
        if line.startswith("["):
            classes, tests = found.setdefault(line.strip("[]"), ([], []))
        elif line.startswith("class "):
            classes.append(line[6:])
        elif line.startswith("rule "):
            tests.append(line[5:])
    return {locale: RuleSet(tuple(c), tuple(t)) for locale, (c, t) in found.items()}


@functools.cache
def default_rule_sets() -> Mapping[str, RuleSet]:
    """The rule sets that come with the package."""
    return read_rule_sets(resources.files("lawmill.data").joinpath("noise_rules.txt").read_text(encoding="utf-8"))


def filter_noise(
    logs: DataFrame,
    rule_sets: Mapping[str, RuleSet | Callable[[Column, Column], Column]],
    state: str = "state",
    description: Column | None = None,
    classes: Column | None = None,
    alias: str = "default",
    strict_legacy: bool = False,
) -> DataFrame:
    """Logs without noise. ``alias="none"`` keeps all; a callable makes its own expression of (description, classes).

    One branch per locale, picked by the state before any text is compared, so rows pay for their own set only.
    """
    if alias == "none":
        return logs
    description = F.col("log.action.description") if description is None else description
    classes = canonical_classes(F.col("log.action"), strict_legacy) if classes is None else classes
    hit = F.lit(False)
    for locale, rule_set in rule_sets.items():
        expression = rule_set(description, classes) if callable(rule_set) else noise(rule_set, description, classes)
        hit = F.when(F.col(state) == locale, expression).otherwise(hit)
    return logs.filter(~hit)


def filter_noise_by_locale(logs: DataFrame, rule_sets: Mapping[str, RuleSet], state: str, description: str, classes: str) -> DataFrame:
    """The same as a join with a small table of single tests, for rule sets too large for one expression.

    Each rule becomes alternatives of tests; a log goes if one alternative has all of its tests true.
    """
    spark = logs.sparkSession
    rows = [(locale, list(r.classes), [a for rule in r.rules for a in _alternatives(rule)]) for locale, r in rule_sets.items()]
    table = spark.createDataFrame(rows, "_locale string, _classes array<string>, _rules array<array<struct<kind:string,value:string>>>")

    def holds(test: Column) -> Column:
        text = F.col(description)
        return (
            F.when(test["kind"] == "=", text == test["value"])
            .when(test["kind"] == "^", text.startswith(test["value"]))
            .when(test["kind"] == "~", text.contains(test["value"]))
            .otherwise(F.octet_length(text) < test["value"].cast("int"))
        )

    joined = logs.join(F.broadcast(table), logs[state] == table["_locale"], "left")
    by_text = F.exists("_rules", lambda rule: F.forall(rule, lambda t: F.coalesce(holds(t), F.lit(False))))
    by_class = F.arrays_overlap(F.coalesce(classes, F.array()), F.col("_classes"))
    hit = F.coalesce(by_text, F.lit(False)) | F.coalesce(by_class, F.lit(False))
    return joined.filter(~hit).drop("_locale", "_classes", "_rules")
