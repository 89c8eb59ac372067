"""Guards, counts, reconciliation of sources, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shrink_guard(old: DataFrame, new: DataFrame, keys: Sequence[str], identifier: str) -> DataFrame:
    """Per key: rows and distinct identifiers of two snapshots, and ``refuse`` where both fell."""
    counted = [
        side.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.count_distinct(identifier).alias(f"{name}_ids"))
        for name, side in (("old", old), ("new", new))
    ]
    both = counted[0].join(counted[1], list(keys), "full_outer").fillna(0)
    return both.withColumn("refuse", (F.col("new_rows") < F.col("old_rows")) & (F.col("new_ids") < F.col("old_ids")))


def content_change(guarded: DataFrame) -> DataFrame:
    """What a commit does: unchanged, dropped, net_new or rescraped."""
    ids = F.col("new_ids") - F.col("old_ids")
    rows = F.col("new_rows") - F.col("old_rows")
    return guarded.withColumn("change", F.when(ids < 0, "dropped").when(ids > 0, "net_new").when(rows != 0, "rescraped").otherwise("unchanged"))


def reconcile(a: DataFrame, b: DataFrame, group: Sequence[str], identifier: str) -> DataFrame:
    """Per group: identifiers in both sources, only a, only b, and a verdict. Blanks and case of identifiers don't count."""
    def norm(df: DataFrame, flag: str) -> DataFrame:
        return df.select(*group, F.upper(F.regexp_replace(F.col(identifier).cast("string"), r"\s+", "")).alias("_id")).distinct().withColumn(flag, F.lit(1))

    both = norm(a, "_a").join(norm(b, "_b"), [*group, "_id"], "full_outer")
    counts = both.groupBy(*group).agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"),
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
    )
    verdict = F.when((F.col("only_a") == 0) & (F.col("only_b") == 0), "agree").when((F.col("only_a") == 0) | (F.col("only_b") == 0), "subset").otherwise("split")
    return counts.withColumn("verdict", verdict)


def union_backfill(sources: Sequence[DataFrame], keys: Sequence[str], order: Column) -> DataFrame:
    """Every key of any source, in its most complete or recent version."""
    from lawmill.operators.latest import best_row

    merged = sources[0]
    for other in sources[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return best_row(merged, keys, order)


def expected_vs_actual(expected: DataFrame, actual: DataFrame, name: str) -> DataFrame:
    """(name, status): missing or surplus."""
    e, a = expected.select(name), actual.select(name)
    return e.exceptAll(a).distinct().withColumn("status", F.lit("missing")).unionByName(a.subtract(e).withColumn("status", F.lit("surplus")))


def outcome_counts(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extraction counters from an ``outcome`` column and the sorted distinct failure reasons joined by plus signs."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(F.col("outcome") == kind).alias(kind) for kind in ("ok", "error", "unavailable", "skipped")),
        F.array_join(F.array_sort(F.collect_set("reason")), "+").alias("reasons"),
    )


def rate_with_total(df: DataFrame, key: str, hit: Column, error: Column) -> DataFrame:
    """Rate per key and in total, errors counted apart."""
    return (
        df.rollup(key)
        .agg(F.grouping(key).cast("int").alias("is_total"), F.count_if(~error).alias("checked"), F.count_if(hit & ~error).alias("hits"), F.count_if(error).alias("errors"))
        .withColumn("pct", F.when(F.col("checked") > 0, F.round(100.0 * F.col("hits") / F.col("checked"), 2)))
    )


def backlog(bills: DataFrame, texts: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Bills, bills with text and missing ones at every level of the given columns."""
    have = texts.select(*keys).distinct().withColumn("_has", F.lit(True))
    return (
        bills.join(have, list(keys), "left")
        .cube(*by)
        .agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("bills"), F.count_if(F.col("_has").isNotNull()).alias("with_text"))
        .withColumn("missing", F.col("bills") - F.col("with_text"))
    )


def chronic(state: DataFrame, least: int = 3) -> DataFrame:
    return state.filter(F.col("occurrences") >= least)


def outstanding_errors(errors: DataFrame, key: str, ts: str) -> DataFrame:
    """Per key how many errors are open and since when."""
    return errors.groupBy(key).agg(F.count(F.lit(1)).alias("errors"), F.min(ts).alias("since"))


def counts_by_kind(objects: DataFrame, kind: str = "kind") -> DataFrame:
    """Processing counters by kind of object."""
    return objects.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def status_mismatch(configured: DataFrame, verified: DataFrame, key: str = "locale", status: str = "status") -> DataFrame:
    """Locales whose configured status isn't the verified one, or that only one side lists."""
    a = configured.select(key, F.col(status).alias("configured"))
    b = verified.select(key, F.col(status).alias("verified"))
    return a.join(b, key, "full_outer").filter(~F.col("configured").eqNullSafe(F.col("verified")))


def unreported(findings: DataFrame, known: DataFrame, keys: Sequence[str] = ("state", "symptom")) -> DataFrame:
    return findings.join(known.select(*keys).distinct(), list(keys), "left_anti")
