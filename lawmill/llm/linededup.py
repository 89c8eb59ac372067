"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

A line's key is the line without ASCII white space at either end and with A-Z lower-cased. A key of
``min_chars`` code points or more that at least ``min_docs`` documents hold loses all of its lines,
except those in the largest ``doc_id`` that holds it.

Defined results: a null or empty text is one empty line; a null ``doc_id`` counts as one document and is
never the largest; repeated rows with one ``doc_id`` are one document when counted and each keep their own
row; ties can't be, as the largest doc_id is one; very long texts are taken whole, in time in proportion to their
lines; an empty table gives an empty table; further columns pass through ``dedup_lines``, whatever their names.

Scale: documents that hold one hot line meet in a count, which each map task folds first; only keys over the
threshold are joined back, with the places of their lines: as a broadcast table while they are counted to be few, else
in a join of one row per key on that side, so that Spark can split a hot key. The texts are shuffled once, by document.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.llm.arrays import once
from lawmill.llm.rows import pack, unpack
from lawmill.session import materialise, small

BROADCAST_KEYS = 500_000
WHITE = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; plain lower() where there are only ASCII characters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key_hash(min_chars: int):
    """Line to 128 bits of its key's hash, null for a key below the length."""

    def hashed(line: Column) -> Column:
        stripped = F.btrim(line, F.lit(WHITE))
        key = ascii_lower(stripped)
        return F.when(
            F.char_length(stripped) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))
        )

    return hashed


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` (doc_id, text and columns of other names) with ``_lines`` (array before dropping) and ``_kept`` (array of the lines that stay)."""
    key = _key_hash(min_chars)
    hashes = F.transform(lines_of(F.col("text")), lambda line, at: F.struct(key(line).alias("h"), at.alias("at")))
    # rows without a doc_id are one document when counted, but their lines are kept apart by their texts
    bare = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    found = docs.select(F.col("doc_id").alias("_doc"), bare.alias("_bare"), F.explode(F.filter(hashes, lambda x: x["h"].isNotNull())).alias("_x")).select(
        "_doc", "_bare", "_x.h.a", "_x.h.b", "_x.at"
    )
    pairs = materialise(found.groupBy("a", "b", "_doc", "_bare").agg(F.collect_set("at").alias("_at")))
    common = materialise(
        pairs.groupBy("a", "b")
        .agg((F.count("_doc") + F.max(F.col("_doc").isNull().cast("int"))).alias("_n"), F.max("_doc").alias("_last"))
        .filter(F.col("_n") >= min_docs)
        .select("a", "b", "_last")
    )
    each = F.transform("_at", lambda at: F.struct("a", "b", at.alias("at")))
    drops = (
        pairs.join(small(common, BROADCAST_KEYS), ["a", "b"])
        .filter(~F.col("_doc").eqNullSafe(F.col("_last")))
        .groupBy("_doc", "_bare")
        .agg(F.flatten(F.collect_list(each)).alias("_drop"))
    )
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops["_doc"]) & bare.eqNullSafe(drops["_bare"]), "left").drop("_doc", "_bare")
    lines = lines_of(F.col("text"))

    def without(all_lines: Column) -> Column:
        # another row of the same doc_id may have other lines at these places, so the key is looked at again
        gone = F.filter("_drop", lambda d: F.coalesce(key(F.get(all_lines, d["at"])) == F.struct(d["a"].alias("a"), d["b"].alias("b")), F.lit(False)))
        stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.transform(gone, lambda d: d["at"]))
        return F.transform(stay, lambda at: F.get(all_lines, at))

    return joined.withColumn("_lines", lines).withColumn("_kept", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(once(F.col("_lines"), without))).drop("_drop")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text`` and ``n_chars`` brought up to date."""
    done = drop_repeated_lines(pack(docs, "doc_id", "text"), min_chars, min_docs)
    changed = F.size("_lines") != F.size("_kept")
    new = {"text": F.when(changed, F.array_join("_kept", "\n")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.char_length(new["text"]).cast(kind)).otherwise(F.col("_rest.n_chars"))
    return unpack(done, docs.columns, "doc_id", "text", **new)
