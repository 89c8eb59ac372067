"""Secret scan with corpus-wide ownership frequency.

Base patterns find credential-like text. Each match's value is hashed, and the corpus is asked how many distinct
documents (the repositories here) and sources (their owners) hold that hash: a value that more than ``MAX_OWNERS``
owners or more than ``MAX_DOCUMENTS`` repositories hold is a widely copied example, even if all copies are of one owner;
any other stays with its owner and looks live, though a document and with it the value may have been copied once. The
scan adds an ``owned`` span over the value of each owner-specific match and never removes a base span.

Positions count code points, ends are exclusive. A document's own matches stay in its row: splitting the text
at a pattern and extracting the same pattern gives the gaps and the matches, whose lengths add up to positions.

Defined results: null text is empty; a null source is an owner of its own; a null doc_id counts as one
document; repeated rows are scanned each, and their copies of a value count once per doc_id; very long texts are scanned
whole, in time in proportion to their matches; no match gives an empty list; an empty table gives no rows; only the
three columns are read, so others may have any names.

Scale: only matches are shuffled (hash, document, owner), first folded per (hash, owner, document), so a value
that a third of all documents hold meets as a count. The texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.llm.arrays import once, running_sums
from lawmill.session import materialise

#: Kind, pattern, group that holds the value, least length of the group. Fixed values of the scan.
KINDS = (
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
)
FOUND = "array<struct<start:int,rank:int,end:int,value_start:int,value:string>>"
OWNED = "owned"
MAX_OWNERS = 2
MAX_DOCUMENTS = 20
MIN_VALUE = 12


def _matches(text: Column, rank: int) -> Column:
    """Array of (start, kind rank, end, value start, value) of one kind, in order."""
    kind, pattern, group, least = KINDS[rank]
    regex = F.lit(pattern)
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    value = F.regexp_extract_all(text, regex, F.lit(group))
    pieces = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("w"), value.alias("v")), lambda x: x)
    none = F.from_json(F.lit("[]"), FOUND)

    def found(xs: Column) -> Column:
        ends = running_sums(F.transform(xs, lambda x: (F.char_length(x["g"]) + F.coalesce(F.char_length(x["w"]), F.lit(0))).cast("bigint")))
        placed = F.zip_with(
            xs,
            ends,
            lambda x, end: F.struct(
                (end - F.char_length(x["w"])).cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"),
                (end - F.char_length(x["v"])).cast("int").alias("value_start"), x["v"].alias("value"),
            ),
        )
        return F.filter(placed, lambda m: m["start"].isNotNull() & (F.char_length(m["value"]) >= least))

    # a text without the pattern costs one search and builds nothing
    return F.when(F.size(gaps) > 1, once(pieces, found)).otherwise(none)


def base_matches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``found``: all base matches of the row's text by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string").alias("source")
    return docs.select(
        "doc_id", source, F.array_sort(F.concat(*(_matches(text, rank) for rank in range(len(KINDS))))).alias("found")
    )


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, owners, documents) of every value found."""
    each = found.select("doc_id", "source", F.explode("found").alias("m")).select(
        _value_hash(F.col("m.value")).alias("value_hash"), "source", "doc_id"
    )
    pairs = each.groupBy("value_hash", "source", "doc_id").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("value_hash", "source").agg(F.count(F.lit(1)).alias("documents"))
    return owners.groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("documents").alias("documents"))


def _value_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def scan_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, max_documents: int = MAX_DOCUMENTS, min_value: int = MIN_VALUE) -> DataFrame:
    """Each row's ``doc_id``, ``found`` and ``spans``: array of (start, rank, end, kind) of base and owned spans.

    ``rank`` orders the kinds as listed, owned last. A value shorter than ``min_value`` code points or held by
    more than ``max_owners`` owners or ``max_documents`` documents gets no owned span.
    """
    rows = materialise(base_matches(docs).withColumn("row", F.monotonically_increasing_id()))
    live = ownership(rows).filter((F.col("owners") <= max_owners) & (F.col("documents") <= max_documents)).select("value_hash")
    each = rows.select("row", F.explode("found").alias("m")).filter(F.char_length("m.value") >= min_value)
    owned = (
        each.withColumn("value_hash", _value_hash(F.col("m.value")))
        .join(live, "value_hash", "left_semi")
        .groupBy("row")
        .agg(
            F.collect_set(
                F.struct(F.col("m.value_start").alias("start"), F.lit(len(KINDS)).alias("rank"), F.col("m.end").alias("end"))
            ).alias("owned")
        )
    )
    base = F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["end"].alias("end")))
    spans = F.array_sort(F.when(F.col("owned").isNull(), base).otherwise(F.concat(base, F.col("owned"))))
    return rows.join(owned, "row", "left").select("doc_id", "found", base.alias("base"), spans.alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(kind) for kind, *_ in KINDS), F.lit(OWNED))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
