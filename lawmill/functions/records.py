"""Whole records: reshaping, pruning, hashing, text of a bill and feed items."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITIES = "array<struct<entity_type:string,entity_id:string,name:string,note:string>>"
VOLATILE = ("_id", "scraped_at", "_processing", "timestamp", "sources")


def canonical_classes(action: Column, strict_legacy: bool = False) -> Column:
    """Classes of an action in either writer's field; the legacy rule knows only the older field."""
    return action["classification"] if strict_legacy else F.coalesce(action["classification"], action["classifications"])


def reshape_action(action: Column, session: Column, sources: Column) -> Column:
    """The log's action struct, with the defaults for what is missing."""
    return F.struct(
        F.coalesce(action["description"], F.lit("no_description")).alias("description"),
        F.coalesce(action["date"], F.lit("no_date")).alias("occurred_at"),
        F.coalesce(action["organization_id"], F.lit("no_jurisdiction")).alias("jurisdiction_id"),
        session.alias("session_id"),
        F.lit("bill").alias("entity_type"),
        F.coalesce(canonical_classes(action), F.array().cast("array<string>")).alias("classifications"),
        F.coalesce(action["related_entities"], F.array().cast(ENTITIES)).alias("related_entities"),
        sources.alias("sources"),
    )


def prune(column: Column, kind: T.DataType) -> Column:
    """A typed value without its empty parts: "", [], {} and structs of nothing become null at every depth."""
    if isinstance(kind, T.StringType):
        return F.nullif(column, F.lit(""))
    if isinstance(kind, T.ArrayType):
        kept = F.filter(F.transform(column, lambda x: prune(x, kind.elementType)), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.MapType):
        kept = F.map_filter(F.transform_values(column, lambda _, v: prune(v, kind.valueType)), lambda _, v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.StructType):
        parts = [prune(column[f.name], f.dataType).alias(f.name) for f in kind.fields]
        filled = F.lit(False)
        for part in parts:
            filled = filled | part.isNotNull()
        return F.when(filled, F.struct(*parts))
    return column


def prune_rows(df: DataFrame) -> DataFrame:
    return df.select(*(prune(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def _pruned(value):
    """Plain data without null, "", [] and {} at any depth; None if nothing is left."""
    if isinstance(value, dict):
        kept = {k: p for k, v in value.items() if (p := _pruned(v)) is not None}
        return kept or None
    if isinstance(value, list):
        return [p for v in value if (p := _pruned(v)) is not None] or None
    return None if value is None or value == "" else value


@F.pandas_udf(T.StringType())
def prune_json(texts: pd.Series) -> pd.Series:
    """The same for JSON text of any shape; null for text that isn't JSON or holds nothing."""

    def one(text):
        try:
            kept = _pruned(json.loads(text))
        except (TypeError, ValueError):
            return None
        return None if kept is None else json.dumps(kept, ensure_ascii=False, separators=(",", ":"))

    return texts.map(one)


def drop_keys(column: Column, kind: T.DataType, names=("_id", "scraped_at")) -> Column:
    """A typed value without the named fields at any depth."""
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: drop_keys(x, kind.elementType, names))
    if isinstance(kind, T.StructType):
        kept = [drop_keys(column[f.name], f.dataType, names).alias(f.name) for f in kind.fields if f.name not in names]
        return F.when(column.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    return column


def json_path(value: Column, path: str) -> Column:
    """Text at a dotted path of objects and array indexes in JSON text; null where it is missing."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.try_variant_get(F.try_parse_json(value), f"${steps}", "string")


def sorted_fields(column: Column, kind: T.DataType, drop: Sequence[str] = ()) -> Column:
    """A typed value with the fields of its structs in the order of their names at every depth, without the dropped ones at the top."""
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: sorted_fields(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(column))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], sorted_fields(e["value"], kind.valueType))))
    if isinstance(kind, T.StructType):
        fields = sorted((f for f in kind.fields if f.name not in drop), key=lambda f: f.name)
        if not fields:
            return column
        return F.when(column.isNotNull(), F.struct(*(sorted_fields(column[f.name], f.dataType).alias(f.name) for f in fields)))
    return column


def content_hash(*columns: str, schema: T.StructType | None = None) -> Column:
    """SHA-256 of the JSON of some columns, keys sorted by name at the top, and at every depth where their schema is given;
    null parts are written as null. Volatile fields (``VOLATILE``) of the named columns are left out."""
    names = sorted(columns)
    values = [F.col(n) if schema is None else sorted_fields(F.col(n), schema[n].dataType, VOLATILE) for n in names]
    return F.sha2(F.to_json(F.struct(*(v.alias(n) for v, n in zip(values, names))), {"ignoreNullFields": "false"}), 256)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def bill_text(title, subject, abstracts, session, organization, description, bill_id, others: Column | None = None) -> Column:
    """One text to score: the known parts in a fixed order, then other strings by key, blanks between."""
    parts = [title, F.array_join(subject, " "), F.array_join(F.transform(abstracts, lambda a: a["abstract"]), " "),
             session, organization, description, bill_id]
    if others is not None:
        parts.append(F.array_join(F.transform(F.array_sort(F.map_entries(others)), lambda e: e["value"]), " "))
    return F.concat_ws(" ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def merge_processing(theirs: Column, ours: Column, stamp: str = "text_extraction_latest_update") -> Column:
    """Theirs, with only our extraction stamp laid over it."""
    only = F.map_filter(ours, lambda k, v: k == stamp)
    return F.map_concat(F.map_filter(theirs, lambda k, v: (k != stamp) | F.element_at(ours, stamp).isNull()), only)


def feed_title(tags: Column, repo: Column, title: Column, identifier: Column) -> Column:
    """Tags, repository and title or identifier, with a word for each that is missing."""
    names = F.coalesce(F.nullif(F.array_join(F.array_sort(tags), ", "), F.lit("")), F.lit("untagged"))
    name = F.coalesce(F.nullif(F.trim(title), F.lit("")), identifier, F.lit("Legislative Update"))
    return F.concat_ws(" - ", names, F.coalesce(repo, F.lit("unknown")), name)


def _line(label: str, value: Column) -> Column:
    """``label: value``, null without a value."""
    return F.concat(F.lit(f"{label}: "), value)


def _items(label: str, values: Column, indent: int) -> Column:
    """A label and its values, one a line behind a dash; null without a value."""
    dash = "\n" + " " * indent + "- "
    present = F.array_compact(values)
    return F.when(F.size(present) > 0, F.concat(F.lit(f"{label}:{dash}"), F.array_join(present, dash)))


def _block(head: str, lines: list[Column], indent: int) -> Column:
    """A head and the lines that are present, indented; null without a line."""
    gap = "\n" + " " * indent
    present = F.array_compact(F.array(*lines))
    return F.when(F.size(present) > 0, F.concat(F.lit(head + gap), F.array_join(present, gap)))


def feed_description(row_id: Column, action: Column, bill_id: Column, bill: Column, classes: Column | None = None) -> Column:
    """The labelled text block of a feed item: id, the log with its action, the bill; a word where all is missing.

    ``action`` has description, date, classification and organization_id; ``bill`` has identifier, title,
    legislative_session, subject and abstracts (abstract, note)."""
    acted = [
        _line("description", action["description"]), _line("date", action["date"]),
        _items("classification", action["classification"] if classes is None else classes, 6), _line("organization_id", action["organization_id"]),
    ]
    log = _block("log:", [F.when(F.lit(True), _block("  action:", acted, 4)), _line("  bill_id", bill_id)], 0)
    abstracts = F.transform(
        F.filter(bill["abstracts"], lambda a: a["abstract"].isNotNull()),
        lambda a: F.concat(F.lit("abstract"), F.when(F.coalesce(a["note"], F.lit("")) != "", F.concat(F.lit(" ("), a["note"], F.lit(")"))).otherwise(""), F.lit(": "), a["abstract"]),
    )
    known = [
        _line("identifier", bill["identifier"]), _line("title", bill["title"]), _line("legislative_session", bill["legislative_session"]),
        _items("subject", bill["subject"], 4), F.when(F.size(abstracts) > 0, F.array_join(abstracts, "\n  ")),
    ]
    parts = F.array_compact(F.array(_line("id", row_id), log, _block("bill:", known, 2)))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise("Legislative update")


def feed_link(base: Column, bill_source: Column, first_url: Column) -> Column:
    """The base and the bill's path where both are known, else the bill's first source."""
    return F.coalesce(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), bill_source), first_url)


def guid(log_path: Column, timestamp: Column, row_id: Column) -> Column:
    return F.coalesce(F.nullif(log_path, F.lit("")), F.concat(F.coalesce(timestamp, F.lit("")), F.lit("_"), F.coalesce(row_id, F.lit(""))))
