"""Keys, paths and identifiers of bills, logs and jurisdictions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lawmill.functions.text import slugify
from lawmill.functions.times import compact_ts

#: Action classes whose logs are named by class. Fixed values.
TRACKED_CLASSES = ("introduction", "passage", "executive-receipt", "became-law")
#: Names of jurisdictions by code. Fixed values.
STATE_NAMES = {
    "al": "Alabama", "ak": "Alaska", "az": "Arizona", "ar": "Arkansas", "ca": "California", "co": "Colorado", "ct": "Connecticut",
    "de": "Delaware", "fl": "Florida", "ga": "Georgia", "hi": "Hawaii", "id": "Idaho", "il": "Illinois", "in": "Indiana",
    "ia": "Iowa", "ks": "Kansas", "ky": "Kentucky", "la": "Louisiana", "me": "Maine", "md": "Maryland", "ma": "Massachusetts",
    "mi": "Michigan", "mn": "Minnesota", "ms": "Mississippi", "mo": "Missouri", "mt": "Montana", "ne": "Nebraska", "nv": "Nevada",
    "nh": "New Hampshire", "nj": "New Jersey", "nm": "New Mexico", "ny": "New York", "nc": "North Carolina", "nd": "North Dakota",
    "oh": "Ohio", "ok": "Oklahoma", "or": "Oregon", "pa": "Pennsylvania", "ri": "Rhode Island", "sc": "South Carolina",
    "sd": "South Dakota", "tn": "Tennessee", "tx": "Texas", "ut": "Utah", "vt": "Vermont", "va": "Virginia", "wa": "Washington",
    "wv": "West Virginia", "wi": "Wisconsin", "wy": "Wyoming", "dc": "District of Columbia", "pr": "Puerto Rico", "gu": "Guam",
    "vi": "U.S. Virgin Islands", "mp": "Northern Mariana Islands", "as": "American Samoa", "usa": "United States",
}


def org_classification(text: Column, missing: str | None = None) -> Column:
    """Class in a ``~{json}`` organisation reference."""
    found = F.try_variant_get(F.try_parse_json(F.regexp_replace(text, "^~", "")), "$.classification", "string")
    return found if missing is None else F.coalesce(found, F.lit(missing))


def jurisdiction_code(jurisdiction: Column, fallback: Column | None = None, names: Mapping[str, str] | None = None) -> Column:
    """State code of a jurisdiction id, ``usa`` for the federal one, else by name, else the fallback."""
    code = F.nullif(F.regexp_extract(jurisdiction, r"(?:state|territory|district):([a-z]{2})\b", 1), F.lit(""))
    federal = F.when(jurisdiction.contains("country:us"), "usa")
    named = F.lit(None).cast("string")
    for name, value in (names or {}).items():
        named = F.when(F.lower(jurisdiction) == name.lower(), value).otherwise(named)
    return F.coalesce(code, federal, named, fallback if fallback is not None else F.lit(None))


def jurisdiction_name(name: Column, code: Column) -> Column:
    """The given name, else by code, else the code in upper case or ``?``."""
    known = F.element_at(F.create_map(*(F.lit(x) for pair in STATE_NAMES.items() for x in pair)), code)
    return F.coalesce(F.nullif(name, F.lit("")), known, F.upper(code), F.lit("?"))


def path_part(path: Column, name: str) -> Column:
    """The part after ``name:`` in a path, or the part after a folder called ``name``."""
    keyed = F.regexp_extract(path, rf"{name}:([^/]+)", 1)
    folder = F.regexp_extract(path, rf"(?:^|/){name}/([^/]+)", 1)
    return F.coalesce(F.nullif(keyed, F.lit("")), F.nullif(folder, F.lit("")))


def path_info(path: Column) -> Column:
    """Struct of country, state, session and bill of a data path."""
    return F.struct(
        path_part(path, "country").alias("country"), path_part(path, "state").alias("state"),
        path_part(path, "sessions").alias("session_id"), path_part(path, "bills").alias("bill_id"),
    )


def session_of(session: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(session, F.lit("")), path_part(path, "sessions"))


def bill_id(identifier: Column) -> Column:
    return F.replace(identifier, F.lit(" "), F.lit(""))


def bill_key(state: Column, session: Column, identifier: Column) -> Column:
    return F.concat_ws("/", F.lower(state), session, bill_id(identifier))


def action_log_key(date: Column, description: Column, classification: Column, organization: Column) -> Column:
    """File key of an action's log: by class and chamber if the first class is tracked, else by the description."""
    stamp = F.coalesce(compact_ts(date), F.lit("unknown"))
    first = F.get(classification, 0)
    by_class = F.concat_ws(".", stamp, F.lit("classification"), first, org_classification(organization, "unknown"))
    slug = slugify(F.coalesce(description, F.lit("no_description")))
    return F.when(first.isin(*TRACKED_CLASSES), by_class).otherwise(F.concat_ws("_", stamp, slug))


def vote_log_key(date: Column, result: Column, organization: Column) -> Column:
    stamp = F.coalesce(compact_ts(date), F.lit("unknown"))
    passed = F.concat_ws(".", stamp, F.lit("vote_event.pass"), org_classification(organization, "unknown"))
    return F.when(result == "pass", passed).otherwise(F.concat_ws("_", stamp, F.lit("vote_event"), slugify(F.coalesce(result, F.lit("unknown")))))


def vote_result(text: Column) -> Column:
    """pass, fail or unknown from a result or a log's file name."""
    found = F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), r"(pass|fail)", 1)
    return F.when(found == "", "unknown").otherwise(found)


def repo_name(locale: Column) -> Column:
    return F.concat(F.lower(locale), F.lit("-legislation"))


def locale_of_repo(path: Column) -> Column:
    """Locale of the repository that a path starts with."""
    return F.regexp_replace(F.split(path, "/")[0], "-legislation$", "")
