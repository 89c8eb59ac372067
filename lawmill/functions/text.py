"""Text columns: slugs, truncation, case, escaping, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of a page that needs JavaScript. Fixed values.
SCRIPT_PHRASES = (
    "enable javascript",
    "enable it to continue",
    "doesn't work properly without javascript",
    "does not work properly without javascript",
    "requires javascript",
)


def slugify(text: Column, limit: int = 100) -> Column:
    """Lower case, letters, digits and underscores only (no combining marks), white space folded to one underscore, none at
    the ends, cut to ``limit``."""
    plain = F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+", "_"), "^_+|_+$", ""), 1, limit)


def file_slug(text: Column) -> Column:
    """A safe file name: anything but ASCII letters, digits, dot, dash and underscore becomes one underscore."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def session_slug(text: Column) -> Column:
    """Lower-case session id, null unless it is letters, digits and dashes."""
    slug = F.lower(F.regexp_replace(F.trim(text), r"[ _]+", "-"))
    return F.when(slug.rlike(r"^[a-z0-9][a-z0-9-]*$"), slug)


def truncate(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def title_case(tag: Column) -> Column:
    return F.initcap(F.replace(tag, F.lit("_"), F.lit(" ")))


def xml_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments go, tags become blanks, common entities are read, blanks fold."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n\f]+", " "))


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_placeholder(html: Column, text: Column, least: int = 200) -> Column:
    """Whether a page holds no document: it asks for JavaScript or has too little text."""
    low = F.lower(html)
    asks = F.lit(False)
    for phrase in SCRIPT_PHRASES:
        asks = asks | low.contains(phrase)
    return asks | (F.char_length(F.trim(text)) < least)


def sniff(content_type: Column, text: Column) -> Column:
    """xml, pdf or html by content type and first bytes."""
    head = F.substring(text, 1, 1000)
    return (
        F.when(F.lower(F.coalesce(content_type, F.lit(""))).contains("xml") | F.ltrim(head).startswith("<?xml") | head.contains("<bill>"), "xml")
        .when(head.startswith("%PDF-"), "pdf")
        .otherwise("html")
    )


def metric_escape(text: Column) -> Column:
    """Tag escaping of the line protocol: backslash before backslash, comma, equals sign and blank; null for a line break."""
    return F.when(~text.rlike(r"[\r\n]"), F.regexp_replace(text, r"([\\,= ])", r"\\$1"))


def metric_number(value: Column) -> Column:
    """Integers without decimals."""
    return F.when(value == F.floor(value), F.floor(value).cast("bigint").cast("string")).otherwise(value.cast("string"))


def routine_line(line: Column) -> Column:
    """Class of a log line: ``routine`` (HH:MM:SS INFO), ``warning`` (a python warning), ``other``."""
    return (
        F.when(line.rlike(r"^\d{2}:\d{2}:\d{2} INFO"), "routine")
        .when(line.rlike(r"^/[^ ]*:[0-9]+: [A-Za-z_]+Warning: "), "warning")
        .otherwise("other")
    )


def log_noise(line: Column) -> Column:
    """Blank lines and group marks."""
    return (F.trim(line) == "") | line.startswith("##[group]") | line.startswith("##[endgroup]")
