"""Bill documents: candidates, text, outcome, availability."""

from __future__ import annotations

from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawmill.functions.text import html_placeholder, html_text

#: Preference of document kinds. Fixed values.
PREFERENCE = {"text/xml": 1, "text/html": 2, "application/pdf": 3, "text/plain": 4}
MARKUP_NOTE = (
    "Visual Markup Detected: true -- this document likely contains redline (strikethrough/underline) formatting; "
    "plain text extraction may not faithfully represent what the bill changes. See the saved original file."
)
RULE = "=" * 80


def preference(media_type: Column) -> Column:
    rank = F.lit(9)
    for kind, place in reversed(PREFERENCE.items()):
        rank = F.when(F.lower(media_type).contains(kind), place).otherwise(rank)
    return rank


def candidates(links: DataFrame, keys=("bill_id", "note")) -> DataFrame:
    """The first link of each kind of a version, ranked: xml, html, pdf, plain text."""
    ranked = links.withColumn("preference", preference(F.col("media_type"))).filter(F.col("preference") < 9)
    first = ranked.groupBy(*keys, "preference").agg(F.min_by(F.struct("url", "media_type"), "position").alias("link"))
    return first.select(*keys, "preference", "link.*").withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("preference")))


class _Text(HTMLParser):
    """Collects text outside script and style, and the title."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self.skip, self.in_title = [], [], 0, False

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.in_title = tag == "title"

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in ("script", "style")))
        self.in_title = False

    def handle_data(self, data):
        if not self.skip:
            (self.title if self.in_title else self.parts).append(data)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def parse_html(pages: pd.Series) -> pd.DataFrame:
    """Title and text by a parser, for pages where patterns are not enough; null for null."""
    titles, texts = [], []
    for page in pages:
        if page is None:
            titles.append(None)
            texts.append(None)
            continue
        reader = _Text()
        reader.feed(page)
        reader.close()
        titles.append(" ".join("".join(reader.title).split()) or None)
        texts.append(" ".join(" ".join(reader.parts).split()))
    return pd.DataFrame({"title": titles, "text": texts})


XML_PARTS = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("official_title", T.StringType()), T.StructField("sections", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())]
)


@F.pandas_udf(XML_PARTS)
def xml_parts(documents: pd.Series) -> pd.DataFrame:
    """Title, official title, the sections' texts and the whole text of a bill in XML; nulls for input that isn't well-formed.

    The platform's own XPath functions end the job at the first such input and at any DOCTYPE, so a parser reads each
    document by itself; it fetches no external definition, and an entity that only such a one names counts as malformed."""
    rows = []
    for document in documents:
        try:
            root = ElementTree.fromstring(document)
        except (ElementTree.ParseError, TypeError, ValueError):
            rows.append((None, None, None, None))
            continue
        own = lambda tag: (root.findtext(f".//{tag}") or "").strip()  # noqa: B023, E731
        whole = lambda element: "".join(element.itertext()).strip()
        sections = [text for section in root.iterfind(".//section") if (text := whole(section))]
        rows.append((own("title"), own("official-title"), sections, whole(root)))
    return pd.DataFrame(rows, columns=XML_PARTS.names)


def outcome(content: Column, media_type: Column) -> Column:
    """Struct of outcome, reason and text of one fetched document."""
    text = F.when(F.lower(media_type).contains("html"), html_text(content)).when(F.lower(media_type).contains("xml"), xml_parts(content)["text"]).otherwise(content)
    reason = (
        F.when(content.isNull(), "download_failed")
        .when(F.lower(media_type).contains("xml") & text.isNull(), "parsing_failed")
        .when(F.lower(media_type).contains("html") & html_placeholder(content, text), "placeholder_only")
        .when(F.trim(text) == "", "no_text_layer")
    )
    return F.struct(F.when(reason.isNull(), "ok").otherwise("unavailable").alias("outcome"), reason.alias("reason"), F.when(reason.isNull(), text).alias("text"))


def extract(ranked: DataFrame, fetched: DataFrame, keys=("bill_id", "note")) -> DataFrame:
    """Per version the first candidate with text, else all reasons joined."""
    tried = ranked.join(fetched, "url", "left").withColumn("result", outcome(F.col("content"), F.col("media_type")))
    ok = F.col("result.outcome") == "ok"
    return tried.groupBy(*keys).agg(
        F.min_by(F.when(ok, F.struct("url", "media_type", "result.text")), F.when(ok, F.col("rank"))).alias("best"),
        F.array_join(F.array_sort(F.collect_set("result.reason")), "+").alias("reasons"),
        F.count(F.lit(1)).alias("tried"),
    ).select(*keys, "best.*", F.when(F.col("best").isNull(), F.col("reasons")).alias("reason"), "tried")


def text_document(title: Column, official: Column, source: Column, media_type: Column, markup: Column, text: Column) -> Column:
    """Header, a rule and the text."""
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), F.coalesce(title, F.lit("N/A"))),
        F.concat(F.lit("Official Title: "), F.coalesce(official, F.lit("N/A"))),
        F.concat(F.lit("Source: "), source),
        F.concat(F.lit("Media Type: "), media_type),
        F.when(markup, F.lit(MARKUP_NOTE)),
    )
    return F.concat(head, F.lit(f"\n\n{RULE}\n\n"), F.coalesce(text, F.lit("")))


def availability(before: DataFrame, results: DataFrame, key: str, now: Column) -> DataFrame:
    """State after a run: reason and time of what stays unavailable, the stamp of what was read."""
    both = before.join(results, key, "full_outer")
    ok = F.col("outcome") == "ok"
    return both.select(
        key,
        F.when(ok, now).otherwise(F.col("extracted_at")).alias("extracted_at"),
        F.when(F.col("outcome") == "unavailable", F.col("new_reason")).when(ok, None).otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("outcome") == "unavailable", now).when(ok, None).otherwise(F.col("checked_at")).alias("checked_at"),
    )
