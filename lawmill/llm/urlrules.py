"""URL filter: listed rules first, then association rules mined with FP-growth.

A url becomes a set of tokens (host suffixes, path parts with digits folded, extension, query keys). FP-growth
over the labelled urls' token sets plus a label token gives rules "tokens => block". A rule stays if at least
``MIN_COUNT`` rows labelled bad hold its tokens (a number of rows, the same at every size), if its confidence over all
labelled rows reaches the bound, and if no rule on fewer of its tokens does. A rule is filed in an inverted index
under its rarest token; a url looks up its own tokens there and a rule fires if the url has all of the rule's tokens.

What FP-growth sees of a url is bounded, as each subset of a url's tokens may be frequent: tokens that fewer than
``MIN_COUNT`` bad rows hold can't be in a rule and go; of tokens that the same labelled rows hold only the longest, the
most specific one, stays; of the rest a url gives the ``MAX_TOKENS`` that part bad from good most. So n labelled urls have
at most 2^12 sets each there, whatever their length. A rule that FP-growth can't see is held by a bad url with more
tokens than that, and ``left_out_sets`` finds all of those level by level, so that no rule is lost. Confidences are
counted again on all tokens of all labelled urls.

Defined results: a null url or one without ``://`` has empty host and path and fits no rule; without labelled
urls or with less than ``MIN_COUNT`` bad ones nothing is mined and the method allows; a null label is no label;
repeated rows are judged each and count each as labels; of rules of one confidence the last by items is named; a very
long url is judged on all of its tokens; an empty table gives an empty table; columns named like the results are
replaced, others may have any names.

Scale: every step is native. The index and the token table are broadcast only while their counted rows stay under a
bound; beyond it the same joins shuffle. Verdicts are worked out once per distinct url.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.llm.linededup import ascii_lower
from lawmill.llm.rows import pack, unpack
from lawmill.session import materialise, small

#: Action, host, path of each listed rule. Fixed values.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
PARTS = r"^(?s).*?://([^/?#]*)([^?#]*)\??([^#]*)"
BLOCK = "label=block"
MIN_COUNT = 5
MIN_CONFIDENCE = 0.8
MAX_TOKENS = 12
BROADCAST_RULES = 20_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest listed rule that fits; of equals the block wins."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, action = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, kind).otherwise(action)
    return rule, action


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url; none for a null url."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(
        labels, lambda x, i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    )
    parts = F.transform(
        F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0"))
    )
    keys = F.transform(
        F.filter(F.split(F.regexp_extract(url, PARTS, 3), "&"), lambda x: x != ""),
        lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)),
    )
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    more = F.when(extension != "", F.array(F.concat(F.lit("ext="), extension))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return F.coalesce(F.array_distinct(F.concat(suffixes, parts, F.coalesce(keys, none), more)), none)


def telling_tokens(rows: DataFrame, min_count: float) -> DataFrame:
    """(token, held, score) from (row, bad, tokens): tokens of enough bad rows, one for each set of rows, by how much they part bad from good."""
    each = rows.select("row", "bad", F.explode("tokens").alias("token"))
    bad = F.sum(F.col("bad").cast("int")).alias("bad")
    held = each.groupBy("token").agg(bad, F.count(F.lit(1)).alias("held"), F.bit_xor(F.xxhash64("row")).alias("same")).filter(F.col("bad") >= min_count)
    one = held.groupBy("bad", "held", "same").agg(F.max(F.struct(F.length("token").alias("n"), "token")).alias("one"))
    return one.select("one.token", "held", (F.col("bad") / F.col("held")).alias("score"))


def count_rules(rules: DataFrame, rows: DataFrame) -> DataFrame:
    """(items, key, bad, held) of rules (items, key): how many rows, and how many bad ones, hold all of the items."""
    hits = rows.select("bad", "tokens", F.explode("tokens").alias("key")).join(rules, "key")
    hits = hits.filter(F.size(F.array_except("items", "tokens")) == 0)
    return hits.groupBy("items", "key").agg(F.sum(F.col("bad").cast("int")).alias("bad"), F.count(F.lit(1)).alias("held"))


def left_out_sets(told: DataFrame, goods: int, least: float, min_confidence: float, max_tokens: int) -> DataFrame:
    """(ids) of the sure sets of two tokens or more that a bad row with more than ``max_tokens`` tokens holds.

    ``told`` is (row, bad, ranked), ranked an array of (by, n, token, id); ``goods`` counts the good rows. Sets grow by a
    token a level. A set goes on only if it isn't sure yet and each token of it shuts out a good row that the others
    let through: a token that shuts out none could be left out of a rule without making it less sure. Both hold for all
    subsets of a minimal rule, so every minimal rule is reached, whatever its length. Rows that hold a set and go on
    alike are counted as one, as in the fit's trees."""
    unsure = F.filter("ranked", lambda t: -t["by"] < min_confidence)
    bad = F.col("bad").cast("long")
    wide = F.col("bad") & (F.size("ranked") > max_tokens)
    each = told.select("row", bad.alias("bads"), (1 - bad).alias("good"), wide.alias("wide"), F.explode(F.transform(unsure, lambda t: t["id"])).alias("id"))
    tally = (F.sum("bads").alias("bads"), F.sum("good").alias("good"), F.max("wide").alias("wide"))
    first = materialise(each.groupBy("id").agg(*tally).filter(F.col("wide") & (F.col("good") < goods)))
    kept = first.select(F.array("id").alias("ids"), "good")
    rows = each.join(small(first.select("id")), "id", "left_semi").groupBy("row").agg(F.sort_array(F.collect_list("id")).alias("tail"), *(F.max(c).alias(c) for c in ("bads", "good", "wide")))
    held = materialise(extended(rows.groupBy("tail").agg(*tally).withColumn("ids", F.array().cast("array<bigint>"))).groupBy("ids", "tail").agg(*tally))
    found = first.select(F.array("id").alias("ids")).limit(0)
    size = 1
    while not kept.isEmpty():
        size += 1
        grown = materialise(extended(held).groupBy("ids", "tail").agg(*tally))
        counted = grown.groupBy("ids").agg(*tally).filter(F.col("wide") & (F.col("bads") >= least))
        parts = counted.select("ids", "bads", "good", F.explode(F.transform("ids", lambda out: F.array_remove("ids", out))).alias("part"))
        parts = parts.join(small(kept.select(F.col("ids").alias("part"), F.col("good").alias("through"))), "part").filter(F.col("good") < F.col("through"))
        whole = parts.groupBy("ids", "bads", "good").agg(F.count(F.lit(1)).alias("parts")).filter(F.col("parts") == size)
        whole = materialise(whole.withColumn("sure", F.col("bads") / (F.col("bads") + F.col("good")) >= min_confidence))
        found = found.union(whole.filter("sure").select("ids"))
        kept = whole.filter(~F.col("sure")).select("ids", "good")
        held = grown.join(small(kept.select("ids")), "ids", "left_semi")
    return found


def extended(held: DataFrame) -> DataFrame:
    """Each (ids, tail, bads, good, wide) with each id of its tail taken over into ids; the ids behind it are the new tail."""
    each = held.select("*", F.posexplode("tail").alias("at", "id"))
    tail = F.slice("tail", F.col("at") + 2, F.size("tail"))
    return each.select(F.concat("ids", F.array("id")).alias("ids"), tail.alias("tail"), "bads", "good", "wide")


def mine_rules(
    labelled: DataFrame, min_support: float = 0.0, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """(rule_id, items, key, support, confidence) from (url, bad boolean). ``key`` is the rule's rarest token.

    ``min_support``, a share of the labelled rows, applies besides ``min_count``. ``max_tokens`` parts the work between
    FP-growth and ``left_out_sets``; the rules are the same for any value."""
    rows = labelled.filter(F.col("bad").isNotNull() & F.col("url").isNotNull()).select("bad", url_tokens(F.col("url")).alias("tokens"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    least = max(min_count, min_support * total)
    # ids from rare to common, so that rows go on alike soon in left_out_sets
    telling = small(materialise(telling_tokens(rows, least).sort("held").withColumn("id", F.monotonically_increasing_id())))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), (-F.length("token")).alias("n"), "token", "id")))
    told = materialise(rows.select("row", "bad", F.explode("tokens").alias("token")).join(telling, "token").groupBy("row", "bad").agg(ranked.alias("ranked")))
    items = F.transform(F.slice("ranked", 1, max_tokens), lambda t: t["token"])
    sets = told.select(F.when(F.col("bad"), F.concat(items, F.array(F.lit(BLOCK)))).otherwise(items).alias("items"))
    # the share is of the sets; half a row less, so that rounding can't ask for one more
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, told.count())), minConfidence=min_confidence).fit(sets)
    found = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK)).select(F.array_sort("antecedent").alias("items"))
    if not told.filter(F.col("bad") & (F.size("ranked") > max_tokens)).isEmpty():
        goods = rows.filter(~F.col("bad")).count()
        left = left_out_sets(told, goods, least, min_confidence, max_tokens).select("ids", F.explode("ids").alias("id")).join(telling, "id")
        left = left.groupBy("ids").agg(F.sort_array(F.collect_list("token")).alias("items")).select("items")
        single = telling.filter(F.col("score") >= min_confidence).select(F.array("token").alias("items"))
        found = found.union(single).union(left).distinct()
    counts = telling.select(F.col("token").alias("item"), "held")
    keyed = found.select("items", F.explode("items").alias("item")).join(counts, "item").groupBy("items").agg(F.min(F.struct("held", "item")).alias("least"))
    counted = count_rules(small(materialise(keyed.select("items", F.col("least.item").alias("key")))), rows)
    sure = materialise(counted.withColumn("confidence", F.col("bad") / F.col("held")).filter((F.col("confidence") >= min_confidence) & (F.col("bad") >= least)))
    # a rule on more tokens than another says nothing new
    fewer = small(sure.select("key", F.col("items").alias("fewer")))
    more = sure.select("items", F.explode("items").alias("key")).join(fewer, "key")
    more = more.filter((F.size("fewer") < F.size("items")) & (F.size(F.array_except("fewer", "items")) == 0)).select("items").distinct()
    minimal = sure.join(more, "items", "left_anti")
    return materialise(minimal.select(F.xxhash64(F.array_join("items", "\x00")).alias("rule_id"), "items", "key", (F.col("bad") / total).alias("support"), "confidence"))


def match_rules(pages: DataFrame, rules: DataFrame, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(url, mined_confidence, mined_items) of each distinct url on which a mined rule fires; the surest rule counts."""
    index = rules.select("key", "items", "confidence")
    if rules.count() <= broadcast_rules:
        index = F.broadcast(index)
    urls = pages.select("url").filter(F.col("url").isNotNull()).distinct().withColumn("tokens", url_tokens(F.col("url")))
    hits = urls.withColumn("key", F.explode("tokens")).join(index, "key")
    hits = hits.filter(F.size(F.array_except("items", "tokens")) == 0)
    best = hits.groupBy("url").agg(F.max(F.struct("confidence", "items")).alias("best"))
    return best.select("url", F.col("best.confidence").alias("mined_confidence"), F.col("best.items").alias("mined_items"))


def judge_urls(pages: DataFrame, rules: DataFrame, listed=RULES) -> DataFrame:
    """``pages`` plus host, path, rule, verdict, mined_confidence and mined_items; columns of these names are replaced."""
    out = pack(pages, "url").join(match_rules(pages, rules), "url", "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, action = listed_rule(host, path, listed)
    mined = F.when(F.col("mined_confidence").isNotNull(), "block").otherwise("allow")
    return unpack(
        out, pages.columns, "url", host=host, path=path, rule=rule, verdict=F.coalesce(action, mined),
        mined_confidence=F.col("mined_confidence"), mined_items=F.col("mined_items"),
    )
