"""URL filters: given host and path rules first, mined association rules for the rest.

Tokens of labelled URLs that exactly the same rows hold count as one. Spark's
FP-growth mines the token combinations of the blocked URLs; each is then counted
over all labelled URLs, and as rules those stay that conclude "block" with enough
support and confidence, and that no more general rule with at least their
confidence makes needless. A token whose URLs are all blocked is a rule by itself,
and as nothing that holds it can be surer, it is not mined further. Each rule is
filed in an inverted index under its rarest token; a URL meets the rules filed
under its tokens and is blocked if it holds all tokens of one of them.

The query labels a page by the row of ``labels`` with its number: toxic or of
quality 0 means block.

Defined results: a null URL or one without "://" has an empty host and path and
no tokens, so it is allowed; null labels count as not toxic and of quality 1;
repeated rows are judged alike, and count each when they are labelled; URLs of any
length are read whole; of tokens that the same rows hold the smallest stands for
all; of equally sure rules the first in order of their tokens is named; without
labels nothing is mined and all URLs that no given rule blocks are allowed; further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, small, table, written

#: Fixed rules of the contract: (verdict, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.5


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def given_rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the last that fits wins: the longest
        name, slash, rest = text.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: the host and its parents, path segments (digits as 0) with their place, file type, query keys and scheme."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.filter(F.split(F.translate(F.regexp_replace(p, r"[0-9]+", "0"), UPPER, LOWER), "/"), lambda x: x != "")
    parts = F.transform(parts, lambda x, i: F.concat(F.lit("path:"), i.cast("string"), F.lit(":"), x))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key:"), x))
    scheme = F.concat(F.lit("scheme:"), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1))
    kind = F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1)
    more = F.array(scheme, F.when(kind != "", F.concat(F.lit("type:"), kind)))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(F.concat(parents, parts, keys, more), lambda x: x.isNotNull())))


RULE = "items array<string>, confidence double, support double, anchor string"


def _filed(items: DataFrame, frequent: DataFrame) -> DataFrame:
    """items with anchor, their token that is held least often; frequent: token, n, a table of bounded size."""
    each = items.select("items", F.explode("items").alias("token")).join(F.broadcast(frequent.select("token", "n")), "token")
    return each.groupBy("items").agg(F.min(F.struct("n", "token"))["token"].alias("anchor"))


def _counted(items: DataFrame, baskets: DataFrame) -> DataFrame:
    """items and anchor with total, how many baskets hold all of them."""
    met = baskets.select("tokens", F.explode("tokens").alias("anchor")).join(small(items), "anchor").where(F.size(F.array_except("items", "tokens")) == 0)
    return met.groupBy("items", "anchor").agg(F.count("*").alias("total"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (items, confidence, support, anchor) from rows (url, blocked); a written table."""
    spark = labelled.sparkSession
    rows = labelled.select(tokens(F.col("url")).alias("tokens"), F.coalesce("blocked", F.lit(False)).alias("blocked")).where(F.size("tokens") > 0)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    n, bad = rows.agg(F.count("*"), F.count_if("blocked")).first()
    least = max(1, math.ceil(min_support * n - 1e-9))
    if bad < least:
        return spark.createDataFrame([], RULE)
    # each row holds a limited number of tokens on average, so those held by so many of the blocked rows are few
    held = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    same = (F.bit_xor(F.xxhash64("row")), F.bit_xor(F.xxhash64(F.lit(1), "row")))
    frequent = held.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad"), same[0].alias("one"), same[1].alias("two")).where(F.col("bad") >= least)
    frequent = written(frequent.groupBy("n", "bad", "one", "two").agg(F.min("token").alias("token")))
    sure = frequent.where("bad = n").select(F.array("token").alias("items"), "bad", F.col("n").alias("total"), F.col("token").alias("anchor"))
    open_ = frequent.where("bad < n").select("token", "n")
    baskets = written(held.join(F.broadcast(open_.select("token")), "token").groupBy("row", "blocked").agg(F.collect_set("token").alias("tokens")))
    blocked = baskets.where("blocked").select(F.col("tokens").alias("items"))
    found = sure
    if not blocked.isEmpty():
        mined = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / blocked.count()).fit(blocked).freqItemsets
        mined = written(mined.where(F.col("freq") >= least).select(F.array_sort("items").alias("items"), F.col("freq").alias("bad")))
        filed = written(_filed(mined, open_))
        found = found.unionByName(mined.join(_counted(filed, baskets), "items").select(*found.columns))
    confidence = F.col("bad") / F.col("total")
    found = found.where(confidence >= min_confidence)
    found = written(found.select("items", confidence.alias("confidence"), (F.col("bad") / n).alias("support"), "anchor"))
    # a rule is needless if a part of it concludes the same as surely; such a part has its first item among the rule's
    part = found.select(F.col("items").alias("p_items"), F.col("confidence").alias("p_confidence"), F.get("items", 0).alias("item"))
    needless = (
        found.select("items", "confidence", F.explode("items").alias("item"))
        .join(part, "item")
        .where((F.size("p_items") < F.size("items")) & (F.size(F.array_except("p_items", "items")) == 0) & (F.col("p_confidence") >= F.col("confidence")))
        .select("items").distinct()
    )
    return written(found.join(needless, "items", "left_anti"))


def judge(urls: DataFrame, mined: DataFrame, rules=RULES) -> DataFrame:
    """urls (page_id, url) with host, path, rule, verdict, confidence and items of the surest mined rule (null where a given rule decides or none fits)."""
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    rows = urls.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("rule", rule).withColumn("given", verdict)
    open_ = rows.where("rule IS NULL AND host <> ''").select("url", tokens(F.col("url")).alias("own")).dropDuplicates(["url"])
    index = small(mined.select(F.col("anchor"), F.col("items"), F.col("confidence")))
    met = open_.select("url", "own", F.explode("own").alias("token")).join(index, F.col("token") == F.col("anchor")).where(F.size(F.array_except("items", "own")) == 0)
    # the surest rule; of equally sure ones the first in order
    best = met.groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("minus"), "items")).alias("best")).withColumnRenamed("url", "_url")
    joined = rows.join(best, F.col("url") == F.col("_url"), "left")
    mined_verdict = F.when(F.col("rule").isNull() & F.col("best").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("given", mined_verdict).alias("verdict"), (-F.col("best.minus")).alias("confidence"), F.col("best.items").alias("items"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("blocked"))
    return judge(pages, mine(pages.join(labels, "page_id"))).select("page_id", "host", "path", "rule", "verdict")
