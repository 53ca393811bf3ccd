"""URL filters: stated rules, and association rules that FP-growth mines from labelled URLs.

A URL is a set of tokens (host suffixes, path segments, query keys). FP-growth finds token combinations
of bad URLs; rules are kept by support and confidence, and a rule that a shorter one implies with at
least its confidence is left out. Matching goes by an inverted index: every rule is listed under its
rarest token, so a URL meets only the rules of its tokens, and is then checked for the others.

Everything here is DataFrame functions and Spark's own FP-growth.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import checked_small, cut_lineage
from .common import let

BAD = "label=bad"
# A rule needs this many labelled URLs, and this share of all of them, and this share of bad ones.
MIN_COUNT, MIN_SUPPORT, MIN_CONFIDENCE = 20, 0.001, 0.8
# Stated rules are one expression; a longer list belongs into a table.
MAX_STATED = 500


@dataclass(frozen=True)
class Rule:
    """A stated rule: a host (and its subdomains) and the start of a path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; without ://, or null: empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; without ://, or null: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)


def stated_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MAX_STATED:
        raise ValueError(f"more than {MAX_STATED} stated rules")
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(
            fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        ).otherwise(chosen)
    return chosen


def tokens(url: Column, deepest: int | None = None) -> Column:
    """Distinct tokens: every suffix of the host, path segments and query keys, digits as 0.

    With ``deepest``, suffixes of up to so many labels: for a caller that knows that longer ones are of no
    use, because all suffixes of a host together grow with the square of its length.
    """

    def suffixes(labels: Column) -> Column:
        count = F.size(labels) if deepest is None else F.least(F.size(labels), F.lit(deepest))
        return F.transform(
            F.sequence(F.lit(1), count),
            lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")),
        )

    def folded(text: Column) -> Column:
        return F.regexp_replace(F.lower(text), r"[0-9]+", "0")

    host = let(F.split(folded(host_of(url)), r"\."), suffixes)
    segments = F.filter(F.split(folded(path_of(url)), "/"), lambda s: s != "")
    keys = F.transform(F.split(query_of(url), "&"), lambda pair: F.regexp_extract(pair, "^([^=]*)", 1))
    keys = F.filter(keys, lambda k: k != "")
    return F.array_distinct(
        F.concat(
            F.filter(host, lambda h: h != "host:"),
            F.transform(segments, lambda s: F.concat(F.lit("path:"), s)),
            F.transform(keys, lambda k: F.concat(F.lit("key:"), folded(k))),
        )
    )


def mine(
    labelled: DataFrame,
    min_count: int = MIN_COUNT,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Rules tokens -> bad from (url, bad): rule_tokens, rare_token, confidence, support, rule_text.

    A null url has no tokens and makes no rule; a null label counts as not bad. With too few labelled
    URLs for min_count there are no rules. Every token that bad URLs have often enough is mined, wherever
    it stands in a URL; tokens of the very same URLs are mined as one and put back in afterwards.
    """
    schema = "rule_tokens array<string>, rare_token string, confidence double, support double, rule_text string"
    none = labelled.sparkSession.createDataFrame([], schema)
    is_bad = F.coalesce(F.col("bad"), F.lit(False))
    depth = F.size(F.split(host_of(F.col("url")), r"\."))
    depths = labelled.select(depth.alias("depth"), is_bad.alias("bad"), (is_bad | (F.size(tokens(F.col("url"), 2)) > 0)).alias("counts"))
    depths = depths.groupBy("depth").agg(F.count_if("counts").alias("n"), F.count_if("bad").alias("n_bad")).collect()
    total = sum(r["n"] for r in depths)
    if total < min_count:
        return none
    support = max(min_support, min_count / total)
    need = ceil(support * total)
    # A suffix of more labels than this is in fewer bad URLs than a rule needs.
    deepest = max((d["depth"] for d in depths if sum(r["n_bad"] for r in depths if r["depth"] >= d["depth"]) >= need), default=0)
    if not deepest:
        return none
    marked = labelled.select(tokens(F.col("url"), max(2, deepest)).alias("t"), is_bad.alias("bad"))
    marked = marked.where(F.col("bad") | (F.size("t") > 0))
    # Which URLs have a token: their number and two sums of hashes.
    counted = marked.select("bad", F.xxhash64("t").alias("urls"), F.explode("t").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("freq"),
        F.count_if("bad").alias("n_bad"),
        F.sum(F.shiftright("urls", 33)).alias("high"),
        F.sum(F.col("urls").bitwiseAND(F.lit((1 << 31) - 1))).alias("low"),
    )
    often = counted.where(F.col("n_bad") >= need).groupBy("freq", "n_bad", "high", "low").agg(
        F.min("token").alias("token"), F.collect_set("token").alias("same")
    )
    often = cut_lineage(often)
    # Each is in a share of the URLs, so they are not many.
    mined = [r["token"] for r in often.select("token").collect()]
    if not mined:
        return none
    items = F.filter("t", lambda t: t.isin(mined))
    items = F.concat(items, F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>")))
    marked = marked.select(items.alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(marked)
    # What FP-growth found is mined anew at each use, so it is written once.
    found = model.associationRules.where(F.get("consequent", F.lit(0)) == BAD)
    # Support of a rule's tokens alone, so that min_count holds for good and bad URLs together.
    found = found.select(
        F.array_sort("antecedent").alias("rule_tokens"), "confidence", (F.col("support") / F.col("confidence")).alias("support")
    )
    found = cut_lineage(found)
    # A rule goes if leaving out one of its tokens gives a rule at least as sure.
    parts = found.select(
        F.col("rule_tokens").alias("of"),
        F.col("confidence").alias("sure"),
        F.explode(F.transform("rule_tokens", lambda t: F.array_remove(F.col("rule_tokens"), t))).alias("shorter"),
    )
    implied = parts.join(found, F.col("shorter") == F.col("rule_tokens")).where("confidence >= sure").select("of")
    rules = found.join(implied, F.col("rule_tokens") == F.col("of"), "left_anti")
    # Every way to put in one token for each that was mined for several.
    listed = rules.select("*", F.explode("rule_tokens").alias("token")).join(often.select("token", "same"), "token")
    listed = listed.groupBy("rule_tokens", "confidence", "support").agg(F.collect_list("same").alias("choices"))
    ways = F.aggregate(
        "choices",
        F.array(F.array().cast("array<string>")),
        lambda ways, same: F.flatten(F.transform(ways, lambda way: F.transform(same, lambda t: F.concat(way, F.array(t))))),
    )
    rules = listed.select(F.explode(ways).alias("way"), "confidence", "support")
    rules = rules.select(F.array_sort("way").alias("rule_tokens"), "confidence", "support")
    single = often.select(F.explode("same").alias("token"), "freq")
    listed = rules.select("*", F.explode("rule_tokens").alias("token")).join(single, "token")
    return listed.groupBy("rule_tokens", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("rare_token")).select(
        "rule_tokens", "rare_token", "confidence", "support", F.array_join("rule_tokens", " ").alias("rule_text")
    )


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, mined_rule, confidence: the surest rule that each url (distinct) fits; others have no row."""
    index = checked_small(rules.select("rule_tokens", "rare_token", "confidence", "rule_text"))
    # No rule has a longer suffix of a host than this.
    hosts = index.select(F.explode("rule_tokens").alias("token")).where(F.col("token").startswith("host:"))
    deepest = hosts.agg(F.max(F.size(F.split("token", r"\.")))).first()[0]
    own = urls.select("url").where(F.col("url").isNotNull()).distinct()
    own = own.select("url", tokens(F.col("url"), deepest or 1).alias("own"))
    met = own.select("url", "own", F.explode("own").alias("token")).join(index, F.col("token") == F.col("rare_token"))
    met = met.where(F.size(F.array_except("rule_tokens", "own")) == 0)
    best = F.max(F.struct("confidence", F.col("rule_text").alias("mined_rule")))
    return met.groupBy("url").agg(best.alias("best")).select(F.col("url").alias("of_url"), "best.mined_rule", "best.confidence")


def judge(pages: DataFrame, rules: list[Rule], mined: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, mined_rule, confidence of every row.

    The longest stated rule that fits decides; else a URL that fits a mined rule is blocked and any other
    allowed. A null URL, or one without ://, has an empty host and path and is allowed. Repeated rows
    stay; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    matched = match(rows, mined)
    rows = rows.join(matched, F.col("url") == F.col("of_url"), "left")
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("stated", stated_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return rows.select(
        F.col(id_col),
        "host",
        "path",
        F.col("stated.rule").alias("rule"),
        F.coalesce(F.col("stated.verdict"), by_method).alias("verdict"),
        "mined_rule",
        "confidence",
    )


def label_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad for pages of labelled documents: the number in a page's path is its document's id. Bad is
    low quality or toxic."""
    doc = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    doc = F.when(doc != "", doc).cast("long")
    bad = labels.groupBy("doc_id").agg(
        F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad")
    )
    return pages.select("url", doc.alias("of_doc")).join(bad, F.col("of_doc") == F.col("doc_id")).select("url", "bad")
