"""URL filters from association rules.

Urls that a fixed rule decides are the labels: each is a basket of its tokens (labels of its host,
segments of its path) and its verdict. Spark's FP-growth mines frequent baskets; of the rules
"tokens => verdict" those stay whose confidence and support suffice and that no rule with fewer of
the tokens makes redundant. Other urls are matched by an inverted index: their tokens meet the
index's (token, rule) entries, and a rule fires if all its tokens are met.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans.storage import cut, small_side


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The fixed rules.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)
SUPPORT, CONFIDENCE, LENGTH = 0.005, 0.8, 3
#: Items that stand for verdicts in baskets; tokens never hold a blank.
_VERDICT = "verdict "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) after the first ``://`` up to ``/``, ``?``, ``#`` or the end, and
    the path from there up to ``?``, ``#`` or the end; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fixed_verdict(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest fixed rule whose host is the url's host or a parent
    domain of it and whose path begins the url's path; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: ``h:`` and a label of the host, ``p:`` and a segment of the path, digits
    of segments written as 0."""
    of_host = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    plain = F.regexp_replace(F.regexp_replace(path, "[0-9]+", "0"), r"\s", "_")
    of_path = F.transform(F.filter(F.split(plain, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(of_host, of_path))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, length: int = LENGTH) -> DataFrame:
    """(rule_id, items, n_items, verdict, confidence, support) from ``labelled`` (items, verdict):
    rules of at most ``length`` tokens, without those that a rule of fewer tokens implies at the
    same confidence or more. No labelled rows give no rules."""
    baskets = cut(labelled.select(F.array_append("items", F.concat(F.lit(_VERDICT), "verdict")).alias("items")), "baskets")
    schema = "items array<string>, n_items int, verdict string, confidence double, support double"
    n = baskets.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "rule_id long, " + schema)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    sets = model.freqItemsets
    has = lambda x: F.startswith(x, F.lit(_VERDICT))
    split = sets.where(F.size("items") <= length + 1).select(
        F.array_sort(F.filter("items", lambda x: ~has(x))).alias("items"), F.get(F.filter("items", has), 0).alias("v"), "freq"
    )
    split = cut(split, "itemsets")
    bodies = split.where("v is null").select("items", F.col("freq").alias("all"))
    rules = (
        split.where("v is not null and size(items) > 0")
        .join(bodies, "items")
        .select(
            "items",
            F.size("items").alias("n_items"),
            F.expr(f"substring(v, {len(_VERDICT) + 1})").alias("verdict"),
            (F.col("freq") / F.col("all")).alias("confidence"),
            (F.col("freq") / n).alias("support"),
        )
        .where(F.col("confidence") >= confidence)
    )
    rules = cut(rules.withColumn("rule_id", F.xxhash64(F.array_join("items", " "), "verdict")), "rules")
    # a rule is redundant if dropping one or more of its tokens gives one that is as confident;
    # subsets of at most three tokens are few, so they are listed and looked up
    masks = F.expr("transform(sequence(1, cast(pow(2, n_items) as int) - 2), m -> filter(items, (x, i) -> (shiftright(m, i) & 1) = 1))")
    parts = rules.where("n_items > 1").select("rule_id", "verdict", "confidence", F.explode(masks).alias("part"))
    known = rules.select(F.col("items").alias("part"), "verdict", F.col("confidence").alias("c"))
    redundant = parts.join(known, ["part", "verdict"]).where("c >= confidence").select("rule_id").distinct()
    return rules.join(redundant, "rule_id", "left_anti").select("rule_id", "items", "n_items", "verdict", "confidence", "support")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, learned, confidence) of the most confident rule for each of ``urls`` (host,
    path, items; distinct): by an inverted index from tokens to rules. Urls without a rule are left out."""
    index = rules.select(F.explode("items").alias("token"), "rule_id", "n_items", "verdict", "confidence", "support")
    met = urls.select("host", "path", F.explode("items").alias("token")).join(small_side(index, 200_000), "token")
    fired = met.groupBy("host", "path", "rule_id").agg(
        F.count("*").alias("n"), F.first("n_items").alias("n_items"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"), F.first("support").alias("support")
    )
    best = fired.where("n = n_items").groupBy("host", "path").agg(
        F.max(F.struct("confidence", "support", "n_items", "verdict", "rule_id")).alias("best")
    )
    return best.select("host", "path", F.col("best.verdict").alias("learned"), F.col("best.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, default: str = "allow") -> DataFrame:
    """``pages`` (url; other columns kept unless named as the new ones) with host, path, rule (of
    the fixed rule, else null), verdict (the fixed rule's, else the best mined rule's, else
    ``default``) and confidence (1 for fixed rules, null for the default).

    Null urls and urls without ``://`` have an empty host and path and get the default. Repeated
    rows each get their verdict; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "confidence")]
    rows = pages.select(*kept, host.alias("host"), path.alias("path")).withColumn("__fixed", fixed_verdict(F.col("host"), F.col("path"), rules))
    named = rows.select("host", "path", "__fixed", tokens(F.col("host"), F.col("path")).alias("items"))
    labelled = named.where("__fixed is not null").select("items", F.col("__fixed.verdict").alias("verdict"))
    mined = mine(labelled)
    open_urls = named.where("__fixed is null").select("host", "path", "items").distinct()
    learned = match(open_urls, cut(mined, "mined"))
    out = rows.join(learned, ["host", "path"], "left")
    return out.select(
        *kept,
        "host",
        "path",
        F.col("__fixed.rule").alias("rule"),
        F.coalesce("__fixed.verdict", "learned", F.lit(default)).alias("verdict"),
        F.when(F.col("__fixed").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"),
    )
