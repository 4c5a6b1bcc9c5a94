"""URL filters: rules by host and path, and for what they leave open, association rules that FP-growth mines from labelled URLs.

A URL is a set of tokens: its host's words, its path's segments (digits as `#`), names of its query, its fragment. From
labelled URLs Spark's FP-growth takes the token sets that are frequent enough, with the label as one more token; a set that leads to the label with
enough confidence is a rule, unless a rule of some of its tokens is as confident. Rules are filed under their rarest token; a URL meets
those rules only that are filed under a token of its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

#: (host, path, verdict). A rule fits its host and all subdomains, where the path starts with the rule's.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A rule is mined if so large a share of the labelled URLs, and so many of them, have its tokens and the label ...
SUPPORT, EVIDENCE = 0.01, 5
#: ... and so large a share of the labelled URLs with its tokens has the label.
CONFIDENCE = 0.6
BAD = "label=block"
#: Rules of a list are literals of the plan, so that no URL is shuffled for them; longer lists belong in a table and a join.
MOST_RULES = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What is between the first `://` and the next `/`, `?`, `#` or the end, A-Z in lower case; what follows up to `?`, `#` or the end.

    Both empty where url is null or has no `://`.
    """
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.regexp_replace(rest, r"(?s)^[^/?#]*", ""), r"(?s)^[^?#]*", 0)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(length, rule, verdict) of the longest rule that fits, of equal ones the first by text; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules in a list")
    by: dict[str, list[tuple[str, str]]] = {}
    for name, start, verdict in rules:
        by.setdefault(name, []).append((start, verdict))
    entry = lambda name, x: F.struct(F.lit(x[0]).alias("start"), F.lit(-len(name + x[0])).alias("short"), F.lit(name + x[0]).alias("rule"), F.lit(x[1]).alias("verdict"))
    filed = F.create_map(*(c for name, some in sorted(by.items()) for c in (F.lit(name), F.array(*(entry(name, x) for x in some)))))
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(ends, lambda e: F.try_element_at(filed, e)), lambda x: x.isNotNull()))
    fits = F.filter(found, lambda x: F.startswith(path, x["start"]))
    return F.array_min(F.transform(fits, lambda x: F.struct(x["short"].alias("short"), x["rule"].alias("rule"), x["verdict"].alias("verdict"))))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, sorted; empty where it is null or has no `://`."""
    host, path = host_and_path(url)
    low = lambda c: F.translate(c, _UPPER, _LOWER)
    words = lambda c, cut, mark: F.transform(F.filter(F.split(c, cut), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    segments = F.regexp_replace(low(path), "[0-9]+", "#")
    has = F.instr(F.coalesce(url, F.lit("")), "://") > 0
    query = F.regexp_replace(F.regexp_extract(low(F.coalesce(url, F.lit(""))), r"(?s)^[^?#]*\?([^#]*)", 1), "=[^&]*", "")
    fragment = F.regexp_extract(low(F.coalesce(url, F.lit(""))), "(?s)#(.*)$", 1)
    every = F.concat(words(host, r"[.\-]", "h:"), words(segments, "/", "p:"), words(query, "&", "q:"), words(fragment, " ", "f:"))
    return F.when(has, F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<string>"))


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, evidence: int = EVIDENCE, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule: its tokens sorted, key: the rarest, confidence, support: labelled URLs that have them and the label).

    pages: (page_id, url), labels: (doc_id, quality, toxic). A page that is labelled toxic or of no quality is to be blocked; null labels
    say nothing, null ids meet nothing; pages and labels that repeat an id are as many URLs as there are pairs. No rules where nothing
    is labelled.
    """
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    known = labels.where(bad.isNotNull()).select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    rows = pages.select("page_id", "url").join(known, "page_id").select(tokens(F.col("url")).alias("items"), "bad")
    rows = materialize(rows.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")), "labelled")
    spark, n = pages.sparkSession, rows.count()
    if not n:
        return spark.createDataFrame([], "rule array<string>, key string, confidence double, support long")
    least = max(math.ceil(support * n - 1e-9), evidence)
    if least > n:
        return spark.createDataFrame([], "rule array<string>, key string, confidence double, support long")
    # FP-growth asks for a share and rounds up: half a URL less is safe from how the division falls
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=confidence).fit(rows)
    sets = materialize(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    mined = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.array_sort("antecedent").alias("rule"), "confidence")
    both = sets.where(F.array_contains("items", BAD)).select(F.array_remove("items", BAD).alias("rule"), F.col("freq").alias("support"))
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    filed = mined.join(both, "rule").withColumn("id", F.concat_ws("\x00", "rule"))
    rare = filed.select("id", F.explode("rule").alias("token")).join(single, "token").groupBy("id").agg(F.min(F.struct("freq", "token")).alias("m"))
    filed = materialize(filed.join(rare, "id").select("id", "rule", F.col("m.token").alias("key"), "confidence", "support"), "rules")
    # a rule goes if some of its tokens are a rule that is as confident
    asked = filed.select(F.col("id").alias("of"), F.col("rule").alias("tokens"), F.col("confidence").alias("c"), F.explode("rule").alias("key"))
    met = asked.join(filed, "key").where((F.size("rule") < F.size("tokens")) & (F.col("confidence") >= F.col("c")) & (F.size(F.array_except("rule", "tokens")) == 0))
    return filed.join(met.select(F.col("of").alias("id")).distinct(), "id", "left_anti").drop("id")


def matches(urls: DataFrame, mined: DataFrame) -> DataFrame:
    """(url, mined: the tokens of its best rule, confidence, n_mined: rules that fit) of distinct urls that a rule fits, by the rules' keys."""
    met = urls.select("url", tokens(F.col("url")).alias("tokens")).withColumn("key", F.explode("tokens")).join(mined, "key")
    fits = met.where(F.size(F.array_except("rule", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.array_join("rule", " ").alias("text")))
    return fits.groupBy("url").agg(best.alias("b"), F.count("*").alias("n_mined")).select("url", F.col("b.text").alias("mined"), (-F.col("b.c")).alias("confidence"), "n_mined")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, support: float = SUPPORT, evidence: int = EVIDENCE, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence, n_mined): a row a page, whatever its id; of no pages none.

    The longest of `rules` that fits decides; where none does, a page is blocked if a mined rule fits its URL. Null URLs and those without
    `://` have an empty host and path and no tokens: allowed. Equal URLs are judged once and alike; other columns are left alone.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = rows.select("url").where("url is not null").distinct()
    found = matches(urls, materialize(mine(pages, labels, support, evidence, confidence), "mined"))
    rows = rows.join(found, "url", "left").withColumn("first", first_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("first.verdict"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("first.rule").alias("rule"), verdict.alias("verdict"), "mined", "confidence", F.coalesce("n_mined", F.lit(0).cast("long")).alias("n_mined"))
