"""URL filters: explicit host and path rules, and token rules mined from labelled pages.

``judged`` gives each url a verdict. Explicit rules come first: a rule fits its host and all subdomains if the url's
path starts with the rule's path, and the longest fitting rule wins. Urls that no rule fits are judged by association
rules: FP-growth finds sets of url tokens that go along with the label ``block`` in the labelled pages, rules under the
wanted confidence, support or lift are dropped, and each rule is filed under the rarest of its tokens. A url meets only
rules filed under one of its tokens, and is blocked if it holds all tokens of one.

Only DataFrame, SQL and MLlib (JVM) operations are used.

Defined cases: a null url or one without ``://`` has an empty host and path, holds no tokens and is allowed. Repeated
rows each get their row. Labels with a null id or without a page teach nothing; a page with several labels counts as
blocked if one of them says so. Without labelled pages nothing is mined and unmatched urls are allowed. Further columns
of the pages, whatever their names, are not carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import through_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "=block", "=allow"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; nulls if none fits. ``rules``: (``host/path``, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: scheme, host, its labels and its last two together, path parts, query keys, fragment.

    Numbers in path parts become ``#``, so that page numbers do not hide what pages share.
    """
    h, p, rest = host(url), path(url), _after_scheme(url)
    labels = F.split(h, r"\.")
    parts = F.filter(F.split(F.regexp_replace(p, "[0-9]+", "#"), "/"), lambda x: x != "")
    query = F.split(F.regexp_extract(rest, r"\?([^#]*)", 1), "&")
    keys = F.filter(F.transform(query, lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    named = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(kind + ":"), x))
    found = F.concat(
        F.array(F.concat(F.lit("scheme:"), ascii_lower(F.substring_index(url, "://", 1))), F.concat(F.lit("host:"), h)),
        named("label", labels), F.array(F.concat(F.lit("site:"), F.substring_index(h, ".", -2))),
        named("part", parts), named("key", keys),
        F.when(F.contains(rest, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.instr(url, "://") > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def mined_rules(
    urls: DataFrame, labels: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_lift: float = 1.2,
    min_pages: int = 20,
) -> DataFrame:
    """Rules ``tokens -> block``, each seen in ``min_pages`` labelled pages: tokens, confidence, lift, support, filed_under.

    ``urls`` has page_id and url; ``labels`` has doc_id (the page's), quality and toxic.
    """
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce(bad, F.lit(False))).alias("bad"))
    taught = through_table(
        urls.select("page_id", tokens(F.col("url")).alias("items")).where(F.size("items") > 0).join(known, "page_id")
        .select(F.concat("items", F.array(F.when(F.col("bad"), BLOCK).otherwise(ALLOW))).alias("items"))
    )
    empty = urls.sparkSession.createDataFrame([], "tokens array<string>, confidence double, lift double, support double, filed_under string")
    n = taught.count()
    if not n:
        return empty
    model = FPGrowth(minSupport=min(1.0, max(min_support, min_pages / n)), minConfidence=min_confidence).fit(taught)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = (
        model.associationRules.where((F.col("consequent")[0] == BLOCK) & ~F.array_contains("antecedent", ALLOW) & (F.col("lift") >= min_lift))
        .select(F.array_sort("antecedent").alias("tokens"), "confidence", "lift", "support")
    )
    rarest = (
        rules.select("tokens", F.explode("tokens").alias("token")).join(single, "token")
        .groupBy("tokens").agg(F.min_by("token", F.struct("freq", "token")).alias("filed_under"))
    )
    return rules.join(rarest, "tokens")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls that hold all tokens of a rule: url, the best such rule's tokens and confidence."""
    held = urls.select("url").where("url is not null").distinct().select("url", tokens(F.col("url")).alias("held"))
    return (
        held.select("url", "held", F.explode("held").alias("filed_under")).join(rules, "filed_under")
        .where(F.size(F.array_except("tokens", "held")) == 0)
        .groupBy("url").agg(F.max(F.struct("confidence", "tokens")).alias("best"))
        .select("url", F.col("best.tokens").alias("tokens"), F.col("best.confidence").alias("confidence"))
    )


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], **mining: float) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the confidence of the mined rule that fits, else null."""
    urls = pages.select("page_id", "url")
    hits = matched(urls, mined_rules(urls, labels, **mining)).select("url", "confidence")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (
        urls.join(hits, "url", "left").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "confidence")
        .select(
            "page_id", "host", "path", rule.alias("rule"),
            F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
            F.col("confidence").alias("mined_confidence"),
        )
    )
