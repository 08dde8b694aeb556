"""URL verdicts from a rule list and from association rules that FP-growth mines.

Tokens of labelled urls, with an item for a bad label, are the transactions. Rules whose consequent
is that item, pruned by support and by confidence over the share of bad urls, are candidates. They are mined from one half
of the labelled urls and tried on the other: only rules that do better there than chance allows for so many trials
block what no listed rule decides. Matching uses an
inverted index: each rule is filed under its rarest token and looked up by a url's tokens, then the rest
of its tokens is checked. DataFrame functions and Spark's FP-growth only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: (verdict, host, path); a rule's text is host + path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BAD = "label=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct lower-case runs of letters and digits after the scheme; host labels, path and query parts."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    return F.array_distinct(F.filter(F.split(F.lower(rest), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def mine(urls: DataFrame, min_support: float = 0.002, min_count: int = 10, min_lift: float = 1.25, max_share: float = 0.5) -> DataFrame:
    """(tokens, confidence, lift, support) of rules for bad urls; ``urls`` has url and bad (boolean).

    Bad urls with a rule's tokens are a share of ``min_support`` of the labelled urls, and ``min_count``, at
    least, and ``min_lift`` times as frequent among the urls with these tokens as among all. Tokens in more than
    ``max_share`` of the urls make no rules, and of tokens that stand in exactly the same urls the first by
    code point stands for all, so that the parts that a site's urls share don't multiply the itemsets. Urls
    without tokens are left out. An empty table, or one without bad urls, gives no rules.
    """
    sets = scratch(urls.select(F.monotonically_increasing_id().alias("n"), "bad", tokens(F.col("url")).alias("items")).where(F.size("items") > 0), "labelled")
    total, bad = sets.agg(F.count("*"), F.count(F.when(F.col("bad"), 1))).first()
    if not bad:
        return urls.sparkSession.createDataFrame([], "rule_tokens array<string>, confidence double, lift double, support double")
    each = sets.select("n", "bad", F.explode("items").alias("item"))
    held = each.groupBy("item").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("n")).alias("same")).where(F.col("c") <= max_share * total)
    used = held.groupBy("c", "same").agg(F.min("item").alias("item")).where(F.col("c") >= min_count).select("item")
    items = each.join(used, "item").groupBy("n", "bad").agg(F.collect_list("item").alias("items"))
    items = items.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    items = scratch(items, "transactions")  # urls without a token of use are no transactions; supports allow for them
    kept = items.count()
    least = min(1.0, max(min_support * total, min_count) / max(1, kept))
    rules = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min(1.0, min_lift * bad / total)).fit(items).associationRules
    rules = rules.where(F.col("consequent") == F.array(F.lit(BAD)))
    return rules.select(F.col("antecedent").alias("rule_tokens"), "confidence", (F.col("confidence") * total / bad).alias("lift"), (F.col("support") * kept / total).alias("support"))


def rule_hits(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, confidence): distinct urls with the rules whose tokens they all hold; ``rule`` is the sorted tokens."""
    held = urls.select("url").where("url is not null").distinct().select("url", tokens(F.col("url")).alias("tokens"))
    parts = rules.withColumn("rule", F.concat_ws(" ", F.array_sort("rule_tokens"))).select("rule", "rule_tokens", "confidence", F.explode("rule_tokens").alias("token"))
    used = parts.select("token").distinct()
    often = held.select(F.explode("tokens").alias("token")).join(used, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    index = parts.join(often, "token").groupBy("rule").agg(F.min(F.struct("n", "token")).alias("rarest"), F.first("rule_tokens").alias("rule_tokens"), F.first("confidence").alias("confidence")).select("rule", F.col("rarest.token").alias("token"), "rule_tokens", "confidence")
    hits = held.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    return hits.select("url", "rule", "confidence")


def blocked_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that hold all tokens of some rule, with the best confidence of such a rule."""
    return rule_hits(urls, rules).groupBy("url").agg(F.max("confidence").alias("confidence"))


def confirmed(rules: DataFrame, urls: DataFrame, alpha: float = 0.01) -> DataFrame:
    """The rules that hold on ``urls`` (url, bad), with tried, hits and chance (long, long, double).

    Of ``tried`` urls with a rule's tokens ``hits`` are bad. With a share p of bad urls among all, ``hits`` or more come by
    chance with a probability of exp(-tried * KL(hits / tried || p)) at most (Chernoff); a rule stays if this is at
    most ``alpha`` over the number of rules. Without urls or bad ones none stays.
    """
    rules = scratch(rules.withColumn("rule", F.concat_ws(" ", F.array_sort("rule_tokens"))), "rules")
    n_rules, (n, bad) = rules.count(), urls.agg(F.count("*"), F.count(F.when(F.col("bad"), 1))).first()
    p = bad / n if n else 0.0
    tried = rule_hits(urls, rules).join(urls.groupBy("url").agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("b")), "url").groupBy("rule").agg(F.sum("n").alias("tried"), F.sum("b").alias("hits"))
    q = F.col("hits") / F.col("tried")
    part = lambda x, y: F.when(x > 0, x * F.log(x / max(y, 1e-300))).otherwise(0.0)
    chance = F.when(q > p, F.exp(-F.col("tried") * (part(q, p) + part(1 - q, 1 - p)))).otherwise(1.0)
    return rules.join(tried, "rule").withColumn("chance", chance).where(F.col("chance") <= alpha / max(1, n_rules)).where(F.lit(0 < bad < n)).drop("rule")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, min_support: float = 0.002, min_count: int = 10, min_lift: float = 1.25, alpha: float = 0.01, id_col: str = "page_id") -> DataFrame:
    """Verdict on each page's url: the longest listed rule that fits, else the mined rules'.

    ``labels`` (doc_id, quality, toxic) says of the page with the same id whether it is bad: toxic, or
    of quality 0; of several labels the worst counts and a null is no fault. A listed rule fits its
    host and its subdomains if the path starts with the rule's. A null url has empty host and path and
    is allowed. Repeated pages are judged alike; other columns are not read. Half of the labelled urls, by hash, are
    mined and the others try the rules; with no rule left, the method allows every page.

    Returns one row per input row: ``id_col``, host, path, rule (null if none fits), verdict, confidence
    (of the best mined rule that fits, else null).
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col("url"))
    bad = labels.groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    labelled = scratch(source.where("url is not null").join(bad, F.col("page_id") == F.col("doc_id")).select("url", "bad", F.pmod(F.xxhash64("url"), F.lit(2)).alias("half")), "labelled")
    mined = mine(labelled.where("half = 0").drop("half"), min_support, min_count, min_lift)
    blocked = scratch(blocked_urls(source, confirmed(mined, labelled.where("half = 1").drop("half"), alpha)), "blocked")
    told = source.where("url is not null").join(blocked, "url", "left").select("page_id", "url", "confidence")
    told = told.union(source.where("url is null").select("page_id", "url", F.lit(None).cast("double")))
    host, path = host_and_path(F.col("url"))
    out = told.withColumn("host", host).withColumn("path", path)
    fit = lambda r: ((F.col("host") == r[1]) | F.col("host").endswith("." + r[1])) & F.col("path").startswith(r[2])
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    for r in reversed(ordered):
        rule, verdict = F.when(fit(r), r[1] + r[2]).otherwise(rule), F.when(fit(r), r[0]).otherwise(verdict)
    return out.select(F.col("page_id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "confidence")
