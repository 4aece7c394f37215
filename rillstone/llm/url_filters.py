"""URL filters: hand-written host and path rules, and mined token rules.

Only DataFrame functions and Spark's own FP-growth run on the main path.

Hand-written rules come first: a rule fits its host and every subdomain where
the url's path starts with the rule's path; the longest rule wins. What no rule
fits is judged by association rules: the tokens of labelled urls (host labels,
path segments, query keys) and their label are baskets, FP-growth mines the
sets that occur with the label, and sets of enough support and confidence
become rules. An inverted index, from token to rule, finds the rules whose
tokens a url has all of.

Edge cases: a null url, or one without `://`, has an empty host and path, fits
no rule and has no tokens: it is allowed. Null labels are not learned from. With
no labels, or none that a token set tells, no rule is mined and nothing but the
hand-written rules blocks. Repeated rows each get their result; pages with a
null page_id too. Of rules that fit equally long the first wins; of mined rules
the most confident, then the last by its tokens. A url of any length is one
row. Columns beyond `page_id, url` are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.runtime import cut

#: (host, path, verdict) of the contract's rules: fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
TARGET = "\x00bad"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: Labelled pages that a rule must rest on, however small the share that they are.
MIN_PAGES = 20
#: An index of at most this many (token, rule) rows, or this many matched token sets, is broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "/", 1)).otherwise(F.lit(""))
    host = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def split_url(pages: DataFrame) -> DataFrame:
    """`pages` with host and path."""
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    path = F.when(F.instr("url", "://") > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))
    return pages.withColumn("host", host_of(F.col("url"))).withColumn("path", F.coalesce(path, F.lit("")))


def written_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as `host/path`, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """Distinct host labels, path segments and query keys, each marked by its kind."""
    rest = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    host = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x))
    path = F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    keys = F.transform(F.split(rest, "&"), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.coalesce(F.array_distinct(F.filter(F.concat(host, path, keys), lambda x: F.length(x) > 2)), F.array().cast("array<string>"))


def mine(pages: DataFrame, labels: DataFrame, bad: Column, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rules (rule, tokens, confidence, support) from urls whose page_id is labelled.

    `bad`: a boolean over the columns of `labels`; several labels of an id must agree.
    """
    told = labels.where(F.col("doc_id").isNotNull() & bad.isNotNull()).groupBy("doc_id").agg(F.max(bad).alias("bad"), F.min(bad).alias("least")).where("bad = least")
    split = split_url(pages.select("page_id", "url"))
    baskets = split.join(told, split["page_id"] == told["doc_id"]).select(F.array_union(tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(TARGET))).otherwise(F.array().cast("array<string>"))).alias("items"))
    baskets = cut(baskets.where(F.size("items") > 0))
    support = min(1.0, max(min_support, min_pages / max(1, baskets.count())))
    # the label alone, at its own rate, says nothing: a rule's confidence must pass the limit by its tokens
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == TARGET) & (F.col("lift") > 1))
    found = found.select(F.sort_array("antecedent").alias("tokens"), "confidence", "support")
    return found.withColumn("rule", F.concat_ws(" ", "tokens"))


def matches(keyed: DataFrame, rules: DataFrame, rule_rows: int) -> DataFrame:
    """(row, mined) of the rows of `keyed` (row, tokens) that have all tokens of a rule; the best rule of each."""
    index = rules.select("rule", "confidence", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    if rule_rows <= BROADCAST_ROWS:
        index = F.broadcast(index)
    hits = keyed.select("row", F.explode("tokens").alias("token")).join(index, "token").groupBy("row", "rule", "confidence", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size")
    return hits.groupBy("row").agg(F.max_by("rule", F.struct("confidence", "rule")).alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, bad: Column, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per row of `pages`: page_id, host, path, rule, verdict, mined (the token rule that blocked it)."""
    mined = cut(mine(pages, labels, bad, min_support, min_confidence, min_pages))
    rule_rows = mined.agg(F.sum(F.size("tokens"))).first()[0] or 0
    name, says = written_rule(rules)
    split = split_url(pages.select("page_id", "url")).withColumn("rule", name).withColumn("says", says)
    split = split.withColumn("tokens", tokens(F.col("url")))
    # urls of equal tokens share a judgement, so a crowded host is matched once
    split = split.withColumn("row", F.xxhash64("tokens"))
    keyed = split.where("says is null").select("row", "tokens").dropDuplicates(["row"])
    found = cut(matches(keyed, mined, rule_rows))
    # a crowded host's rows are spread wherever they are read, if what they meet is small
    out = split.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "row", "left")
    mined_name = F.when(F.col("says").isNull(), F.col("mined"))
    verdict = F.coalesce("says", F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), mined_name.alias("mined"))
