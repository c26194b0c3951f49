"""URL filtering by association rules, in DataFrame and SQL functions only.

A URL is a set of tokens: all suffixes of its host, all parts of its path by their
place, its extension, whether it has a query, the names of the query and the names
with their values, and the fragment (runs of digits of parts, names, values and
fragments are written alike).  Only support prunes them, and every labelled page counts.
URLs that a given list rules on are the labelled ones.  FP-growth mines the token
sets that go with a verdict; rules ``tokens => verdict`` are kept by support and
confidence, and dropped where the rule without one of their tokens has the same
verdict and is as sure.  The rules are laid out as an inverted index, token ->
rules; a rule fires for a URL that meets all of its tokens.  Of those that fire
the surest decides, then the one with more support, then the longer, then block,
then the first by its tokens.  URLs without a rule are allowed.

Matching is done once for each distinct token set.  What is found is stored, and joined
back to the pages in a join of its own, in which Spark splits the pages of a frequent set.

Defined results: a null url, or one without ``://``, has an empty host and path and
no tokens: no list rule fits and it is allowed.  An empty table gives no rows.
Repeated rows are judged each.  With no labelled URL no rule is mined and all others
are allowed.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmine.llm.shared import materialize, only

#: Part of a filter list: (verdict, host and path).
LIST = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "verdict=allow", "verdict=block"


@dataclass(frozen=True)
class Parameters:
    """support: share of the labelled pages; a URL of n frequent tokens has up to 2**n frequent sets."""

    support: float = 0.002
    confidence: float = 0.8


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def list_rule(h: Column, p: Column, rules=LIST) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, rule_path = text.partition("/")
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith("/" + rule_path)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, h: Column, p: Column) -> Column:
    """The distinct tokens of the whole URL."""
    alike = lambda x: F.regexp_replace(x, r"[0-9]+", "0")
    none = F.array().cast("array<string>")
    label = F.split(h, r"\.")
    hosts = F.transform(label, lambda _, i: F.concat(F.lit("host"), (i + 1).cast("string"), F.lit("="), F.array_join(F.slice(label, -1 - i, i + 1), ".")))
    parts = F.transform(F.filter(F.split(p, "/"), lambda x: x != ""), lambda x, i: F.concat(F.lit("path"), (i + 1).cast("string"), F.lit("="), alike(x)))
    pairs = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    names = F.transform(pairs, lambda x: F.concat(F.lit("name="), alike(F.substring_index(x, "=", 1))))
    values = F.transform(F.filter(pairs, lambda x: F.contains(x, F.lit("="))), lambda x: F.concat(F.lit("value="), alike(x)))
    fragment = F.regexp_extract(url, r"(?s)^[^#]*#(.*)$", 1)
    extension = F.regexp_extract(p, r"\.([A-Za-z0-9]{1,8})$", 1)
    flags = F.array(
        F.when(extension != "", F.concat(F.lit("ext="), F.lower(extension))), F.when((h != "") & F.contains(url, F.lit("?")), F.lit("query")),
        F.when((h != "") & (fragment != ""), F.concat(F.lit("fragment="), alike(fragment))),
    )
    found = F.concat(F.when(h != "", F.concat(hosts, names, values)).otherwise(none), parts, F.array_compact(flags))
    return F.when(url.isNull(), none).otherwise(F.array_sort(F.array_distinct(found)))


def mine(labelled: DataFrame, parameters: Parameters = Parameters()) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, support) from labelled(tokens, verdict)."""
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=parameters.support, minConfidence=parameters.confidence).fit(baskets)
    sets = materialize(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    verdict = F.when(F.array_contains("items", ALLOW), "allow").when(F.array_contains("items", BLOCK), "block")
    with_verdict = sets.withColumn("verdict", verdict).where("verdict is not null and size(items) > 1")
    with_verdict = with_verdict.select(F.array_remove(F.array_remove("items", ALLOW), BLOCK).alias("items"), "verdict", F.col("freq").alias("support"))
    rules = with_verdict.join(sets.select("items", F.col("freq").alias("all")), "items").withColumn("confidence", F.col("support") / F.col("all"))
    rules = rules.where(F.col("confidence") >= parameters.confidence)
    # one that a part of its tokens decides as surely adds nothing
    general = rules.select(F.col("items").alias("part"), F.col("verdict").alias("of"), F.col("confidence").alias("sure"))
    smaller = rules.withColumn("part", F.explode(F.expr("transform(sequence(1, size(items)), i -> filter(items, (x, j) -> j <> i - 1))")))
    beaten = smaller.join(general, (smaller.part == general.part) & (F.col("verdict") == F.col("of")) & (F.col("sure") >= F.col("confidence"))).select("items", "verdict").distinct()
    kept = rules.join(beaten, ["items", "verdict"], "left_anti")
    return kept.select(F.concat_ws("\t", F.col("items"), F.col("verdict")).alias("rule_id"), F.col("items").alias("tokens"), "verdict", "confidence", "support")


def decide(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined) for each of the distinct token_sets(tokens) in which a rule fires, by inverted index."""
    index = rules.withColumn("needed", F.size("tokens")).withColumn("token", F.explode("tokens")).drop("tokens")
    hits = token_sets.withColumn("token", F.explode("tokens")).join(index, "token")
    fired = hits.groupBy("tokens", "rule_id", "verdict", "confidence", "support", "needed").agg(F.count(F.lit(1)).alias("met")).where("met = needed")
    best = F.max(F.struct("confidence", "support", "needed", (F.col("verdict") == "block").alias("blocks"), F.col("rule_id").alias("by"), "verdict")).alias("best")
    return fired.groupBy("tokens").agg(best).select("tokens", F.col("best.verdict").alias("mined"))


def judge(pages: DataFrame, parameters: Parameters = Parameters(), rules=LIST) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    seen = only(pages, "page_id", "url").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    seen = seen.withColumn("listed", list_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    labelled = seen.where("listed is not null").select("tokens", F.col("listed.verdict").alias("verdict"))
    mined = mine(labelled, parameters)
    asked = seen.where("listed is null and size(tokens) > 0").select("tokens").distinct()
    said = materialize(decide(asked, mined), "said")
    # listed pages need no lookup, so they are not dealt by a key that they all lack
    listed = seen.where("listed is not null").select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.col("listed.verdict").alias("verdict"))
    others = seen.where("listed is null").join(said, "tokens", "left")
    return listed.unionByName(others.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("mined", F.lit("allow")).alias("verdict")))
