"""URL filter by association rules.

URLs with a label become transactions of tokens (host labels, path parts, query names) plus their
label; Spark's FP-growth finds the frequent combinations, and the rules that end in a label and pass
confidence and support are kept, without those that a shorter rule of the same label and no less
confidence makes superfluous. A rule is indexed by its rarest token; judging joins each token of a
URL with that index and a rule fires when all its tokens stand in the URL; the most confident firing
rule decides, block before allow, then the default. Explicit host/path rules come first.

All rules that remain are kept, as a table in the shared folder; none of them reaches the driver.

Cases: a null url, or one without ``://``, has an empty host and path, no tokens and the default
verdict; repeated rows are judged each; without labelled rows no rule is mined; extra columns are
ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import stage, take_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# (verdict, host, path)
EXPLICIT = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (lower-cased A-Z) and ``path``."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    df = df.withColumn("_rest", rest)
    return df.withColumn("host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER)) \
        .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))


def explicit_rule(rules) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens() -> Column:
    """Distinct tokens of host, path and query names; digits count as one sign."""
    host = F.transform(F.split("host", r"[.\-:@]+"), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(F.regexp_replace(F.translate("path", UPPER, LOWER), r"[0-9]+", "0"), r"[/._\-]+"), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract("_rest", r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^[^=]*", 0)))
    return F.array_distinct(F.filter(F.concat(host, parts, names), lambda x: F.length(x) > 2))


def same_rows(rows: DataFrame, least: int) -> DataFrame:
    """(tokens) rows -> (rep, alike, n): the tokens of ``least`` rows or more, those that stand in the same rows together.

    A token's rows are told by their number and two sums over hashes of the rows' token sets: tokens in the same rows
    have equal sums, and tokens with equal sums stand in rows of the same sets (but for 64-bit collisions).
    """
    whole = F.array_sort("tokens")
    x = rows.select(F.explode("tokens").alias("t"), F.xxhash64(whole).cast("decimal(20,0)").alias("a"), F.xxhash64(whole, F.lit(1)).cast("decimal(20,0)").alias("b"))
    x = x.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("n") >= least)
    return x.groupBy("n", "a", "b").agg(F.min("t").alias("rep"), F.array_sort(F.collect_list("t")).alias("alike")).select("rep", "alike", "n")


def spelled_out(rules: DataFrame, alike: DataFrame) -> DataFrame:
    """Rules over representatives -> the same rules for every token that stands in the same rows. A set with two such
    tokens has the rows of the set with one, so it was superfluous and needs no rule."""
    place = rules.select("tokens", "verdict", "confidence", "freq", F.posexplode("tokens").alias("_i", "rep"))
    out = place.join(alike.select("rep", "alike"), "rep").groupBy("tokens", "verdict", "confidence", "freq").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "alike"))), lambda s: s["alike"]).alias("_all"))
    product = F.aggregate("_all", F.array(F.array().cast("array<string>")),
                          lambda done, more: F.flatten(F.transform(done, lambda d: F.transform(more, lambda m: F.array_append(d, m)))))
    return out.select(F.explode(product).alias("tokens"), "verdict", "confidence", "freq").withColumn("tokens", F.array_sort("tokens"))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8) -> DataFrame:
    """(tokens, verdict) rows -> stored rules (tokens, verdict, confidence, freq, key); ``key`` is the
    rule's rarest token.

    Tokens that stand in the same rows are mined as one and spelled out afterwards, so tokens that many URLs share don't
    double the sets. Support falls as a set grows, so all subsets of a frequent set are frequent: the best confidence
    below a rule comes level by level from the sets that are one token shorter.
    """
    rows = stage(labelled.select(F.monotonically_increasing_id().alias("_r"), "tokens", "verdict"), "url-labelled")
    least = max(1, math.ceil(min_support * rows.count()))
    alike = stage(same_rows(rows, least), "url-alike")
    t = rows.select("_r", "verdict", F.explode("tokens").alias("_t")).join(alike.select(F.col("rep").alias("_t")), "_t") \
        .groupBy("_r", "verdict").agg(F.concat(F.collect_list("_t"), F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    t = stage(t.select("items"), "url-items")
    # rows without a frequent token are left out, so the support is told as a count
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, t.count())), minConfidence=min_confidence).fit(t)
    sets = stage(model.freqItemsets.select(
        F.array_sort(F.filter("items", lambda x: ~x.startswith("="))).alias("tokens"),
        F.get(F.filter("items", lambda x: x.startswith("=")), F.lit(0)).alias("_v"), "freq"), "url-sets")
    alone = sets.where("_v IS NULL").select("tokens", F.col("freq").alias("_n"))
    scored = sets.where("_v IS NOT NULL AND size(tokens) > 0").join(alone, "tokens").select(
        "tokens", F.substring("_v", 2, 1000).alias("verdict"), (F.col("freq") / F.col("_n")).alias("confidence"), "freq")
    scored = stage(scored, "url-scored")
    longest = scored.agg(F.max(F.size("tokens"))).first()[0] or 0
    level = scored.where("size(tokens) = 1").withColumn("_below", F.lit(-1.0))
    levels = [level]
    for size in range(2, longest + 1):
        below = level.select(F.col("tokens").alias("_sub"), "verdict", F.greatest("confidence", "_below").alias("_best"))
        wider = scored.where(F.size("tokens") == size).withColumn("_sub", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))))
        level = stage(wider.join(below, ["_sub", "verdict"]).groupBy("tokens", "verdict", "confidence", "freq").agg(F.max("_best").alias("_below")), "url-level")
        levels.append(level)
    rules = reduce(DataFrame.unionByName, levels).where((F.col("confidence") >= min_confidence) & (F.col("_below") < F.col("confidence"))).drop("_below")
    single = alike.select(F.explode("alike").alias("_t"), F.col("n").alias("_n"))
    keyed = stage(spelled_out(rules, alike), "url-spelled").withColumn("_t", F.explode("tokens")).join(single, "_t")
    return stage(keyed.groupBy("tokens", "verdict", "confidence", "freq").agg(F.min(F.struct("_n", "_t"))["_t"].alias("key")), "url-rules")


def with_mined(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``mined``: verdict of the most confident rule, block before allow, whose tokens all stand
    in column ``tokens`` (null if none does)."""
    r = rules.select("key", F.col("tokens").alias("_need"), "verdict", "confidence")
    met = df.select("tokens", F.explode("tokens").alias("key"))
    fired = met.join(r, (met["key"] == r["key"]) & (F.size(F.array_except("_need", "tokens")) == 0))
    best = fired.groupBy(F.col("tokens").alias("_of")).agg(F.max(F.struct("confidence", F.col("verdict") == "block", "verdict"))["verdict"].alias("mined"))
    best = stage(best, "url-best")  # apart from the aggregate, a hot token set's join can be split
    return df.join(best, df["tokens"] == best["_of"], "left").drop("_of")


def judge(pages: DataFrame, labels: DataFrame, explicit=None, default: str = "allow", **kw) -> DataFrame:
    """-> (page_id, host, path, rule, verdict, mined). The labels that rules are mined from: the
    explicit rules' verdicts and, for other pages, their row of ``labels`` by doc_id = page_id (low
    quality or toxic: block)."""
    explicit = EXPLICIT if explicit is None else explicit
    p = with_parts(take_columns(pages, "page_id", "url")).withColumn("_e", explicit_rule(explicit)).withColumn("tokens", tokens())
    lab = take_columns(labels, "doc_id", "quality", "toxic").where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("_bad"))
    train = p.join(lab, p["page_id"] == lab["doc_id"], "left").withColumn(
        "verdict", F.coalesce(F.col("_e.verdict"), F.when(F.col("_bad"), "block").when(~F.col("_bad"), "allow")))
    rules = mine(train.where(F.col("verdict").isNotNull()).select("tokens", "verdict"), **kw)
    p = with_mined(p, rules)
    return p.select("page_id", "host", "path", F.col("_e.rule").alias("rule"),
                    F.coalesce(F.col("_e.verdict"), F.col("mined"), F.lit(default)).alias("verdict"), "mined")
