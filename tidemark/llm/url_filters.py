"""URL filters: fixed host and path rules, and association rules mined from labels."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import save, table

#: (verdict, host/path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: A rule of the registered query rests on so many labelled rows at least.
MIN_ROWS = 20
#: Where rules for both verdicts are mined, a rule's confidence less so many of its
#: standard deviations must exceed its verdict's share of all labelled rows.
MARGIN = 1.0
#: Token sets in more than one of so many pages are judged by a broadcast table, which
#: so has fewer rows than that; the others are dealt out by token set.
HOT_SHARE = 1000
#: Up to so many mined rules are broadcast; beyond, the join shuffles them.
BROADCAST_RULES = 10_000
#: The item of what is to be blocked; those of tokens are 0 and up.
BLOCK = -1


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its
    host and all subdomains if the path starts with the rule's."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, prefix = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + prefix))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a url, sorted: host labels, the leading path segments
    (digits as #), the ending, query keys, and whether it has a fragment."""
    host, path = host_path(url)
    plain = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), plain(x)))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), plain(x)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    more = F.array(
        F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))),
        F.when(F.contains(url, F.lit("#")), F.lit("fragment")),
        F.when(F.endswith(path, F.lit("/")), F.lit("slash")),
    )
    every = F.array_sort(F.array_distinct(F.array_compact(F.concat(labels, segments, keys, more))))
    return F.when(F.instr(url, "://") > 0, every).otherwise(F.array().cast("array<string>"))


def surest(found: DataFrame, n: int, min_confidence: float) -> DataFrame:
    """Rows (items, confidence, support) of the rules of ``found(items, freq)``, the
    frequent sorted sets of ``n`` rows, that no shorter rule with part of their items
    equals in confidence.

    What is left of a frequent set without one of its items is frequent too. So sets are
    taken by size, each learns the highest confidence of its parts from those one item
    shorter, and what is joined and stored is in proportion to the sets."""
    whole = found.where(~F.array_contains("items", BLOCK)).withColumnRenamed("freq", "n")
    blocked = found.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("items"), "freq")
    known = save(blocked.join(whole, "items").select("items", F.size("items").alias("width"), (F.col("freq") / F.col("n")).alias("confidence"), (F.col("freq") / F.lit(n)).alias("support")), "confidences")
    longest = known.agg(F.max("width")).first()[0] or 0
    shorter, rules = None, []
    for width in range(1, longest + 1):
        own = known.where(F.col("width") == width).select("items", "confidence", "support")
        if shorter is None:
            own = own.withColumn("part", F.lit(None).cast("double"))
        else:
            parts = own.select("items", F.explode("items").alias("item")).select("items", F.array_remove("items", F.col("item")).alias("less"))
            parts = parts.join(shorter.select(F.col("items").alias("less"), F.greatest("confidence", "part").alias("sure")), "less").groupBy("items").agg(F.max("sure").alias("part"))
            own = own.join(parts, "items", "left")
        shorter = save(own, "widths")
        rules.append(shorter.where(F.col("confidence") >= min_confidence).where("part is null or part < confidence").select("items", "confidence", "support"))
    return functools.reduce(DataFrame.unionAll, rules) if rules else known.select("items", "confidence", "support")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = 1) -> DataFrame:
    """Rows (rule_id, tokens, confidence, support): token combinations of
    ``labelled(tokens, block)`` after which ``block`` is likely, by FP-growth.
    A rule is dropped if a shorter one with part of its tokens is as sure.

    Of all rows ``min_support``, and ``min_rows`` at least, must hold a rule's tokens
    and be blocked. Transactions are whole token sets but for tokens that fewer rows
    hold and are to be blocked: no rule can have these. Tokens that
    stand in the same rows are mined as one: of a rule with two of them, the one
    without either is as sure; a rule with one is given for each of them.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double")
    held = save(labelled.where("block is not null and size(tokens) > 0").select(F.monotonically_increasing_id().alias("row"), "tokens", "block"), "labelled")
    n = held.count()
    least = math.ceil(max(min_support * n, min_rows))
    if least > n:
        return empty
    min_support = (least - 0.5) / n  # FP-growth rounds the product with n up
    spread = held.select("row", "block", F.explode("tokens").alias("token"))
    where = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    counts = spread.groupBy("token").agg(F.count("*").alias("n"), F.count_if("block").alias("n_block"), *where).where(F.col("n_block") >= least)
    alike = save(counts.groupBy("n", "h0", "h1").agg(F.min("token").alias("token"), F.collect_list("token").alias("members")).select("token", "members"), "alike-tokens")
    alike = save(alike.withColumn("item", F.monotonically_increasing_id()), "alike-tokens")
    named = spread.join(F.broadcast(alike.select("token", "item")), "token", "left")
    sets = named.groupBy("row", "block").agg(F.collect_list("item").alias("known"))
    items = save(sets.select(F.when(F.col("block"), F.concat("known", F.array(F.lit(BLOCK)))).otherwise(F.col("known")).alias("items")), "transactions")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = save(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "frequent-sets")
    sure = surest(found, n, min_confidence).withColumn("rule", F.monotonically_increasing_id())
    sure = save(sure, "sure-rules")
    parts = sure.select("rule", "confidence", "support", F.explode("items").alias("item")).join(F.broadcast(alike), "item").groupBy("rule", "confidence", "support").agg(F.collect_list("members").alias("parts"))
    choices = F.aggregate("parts", F.array(F.array().cast("array<string>")), lambda acc, p: F.flatten(F.transform(acc, lambda a: F.transform(p, lambda t: F.concat(a, F.array(t))))))
    out = parts.select(F.explode(choices).alias("tokens"), "confidence", "support").withColumn("tokens", F.array_sort("tokens"))
    return save(out.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "support"), "rules")


def mine_both(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = 0.5, min_rows: int = 1, margin: float = MARGIN) -> DataFrame:
    """Rows (rule_id, tokens, confidence, support, verdict, lift): what ``mine`` finds for
    blocking and for allowing, if it is surer than the verdict's share of the labelled
    rows by ``margin`` standard deviations of a share of as many rows as hold the rule's
    tokens. The lift is the confidence over that share."""
    held = save(labelled.where("block is not null and size(tokens) > 0").select("tokens", "block"), "labelled")
    n, blocked = held.agg(F.count("*"), F.count_if("block")).first()
    found = []
    for verdict, own in (("block", blocked), ("allow", n - blocked)):
        base = own / n if n else 0.0
        rules = mine(held.withColumn("block", F.col("block") == F.lit(verdict == "block")), min_support, min_confidence, min_rows)
        rows = F.col("support") * n / F.col("confidence")
        spread = F.sqrt(F.col("confidence") * (1 - F.col("confidence")) / rows)
        rules = rules.where(F.col("confidence") - margin * spread > base)
        found.append(rules.withColumns({"verdict": F.lit(verdict), "lift": F.try_divide(F.col("confidence"), F.lit(base)), "rule_id": F.xxhash64("tokens", F.lit(verdict))}))
    return save(found[0].unionByName(found[1]), "rules")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The surest rule for each of ``sets(tokens)`` that holds all its tokens:
    (tokens, rule_tokens, confidence, verdict), by lift and then confidence. Rules are indexed under their rarest token
    (fewest rules); a set probes the index with its tokens."""
    spread = rules.select("rule_id", F.explode("tokens").alias("token"))
    common = spread.groupBy("token").agg(F.count("*").alias("n"))
    index = spread.join(common, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token")).join(rules, "rule_id").select("token", F.col("tokens").alias("rule_tokens"), "confidence", "verdict", "lift")
    index = save(index, "rule-index")
    if index.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    return hits.groupBy("tokens").agg(F.max_by(F.struct("rule_tokens", "confidence", "verdict"), F.struct("lift", "confidence", "rule_tokens")).alias("best")).select("tokens", "best.*")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = 1, both: bool = False) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: page_id, host, path, rule,
    verdict, mined (whether a mined rule gave the verdict).

    The longest fixed rule decides; else a url that holds all tokens of a rule
    mined from ``labelled(url, block)`` is blocked, with ``both`` it gets the verdict of
    the surest such rule of ``mine_both``; any other is allowed. Urls are
    reduced to distinct token sets before mining's rules are matched. A null url,
    or one without ``://``, has empty host and path and no tokens: allowed.
    Repeated rows are judged alike; columns other than the named are ignored;
    without labels no rule is mined.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), url_tokens(F.col("url")).alias("tokens"))
    learned = labelled.select(url_tokens(F.col("url").cast("string")).alias("tokens"), "block")
    if both:
        mined = mine_both(learned, min_support, min_confidence, min_rows)
    else:
        mined = mine(learned, min_support, min_confidence, min_rows).withColumns({"verdict": F.lit("block"), "lift": F.col("confidence")})
    sets = save(rows.groupBy("tokens").agg(F.count("*").alias("n")), "token-sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    verdicts = save(match(sets.select("tokens"), mined).select("tokens", F.col("verdict").alias("mined")), "verdicts")
    hot = sets.where(F.col("n") * HOT_SHARE > total).join(verdicts, "tokens", "left").select("tokens", F.struct("mined").alias("hot"))
    marked = rows.join(F.broadcast(hot), "tokens", "left")
    rest = marked.where("hot is null").join(verdicts, "tokens", "left")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    found = marked.where("hot is not null").withColumn("mined", F.col("hot.mined")).unionByName(rest).withColumns({"rule": rule, "fixed": verdict})
    return found.select("page_id", "host", "path", "rule", F.coalesce("fixed", "mined", F.lit("allow")).alias("verdict"), (F.col("fixed").isNull() & F.col("mined").isNotNull()).alias("mined"))


def op10_association_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a page is to be blocked if the document of its number has quality 0. Rules
    for blocking and allowing rest on ``MIN_ROWS`` labelled rows and half of them."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", (F.col("quality") == 0).alias("block"))
    return judge(pages, labelled, min_confidence=0.5, min_rows=MIN_ROWS, both=True)
