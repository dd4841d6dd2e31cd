"""URL filtering: fixed host and path rules, then association rules over URL tokens.

FP-growth mines the token sets of the urls labelled bad; how many other labelled urls hold a mined set is counted through an
inverted index. Rules `tokens -> bad` of any length, for which MIN_COUNT bad urls (all, where fewer urls are labelled) and MIN_LIFT
times the share of bad urls overall stand, block a url that holds their tokens. Tokens on fewer bad urls can be in no rule and aren't mined. Tokens that the same labelled urls hold are
one item, met by any of them: a rule with one of them is as sure as one with several, so nothing is lost, and a long url that is
repeated costs no more than a short one. A rule goes if one with an item less is as sure. Rules are found through an inverted
index on the rarest item of each, over the distinct item sets only. DataFrame functions throughout.

What mining and counting cost grows with the number of item sets on MIN_COUNT bad urls, which is left unbounded; sets that only
other urls hold cost nothing.

Edge cases: a null url, or one without `://`, has an empty host and path, no tokens, and is allowed; repeated ids and urls are
judged row by row; a label without a verdict (null quality and toxicity) is no label, of several of an id a bad one counts; without
labelled or without bad urls there are no association rules; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import looked_up, written

#: (verdict, rule) of the contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Bad urls that a rule stands on, and its share of bad urls against that of all labelled urls, at least.
MIN_COUNT, MIN_LIFT = 20, 1.5


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _tokens(prefix: str, part: Column) -> Column:
    found = F.filter(F.split(F.regexp_replace(_lower(part), r"[0-9]+", "0"), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.transform(found, lambda t: F.concat(F.lit(prefix), t))


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens: parts of the host (h:), of the path (p:) and of query and fragment (q:); digits become 0. Only of
    urls with a `://`."""
    host, path = host_and_path(url)
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*[?#](.*)$", 1), F.lit(""))
    return F.array_sort(F.array_distinct(F.concat(_tokens("h:", host), _tokens("p:", path), _tokens("q:", rest))))


def url_items(labelled: DataFrame, least: int) -> DataFrame:
    """(token, item, n): the tokens on `least` bad urls of `labelled` (row, tokens, bad), the least token held by the same rows, and the
    number of these."""
    each = labelled.select("row", "bad", F.explode("tokens").alias("token"))
    # of two seeded hashes, the sum over the rows names the set of rows
    rows = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"rows{k}") for k in (1, 2)]
    seen = each.groupBy("token").agg(F.count_if("bad").alias("n_bad"), F.count("*").alias("n"), *rows).filter(F.col("n_bad") >= least)
    item = seen.groupBy("n", "rows1", "rows2").agg(F.min("token").alias("item"))
    return seen.join(item, ["n", "rows1", "rows2"]).select("token", "item", "n")


def _counted(mined: DataFrame, others: DataFrame) -> DataFrame:
    """`mined` (items, key) with the number `n_other` of rows of `others` (held, times) that hold all items. A set of items is looked
    for only among the rows that hold its key, the rarest of them; these may be many for one key, and are dealt by their sets."""
    asked = looked_up(others.withColumn("key", F.explode("held")), mined.select("key", "items"), ["key"], F.xxhash64("held"))
    met = asked.filter(F.size(F.array_except("items", "held")) == 0)
    return mined.join(met.groupBy("items").agg(F.sum("times").alias("n_other")), "items", "left").withColumn("n_other", F.coalesce("n_other", F.lit(0)))


def mined_rules(urls: DataFrame, labels: DataFrame, min_count: int = MIN_COUNT, min_lift: float = MIN_LIFT) -> tuple[DataFrame, DataFrame] | None:
    """(items, confidence, lift, n_bad, key): rules that lead to a bad label, key being the rarest item; and (token, item), the
    item that each token in a rule counts as. `urls` has id and tokens, `labels` has id and bad. None without bad rows, or with fewer
    than a rule needs."""
    one = labels.groupBy("id").agg(F.max("bad").alias("bad"))
    labelled = written(written(urls.join(one, "id").select("tokens", "bad")).withColumn("row", F.monotonically_increasing_id()))
    n, n_bad = labelled.agg(F.count("*"), F.count_if("bad")).head()
    least = min(min_count, n)
    if not n_bad or n_bad < least:
        return None
    items = written(url_items(labelled, least))
    held = looked_up(labelled.select("row", "bad", F.explode("tokens").alias("token")), items.drop("n"), ["token"], F.col("row"))
    baskets = written(held.groupBy("row", "bad").agg(F.array_sort(F.collect_set("item")).alias("held")))
    # half a url less, so that rounding of the share doesn't ask for one more
    model = FPGrowth(itemsCol="held", minSupport=(least - 0.5) / n_bad).fit(baskets.filter("bad"))
    mined = written(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n_bad")))
    keyed = mined.withColumn("item", F.explode("items")).join(items.select("item", "n").distinct(), "item").groupBy("items", "n_bad").agg(F.min_by("item", F.struct("n", "item")).alias("key"))
    others = baskets.filter(~F.col("bad")).groupBy("held").agg(F.count("*").alias("times"))
    rules = _counted(written(keyed), others).withColumn("confidence", F.col("n_bad") / (F.col("n_bad") + F.col("n_other")))
    rules = written(rules.filter(F.col("confidence") >= min(1.0, min_lift * n_bad / n)).select("items", "confidence", (F.col("confidence") / (n_bad / n)).alias("lift"), "n_bad", "key"))
    shorter = rules.select(F.col("items").alias("part"), F.col("confidence").alias("sure"))
    parts = rules.filter(F.size("items") > 1).select("items", "confidence", F.explode("items").alias("without")).withColumn("part", F.array_remove("items", F.col("without")))
    rules = written(rules.join(parts.join(shorter, "part").filter("sure >= confidence").select("items").distinct(), "items", "left_anti"))
    needed = rules.select(F.explode("items").alias("item")).distinct()
    return rules, written(items.select("token", "item").join(needed, "item", "left_semi"))


def judged_urls(pages: DataFrame, labels: DataFrame, rules=RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence (of the best association rule met). `labels` has id and bad; it is
    joined on page_id."""
    host, path = host_and_path(F.col("url"))
    urls = written(pages.select(F.col("page_id").alias("id"), host.alias("host"), path.alias("path"), url_tokens(F.col("url")).alias("tokens")))
    found = mined_rules(urls.select("id", "tokens"), labels, **options)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    named = urls.select(F.col("id").alias("page_id"), "host", "path", rule.alias("rule"), verdict.alias("own"), "tokens")
    if found is None:
        return named.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    mined, item_of = found
    # token sets whose items hold what a rule needs; there are no more of them than distinct token sets
    sets = urls.select("tokens").distinct().withColumn("set", F.xxhash64("tokens"))
    items = looked_up(sets.select("tokens", "set", F.explode("tokens").alias("token")), item_of, ["token"], F.col("set")).groupBy("tokens").agg(F.collect_set("item").alias("held"))
    asked = items.withColumn("key", F.explode("held"))
    index = mined.select("key", F.col("items").alias("needed"), "confidence")
    met = asked.join(index, "key").filter(F.size(F.array_except("needed", "held")) == 0).groupBy("tokens").agg(F.max("confidence").alias("confidence"))
    out = looked_up(named, written(met), ["tokens"], F.xxhash64("page_id", "path"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")


def op5_urlrules(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages are labelled by the documents of the same id: bad if of low quality or toxic."""
    told = labels.filter(F.col("doc_id").isNotNull() & F.coalesce("quality", "toxic").isNotNull())
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return judged_urls(pages.select("page_id", "url"), told.select(F.col("doc_id").alias("id"), bad.alias("bad")))
