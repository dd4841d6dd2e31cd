"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a domain - language - source tree in proportion to integer weights. A node can take no more than its
leaves hold, times the epochs allowed; what it can't take goes to its siblings first and, as a parent never gets more than its
leaves can take, to the parent's siblings only when they are all full. Each leaf takes whole seeded epochs of its documents and
a token-prefix of the next one. DataFrame functions throughout.

A leaf's prefix is found from sums over 4096 spans of the seeded order, then from sums per key of the span where the budget ends,
so no task sorts or gathers a whole leaf. What is joined to the documents is a row per leaf, broadcast up to SMALL leaves.

Edge cases: null domains, languages and sources count as ''; null and empty texts have no tokens; shares are rounded down, so
up to one token per child stays unspent; a node of weight 0, or without tokens, gets nothing; rows that repeat an id stand or
fall together; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import WORD, looked_up, written

LEVELS = ("domain", "lang", "source")
SPAN_DIGITS = 3
#: Weights of the query; a name that isn't listed has weight 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 3, "fr": 2, "es": 1}, "source": {}}
#: Budget as percent of the tokens there are, most epochs, seed.
BUDGET_PERCENT, EPOCHS, SEED = 70, 2, 11


def source_domain(source: Column) -> Column:
    """Domain of a source: its number mod 4."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    return F.when(n == "", "d").otherwise(F.concat(F.lit("d"), F.pmod(n.cast("decimal(38,0)"), F.lit(4)).cast("int").cast("string")))


def _weight(level: str, weights: dict) -> Column:
    return reduce(lambda out, item: F.when(F.col(level) == item[0], F.lit(item[1])).otherwise(out), weights.get(level, {}).items(), F.lit(1)).cast("long")


def _filled(nodes: DataFrame, level: int, weights: dict) -> DataFrame:
    """Each parent's `budget` shared among its children (`held` is what a child can take): children are filled in the order of
    held / weight; the first that isn't filled, and all after it, share the rest by weight."""
    parents, name = list(LEVELS[:level]), LEVELS[level]
    nodes = nodes.withColumn("w", _weight(name, weights)).filter("w > 0 AND held > 0")
    order = Window.partitionBy(*(parents or [F.lit(0)])).orderBy(F.col("held") / F.col("w"), name)
    whole = Window.partitionBy(*(parents or [F.lit(0)]))
    left = F.col("budget") - F.coalesce(F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nodes = nodes.withColumns({"left": left, "open_w": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)), "at": F.row_number().over(order)})
    free = F.when(F.col("left") * F.col("w") < F.col("held") * F.col("open_w"), F.struct("at", "left", "open_w"))
    nodes = nodes.withColumn("level", F.min(free).over(whole))
    share = F.expr("(level.left * w) div level.open_w")
    return nodes.withColumn("share", F.when(F.col("level").isNull() | (F.col("at") < F.col("level.at")), F.col("held")).otherwise(F.least(share, F.col("held"))))


def leaf_budgets(leaves: DataFrame, weights: dict, percent: int, epochs: int) -> DataFrame:
    """`leaves` (the levels, tokens) with `share`, the tokens each leaf is to give; leaves that give none are left out."""
    held = leaves.withColumn("held", F.col("tokens") * epochs)
    total = held.agg(F.expr(f"coalesce(sum(tokens), 0) * {percent} div 100").alias("budget"))
    above = None
    for level in range(len(LEVELS)):
        names = list(LEVELS[: level + 1])
        nodes = held.groupBy(*names).agg(F.sum("held").alias("held"), F.sum("tokens").alias("tokens"))
        # the root's budget is one row, the others are one row per parent
        nodes = nodes.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").drop("one") if level == 0 else nodes.join(above, names[:-1])
        above = _filled(nodes, level, weights).select(*names, "tokens", F.col("share").alias("budget"))
        above = above if level == len(LEVELS) - 1 else above.drop("tokens")
    return above.withColumnRenamed("budget", "share")


def _with_levels(docs: DataFrame, domain: Column) -> DataFrame:
    """`docs` with the levels as `__domain`, `__lang` and `__source`."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return docs.withColumns({"__domain": empty(domain), "__lang": empty(F.col("lang")), "__source": empty(F.col("source"))})


_LEAF = [f"__{c}" for c in LEVELS]


def _key(seed: int) -> Column:
    """Place of a document in the seeded order of its leaf's last epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def leaf_plan(rows: DataFrame, weights: dict, percent: int, epochs: int, seed: int) -> DataFrame:
    """Of each leaf that gives tokens: `__whole` epochs, and `__last` (span and key), up to which documents go once more. `rows`
    has the leaf, doc_id and n_tokens.

    Every step adds tokens within a leaf's spans, or within the keys of one span, before a leaf's sums meet."""
    leaves = rows.groupBy(*[F.col(f"__{c}").alias(c) for c in LEVELS]).agg(F.sum("n_tokens").alias("tokens"))
    shares = leaf_budgets(leaves, weights, percent, epochs)
    plan = written(shares.select(*[F.col(c).alias(f"__{c}") for c in LEVELS], F.expr("share div tokens").alias("__whole"), F.expr("share % tokens").alias("__rest")))
    spread = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = looked_up(rows, plan, _LEAF, spread).withColumn("key", _key(seed)).withColumn("span", F.substring("key", 1, SPAN_DIGITS))
    upto = F.sum("n").over(Window.partitionBy(*_LEAF).orderBy("span"))
    spans = keyed.groupBy(*_LEAF, "__rest", "span").agg(F.sum("n_tokens").alias("n")).withColumn("upto", upto).filter("upto > __rest")
    ends = written(spans.groupBy(*_LEAF).agg(F.min(F.struct("span", (F.col("upto") - F.col("n")).alias("before"))).alias("end")).select(*_LEAF, F.col("end.span").alias("end"), "end.before"))
    edge = looked_up(keyed, ends, _LEAF, spread).filter("span = end").groupBy(*_LEAF, "__rest", "before", "key").agg(F.sum("n_tokens").alias("n"))
    within = edge.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*_LEAF).orderBy("key"))).filter("upto <= __rest")
    last = within.groupBy(*_LEAF).agg(F.max("key").alias("key"))
    # a key up to which documents go: that in the span where the budget ends, or what comes before that span
    place = F.coalesce("key", "end")
    return written(plan.join(ends, _LEAF, "left").join(last, _LEAF, "left").select(*_LEAF, "__whole", place.alias("__last")))


def _counted(docs: DataFrame, domain: Column) -> DataFrame:
    """The leaf, doc_id and n_tokens of each document, written."""
    tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return written(_with_levels(docs, domain).select("doc_id", *_LEAF, tokens.alias("n_tokens")))


def _with_copies(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The chosen of `rows` (doc_id and the leaf among its columns) with `__copies`, 1 and up."""
    out = looked_up(rows, plan, _LEAF, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    more = (_key(seed) <= F.col("__last")).cast("long")
    return out.withColumn("__copies", (F.col("__whole") + F.coalesce(more, F.lit(0))).cast("int")).filter("__copies > 0")


def mixed_documents(docs: DataFrame, domain: Column, weights: dict = WEIGHTS, percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies (1 and up) of the documents chosen from `docs` (doc_id, text, lang,
    source)."""
    rows = _counted(docs, domain)
    chosen = _with_copies(rows, leaf_plan(rows, weights, percent, epochs, seed), seed)
    return chosen.select("doc_id", *[F.col(f"__{c}").alias(c) for c in LEVELS], "n_tokens", F.col("__copies").alias("copies"))


def op6_mixing(docs: DataFrame) -> DataFrame:
    return mixed_documents(docs.select("doc_id", "text", "lang", "source"), source_domain(F.col("source")))


def mixed_rows(docs: DataFrame, domain: Column, weights: dict = WEIGHTS, percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The chosen documents with their own columns, one row per copy. The texts aren't shuffled."""
    plan = leaf_plan(_counted(docs, domain), weights, percent, epochs, seed)
    chosen = _with_copies(_with_levels(docs, domain), plan, seed)
    return chosen.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def oracle_sql() -> str:
    """The query's rows in one window per leaf, as plain SQL."""
    weight = lambda level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END" if WEIGHTS[level] else "1"
    ctes = ["""rows_ AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN 'd'
      ELSE 'd' || CAST(CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4 AS VARCHAR) END AS domain,
      coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents)""",
        f"held AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {EPOCHS} AS held FROM rows_ GROUP BY ALL)",
        f"b_root AS (SELECT CAST(sum(tokens) AS BIGINT) * {BUDGET_PERCENT} // 100 AS budget FROM held)"]
    above = "b_root"
    for level, name in enumerate(LEVELS):
        parents, names = ", ".join(LEVELS[:level]) or "1", ", ".join(LEVELS[: level + 1])
        join = f"NATURAL JOIN {above}" if level else f", {above}"
        ctes.append(f"""n_{name} AS (SELECT *, {weight(name)} AS w FROM (SELECT {names}, CAST(sum(held) AS BIGINT) AS held FROM held GROUP BY ALL) {join} WHERE {weight(name)} > 0 AND held > 0)""")
        ctes.append(f"""o_{name} AS (SELECT *, budget - coalesce(sum(held) OVER (PARTITION BY {parents} ORDER BY held / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
          sum(w) OVER (PARTITION BY {parents} ORDER BY held / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
          row_number() OVER (PARTITION BY {parents} ORDER BY held / w, {name}) AS at_ FROM n_{name})""")
        ctes.append(f"""l_{name} AS (SELECT *, min(at_) FILTER (left_ * w < held * open_w) OVER (PARTITION BY {parents}) AS first_ FROM o_{name})""")
        ctes.append(f"""b_{name} AS (SELECT {names}, CAST(CASE WHEN first_ IS NULL OR at_ < first_ THEN held
          ELSE least(held, (max(left_) FILTER (at_ = first_) OVER (PARTITION BY {parents}) * w) // (max(open_w) FILTER (at_ = first_) OVER (PARTITION BY {parents}))) END AS BIGINT) AS budget FROM l_{name})""")
        above = f"b_{name}"
    ctes.append("plan AS (SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS rest FROM b_source NATURAL JOIN held)")
    ctes.append(f"keyed AS (SELECT rows_.*, whole, rest, md5('{SEED}:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM rows_ NATURAL JOIN plan)")
    return f"""WITH {', '.join(ctes)} SELECT doc_id, domain, lang, source, n_tokens, CAST(copies AS INTEGER) AS copies FROM (
      SELECT *, whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS copies FROM keyed) WHERE copies > 0"""
