"""Market-basket analysis: baskets, frequent itemsets of any size, rules with
multi-item consequents, rule tiers, top rules, rule network, department correlations.

Scale notes. A basket is one (store, date); items are departments. Items are pruned
by support, then every basket becomes one sorted array of its frequent items, built
by one shuffle and written. Level k counts the k-item combinations inside a basket
whose (k-1)-item parts are all frequent, by map-side combine, never across baskets.
Itemsets are arrays; text is joined only for output. The frequent parts are joined as
a table and the optimizer chooses how.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.session import written

KEYS = ["store", "date"]


def basket_items(df: DataFrame, item: str = "dept", value: str = "weekly_sales_cleaned",
                 keys: list[str] = KEYS) -> DataFrame:
    """Distinct (basket, item) with positive sales."""
    return df.where(F.col(value) > 0).select(*keys, F.col(item).alias("item")).distinct()


def n_baskets(items: DataFrame, keys: list[str] = KEYS) -> int:
    return items.select(*keys).distinct().count()


def frequent_itemsets(items: DataFrame, min_support: float, max_len: int = 3,
                      keys: list[str] = KEYS, n: int | None = None) -> DataFrame:
    """Frequent itemsets up to ``max_len``: (items, itemset, size, cnt, support).

    ``items`` is the sorted array, ``itemset`` its text. Apriori: a set of k items is
    counted in the baskets that hold it and only if the sets without its last or its
    first item are frequent.
    """
    if max_len < 1:
        raise ValueError("max_len must be at least 1")
    baskets = items.groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("all"))
    baskets = written(baskets.withColumn("b", F.monotonically_increasing_id()).select("b", "all"))
    n = n if n is not None else baskets.count()
    enough = F.col("cnt") / F.lit(float(n)) >= min_support
    one = baskets.select(F.explode("all").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("cnt")).where(enough)
    sets = [written(one.select(F.array("item").alias("items"), "cnt"))]
    held = baskets.select("b", F.explode("all").alias("item")).join(one.select("item"), "item", "left_semi")
    held = written(held.groupBy("b").agg(F.array_sort(F.collect_list("item")).alias("all")))  # at most the frequent items
    grown = held.select("b", "all", F.explode(F.transform("all", lambda x: F.array(x))).alias("items"))
    for size in range(2, max_len + 1):
        # each set grows by a larger item of its basket
        larger = F.filter("all", lambda x: x > F.element_at("items", -1))
        grown = grown.select("b", "all", F.explode(F.transform(larger, lambda x: F.concat("items", F.array(x)))).alias("items"))
        if size > 2:  # the part without the first item must be frequent as well
            known = sets[-1].select(F.col("items").alias("_p"))
            grown = grown.join(known, F.slice("items", 2, size - 1) == F.col("_p"), "left_semi")
        level = written(grown.groupBy("items").agg(F.count(F.lit(1)).alias("cnt")).where(enough))
        sets.append(level)
        if size < max_len:
            grown = grown.join(level.select("items"), "items", "left_semi")
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.select("items", F.array_join("items", ", ").alias("itemset"), F.size("items").alias("size"), "cnt",
                      (F.col("cnt") / F.lit(float(n))).alias("support"))


def _splits(itemsets: DataFrame) -> DataFrame:
    """All (antecedent, consequent) splits: a bit mask says which items are antecedents."""
    sets = itemsets.where(F.col("size") >= 2)
    masks = F.expr("sequence(1, cast(pow(2, size) as int) - 2)")
    r = sets.select("items", "support", F.explode(masks).alias("mask"))
    side = "filter(items, (x, i) -> getbit(mask, i) = {})"
    return r.select(F.expr(side.format(1)).alias("a"), F.expr(side.format(0)).alias("c"), "support")


def association_rules(itemsets: DataFrame, min_lift: float | None = 1.0) -> DataFrame:
    """Rules from every split of every frequent itemset, with the usual metrics.

    Supports of antecedents and consequents are looked up among the itemsets
    (frequent by the apriori property). Rules whose Zhang metric is undefined
    are dropped; conviction is null when confidence is 1. ``a`` and ``c`` hold the
    sides as arrays, ``antecedents`` and ``consequents`` as text.
    """
    sup = itemsets.select("items", "support")
    r = (_splits(itemsets)
         .join(sup.select(F.col("items").alias("a"), F.col("support").alias("antecedent_support")), "a")
         .join(sup.select(F.col("items").alias("c"), F.col("support").alias("consequent_support")), "c"))
    s, sa, sc = F.col("support"), F.col("antecedent_support"), F.col("consequent_support")
    conf = s / sa
    r = r.select("a", "c", F.array_join("a", ", ").alias("antecedents"), F.array_join("c", ", ").alias("consequents"),
                 "antecedent_support", "consequent_support", "support",
                 conf.alias("confidence"), (conf / sc).alias("lift"), (s - sa * sc).alias("leverage"),
                 F.when(conf < 1, (F.lit(1.0) - sc) / (F.lit(1.0) - conf)).alias("conviction"),
                 F.try_divide(s - sa * sc, F.greatest(s * (F.lit(1.0) - sa), sa * (sc - s))).alias("zhangs_metric"))
    r = r.where(F.col("zhangs_metric").isNotNull())
    if min_lift is not None:
        r = r.where(F.col("lift") >= min_lift)
    return r


def rule_tiers(rules: DataFrame) -> DataFrame:
    """Strong / medium / below-one tiers, cut from the uncut rule set."""
    c, l = F.col("confidence"), F.col("lift")
    tier = (F.when((c > 0.7) & (l > 1.2), "strong")
            .when((c > 0.6) & (c < 0.85) & (l > 1.3) & (l < 1.45), "medium")
            .when(l < 1, "below_one"))
    return rules.withColumn("tier", tier).where(F.col("tier").isNotNull())


def top_rules(rules: DataFrame, k: int = 50) -> DataFrame:
    """Top-k rules by lift (ties by antecedents, consequents): a TakeOrderedAndProject."""
    return rules.orderBy(F.desc("lift"), "antecedents", "consequents").limit(k)


def rule_network(rules: DataFrame, k: int = 30) -> DataFrame:
    """Edges of the top-k rules and nodes weighted by summed support, in one table."""
    top = top_rules(rules, k)
    edges = top.select(F.lit("edge").alias("kind"), F.col("antecedents").alias("source"),
                       F.col("consequents").alias("target"), "lift", "confidence", "support",
                       F.lit(None).cast("double").alias("weight"))
    ends = top.select(F.col("antecedents").alias("node"), "support").unionByName(
        top.select(F.col("consequents").alias("node"), "support"))
    nodes = ends.groupBy("node").agg(F.sum("support").alias("weight")).select(
        F.lit("node").alias("kind"), F.col("node").alias("source"), F.lit(None).cast("string").alias("target"),
        F.lit(None).cast("double").alias("lift"), F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("double").alias("support"), "weight")
    return edges.unionByName(nodes)


def lift_pivot(rules: DataFrame, items: list[str]) -> DataFrame:
    """Antecedent x consequent lift grid of one-to-one rules, absent cells 0.

    ``items`` are the frequent items (a bounded list), so the width is fixed up front.
    """
    one = rules.where((F.size("a") == 1) & (F.size("c") == 1))
    return one.groupBy("antecedents").pivot("consequents", items).agg(F.first("lift")).fillna(0.0)


def item_week_matrix_corr(df: DataFrame, item: str = "dept", value: str = "weekly_sales_cleaned") -> DataFrame:
    """Pearson correlation between all pairs of items over weeks (absent weeks count as 0), long form.

    Items that meet in a week are paired inside the week; an absent week adds nothing to
    sums and products, so moments over the weeks at hand and the number of all weeks
    give the correlation. One more row of all items, each with the value 0, pairs those
    that never share a week. A pair with an item of equal value in every week is null.
    """
    wk = df.groupBy("date", item).agg(F.sum(value).cast("double").alias("v"))
    wk = written(wk.select("date", F.col(item).alias("i"), "v"))
    n = F.lit(float(wk.select("date").distinct().count()))
    one = wk.groupBy("i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    rows = wk.select(F.struct("date").alias("row"), "i", "v").unionByName(
        one.select(F.lit(None).cast("struct<date: date>").alias("row"), "i", F.lit(0.0).alias("v")))
    week = rows.groupBy("row").agg(F.collect_list(F.struct("i", "v")).alias("all"))  # the items of one week
    pair = (week.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
            .groupBy(F.col("x.i").alias("dept1"), F.col("y.i").alias("dept2"))
            .agg(F.sum(F.col("x.v") * F.col("y.v")).alias("p")))
    a = one.select(F.col("i").alias("dept1"), F.col("s").alias("s1"), F.col("q").alias("q1"))
    b = one.select(F.col("i").alias("dept2"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    r = pair.join(a, "dept1").join(b, "dept2")
    cov = F.col("p") - F.col("s1") * F.col("s2") / n
    spread = F.sqrt(F.greatest((F.col("q1") - F.col("s1") * F.col("s1") / n) * (F.col("q2") - F.col("s2") * F.col("s2") / n), F.lit(0.0)))
    return r.select("dept1", "dept2", F.try_divide(cov, spread).alias("corr"))


def strong_pairs(corr: DataFrame, pos: float = 0.85, neg: float = -0.65) -> DataFrame:
    """Strongly positive and strongly negative item pairs, each pair once (dept1 < dept2)."""
    c = F.col("corr")
    return (corr.where(F.col("dept1") < F.col("dept2"))
                .withColumn("sign", F.when(c > pos, "positive").when(c < neg, "negative"))
                .where(F.col("sign").isNotNull()))
