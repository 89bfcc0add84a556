"""Market-basket queries (department baskets per store-week)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.functions.numeric import r4
from tillcast.operators import basket as B
from tillcast.plans.registry import Views, register
from tillcast.plans.sqlbase import with_cleaned

# Thresholds for the stand-in data (the reference defaults of 0.25 support
# and lift 1.2 find no rules on it); the operator defaults stay those of the reference.
MIN_SUPPORT = 0.15
MIN_LIFT = 1.0
# Correlations called strong on the stand-in data, where none reaches the
# reference defaults of 0.85 and -0.65 (the operator defaults).
POS_CORR, NEG_CORR = 0.0, -0.02
# The department names of the stand-in data (oracle pivot columns).
TYPE_ITEMS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def basket_ctes(min_support: float) -> list[str]:
    s = repr(float(min_support))
    return [
        "bi as (select distinct store, date, dept as item from cleaned where weekly_sales_cleaned > 0)",
        "nb as (select cast(count(*) as double) as n from (select distinct store, date from bi) x)",
        f"f1 as (select item, count(*) as cnt from bi group by item having count(*) / (select n from nb) >= {s})",
        "fi as (select bi.* from bi join f1 on f1.item = bi.item)",
        """bp as (select a.store, a.date, a.item as i1, b.item as i2 from fi a join fi b
               on a.store = b.store and a.date = b.date and a.item < b.item)""",
        f"p2 as (select i1, i2, count(*) as cnt from bp group by i1, i2 having count(*) / (select n from nb) >= {s})",
        f"""p3 as (select p.i1, p.i2, c.item as i3, count(*) as cnt
               from (select bp.* from bp join p2 on p2.i1 = bp.i1 and p2.i2 = bp.i2) p
               join fi c on c.store = p.store and c.date = p.date and c.item > p.i2
               group by p.i1, p.i2, c.item having count(*) / (select n from nb) >= {s})""",
        """sets as (select item as itemset, 1 as size, cnt, cnt / (select n from nb) as support from f1
               union all select i1 || ', ' || i2, 2, cnt, cnt / (select n from nb) from p2
               union all select i1 || ', ' || i2 || ', ' || i3, 3, cnt, cnt / (select n from nb) from p3)""",
        """splits as (
               select i1 as a, i2 as c, cnt from p2 union all select i2, i1, cnt from p2
               union all select i1, i2 || ', ' || i3, cnt from p3 union all select i2, i1 || ', ' || i3, cnt from p3
               union all select i3, i1 || ', ' || i2, cnt from p3 union all select i1 || ', ' || i2, i3, cnt from p3
               union all select i1 || ', ' || i3, i2, cnt from p3 union all select i2 || ', ' || i3, i1, cnt from p3)""",
        """rules_all as (
               select antecedents, consequents, antecedent_support, consequent_support, support,
                      support / antecedent_support as confidence,
                      support / antecedent_support / consequent_support as lift,
                      support - antecedent_support * consequent_support as leverage,
                      case when support / antecedent_support < 1
                           then (1e0 - consequent_support) / (1e0 - support / antecedent_support) end as conviction,
                      (support - antecedent_support * consequent_support)
                        / nullif(greatest(support * (1e0 - antecedent_support),
                                          antecedent_support * (consequent_support - support)), 0) as zhangs_metric
               from (select s.a as antecedents, s.c as consequents, sa.support as antecedent_support,
                            sc.support as consequent_support, s.cnt / (select n from nb) as support
                     from splits s join sets sa on sa.itemset = s.a join sets sc on sc.itemset = s.c) x)""",
        "rules_uncut as (select * from rules_all where zhangs_metric is not null)",
    ]


RULE_COLS = ["antecedent_support", "consequent_support", "support", "confidence", "lift", "leverage",
             "conviction", "zhangs_metric"]


def _rsql(prefix=""):
    return ", ".join(f"r4({prefix}{c}) as {c}" for c in RULE_COLS)


def _rules_spark(rules):
    return rules.select("antecedents", "consequents", *[r4(c).alias(c) for c in RULE_COLS])


W = with_cleaned(*basket_ctes(MIN_SUPPORT))


def _items(spark, sf_dir):
    return B.basket_items(Views(spark, sf_dir).cleaned)


def _itemsets(spark, sf_dir, min_support=MIN_SUPPORT):
    return B.frequent_itemsets(_items(spark, sf_dir), min_support)


@register("basket_items", W + "select store, date, item from bi")
def basket_items(spark, sf_dir):
    return _items(spark, sf_dir)


@register("frequent_items", with_cleaned(*basket_ctes(0.25)) + """
select item as itemset, r4(cnt / (select n from nb)) as support from f1""")
def frequent_items(spark, sf_dir):
    s = B.frequent_itemsets(_items(spark, sf_dir), 0.25, max_len=1)
    return s.select("itemset", r4("support").alias("support"))


@register("pair_support", W + """
select i1 as item_a, i2 as item_b, count(*) as n_baskets, r4(count(*) / (select n from nb)) as support
from (select a.store, a.date, a.item as i1, b.item as i2 from bi a join bi b
      on a.store = b.store and a.date = b.date and a.item < b.item) x group by i1, i2""")
def pair_support(spark, sf_dir):
    items = _items(spark, sf_dir)
    n = B.n_baskets(items)
    s = B.frequent_itemsets(items, 0.0, max_len=2, n=n).where(F.col("size") == 2)
    return s.select(F.col("items")[0].alias("item_a"), F.col("items")[1].alias("item_b"), F.col("cnt").alias("n_baskets"),
                    r4("support").alias("support"))


@register("frequent_itemsets", W + "select itemset, size, cnt, r4(support) as support from sets")
def frequent_itemsets(spark, sf_dir):
    s = _itemsets(spark, sf_dir)
    return s.select("itemset", "size", "cnt", r4("support").alias("support"))


@register("association_rules", W + f"""
select antecedents, consequents, {_rsql()} from rules_uncut where lift >= {MIN_LIFT!r}""")
def association_rules(spark, sf_dir):
    return _rules_spark(B.association_rules(_itemsets(spark, sf_dir), MIN_LIFT))


@register("rule_tiers", W + f"""
select antecedents, consequents, {_rsql()}, tier from (
  select *, case when confidence > 0.7 and lift > 1.2 then 'strong'
                 when confidence > 0.6 and confidence < 0.85 and lift > 1.3 and lift < 1.45 then 'medium'
                 when lift < 1 then 'below_one' end as tier
  from rules_uncut) t where tier is not null""")
def rule_tiers(spark, sf_dir):
    r = B.rule_tiers(B.association_rules(_itemsets(spark, sf_dir), None))
    return r.select("antecedents", "consequents", *[r4(c).alias(c) for c in RULE_COLS], "tier")


@register("top_rules", W + f"""
select antecedents, consequents, {_rsql()} from rules_uncut where lift >= {MIN_LIFT!r}
order by lift desc, antecedents, consequents limit 50""")
def top_rules(spark, sf_dir):
    return _rules_spark(B.top_rules(B.association_rules(_itemsets(spark, sf_dir), MIN_LIFT), 50))


@register("rule_network", W + f"""
, top as (select * from rules_uncut where lift >= {MIN_LIFT!r} order by lift desc, antecedents, consequents limit 30)
select 'edge' as kind, antecedents as source, consequents as target, r4(lift) as lift,
       r4(confidence) as confidence, r4(support) as support, cast(null as double) as weight from top
union all
select 'node', node, null, null, null, null, r4(sum(support)) from (
  select antecedents as node, support from top union all select consequents, support from top) e group by node""")
def rule_network(spark, sf_dir):
    net = B.rule_network(B.association_rules(_itemsets(spark, sf_dir), MIN_LIFT), 30)
    return net.select("kind", "source", "target", *[r4(c).alias(c) for c in
                                                     ("lift", "confidence", "support", "weight")])


@register("lift_pivot", W + f"""
select antecedents, {", ".join(f"r4(coalesce(max(case when consequents = '{i}' then lift end), 0e0)) as {i}"
                               for i in TYPE_ITEMS)}
from rules_uncut where lift >= {MIN_LIFT!r} and antecedents not like '%, %' and consequents not like '%, %'
group by antecedents""")
def lift_pivot(spark, sf_dir):
    s = _itemsets(spark, sf_dir)
    items = sorted(r[0] for r in s.where(F.col("size") == 1).select("itemset").collect())
    p = B.lift_pivot(B.association_rules(s, MIN_LIFT), items)
    return p.select("antecedents", *[r4(F.col(f"`{i}`")).alias(i) for i in items])


DEPT_CORR_CTES = [
    """piv as (select d.dept, dt.date, coalesce(sum(c.weekly_sales_cleaned), 0e0) as sales
               from (select distinct dept from cleaned) d cross join (select distinct date from cleaned) dt
               left join cleaned c on c.dept = d.dept and c.date = dt.date group by d.dept, dt.date)""",
    """dcorr as (select a.dept as dept1, b.dept as dept2,
                        case when stddev_samp(a.sales) * stddev_samp(b.sales) <> 0 then corr(a.sales, b.sales) end as corr
                 from piv a join piv b on a.date = b.date group by a.dept, b.dept)""",
]


@register("dept_corr", with_cleaned(*DEPT_CORR_CTES) + "select dept1, dept2, r4(s8(corr)) as corr from dcorr")
def dept_corr(spark, sf_dir):
    from tillcast.functions.numeric import snap8
    c = B.item_week_matrix_corr(Views(spark, sf_dir).cleaned)
    return c.select("dept1", "dept2", r4(snap8("corr")).alias("corr"))


@register("strong_pairs", with_cleaned(*DEPT_CORR_CTES) + f"""
select dept1, dept2, r4(s8(corr)) as corr, case when corr > {POS_CORR!r} then 'positive' else 'negative' end as sign
from dcorr where dept1 < dept2 and (corr > {POS_CORR!r} or corr < {NEG_CORR!r})""")
def strong_pairs(spark, sf_dir):
    from tillcast.functions.numeric import snap8
    c = B.strong_pairs(B.item_week_matrix_corr(Views(spark, sf_dir).cleaned), POS_CORR, NEG_CORR)
    return c.select("dept1", "dept2", r4(snap8("corr")).alias("corr"), "sign")


PARITY_CTES = [
    "hs as (select store, date, dept || case when weekofyear(date) % 2 = 0 then ' even' else ' odd' end as dept, weekly_sales_cleaned from cleaned)",
    """hpiv as (select d.dept, dt.date, coalesce(sum(c.weekly_sales_cleaned), 0e0) as sales
               from (select distinct dept from hs) d cross join (select distinct date from hs) dt
               left join hs c on c.dept = d.dept and c.date = dt.date group by d.dept, dt.date)""",
    """hcorr as (select a.dept as dept1, b.dept as dept2,
                        case when stddev_samp(a.sales) * stddev_samp(b.sales) <> 0 then corr(a.sales, b.sales) end as corr
                 from hpiv a join hpiv b on a.date = b.date group by a.dept, b.dept)""",
]


def _week_parity(spark, sf_dir):
    """Departments told apart by even and odd weeks: items of different weeks never meet."""
    c = Views(spark, sf_dir).cleaned
    parity = F.when(F.weekofyear("date") % 2 == 0, F.lit(" even")).otherwise(F.lit(" odd"))
    return c.withColumn("dept", F.concat("dept", parity))


@register("alternating_corr", with_cleaned(*PARITY_CTES) + "select dept1, dept2, r4(s8(corr)) as corr from hcorr")
def alternating_corr(spark, sf_dir):
    from tillcast.functions.numeric import snap8
    c = B.item_week_matrix_corr(_week_parity(spark, sf_dir))
    return c.select("dept1", "dept2", r4(snap8("corr")).alias("corr"))


@register("alternating_pairs", with_cleaned(*PARITY_CTES) + """
select dept1, dept2, r4(s8(corr)) as corr, case when corr > 3e-1 then 'positive' else 'negative' end as sign
from hcorr where dept1 < dept2 and (corr > 3e-1 or corr < -3e-1)""")
def alternating_pairs(spark, sf_dir):
    from tillcast.functions.numeric import snap8
    c = B.strong_pairs(B.item_week_matrix_corr(_week_parity(spark, sf_dir)), 0.3, -0.3)
    return c.select("dept1", "dept2", r4(snap8("corr")).alias("corr"), "sign")
