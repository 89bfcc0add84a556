"""DuckDB text of the stand-in views, used as the prefix of every oracle query.

The oracle is an independent engine: these CTEs restate the stand-in rules in
plain SQL (no macros), so each oracle string is one self-contained SELECT.
"""

from __future__ import annotations


def fri(x: str) -> str:
    """Friday ending the Saturday-Friday week of x, in DuckDB."""
    d = f"cast({x} as date)"
    return f"({d} + cast((5 - isodow({d}) + 7) % 7 as integer))"


def sales_cte(dept: str = "p_type", name: str = "sales", store: str = "s_nationkey") -> str:
    return f"""{name} as (
  select store, dept, date, weekly_sales, weekofyear(date) in (6, 36, 47, 52) as is_holiday from (
    select s.{store} as store, p.{dept} as dept, {fri('l.l_shipdate')} as date,
           cast(sum(case when l.l_returnflag = 'R' then -cast(l.l_extendedprice as decimal(18,2))
                         else cast(l.l_extendedprice as decimal(18,2)) end) as double) as weekly_sales
    from lineitem l join supplier s on s.s_suppkey = l.l_suppkey
                    join part p on p.p_partkey = l.l_partkey
    group by 1, 2, 3) x)"""


STORES_CTE = """stores as (
  select s.s_nationkey as store,
         case when n.n_regionkey in (0, 1) then 'A' when n.n_regionkey in (2, 3) then 'B' else 'C' end as type,
         cast(10000 * count(*) as integer) as size
  from supplier s join nation n on n.n_nationkey = s.s_nationkey
  group by s.s_nationkey, n.n_regionkey)"""


def _md(i: int) -> str:
    return (f"cast(sum(case when l.l_linenumber = {i} then cast(l.l_extendedprice as decimal(18,2)) "
            f"* cast(l.l_discount as decimal(4,2)) end) as double) as markdown{i}")


FEATURES_CTE = f"""features as (
  with spine as (select st.store, d.date from stores st cross join (select distinct date from sales) d),
  econ as (select c.c_nationkey as store, {fri('o.o_orderdate')} as date,
                  cast(sum(cast(o.o_totalprice as decimal(18,2))) as double) / count(*) / 1e3 as cpi0,
                  cast(sum(cast(c.c_acctbal as decimal(18,2))) as double) / count(*) / 1e3 as une0
           from orders o join customer c on c.c_custkey = o.o_custkey
           group by 1, 2),
  md as (select s.s_nationkey as store, {fri('l.l_shipdate')} as date,
                {', '.join(_md(i) for i in range(1, 6))}
         from lineitem l join supplier s on s.s_suppkey = l.l_suppkey
         group by 1, 2)
  select sp.store, sp.date, weekofyear(sp.date) in (6, 36, 47, 52) as is_holiday,
         round(6e1 + 25e0 * sin(2e0 * pi() * weekofyear(sp.date) / 52e0) + sp.store % 7, 4) as temperature,
         round(25e-1 + 1e-2 * weekofyear(sp.date) + 1e-1 * (sp.store % 5), 4) as fuel_price,
         md.markdown1, md.markdown2, md.markdown3, md.markdown4, md.markdown5,
         case when weekofyear(sp.date) % 5 = 0 then null else e.cpi0 end as cpi,
         case when weekofyear(sp.date) % 7 = 0 then null else e.une0 end as unemployment
  from spine sp left join econ e on e.store = sp.store and e.date = sp.date
                left join md on md.store = sp.store and md.date = sp.date)"""


def _interp(c: str) -> str:
    w_back = "over (partition by store order by date rows between unbounded preceding and current row)"
    w_fwd = "over (partition by store order by date rows between current row and unbounded following)"
    return f"""case when {c} is not null then {c}
            when last_value(case when {c} is not null then rn end ignore nulls) {w_back} is null then null
            when first_value(case when {c} is not null then rn end ignore nulls) {w_fwd} is null
              then last_value({c} ignore nulls) {w_back}
            else last_value({c} ignore nulls) {w_back}
                 + (first_value({c} ignore nulls) {w_fwd} - last_value({c} ignore nulls) {w_back})
                 * (rn - last_value(case when {c} is not null then rn end ignore nulls) {w_back})
                 / (first_value(case when {c} is not null then rn end ignore nulls) {w_fwd}
                    - last_value(case when {c} is not null then rn end ignore nulls) {w_back}) end"""


# features with markdown nulls filled, cpi/unemployment interpolated per store by date
FEATURES_FILLED_CTE = f"""features_filled as (
  select store, date, is_holiday, temperature, fuel_price,
         coalesce(markdown1, 0e0) as markdown1, coalesce(markdown2, 0e0) as markdown2,
         coalesce(markdown3, 0e0) as markdown3, coalesce(markdown4, 0e0) as markdown4,
         coalesce(markdown5, 0e0) as markdown5,
         {_interp('cpi')} as cpi,
         {_interp('unemployment')} as unemployment
  from (select *, row_number() over (partition by store order by date) as rn from features) f)"""

PREPARED_CTE = """prepared as (
  select s.store, s.dept, s.date, s.weekly_sales, cast(s.is_holiday as integer) as is_holiday,
         f.temperature, f.fuel_price, f.markdown1, f.markdown2, f.markdown3, f.markdown4, f.markdown5,
         f.cpi, f.unemployment, f.type, f.size,
         cast(year(s.date) as integer) as year, cast(month(s.date) as integer) as month,
         cast(weekofyear(s.date) as integer) as week_of_year,
         coalesce(f.markdown1, 0e0) + coalesce(f.markdown2, 0e0) + coalesce(f.markdown3, 0e0)
           + coalesce(f.markdown4, 0e0) + coalesce(f.markdown5, 0e0) as total_markdown
  from sales s
  left join (select ff.*, st.type, st.size
             from features_filled ff left join stores st on st.store = ff.store) f
    on f.store = s.store and f.date = s.date and f.is_holiday = s.is_holiday)"""


def with_views(*extra: str, dept: str = "p_type", prepared: bool = False) -> str:
    """'with sales as (...), stores as (...), features as (...)[, ...extra]'."""
    parts = [sales_cte(dept), STORES_CTE, FEATURES_CTE]
    if prepared:
        parts += [FEATURES_FILLED_CTE, PREPARED_CTE]
    parts += list(extra)
    return "with " + ",\n".join(parts) + "\n"


# rolling z + moving-average decomposition + consensus + seasonal-median repair
CLEANED_CTE = """flagged as (
  select *,
         coalesce(cast(abs((weekly_sales - avg(weekly_sales) over w8)
                           / (stddev_samp(weekly_sales) over w8 + 1e-5)) > 2e0 as integer), 0) as rolling_anomaly,
         (weekly_sales - avg(weekly_sales) over w8) / (stddev_samp(weekly_sales) over w8 + 1e-5) as rolling_zscore,
         count(*) over ws as n_obs,
         row_number() over wo as rn,
         case when count(*) over ws >= 104 and lag(weekly_sales, 26) over wo is not null
                   and lead(weekly_sales, 26) over wo is not null
              then cast((cast(lag(weekly_sales, 26) over wo as decimal(22,4))
                         + cast(lead(weekly_sales, 26) over wo as decimal(22,4))) * 0.5
                        + sum(cast(weekly_sales as decimal(22,4))) over w51 as double) / 52e0 end as stk_trend
  from prepared
  window wo as (partition by store, dept order by date),
         ws as (partition by store, dept),
         w8 as (partition by store, dept order by date rows between 7 preceding and current row),
         w51 as (partition by store, dept order by date rows between 25 preceding and 25 following)),
phased as (
  select *, avg(weekly_sales - stk_trend) over wp as pm,
         avg(weekly_sales - stk_trend) over wp / count(*) over wp as pw
  from (select *, (rn - 1) % 52 as phase from flagged) f
  window wp as (partition by store, dept, phase)),
seasoned as (
  select *, case when n_obs >= 104 then pm - sum(pw) over (partition by store, dept) / 52e0 end as stk_season
  from phased),
resid as (select *, weekly_sales - stk_trend - stk_season as stk_resid from seasoned),
decomposed as (
  select *, coalesce(cast(abs((stk_resid - avg(stk_resid) over ws)
                              / stddev_samp(stk_resid) over ws) > 25e-1 as integer), 0) as stk_anomaly
  from resid window ws as (partition by store, dept)),
medians as (select week_of_year, median(weekly_sales) as seasonal_median from prepared group by week_of_year),
cleaned as (
  select d.* exclude (n_obs, rn, phase, pm, pw),
         cast(d.stk_anomaly = 1 and d.rolling_anomaly = 1 as integer) as final_anomaly,
         case when d.stk_anomaly = 1 and d.rolling_anomaly = 1 then m.seasonal_median
              else d.weekly_sales end as weekly_sales_cleaned
  from decomposed d left join medians m on m.week_of_year = d.week_of_year)"""


def with_cleaned(*extra: str, dept: str = "p_type") -> str:
    return with_views(CLEANED_CTE, *extra, dept=dept, prepared=True)
