"""DuckDB oracle SQL for Pareto lumping, the demand frame and the log-share target."""

from __future__ import annotations

from ..operators.pareto import ITEM_COLS
from ..operators.share import FIRST_COLS, MEAN_COLS
from .sql_periodic import rollup_cte
from .sql_weekly import mean

ROLL_KEYS = ["period", "item_no", "state", "store_type"]


def _d(c: str) -> str:
    return f"coalesce(cast({c} as decimal(38,8)), cast(0 as decimal(38,8)))"


def pareto_ctes(n_weeks: int, share: float, min_levels: int) -> str:
    keep = 1 - share
    modes = ", ".join(
        f"(SELECT {c} FROM rk WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS m_{c}"
        for c in ITEM_COLS)
    repl = ", ".join(f"CASE WHEN coalesce(m.lumped, false) THEN md.m_{c} ELSE r.{c} END AS {c}" for c in ITEM_COLS)
    return rollup_cte(n_weeks, ROLL_KEYS, "sku") + f""",
never AS (SELECT item_no FROM rolled GROUP BY item_no HAVING sum(sales_quantity) = 0),
rk AS (SELECT * FROM rolled WHERE item_no NOT IN (SELECT item_no FROM never)),
per AS (SELECT brand, item_no, sum({_d('billing')}) AS metric_sum FROM rk GROUP BY brand, item_no),
pm AS (SELECT brand, item_no, metric_sum,
              sum(metric_sum) OVER (PARTITION BY brand ORDER BY metric_sum DESC, item_no ASC
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_sum,
              sum(metric_sum) OVER (PARTITION BY brand) AS total,
              count(*) OVER (PARTITION BY brand) AS levels FROM per),
mapping AS (SELECT brand, item_no, cast(metric_sum as double) AS metric_sum,
                   cast(cum_sum as double) / nullif(cast(total as double), 0) AS cum_share, levels,
                   (cum_sum > total * {keep} AND levels > {min_levels}) AS lumped FROM pm),
md AS (SELECT {modes}),
lumped AS (
  SELECT r.* REPLACE (
           CASE WHEN coalesce(m.lumped, false) THEN 'Others' ELSE cast(r.item_no as varchar) END AS item_no,
           CASE WHEN coalesce(m.lumped, false) THEN 'Others' ELSE r.brand END AS brand, {repl}),
         r.brand AS _orig_brand, coalesce(m.lumped, false) AS _lumped
  FROM rk r LEFT JOIN mapping m ON r.brand = m.brand AND r.item_no = m.item_no, md),
demand0 AS (
  SELECT store_type, item_no, period, state, {", ".join(f"min({c}) AS {c}" for c in FIRST_COLS)},
         {", ".join(f"{mean(c)} AS {c}" for c in MEAN_COLS)}
  FROM lumped GROUP BY store_type, item_no, period, state),
demand AS (SELECT * REPLACE (stock_prevailing_mrp / 10000.0 AS stock_prevailing_mrp, billing / 10000.0 AS billing)
           FROM demand0),
ms AS (SELECT state, period, cast(sum(cast(sales_quantity as decimal(38,8))) as double) AS sales_quantity,
              count(DISTINCT store_type) AS store_numbers FROM demand GROUP BY state, period),
sizes AS (SELECT ms.state, ms.period, ms.sales_quantity, m.market_share,
                 ms.sales_quantity / m.market_share AS market_size, ms.store_numbers,
                 ms.sales_quantity / m.market_share / cast(ms.store_numbers as double) AS per_store_market
          FROM ms LEFT JOIN market_share m ON ms.state = m.state),
joined AS (SELECT d.*, s.per_store_market, s.per_store_market - d.sales_quantity AS so
           FROM demand d JOIN sizes s ON d.state = s.state AND d.period = s.period
           WHERE s.per_store_market - d.sales_quantity IS NOT NULL AND s.per_store_market - d.sales_quantity <> 0),
target_b AS (SELECT * EXCLUDE (so), ln(r) AS log_share FROM
             (SELECT *, CASE WHEN sales_quantity / so = 0 THEN 1e-5 ELSE sales_quantity / so END AS r FROM joined)
             WHERE r > 0 AND isfinite(r)),
target_a AS (SELECT * EXCLUDE (so), ln(r) AS log_share FROM
             (SELECT *, (CASE WHEN sales_quantity = 0 THEN 1e-5 ELSE sales_quantity END) / so AS r FROM joined)
             WHERE r > 0 AND isfinite(r))"""


def feature_ctes(n_weeks, share, min_levels, f_share, f_min) -> str:
    unp = " UNION ALL ".join(f"SELECT '{c}' AS feature, cast({c} as varchar) AS level, {_d('billing')} AS m, "
                             f"{_d('sales_quantity')} AS q FROM tb" for c in ITEM_COLS)
    keep = 1 - f_share
    return pareto_ctes(n_weeks, share, min_levels) + f""",
tb AS (SELECT * EXCLUDE (r) FROM target_b),
fs AS ({unp}),
fper AS (SELECT feature, level, sum(m) AS metric_sum FROM fs GROUP BY feature, level),
fpm AS (SELECT feature, level, metric_sum,
               sum(metric_sum) OVER (PARTITION BY feature ORDER BY metric_sum DESC, level ASC NULLS LAST
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_sum,
               sum(metric_sum) OVER (PARTITION BY feature) AS total,
               count(*) OVER (PARTITION BY feature) AS levels FROM fper),
fmap AS (SELECT feature, level, cast(metric_sum as double) AS metric_sum,
                cast(cum_sum as double) / nullif(cast(total as double), 0) AS cum_share, levels,
                (cum_sum > total * {keep} AND levels > {f_min} AND level IS NOT NULL) AS lumped FROM fpm)"""


def item_pareto_report_sql(n, share, ml) -> str:
    return pareto_ctes(n, share, ml) + f""",
orig AS (SELECT brand, count(*) AS orig_sku_count,
                count(*) FILTER (WHERE NOT lumped) + max(cast(lumped as int)) AS new_sku_count
         FROM mapping GROUP BY brand),
rw AS (SELECT _orig_brand AS brand, sum(CASE WHEN _lumped THEN {_d('billing')} END) AS ob, sum({_d('billing')}) AS tb,
              sum(CASE WHEN _lumped THEN {_d('sales_quantity')} END) AS oq, sum({_d('sales_quantity')}) AS tq
       FROM lumped GROUP BY _orig_brand)
SELECT o.brand, orig_sku_count, new_sku_count,
       coalesce(cast(ob as double) * 100 / nullif(cast(tb as double), 0), 0.0) AS other_billing_pct,
       coalesce(cast(oq as double) * 100 / nullif(cast(tq as double), 0), 0.0) AS other_sales_qty_pct
FROM orig o JOIN rw ON o.brand = rw.brand"""


def feature_report_sql(n, share, ml, fs, fm) -> str:
    return feature_ctes(n, share, ml, fs, fm) + """,
fj AS (SELECT fs.*, coalesce(fmap.lumped, false) AS hit FROM fs LEFT JOIN fmap
       ON fs.feature = fmap.feature AND fs.level = fmap.level),
fg AS (SELECT feature, sum(CASE WHEN hit THEN m END) AS ob, sum(m) AS tb, sum(CASE WHEN hit THEN q END) AS oq,
              sum(q) AS tq FROM fj GROUP BY feature),
flv AS (SELECT feature, count(*) AS orig_levels,
               count(*) FILTER (WHERE NOT lumped) + max(cast(lumped as int)) AS new_levels FROM fmap GROUP BY feature)
SELECT upper(flv.feature) AS feature, orig_levels, new_levels,
       coalesce(cast(ob as double) * 100 / nullif(cast(tb as double), 0), 0.0) AS other_billing_pct,
       coalesce(cast(oq as double) * 100 / nullif(cast(tq as double), 0), 0.0) AS other_sales_qty_pct
FROM flv JOIN fg ON flv.feature = fg.feature"""
