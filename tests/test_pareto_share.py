from pyspark.sql import functions as F

from tillroll.operators import pareto as PA
from tillroll.operators import share as SH


def _items(spark, values, brand="B"):
    return spark.createDataFrame([(brand, i, float(v), 1.0) for i, v in enumerate(values)],
                                 "brand string, item_no long, billing double, sales_quantity double")


def test_item_pareto_tie_at_threshold(spark):
    # 11 items, total 100; cumulative share crosses 95 % at the 10th item
    vals = [30, 20, 15, 10, 8, 6, 4, 2, 2, 2, 1]
    m = {r.item_no: r.lumped for r in PA.item_pareto_mapping(_items(spark, vals), 0.05, 10).collect()}
    # cum: 30,50,65,75,83,89,93,95,97,99,100 -> > 95 from the 9th item on (ties by item number)
    assert [m[i] for i in range(11)] == [False] * 8 + [True] * 3


def test_item_pareto_needs_more_than_min_levels(spark):
    m = PA.item_pareto_mapping(_items(spark, [10] * 10), 0.05, 10).collect()
    assert not any(r.lumped for r in m)


def test_dominant_item_lumps_itself(spark):
    # one level holding over 90 % crosses the feature threshold by itself
    df = spark.createDataFrame([("x", 91.0, 1.0)] + [(f"l{i}", 0.9, 1.0) for i in range(10)],
                               "material string, billing double, sales_quantity double")
    m = {r.level: r.lumped for r in PA.feature_pareto_mapping(df, ["material"], 0.10, 10).collect()}
    assert m["x"] is True
    out = PA.apply_feature_pareto(df, PA.feature_pareto_mapping(df, ["material"], 0.10, 10), ["material"])
    assert out.where("material = 'Other'").count() == 11


def test_kept_levels_total_at_most_threshold(spark):
    vals = [5, 9, 1, 13, 2, 8, 7, 3, 3, 4, 6, 11, 12]
    df = _items(spark, vals)
    m = PA.item_pareto_mapping(df, 0.05, 10).collect()
    kept = sum(r.metric_sum for r in m if not r.lumped)
    assert kept <= 0.95 * sum(vals)


def test_log_share_cases(spark):
    demand = spark.createDataFrame(
        [("ST1", 1, "A", 0.0), ("ST1", 1, "B", 50.0), ("ST1", 1, "C", 60.0), ("ST1", 1, "D", 10.0)],
        "state string, period int, store_type string, sales_quantity double")
    sizes = spark.createDataFrame([("ST1", 1, 50.0)], "state string, period int, per_store_market double")
    out = {r.store_type: r.log_share for r in SH.log_share(demand, sizes, "B").collect()}
    import math
    assert math.isclose(out["A"], math.log(1e-5))   # zero sales -> 1e-5
    assert "B" not in out                               # sales equal to market: so = 0, dropped
    assert "C" not in out                               # above market: negative ratio, no finite log share, dropped (PF20)
    assert math.isclose(out["D"], math.log(10 / 40))


def test_cumulative_sums_against_sorting(spark):
    import random
    from decimal import Decimal
    rng = random.Random(3)
    rows = [("A", i, float(rng.choice([0, 1, 2, 5, 5, 9, 13]) + round(rng.random(), 4))) for i in range(300)]
    rows += [(None, i, float(rng.randint(0, 4))) for i in range(120)]  # many ties, a null brand
    df = spark.createDataFrame([(b, i, v, 1.0) for b, i, v in rows],
                               "brand string, item_no long, billing double, sales_quantity double")
    got = {(r.brand, r.item_no): r for r in PA.item_pareto_mapping(df, 0.05, 10).collect()}
    assert len(got) == len(rows)
    for brand in ("A", None):
        own = sorted((-Decimal(str(v)), i) for b, i, v in rows if b == brand)
        total, so_far = -sum(v for v, _ in own), Decimal(0)
        for v, i in own:
            so_far -= v
            assert abs(got[brand, i].cum_share - float(so_far / total)) < 1e-9
            assert got[brand, i].lumped == (so_far > total * Decimal("0.95")) and got[brand, i].levels == len(own)
