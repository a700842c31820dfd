import datetime as dt

from pyspark.sql import functions as F

from tillroll.operators import quality as Q
from tillroll.operators.fuzzy import fuzzy_level_matches


def test_returns_matching_cases(spark):
    w0 = dt.date(2019, 5, 6)
    wk = lambda n: w0 + dt.timedelta(days=7 * n)
    weekly = spark.createDataFrame(
        [("1_S1", 1, "S1", wk(0), 1), ("1_S1", 1, "S1", wk(1), -1),     # matched
         ("2_S1", 2, "S1", wk(1), -1),                                   # no previous sale
         ("3_S1", 3, "S1", wk(0), 2), ("3_S1", 3, "S1", wk(2), -1)],     # two-week gap
        "col_pk string, item_no long, location_code string, week_start date, sales_qty_in_week long")
    out = Q.match_returns(weekly).collect()
    assert [(r.col_pk, r.returned_quantity, r.sold_quantity_prev_week) for r in out] == [("1_S1", -1, 1)]


def test_gender_rule_and_blanks(spark):
    df = spark.createDataFrame([(40.0, "Women"), (30.0, ""), (30.0, None), (30.0, "Men")],
                               "case_size double, gender string")
    got = [r.gender for r in Q.gender_rule(df).collect()]
    assert got == ["Men", "Women", "Women", "Men"]
    b = Q.blank_to_null(spark.createDataFrame([("", 1), ("x", 2)], "a string, n int"), ["a"])
    assert [r.a for r in b.orderBy("n").collect()] == [None, "x"]


def test_null_audit_counts(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (None, None)], "x int, y string")
    got = {r.column_name: r.null_count for r in Q.null_audit(df).collect()}
    assert got == {"x": 2, "y": 2}


def _brute(levels, threshold, top):
    import difflib  # noqa: F401  (only the edit distance below is used)

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            cur = [i]
            for j, cb in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
            prev = cur
        return prev[-1]
    out = set()
    for a in levels:
        cands = []
        for b in levels:
            if a != b:
                s = 1.0 - lev(a, b) / max(len(a), len(b))
                if s >= threshold:
                    cands.append((-s, b))
        for rank, (s, b) in enumerate(sorted(cands)[:top], 1):
            out.add((a, b, rank))
    return out


def test_fuzzy_prefix_join_equals_brute_force(spark):
    levels = ["stainless steel", "stainles steel", "stainless-steel", "steel", "gold", "golden", "gold plated",
              "rose gold", "rosegold", "titanium", "titanum", "ceramic", "ceramics", "black", "blak", "blue",
              "brown", "leather", "lether", "rubber", "rubbr", "silver", "silvr", "a", "ab"]
    df = spark.createDataFrame([(x,) for x in levels], "material string")
    got = {(r.level, r.match, r.match_rank) for r in fuzzy_level_matches(df, ["material"], 0.6, 3).collect()}
    assert got == _brute(levels, 0.6, 3)
