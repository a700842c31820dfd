"""Dictionary codes for text attributes that roll-ups carry along (AG1-AG8, J1-J6).

A minimum or maximum over text makes Spark sort the rows of every aggregation, for text does not fit a hash
aggregation's fixed-width buffers. Carried attributes (brand, department, region, ...) have few levels, so they
are replaced by their place in the sorted list of their levels, an int with the same order, and put back once
after the roll-ups. The lists come from one scan of the attributes; one with more than ``MOST`` levels stays text.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

MOST = 1024
#: Names of one attribute.
SAME = [("state_code", "state"), ("store_in", "location_code")]


class Codes:
    """Sorted levels by attribute."""

    def __init__(self, levels: dict[str, list[str]], never_null: tuple[str, ...] = ()):
        self.never_null = never_null
        self.levels = {c: x for c, x in levels.items() if len(x) <= MOST}

    @classmethod
    def of(cls, frames: list[DataFrame], cols: list[str]) -> Codes:
        """The levels of ``cols`` in all of ``frames`` (a frame may hold some of them only): one aggregation."""
        parts = [f.select(*[c for c in cols if c in f.columns]) for f in frames]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        cols = rows.columns
        # of a longer list no more than shows that it is too long is returned
        sets = rows.agg(*[F.slice(F.array_sort(F.collect_set(c)), 1, MOST + 1).alias(c) for c in cols]).head()
        levels = {c: list(sets[c]) for c in cols}
        for a, b in SAME:
            if a in levels or b in levels:
                levels[a] = levels[b] = sorted({*levels.get(a, []), *levels.get(b, [])}, key=lambda x: x.encode())
        return cls(levels)

    def fill(self, df: DataFrame) -> DataFrame:
        """``df.na.fill(0)`` that leaves codes alone, and numbers that are never null (their rows keep their partitions)."""
        numbers = [f.name for f in df.schema.fields
                   if isinstance(f.dataType, NumericType) and f.name not in self.levels and f.name not in self.never_null]
        return df.na.fill(0, numbers)

    def encode(self, df: DataFrame) -> DataFrame:
        own = {c: x for c, x in self.levels.items() if c in df.columns}
        return df.withColumns({c: F.when(F.col(c).isNotNull(), F.array_position(F.lit(x), F.col(c)).cast("int"))
                               if x else F.lit(None).cast("int") for c, x in own.items()})

    def decode(self, df: DataFrame) -> DataFrame:
        own = {c: x for c, x in self.levels.items() if c in df.columns}
        return df.withColumns({c: F.when(F.col(c).isNotNull(), F.element_at(F.lit(x), F.col(c)))
                               if x else F.lit(None).cast("string") for c, x in own.items()})


#: The text attributes of the four facts that the roll-ups carry.
FACT_ATTRS = ["brand", "department", "state", "region", "sales_department", "state_code", "product_group_code"]


class CodedFacts:
    """The four raw facts of ``t`` with their carried attributes as codes and money as doubles.

    ``codes`` says which attributes are codes, and which; without it the levels of FACT_ATTRS are read from the facts.
    """

    def __init__(self, t, codes: Codes | None = None):
        t = replace(t, exact=False)
        raw = {k: getattr(t, k) for k in ("closing_stock_raw", "purchase_raw", "transfer_raw", "sales_raw")}
        self.codes = Codes.of(list(raw.values()), FACT_ATTRS) if codes is None else codes
        for k, df in raw.items():
            setattr(self, k, self.codes.encode(df))


def rolled(df: DataFrame, f, cols: list[str] | None = None) -> DataFrame:
    """``f(df)`` with the text attributes ``cols`` of ``df`` as codes on the way."""
    codes = Codes.of([df], cols or FACT_ATTRS)
    return codes.decode(f(codes.encode(df)))
