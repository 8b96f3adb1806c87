"""Joins of a large side whose keys may be hot with a side that has few rows a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key in one task, about.
HOT_ROWS = 1_000_000


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """left joined with right on the keys (inner, left, left_semi or left_anti); a hot key of the left is dealt over several tasks.

    Keys are counted before they shuffle. Those with more than hot_rows rows, at most one for each
    hot_rows rows of the left and so few enough to broadcast, get as many salts as they need: the
    left's rows take one by their contents, the right's rows come once for each.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    hot = F.broadcast(counts.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    contents = [F.col(f"`{f.name}`") for f in left.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]  # these have no hash
    dealt = left.join(hot, list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(*contents), salts).cast("int")).drop("_salts")
    copies = right.join(hot, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
