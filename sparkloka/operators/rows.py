"""Dedupes, quotas, splits and unions over rows with an explicit order.

Defined results: null keys are dropped where a key decides what a row is, and each operator names its tie order; rows
are never dropped for any other reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloka.runtime import release, stage


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, by aggregation: map-side combined, so a hot key costs no task more."""
    rest = [c for c in df.columns if c not in keys]
    marks = [o for o in order]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*marks)).alias("__r"))
    return picked.select(*keys, "__r.*")


def fold_two_keys(df: DataFrame, order: str, first: str, second: str) -> DataFrame:
    """The rows that remain if rows are read in order and one is dropped when a row that was kept before it has its
    ``first`` or its ``second`` key (null or '' is no key). ``order`` is unique.

    In rounds: a row that comes first under each of its keys is kept, whatever shares a key with a kept row is dropped,
    and the rest is looked at again; the result is that of the one pass in order. A round decides all but the rows that
    wait for an undecided one before them."""
    key = lambda c: F.when(F.col(c) != "", F.col(c))
    left = stage(df.select(order, key(first).alias("__a"), key(second).alias("__b")), "fold")
    kept = None
    while left.limit(1).count():
        tops = left
        for k in ("__a", "__b"):
            tops = tops.join(left.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"__m{k}")), k, "left")
        now = stage(tops.filter((F.col("__a").isNull() | (F.col("__m__a") == F.col(order))) & (F.col("__b").isNull() | (F.col("__m__b") == F.col(order)))).select(order, "__a", "__b"), "fold-kept")
        kept = now if kept is None else kept.unionByName(now)
        rest = left.join(now.select(order), order, "left_anti")
        for k in ("__a", "__b"):
            rest = rest.join(now.select(k).filter(F.col(k).isNotNull()), k, "left_anti")
        done, left = left, stage(rest.select(order, "__a", "__b"), "fold")
        release(done)
    return df.join(kept.select(order), order, "left_semi") if kept is not None else df


def top_per(df: DataFrame, key: str, order: Sequence[Column], most: int | Column) -> DataFrame:
    """The first rows of each group; the planner cuts every partition to the limit before it shuffles."""
    return df.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank_in_group") <= most)


def union_all(frames: Mapping[str, DataFrame], columns: Sequence[str], defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Frames of different columns as one: missing columns get their default, strings are trimmed, null becomes ''."""
    out = None
    for i, (source, df) in enumerate(frames.items()):
        cols = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit((defaults or {}).get(c, "")))).alias(c) if c in df.columns else F.lit((defaults or {}).get(c, "")).alias(c) for c in columns]
        one = df.select("row_id", F.lit(source).alias("corpus_source"), F.lit(i).alias("source_ord"), *cols)
        out = one if out is None else out.unionByName(one)
    return out


def hash_rank_split(df: DataFrame, label: str, id_col: str, shares: tuple[int, int] = (70, 85), least: int = 3) -> DataFrame:
    """Stratified split by rank of the id's SHA-256 within each label; labels of fewer than ``least`` rows go to train.

    The rank is cut by the label's count, so every label is split 70/15/15 as nearly as its count allows. Large labels
    are ranked in cells of the hash: the rank within a cell plus the sizes of the cells before."""
    h = F.sha2(F.col(id_col).cast("string"), 256)
    rows = df.withColumn("__h", h).withColumn("__cell", F.substring("__h", 1, 3))
    cells = rows.groupBy(label, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(label).orderBy("__cell")
    cells = cells.withColumn("__before", F.sum("__n").over(w) - F.col("__n")).withColumn("__total", F.sum("__n").over(Window.partitionBy(label)))
    r = F.row_number().over(Window.partitionBy(label, "__cell").orderBy("__h", id_col)) - 1 + F.col("__before")
    ranked = rows.join(cells.drop("__n"), [label, "__cell"]).withColumn("__r", r)
    at = F.col("__r") * 100
    split = F.when(F.col("__total") < least, "train").when(at < shares[0] * F.col("__total"), "train").when(at < shares[1] * F.col("__total"), "validation").otherwise("test")
    return ranked.withColumn("split", split).drop("__h", "__cell", "__before", "__total", "__r")


def donate(df: DataFrame, label: str, id_col: str, split: str = "split") -> DataFrame:
    """Moves one row of each label that train lacks into train: from validation first, then from test, smallest id."""
    order = F.struct(F.when(F.col(split) == "validation", 0).otherwise(1), F.col(id_col))
    lacking = df.groupBy(label).agg(F.count_if(F.col(split) == "train").alias("__t"), F.min_by(id_col, order).alias("__donor")).filter("__t = 0")
    out = df.join(F.broadcast(lacking.select(F.col(label).alias("__l"), "__donor")), (F.col(label) == F.col("__l")) & (F.col(id_col) == F.col("__donor")), "left")
    return out.withColumn(split, F.when(F.col("__donor").isNotNull(), "train").otherwise(F.col(split))).drop("__l", "__donor")
