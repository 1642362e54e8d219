"""Reports on labels: precision, recall, F1, confusion, weights, entity spans. Zero divisions are 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def class_report(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, support, prec, recall, f1) from (truth, guess): one pass over the pairs, then a table of label pairs."""
    n = pairs.groupBy("truth", "guess").agg(F.count(F.lit(1)).alias("n"))
    ends = n.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("g"), F.col("n").alias("t")), F.struct(F.col("guess").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").cast("int").alias("g"), F.lit(0).cast("long").alias("t")))).alias("x")).select("x.*")
    per = ends.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("g").alias("g"), F.sum("t").alias("t"))
    dim = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    r = F.broadcast(dim).join(per, "label", "left").na.fill(0)
    part = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    r = r.select("label", F.col("t").alias("support"), part("tp", "g").alias("p"), part("tp", "t").alias("r"))
    return r.select("label", "support", F.round("p", 6).alias("prec"), F.round("r", 6).alias("recall"), F.round(F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))), 6).alias("f1"))


def confusion(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    return pairs.groupBy("truth").pivot("guess", list(labels)).count().na.fill(0)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k * n_c) for each label."""
    g = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # one row a label
    return g.withColumn("weight", F.round(F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")), 6))


def spans(tags):
    """array<struct<type, start, stop>> of a BIO tag array: B opens, I goes on with the same type, all else closes."""
    start = F.struct(F.array().cast("array<struct<type:string,start:int,stop:int>>").alias("done"), F.lit("").alias("type"), F.lit(-1).alias("start"), F.lit(0).alias("i"))

    def step(a, t):
        kind = F.substring(t, 3, 100)
        inner = t.startswith("I-") & (a["type"] == kind) & (a["start"] >= 0)
        closed = F.when((a["start"] >= 0) & ~inner, F.concat(a["done"], F.array(F.struct(a["type"].alias("type"), a["start"].alias("start"), a["i"].alias("stop"))))).otherwise(a["done"])
        return F.struct(closed.alias("done"), F.when(inner, a["type"]).when(t.startswith("B-"), kind).otherwise("").alias("type"), F.when(inner, a["start"]).when(t.startswith("B-"), a["i"]).otherwise(-1).alias("start"), (a["i"] + 1).alias("i"))

    return F.aggregate(tags, start, step, lambda a: F.when(a["start"] >= 0, F.concat(a["done"], F.array(F.struct(a["type"].alias("type"), a["start"].alias("start"), a["i"].alias("stop"))))).otherwise(a["done"]))


def span_scores(truth: DataFrame, guess: DataFrame) -> DataFrame:
    """Entity-level precision, recall and F1 by type from (sent_id, type, start, stop) of two taggers."""
    on = ["sent_id", "type", "start", "stop"]
    both = truth.select(*on, F.lit(1).alias("t")).join(guess.select(*on, F.lit(1).alias("g")), on, "full_outer")
    r = both.groupBy("type").agg(F.sum(F.coalesce(F.col("t") * F.col("g"), F.lit(0))).alias("tp"), F.count("t").alias("n_true"), F.count("g").alias("n_guess"))
    part = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    r = r.withColumns({"p": part("tp", "n_guess"), "r": part("tp", "n_true")})
    return r.select("type", "tp", "n_true", "n_guess", F.round(F.when(F.col("p") + F.col("r") == 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))), 6).alias("f1"))
