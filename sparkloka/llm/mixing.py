"""A mix of sources with target shares of all tokens, by hash-threshold histograms.

Tokens are summed by source and hash bucket; in the nested order of the hash the bucket is found in which a source's
budget runs out; only that bucket is cut finer, until it holds one document; documents under the threshold are taken.
Nothing is sorted, and a smaller budget always takes a subset of a larger one's documents.

A source is used whole as often as its budget holds it, and its documents below the threshold once more, never more
than max_repeats times. Without a given size the mix is as large as it can be with every share met: the smallest of
(tokens * max_repeats / share). Shares of sources without tokens can't be met; the rest keep their proportions.

Defined results: documents of null or blank source or of one without a target stay out; null and empty texts have no
tokens and follow the threshold; targets repeated under one name add up their shares (and take the least max_repeats);
null or negative shares and repeats count as 0; no targets or no documents give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloka.llm.tokens import encode
from sparkloka.runtime import stage

#: Bits of the hash that each refinement looks at; buckets of a source's histogram.
BITS = 12
#: Sources a target table may have; it is read to the driver.
MAX_TARGETS = 10_000


def source_name(c: Column) -> Column:
    t = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(t != "", t)


def _bucket(level: int) -> Column:
    return F.shiftrightunsigned("h", 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def sized(docs: DataFrame, targets: DataFrame, path: str | None = None) -> tuple[DataFrame, dict[str, tuple[float, int]]]:
    """(doc_id, source, n_tokens, h) of the documents that may be used, staged; and the targets."""
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("repeats")).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    wanted = {r["source"]: (float(r["share"]), int(r["repeats"])) for r in rows}
    some = docs.select("doc_id", source_name(F.col("source")).alias("source"), "text").filter(F.col("source").isin(list(wanted)))
    counted = encode(some, ["doc_id", "source"], "text", path, count_only=True)
    return stage(counted.withColumn("h", F.xxhash64("doc_id", F.lit("mix"))), "mix-sizes"), wanted


def thresholds(docs: DataFrame, budgets: dict[str, float]) -> dict[str, tuple[int, int]]:
    """For each source the hash prefix below which its documents add up to its budget: (bits, prefix), prefix excluded.

    Each round sums a histogram of at most 2^BITS buckets for each source still open, adds it up in the cluster, and
    brings home the one bucket of each source in which its budget runs out."""
    spark = docs.sparkSession
    level, done = 0, {}
    open_ = {s: (0, 0.0) for s, b in budgets.items() if b > 0}  # prefix, tokens before it
    upto = Window.partitionBy("source").orderBy("b")
    while open_ and BITS * (level + 1) <= 60:
        at = spark.createDataFrame([(s, p, x, float(budgets[s])) for s, (p, x) in open_.items()], "source string, prefix bigint, spent double, budget double")
        inside = F.lit(True) if level == 0 else F.shiftrightunsigned("h", 64 - BITS * level) == F.col("prefix")
        hist = docs.join(F.broadcast(at), "source").filter(inside).groupBy("source", "spent", "budget", _bucket(level).alias("b")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        sums = hist.withColumn("after", F.col("spent") + F.sum("t").over(upto)).withColumn("before", F.col("after") - F.col("t"))
        edge = {r["source"]: r for r in sums.filter("before <= budget AND after > budget").select("source", "b", "t", "n", "before").collect()}  # one a source
        left = {}
        for s, (prefix, _) in open_.items():
            if s not in edge:  # the whole bucket fits
                done[s] = (BITS * (level + 1), (prefix + 1) << BITS)
                continue
            r = edge[s]
            here = (prefix << BITS) | r["b"]
            if r["n"] == 1 or BITS * (level + 2) > 60:  # one document: taken if that comes nearer the budget
                done[s] = (BITS * (level + 1), here + ((budgets[s] - r["before"]) * 2 > r["t"]))
            else:
                left[s] = (here, r["before"])
        open_ = left
        level += 1
    return done


def mix(docs: DataFrame, targets: DataFrame, size: float | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, n_tokens, copies) and the report of its shares by source."""
    spark = docs.sparkSession
    sizes, wanted = sized(docs, targets, path)
    have = {r["source"]: (r["t"] or 0, r["n"]) for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    usable = {s: w for s, (w, r) in wanted.items() if w > 0 and r > 0 and have.get(s, (0, 0))[0] > 0}
    whole = sum(usable.values())
    if size is None:
        size = min((have[s][0] * wanted[s][1] * whole / w for s, w in usable.items()), default=0.0)
    budget = {s: min(size * w / whole, float(have[s][0] * wanted[s][1])) for s, w in usable.items()}
    laps = {s: min(int(b // have[s][0]), wanted[s][1]) for s, b in budget.items()}
    rest = {s: budget[s] - laps[s] * have[s][0] for s in budget}
    cuts = thresholds(sizes, {s: x for s, x in rest.items() if x > 0 and laps[s] < wanted[s][1]})
    plan = [(s, laps[s], *cuts.get(s, (BITS, 0))) for s in budget]  # one row a source that is used
    chosen = sizes.join(F.broadcast(spark.createDataFrame(plan, "source string, laps int, bits int, edge bigint")), "source")
    more = (F.expr("shiftrightunsigned(h, 64 - bits)") < F.col("edge")).cast("int")
    chosen = chosen.select("doc_id", "source", "n_tokens", (F.col("laps") + more).cast("int").alias("copies")).filter("copies > 0")
    sums = {r["source"]: (r["t"], r["n"], r["c"]) for r in chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.count(F.lit(1)).alias("n"), F.max("copies").alias("c")).collect()}
    total = sum(t for t, _, _ in sums.values())
    rows = [
        (s, w, r, have.get(s, (0, 0))[1], int(have.get(s, (0, 0))[0]), sums.get(s, (0, 0, 0))[1], int(sums.get(s, (0, 0, 0))[2]), int(sums.get(s, (0, 0, 0))[0]), sums.get(s, (0, 0, 0))[0] / total if total else 0.0)
        for s, (w, r) in sorted(wanted.items())
    ]
    report = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, n_docs bigint, n_tokens bigint, n_docs_used bigint, most_copies bigint, mix_tokens bigint, actual_share double")
    return chosen, report
