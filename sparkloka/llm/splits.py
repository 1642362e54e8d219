"""Splits that keep related records together: components by random-mate contraction, split by cumulative weight.

Records naming the same account or page are related. Every key (account or page) is contracted to the smallest
row id that names it, so the graph to solve has row ids as vertices and only records naming several keys as edges.
Each round every vertex draws a coin; a tails vertex with a heads neighbour collapses into the smallest such
neighbour, edges are rewritten and deduplicated, until none is left. Labels are then unwound, last round first. A round is
a few joins; once no more than REST edges are left, their rounds are run within one task, by the same contraction.

Defined results: a record without account and page is a group of its own; null or repeated row ids are kept in the
splits (a repeated row id is one record); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloka.runtime import join_hot, release, stage, table

# Authors that name nobody.
NOBODY = ["", "unknown", "[deleted]", "-", "anonim"]
# The platform of a host, and the platforms whose paths begin with the account.
HOSTS = {"vidka.example": "tiktok", "kicau.example": "x", "fotogrid.example": "instagram", "petarasa.example": "gmaps"}
BY_PATH = ["tiktok", "x"]
TABLES = ["social_bootstrap", "signal_train", "signal_val", "signal_test", "airgap_corpus"]
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Cells of the two-step running sum over components.
CELLS = 4096
#: Counted rows up to which a round's merges (two bigints a row) are broadcast and its edges kept in one file.
SMALL = 200_000

#: Edges up to which the remaining rounds are run in one task.
REST = 20_000

_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _bare(c: Column) -> Column:
    """An address without outer space, scheme, www./m., query, fragment and closing slash."""
    c = F.regexp_replace(F.regexp_replace(c, _SPACE, ""), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?i)^(?:https?:)?(?://)?(?:(?:www|m)\.)*", ""), r"/+$", "")


def _platform(host: Column, other: Column, hosts: Mapping[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in hosts.items() for x in kv])
    return F.coalesce(F.try_element_at(known, host), F.when(F.trim(other) != "", F.lower(F.trim(other))))


def record_keys(df: DataFrame, hosts: Mapping[str, str] = HOSTS) -> DataFrame:
    """(row_id, keys): the accounts and the page that each record names, in one spelling."""
    df = df.select("row_id", "platform", "author", "url", _bare(F.col("url")).alias("u"), _bare(F.col("author")).alias("a"))
    df = df.select("row_id", "platform", "a", "u", F.lower(F.regexp_extract("u", r"^([^/]+\.[^/]+)/.+", 1)).alias("host"), F.lower(F.regexp_extract("a", r"^([^/@]+\.[^/]+)/[^/]+$", 1)).alias("a_host"))
    named = F.lower(F.regexp_replace(F.regexp_replace("a", r"^.*/", ""), r"^@+", ""))
    on = _platform(F.col("a_host"), F.col("platform"), hosts)
    by_author = F.when(~named.isin(NOBODY) & ~F.lower(F.col("a")).isin(NOBODY), F.concat_ws("\u0001", F.lit("account"), F.coalesce(on, F.lit("")), named))
    site = _platform(F.col("host"), F.col("platform"), hosts)
    first = F.lower(F.regexp_replace(F.regexp_extract("u", r"^[^/]+/([^/]+)", 1), r"^@+", ""))
    by_path = F.when(site.isin(BY_PATH) & (F.col("host") != "") & ~first.isin([*NOBODY, "p", "place", "i", "search", "hashtag"]), F.concat_ws("\u0001", F.lit("account"), site, first))
    path = F.regexp_replace("u", r"^[^/]+", "")
    path = F.when(site.isin(BY_PATH), F.lower(path)).otherwise(F.regexp_replace(path, r"/{2,}", "/"))
    page = F.when((F.col("host") != "") & ~F.coalesce(site.isin(BY_PATH) & path.rlike(r"^/[^/]+$"), F.lit(False)), F.concat_ws("\u0001", F.lit("page"), F.col("host"), path))
    return df.select("row_id", F.array_distinct(F.array_compact(F.array(by_author, by_path, page))).alias("keys"))


def _coin(v: str, round_no: int) -> Column:
    return F.pmod(F.xxhash64(F.col(v), F.lit(round_no), F.lit("mate")), F.lit(2)) == 1


def _meet(rows: DataFrame, lookup: DataFrame, on: str, n_lookup: int, total: int) -> DataFrame:
    """Left join with unique keys: by broadcast up to SMALL counted rows, else by shuffle with the hot keys split off."""
    if n_lookup <= SMALL:
        return rows.join(F.broadcast(lookup.drop("n")), on, "left")
    return join_hot(rows, lookup, [on], "n", total, "left").drop("n")


def _mated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(child, parent) of the vertices of a few edges (u, v) that end up under another: random-mate rounds in memory."""
    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not ends:
        return
    vertices, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label, k = np.arange(len(vertices)), 0
    while len(a):
        heads = np.random.default_rng(k).random(len(vertices)) < 0.5
        one, two = ~heads[a] & heads[b], ~heads[b] & heads[a]
        parent = np.full(len(vertices), len(vertices))
        np.minimum.at(parent, np.concatenate([a[one], b[two]]), np.concatenate([b[one], a[two]]))
        parent = np.where(parent < len(vertices), parent, np.arange(len(vertices)))
        label, a, b = parent[label], parent[a], parent[b]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        a, b = pairs
        k += 1
    moved = label != np.arange(len(vertices))
    yield pa.RecordBatch.from_arrays([pa.array(vertices[moved]), pa.array(vertices[label[moved]])], ["child", "parent"])


def contract(edges: DataFrame) -> DataFrame:
    """Random-mate contraction of undirected ``edges`` (u, v: bigint). Returns (vertex, top): for every vertex that
    has an edge the smallest vertex of its component."""
    spark = edges.sparkSession
    edges = stage(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "mate-edges")
    merges: list[tuple[DataFrame, int]] = []
    while (m := edges.count()) > 0:
        k = len(merges)
        if m <= REST:
            mates = stage(edges.coalesce(1).mapInArrow(_mated, "child bigint, parent bigint"), "mate-rest")
            merges.append((mates, mates.count()))
            release(edges)
            break
        pack = (lambda d: d.coalesce(1)) if m <= SMALL else (lambda d: d)
        ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        mates = ends.filter(~_coin("u", k)).groupBy(F.col("u").alias("child")).agg(F.min(F.when(_coin("v", k), F.col("v"))).alias("parent"), F.count(F.lit(1)).alias("n")).filter("parent IS NOT NULL")
        mates = stage(pack(mates), f"mate-{k}")
        merges.append((mates, mates.count()))
        moved = edges
        for end in ("u", "v"):
            moved = _meet(moved, mates.withColumnRenamed("child", end), end, merges[-1][1], m).withColumn(end, F.coalesce("parent", end)).drop("parent")
        left = stage(pack(moved.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()), f"mate-edges-{k}")
        release(edges)
        edges = left
    if not merges:
        return spark.createDataFrame([], "vertex bigint, top bigint")
    # unwinding: the last rounds, as far as they hold SMALL rows together, in one plan; earlier ones each by its own
    first, held = len(merges) - 1, merges[-1][1]
    while first > 0 and held + merges[first - 1][1] <= SMALL:
        first -= 1
        held += merges[first][1]
    labels = merges[first][0].select(F.col("child").alias("vertex"), F.col("parent").alias("root"))
    for mates, _ in merges[first + 1 :]:
        up = F.broadcast(mates.select(F.col("child").alias("root"), "parent")) if held <= SMALL else mates.select(F.col("child").alias("root"), "parent")
        labels = labels.join(up, "root", "left").select("vertex", F.coalesce("parent", "root").alias("root")).unionByName(mates.select(F.col("child").alias("vertex"), F.col("parent").alias("root")))
    n_labels = held
    labels = stage(labels, "mate-labels")
    for mates, n in reversed(merges[:first]):
        here = mates.select(F.col("child").alias("vertex"), F.col("parent").alias("up"))
        hooks = here.groupBy("up").agg(F.count(F.lit(1)).alias("n")).join(labels.select(F.col("vertex").alias("up"), "root"), "up")
        done = stage(labels.unionByName(join_hot(here, hooks, ["up"], "n", n, "left").select("vertex", F.coalesce("root", "up").alias("root"))), "mate-labels")
        release(labels)
        labels, n_labels = done, n_labels + n
    tops = labels.groupBy("root").agg(F.least(F.min("vertex"), F.col("root")).alias("top"), F.count(F.lit(1)).alias("n"))
    return join_hot(labels, tops, ["root"], "n", n_labels, "left").select("vertex", "top").unionByName(tops.select(F.col("root").alias("vertex"), "top"))


def groups(records: DataFrame, hosts: Mapping[str, str] = HOSTS) -> DataFrame:
    """(row_id, group_id, size): the group of every record; group_id is its smallest row id."""
    keyed = stage(record_keys(records.filter("row_id IS NOT NULL"), hosts), "split-keys")
    pairs = keyed.select("row_id", F.explode("keys").alias("key"))
    reps = stage(pairs.groupBy("key").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("n")), "split-reps")
    total = reps.agg(F.sum("n")).first()[0] or 0
    met = join_hot(pairs, reps.filter("n > 1"), ["key"], "n", total, "inner").select("row_id", "rep")
    # what a record names alone contracts to the record itself; so only keys of several records are looked up
    near = stage(met.groupBy("row_id").agg(F.sort_array(F.collect_set("rep")).alias("reps")), "split-near")
    graph = near.select(F.explode(F.concat(F.array("row_id"), "reps")).alias("v"), F.col("reps")[0].alias("u")).select("u", "v")
    # u is the smallest key's representative; a record that represents nothing is a leaf and needs no edge
    inner = graph.join(near.select(F.explode("reps").alias("v")).distinct(), "v", "left_semi")
    comp = stage(contract(inner), "split-components")
    per = near.groupBy(F.col("reps")[0].alias("m")).agg(F.count(F.lit(1)).alias("n"))
    top = per.join(comp.select(F.col("vertex").alias("m"), F.col("top")), "m", "left").withColumn("group_id", F.coalesce("top", "m")).drop("top")
    sizes = top.groupBy("group_id").agg(F.sum("n").alias("size"))
    top = stage(top.join(sizes, "group_id"), "split-tops")
    rows = near.select("row_id", F.col("reps")[0].alias("m"))
    joined = join_hot(rows, top.select("m", "group_id", "size", "n"), ["m"], "n", rows.count(), "inner").select("row_id", "group_id", "size")
    alone = keyed.select("row_id").distinct().join(near.select("row_id"), "row_id", "left_anti").select("row_id", F.col("row_id").alias("group_id"), F.lit(1).cast("long").alias("size"))
    return joined.unionByName(alone)


def assign(grouped: DataFrame, proportions: Mapping[str, float] = PROPORTIONS) -> DataFrame:
    """(row_id, group_id, split): groups lie on a line by size class and hash, as long as they are large; a group goes
    where its middle falls. Groups above a hundredth of all records come first, so they go to the first split."""
    names, shares = list(proportions), list(proportions.values())
    comps = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("w"))
    total = comps.agg(F.sum("w")).first()[0] or 0
    big = F.col("w") * 100 > total
    h = F.xxhash64(F.col("group_id"), F.lit("split"))
    comps = comps.withColumns({"cell": F.when(big, F.lit(-1)).otherwise(F.pmod(h, F.lit(CELLS))).cast("int"), "h": h})
    cells = comps.groupBy("cell").agg(F.sum("w").alias("cw"))  # at most CELLS + 1 rows
    before = cells.withColumn("start", F.sum("cw").over(Window.orderBy("cell")) - F.col("cw")).select("cell", "start")
    inside = F.sum("w").over(Window.partitionBy("cell").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = comps.join(F.broadcast(before), "cell").withColumn("mid", (F.col("start") + F.coalesce(inside, F.lit(0)) + F.col("w") / 2) / F.lit(max(total, 1)))
    split, edge = F.lit(names[-1]), sum(shares)
    for name, share in reversed(list(zip(names[:-1], shares[:-1]))):
        edge = sum(shares[: names.index(name) + 1])
        split = F.when(F.col("mid") < edge / sum(shares), F.lit(name)).otherwise(split)
    chosen = stage(placed.select("group_id", split.alias("split"), F.col("w").alias("n")), "split-chosen")
    return join_hot(grouped, chosen, ["group_id"], "n", total, "inner").select("row_id", "group_id", "split")


def all_records(spark, sf_dir: str) -> DataFrame:
    """The records of all tables that share accounts and pages."""
    out = None
    for name in TABLES:
        t = table(spark, sf_dir, name)
        t = t.select("row_id", "platform", (F.col("author") if "author" in t.columns else F.lit(None).cast("string")).alias("author"), "url")
        out = t if out is None else out.unionByName(t)
    return out


def found(records: DataFrame) -> DataFrame:
    """Records in groups of two or more."""
    return groups(records).filter("size > 1").select("row_id", "group_id")
