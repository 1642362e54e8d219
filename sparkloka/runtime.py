"""Session defaults, staged tables in the shared folder, size-checked broadcasts and hot-key joins."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least 1/HOT_SHARE of all rows is hot; so at most HOT_SHARE keys can be hot at any data size.
HOT_SHARE = 256
#: Below so many rows a whole table is small enough for one task, and no key needs splitting.
ONE_TASK_ROWS = 1_000_000

_staged: list[tuple[SparkSession, str]] = []


def session(app: str = "sparkloka", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; ``conf`` overrides any setting."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A temporary one is made only where that is unset and
    the master is local, so that all tasks see this machine's disk; on a cluster an unset folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloka-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloka/{uuid.uuid4().hex}-{name}"
    df.write.mode("overwrite").parquet(path)
    _staged.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path  # type: ignore[attr-defined]
    return out


def release(df: DataFrame) -> None:
    """Delete a staged table nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        _staged[:] = [x for x in _staged if x[1] != path]
        _delete(df.sparkSession, path)


def bounded(df: DataFrame, rows: int, size: int = 64 << 20) -> DataFrame:
    """Hint a broadcast of ``df`` only if it is counted to hold at most ``rows`` rows and ``size`` bytes; else leave the
    join to Spark."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    some = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(wide, F.lit(16 * len(df.columns))).cast("long")), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if some["n"] <= rows and some["b"] <= size else df


def join_hot(rows: DataFrame, lookup: DataFrame, on: Sequence[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """Join ``rows`` with a ``lookup`` whose keys are unique and whose column ``weight`` counts the rows of each key.

    Keys with at least ``total / HOT_SHARE`` rows, of which there can be no more than HOT_SHARE, are joined by
    broadcast, so no task receives a hot key's rows; all other keys are joined by shuffle.
    Null keys match nothing and come out with nulls (``left``) or not at all (``inner``).
    """
    if total < ONE_TASK_ROWS:
        return rows.join(lookup, list(on), how)
    least = total // HOT_SHARE
    hot = lookup.filter(F.col(weight) >= least)
    names = [f"__hot_{c}" for c in on]
    head = hot.select(*[F.col(c).alias(n) for c, n in zip(on, names)], F.struct(*[c for c in lookup.columns if c not in on]).alias("__hit"))
    if head.limit(1).count() == 0:
        return rows.join(lookup, list(on), how)
    tagged = rows.join(F.broadcast(head), [rows[c].eqNullSafe(head[n]) for c, n in zip(on, names)], "left")
    extra = [c for c in lookup.columns if c not in on]
    warm = tagged.filter(F.col("__hit").isNotNull()).select(*rows.columns, *[F.col(f"__hit.{c}").alias(c) for c in extra])
    cold = tagged.filter(F.col("__hit").isNull()).select(*rows.columns).join(lookup.filter(F.col(weight) < least), list(on), how)
    return warm.unionByName(cold.select(*rows.columns, *extra))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
