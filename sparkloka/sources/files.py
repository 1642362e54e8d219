"""Readers and writers: CSV and JSON with fixed schemas, tagged sentences, page and place records, relational keys.

Defined results: a missing path reads as an empty table of the schema; CSV cells are strings, empty cells are ''; rows
that don't fit the schema keep nulls; sinks write only the columns they name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True, multi_line: bool = True) -> DataFrame:
    """Quoted CSV, every cell a string; the file's path as ``corpus_source``. Globs are fine.

    With ``multi_line`` cells may hold line breaks and every file is one task; without it files are split."""
    schema = strings(columns)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("corpus_source", F.lit(""))
    df = spark.read.schema(schema).option("header", header).option("multiLine", multi_line).option("quote", '"').option("escape", '"').csv(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns], F.col("_metadata.file_path").alias("corpus_source"))


def typed(df: DataFrame, **types: str) -> DataFrame:
    """Columns cast where they can be; what can't be cast is null."""
    return df.withColumns({c: F.trim(c).try_cast(t) for c, t in types.items()})


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_extended(df: DataFrame, path: str, defaults: Sequence[str]) -> None:
    """The default columns first, then all others by name."""
    write_csv(df, path, [*defaults, *sorted(set(df.columns) - set(defaults))])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, valid: Column | None = None) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return df if valid is None else df.filter(F.coalesce(valid, F.lit(False)))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document holding an array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def write_document(spark: SparkSession, path: str, text: str) -> None:
    """One small document (JSON, HTML) as one file of any file system that the session knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_tagged(spark: SparkSession, path: str, least: int = 2, tag_at: int = -1, sep: str = "\t") -> DataFrame:
    """(file, sent_no, tokens, tags) of blank-line-parted sentences with a token and its tags a line.

    Records are cut at the blank lines by the reader itself, so large files are split; ``sent_no`` numbers a file's
    sentences by their place in it. Lines of fewer than ``least`` fields are left out; ``tag_at`` counts from 1, or from
    the end if negative."""
    lines = spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"), F.posexplode(F.split(F.regexp_replace("value", r"\r", ""), r"\n[ \t]*\n\s*")).alias("__k", "block"))
    fields = F.filter(F.transform(F.split("block", r"\n"), lambda x: F.split(x, sep)), lambda f: (F.size(f) >= least) & (F.trim(f[0]) != "") & (f[0] != "-DOCSTART-"))
    out = lines.select("file", "__b", "__i", "__k", fields.alias("f")).select("file", "__b", "__i", "__k", F.transform("f", lambda f: F.trim(f[0])).alias("tokens"), F.transform("f", lambda f: F.trim(F.try_element_at(f, F.lit(tag_at)))).alias("tags")).filter(F.size("tokens") > 0)
    # sentences before each piece of a file are added up over its few pieces, so no file is numbered by one task
    before = out.groupBy("file", "__b").agg(F.count(F.lit(1)).alias("n")).withColumn("__before", F.sum("n").over(Window.partitionBy("file").orderBy("__b")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("file", "__b").orderBy("__i", "__k")) - 1
    return out.withColumn("__p", place).join(F.broadcast(before), ["file", "__b"]).select("file", (F.col("__before") + F.col("__p")).cast("bigint").alias("sent_no"), "tokens", "tags")


def flatten_elements(df: DataFrame, json: str) -> DataFrame:
    """Place records of a map query's answer: nodes, ways and relations, the point from the node or its centre."""
    schema = "struct<elements:array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>>"
    e = df.select(F.explode(F.from_json(F.col(json), schema)["elements"]).alias("e"))
    return e.select(F.col("e.id").alias("osm_id"), F.col("e.type").alias("osm_type"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.try_element_at("e.tags", F.lit("name")).alias("name"), F.try_element_at("e.tags", F.lit("amenity")).alias("amenity"), F.try_element_at("e.tags", F.lit("brand")).alias("brand")).filter("lat IS NOT NULL AND lon IS NOT NULL")


def administrative_keys(df: DataFrame, html: str) -> DataFrame:
    """(id, parent_id, level, name) of the four levels in an HTML table: keys are concatenated and keep their zeros; of
    a key given twice the last name counts."""
    row = r'<tr[^>]*class="table_content"[^>]*>(.*?)</tr>'
    cells = df.select(F.posexplode(F.regexp_extract_all(html, F.lit("(?s)" + row), F.lit(1))).alias("ord", "row")).select("ord", F.transform(F.regexp_extract_all("row", F.lit("(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))).alias("c"))
    level = [F.struct(F.lit(k + 1).alias("level"), F.concat(*[F.col("c")[2 * i] for i in range(k + 1)]).alias("id"), F.col("c")[2 * k + 1].alias("name"), (F.concat(*[F.col("c")[2 * i] for i in range(k)]) if k else F.lit(None).cast("string")).alias("parent_id")) for k in range(4)]
    out = cells.filter(F.size("c") >= 8).select("ord", F.explode(F.array(*level)).alias("x")).select("ord", "x.*")
    return out.groupBy("level", "id", "parent_id").agg(F.max_by("name", "ord").alias("name")).select("id", "parent_id", "level", "name")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Children whose parent is missing: a foreign key check."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
