"""Mixed timestamp formats and zones to UTC instants, through a dictionary of distinct raw values.

Raw strings repeat and parsing them is the dear part, so every distinct (raw, zone) is parsed once, with built-in
expressions only, kept in a table that later runs extend, and joined back to the rows.

Defined results: null, blank and placeholder values, impossible dates, unknown zone names and unlisted forms give a
null instant. Bare numbers under nine digits (such as 0) are placeholders. Rows are kept whatever happens to them;
repeated rows and ids stay repeated; extra columns are ignored.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloka.runtime import bounded, join_hot, stage

# Month names and abbreviations, Indonesian and English.
MONTHS = {
    1: "jan january januari",
    2: "feb february februari peb",
    3: "mar march maret",
    4: "apr april",
    5: "may mei",
    6: "jun june juni",
    7: "jul july juli",
    8: "aug august agu agustus ags agt",
    9: "sep sept september",
    10: "oct october okt oktober",
    11: "nov november nop nopember",
    12: "dec december des desember",
}
# Zone abbreviations with their offset in minutes.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "wib": 420, "wita": 480, "wit": 540, "sgt": 480, "myt": 480, "jst": 540, "kst": 540,
    "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}
# Age units in seconds.
UNITS = {
    1: "s sec secs second seconds detik dtk",
    60: "m min mins minute minutes menit mnt",
    3600: "h hr hrs hour hours jam",
    86400: "d day days hari hr.",
    604800: "w wk wks week weeks minggu mgg pekan",
}

_ZONE = r"((?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|[A-Za-z]{1,5})?"
_CLOCK = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,12}))?)?"
#: Pattern and the groups of year, month, day, hour, minute, second, fraction, half of the day, zone. The first that fits decides.
FORMATS = [
    (rf"(?i)^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:T|[ ,]+){_CLOCK} ?{_ZONE}$", "1 2 3 4 5 6 7 - 8"),
    (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})[T ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,12}}))? ?(?:(?<=\d)(?=$)|(?=[A-Za-z+-])){_ZONE}$", "1 2 3 4 5 6 7 - 8"),
    (rf"(?i)^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})[ ,T]+{_CLOCK} ?([AP])\.?M\.?(?: {_ZONE})?$", "3 1 2 4 5 6 7 8 9"),
    (rf"(?i)^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})[ ,T]+{_CLOCK} ?{_ZONE}$", "3 2 1 4 5 6 7 - 8"),
    (rf"(?i)^(?:[A-Za-z']+,? )?(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?[ -](\d{{4}}),?(?: pukul| jam| at)? {_CLOCK}(?: ?([AP])\.?M\.?)?(?: ?{_ZONE})?$", "3 2 1 4 5 6 7 8 9"),
    (rf"(?i)^(?:[A-Za-z']+, )?([A-Za-z]{{3,9}})\.? (\d{{1,2}}),? (\d{{4}}),?(?: at| pukul)? {_CLOCK}(?: ?([AP])\.?M\.?)?(?: ?{_ZONE})?$", "3 1 2 4 5 6 7 8 9"),
]
_AGE = r"(?i)^(?:sekitar |about )?(\d{1,6}) ?([a-z.]{1,7}?)(?: yang lalu| yg lalu| lalu| ago)$"
#: The one form that needs no dictionary: it is the form everything else is brought to.
CANONICAL = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"


def _lookup(values: dict[int, str] | dict[str, int], key: Column) -> Column:
    pairs: list[Column] = []
    for a, b in values.items():
        for word in [a] if isinstance(a, str) else b.split():
            pairs += [F.lit(word), F.lit(b if isinstance(a, str) else a)]
    return F.try_element_at(F.create_map(*pairs), F.lower(key))


def _tidy(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"[\s\p{Z}\x{200B}\x{FEFF}]+", " "))


def _canonical_us(raw: Column) -> Column:
    n = lambda a, b: F.substring(raw, a, b).try_cast("int")
    return F.unix_micros(F.try_make_timestamp(n(1, 4), n(6, 2), n(9, 2), n(12, 2), n(15, 2), F.substring(raw, 18, 2).try_cast("decimal(8,6)"), F.lit("UTC")))


def parse_raw(df: DataFrame, raw: str = "raw", zone: str = "zone") -> DataFrame:
    """Adds ``utc_us`` (instant in microseconds) and ``age_us`` (a span to count back) to rows of distinct values."""
    t = _tidy(F.col(raw))
    cut = F.lit(None).cast("string")
    for pattern, groups in reversed(FORMATS):
        cut = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, "|".join("" if g == "-" else f"${g}" for g in groups.split()))).otherwise(cut)
    df = df.withColumn("__t", t).withColumn("__p", F.split(cut, r"\|"))
    part = lambda i: F.when(F.col("__p")[i] != "", F.col("__p")[i])
    month = F.coalesce(part(1).try_cast("int"), _lookup(MONTHS, part(1)))
    half, hour = F.lower(part(7)), part(3).try_cast("int")
    hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.concat(F.coalesce(part(5), F.lit("0")), F.lit("."), F.rpad(F.substring(F.coalesce(part(6), F.lit("")), 1, 6), 6, "0"))
    wall = F.try_make_timestamp(part(0).try_cast("int"), month, part(2).try_cast("int"), hour, part(4).try_cast("int"), second.try_cast("decimal(8,6)"), F.lit("UTC"))
    df = df.withColumn("__wall", wall).withColumn("__z", part(8))
    digits = F.regexp_replace(F.regexp_replace("__z", "(?i)^(UTC|GMT)(?=[+-])", ""), ":", "")
    minutes = F.when(
        digits.rlike(r"^[+-]\d{2}(\d{2})?$"),
        F.when(digits.startswith("-"), -1).otherwise(1) * (F.substring(digits, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0))),
    ).otherwise(_lookup(ZONES, F.col("__z")))
    local = F.unix_micros(F.to_utc_timestamp("__wall", F.coalesce(F.col(zone), F.lit("UTC"))))
    at = F.when(F.col("__z").isNotNull(), F.unix_micros("__wall") - minutes.cast("long") * 60_000_000).when(F.col(zone).isNotNull(), local)
    size, whole = F.length("__t"), F.col("__t").try_cast("long")
    unix = F.when(
        F.col("__t").rlike(r"^\d{9,19}$"),
        F.when(size <= 11, whole * 1_000_000).when(size <= 14, whole * 1_000).when(size <= 17, whole).otherwise((F.col("__t").try_cast("decimal(20,0)") / 1000).try_cast("decimal(20,3)").try_cast("long")),
    ).when(F.col("__t").rlike(r"^\d{9,11}[.]\d+$"), (F.col("__t").try_cast("decimal(30,9)") * 1_000_000).try_cast("long"))
    age = F.when(F.col("__t").rlike(_AGE), F.regexp_extract("__t", _AGE, 1).try_cast("long") * _lookup(UNITS, F.regexp_extract("__t", _AGE, 2)) * 1_000_000)
    return df.withColumns({"utc_us": F.when(F.col("__p").isNotNull(), at).otherwise(unix), "age_us": age}).drop("__t", "__p", "__wall", "__z")


def normalise_instants(df: DataFrame, id_col: str, fields: list[tuple[str, str, str | None]], dictionary: str | None = None) -> DataFrame:
    """One row (id, field, raw, utc_us) for each row and field.

    fields: (column, column with the IANA zone of its local times, column whose instant its ages count back from).
    dictionary: folder of a table (raw, zone, utc_us, age_us) that is used and extended; without it, one run's own.
    """
    spark = df.sparkSession
    none = F.lit(None).cast("string")
    long = df.select(
        F.col(id_col).alias("__id"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw"), F.col(z).alias("zone"), (F.col(b) if b and b != f else none).alias("base"), (dict((x[0], F.col(x[1])) for x in fields)[b] if b and b != f else none).alias("base_zone")) for f, z, b in fields])).alias("v"),
    ).select("__id", "v.*")
    plain = F.col("raw").rlike(CANONICAL)
    dull = F.col("raw").isNull() | (_tidy(F.col("raw")) == "")
    fixed = long.filter(F.coalesce(plain | dull, F.lit(True))).select("__id", "field", "raw", _canonical_us(F.col("raw")).alias("utc_us"))
    return fixed.unionByName(_through_dictionary(spark, long.filter(~dull & ~plain), dictionary)).withColumnRenamed("__id", id_col)


def _through_dictionary(spark, odd: DataFrame, dictionary: str | None) -> DataFrame:
    """Values that are neither blank nor canonical. Their ages' base values need an instant too."""
    ages = F.col("raw").rlike(_AGE)
    odd = odd.withColumn("base", F.when(F.trim(F.col("raw")).rlike(_AGE), F.col("base"))).withColumn("base_zone", F.when(F.col("base").isNotNull(), F.col("base_zone")))
    keys = odd.select("raw", "zone")
    counts = keys.groupBy("raw", F.coalesce("zone", F.lit("")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    parse = lambda d: parse_raw(d.withColumn("__zone", F.when(F.col("zone") != "", F.col("zone"))), "raw", "__zone").drop("__zone")
    if dictionary is None:
        entries = stage(parse(counts), "instants")
    else:
        schema = T.StructType([T.StructField("raw", T.StringType()), T.StructField("zone", T.StringType()), T.StructField("utc_us", T.LongType()), T.StructField("age_us", T.LongType())])
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(dictionary)
        counts = stage(counts, "instant-keys")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            new = counts.join(spark.read.schema(schema).parquet(dictionary), ["raw", "zone"], "left_anti")
        else:
            new = counts
        parse(new).select(*schema.names).write.mode("append").parquet(dictionary)
        entries = counts.join(spark.read.schema(schema).parquet(dictionary), ["raw", "zone"])
    total = entries.agg(F.sum("n")).first()[0] or 0
    hits = join_hot(odd.withColumn("zone", F.coalesce("zone", F.lit(""))), entries, ["raw", "zone"], "n", total, "left").drop("n")
    direct = hits.filter(F.col("age_us").isNull()).select("__id", "field", "raw", "utc_us")
    aged = hits.filter(F.col("age_us").isNotNull())
    inline = F.coalesce(F.col("base").rlike(CANONICAL), F.lit(True))
    at_once = aged.filter(inline).select("__id", "field", "raw", (_canonical_us(F.col("base")) - F.col("age_us")).alias("utc_us"))
    later = aged.filter(~inline).select("__id", "field", "raw", "age_us", F.col("base").alias("b_raw"), F.coalesce("base_zone", F.lit("")).alias("b_zone"))
    bases = entries.select(F.col("raw").alias("b_raw"), F.col("zone").alias("b_zone"), F.col("utc_us").alias("b_us"), "n")
    joined = join_hot(later, bases, ["b_raw", "b_zone"], "n", total, "left")
    return direct.unionByName(at_once).unionByName(joined.select("__id", "field", "raw", (F.col("b_us") - F.col("age_us")).alias("utc_us")))


def with_zones(posts: DataFrame, cities: DataFrame, sites: DataFrame, default: str = "Asia/Jakarta") -> DataFrame:
    """Adds ``__city_zone`` and ``__site_zone``; the two dimensions are counted before they are broadcast."""
    known = sorted(zoneinfo.available_timezones())  # any other name would fail the query
    one = lambda d, k: d.filter(F.col("tz_name").isin(known)).groupBy(F.lower(F.trim(F.col(k))).alias(f"__{k}")).agg(F.min("tz_name").alias(f"__tz_{k}"))
    c, s = one(cities, "city"), one(sites, "scrape_mode")
    out = posts.join(bounded(c, 100_000), F.lower(F.trim(posts["city"])) == c["__city"], "left").join(bounded(s, 100_000), F.lower(F.trim(posts["scrape_mode"])) == s["__scrape_mode"], "left")
    return out.withColumn("__city_zone", F.coalesce("__tz_city", F.lit(default))).withColumn("__site_zone", F.col("__tz_scrape_mode"))


def post_instants(posts: DataFrame, cities: DataFrame, sites: DataFrame, dictionary: str | None = None) -> DataFrame:
    """Instants of ``timestamp`` and ``collected_at`` of social posts."""
    rows = with_zones(posts.select("row_id", "timestamp", "collected_at", "city", "scrape_mode"), cities, sites)
    return normalise_instants(rows, "row_id", [("timestamp", "__city_zone", "collected_at"), ("collected_at", "__site_zone", None)], dictionary)


def found(posts: DataFrame, cities: DataFrame, sites: DataFrame) -> DataFrame:
    """Values that name an instant in another form than the canonical one."""
    out = post_instants(posts, cities, sites)
    return out.filter(F.col("utc_us").isNotNull() & ~F.col("raw").rlike(CANONICAL)).select("row_id", "field", "utc_us")
