"""The given tables in the shapes the operators expect."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.hashing import unit
from tesserae.functions.text import ANSWER_PREFIX
from tesserae.workspace import spread

CODE_SEED = 7
CODES = 16
POSITIONS = 3


KEYS = {"lineitem": ["l_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "conversations": ["conv_id"]}


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table; the large ones spread over the cores when they come in few files."""
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    rows = rows.select(*columns) if columns else rows
    return spread(rows, *KEYS[name]) if name in KEYS else rows


def epoch(column: str):
    """Seconds since 1970 of a timestamp without time zone."""
    days = F.unix_date(F.col(column).cast("date")).cast("bigint")
    return days * 86400 + F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    """Interactions: customers buying parts; the part type is the category, the discount the rating."""
    lines = table(
        spark, sf, "lineitem",
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount",
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(
        parts, lines.l_partkey == parts.p_partkey
    )
    return joined.select(
        F.col("p_type").alias("category"),
        F.col("o_custkey").cast("string").alias("user"),
        F.col("l_partkey").cast("string").alias("item"),
        epoch("o_orderdate").alias("ts"),
        F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
        ).alias("seq"),
        F.col("l_discount").alias("overall"),
    )


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    return purchases(spark, sf).drop("overall")


def one_category(rows: DataFrame) -> DataFrame:
    return rows.withColumn("category", F.lit("all"))


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    """Interactions from the event log: a small item pool that most users have largely seen."""
    return table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "props").select(
        F.col("event_type").alias("category"),
        F.col("user_id").cast("string").alias("user"),
        F.get_json_object("props", "$.k").alias("item"),
        epoch("ts").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def products(spark: SparkSession, sf: str) -> DataFrame:
    """Raw metadata: padded names, missing and empty brands, nested category paths."""
    part = table(spark, sf, "part")
    size = F.concat(F.lit("Size "), F.col("p_size").cast("string"))
    brand = (
        F.when(F.col("p_size") > 47, F.lit(None))
        .when(F.col("p_size") < 4, F.lit(""))
        .otherwise(F.col("p_brand"))
    )
    return part.select(
        F.col("p_type").alias("category"),
        F.col("p_partkey").alias("seq"),
        F.col("p_partkey").cast("string").alias("asin"),
        F.concat(F.lit("  "), F.regexp_replace("p_name", " ", " \n\t"), F.lit(" ")).alias("title"),
        F.concat(F.lit("A  "), F.col("p_name"), F.lit(" of size "), F.col("p_size").cast("string")).alias(
            "description"
        ),
        F.array(
            F.array(F.lit("Products"), F.col("p_type"), size), F.array(F.lit("Products"), F.col("p_brand"))
        ).alias("categories"),
        brand.cast("string").alias("brand"),
    )


def product_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata in which some asins have a second, later record."""
    first = products(spark, sf)
    later = (
        first.filter(F.col("description").contains("red "))
        .withColumn("seq", F.col("seq") + 1_000_000_000)
        .withColumn("title", F.concat(F.lit("new "), F.trim("title")))
        .withColumn("brand", F.lit("Renamed"))
    )
    return first.unionByName(later)


def hashed_codes(spark: SparkSession, sf: str) -> DataFrame:
    """A code tuple per vector drawn from the digest of (vector, position); some are unknown."""
    drawn = [
        F.floor(unit(CODE_SEED, "vec_id", F.lit(p)) * (CODES + 1)).cast("int") - 1
        for p in range(POSITIONS)
    ]
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("category"),
        "vec_id",
        F.floor(F.col("vec_id") / 50).alias("batch_id"),
        F.array(*drawn).alias("ids"),
    )


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation turn as a prediction of the next one."""
    turns = table(spark, sf, "conversations", "conv_id", "turn", "text")
    following = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference")
    )
    return turns.select("conv_id", "turn", F.col("text").alias("prediction")).join(
        following, ["conv_id", "turn"]
    )


def near_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents against a copy rewritten by language: upper case and respaced, prefixed, altered."""
    text = F.col("text")
    prefix = F.lit(ANSWER_PREFIX)
    changed = (
        F.when(F.col("lang") == "en", F.translate(F.regexp_replace(text, " ", "  "), ascii_lowercase, ascii_uppercase))
        .when(F.col("lang") == "de", F.concat(F.lit(" \n"), prefix, text))
        .when(F.col("lang") == "fr", F.regexp_replace(text, "[ai]n", "on"))
        .otherwise(text)
    )
    return table(spark, sf, "documents", "doc_id", "lang", "text").select(
        "doc_id", changed.alias("prediction"), text.alias("reference")
    )
