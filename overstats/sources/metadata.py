"""Side tables: people register, style files, exported metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from overstats.functions import styles


def read_csv(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def unambiguous_register(rows: DataFrame, identifier: str = "identifier",
                         keys: tuple[str, ...] = ("key_cricinfo", "key_cricinfo_2")) -> DataFrame:
    """External id -> person; an id given to two people is left out."""
    c = F.col
    pairs = rows.select(
        F.trim(identifier).alias("person_id"),
        F.explode(F.array(*[F.trim(k) for k in keys])).alias("external_id"),
    ).where((c("person_id") != "") & (c("external_id") != "")).distinct()
    return pairs.groupBy("external_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("person_id").alias("person_id")
    ).where("_n = 1").drop("_n")


# fixed values: columns of a styles file
STYLE_COLUMNS = ("name", "bowling_type", "batting_hand", "role", "country", "cricinfo_id",
                 "source", "cricsheet_id", "full_name")


def style_rows(raw: DataFrame, source: str = "") -> DataFrame:
    """Rows of a styles file; text the taxonomy doesn't know is kept as it is.

    ``row_no`` is the row's place, which settles duplicates.
    """
    c = F.col
    have = {k: F.trim(F.coalesce(c(k), F.lit(""))) if k in raw.columns else F.lit("")
            for k in STYLE_COLUMNS}
    kind, hand = styles.bowling_style(have["bowling_type"]), styles.batting_hand(have["batting_hand"])
    return raw.where(have["name"] != "").select(
        have["name"].alias("name"),
        F.when(kind != "", kind).otherwise(have["bowling_type"]).alias("bowling_type"),
        F.when(hand != "", hand).otherwise(have["batting_hand"]).alias("batting_hand"),
        have["role"].alias("role"), have["country"].alias("country"),
        have["cricinfo_id"].alias("external_id"), have["cricsheet_id"].alias("row_id"),
        have["full_name"].alias("full_name"),
        F.when(have["source"] != "", have["source"]).otherwise(source).alias("source"),
        c("row_no") if "row_no" in raw.columns else F.monotonically_increasing_id().alias("row_no"),
    )


def convert_metadata(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An exported player table as styles rows, and the styles not recognised.

    Column names are the export's: unique_name, cricsheet_id, bowling_style,
    batting_style, playing_role, country, cricinfo_id, full_name.
    """
    c = F.col
    clean = lambda k: styles.clean_value(F.coalesce(c(k), F.lit("")))
    first = styles.primary_style(F.coalesce(c("bowling_style"), F.lit("")))
    rows = raw.where(clean("unique_name") != "").select(
        clean("unique_name").alias("name"), clean("cricsheet_id").alias("cricsheet_id"),
        clean("full_name").alias("full_name"), first.alias("_raw"),
        styles.bowling_style(first).alias("bowling_type"),
        styles.batting_hand(clean("batting_style")).alias("batting_hand"),
        clean("playing_role").alias("role"), clean("country").alias("country"),
        clean("cricinfo_id").alias("cricinfo_id"),
    )
    unknown = rows.where((c("_raw") != "") & (c("bowling_type") == "")).groupBy(
        c("_raw").alias("style")
    ).agg(F.count(F.lit(1)).alias("n"))
    kept = rows.where((c("bowling_type") != "") | (c("batting_hand") != "")).drop("_raw")
    return kept.withColumn("source", F.lit("player-meta")), unknown


def write_styles(rows: DataFrame, path: str) -> None:
    """Ordered styles CSV parts with a header."""
    rows.orderBy("name", "cricsheet_id").write.mode("overwrite").option("header", True).csv(path)


def row_numbers(rows: DataFrame, *order: str) -> DataFrame:
    """Number rows within their name: only duplicates of a name are compared."""
    window = Window.partitionBy("name").orderBy(*order)
    return rows.withColumn("row_no", F.row_number().over(window))


PLACES_DDL = "ground STRING, city STRING, country STRING"


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Gazetteer rules (ground, city, country); blank means 'any'."""
    return spark.read.option("header", True).schema(PLACES_DDL).csv(path)
