"""Readers of the raw inputs: keyed CSV, bibliographies, songs, linked censuses, code books, geocodes, Stata files, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergekin.standardise import census_code, census_text, split_name, standard_number, standard_string, strip_entities


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, header: bool = True) -> DataFrame:
    """A CSV of texts; with columns an explicit schema, so that no pass is spent on inference."""
    reader = spark.read.option("header", header).option("quote", '"').option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def keyed_csv(spark: SparkSession, path: str, key: str, columns: list[str] | None = None) -> DataFrame:
    """read_csv with one row per key, the last in file order."""
    rows = read_csv(spark, path, columns).withColumn("_at", F.monotonically_increasing_id())
    last = Window.partitionBy(key).orderBy(F.desc("_at"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_at", "_k")


def publications(raw: DataFrame) -> DataFrame:
    """Publication records from raw rows id, title, authors, venue, year."""
    return raw.select("id", F.lit("P").alias("role"), standard_number("year").alias("year"), standard_string("venue").alias("venue"), standard_string("title").alias("pub_name"), "authors")


def authors(raw: DataFrame) -> DataFrame:
    """One row per author of a raw publication row: the name split in parts, the other authors' ids and the publication's values.

    The author list is split at commas; HTML entities go and punctuation becomes blanks; an author's id is <publication>_<place>.
    """
    pubs = publications(raw)
    cut = F.transform(F.split(strip_entities("authors"), ","), lambda a: F.trim(a))
    listed = pubs.withColumn("list", F.filter(cut, lambda a: a != "")).withColumn("ids", F.transform(F.sequence(F.lit(1), F.size("list")), lambda i: F.concat(F.col("id"), F.lit("_"), i.cast("string"))))
    each = listed.where("size(list) > 0").select("id", "year", "venue", "pub_name", "ids", F.posexplode("list").alias("at", "fullname"))
    own = F.element_at("ids", F.col("at") + 1)
    return each.select(own.alias("id"), F.col("id").alias("pub_id"), F.lit("A").alias("role"), (F.col("at") + 1).alias("author_no"), "year", "venue", "pub_name", "fullname", split_name("fullname").alias("n"), F.array_remove("ids", own).alias("coauthor_ids")).select("*", "n.*").drop("n")


def songs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two song tables (id, title, album, artist, year, length) as one, with the source their ids tell (10..., 20...)."""
    both = first.unionByName(second)
    source = F.when(F.col("id").startswith("10"), "A").when(F.col("id").startswith("20"), "B")
    return both.select("id", source.alias("source"), standard_string("title").alias("title"), standard_string("album").alias("album"), standard_string("artist").alias("artist"), standard_number("year").alias("year"), standard_number("length").alias("length"))


def candidate_pairs(raw: DataFrame, id1: str, id2: str, label: str = "label") -> DataFrame:
    """(r1, r2, label) from a file of candidate pairs."""
    return raw.select(F.col(f"`{id1}`").alias("r1"), F.col(f"`{id2}`").alias("r2"), F.col(label).cast("int").alias("label"))


def code_book(spark: SparkSession, path: str) -> DataFrame:
    """(code, label) of a headerless CSV."""
    return read_csv(spark, path, ["code", "label"], header=False)


def decoded(df: DataFrame, column: str, book: DataFrame, out: str) -> DataFrame:
    """df with the label of a code; code books are fixed lists, so the smaller side is left to the planner."""
    return df.join(book.select(F.col("code").alias(column), F.col("label").alias(out)), column, "left")


def geocodes(raw: DataFrame) -> DataFrame:
    """(location, lat, lon) from text such as [55.8, -4.2]."""
    at = lambda i: F.regexp_extract("geocode", r"\[?\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*\]?", i).try_cast("double")
    return raw.select("location", at(1).alias("lat"), at(2).alias("lon"))


def read_stata(spark: SparkSession, path: str) -> DataFrame:
    """A Stata file by way of pandas on the driver; Spark has no reader, and such files are bounded single-machine exports."""
    import pandas as pd

    return spark.createDataFrame(pd.read_stata(path, convert_categoricals=False))


def people_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


# --- linked census -----------------------------------------------------------------------------------------------

_FIELDS = ["relate", "namefrst", "namelast", "year", "serial", "pernum", "sex", "race", "bpl", "age", "stateicp", "city", "occ1950"]
#: households' roles by relation to the head and sex.
HOUSEHOLD_LINKS = ["F-F", "M-M", "C-C"]


def household_role(relate: Column, sex: Column) -> Column:
    """F and M for the couple by sex, C for a child; null for others."""
    r, s = census_text(relate), census_text(sex)
    return F.when(r.isin("1", "2"), F.when(s == "2", "M").when(s == "1", "F")).when(r == "3", "C")


def linked_census(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, links): the persons of both censuses of a linked table, each once by year, household and place, and the pairs linked.

    Kept are rows with the same relation 1, 2 or 3 on both sides, and persons of the first census without a link (linktype 9).
    """
    rel1, rel2 = census_text("relate_1"), census_text("relate_2")
    kept = raw.where(rel1.isin("1", "2", "3") & (F.coalesce(rel1 == rel2, F.lit(False)) | F.col("relate_2").isNull()))

    def side(n: int) -> DataFrame:
        c = {f: F.col(f"{f}_{n}") for f in _FIELDS}
        return kept.where(c["serial"].isNotNull()).select(
            F.concat_ws("-", c["year"], c["serial"], c["pernum"]).alias("id"), c["year"].cast("int").alias("census_year"), c["serial"].alias("serial"), c["pernum"].alias("pernum"),
            household_role(c["relate"], c["sex"]).alias("role"), F.when(census_text(c["sex"]) == "1", "M").when(census_text(c["sex"]) == "2", "F").alias("sex"),
            standard_string(c["namefrst"]).alias("fname"), standard_string(c["namelast"]).alias("sname"), (c["year"] - census_text(c["age"]).try_cast("int")).cast("int").alias("birth_year"),
            census_text(c["race"]).alias("race"), census_code(c["bpl"], "bpl").alias("bpl"), census_code(c["stateicp"], "stateicp").alias("state"), census_code(c["city"], "city").alias("city"), census_code(c["occ1950"], "occ1950").alias("occ"),
        )

    people = side(1).unionByName(side(2)).groupBy("id").agg(*[F.min_by(c, F.struct(F.coalesce("fname", F.lit("")), F.coalesce("sname", F.lit("")), F.coalesce("occ", F.lit("")), F.coalesce("city", F.lit("")), F.coalesce("state", F.lit("")), F.coalesce("birth_year", F.lit(0)))).alias(c) for c in side(1).columns if c != "id"])
    links = kept.where("serial_2 is not null").select(F.concat_ws("-", "year_1", "serial_1", "pernum_1").alias("a"), F.concat_ws("-", "year_2", "serial_2", "pernum_2").alias("b")).distinct()
    return people, links


def household_relations(people: DataFrame) -> DataFrame:
    """(record, relation, other): spouse, mother, father, child and sibling ids within each household of a census.

    Only what the roles tell: the couple are each other's spouse and the parents of all children.
    """
    one = people.where("role is not null").select("census_year", "serial", F.col("id").alias("record"), "role")
    two = one.select("census_year", "serial", F.col("record").alias("other"), F.col("role").alias("role_o"))
    both = one.join(two, ["census_year", "serial"]).where("record != other")
    a, b = F.col("role"), F.col("role_o")
    relation = F.when(a.isin("F", "M") & b.isin("F", "M"), "spouse").when((a == "C") & (b == "M"), "mother").when((a == "C") & (b == "F"), "father").when(a.isin("F", "M") & (b == "C"), "child").when((a == "C") & (b == "C"), "sibling")
    return both.select("record", relation.alias("relation"), "other")
