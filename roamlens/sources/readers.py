"""Readers for the text, JSON and parquet inputs of the analysis scripts
(SURVEY S4, S6–S12, S14, S15).  All schemas are declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamlens import schemas as S
from roamlens.operators.fuzzy import flatten_gazetteer_list, flatten_gazetteer_map, parse_gazetteer_text


def read_lines(spark: SparkSession, paths, keep_blank: bool = False) -> DataFrame:
    """Lines of one or many text files, stripped; blank lines dropped
    unless ``keep_blank``.  The source file is kept (``file``)."""
    df = spark.read.text(paths).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"))
    return df if keep_blank else df.filter(F.col("value") != "")


def read_numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines with their exact (file, line number), for readers where order
    matters (later duplicates win).  One whole file per row before the split,
    so use it for dictionary-sized files."""
    w = spark.read.text(paths, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    return w.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "value")) \
            .withColumn("value", F.trim(F.regexp_replace("value", "\r$", "")))


def read_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Every file of a directory as one document (path, text)."""
    return spark.read.text(directory, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def first_nonblank_line(text) -> Column:
    """The first non-blank line of a document (null for an empty file)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.try_element_at(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""), F.lit(1))


def read_lexicon(spark: SparkSession, sentiment: str, negation: str, degree: str) -> DataFrame:
    """Three lexicon files (``word score`` / ``word`` / ``word weight``) as
    (word, kind, weight, ord); ``ord`` follows file order so that a later
    duplicate wins in ``merge_lexicon``."""
    def one(path, kind, has_weight, base):
        l = read_numbered_lines(spark, path).filter(F.col("value") != "")
        parts = F.split("value", " ")
        w = parts[1].cast("double") if has_weight else F.lit(-1.0)
        return l.select(parts[0].alias("word"), F.lit(kind).alias("kind"), w.alias("weight"),
                        (F.lit(base) + F.col("line_no")).cast("long").alias("ord"))
    big = 1 << 40
    return one(sentiment, "sen", True, 0).unionByName(one(negation, "not", False, big)) \
                                        .unionByName(one(degree, "deg", True, 2 * big))


def read_gazetteer_text(spark: SparkSession, path: str) -> DataFrame:
    """Text gazetteer -> map shape (one row, column ``value``)."""
    return parse_gazetteer_text(spark.read.text(path, wholetext=True), "value")


def read_gazetteer_json(spark: SparkSession, path: str) -> DataFrame:
    """Gazetteer JSON -> flat (ord, level, name, province), in any of its shapes:
    a list of ``{province: {city: [county]}}``, one such map, or a list of
    ``{province: [{city: [county]}]}``.  The text is parsed with each declared schema;
    the one that loses no entry is taken, and a file that fits none is an error."""
    raw = spark.read.text(path, wholetext=True)
    maps = raw.select(F.from_json("value", S.GAZETTEER_JSON_MAPS).alias("value"))
    if _whole(maps.select(F.explode("value").alias("v")).select(F.explode("v"))):
        one = F.map_from_entries(F.flatten(F.transform("value", lambda m: F.map_entries(m))))
        return flatten_gazetteer_map(maps.select(one.alias("value")), "value")
    one = raw.select(F.from_json("value", S.GAZETTEER_JSON_MAP).alias("value"))
    if _whole(one.select(F.explode("value"))):
        return flatten_gazetteer_map(one, "value")
    lists = raw.select(F.from_json("value", S.GAZETTEER_JSON_LIST).alias("value"))
    if _whole(lists.select(F.explode("value").alias("v")).select(F.explode("v"))):
        return flatten_gazetteer_list(lists, "value")
    raise ValueError(f"{path} has none of the known gazetteer shapes")


def _whole(provinces: DataFrame) -> bool:
    """Whether (key, value) rows exist and all values were parsed."""
    r = provinces.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("lost")).first()
    return r["n"] > 0 and r["lost"] == 0


def read_labelled_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Pre-tokenised labelled corpus (doc_id, label, words)."""
    return spark.read.schema(S.LABELLED_TOKENS).parquet(path)


def read_scene_areas(spark: SparkSession, path: str) -> DataFrame:
    """The area-polygon collection exported as JSON lines."""
    return spark.read.schema(S.SCENE_AREA).json(path)


def parse_json(df: DataFrame, col: str, schema, out: str = "doc") -> DataFrame:
    """Parse a JSON response body once into a struct."""
    return df.withColumn(out, F.from_json(col, schema))
