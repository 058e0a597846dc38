"""The corpus pipeline: documents through the stages in order, each stage's rows
written as Parquet and read again as the next one's input.

Every stage reads all rows its predecessor kept.  All but the last return the columns
of ``documents``; extra input columns pass through the filters unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamlens.llm import minhash, mixing, ordinal_quality, piece_trie, pseudonyms
from roamlens.llm.common import load, materialise, prepare
from roamlens.llm.queries import tokenizer_file

#: Columns between the model and its filter.
QUALITY = ("__expected_grade", "__p_good", "__kept")


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model takes for good text; those it rejects go."""
    model = ordinal_quality.train(docs, load(spark, sf_dir, "labels"))
    return ordinal_quality.quality(docs, model, out=QUALITY).filter(QUALITY[2]).drop(*QUALITY)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__id``, the id of a text: doc_id, but where texts under one id differ,
    one (the least by hash) keeps it and each other has a number of its own above 2 ** 62."""
    text = F.xxhash64("text", F.col("text").isNull())
    unlike = docs.groupBy("doc_id").agg(F.min(text).alias("__least"), F.max(text).alias("__most"))
    unlike = unlike.filter("__least != __most AND doc_id IS NOT NULL").select("doc_id", "__least")
    if unlike.isEmpty():
        return docs.withColumn("__id", F.col("doc_id"))
    own = F.xxhash64("doc_id", text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    one = F.col("__least").isNull() | (F.col("__least") == text)
    marked = docs.join(unlike, "doc_id", "left").withColumn("__id", F.when(one, F.col("doc_id")).otherwise(own))
    return materialise(marked.drop("__least"), "numbered-texts")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id (of
    equal texts under one id, the row with the least hash).  Unlike texts under one id
    are documents of their own.  Rows without an id all stay."""
    rows = _numbered(docs)
    found = minhash.near_duplicates(rows, id_col="__id")
    kept = found.filter("kept AND __id IS NOT NULL").select("__id").distinct()
    named = rows.join(kept, "__id", "left_semi")
    again = found.groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1 AND __id IS NOT NULL").select("__id")
    row = F.struct(*docs.columns)
    repeated = named.join(again, "__id", "left_semi").groupBy("__id").agg(F.min_by(row, F.xxhash64(row)).alias("__row"))
    single = named.join(again, "__id", "left_anti").select(docs.columns)
    return single.unionByName(repeated.select("__row.*")).unionByName(docs.filter("doc_id IS NULL")).select(docs.columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; ``n_chars`` follows the new text."""
    out = pseudonyms.pseudonyms(docs, spans_col=None)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as rows: a document once for each repeat that the mix takes, cut at the
    budget's end where the last repeat is partial."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = docs.select("doc_id", "text", "source", F.struct(*rest).alias("__rest"))  # no name can clash
    rows = mixing.copies(mixing.mix(whole, keep=("text", "__rest")))
    out = {c: F.col(f"__rest.{c}") for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.length("text").cast("long")
    return rows.select(*[out[c].alias(c) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids and their number, for every row of the mix."""
    out = piece_trie.encode(docs, tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"))


def _with_package(stage):
    """The stage, run with the package on the executors."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return stage(spark, docs, sf_dir)
    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


STAGES = [(name, _with_package(stage)) for name, stage in (
    ("quality", select_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pseudonyms", pseudonymise),
    ("mix", mix_sources),
    ("pieces", encode_pieces))]

#: Hashed-text regression, MinHash and sub-word pieces have no SQL form: the stages
#: are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
