"""Corpus pipeline: from documents to the token files of a training mix.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the last
return the columns of ``documents``. ``run`` writes each stage's rows as Parquet in the shared folder and
reads them again, so a lost executor costs the running stage at most.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellpulse.llm.decontaminate import clean_rows
from cellpulse.llm.line_crf import fit_field, good_rows
from cellpulse.llm.mixing import label_domain, mixed_rows
from cellpulse.llm.ngram_join import one_of_each
from cellpulse.llm.wavelet import token_index
from cellpulse.session import materialise

#: Least quality of a document that stays.
QUALITY = 0.7
#: Share of its expected tokens that each domain keeps.
SHARES = {"good": 1.0, "poor": 0.25, "toxic": 0.1}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go. One label in four is left for judging it."""
    labels = _labels(spark, sf_dir).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    return good_rows(docs, fit_field(docs, labels), QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; five words, similarity 0.8."""
    return one_of_each(docs, length=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), length=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every domain keeps its share of expected tokens: a rate under 1 is the chance that a document stays."""
    return mixed_rows(docs, _labels(spark, sf_dir), label_domain(), SHARES)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and each document's place in them."""
    return token_index(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mixing),
    ("token-ID output", tokens),
]

#: Fitted models, whole-set similarity and a tokenizer: no SQL states these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return materialise(STAGES[-1][1](spark, docs, sf_dir), "tokens")
