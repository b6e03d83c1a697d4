"""A training-data pipeline of five stages, each of which writes its rows before the next one reads them.

language_id     drops documents whose language can't be told: no letters, or a posterior share under MIN_SCORE
line_dedup      drops lines that many documents share; a document of which no word is left goes
ngram_join      keeps the document with the smallest id of each group of near copies
decontaminate   drops documents that hold a benchmark item
pack            packs the rest into sequences of 2,048 tokens: one row per piece

Each stage but the last returns the columns that it was given, whatever they are called, with changed texts at line_dedup only. Null texts have no letter
and go at language_id; empty ones too. Very long texts are treated whole. Rows that repeat an id and text are one document and come out once, at
ngram_join; of rows that share an id but not a text the one of least hash stays there. Rows with a null id stand for no document and go at ngram_join. Of
texts that are equal the one with the smallest id stays. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfeat.llm._spark import cut, table
from flowfeat.llm.decontaminate import contamination
from flowfeat.llm.language_id import UNKNOWN, fit, language_id
from flowfeat.llm.line_dedup import line_dedup
from flowfeat.llm.ngram_join import ngram_jaccard_join
from flowfeat.llm.packing import pack, pieces

MIN_SCORE = 0.5
#: Trees and sequences come from sampling rules and heuristics that SQL can't state; tests hold the stages against brute force.
ORACLE_SQL = None


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of ``MIN_SCORE`` at least, by trees from these documents."""
    judged = language_id(docs, fit(docs))
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(docs.columns)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that five or more share, but for the largest id's; ``n_chars`` follows the text. A document that lost lines and has no letter or digit left goes."""
    out = line_dedup(docs)
    return out.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class; a class is what links of similarity 0.8 or more reach."""
    kept = ngram_jaccard_join(docs).filter("doc_id = class_id").select("doc_id")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = docs.join(kept, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(row, F.xxhash64("text")).alias("__row"))
    return one.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def stage_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, neither copied nor paraphrased."""
    found = cut(contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its sequence and its place there."""
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", stage_language),
    ("line_dedup", stage_lines),
    ("ngram_join", stage_near_copies),
    ("decontaminate", stage_benchmark),
    ("pack", stage_pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
