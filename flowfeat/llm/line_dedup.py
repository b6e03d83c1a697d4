"""Operator 5, line dedup: lines that many documents share are dropped, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfeat.llm._spark import cut, table

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case and other letters as they are."""
    bare = F.trim(line, F.lit(SPACE))
    # lower() is far quicker than translate() and does the same to pure ASCII
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashed(key: Column, min_chars: int) -> Column:
    """128 bits of the key, null if it is too short to count."""
    return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b")))


def _member(h: Column, drop: Column, steps: Column) -> Column:
    """Whether the sorted list holds h, by halving: ``steps`` are falling powers of two that reach over the list. False for a null h."""
    at = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(drop, at + step - 1) <= h, at + step).otherwise(at))
    return F.coalesce(F.get(drop, at - 1) == h, F.lit(False))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with lines dropped whose key at least ``min_docs`` documents hold, except in the largest id among them.

    Adds ``n_lines``, ``n_dropped`` and replaces the text; every other column stays. A null or empty text is one
    empty line and comes out empty. Rows that repeat an id count as one document and lose the same lines; rows with
    a null id count together as one document, which is never the largest unless alone. An empty table gives an empty table.

    Work: one shuffle of (key hash, id) pairs of long lines only, written once and read twice; counts are pre-aggregated on the map side so
    that a line held by a third of all documents arrives as a few partial counts; the join back is one that Spark splits on skew. A document's
    lines are looked up in its sorted list of drops by halving, so long documents cost lines times the logarithm of their drops.
    """
    own = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    src = docs.select(F.struct(*own).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    lines = F.split(F.coalesce(F.col("__text"), F.lit("")), "\n", -1)
    held = cut(
        src.select("__id", F.explode(lines).alias("__line"))
        .select("__id", _hashed(line_key(F.col("__line")), min_chars).alias("__h"))
        .filter(F.col("__h").isNotNull())
        .select("__id", F.col("__h.a").alias("__a"), F.col("__h.b").alias("__b"))
        .distinct(),
        "held-lines",
    )
    common = cut(held.groupBy("__a", "__b").agg(F.count("*").alias("__n"), F.max("__id").alias("__last")).filter(F.col("__n") >= min_docs).select("__a", "__b", "__last"), "common-lines")
    drops = (
        held.join(common, ["__a", "__b"])
        .filter(~F.col("__id").eqNullSafe(F.col("__last")))
        .groupBy(F.col("__id").alias("__of"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("__a").alias("a"), F.col("__b").alias("b")))).alias("__drop"))
        .withColumn("__steps", F.transform(F.sequence(F.floor(F.log2(F.size("__drop"))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int")))
    )
    hashed = F.transform("__lines", lambda x: F.struct(x.alias("line"), _hashed(line_key(x), min_chars).alias("h")))
    kept = F.transform(F.filter(hashed, lambda x: ~_member(x["h"], F.col("__drop"), F.col("__steps"))), lambda x: x["line"])
    out = src.join(drops, F.col("__id").eqNullSafe(F.col("__of")), "left").withColumn("__lines", lines).withColumn("__kept", F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(kept))
    return out.select(
        *[F.col("__row")[c].alias(c) for c in own],
        F.array_join("__kept", "\n").alias(text_col),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = """
WITH l AS (
  SELECT doc_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.*, c.last IS NOT NULL AND c.last <> k.doc_id AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
