"""From documents to packed training sequences, each stage one of the operators of kelpie.llm.

1. quality classifier: documents that the model rejects go;
2. line dedup: lines that at least ten documents hold go, n_chars follows the text;
3. n-gram Jaccard join: of each class of near copies the document with the smallest id stays;
4. benchmark decontamination: documents with a copy of a test item go;
5. best-fit packing: the rows say where each piece of a document lies.

All but the last stage return the columns of documents. Nulls, empty and repeated rows and empty
tables have the operators' defined results; a document without an id is kept like any other, and
of each class of near copies one row stays, even where rows share an id or have none.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm import decontamination, line_dedup, near_duplicates, packing, quality_model
from kelpie.llm.common import stored, table

#: Ids that a join may broadcast, eight bytes each.
IDS = 1_000_000


def aside(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the whole row in one column, so that no operator's column takes another's name."""
    return docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")


def back(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The rows as they were, but for the new values."""
    return df.select(*(new[c].alias(c) if c in new else F.col(f"_row.{c}") for c in columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model predicts to be of quality 1."""
    judged = quality_model.classify(aside(docs), table(spark, sf_dir, "labels"))
    return back(judged.filter("predicted = 1"), docs.columns)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that at least ten of them hold; n_chars is counted anew."""
    out = line_dedup.dedup_lines(aside(docs))
    return back(out, docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies, whether or not ids are repeated or null.

    Only ids move: they go to the documents where they are few enough, and texts' digests meet
    only where an id comes more than once.
    """
    classes = stored(near_duplicates.classes_of(docs), "classes")
    heads = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    ids = classes.groupBy(F.col("doc_id").alias("head")).agg(F.count("*").alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("first"))
    ids = stored(ids.filter("first").select("head", "n"), "heads")

    def few(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= IDS else df

    def those(rows: DataFrame, ids: DataFrame) -> DataFrame:
        ids = few(ids)
        return rows.join(ids, rows["doc_id"].eqNullSafe(ids["head"]), "left_semi")

    once, more = those(docs, ids.filter("n = 1").select("head")), ids.filter("n > 1").select("head")
    if more.isEmpty():
        return once
    chosen = few(stored(those(heads, more).groupBy("root", F.col("doc_id").alias("head")).agg(F.min("copy").alias("own")), "chosen"))
    rows = near_duplicates.with_copies(aside(those(docs, more)))
    rows = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["head"]) & (rows["copy"] == chosen["own"]), "left_semi")
    return once.unionByName(back(rows.dropDuplicates(["doc_id", "copy"]), docs.columns))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("line_dedup", without_shared_lines),
    ("near_duplicates", one_of_each_class),
    ("decontamination", without_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: Learned scores, alignment and MinHash have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None
