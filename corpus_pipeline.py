"""The corpus pipeline: classify, deduplicate, redact, mix and pack documents.

Each stage takes what its predecessor kept, read again from Parquet. All but the
last return the columns of documents; the mix repeats rows that it takes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import STAGED, release, shared_folder, staged, table, text_or_empty, whole
from textquarry.llm.contexts import personal_data, redact
from textquarry.llm.mixing import measured, numbered, queued, sequenced
from textquarry.llm.near_dups import few, near_duplicates
from textquarry.llm.packing import pack_documents
from textquarry.llm.quality_classifier import classify, train


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier accepts; null and empty texts are judged like any other, and no rows give none."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs.select(whole(docs).alias("_doc"), "text"), model).filter("accepted").select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8), the first by id, text's digest and the other columns; one row of each id and text. Rows without an id stay, those without words have no near ones.

    Rows are told apart by numbers of their own, so no two can be taken for one.
    """
    rows = staged(docs.select(whole(docs).alias("_doc"), F.monotonically_increasing_id().alias("_row")))
    of = F.struct(F.col("_doc.doc_id").alias("doc_id"), F.sha2(text_or_empty("_doc.text").cast("binary"), 256).alias("digest"))
    order = F.struct(of.alias("of"), F.to_json(F.col("_doc").dropFields("text")).alias("rest"), "_row").alias("_order")
    named = rows.select(F.when(F.col("_doc.doc_id").isNotNull(), F.col("_row")).alias("doc_id"), F.col("_doc.text").alias("text"))
    found = staged(near_duplicates(named, shingle=5, percent=80).filter("doc_id is not null").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"), "n_shingles"))
    several = few(staged(found.filter("_row != _group").select("_group").distinct()))
    near = staged(found.join(several, "_group", "left_semi").select("_row", "_group").distinct())
    heads = rows.select("_row", order).join(few(near), "_row").groupBy("_group").agg(F.min_by("_row", "_order").alias("_head"))
    copies = near.join(few(staged(heads)), "_group").filter("_row != _head").select("_row")
    blank = few(staged(found.filter("n_shingles = 0").select("_row")))
    blank = staged(rows.select("_row", of.alias("_of"), order).join(blank, "_row", "left_semi"))
    firsts = staged(blank.groupBy("_of").agg(F.min_by("_row", "_order").alias("_head"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    gone = staged(copies.union(blank.join(few(firsts), "_of").filter("_row != _head").select("_row")))
    return rows.join(few(gone), "_row", "left_anti").select("_doc.*")


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; null texts stay null."""
    clean = redact(docs, personal_data(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the order of the queue, as often as it serves them; of a copy that the budget cuts, all or nothing, whichever is nearer.

    Texts without words have no size and stay once; null sources are a source; no rows give none.
    """
    rows = numbered(docs)
    sized, targets = measured(rows, row="_row", size="_size")
    copies = queued(sized, targets).groupBy("_row", "copy", "doc_id", "source", "size").agg(F.sum("taken").alias("_taken"), F.min("finish_time").alias("finish_time"))
    kept = staged(copies.filter("case when size = 0 then copy = 0 else 2 * _taken >= size end").drop("_taken"))
    return sequenced(rows, kept, targets)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences of 4096; null and empty texts are the end token alone, no rows give none."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("PII", remove_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: Learned weights, bootstrapped patterns and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as Parquet and read again."""
    shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        first = len(STAGED)
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = staged(docs)
            release(spark, first, -1)  # what the stage staged on its way, but not its result
    return docs
