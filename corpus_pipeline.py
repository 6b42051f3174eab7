"""A corpus pipeline of five stages: toxic documents go, one document of each near-duplicate group stays, documents with benchmark
passages go, personal data get surrogates, and the rest is mixed to source weights, texts repeated or cut as the mix says.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes each stage's rows to the shared
folder and reads them again for the next. Other columns of documents are carried through.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, pii, simhash, toxicity
from lodestone.llm.common import durable, free_name, table, text_hash


#: The near-copy stage takes fingerprints over pairs of words in six views: of random edits that leave 0.8 of the five-word shingles or more
#: (Jaccard), it links some 0.94, one view over three words 0.34.
WORDS, VIEWS = 2, 6


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't predict toxic."""
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by SimHash: the one with the smallest id (null ids last) and, where texts share it, the smallest text hash.

    Groups are told apart by their smallest fingerprint, as one id can stand for texts of several groups: each of them keeps a row.
    """
    h = free_name("_h", docs)
    keyed = docs.withColumn(h, text_hash())
    rows = simhash.near_duplicates(keyed.select("doc_id", "text", F.col(h).alias("_h")), keep=("_h",), shingle=WORDS, views=VIEWS).groupBy("root", "doc_id", "_h").count()
    heads = durable(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "_h", "count")).alias("h")).select(F.col("h.doc_id").alias("_id"), F.col("h._h").alias("_h2"), F.col("h.count").alias("_n")))
    kept = keyed.join(heads, keyed["doc_id"].eqNullSafe(heads["_id"]) & (keyed[h] == heads["_h2"]), "left_semi")
    if not heads.filter("_n > 1").isEmpty():  # a head's row repeats
        kept = kept.dropDuplicates(["doc_id", h])
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select(*docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data replaced; lengths in characters follow the text."""
    return pii.replace_pii(docs, pii.session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: the documents it takes words of, a row for each epoch, with size, source_size, target, epoch (from 0) and taken (the
    row's words). Where the budget ends within a document, the text is cut behind its last word taken. Rows that are equal in id and
    text are one document, repeated so often. Clashing columns are replaced."""
    added = ["size", "source_size", "target", "epoch", "taken"]
    docs = docs.drop(*added)
    h, h2, ident, words_in_all, n = (free_name(c, docs) for c in ("_h", "_h2", "_id", "_all", "_n"))
    keyed = docs.withColumn(h, text_hash())
    mixed = mixing.mix(keyed.select("doc_id", "text", "source", F.col(h).alias("_h")), keep=("_h",)).groupBy(F.col("doc_id").alias(ident), F.col("_h").alias(h2)).agg(*[F.max(c).alias(c) for c in added[:3]], F.sum("taken").alias(words_in_all), F.count("*").alias(n))
    mixed = durable(mixed.filter(F.col(words_in_all) > 0))
    rows = keyed.join(mixed, keyed["doc_id"].eqNullSafe(mixed[ident]) & (keyed[h] == mixed[h2]))
    if not mixed.filter(F.col(n) > 1).isEmpty():
        rows = rows.dropDuplicates(["doc_id", h])
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(words_in_all) / F.col("size")) - 1)))
    rows = rows.withColumn("taken", F.least("size", F.col(words_in_all) - F.col("epoch") * F.col("size")))
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + mixing.TOKEN), F.lit(0)), F.lit(1), F.col("taken").cast("int"))
    rows = rows.withColumn("text", F.when(F.col("taken") < F.col("size"), F.array_join(words, "")).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns, *added)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("benchmark_decontamination", drop_contaminated), ("pii", replace_pii), ("mixing", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs


#: The first stages (a trained classifier, XXH64 fingerprints) can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None
