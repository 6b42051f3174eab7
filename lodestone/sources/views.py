"""Tables of a data folder, and the views derived from them: sentences, triples, memory rows, turn events."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import terms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(spark, d) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "s"))
    return lines.filter(F.trim("s") != "").select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim("s").alias("sentence"))


def triples(spark, d) -> DataFrame:
    s = sentences(spark, d).withColumn("t", terms(F.col("sentence"))).filter(F.size("t") >= 3)
    p = lambda k: (((F.col("doc_id") * 31 + F.col("pos") * k) % 101) / 100.0).cast("double")
    article = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("PMC"), F.col("doc_id").cast("string"), F.lit(".txt"))).otherwise(F.col("doc_id").cast("string"))
    names = {"s_ebio": 17, "s_ngen": 29, "s_otro": 43, "o_ebio": 59, "o_ngen": 71, "o_otro": 83}
    return s.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("triple_id"), article.alias("article_id"), "doc_id", "pos", F.col("sentence").alias("sentence_text"), *[F.get("t", F.lit(i)).alias(n) for i, n in enumerate(("subject", "relation", "object"))], *[p(k).alias(n) for n, k in names.items()])


def memory_docs(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.lit("message").alias("doc_type"), F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("turn_index"), "role", "text", (((F.col("conv_id") * 7 + F.col("turn") * 13) % 101) / 100.0).cast("double").alias("importance"))


def turn_events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("scope"), F.col("event_type").alias("state_key"), (F.get_json_object("props", "$.k").cast("int") % 10).alias("action"), F.least(F.col("value") / F.lit(200.0), F.lit(1.0)).alias("reward"))
