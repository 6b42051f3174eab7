"""Joins and aggregates over triples: lookups, subgraphs, the entity graph, evidence union, ideas, term promotion, near-duplicate gate."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T


def looked_up(selection: DataFrame, sentences: DataFrame, papers: DataFrame) -> DataFrame:
    """Selected (doc_id, pos) with sentence and the paper's source; a selection without a match is left out."""
    return selection.join(sentences, ["doc_id", "pos"]).join(papers, "doc_id")


def subgraph(triples: DataFrame, ids: DataFrame, confidence_min: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of chosen triples that are sure enough."""
    e = triples.join(ids, "triple_id", "left_semi").filter(F.col("confidence") >= confidence_min).select("triple_id", F.col("subject").alias("source"), "relation", F.col("object").alias("target"), "confidence")
    return e.select(F.col("source").alias("name")).union(e.select("target")).distinct(), e


def entity_graph(triples: DataFrame) -> DataFrame:
    """(name, type, degree): every entity once; its type is that of its latest triple (by doc_id, pos), subjects before objects."""
    ends = triples.select(F.explode(F.array(F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("type"), F.lit(0).alias("side")), F.struct(F.col("object").alias("name"), F.col("object_type").alias("type"), F.lit(1).alias("side")))).alias("x"), "doc_id", "pos")
    return ends.groupBy("x.name").agg(F.max_by("x.type", F.struct("doc_id", "pos", -F.col("x.side"))).alias("type"), F.count("*").alias("degree"))


def entity_edges(triples: DataFrame, text_most: int = 1000) -> DataFrame:
    """(source, target, triple_id, relation, article_id, confidence, sentence_text): one edge for each subject, object and triple id, as
    its latest triple (by doc_id, pos) has it; the sentence is cut to text_most characters. Rows without an end or id make no edge.

    Whole rows of an edge compete in an aggregate, so a triple that repeats often is cut down before the shuffle.
    """
    kept = triples.filter("subject IS NOT NULL AND object IS NOT NULL AND triple_id IS NOT NULL")
    values = F.struct("relation", "article_id", "confidence", F.substring("sentence_text", 1, text_most).alias("sentence_text"))
    edges = kept.groupBy(F.col("subject").alias("source"), F.col("object").alias("target"), "triple_id").agg(F.max_by(values, F.struct("doc_id", "pos")).alias("x"))
    return edges.select("source", "target", "triple_id", "x.*")


def updated_edges(edges: DataFrame, triples: DataFrame, text_most: int = 1000) -> DataFrame:
    """A stored edge table after a batch of triples: the batch's edges replace those of the same ends and triple id, others stay."""
    new = entity_edges(triples, text_most)
    return edges.join(new, ["source", "target", "triple_id"], "left_anti").unionByName(new)


def evidence_union(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(evidence_id, source, text): rows (doc_id, pos, text) of several sources, one of each id; earlier sources win."""
    out = None
    for i, (name, df) in enumerate(parts):
        rows = df.select(T.stable_id(F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.substring("text", 1, 240), prefix="ev_").alias("evidence_id"), F.lit(name).alias("source"), F.lit(i).alias("_p"), "text")
        out = rows if out is None else out.unionByName(rows)
    w = Window.partitionBy("evidence_id").orderBy("_p", "text")
    return out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("evidence_id", "source", "text")


def first_source(parts: list[DataFrame], key: str) -> DataFrame:
    """For each key the rows of the first source that has any."""
    out = None
    for i, df in enumerate(parts):
        df = df.withColumn("priority", F.lit(i))
        out = df if out is None else out.unionByName(df)
    best = out.groupBy(key).agg(F.min("priority").alias("priority"))
    return out.join(best, [key, "priority"])


def idea_statistics(turns: DataFrame) -> DataFrame:
    """(idea, frequency, sessions, reward_avg, importance). turns: (session_id, turn_index, reward, ideas: array, distinct in a turn)."""
    rows = turns.select("session_id", "reward", F.explode(F.array_distinct("ideas")).alias("idea"))
    g = rows.groupBy("idea").agg(F.count("*").alias("frequency"), F.count_distinct("session_id").alias("sessions"), F.round(F.avg("reward"), 6).alias("reward_avg"))
    score = 0.40 * F.log1p("frequency") / F.log(F.lit(33.0)) + 0.30 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("reward_avg"))) + 0.20
    return g.withColumn("importance", F.round(F.least(F.lit(1.0), score), 4))


def cooccurrence(turns: DataFrame, most: int = 24, least: int = 2) -> DataFrame:
    """(idea, other, n): ideas that share turns. A turn's list is cut to its first `most` ideas by the extraction, so its pairs are bounded."""
    ideas = turns.select(F.slice(F.array_sort(F.array_distinct("ideas")), 1, most).alias("i"))
    pairs = ideas.select("i", F.posexplode("i").alias("p", "idea")).select("idea", F.explode(F.slice("i", F.col("p") + 2, most)).alias("other"))
    return pairs.groupBy("idea", "other").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def promoted_terms(outcomes: DataFrame, known: DataFrame, least_rate: float, least_updates: int, least_runs: int) -> DataFrame:
    """(term, runs): terms that did well in enough runs and aren't known. outcomes: (run, term, ok)."""
    per = outcomes.groupBy("run", "term").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("rate")).filter((F.col("n") >= least_updates) & (F.col("rate") >= least_rate))
    return per.groupBy("term").agg(F.count("*").alias("runs")).filter(F.col("runs") >= least_runs).join(known, "term", "left_anti")


def provider_summary(calls: DataFrame) -> DataFrame:
    """(name, calls, success, failure, mean_value, last_status) of a call log (name, ts, event_id, ok, value, status)."""
    return calls.groupBy("name").agg(F.count("*").alias("calls"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failure"), F.round(F.avg("value"), 4).alias("mean_value"), F.max_by("status", F.struct("ts", "event_id")).alias("last_status"))


def term_beta(outcomes: DataFrame) -> DataFrame:
    """(scope, term, alpha, beta, updates, mean): successes go to alpha, failures to beta, both from 1; terms with one update are left out."""
    g = outcomes.groupBy("scope", "term").agg(F.round(1 + F.sum(F.greatest(F.lit(0.0), F.col("utility"))), 6).alias("alpha"), F.round(1 + F.sum(F.greatest(F.lit(0.0), -F.col("utility"))), 6).alias("beta"), F.count("*").alias("updates"))
    return g.filter("updates >= 2").withColumn("mean", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 6))
