"""Rewards of turns and runs: reward terms, step rewards, replay of policies, weighted scores, penalties, reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T


def pairs(messages: DataFrame) -> DataFrame:
    """(session_id, turn_index, question, answer): each user turn with the assistant turn right after it."""
    u = messages.filter("role = 'user'").select("session_id", "turn_index", F.col("text").alias("question"))
    a = messages.filter("role = 'assistant'").select("session_id", (F.col("turn_index") - 1).alias("turn_index"), F.col("text").alias("answer"))
    return u.join(a, ["session_id", "turn_index"])


# The weights of a turn's reward, and of the means over its retrieval steps.
WEIGHTS = {
    "relevance": 0.22,
    "support": 0.24,
    "factuality": 0.14,
    "citation_coverage": 0.16,
    "alignment": 0.08,
    "frame_alignment": 0.06,
    "sentiment_gain": 0.05,
    "has_context": 0.08,
    "conflict_free": 0.08,
    "assembly_quality": 0.03,
    "claim_contradiction": -0.20,
    "unsupported": -0.10,
    "off_topic": -0.10,
    "frame_drift": -0.10,
    "prior_conflict": -0.15,
    "longitudinal": -0.08,
    "query_drift": -0.08,
    "unsupported_bridge": -0.10,
    "latency": -0.05,
    "tokens": -0.05,
}
STEP_GAP, STEP_DISTRACTORS = 0.04, -0.04
#: Columns of a turn that reward_report takes where they are there; missing ones and nulls count as nothing.
FEATURES = ["entailment_avg", "contradiction_avg", "n_claims", "n_entailed", "n_contradicted", "n_unsupported", "n_conflicts", "frame_alignment", "frame_drift", "n_prior_conflicts", "longitudinal", "assembly_quality", "n_feedback_accepted", "n_ungrounded", "edge_support", "elapsed_sec", "gap_closure", "distractor_ratio"]


def gap_closure(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, gap_closure): the share of what was missing before a retrieval step that is confirmed after it (4 places); 0 if nothing was.

    before, after: (query_id, confirmed, missing), as retrieval.gap_record gives them."""
    rows = before.select("query_id", "missing").join(after.select("query_id", "confirmed"), "query_id", "left")
    closed = F.size(F.array_intersect("missing", F.coalesce("confirmed", F.array().cast("array<string>"))))
    return rows.select("query_id", F.when(F.size("missing") > 0, F.round(closed / F.size("missing"), 4)).otherwise(0.0).alias("gap_closure"))


def support_of(answer: Column, context: Column, messages: Column) -> Column:
    """The best overlap of the answer with all context texts, with the messages among them, or with one text."""
    one = F.array_max(F.transform(context, lambda x: T.lexical_overlap(answer, x)))
    return F.greatest(T.lexical_overlap(answer, F.array_join(context, "\n")), T.lexical_overlap(answer, F.array_join(messages, "\n")), F.coalesce(one, F.lit(0.0)))


def alignment_of(question: Column, answer: Column, context: Column) -> Column:
    """The share of the question's terms that the answer or a context text has."""
    q = T.important_terms(question, 40)
    seen = F.array_union(T.important_terms(answer, 80), F.flatten(F.transform(context, lambda x: T.important_terms(x, 80))))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, seen)) / F.size(q))


def off_topic_of(question: Column, answer: Column, context: Column, mechanistic: list[str] | None = None, pharmacology: list[str] | None = None) -> Column:
    """The penalty for pharmacology in the answer to a question about mechanisms that doesn't ask for it."""
    topic, foreign = mechanistic or [*T.MECHANISTIC, *T.MECHANISTIC_GENERIC], pharmacology or T.PHARMACOLOGY
    asks = (T.hits(question, topic) > 0) | F.contains(F.lower(question), F.lit("functional synergy"))
    own = T.hits(answer, foreign)
    total = own + F.when(own > 0, 0.25 * T.hits(F.array_join(context, " "), foreign)).otherwise(0.0)
    return F.when(asks & (T.hits(question, T.ASKS_PHARMACOLOGY) == 0) & (T.hits(question, foreign) == 0), F.round(F.least(F.lit(1.0), total / 4.0), 4)).otherwise(0.0)


def reward_report(turns: DataFrame, budget: int, mechanistic: list[str] | None = None, pharmacology: list[str] | None = None) -> DataFrame:
    """turns with score and its 20 terms (WEIGHTS), rounded to 4 places: weighted, with the step rewards, and clamped to 0..1.

    turns: question, answer, context and messages (arrays of texts; the second those of the context that are messages), and any of
    FEATURES. edge_support: missing, partial or other. Columns that clash with the added ones are replaced.
    """
    have = lambda c, kind="double": F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)) if c in turns.columns else F.lit(0).cast(kind)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    q, a, ctx = F.col("question"), F.col("answer"), F.col("context")
    claims = F.greatest(F.lit(1.0), have("n_claims"))
    share = lambda c: F.when(have("n_claims") > 0, have(c) / claims).otherwise(0.0)
    edge = F.col("edge_support") if "edge_support" in turns.columns else F.lit("")
    bridge = F.when((have("n_unsupported") > 0) & (have("n_claims") > 0), F.when(edge == "missing", share("n_unsupported")).when(edge == "partial", 0.5 * share("n_unsupported")))
    terms = {
        "relevance": T.lexical_overlap(q, a),
        "support": support_of(a, ctx, F.col("messages")),
        "factuality": unit(have("entailment_avg") - have("contradiction_avg")),
        "citation_coverage": share("n_entailed"),
        "alignment": alignment_of(q, a, ctx),
        "frame_alignment": have("frame_alignment"),
        "sentiment_gain": F.greatest(F.lit(0.0), T.sentiment(a) - T.sentiment(q)),
        "has_context": F.when(F.size(ctx) > 0, 1.0).otherwise(0.25),
        "conflict_free": 1.0 - F.least(F.lit(1.0), 0.35 * have("n_conflicts")),
        "assembly_quality": unit(have("assembly_quality")),
        "claim_contradiction": share("n_contradicted"),
        "unsupported": share("n_unsupported"),
        "off_topic": off_topic_of(q, a, ctx, mechanistic, pharmacology),
        "frame_drift": have("frame_drift"),
        "prior_conflict": F.least(F.lit(1.0), have("n_prior_conflicts") / 2.0),
        "longitudinal": have("longitudinal"),
        "query_drift": F.least(F.lit(1.0), have("n_ungrounded") / F.greatest(F.lit(1.0), have("n_feedback_accepted") + have("n_ungrounded"))),
        "unsupported_bridge": F.least(F.lit(1.0), F.coalesce(bridge, F.lit(0.0))),
        "latency": F.least(F.lit(1.0), have("elapsed_sec") / 30.0),
        "tokens": F.least(F.lit(1.0), F.floor(F.length(a) / 4) / F.lit(float(max(1, budget)))),
    }
    rows = turns.withColumns({f"_t_{k}": v for k, v in terms.items()})
    score = sum((F.lit(w) * F.col(f"_t_{k}") for k, w in WEIGHTS.items()), F.lit(0.0))
    if {"gap_closure", "distractor_ratio"} & set(turns.columns):
        score = unit(score + STEP_GAP * have("gap_closure") + STEP_DISTRACTORS * have("distractor_ratio"))
    rows = rows.withColumn("score", F.round(unit(score), 4)).withColumns({k: F.round(f"_t_{k}", 4) for k in terms})
    return rows.drop(*[f"_t_{k}" for k in terms])


def context_support(pairs_: DataFrame, context: DataFrame) -> DataFrame:
    """pairs with support (best overlap of the answer with one context row, or with all) and n_context.

    context: (session_id, turn_index of the pair, text).
    """
    joined = pairs_.select("session_id", "turn_index", "answer").join(context.select("session_id", "turn_index", "text"), ["session_id", "turn_index"])
    best = joined.groupBy("session_id", "turn_index").agg(F.max(T.lexical_overlap(F.col("answer"), F.col("text"))).alias("support"), F.count("*").alias("n_context"))
    return pairs_.join(best, ["session_id", "turn_index"], "left").na.fill(0.0, ["support"]).na.fill(0, ["n_context"])


def query_novelty(queries: DataFrame, key: str, order: str) -> DataFrame:
    """The share of each query's terms that no earlier query of the key had; 1 for the first. A term's first place decides."""
    t = queries.select(key, order, F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"))
    first = t.withColumn("_f", F.min(order).over(Window.partitionBy(key, "term")))
    share = first.groupBy(key, order).agg(F.round(F.count_if(F.col("_f") == F.col(order)) / F.count("*"), 4).alias("novelty"))
    lead = queries.groupBy(key).agg(F.min(order).alias("_lead"))
    return queries.select(key, order).join(share, [key, order], "left").join(lead, key).select(key, order, F.when(F.col(order) == F.col("_lead"), 1.0).otherwise(F.coalesce("novelty", F.lit(0.0))).alias("novelty"))


def distractors(hits: DataFrame, anchors: DataFrame) -> DataFrame:
    """(query_id, distractor_ratio): the share of hits (query_id, doc, text) that hold none of the query's anchors."""
    m = hits.join(anchors, "query_id", "left").groupBy("query_id", "doc").agg(F.max(F.coalesce(F.contains(F.lower("text"), F.col("anchor")), F.lit(False))).alias("ok"))
    return m.groupBy("query_id").agg(F.round(F.count_if(~F.col("ok")) / F.count("*"), 4).alias("distractor_ratio"))


def weighted(scores: DataFrame, weights: DataFrame, penalties: DataFrame, key: str) -> DataFrame:
    """(key, score): weighted components (key, component, value) minus the capped penalties (key, type, amount), clamped to 0..1.

    weights: (component, weight), a configuration table.
    """
    good = scores.join(weights, "component").groupBy(key).agg(F.sum(F.col("value") * F.col("weight")).alias("good"))
    bad = capped(penalties, key).groupBy(key).agg(F.sum("amount").alias("bad"))
    total = F.col("good") - F.coalesce("bad", F.lit(0.0))
    return good.join(bad, key, "left").select(key, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4).alias("score"))


def capped(penalties: DataFrame, key: str) -> DataFrame:
    """One penalty of each type: the largest, with the number of them."""
    return penalties.groupBy(key, "type").agg(F.max("amount").alias("amount"), F.count("*").alias("n"))


def compared(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta) of two runs; keys of either."""
    x, y = a.select(key, F.col(value).alias("before")), b.select(key, F.col(value).alias("after"))
    return x.join(y, key, "full").withColumn("delta", F.round(F.col("after") - F.col("before"), 4))


def frame_alignment(frames: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """Keys with alignment and drift: hits of the frame's active and avoided terms in the answer."""
    rows = answers.join(frames, key).withColumn("t", F.array_distinct(T.terms(F.col("answer"))))
    hit = lambda c: F.size(F.array_intersect("t", c))
    drift = F.least(F.lit(1.0), hit("avoided") / 4.0)
    return rows.select(*key, F.round(F.least(F.lit(1.0), hit("active") / F.greatest(F.lit(1), F.least(F.size("active"), F.lit(12)))), 4).alias("alignment"), F.round(F.when((F.size("active") > 0) & (hit("active") == 0), F.greatest(drift, F.lit(0.25))).otherwise(drift), 4).alias("drift"))


def consistency_report(rows: DataFrame) -> DataFrame:
    """rows (frame_alignment's alignment and drift; n_claims, n_contradicted, n_unsupported, n_prior_conflicts) with the rates of contradicted
    and unsupported claims, the prior-conflict rate, their weighted penalty, and warnings (an array of types)."""
    claims = F.greatest(F.lit(1), "n_claims")
    rate = lambda c: F.least(F.lit(1.0), F.col(c) / claims)
    prior = F.least(F.lit(1.0), F.col("n_prior_conflicts") / 2.0)
    penalty = F.lit(0.35) * rate("n_contradicted") + F.lit(0.20) * rate("n_unsupported") + F.lit(0.25) * prior + F.lit(0.20) * F.col("drift")
    warn = lambda test, name: F.when(test, F.lit(name))
    warnings = F.array_compact(F.array(warn(F.col("drift") > 0, "frame_drift"), warn(F.col("n_contradicted") > 0, "source_contradiction"), warn(F.col("n_prior_conflicts") > 0, "prior_memory_conflict")))
    return rows.withColumns({"contradicted_rate": F.round(rate("n_contradicted"), 4), "unsupported_rate": F.round(rate("n_unsupported"), 4), "prior_conflict_rate": F.round(prior, 4), "penalty": F.round(F.least(F.lit(1.0), penalty), 4), "warnings": warnings})


def run_summary(turns: DataFrame, traps: DataFrame, key: str, failed_below: float) -> DataFrame:
    """A row for each run (key): turns, mean_reward, failed turns (reward below `failed_below`), traps and missed_traps.

    turns: (key, reward); traps: (key, missed), a row for each trap that was set. Runs without traps have none missed.
    """
    t = turns.groupBy(key).agg(F.count("*").alias("turns"), F.round(F.avg("reward"), 6).alias("mean_reward"), F.count_if(F.col("reward") < failed_below).alias("failed"))
    return t.join(traps.groupBy(key).agg(F.count("*").alias("traps"), F.count_if("missed").alias("missed_traps")), key, "left").na.fill(0, ["traps", "missed_traps"])
