"""Replay of two context policies over stored sessions: the newest messages under a budget, and a working set by priority."""

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators import rewards as R
from lodestone.operators import windows as W

PICKED = "session_id long, turn_index int, m_turn int, role string, text string, cost long, compressed boolean, promoted boolean"


def estimate(text: str) -> int:
    """The token estimate of functions.text.tokens, of one string."""
    text = text.strip()
    return max(1, math.ceil(1.25 * len(text.split())), math.ceil(len(text) / 4)) if text else 0


def shortened(text: str, budget: int) -> str:
    """The text within a token budget: leading sentences that fit, and its terms; else its first words."""
    text = " ".join(text.split())
    if estimate(text) <= budget:
        return text
    kept, used = [], 0
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        if used >= 0.75 * budget:
            break
        if used + estimate(sentence) <= max(8, budget - 8):
            kept.append(sentence)
            used += estimate(sentence)
    words = [w.lower() for w in re.findall(T.TERM, text)]
    focus = "Focus: " + ", ".join(list(dict.fromkeys(w for w in words if w not in T.STOP))[:8])
    if len(focus) > 7 and estimate(" ".join([*kept, focus])) <= budget:
        kept.append(focus + ".")
    words = " ".join(kept).split() or text.split()[: max(8, int(budget / 1.25))]
    while words and estimate(" ".join(words)) > budget:
        words.pop()
    return " ".join(words)


def picked(budget: int, least: int = 24):
    """An applyInPandas function over one turn's candidates: each that fits, in order of rank; of others what `least` tokens and more can hold."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = budget, []
        for r in rows.sort_values("place").itertuples():
            text = r.text or ""
            if (packed := estimate(text) > left) and left >= least:
                text = shortened(text, left)
            n = estimate(text)
            if n > left or (packed and not text):
                continue
            left -= n
            out.append((r.session_id, r.turn_index, r.m_turn, r.role, text, n, packed, r.memory_state == "promoted"))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PICKED.split(", ")])

    return run


def working_context(messages: DataFrame, pairs: DataFrame, budget: int, working_turns: int) -> DataFrame:
    """The rows (PICKED) that the working set holds before each turn of pairs (session_id, turn_index, question).

    A session's messages meet its later turns, so work grows with the square of a session's length, as in any replay; a task holds
    one turn's candidates. Promoted rows come first, then working and episodic ones by priority.
    """
    m = messages.withColumnRenamed("turn_index", "m_turn")
    rows = m.join(pairs.select("session_id", "turn_index", "question"), "session_id").filter((F.col("m_turn") >= 0) & (F.col("m_turn") < F.col("turn_index")))
    state = W.memory_state(F.col("doc_type"), F.lit(False), F.col("m_turn"), F.col("turn_index"), F.col("importance"), F.col("role"), working_turns)
    rows = rows.withColumn("memory_state", state).filter("memory_state <> 'evicted'")
    rows = rows.withColumn("priority", W.priority(F.col("memory_state"), F.col("importance"), F.col("m_turn"), F.col("turn_index"), working_turns, relevance=W.relevance_bonus(F.col("text"), F.col("question"))))
    order = [F.when(F.col("memory_state") == "promoted", 0).otherwise(1), F.desc("priority"), F.desc(F.when(F.col("memory_state") == "promoted", F.col("importance"))), F.desc("m_turn"), "role"]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("session_id", "turn_index").orderBy(*order)))
    rows = rows.select("session_id", "turn_index", "m_turn", "role", "text", "memory_state", "place")
    return rows.groupBy("session_id", "turn_index").applyInPandas(picked(budget), PICKED)


def recent_context(messages: DataFrame, pairs: DataFrame, budget: int, turns: int) -> DataFrame:
    """The rows (PICKED) that the plain policy holds before each turn: of the newest 2 * turns messages each that still fits."""
    own = Window.partitionBy("session_id").orderBy("turn_index", "role")
    m = messages.filter(F.col("role").isin("user", "assistant") & (F.col("turn_index") >= 0)).withColumn("_n", F.row_number().over(own))
    before = m.join(pairs.select("session_id", "turn_index"), ["session_id", "turn_index"]).filter("role = 'user'")
    slots = before.select("session_id", "turn_index", F.explode(F.sequence(F.col("_n") - 1, F.col("_n") - max(1, 2 * turns))).alias("_n")).filter("_n > 0")
    rows = slots.join(m.withColumnRenamed("turn_index", "m_turn"), ["session_id", "_n"]).filter("m_turn < turn_index").withColumn("key", F.struct("session_id", "turn_index"))
    kept = W.fitting(rows, "key", [-F.col("_n")], T.tokens(F.col("text")), ["_n"], budget).select("key.*", "_n", "cost")
    return kept.join(m.withColumnRenamed("turn_index", "m_turn"), ["session_id", "_n"]).select("session_id", "turn_index", "m_turn", "role", "text", "cost", F.lit(False).alias("compressed"), F.lit(False).alias("promoted"))


def replayed(messages: DataFrame, budget: int, working_turns: int = 8) -> DataFrame:
    """A row for each user turn with an answer and each policy (baseline, current): reward terms, context tokens and counts.

    messages: (session_id, turn_index, doc_type, role, text, importance).
    """
    pairs = R.pairs(messages)
    rows = recent_context(messages, pairs, budget, working_turns).withColumn("policy", F.lit("baseline")).unionByName(working_context(messages, pairs, budget, working_turns).withColumn("policy", F.lit("current")))
    context = rows.groupBy("session_id", "turn_index", "policy").agg(F.array_sort(F.collect_list(F.struct("m_turn", "role", "text"))).alias("c"), F.sum("cost").alias("context_tokens"), F.count_if("compressed").alias("compressed"), F.count_if("promoted").alias("promoted"))
    both = pairs.withColumn("policy", F.explode(F.array(F.lit("baseline"), F.lit("current")))).join(context, ["session_id", "turn_index", "policy"], "left")
    both = both.withColumn("context", F.coalesce(F.transform("c", lambda x: F.coalesce(x["text"], F.lit(""))), F.array().cast("array<string>"))).na.fill(0, ["context_tokens", "compressed", "promoted"])
    return R.reward_report(both.withColumn("messages", F.col("context")), budget).select("session_id", "turn_index", "policy", "score", "support", "alignment", "off_topic", "context_tokens", "compressed", "promoted")


def replay_summary(messages: DataFrame, budget: int, working_turns: int = 8) -> DataFrame:
    """A row for each session, and one in all (session_id null): means of both policies over its turn pairs, and their differences."""
    values = ["score", "support", "alignment", "off_topic", "context_tokens", "compressed", "promoted"]
    rows = replayed(messages, budget, working_turns)
    of = lambda p, c: F.round(F.avg(F.when(F.col("policy") == p, F.col(c))), 4)
    g = rows.rollup("session_id").agg(F.count_if(F.col("policy") == "current").alias("turn_pairs"), *[of(p, c).alias(f"{p}_{c}") for p in ("baseline", "current") for c in values])
    return g.select("session_id", "turn_pairs", *[f"{p}_{c}" for p in ("baseline", "current") for c in values], *[F.round(F.col(f"current_{c}") - F.col(f"baseline_{c}"), 4).alias(f"{c}_delta") for c in values[:4]])
