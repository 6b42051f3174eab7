"""Session windows and ranking: recency, latest rows, memory states, budgets, pages, folds, keyed logs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators.folds import fold

PRESERVED, LOW_VALUE = ["landmark", "user_correction", "evidence_table", "conversation_frame"], ["system", "tool"]
ALPHA = 0.25


def next_turn(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg((F.max("turn_index") + 1).cast("long").alias("next_turn"))


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The newest n messages of each session, with their place from the oldest of them."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("turn_index"), F.desc("role"))
    kept = messages.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("_r"))).cast("long")).drop("_r")


def latest(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key by `order`: the latest-wins view of an append log."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def memory_state(doc_type: Column, supported: Column, turn: Column, current: Column, importance: Column, role: Column, working_turns: int = 8, least: float = 0.25) -> Column:
    """promoted, episodic, working or evicted. A null turn counts as -1, turn 0 is a turn."""
    turn = F.coalesce(turn, F.lit(-1))
    return F.when(doc_type.isin(PRESERVED) | F.coalesce(supported, F.lit(False)), "promoted").when(doc_type == "episodic_summary", "episodic").when(turn >= F.greatest(F.lit(0), current - max(1, working_turns)), "working").when((F.coalesce(importance, F.lit(0.0)) < least) | F.coalesce(role.isin(LOW_VALUE), F.lit(False)), "evicted").otherwise("episodic")


def evidence_supported(flag: Column | None = None, pinned: Column | None = None, statuses: Column | None = None) -> Column:
    """Whether a row is kept for its evidence: flagged, pinned, or with an entailed claim among the statuses of its claims."""
    out = F.lit(False)
    for c in (flag, pinned):
        out = out if c is None else out | F.coalesce(c, F.lit(False))
    return out if statuses is None else out | F.coalesce(F.array_contains(statuses, "entailed"), F.lit(False))


def with_states(messages: DataFrame, working_turns: int = 8, least: float = 0.25, supported: Column | None = None) -> DataFrame:
    """messages with memory_state; supported: rows that evidence promotes (none, if not given)."""
    current = F.max(F.coalesce("turn_index", F.lit(-1))).over(Window.partitionBy("session_id"))
    return messages.withColumn("memory_state", memory_state(F.col("doc_type"), F.lit(False) if supported is None else supported, F.col("turn_index"), current, F.col("importance"), F.col("role"), working_turns, least))


def relevance_bonus(text: Column, query: Column) -> Column:
    """Up to 0.45 for the share of the query's terms that the text has."""
    q = T.important_terms(query, 12)
    return F.least(F.lit(0.45), F.size(F.array_intersect(q, T.important_terms(text, 14))) / F.greatest(F.lit(4), F.size(q)) * 0.9)


def priority(state: Column, importance: Column, turn: Column, current: Column, working_turns: int, supported: Column | None = None, reward: Column | None = None, relevance: Column | None = None) -> Column:
    """A row's place in the working set: by state, importance and age, with bonuses for evidence, reward and relevance where given."""
    bonus = F.when(state == "promoted", 1.0).when(state == "working", 0.65).when(state == "episodic", 0.45).when(state == "evicted", 0.0).otherwise(0.25)
    age = F.greatest(F.lit(0), current - turn)
    total = bonus + 0.55 * F.coalesce(importance, F.lit(0.0)) + 0.35 / (1.0 + age / max(1, working_turns))
    if supported is not None:
        total += F.when(supported, 0.25).otherwise(0.0)
    if reward is not None:
        total += F.greatest(F.lit(0.0), F.least(F.lit(0.2), 0.2 * F.coalesce(reward, F.lit(0.0))))
    return F.round(total if relevance is None else total + relevance, 4)


def fitting(rows: DataFrame, key: str, order: list[Column], cost: Column, keep: list[str], budget: int) -> DataFrame:
    """Rows of each key that a greedy pass by `order` takes: each one that still fits. The fold holds small structs, not texts."""
    item = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], cost.cast("long").alias("cost"), *keep)
    ordered = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.slice(F.col("xs"), 1, 0).alias("out"))
    step = lambda s, x: F.when(s["used"] + x["cost"] <= budget, F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s)
    return ordered.select(key, F.explode(F.aggregate("xs", empty, step, lambda s: s["out"])).alias("x")).select(key, *[f"x.{c}" for c in keep], "x.cost")


def working_set(messages: DataFrame, budget: int, working_turns: int = 8, supported: Column | None = None, reward: Column | None = None, questions: DataFrame | None = None) -> DataFrame:
    """The messages of each session kept under a token budget: promoted rows first, then working and episodic ones by priority.

    supported: rows that evidence promotes and lifts; reward: of a row, null for none; questions (session_id, question): the session's
    request, whose terms lift rows that share them. Sessions without a question, or with an empty one, get no such bonus.
    """
    rows = with_states(messages, working_turns, supported=supported).filter("memory_state <> 'evicted'")
    relevance = None
    if questions is not None:
        rows = rows.join(questions.select("session_id", F.col("question").alias("_question")), "session_id", "left")
        relevance = relevance_bonus(F.coalesce("text", F.lit("")), F.coalesce("_question", F.lit("")))
    current = F.max("turn_index").over(Window.partitionBy("session_id"))
    rows = rows.withColumn("priority", priority(F.col("memory_state"), F.col("importance"), F.col("turn_index"), current, working_turns, supported, reward, relevance))
    promoted = F.col("memory_state") == "promoted"
    order = [F.when(promoted, 0).otherwise(1), -F.col("priority"), F.when(promoted, -F.coalesce("importance", F.lit(0.0))), -F.col("turn_index")]
    return fitting(rows, "session_id", order, T.tokens(F.col("text")), ["turn_index", "memory_state", "priority"], budget)


def legacy_recent(messages: DataFrame, budget: int, turns: int) -> DataFrame:
    """The plain policy: of the newest messages each that still fits, newest first."""
    rows = messages.filter(F.col("role").isin("user", "assistant")).withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_index")))).filter(F.col("_r") <= max(1, 2 * turns))
    return fitting(rows, "session_id", [F.col("_r")], T.tokens(F.col("text")), ["turn_index"], budget)


def prefix_under_budget(rows: DataFrame, key: str, order: list, cost: Column, budget: int) -> DataFrame:
    """Rows up to the first that exceeds the budget; at least one of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("cost", cost).withColumn("_used", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w)).filter((F.col("_used") <= budget) | (F.col("_n") == 1)).drop("_used", "_n")


def page_after(rows: DataFrame, cursor: tuple | None, n: int) -> DataFrame:
    """A page of n rows, newest first by (ts, event_id), after the cursor (keyset paging)."""
    if cursor:
        ts, i = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
        rows = rows.filter((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("event_id") < i)))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def carried_flag(rows: DataFrame, key: str, order: list, flag: Column, out: str) -> DataFrame:
    """Whether the flag was set in any earlier row of the key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.max(flag.cast("int")).over(w) == 1, F.lit(False)))


def obeys_correction(answer: Column, terms: Column) -> Column:
    """Whether an answer names all terms of a correction, in either case; it does where there are none."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.coalesce(F.forall(terms, lambda t: F.contains(low, F.lower(t))), F.lit(True))


def supported_claims(claims: DataFrame, session: str, n: int) -> DataFrame:
    """(session, rank, turn_index, claim, evidence_id, score): entailed claims as later evidence, newest turn first, each text once.

    claims: (session, turn_index, place, claim, status, entailment). Blank claims are passed over; of a text that repeats, its newest turn's counts.
    """
    rows = claims.filter("status = 'entailed'").withColumn("claim", F.trim("claim")).filter("claim <> ''")
    newest = F.min(F.struct((-F.col("turn_index")).alias("t"), "place", F.coalesce("entailment", F.lit(0.0)).alias("score"))).alias("x")
    rows = rows.groupBy(session, "claim").agg(newest).withColumn("evidence_id", F.concat(F.lit("prior_claim_"), T.stable_id(F.col("claim"))))
    w = Window.partitionBy(session).orderBy("x.t", "x.place", "claim")
    rows = rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
    return rows.select(session, "rank", (-F.col("x.t")).alias("turn_index"), "claim", "evidence_id", F.col("x.score").alias("score"))


#: Rows of a key that are folded as one array; longer keys are streamed (operators.folds).
ARRAY_ROWS = 50_000


def action_values(events: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(scope, state_key, action, visits, q_value, reward_sum, reward_avg): an ordered fold, rounded to 6 places at each step.

    Keys of up to ARRAY_ROWS rows are folded as arrays, longer ones row by row with a state that is handed from partition to partition."""
    keys = ["scope", "state_key", "action"]
    rows = events.filter("reward IS NOT NULL").select(*keys, "ts", "event_id", "reward")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    long_ = sizes.filter(F.col("_n") > ARRAY_ROWS).select(*keys, F.lit(True).alias("_long"))
    six = lambda x: F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
    out = folded_arrays(rows, keys, alpha)
    if not long_.isEmpty():
        same = F.lit(True)
        for k in keys:
            same = same & rows[k].eqNullSafe(long_[k])
        out = folded_arrays(rows.join(long_, same, "left_anti"), keys, alpha).unionByName(streamed(rows.join(long_, same, "left_semi"), keys, alpha))
    return out.withColumn("reward_avg", six(F.col("reward_sum") / F.col("visits")))


def folded_arrays(rows: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    ordered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "reward"))).alias("xs"))
    start = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("s"))
    six = lambda x: F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
    step = lambda a, x: F.struct(six(a["q"] + F.lit(alpha) * (x["reward"] - a["q"])).alias("q"), six(a["s"] + x["reward"]).alias("s"))
    folded = ordered.withColumn("f", F.aggregate("xs", start, step))
    return folded.select(*keys, F.size("xs").cast("long").alias("visits"), F.col("f.q").alias("q_value"), F.col("f.s").alias("reward_sum"))


def streamed(rows: DataFrame, keys: list[str], alpha: float, partitions: int | None = None) -> DataFrame:
    def step(state, row):
        from math import floor

        n, q, s = state
        return (n + 1, floor((q + alpha * (row["reward"] - q)) * 1e6 + 0.5) / 1e6, floor((s + row["reward"]) * 1e6 + 0.5) / 1e6), ()

    return fold(rows, keys, ["ts", "event_id"], lambda: (0, 0.0, 0.0), step, "visits long, q_value double, reward_sum double", partitions=partitions)


def best_actions(values: DataFrame) -> DataFrame:
    """The action with the best value of each (scope, state); ties by visits, then the smaller action."""
    best = values.groupBy("scope", "state_key").agg(F.max_by(F.struct("action", "q_value", "visits"), F.struct("q_value", "visits", -F.col("action"))).alias("x"))
    return best.select("scope", "state_key", "x.*")


def folded_changes(log: DataFrame, keys: list[str], order: list, columns: list[str], deleted: str) -> DataFrame:
    """The state that a log of partial updates leaves: the last value of each column that isn't null; tombstoned keys go."""
    w = Window.partitionBy(*keys).orderBy(*order)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = log.withColumns({c: F.last(c, True).over(full) for c in [*columns, deleted]}).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return rows.filter(~F.coalesce(F.col(deleted), F.lit(False))).select(*keys, *columns)


def episodes(messages: DataFrame, key: list[str], max_facts: int = 6) -> DataFrame:
    """A summary of each episode (key): first and last turn, focus terms, facts (its supported messages in order, else those of most
    importance), n_supported and importance.

    messages: key, turn_index, role, text, importance, supported, reward (the episode's). A task holds one episode's texts.
    """
    text = F.transform("x", lambda m: F.coalesce(m["text"], F.lit("")))
    g = messages.groupBy(*key).agg(F.min("turn_index").alias("first_turn"), F.max("turn_index").alias("last_turn"), F.count("*").alias("n"), F.count_if("supported").alias("n_supported"), F.max("reward").alias("_reward"), F.array_sort(F.collect_list(F.struct("turn_index", "role", "text", "importance", "supported"))).alias("x"))
    best = F.slice(F.reverse(F.array_sort(F.transform("x", lambda m: F.struct(m["importance"].alias("i"), m["turn_index"].alias("t"), m["role"].alias("role"), m["text"].alias("text"))))), 1, max_facts)
    line = lambda m: F.concat(m["role"], F.lit(": "), F.substring(F.coalesce(m["text"], F.lit("")), 1, 260))
    facts = F.when(F.col("n_supported") > 0, F.transform(F.slice(F.filter("x", lambda m: m["supported"]), 1, max_facts), line)).otherwise(F.transform(best, line))
    score = F.greatest(F.lit(0.4), F.least(F.lit(1.0), 0.45 + 0.35 * F.coalesce("_reward", F.lit(0.0)) + 0.05 * F.col("n_supported")))
    return g.select(*key, "first_turn", "last_turn", "n", T.important_terms(F.array_join(text, " "), 18).alias("focus"), facts.alias("facts"), "n_supported", F.round(score, 4).alias("importance"))
