"""Queries of windows, folds and keyed logs (WIN, UPS) over messages and events."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import stored as S_
from lodestone.operators import windows as W
from lodestone.plans import duck as D
from lodestone.sources import views as V
from lodestone.sources.store import shared

Q, S = {}, {}


def query(name, sql=None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


@query("win01_next_turn", f"WITH {D.MEMORY} SELECT session_id, (max(turn_index) + 1)::BIGINT AS next_turn FROM memory_docs GROUP BY session_id")
def win01(spark, d):
    return W.next_turn(V.memory_docs(spark, d))


@query("win02_recent_messages", f"WITH {D.MEMORY}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC, role DESC) AS k FROM memory_docs) SELECT session_id, turn_index, role, row_number() OVER (PARTITION BY session_id ORDER BY k DESC) AS place FROM r WHERE k <= 4")
def win02(spark, d):
    return W.recent(V.memory_docs(spark, d), 4).select("session_id", "turn_index", "role", "place")


@query("win03_latest_by_type", f"WITH {D.EVENTS} SELECT scope, state_key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY scope, state_key ORDER BY ts DESC, event_id DESC) AS r FROM turn_events) WHERE r = 1")
def win03(spark, d):
    return W.latest(V.turn_events(spark, d), ["scope", "state_key"], [F.desc("ts"), F.desc("event_id")]).select("scope", "state_key", "event_id")


FOLD = f"""{D.EVENTS}, o AS (SELECT scope, state_key, action, list(reward ORDER BY ts, event_id) AS xs FROM turn_events WHERE reward IS NOT NULL GROUP BY ALL),
v AS (SELECT scope, state_key, action, len(xs)::BIGINT AS visits, list_reduce(list_concat([0.0::DOUBLE], xs), lambda q, r: floor((q + 0.25::DOUBLE * (r - q)) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE) AS q_value, list_reduce(list_concat([0.0::DOUBLE], xs), lambda s, r: floor((s + r) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE) AS reward_sum FROM o)"""


@query("win15_action_values", f"WITH {FOLD} SELECT *, floor(reward_sum / visits * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS reward_avg FROM v")
def win15(spark, d):
    return W.action_values(V.turn_events(spark, d))


@query("win04_top_actions", f"WITH {FOLD} SELECT * FROM (SELECT state_key, row_number() OVER (PARTITION BY state_key ORDER BY q_value DESC, visits DESC, scope, action) AS rank, scope, action, q_value FROM v) WHERE rank <= 5")
def win04(spark, d):
    from lodestone.operators.retrieval import top

    return top(W.action_values(V.turn_events(spark, d)), "state_key", [F.desc("q_value"), F.desc("visits"), "scope", "action"], 5).select("state_key", "rank", "scope", "action", "q_value")


@query("win15_best_actions", f"WITH {FOLD} SELECT scope, state_key, action, q_value, visits FROM (SELECT *, row_number() OVER (PARTITION BY scope, state_key ORDER BY q_value DESC, visits DESC, action) AS r FROM v) WHERE r = 1")
def win15b(spark, d):
    return W.best_actions(W.action_values(V.turn_events(spark, d)))


STATES = f"""{D.MEMORY}, st AS (SELECT *, max(turn_index) OVER (PARTITION BY session_id) AS cur FROM memory_docs),
ms AS (SELECT *, CASE WHEN turn_index >= greatest(0, cur - 3) THEN 'working' WHEN importance < 0.25 OR role IN ('system', 'tool') THEN 'evicted' ELSE 'episodic' END AS memory_state FROM st)"""


@query("win05_memory_states", f"WITH {STATES} SELECT session_id, turn_index, role, CASE WHEN importance > 0.9 OR (role = 'assistant' AND turn_index % 5 = 1) THEN 'promoted' ELSE memory_state END AS memory_state FROM ms")
def win05(spark, d):
    """Rows of high importance stand in for pinned ones, every fifth turn's answers for those with an entailed claim."""
    statuses = F.when((F.col("role") == "assistant") & (F.col("turn_index") % 5 == 1), F.array(F.lit("unsupported"), F.lit("entailed")))
    return W.with_states(V.memory_docs(spark, d), 3, supported=W.evidence_supported(None, F.col("importance") > 0.9, statuses)).select("session_id", "turn_index", "role", "memory_state")


PRIORITY = "round(CASE memory_state WHEN 'working' THEN 0.65 ELSE 0.45 END::DOUBLE + 0.55::DOUBLE * importance + 0.35::DOUBLE / (1.0::DOUBLE + greatest(0, cur - turn_index) / 3::DOUBLE), 4)"
GREEDY = "list_reduce(list_concat([{'used': 0::BIGINT, 'cost': 0::BIGINT, 'keep': []::INT[], 't': -1}], list_transform(xs, lambda x: {'used': 0::BIGINT, 'cost': x.cost, 'keep': []::INT[], 't': x.t})), lambda a, x: CASE WHEN a.used + x.cost <= BUDGET THEN {'used': a.used + x.cost, 'cost': x.cost, 'keep': list_concat(a.keep, [x.t]), 't': x.t} ELSE a END)"


@query("win06_working_set", f"WITH {STATES}, p AS (SELECT session_id, turn_index, {PRIORITY} AS priority, {D.tokens('text')} AS cost FROM ms WHERE memory_state <> 'evicted'), o AS (SELECT session_id, list({{'cost': cost, 't': turn_index}} ORDER BY priority DESC, turn_index DESC) AS xs FROM p GROUP BY session_id) SELECT session_id, unnest({GREEDY.replace('BUDGET', '300')}.keep) AS turn_index FROM o")
def win06(spark, d):
    return W.working_set(V.memory_docs(spark, d), 300, 3).select("session_id", "turn_index")


LIFTED = "round(CASE memory_state WHEN 'promoted' THEN 1.0 WHEN 'working' THEN 0.65 ELSE 0.45 END::DOUBLE + 0.55::DOUBLE * importance + 0.35::DOUBLE / (1.0::DOUBLE + greatest(0, cur - turn_index) / 3::DOUBLE) + CASE WHEN importance > 0.9 THEN 0.25 ELSE 0.0 END::DOUBLE + least(0.2::DOUBLE, 0.2::DOUBLE * (turn_index % 5 / 4::DOUBLE)) + least(0.45::DOUBLE, len(list_intersect(qt, mt)) / greatest(4, len(qt))::DOUBLE * 0.9::DOUBLE), 4)"


@query("win06_relevant_set", f"WITH {STATES}, q AS (SELECT session_id, arg_max(text, turn_index) AS question FROM memory_docs WHERE role = 'user' GROUP BY session_id), l AS (SELECT ms.* REPLACE (CASE WHEN importance > 0.9 THEN 'promoted' ELSE memory_state END AS memory_state), {D.important("coalesce(question, '')", 12)} AS qt, {D.important('text', 14)} AS mt FROM ms LEFT JOIN q USING (session_id)), p AS (SELECT session_id, turn_index, memory_state, importance, {LIFTED} AS priority, {D.tokens('text')} AS cost FROM l WHERE memory_state <> 'evicted'), o AS (SELECT session_id, list({{'cost': cost, 't': turn_index}} ORDER BY CASE WHEN memory_state = 'promoted' THEN 0 ELSE 1 END, priority DESC, CASE WHEN memory_state = 'promoted' THEN importance ELSE 0 END DESC, turn_index DESC) AS xs FROM p GROUP BY session_id), k AS (SELECT session_id, unnest({GREEDY.replace('BUDGET', '120')}.keep) AS turn_index FROM o) SELECT session_id, turn_index, memory_state, priority FROM k JOIN p USING (session_id, turn_index)")
def win06_relevant(spark, d):
    """The working set for each session's last request. Rows of high importance stand in for supported ones, the turn's number for rewards."""
    m = V.memory_docs(spark, d)
    asked = m.filter("role = 'user'").groupBy("session_id").agg(F.max_by("text", "turn_index").alias("question"))
    return W.working_set(m, 120, 3, F.col("importance") > 0.9, F.col("turn_index") % 5 / 4.0, asked).select("session_id", "turn_index", "memory_state", "priority")


@query("win07_recent_under_budget", f"WITH {D.MEMORY}, p AS (SELECT session_id, turn_index, {D.tokens('text')} AS cost, row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC) AS r FROM memory_docs WHERE role IN ('user', 'assistant')), o AS (SELECT session_id, list({{'cost': cost, 't': turn_index}} ORDER BY r) AS xs FROM p WHERE r <= 6 GROUP BY session_id) SELECT session_id, unnest({GREEDY.replace('BUDGET', '300')}.keep) AS turn_index FROM o")
def win07(spark, d):
    return W.legacy_recent(V.memory_docs(spark, d), 300, 3).select("session_id", "turn_index")


@query("win08_prefix_under_budget", f"WITH {D.SENTENCES}, c AS (SELECT doc_id, pos, greatest(1, length(sentence) // 4) + 4 AS cost FROM sentences), u AS (SELECT *, sum(cost) OVER w AS used, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) SELECT doc_id, pos, cost FROM u WHERE used <= 100 OR n = 1")
def win08(spark, d):
    return W.prefix_under_budget(V.sentences(spark, d), "doc_id", ["pos"], T.quarter_tokens(F.col("sentence")) + 4, 100).select("doc_id", "pos", "cost")


@query("win09_citations", f"WITH {D.TRIPLES}, u AS (SELECT *, row_number() OVER (PARTITION BY article_id, sentence_text ORDER BY pos) AS k FROM triples), c AS (SELECT article_id, doc_id, pos, sentence_text, sum(greatest(1, length(sentence_text) // 4) + 16) OVER w AS used, row_number() OVER w AS n FROM u WHERE k = 1 WINDOW w AS (PARTITION BY article_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) SELECT article_id, n AS citation, pos, CASE WHEN regexp_matches(article_id, '^\\d+$') THEN 'https://pubmed.ncbi.nlm.nih.gov/' || article_id || '/' END AS pubmed FROM c WHERE used <= 200 OR n = 1")
def win09(spark, d):
    from pyspark.sql.window import Window

    from lodestone.functions.triples import article_ids

    first = W.latest(V.triples(spark, d), ["article_id", "sentence_text"], ["pos"])
    kept = W.prefix_under_budget(first, "article_id", ["pos"], T.quarter_tokens(F.col("sentence_text")) + 16, 200)
    pmid, _ = article_ids(F.col("article_id"))
    return kept.select("article_id", F.row_number().over(Window.partitionBy("article_id").orderBy("pos")).cast("long").alias("citation"), "pos", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")).alias("pubmed"))


@query("win10_keyset_page", f"WITH {D.EVENTS}, p AS (SELECT ts, event_id FROM turn_events ORDER BY ts DESC, event_id DESC LIMIT 50), c AS (SELECT ts, event_id FROM p ORDER BY ts, event_id LIMIT 1) SELECT e.event_id, e.scope FROM turn_events e, c WHERE e.ts < c.ts OR (e.ts = c.ts AND e.event_id < c.event_id) ORDER BY e.ts DESC, e.event_id DESC LIMIT 50")
def win10(spark, d):
    e = V.turn_events(spark, d)
    last = W.page_after(e, None, 50).orderBy("ts", "event_id").first()  # a page's last row is the next one's cursor
    return W.page_after(e, (last["ts"], last["event_id"]), 50).select("event_id", "scope")


@query("win11_first_wins", f"WITH {D.TRIPLES} SELECT subject, object, triple_id FROM (SELECT *, row_number() OVER (PARTITION BY subject, object ORDER BY doc_id, pos) AS r FROM triples) WHERE r = 1")
def win11(spark, d):
    return W.latest(V.triples(spark, d), ["subject", "object"], ["doc_id", "pos"]).select("subject", "object", "triple_id")


@query("win13_carried_flag", "SELECT conv_id, turn, coalesce(max(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS active FROM conversations")
def win13(spark, d):
    return W.carried_flag(V.table(spark, d, "conversations"), "conv_id", ["turn"], F.contains(F.lower("text"), F.lit("the")), "active").select("conv_id", "turn", "active")


@query("win12_supported_claims", "WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM conversations), k AS (SELECT conv_id, trim(c) AS claim, arg_min(turn, (-turn, place)) AS turn_index, min((-turn, place)) AS x FROM l WHERE contains(lower(c), 'the') AND trim(c) <> '' GROUP BY ALL) SELECT * FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY x, claim) AS rank, turn_index, claim, 'prior_claim_' || substr(sha256(claim), 1, 24) AS evidence_id, 1.0::DOUBLE AS score FROM k) WHERE rank <= 20")
def win12s(spark, d):
    """Lines of messages as claims; those with a common word stand in for entailed ones."""
    lines = V.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("turn_index"), F.posexplode(F.split("text", "\n")).alias("place", "claim"))
    claims = lines.withColumn("status", F.when(F.contains(F.lower("claim"), F.lit("the")), "entailed").otherwise("unsupported")).withColumn("entailment", F.lit(1.0))
    return W.supported_claims(claims, "conv_id", 20)


@query("win13_obeyed_corrections", f"SELECT conv_id, turn, active, NOT active OR len(list_filter(t, lambda x: NOT contains(lower(text), x))) = 0 AS obeyed FROM (SELECT conv_id, turn, text, coalesce(max(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) OVER w = 1, false) AS active, coalesce(lag({D.important('text', 2)}) OVER (PARTITION BY conv_id ORDER BY turn), []) AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
def win13o(spark, d):
    """While a correction is active, an answer must name the first terms of the message before it."""
    from pyspark.sql.window import Window

    rows = W.carried_flag(V.table(spark, d, "conversations"), "conv_id", ["turn"], F.contains(F.lower("text"), F.lit("the")), "active")
    rows = rows.withColumn("t", F.lag(T.important_terms(F.col("text"), 2)).over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.select("conv_id", "turn", "active", (~F.col("active") | W.obeys_correction(F.col("text"), F.col("t"))).alias("obeyed"))


@query("ups01_first_of_key", f"WITH {D.EVENTS} SELECT scope, action, event_id FROM (SELECT *, row_number() OVER (PARTITION BY scope, action ORDER BY ts, event_id) AS r FROM turn_events) WHERE r = 1")
def ups01(spark, d):
    return W.latest(V.turn_events(spark, d), ["scope", "action"], ["ts", "event_id"]).select("scope", "action", "event_id")


@query("ups02_folded_changes", f"WITH {D.EVENTS}, f AS (SELECT scope, last(CASE WHEN action % 2 = 0 THEN reward END ORDER BY ts, event_id) FILTER (action % 2 = 0 AND reward IS NOT NULL) AS reward, last(state_key ORDER BY ts, event_id) FILTER (action % 3 = 0) AS state_key, last(state_key = 'error' ORDER BY ts, event_id) AS gone FROM turn_events GROUP BY scope) SELECT scope, reward, state_key FROM f WHERE NOT coalesce(gone, false)")
def ups02(spark, d):
    e = V.turn_events(spark, d)
    log = e.select("scope", "ts", "event_id", F.when(F.col("action") % 2 == 0, F.col("reward")).alias("reward"), F.when(F.col("action") % 3 == 0, F.col("state_key")).alias("state_key"), (F.col("state_key") == "error").alias("deleted"))
    return W.folded_changes(log, ["scope"], ["ts", "event_id"], ["reward", "state_key"], "deleted")


@query("ups03_state_counts", f"WITH {STATES} SELECT session_id, memory_state, count(*) AS n FROM ms GROUP BY ALL")
def ups03(spark, d):
    return W.with_states(V.memory_docs(spark, d), 3).groupBy("session_id", "memory_state").agg(F.count("*").alias("n"))


@query("ups03_updated_states", f"WITH {STATES} SELECT session_id, turn_index, role, memory_state FROM ms")
def ups03u(spark, d):
    """Early turns first, then the others: the second write touches only the sessions that have any."""
    rows, path = V.memory_docs(spark, d).select("doc_type", "session_id", "turn_index", "role", "importance"), shared(spark)
    for part in (rows.filter("turn_index < 3"), rows.filter("turn_index >= 3")):
        S_.update_states(spark, path, part, 3)
    return spark.read.parquet(path).select("session_id", "turn_index", "role", "memory_state")


@query("ups04_message_ids", f"WITH {D.MEMORY} SELECT 'mem_' || substr(sha256(session_id || chr(10) || turn_index || chr(10) || role), 1, 24) AS mem_id, max(turn_index) AS turn_index FROM memory_docs GROUP BY 1")
def ups04(spark, d):
    m = V.memory_docs(spark, d)
    i = T.stable_id(F.col("session_id").cast("string"), F.col("turn_index").cast("string"), F.col("role"), prefix="mem_")
    return W.latest(m.withColumn("mem_id", i), ["mem_id"], [F.desc("turn_index")]).select("mem_id", "turn_index")
