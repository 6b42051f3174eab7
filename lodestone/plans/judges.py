"""Queries of judging with targets, traps, focus and tags (CLM-3, AGG-12, AGG-18): documents as turns, their lines as claims."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluation as E
from lodestone.operators import judging as J
from lodestone.plans import duck as D
from lodestone.plans import evals as P
from lodestone.sources import views as V
from lodestone.sources.store import durable

Q, S = {}, {}


def query(name, sql=None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


#: Frequent words of the driver's texts stand in for the domain's phrases.
WORDS = {
    "observing": ["only", "ung"],
    "scope_kept": ["with", "ent"],
    "boundary": [" all", "que "],
    "cites": ["stheon", "onth"],
    "agrees": [" mit"],
    "rejects": ["nicht", " pas", "the "],
    "excused": ["rest"],
    "off_topic": ["ion"],
    "drift": ["rest", "est "],
    "edges": ["und"],
    "source_domain": ["idiot", " in "],
    "target_domain": ["the"],
    "proof": [" and"],
    "hedges": ["was "],
    "overgeneral": ["all", "les", "the"],
    "vague": ["of", "der", "la"],
    "reversed": ["avec", "with", "and", "und"],
}
TURN = ["doc_id"]
TAGS = {0: ["evidence_assembly"], 1: ["agent_observability"], 2: ["user_false_premise"], 3: ["scope_correction", "other"]}
TRAPS = {0: ["scope_drift", "factual_inversion"], 1: ["factual_inversion", "mechanistic_contradiction"], 2: ["mechanistic_chain_break", "cross_domain_transfer"]}


def turns(spark, d):
    """Tags, traps, targets and graphs follow from the document's number; its first terms are its focus."""
    n = F.col("doc_id")
    tags, traps = F.array().cast("array<string>"), F.array().cast("array<struct<trap_id:string,type:string>>")
    for k, v in TAGS.items():
        tags = F.when(n % 6 == k, T.lits(v)).otherwise(tags)
    for k, v in TRAPS.items():
        traps = F.when(n % 4 == k, F.array(*[F.struct(F.concat(F.lit(f"{x}_"), n.cast("string")).alias("trap_id"), F.lit(x).alias("type")) for x in v])).otherwise(traps)
    return V.table(spark, d, "documents").select("doc_id", tags.alias("tags"), T.important_terms(F.col("text"), 2).alias("focus"), F.array(n % 60, n % 60 + 1).alias("targets"), traps.alias("traps"), F.array(n % 20, n % 7).alias("graphs"), F.col("text").alias("answer"))


def bank(spark, d):
    t = F.col("text")
    few = T.important_terms(t, 4)
    variant = F.array_compact(F.array(F.concat(F.get(few, F.lit(3)), F.lit("."))))
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("gold_id"), t.alias("claim"), T.important_terms(t, 3).alias("entities"), T.important_terms(t, 3).alias("nodes"), variant.alias("variants"), F.coalesce(F.get(few, F.lit(0)), F.lit("")).alias("subject"), F.coalesce(F.get(few, F.lit(1)), F.lit("")).alias("object"))


def lines(spark, d):
    c = P.claims(spark, d)
    own = E.alias_entities(c, ["doc_id", "pos"], "claim", spark.createDataFrame(P.ALIASES, "canonical string, alias string"))
    rows = c.join(own, ["doc_id", "pos"], "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    return rows.select("doc_id", F.col("pos").alias("claim_id"), "claim", "entities", E.first_predicate(F.col("claim"), P.PREDICATES).alias("predicate"))


def node_aliases(spark):
    return spark.createDataFrame(P.NODE_ALIASES, "node string, alias string")


def judged(spark, d):
    return J.judge(lines(spark, d), TURN, turns(spark, d), bank(spark, d), WORDS, node_aliases(spark))


def listed(xs):
    return f"[{D.quoted(xs)}]::VARCHAR[]"


def any_of(c, k):
    return D.contains_any(c, WORDS[k])


def word_of(k):
    return f"list_has_any(string_split_regex(low, '\\s+'), {listed(WORDS[k])})"


def trap_sql(*types):
    return "coalesce(" + ", ".join(f"list_filter(traps, lambda t: t.type = '{x}')[-1].trap_id" for x in types) + ", NULL)"


def tagged(*xs):
    return f"list_has_any(tags, {listed(xs)})"


FOCUSED = "len(list_filter(focus, lambda f: contains(low, f) OR contains(low, replace(f, '-', ' ')) OR (len(list_filter(string_split(replace(f, '-', ' '), ' '), lambda w: length(w) > 2)) > 0 AND len(list_filter(list_slice(list_filter(string_split(replace(f, '-', ' '), ' '), lambda w: length(w) > 2), 1, 2), lambda w: NOT contains(replace(low, '-', ' '), w))) = 0))) > 0"
TURNS = f"""tn AS (SELECT doc_id, text AS answer, CASE doc_id % 6 {' '.join(f'WHEN {k} THEN {listed(v)}' for k, v in TAGS.items())} ELSE []::VARCHAR[] END AS tags, {D.important('text', 2)} AS focus, [doc_id % 60, doc_id % 60 + 1] AS targets, [doc_id % 20, doc_id % 7] AS graphs,
CASE doc_id % 4 {' '.join('WHEN ' + str(k) + ' THEN [' + ', '.join(f"{{'trap_id': '{x}_' || doc_id, 'type': '{x}'}}" for x in v) + ']' for k, v in TRAPS.items())} ELSE [] END AS traps FROM documents)"""
SAID = f"""{P.GOLD}, {TURNS}, bk AS (SELECT item_id AS gold_id, coalesce({D.important('text', 4)}[1], '') AS subject, coalesce({D.important('text', 4)}[2], '') AS object, {D.important('text', 4)}[4] AS variant FROM benchmark),
tg AS (SELECT doc_id, list(item_id) AS valid FROM tn JOIN benchmark ON list_contains(targets, item_id) GROUP BY doc_id),
bt AS (SELECT doc_id, pos, gold_id, round(rate, 4) AS match FROM (SELECT gm.*, row_number() OVER (PARTITION BY gm.doc_id, pos ORDER BY rate DESC, gold_id) AS r FROM gm LEFT JOIN tg ON tg.doc_id = gm.doc_id WHERE rate > 0 AND (valid IS NULL OR list_contains(valid, gold_id))) WHERE r = 1),
ro AS (SELECT cl.doc_id, cl.pos, claim, lower(claim) AS low, coalesce(own, []) AS entities, CASE WHEN {D.contains_any('lower(claim)', P.PREDICATES['being'])} THEN 'being' WHEN {D.contains_any('lower(claim)', P.PREDICATES['having'])} THEN 'having' ELSE '' END AS predicate, tags, focus, traps, bt.gold_id, coalesce(match, 0.0)::DOUBLE AS match, subject, object, variant, coalesce(list_transform(ep, lambda n: n.pieces), []) AS nodes FROM cl LEFT JOIN ce ON ce.doc_id = cl.doc_id AND ce.pos = cl.pos JOIN tn ON tn.doc_id = cl.doc_id LEFT JOIN bt ON bt.doc_id = cl.doc_id AND bt.pos = cl.pos LEFT JOIN bk ON bk.gold_id = bt.gold_id LEFT JOIN gy ON gy.gold_id = bt.gold_id),
rm AS (SELECT *, gold_id IS NOT NULL AND (coalesce(contains(low, variant), false) OR coalesce(subject <> '' AND object <> '' AND contains(low, subject) AND contains(low, object), false) AND {word_of('reversed')}) AS mentions, regexp_replace(low, '[*_]', '', 'g') AS plain, len(list_filter(nodes, lambda n: len(list_filter(n, lambda p: contains(low, p))) > 0)) AS hit, {FOCUSED} AS focused FROM ro),
rj AS (SELECT *, mentions AND NOT {any_of('plain', 'agrees')} AND {any_of('plain', 'rejects')} AS rejected FROM rm),
rr AS (SELECT *, CASE WHEN {tagged('agent_observability', 'reward_observability', 'diagnosis')} AND {any_of('low', 'observing')} THEN 'observing' WHEN {tagged('scope_correction', 'memory_correction')} AND {any_of('low', 'scope_kept')} THEN 'scope_kept' WHEN {tagged('evidence_assembly')} AND {any_of('low', 'boundary')} THEN 'assembly_boundary'
 WHEN {any_of('low', 'source_domain')} AND {any_of('low', 'target_domain')} AND {any_of('low', 'proof')} AND NOT {any_of('plain', 'hedges')} THEN 'transfer' WHEN {any_of('low', 'cites')} THEN 'cites' WHEN mentions AND NOT rejected AND NOT {any_of('low', 'excused')} THEN 'wrong_variant' WHEN rejected THEN 'rejected_variant'
 WHEN gold_id IS NOT NULL AND match >= 0.55 AND {word_of('overgeneral')} THEN 'overgeneral' WHEN gold_id IS NOT NULL AND match >= 0.55 THEN 'matched' WHEN gold_id IS NOT NULL AND NOT mentions AND NOT {word_of('overgeneral')} AND (len(entities) > 0 OR predicate <> '') AND (hit >= 2 OR (hit >= 1 AND (predicate <> '' OR {any_of('low', 'edges')}) AND match >= 0.2)) THEN 'fragment'
 WHEN {any_of('low', 'boundary')} THEN 'boundary' WHEN len(focus) > 0 AND focused AND match < 0.55 AND len(entities) = 0 THEN 'in_focus' WHEN len(list_filter(traps, lambda t: t.type = 'scope_drift')) > 0 AND {any_of('low', 'drift')} THEN 'drift' WHEN len(entities) <= 1 AND {word_of('vague')} THEN 'vague' WHEN len(focus) > 0 AND NOT focused AND {any_of('low', 'off_topic')} THEN 'off_focus' ELSE 'none' END AS rule FROM rj),
jt AS (SELECT doc_id, pos AS claim_id, rule, len(entities) AS ne, claim, CASE WHEN rule IN ('observing', 'scope_kept', 'assembly_boundary', 'cites', 'boundary', 'in_focus') THEN 'supported' WHEN rule IN ('transfer', 'none') THEN 'unsupported' WHEN rule = 'wrong_variant' THEN 'contradicted' WHEN rule = 'rejected_variant' THEN CASE WHEN match >= 0.55 THEN 'supported' ELSE 'partially_supported' END WHEN rule = 'overgeneral' THEN 'overgeneralized' WHEN rule = 'matched' THEN CASE WHEN match >= 0.75 THEN 'supported' ELSE 'partially_supported' END WHEN rule = 'fragment' THEN 'partially_supported' WHEN rule IN ('drift', 'off_focus') THEN 'out_of_scope' ELSE 'too_vague' END AS label,
 CASE rule WHEN 'transfer' THEN 4 WHEN 'wrong_variant' THEN 5 WHEN 'overgeneral' THEN 2 WHEN 'drift' THEN 3 WHEN 'vague' THEN 2 WHEN 'off_focus' THEN 3 WHEN 'none' THEN 3 ELSE 0 END AS severity,
 CASE rule WHEN 'transfer' THEN 'cross_domain_transfer' WHEN 'wrong_variant' THEN CASE WHEN len(list_filter(traps, lambda t: t.type = 'mechanistic_contradiction')) > 0 THEN 'mechanistic_contradiction' ELSE 'factual_inversion' END WHEN 'overgeneral' THEN 'overgeneralization' WHEN 'drift' THEN 'scope_drift' WHEN 'off_focus' THEN 'scope_drift' WHEN 'vague' THEN 'vague_supported_answer' WHEN 'none' THEN 'unsupported_plausible_mechanism' END AS error_type,
 CASE rule WHEN 'transfer' THEN {trap_sql('cross_domain_transfer', 'user_false_premise', 'scope_drift', 'generated_trap')} WHEN 'wrong_variant' THEN {trap_sql('mechanistic_contradiction', 'factual_inversion', 'user_false_premise', 'generated_trap')} WHEN 'drift' THEN {trap_sql('scope_drift')} WHEN 'off_focus' THEN {trap_sql('scope_drift')} END AS trap_id, gold_id, match FROM rr)"""


@query("clm03_judged_turns", f"WITH {SAID} SELECT doc_id, claim_id, rule, label, severity, error_type, trap_id, gold_id, match FROM jt")
def clm03t(spark, d):
    return judged(spark, d)


GAPS = f"""{SAID}, tl AS (SELECT doc_id, bool_or(ne > 0) AS named, bool_or(coalesce(error_type IN ('factual_inversion', 'mechanistic_contradiction'), false) AND severity >= 4) AS severe, bool_or(coalesce(error_type = 'scope_drift', false)) AS drift, bool_or(rule = 'cites') AS cites, bool_and(rule IN ('boundary', 'assembly_boundary')) AS bounds, bool_or(rule = 'rejected_variant') AS rejected, string_agg(claim, ' ' ORDER BY claim_id) AS said FROM jt GROUP BY doc_id),
ow AS (SELECT tn.doc_id, traps, graphs, lower(said) AS said FROM tn JOIN tl USING (doc_id) WHERE named AND NOT severe AND NOT drift AND NOT cites AND NOT bounds AND NOT list_has_any(tags, {listed(J.SELF_TAGS)}) AND NOT (list_contains(tags, 'user_false_premise') AND rejected)),
gn AS (SELECT DISTINCT item_id // 3 AS graph_id, unnest({D.important('text', 3)}) AS node FROM benchmark), gp2 AS (SELECT graph_id, gn.node, coalesce(list(alias) FILTER (alias IS NOT NULL), [gn.node]) AS pieces FROM gn LEFT JOIN {P.NODE_SQL} ON na.node = gn.node GROUP BY graph_id, gn.node),
og AS (SELECT DISTINCT doc_id, said, unnest(graphs) AS graph_id FROM ow), gs AS (SELECT doc_id, graph_id, count(*) AS n, coalesce(string_agg(node, ',' ORDER BY node) FILTER (len(list_filter(pieces, lambda p: contains(said, p))) = 0), '') AS missing, count(*) FILTER (len(list_filter(pieces, lambda p: contains(said, p))) > 0) AS k FROM og JOIN gp2 USING (graph_id) GROUP BY doc_id, graph_id),
gb AS (SELECT * FROM (SELECT *, round(k::DOUBLE / n, 4) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(k::DOUBLE / n, 4) DESC, graph_id) AS r FROM gs) WHERE r = 1 AND missing <> ''),
ga AS (SELECT doc_id, graph_id, CASE WHEN score >= 0.5 THEN 'partially_supported' ELSE 'unsupported' END AS label, 3 AS severity, 'mechanistic_chain_break' AS error_type, {trap_sql('mechanistic_chain_break')} AS trap_id, missing FROM gb JOIN ow USING (doc_id))"""


def gaps(spark, d, said=None):
    graphs = V.table(spark, d, "benchmark").select(F.floor(F.col("item_id") / 3).alias("graph_id"), F.explode(T.important_terms(F.col("text"), 3)).alias("node"))
    return J.mechanism_gaps(said if said is not None else judged(spark, d), lines(spark, d), TURN, turns(spark, d), graphs, node_aliases(spark))


@query("clm03_mechanism_gaps", f"WITH {GAPS} SELECT * FROM ga")
def clm03g(spark, d):
    return gaps(spark, d).withColumn("missing", F.array_join("missing", ","))


#: All judgements of a turn: its claims', then the gap. A turn's reward follows from the share of errors.
BOARD = f"""{GAPS}, al AS (SELECT doc_id, claim_id, severity, error_type, trap_id FROM jt UNION ALL SELECT doc_id, 1000000, severity, error_type, trap_id FROM ga),
sr AS (SELECT doc_id, round(1 - count(error_type)::DOUBLE / count(*), 4) AS reward FROM al GROUP BY doc_id),
tr AS (SELECT doc_id, x.trap_id AS trap_id, x.type AS type, 4 AS severity, substr(lower(answer), 3, 4) AS wrong, answer FROM (SELECT doc_id, answer, unnest(traps) AS x FROM tn)),
de AS (SELECT DISTINCT doc_id, trap_id FROM al WHERE error_type IS NOT NULL AND trap_id IS NOT NULL),
oc AS (SELECT tr.doc_id, tr.trap_id, tr.type, tr.severity, CASE WHEN de.trap_id IS NOT NULL THEN 'detected' WHEN contains(trim(regexp_replace(replace(lower(answer), '-', ' '), '\\s+', ' ', 'g')), trim(regexp_replace(replace(wrong, '-', ' '), '\\s+', ' ', 'g'))) AND NOT contains(lower(answer), 'was') THEN 'missed' ELSE 'resisted' END AS outcome FROM tr LEFT JOIN de ON de.doc_id = tr.doc_id AND de.trap_id = tr.trap_id WHERE answer IS NOT NULL),
f1 AS (SELECT doc_id, severity, error_type AS category, reward <= CASE severity WHEN 5 THEN 0.05 WHEN 4 THEN 0.15 WHEN 3 THEN 0.45 WHEN 2 THEN 0.70 ELSE 0.90 END AS penalized, trap_id FROM al JOIN sr USING (doc_id) WHERE error_type IS NOT NULL),
fx AS (SELECT doc_id, severity, category, penalized, CASE WHEN NOT penalized THEN 'answer_generation_failure_plus_weak_reward_penalty' WHEN category = 'mechanistic_chain_break' THEN 'mechanistic_completeness_gap' WHEN category = 'scope_drift' THEN 'conversation_frame_not_preserved' ELSE 'answer_generation_failure' END AS root_cause, CASE WHEN NOT penalized THEN 'reward_weighting' WHEN category IN ('unsupported_plausible_mechanism', 'factual_inversion', 'scope_drift', 'mechanistic_chain_break') THEN 'assistant_generation' ELSE 'evaluator_judgment' END AS owner, trap_id, true AS detected FROM f1
 UNION ALL SELECT doc_id, severity, type, false, 'evaluator_judgment_gap', 'evaluator_judgment', trap_id, false FROM oc WHERE outcome = 'missed')"""


def parts(spark, d):
    """Judgements with gaps, rewards, traps and outcomes of all turns."""
    said = durable(judged(spark, d))
    all_ = said.select("doc_id", "claim_id", "severity", "error_type", "trap_id").unionByName(gaps(spark, d, said).select("doc_id", F.lit(1_000_000).cast("long").alias("claim_id"), "severity", "error_type", "trap_id"))
    all_ = durable(all_)
    scores = all_.groupBy("doc_id").agg(F.round(1 - F.count("error_type") / F.count("*"), 4).alias("reward"))
    t = turns(spark, d).filter("answer IS NOT NULL")
    traps = t.select("doc_id", "answer", F.explode("traps").alias("x")).select("doc_id", "x.trap_id", "x.type", F.lit(4).alias("severity"), F.substring(F.lower("answer"), 3, 4).alias("wrong_claim"))
    outcomes = E.trap_outcomes(traps.select("doc_id", "trap_id", "wrong_claim"), J.detected_traps(all_, TURN), t.select("doc_id", "answer"), ["was"], "doc_id")
    return all_, scores, traps, outcomes


def board(spark, d):
    all_, scores, traps, outcomes = parts(spark, d)
    return J.failures(all_, scores, outcomes, traps, TURN), outcomes


@query("agg12_failures_and_traps", f"WITH {BOARD} SELECT * FROM fx")
def agg12t(spark, d):
    return board(spark, d)[0]


@query("agg12_run_summary", f"WITH {BOARD} SELECT (SELECT count(*) FROM tn) AS total_turns, (SELECT count(DISTINCT doc_id) FROM fx) AS failed_turns, (SELECT count(*) FROM oc WHERE outcome = 'missed') AS missed_traps, (SELECT count(*) FROM oc WHERE outcome = 'resisted') AS resisted_traps, (SELECT count(*) FROM fx WHERE detected AND trap_id IS NULL) AS unexpected_failures, (SELECT count(*) FROM fx) AS failure_count")
def agg12s(spark, d):
    rows, outcomes = board(spark, d)
    return J.run_summary(turns(spark, d), rows, outcomes, TURN)


@query("agg18_turn_diagnosis", f"WITH {BOARD}, a AS (SELECT doc_id, first(error_type ORDER BY claim_id) AS f, max(severity) AS worst, bool_or(error_type = 'factual_inversion') AS i, bool_or(error_type = 'mechanistic_chain_break') AS b, bool_or(error_type = 'scope_drift') AS dr FROM al WHERE error_type IS NOT NULL GROUP BY doc_id), o AS (SELECT doc_id, coalesce(string_agg(trap_id, ',' ORDER BY trap_id) FILTER (outcome = 'detected'), '') AS detected, coalesce(string_agg(trap_id, ',' ORDER BY trap_id) FILTER (outcome = 'missed'), '') AS missed, coalesce(string_agg(trap_id, ',' ORDER BY trap_id) FILTER (outcome = 'resisted'), '') AS resisted FROM oc GROUP BY doc_id) SELECT sr.doc_id, coalesce(f, 'none') AS failure_type, coalesce(worst, 0) AS worst, coalesce(detected, '') AS detected, coalesce(missed, '') AS missed, coalesce(resisted, '') AS resisted, concat_ws(',', CASE WHEN i THEN '{J.INVERTED}' END, CASE WHEN b THEN '{J.BROKEN}' END, CASE WHEN dr THEN '{J.DRIFTED}' END, CASE WHEN reward > 0.25 AND worst >= 5 THEN '{J.WEAK_REWARD}' END, CASE WHEN coalesce(missed, '') <> '' THEN '{J.MISSED}' END) AS causes FROM sr LEFT JOIN a USING (doc_id) LEFT JOIN o USING (doc_id)")
def agg18t(spark, d):
    all_, scores, _, outcomes = parts(spark, d)
    rows = J.diagnosis(all_, outcomes, scores, TURN)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("detected", "missed", "resisted", "causes")})
