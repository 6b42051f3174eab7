"""Queries of the evaluation operators (CLM, JOIN, AGG, GEN): document sentences as answers, benchmark items as gold claims."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluation as E
from lodestone.plans import duck as D
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


# Frequent driver words stand in for the domain's vocabularies.
ALIASES = [("article", "the"), ("article", "der"), ("article", "les"), ("joiner", "and"), ("joiner", "und"), ("place", "in"), ("place", "dans")]
PREDICATES = {"being": ["was", "ist", "est"], "having": ["with", "mit", "avec"]}
NEGATORS = ["with", "was", "nicht", "pas"]
PHRASES = {"caveat": ["only"], "transfer": ["idiot"], "wrong": ["stheon"], "overgeneral": [" all"], "drift": ["rest"], "vague": [" of a "]}


def claims(spark, d):
    return V.sentences(spark, d).select("doc_id", "pos", F.col("sentence").alias("claim"))


def gold(spark, d):
    t = F.col("text")
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("gold_id"), t.alias("claim"), T.important_terms(t, 3).alias("entities"))


CL = f"{D.SENTENCES}, cl AS (SELECT doc_id, pos, sentence AS claim FROM sentences)"
HIT = "contains(' ' || regexp_replace(lower(claim), '[^a-z0-9-]+', ' ', 'g') || ' ', ' ' || alias || ' ')"
ALIAS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALIASES) + ") a(canonical, alias)"


@query("clm02_evaluation_claims", f"WITH {CL}, e AS (SELECT doc_id, pos, string_agg(DISTINCT canonical, ',' ORDER BY canonical) AS entities FROM cl JOIN {ALIAS_SQL} ON {HIT} GROUP BY ALL) SELECT doc_id, pos, coalesce(entities, '') AS entities, CASE WHEN {D.contains_any('lower(claim)', PREDICATES['being'])} THEN 'being' WHEN {D.contains_any('lower(claim)', PREDICATES['having'])} THEN 'having' ELSE '' END AS predicate, CASE WHEN {D.hits('claim', NEGATORS)} > 0 THEN 'negated' ELSE 'affirmed' END AS polarity FROM cl LEFT JOIN e USING (doc_id, pos)")
def clm02(spark, d):
    aliases = spark.createDataFrame(ALIASES, "canonical string, alias string")
    c = claims(spark, d)
    e = E.alias_entities(c, ["doc_id", "pos"], "claim", aliases)
    return c.join(e, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce(F.array_join("entities", ","), F.lit("")).alias("entities"), E.first_predicate(F.col("claim"), PREDICATES).alias("predicate"), F.when(T.hits(F.col("claim"), NEGATORS) > 0, "negated").otherwise("affirmed").alias("polarity"))


#: Aliases of a node stand in for those of a domain.
NODE_ALIASES = [("the", "then"), ("the", "der"), ("and", "und ")]
NODE_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in NODE_ALIASES) + ") na(node, alias)"
TERMS = f"list_filter(regexp_extract_all(lower(text), '{E.GOLD_TERM}'), lambda x: x NOT IN ({D.quoted(E.GOLD_STOP)}))"
GOLD = f"""{CL}, ce AS (SELECT doc_id, pos, list(DISTINCT canonical) AS own FROM cl JOIN {ALIAS_SQL} ON {HIT} GROUP BY ALL),
gg AS (SELECT item_id AS gold_id, {TERMS} AS t, {D.important('text', 3)} AS e FROM benchmark),
gx AS (SELECT gold_id, unnest(e) AS node FROM gg), gy AS (SELECT gold_id, list({{'node': node, 'pieces': pieces}}) AS ep FROM (SELECT gold_id, gx.node, coalesce(list(alias) FILTER (alias IS NOT NULL), [gx.node]) AS pieces FROM gx LEFT JOIN {NODE_SQL} ON na.node = gx.node GROUP BY gold_id, gx.node) GROUP BY gold_id),
gm AS (SELECT cl.doc_id, cl.pos, gold_id, greatest(len(list_filter(t, lambda x: contains(lower(claim), x)))::DOUBLE / greatest(1, len(t)), len(list_filter(coalesce(ep, []), lambda n: list_contains(coalesce(own, []), n.node) OR len(list_filter(n.pieces, lambda p: contains(lower(claim), p))) > 0))::DOUBLE / greatest(1, len(e))) AS rate FROM cl LEFT JOIN ce ON ce.doc_id = cl.doc_id AND ce.pos = cl.pos, gg LEFT JOIN gy USING (gold_id)),
bg AS (SELECT doc_id, pos, gold_id, round(rate, 4) AS match FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY rate DESC, gold_id) AS r FROM gm WHERE rate > 0) WHERE r = 1)"""


@query("join08_best_gold", f"WITH {GOLD} SELECT * FROM bg")
def join08(spark, d):
    c, key = claims(spark, d), ["doc_id", "pos"]
    own = E.alias_entities(c, key, "claim", spark.createDataFrame(ALIASES, "canonical string, alias string"))
    return E.best_gold(c, key, "claim", gold(spark, d), own, spark.createDataFrame(NODE_ALIASES, "node string, alias string"))


@query("join09_best_graph", f"WITH {CL}, g AS (SELECT item_id // 3 AS graph_id, unnest({D.important('text', 3)}) AS node FROM benchmark), gd AS (SELECT DISTINCT graph_id, node FROM g), m AS (SELECT conv_id, turn, graph_id, coalesce(string_agg(node, ',' ORDER BY node) FILTER (NOT contains(lower(text), node)), '') AS missing, count(*) FILTER (NOT contains(lower(text), node)) AS k, count(*) AS n FROM conversations, gd GROUP BY ALL) SELECT conv_id, turn, graph_id, missing, score FROM (SELECT *, round(1 - k::DOUBLE / n, 4) AS score, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(1 - k::DOUBLE / n, 4) DESC, graph_id) AS r FROM m) WHERE r = 1")
def join09(spark, d):
    g = V.table(spark, d, "benchmark").select(F.floor(F.col("item_id") / 3).alias("graph_id"), F.explode(T.important_terms(F.col("text"), 3)).alias("node")).distinct()
    return E.best_graph(V.table(spark, d, "conversations"), ["conv_id", "turn"], "text", g).withColumn("missing", F.array_join("missing", ","))


def has(k):
    return D.contains_any("lower(claim)", PHRASES[k])


NEGATED = f"{D.hits('claim', NEGATORS)} > 0"
JUDGED = f"""{GOLD}, jd AS (SELECT doc_id, pos, CASE WHEN {has('caveat')} THEN 'caveat' WHEN {has('transfer')} THEN 'transfer' WHEN {has('wrong')} AND NOT {NEGATED} THEN 'wrong_variant' WHEN {has('wrong')} THEN 'rejected_variant' WHEN m >= 0.55 AND {has('overgeneral')} THEN 'overgeneral' WHEN m >= 0.75 THEN 'match' WHEN m >= 0.55 THEN 'partial' WHEN {has('drift')} THEN 'drift' WHEN {has('vague')} THEN 'vague' ELSE 'none' END AS rule FROM (SELECT cl.*, coalesce(match, 0.0) AS m FROM cl LEFT JOIN bg USING (doc_id, pos))),
rl AS (SELECT * FROM (VALUES ('caveat', 'supported', 0, NULL), ('transfer', 'unsupported', 4, 'cross_domain_transfer'), ('wrong_variant', 'contradicted', 5, 'factual_inversion'), ('rejected_variant', 'supported', 0, NULL), ('overgeneral', 'overgeneralized', 2, 'overgeneralization'), ('match', 'supported', 0, NULL), ('partial', 'partially_supported', 0, NULL), ('drift', 'out_of_scope', 3, 'scope_drift'), ('vague', 'too_vague', 2, 'vague_supported_answer'), ('none', 'unsupported', 3, 'unsupported_plausible_mechanism')) v(rule, label, severity, error_type)),
jj AS (SELECT doc_id, pos, rule, label, severity, error_type FROM jd JOIN rl USING (rule))"""


def judgements(spark, d):
    c = claims(spark, d).join(join08(spark, d), ["doc_id", "pos"], "left").withColumn("match", F.coalesce("match", F.lit(0.0)))
    return E.judged(c, E.standard_rules(F.col("match"), F.col("claim"), T.hits(F.col("claim"), NEGATORS) > 0, PHRASES)).select("doc_id", "pos", "rule", "label", "severity", "error_type")


@query("clm03_judgements", f"WITH {JUDGED} SELECT * FROM jj")
def clm03(spark, d):
    return judgements(spark, d)


TURN = f"{JUDGED}, pn AS (SELECT doc_id, sum(p) AS penalty FROM (SELECT doc_id, error_type, max(CASE severity WHEN 5 THEN 0.55 WHEN 4 THEN 0.45 WHEN 3 THEN 0.25 WHEN 2 THEN 0.10 ELSE 0.0 END::DOUBLE) AS p FROM jj WHERE error_type IS NOT NULL GROUP BY ALL) GROUP BY doc_id), tc AS (SELECT doc_id, round(count(*) FILTER (label IN ('supported', 'partially_supported'))::DOUBLE / count(*), 4) AS factual_support, round(1 - count(*) FILTER (label = 'contradicted')::DOUBLE / count(*), 4) AS contradiction_avoidance, round(1 - count(*) FILTER (label = 'out_of_scope')::DOUBLE / count(*), 4) AS scope_alignment, (CASE WHEN count(*) FILTER (label = 'unsupported') > 0 THEN 0.4 ELSE 0.8 END)::DOUBLE AS uncertainty_calibration FROM jj GROUP BY doc_id), tt AS (SELECT tc.*, round(coalesce(penalty, 0.0), 4)::DOUBLE AS penalty FROM tc LEFT JOIN pn USING (doc_id))"


@query("agg09_turn_components", f"WITH {TURN} SELECT * FROM tt")
def agg09(spark, d):
    return E.turn_components(judgements(spark, d), ["doc_id"])


def rewards(spark, d, said=None):
    t = E.turn_components(said if said is not None else judgements(spark, d), ["doc_id"])
    base = F.lit(0.4) * F.col("factual_support") + F.lit(0.3) * F.col("contradiction_avoidance") + F.lit(0.3) * F.col("scope_alignment")
    return t.select("doc_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - F.col("penalty"))), 4).alias("reward"))


BOARD = f"{TURN}, rw AS (SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE * factual_support + 0.3::DOUBLE * contradiction_avoidance + 0.3::DOUBLE * scope_alignment - penalty)), 4) AS reward FROM tt), fb AS (SELECT doc_id, severity, error_type AS category, reward <= CASE severity WHEN 5 THEN 0.05 WHEN 4 THEN 0.15 WHEN 3 THEN 0.45 WHEN 2 THEN 0.70 ELSE 0.90 END AS penalized FROM jj JOIN rw USING (doc_id) WHERE error_type IS NOT NULL), bo AS (SELECT *, CASE WHEN NOT penalized THEN 'answer_generation_failure_plus_weak_reward_penalty' WHEN category = 'scope_drift' THEN 'conversation_frame_not_preserved' ELSE 'answer_generation_failure' END AS root_cause, CASE WHEN NOT penalized THEN 'reward_weighting' WHEN category IN ('unsupported_plausible_mechanism', 'factual_inversion', 'scope_drift') THEN 'assistant_generation' ELSE 'evaluator_judgment' END AS owner FROM fb)"


def board(spark, d):
    said = durable(judgements(spark, d))
    return E.failure_board(said, rewards(spark, d, said), ["doc_id"])


@query("agg12_failure_board", f"WITH {BOARD} SELECT * FROM bo")
def agg12(spark, d):
    return board(spark, d)


TEMPLATES = [("factual_inversion", "reward_config"), ("factual_inversion", "assistant_prompt_policy"), ("scope_drift", "conversation_frame_policy"), ("unsupported_plausible_mechanism", "evidence_grounding")]


@query("agg13_recommendations", f"WITH {BOARD}, g AS (SELECT category, max(severity) AS s, count(*) AS failures FROM bo GROUP BY category) SELECT category, coalesce(target, 'regression_tests') AS target, CASE WHEN s >= 5 THEN 'P0' WHEN s >= 3 THEN 'P1' ELSE 'P2' END AS priority, failures FROM g LEFT JOIN (VALUES {', '.join(str(t) for t in TEMPLATES)}) v(category, target) USING (category)")
def agg13(spark, d):
    return E.recommendations(board(spark, d), spark.createDataFrame(TEMPLATES, "category string, target string"))


@query("agg17_regressions", f"WITH {BOARD} SELECT doc_id, category, CASE WHEN severity >= 4 THEN 'contradicted' ELSE 'unsupported_or_penalized' END AS expected, (CASE WHEN severity >= 5 THEN 0.05 ELSE 0.45 END)::DOUBLE AS most_reward FROM bo WHERE severity >= 3")
def agg17(spark, d):
    return E.regressions(board(spark, d), ["doc_id"])


@query("agg18_diagnosis", f"WITH {BOARD} SELECT doc_id, count(*) AS failures, max(severity) AS worst, string_agg(DISTINCT root_cause, ',' ORDER BY root_cause) AS causes FROM bo GROUP BY doc_id")
def agg18(spark, d):
    return board(spark, d).groupBy("doc_id").agg(F.count("*").alias("failures"), F.max("severity").alias("worst"), F.array_join(F.array_sort(F.collect_set("root_cause")), ",").alias("causes"))


@query("agg11_coreference", f"WITH r AS (SELECT conv_id AS id, turn, {D.important('text', 6)} AS req, {D.important('text', 2)} AS forb, lag({D.important('text', 80)}) OVER (PARTITION BY conv_id ORDER BY turn) AS ret FROM conversations), s AS (SELECT id || ':' || turn AS id, req, len(list_filter(req, lambda e: len(list_filter(ret, lambda r: contains(r, e))) > 0)) AS k, len(list_filter(forb, lambda e: len(list_filter(ret, lambda r: contains(r, e))) > 0)) AS b FROM r WHERE ret IS NOT NULL) SELECT id, (CASE WHEN len(req) = 0 THEN 0.0 ELSE round(k::DOUBLE / len(req), 4) END)::DOUBLE AS found, greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.5::DOUBLE * b) AS clean FROM s")
def agg11(spark, d):
    from pyspark.sql.window import Window

    c = V.table(spark, d, "conversations")
    t = F.col("text")
    rows = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), T.important_terms(t, 6).alias("required"), T.important_terms(t, 2).alias("forbidden"), F.lag(T.important_terms(t, 80)).over(Window.partitionBy("conv_id").orderBy("turn")).alias("retrieved"))
    return E.coreference(rows.filter("retrieved IS NOT NULL"))


@query("join11_replayed_answers", "SELECT c.conv_id AS scenario, c.turn, c.conv_id % 3 AS variant, md5(coalesce(b1.text, b0.text)) AS answer FROM conversations c LEFT JOIN conversations b1 ON b1.conv_id = c.conv_id + 1 AND b1.turn = c.turn AND c.conv_id % 3 = 1 LEFT JOIN conversations b0 ON b0.conv_id = c.conv_id + 2 AND b0.turn = c.turn")
def join11(spark, d):
    c = V.table(spark, d, "conversations")
    turns = c.select(F.col("conv_id").alias("scenario"), "turn", (F.col("conv_id") % 3).alias("variant"))
    own = c.select(F.col("conv_id").alias("answer_id"), (F.col("conv_id") - 1).alias("scenario"), "turn", F.lit(1).cast("long").alias("variant"), F.col("text").alias("answer"))
    any_ = c.select(F.col("conv_id").alias("answer_id"), (F.col("conv_id") - 2).alias("scenario"), "turn", F.lit(None).cast("long").alias("variant"), F.col("text").alias("answer"))
    return E.replayed(turns, own.unionByName(any_)).withColumn("answer", F.md5("answer")).select("scenario", "turn", "variant", "answer")


@query("join12_traps_of_turns", "WITH t AS (SELECT conv_id || ':' || turn AS turn_id, unnest(['premise_' || conv_id % 7, 'drift_' || turn]) AS trap_id FROM conversations), b AS (SELECT 'premise_' || event_id AS trap_id, event_type AS type, 4 AS severity FROM events) SELECT turn_id, t.trap_id, coalesce(type, CASE WHEN contains(t.trap_id, 'premise') THEN 'user_false_premise' WHEN contains(t.trap_id, 'drift') THEN 'scope_drift' ELSE 'generated_trap' END) AS type, coalesce(severity, CASE WHEN contains(t.trap_id, 'premise') THEN 5 ELSE 3 END) AS severity FROM t LEFT JOIN b USING (trap_id)")
def join12(spark, d):
    c = V.table(spark, d, "conversations")
    turns = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"), F.array(F.concat(F.lit("premise_"), (F.col("conv_id") % 7).cast("string")), F.concat(F.lit("drift_"), F.col("turn").cast("string"))).alias("trap_ids"))
    bank = V.table(spark, d, "events").select(F.concat(F.lit("premise_"), F.col("event_id").cast("string")).alias("trap_id"), F.col("event_type").alias("type"), F.lit(4).alias("severity"))
    return E.traps_of(turns, bank)


@query("join13_trap_outcomes", "WITH t AS (SELECT conv_id || ':' || turn AS turn_id, 'trap' AS trap_id, text, substr(lower(text), 3, 4) AS wrong, conv_id % 5 = 0 AS det FROM conversations) SELECT turn_id, trap_id, CASE WHEN det THEN 'detected' WHEN contains(trim(regexp_replace(replace(lower(text), '-', ' '), '\\s+', ' ', 'g')), trim(regexp_replace(replace(wrong, '-', ' '), '\\s+', ' ', 'g'))) AND NOT contains(lower(text), 'was') THEN 'missed' ELSE 'resisted' END AS outcome FROM t")
def join13(spark, d):
    c = V.table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"), F.lit("trap").alias("trap_id"), F.col("text").alias("answer"), F.substring(F.lower("text"), 3, 4).alias("wrong_claim"), (F.col("conv_id") % 5 == 0).alias("det"))
    return E.trap_outcomes(c.select("turn_id", "trap_id", "wrong_claim"), c.filter("det").select("turn_id", "trap_id"), c.select("turn_id", "answer"), ["was"])


@query("agg24_corpus_audit", f"WITH t AS (SELECT conv_id, text, {D.important('text', 5)} AS a, list_slice({D.terms('text')}, 8, 12) AS b FROM conversations) SELECT 'forbidden_in_required' AS issue, count(*) AS n FROM t WHERE len(list_intersect(a, b)) > 0 UNION ALL SELECT 'empty_text', count(*) FROM t WHERE trim(text) = '' UNION ALL SELECT 'unknown_scenario', count(*) FROM t WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def agg24(spark, d):
    t = F.col("text")
    turns = V.table(spark, d, "conversations").select(F.col("conv_id").alias("scenario"), "text", T.important_terms(t, 5).alias("must"), F.slice(T.terms(t), 8, 5).alias("must_not"))
    return E.audit(turns, V.table(spark, d, "labels").select(F.col("doc_id").alias("scenario")))


GEN = [(0, 0, 2, "Tell me about {topic}."), (0, 1, 2, "What is {topic}?"), (1, 0, 1, "And the evidence for {topic}?"), (2, 0, 3, "Not {topic}, please."), (2, 1, 3, "Leave {topic} out."), (2, 2, 3, "Drop {topic}.")]


@query("gen01_expanded_corpus", f"SELECT item_id AS scenario, variant, turn, replace(template, '{{topic}}', {D.important('text', 1)}[1]) AS text FROM benchmark, (SELECT unnest(range(0, 5)) AS variant), (VALUES {', '.join(str(g) for g in GEN)}) v(turn, pick, n, template) WHERE variant % n = pick")
def gen01(spark, d):
    s = V.table(spark, d, "benchmark").select(F.col("item_id").alias("scenario"), F.get(T.important_terms(F.col("text"), 1), F.lit(0)).alias("topic"))
    return E.expanded(s, spark.createDataFrame(GEN, "turn int, pick int, n int, template string"), 5)


@query("gen02_paraphrases", "WITH b AS (SELECT DISTINCT text, ['again: ' || text, 'so: ' || text] AS alt FROM conversations WHERE turn = 0) SELECT conv_id, turn, coalesce(alt[(conv_id % 2) + 1], c.text) AS text FROM conversations c LEFT JOIN b USING (text)")
def gen02(spark, d):
    c = V.table(spark, d, "conversations")
    bank = c.filter("turn = 0").select("text", F.array(F.concat(F.lit("again: "), "text"), F.concat(F.lit("so: "), "text")).alias("alternatives")).distinct()
    return E.paraphrased(c.select("conv_id", "turn", F.col("conv_id").alias("variant"), "text"), bank)
