"""Queries of joins, aggregates, sets, claims and rewards (JOIN, AGG, SET, CLM, U) over triples, messages and events."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import triples as R
from lodestone.operators import claims as C
from lodestone.operators import graph as G
from lodestone.operators import replay as Rp
from lodestone.operators import rewards as W
from lodestone.operators import windows as Win
from lodestone.plans import duck as D
from lodestone.plans.ranked import DOCS, FIELDS, BOOSTS, SCORED, anchors, bm25_sql, hit_texts, ret02, scored_triples
from lodestone.sources import views as V

Q, S = {}, {}


def query(name, sql=None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


def selection(spark, d):
    return V.table(spark, d, "labels").select("doc_id", F.lit(0).cast("long").alias("pos"))


@query("join01_sentence_lookup", f"WITH {D.SENTENCES} SELECT s.doc_id, s.pos, sentence, source FROM labels l JOIN sentences s ON s.doc_id = l.doc_id AND s.pos = 0 JOIN documents d ON d.doc_id = s.doc_id")
def join01(spark, d):
    return G.looked_up(selection(spark, d), V.sentences(spark, d), V.table(spark, d, "documents").select("doc_id", "source"))


@query("join02_triples_of_papers", f"WITH {SCORED} SELECT triple_id, confidence FROM scored WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND confidence >= 0.5")
def join02(spark, d):
    return scored_triples(spark, d).join(V.table(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_semi").filter("confidence >= 0.5").select("triple_id", "confidence")


NEG = lambda c, ws: f"({D.hits(c, ws)} > 0)"


@query("join03_triple_conflicts", f"WITH {D.TRIPLES}, n AS (SELECT article_id, triple_id, relation, {D.important('relation', 80)} AS ra, {D.important('relation', 120)} AS rb, {NEG('relation', T.NEGATORS)} AS neg, list_sort([subject, object]) AS pair FROM triples) SELECT article_id, triple_id, other_id FROM (SELECT a.article_id, a.triple_id, b.triple_id AS other_id, row_number() OVER (PARTITION BY a.article_id, a.triple_id ORDER BY b.triple_id) AS r FROM n a JOIN n b ON a.article_id = b.article_id AND a.pair = b.pair AND a.triple_id < b.triple_id WHERE {D.jaccard('a.ra', 'b.rb')} < 0.35 OR a.neg <> b.neg) WHERE r <= 5")
def join03(spark, d):
    return C.triple_conflicts(V.triples(spark, d))


@query("join10_turn_pairs", f"WITH {D.MEMORY} SELECT u.session_id, u.turn_index, length(u.text) AS q_len, length(a.text) AS a_len FROM memory_docs u JOIN memory_docs a ON a.session_id = u.session_id AND a.turn_index = u.turn_index + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def join10(spark, d):
    return W.pairs(V.memory_docs(spark, d)).select("session_id", "turn_index", F.length("question").cast("long").alias("q_len"), F.length("answer").cast("long").alias("a_len"))


CLAIMS = f"{D.SENTENCES}, cl AS (SELECT doc_id AS s, pos AS claim_id, sentence, {D.important('sentence', 80)} AS ca, {D.important('sentence', 120)} AS cb, {D.important('sentence', 24)} AS c24 FROM sentences)"


#: The texts are invented: frequent driver words stand in for negations.
DRIVER_NEGATORS = ["with", "was", "nicht", "pas", "por"]


def doc_claims(spark, d):
    return V.sentences(spark, d).select("doc_id", F.col("pos").alias("claim_id"), F.col("sentence").alias("claim"))


@query("join04_claim_conflicts", f"WITH {CLAIMS}, n AS (SELECT s, claim_id, c24, {NEG('sentence', DRIVER_NEGATORS)} AS neg FROM cl) SELECT a.s AS doc_id, a.claim_id, min(b.claim_id) AS prior_id FROM n a JOIN n b ON a.s = b.s AND b.claim_id < a.claim_id AND a.neg <> b.neg WHERE len(list_intersect(a.c24, b.c24)) > 0 AND len(list_intersect(a.c24, b.c24))::DOUBLE / greatest(1, least(len(a.c24), len(b.c24))) >= 0.45 GROUP BY a.s, a.claim_id")
def join04(spark, d):
    return C.claim_conflicts(doc_claims(spark, d), "doc_id", DRIVER_NEGATORS)


@query("join05_candidate_pairs", f"WITH {CLAIMS}, p AS (SELECT a.s AS doc_id, a.claim_id, b.claim_id AS evidence_id, len(list_intersect(a.ca, b.cb)) AS shared, round(len(list_intersect(a.ca, b.cb))::DOUBLE / (len(a.ca) + len(b.cb) - len(list_intersect(a.ca, b.cb))), 6) AS overlap FROM cl a JOIN cl b ON a.s = b.s WHERE len(list_intersect(a.ca, b.cb)) > 0) SELECT doc_id, claim_id, evidence_id, shared, overlap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, claim_id ORDER BY overlap DESC, evidence_id) AS r FROM p) WHERE r <= 4")
def join05(spark, d):
    c = doc_claims(spark, d)
    return C.candidate_pairs(c, c.select("doc_id", F.col("claim_id").alias("evidence_id"), F.col("claim").alias("premise")), "doc_id", 4)


def nli_sql(premise, hypothesis):
    """Entailment, contradiction and neutral from lists pa, pb and texts; put into a FROM item."""
    o = D.jaccard("pa", "pb")
    return f"(SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, o - c * 0.5::DOUBLE)) AS e FROM (SELECT *, CASE WHEN o > 0.15 AND {NEG(premise, C.NLI_NEGATORS)} <> {NEG(hypothesis, C.NLI_NEGATORS)} THEN least(1.0::DOUBLE, o + 0.25::DOUBLE) ELSE 0.0::DOUBLE END AS c FROM (SELECT *, {o} AS o FROM PAIRS)))"


#: Evidence for a claim: its best documents by BM25, at most 8.
MOST_EVIDENCE = 8
PAIRS = f"{bm25_sql(DOCS, FIELDS, BOOSTS, MOST_EVIDENCE)}, pr AS (SELECT query_id, doc_id AS evidence_id, b.text AS hypo, d.text AS prem, {D.important('d.text', 80)} AS pa, {D.important('b.text', 120)} AS pb FROM ranked JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = doc), sc AS (SELECT query_id, evidence_id, e, c, greatest(0.0::DOUBLE, 1.0::DOUBLE - e - c) AS n FROM {nli_sql('prem', 'hypo').replace('PAIRS', 'pr')}), nl AS (SELECT query_id, evidence_id, round(e, 4) AS entailment, round(c, 4) AS contradiction, round(n, 4) AS neutral, CASE WHEN e >= greatest(c, n) THEN 'entailment' WHEN c >= n THEN 'contradiction' ELSE 'neutral' END AS label FROM sc)"


def nli_pairs(spark, d):
    b = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("hypo"))
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("prem"))
    hits = ret02(spark, d, MOST_EVIDENCE).select("query_id", F.col("doc").alias("evidence_id"))
    return C.scored_pairs(docs.join(hits, "evidence_id").join(b, "query_id"), "prem", "hypo").select("query_id", "evidence_id", "entailment", "contradiction", "neutral", "label")


@query("u01_heuristic_scores", f"WITH {PAIRS} SELECT * FROM nl")
def u01(spark, d):
    return nli_pairs(spark, d)


@query("join06_claim_support", f"WITH {PAIRS}, s AS (SELECT *, CASE WHEN contradiction >= 0.5 THEN 'contradicted' WHEN entailment >= 0.5 AND entailment >= neutral THEN 'entailed' ELSE 'unsupported' END AS st FROM nl), g AS (SELECT query_id, count(*) AS n_checked, count(*) FILTER (st = 'contradicted') AS nc, count(*) FILTER (st = 'entailed') AS ne FROM s GROUP BY query_id), bc AS (SELECT query_id, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY contradiction DESC, evidence_id) AS r FROM s WHERE st = 'contradicted') WHERE r = 1), be AS (SELECT query_id, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY entailment DESC, evidence_id) AS r FROM s WHERE st = 'entailed') WHERE r = 1) SELECT g.query_id, CASE WHEN nc > 0 THEN 'contradicted' WHEN ne > 0 THEN 'entailed' ELSE 'unsupported' END AS status, n_checked, CASE WHEN nc > 0 THEN bc.evidence_id WHEN ne > 0 THEN be.evidence_id END AS best_evidence FROM g LEFT JOIN bc USING (query_id) LEFT JOIN be USING (query_id)")
def join06(spark, d):
    return C.support(nli_pairs(spark, d), ["query_id"])


#: The mean of values of 4 places, rounded half up in whole numbers.
MEAN4 = lambda c: f"((2 * sum(CAST(round({c} * 10000) AS BIGINT)) + count(*)) // (2 * count(*)))::DOUBLE / 10000.0::DOUBLE"


@query("agg20_panel_consensus", f"WITH {PAIRS}, g AS (SELECT query_id, {MEAN4('entailment')} AS entailment, round(max(contradiction), 4) AS contradiction, {MEAN4('neutral')} AS neutral, list(label) AS l FROM nl GROUP BY query_id), h AS (SELECT *, CASE WHEN entailment >= contradiction AND entailment >= neutral THEN 'entailment' WHEN contradiction >= neutral THEN 'contradiction' ELSE 'neutral' END AS label FROM g) SELECT query_id, entailment, contradiction, neutral, label, round(len(list_filter(l, lambda x: x = label))::DOUBLE / len(l), 4) AS agreement FROM h")
def agg20(spark, d):
    return C.panel(nli_pairs(spark, d), "query_id")


@query("join16_first_source", f"WITH {SCORED}, u AS (SELECT doc_id, triple_id, 0 AS priority FROM scored WHERE confidence >= 0.8 UNION ALL SELECT doc_id, triple_id, 1 FROM scored WHERE confidence >= 0.4) SELECT doc_id, priority, triple_id FROM u WHERE priority = (SELECT min(priority) FROM u v WHERE v.doc_id = u.doc_id)")
def join16(spark, d):
    t = scored_triples(spark, d).select("doc_id", "triple_id", "confidence")
    return G.first_source([t.filter(f"confidence >= {x}").drop("confidence") for x in (0.8, 0.4)], "doc_id")


@query("agg01_subgraph_nodes", f"WITH {SCORED}, e AS (SELECT * FROM scored WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AND confidence >= 0.5) SELECT subject AS name FROM e UNION SELECT object FROM e")
def agg01(spark, d):
    t = scored_triples(spark, d)
    ids = t.join(V.table(spark, d, "labels").filter("quality = 0"), "doc_id", "left_semi").select("triple_id")
    return G.subgraph(t, ids, 0.5)[0]


def typed(spark, d):
    c = F.col
    return V.triples(spark, d).withColumns({"subject_type": R.entity_type(c("s_ebio"), c("s_ngen"), c("s_otro")), "object_type": R.entity_type(c("o_ebio"), c("o_ngen"), c("o_otro"))})


TYPE = lambda p: f"CASE WHEN {p}_ebio >= 0.7 THEN 'EBio' WHEN {p}_ngen >= {p}_otro AND {p}_ngen > 0 THEN 'NGen' ELSE 'other' END"


@query("agg02_entity_graph", f"WITH {D.TRIPLES}, x AS (SELECT subject AS name, {TYPE('s')} AS type, doc_id, pos, 0 AS side FROM triples UNION ALL SELECT object, {TYPE('o')}, doc_id, pos, 1 FROM triples), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id DESC, pos DESC, side) AS k, count(*) OVER (PARTITION BY name) AS degree FROM x) SELECT name, type, degree FROM r WHERE k = 1")
def agg02(spark, d):
    return G.entity_graph(typed(spark, d))


@query("agg02_entity_edges", f"WITH {D.TRIPLES}, e AS (SELECT *, concat_ws('|', article_id, subject, relation, object) AS eid FROM triples), r AS (SELECT *, row_number() OVER (PARTITION BY subject, object, eid ORDER BY doc_id DESC, pos DESC) AS k FROM e) SELECT subject AS source, object AS target, eid AS triple_id, relation, article_id, ((doc_id * 31 + pos * 17) % 101 / 100.0)::DOUBLE AS confidence, substr(sentence_text, 1, 1000) AS sentence_text FROM r WHERE k = 1")
def agg02_edges(spark, d):
    """Edges written from even documents, then updated by the others. Triples that a paper repeats have one id."""
    t = V.triples(spark, d).withColumn("triple_id", F.concat_ws("|", "article_id", "subject", "relation", "object")).withColumn("confidence", ((F.col("doc_id") * 31 + F.col("pos") * 17) % 101 / 100.0).cast("double"))
    return G.updated_edges(G.entity_edges(t.filter("doc_id % 2 = 0")), t.filter("doc_id % 2 = 1"))


@query("agg03_evidence_table", f"WITH {PAIRS} SELECT query_id, count(*) AS n, count(*) FILTER (label = 'entailment') AS n_entailment, count(*) FILTER (label = 'contradiction') AS n_contradiction, count(*) FILTER (label = 'neutral') AS n_neutral, array_to_string(list_slice(list(evidence_id ORDER BY evidence_id), 1, 5), ',') AS first_five FROM nl GROUP BY query_id")
def agg03(spark, d):
    count = lambda x: F.count_if(F.col("label") == x).alias(f"n_{x}")
    return nli_pairs(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), count("entailment"), count("contradiction"), count("neutral"), F.array_join(F.slice(F.array_sort(F.collect_list("evidence_id")), 1, 5), ",").alias("first_five"))


TURNS = f"{D.MEMORY}, tp AS (SELECT u.session_id, u.turn_index, u.text AS q, a.text AS a, {D.important('u.text', 80)} AS q80, {D.important('a.text', 120)} AS a120, {D.important('a.text', 80)} AS a80, {D.important('u.text', 40)} AS q40 FROM memory_docs u JOIN memory_docs a ON a.session_id = u.session_id AND a.turn_index = u.turn_index + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


def sentiment_sql(c):
    p, n = D.hits(c, T.POSITIVE), D.hits(c, T.NEGATIVE)
    return f"(CASE WHEN {p} + {n} = 0 THEN 0.0 ELSE ({p} - {n})::DOUBLE / ({p} + {n}) END)"


@query("agg05_lexical_features", f"WITH {TURNS} SELECT session_id, turn_index, round({D.jaccard('q80', 'a120')}, 6) AS overlap, {sentiment_sql('a')}::DOUBLE AS sentiment, round(CASE WHEN len(q40) = 0 THEN 0.0 ELSE len(list_intersect(q40, a80))::DOUBLE / len(q40) END, 6) AS alignment FROM tp")
def agg05(spark, d):
    q, a = F.col("question"), F.col("answer")
    q40 = T.important_terms(q, 40)
    return W.pairs(V.memory_docs(spark, d)).select("session_id", "turn_index", F.round(T.lexical_overlap(q, a), 6).alias("overlap"), T.sentiment(a).alias("sentiment"), F.round(F.when(F.size(q40) == 0, 0.0).otherwise(F.size(F.array_intersect(q40, T.important_terms(a, 80))) / F.size(q40)), 6).alias("alignment"))


SUPPORT = f"{TURNS}, cx AS (SELECT tp.session_id, tp.turn_index, max({D.jaccard('tp.a80', 'm.m120')}) AS support, count(*) AS n FROM tp JOIN (SELECT *, {D.important('text', 120)} AS m120 FROM memory_docs) m ON m.session_id = tp.session_id AND m.turn_index < tp.turn_index AND m.turn_index >= tp.turn_index - 3 GROUP BY ALL)"


def with_support(spark, d):
    m = V.memory_docs(spark, d)
    pairs = W.pairs(m)
    ctx = m.select("session_id", F.explode(F.sequence(F.col("turn_index") + 1, F.col("turn_index") + 3)).alias("turn_index"), "text")  # a row is context of the next three turns
    return W.context_support(pairs, ctx)


@query("agg05_context_support", f"WITH {SUPPORT} SELECT session_id, turn_index, round(coalesce(support, 0.0), 6)::DOUBLE AS support, coalesce(n, 0) AS n_context FROM tp LEFT JOIN cx USING (session_id, turn_index)")
def agg05b(spark, d):
    return with_support(spark, d).select("session_id", "turn_index", F.round("support", 6).alias("support"), "n_context")


#: What earlier steps of a turn would give, drawn from its ids, as the tables hold no such columns.
STAND_INS = {"entailment_avg": "((session_id * 3 + turn_index * 7) % 11) / 10.0", "contradiction_avg": "((session_id * 5 + turn_index) % 7) / 10.0", "n_claims": "(session_id + turn_index) % 5", "n_entailed": "((session_id + turn_index) % 5) // 2", "n_contradicted": "((session_id + turn_index) % 5) // 4", "n_unsupported": "((session_id + turn_index) % 5) // 3", "n_conflicts": "(session_id * 7 + turn_index) % 4", "frame_alignment": "((session_id + turn_index * 3) % 9) / 8.0", "frame_drift": "((session_id * 2 + turn_index) % 5) / 4.0", "n_prior_conflicts": "(session_id + turn_index * 5) % 4", "longitudinal": "((session_id * 11 + turn_index) % 6) / 5.0", "assembly_quality": "((session_id + turn_index) % 13) / 10.0", "n_feedback_accepted": "session_id % 6", "n_ungrounded": "(session_id + turn_index) % 3", "elapsed_sec": "(session_id * 13 + turn_index) % 45", "gap_closure": "((session_id + turn_index) % 4) / 3.0", "distractor_ratio": "((session_id * 2 + turn_index) % 4) / 3.0"}
EDGES = "CASE session_id % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'partial' ELSE 'supported' END"
#: The texts are invented: frequent words stand in for the vocabularies of mechanisms and pharmacology.
TOPIC, FOREIGN = ["the", "and", "der"], ["with", "was", "pas"]
STAND_IN_SQL = ", ".join(f"({v})::DOUBLE AS {k}" for k, v in STAND_INS.items()).replace("session_id", "tp.session_id").replace("turn_index", "tp.turn_index")
UNIT = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"
SHARE_OF = lambda c: f"CASE WHEN n_claims > 0 THEN {c}::DOUBLE / n_claims ELSE 0.0 END"
REWARD_TERMS = {
    "relevance": D.jaccard("q80", "a120"),
    "support": f"greatest(coalesce(best, 0.0), {D.jaccard('a80', 'whole')})",
    "factuality": UNIT("entailment_avg - contradiction_avg"),
    "citation_coverage": SHARE_OF("n_entailed"),
    "alignment": "CASE WHEN len(q40) = 0 THEN 0.0 ELSE len(list_intersect(q40, list_concat(a80, seen)))::DOUBLE / len(q40) END",
    "frame_alignment": "frame_alignment",
    "sentiment_gain": f"greatest(0.0::DOUBLE, {sentiment_sql('a')}::DOUBLE - {sentiment_sql('q')}::DOUBLE)",
    "has_context": "CASE WHEN n > 0 THEN 1.0 ELSE 0.25 END",
    "conflict_free": "1.0::DOUBLE - least(1.0::DOUBLE, 0.35::DOUBLE * n_conflicts)",
    "assembly_quality": UNIT("assembly_quality"),
    "claim_contradiction": SHARE_OF("n_contradicted"),
    "unsupported": SHARE_OF("n_unsupported"),
    "off_topic": f"CASE WHEN ({D.hits('q', TOPIC)} > 0 OR contains(lower(q), 'functional synergy')) AND {D.hits('q', T.ASKS_PHARMACOLOGY)} = 0 AND {D.hits('q', FOREIGN)} = 0 THEN round(least(1.0::DOUBLE, ({D.hits('a', FOREIGN)} + CASE WHEN {D.hits('a', FOREIGN)} > 0 THEN 0.25::DOUBLE * {D.hits('joined', FOREIGN)} ELSE 0.0 END) / 4.0::DOUBLE), 4) ELSE 0.0 END",
    "frame_drift": "frame_drift",
    "prior_conflict": "least(1.0::DOUBLE, n_prior_conflicts / 2.0::DOUBLE)",
    "longitudinal": "longitudinal",
    "query_drift": "least(1.0::DOUBLE, n_ungrounded::DOUBLE / greatest(1, n_feedback_accepted + n_ungrounded))",
    "unsupported_bridge": f"CASE WHEN n_unsupported > 0 AND n_claims > 0 THEN least(1.0::DOUBLE, CASE edge_support WHEN 'missing' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END * ({SHARE_OF('n_unsupported')})) ELSE 0.0 END",
    "latency": "least(1.0::DOUBLE, elapsed_sec / 30.0::DOUBLE)",
    "tokens": "least(1.0::DOUBLE, (length(a) // 4) / 600.0::DOUBLE)",
}
SCORE = " + ".join(f"{w}::DOUBLE * {k}" for k, w in W.WEIGHTS.items())
REWARDS = f"{TURNS}, cx AS (SELECT tp.session_id, tp.turn_index, max({D.jaccard('tp.a80', 'm.m120')}) AS best, count(*) AS n, string_agg(m.text, chr(10) ORDER BY m.turn_index) AS joined, flatten(list(m.m80)) AS seen FROM tp JOIN (SELECT *, {D.important('text', 120)} AS m120, {D.important('text', 80)} AS m80 FROM memory_docs) m ON m.session_id = tp.session_id AND m.turn_index < tp.turn_index AND m.turn_index >= tp.turn_index - 3 GROUP BY ALL), fe AS (SELECT tp.*, best, coalesce(n, 0) AS n, coalesce(joined, '') AS joined, coalesce(seen, []) AS seen, {D.important('joined', 120)} AS whole, {EDGES.replace('session_id', 'tp.session_id')} AS edge_support, {STAND_IN_SQL} FROM tp LEFT JOIN cx ON cx.session_id = tp.session_id AND cx.turn_index = tp.turn_index), te AS (SELECT session_id, turn_index, gap_closure, distractor_ratio, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in REWARD_TERMS.items())} FROM fe)"


@query("agg04_turn_reward", f"WITH {REWARDS} SELECT session_id, turn_index, round({UNIT(UNIT(f'{SCORE} + 0.04::DOUBLE * gap_closure - 0.04::DOUBLE * distractor_ratio'))}, 4) AS score, {', '.join(f'round({k}, 4) AS {k}' for k in W.WEIGHTS)} FROM te")
def agg04(spark, d):
    m = V.memory_docs(spark, d)
    ctx = m.select("session_id", F.col("turn_index").alias("m_turn"), F.explode(F.sequence(F.col("turn_index") + 1, F.col("turn_index") + 3)).alias("turn_index"), "text")
    ctx = ctx.groupBy("session_id", "turn_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("m_turn", "text"))), lambda x: x["text"]).alias("context"))
    turns = W.pairs(m).join(ctx, ["session_id", "turn_index"], "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
    turns = turns.withColumns({k: F.expr(v.replace("//", "div")).cast("double") for k, v in STAND_INS.items()} | {"edge_support": F.expr(EDGES), "messages": F.col("context")})
    return W.reward_report(turns, 600, TOPIC, FOREIGN).select("session_id", "turn_index", "score", *W.WEIGHTS)


@query("agg06_query_novelty", f"WITH t AS (SELECT DISTINCT conv_id, turn, unnest({D.terms('text')}) AS term FROM conversations), f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, term) AS ft FROM t), s AS (SELECT conv_id, turn, round(count(*) FILTER (ft = turn)::DOUBLE / count(*), 4) AS novelty FROM f GROUP BY ALL), l AS (SELECT conv_id, min(turn) AS lead FROM conversations GROUP BY conv_id) SELECT c.conv_id, c.turn, CASE WHEN c.turn = lead THEN 1.0 ELSE coalesce(novelty, 0.0) END::DOUBLE AS novelty FROM conversations c LEFT JOIN s USING (conv_id, turn) JOIN l USING (conv_id)")
def agg06(spark, d):
    return W.query_novelty(V.table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query")), "conv_id", "turn")


HITS = f"{bm25_sql(DOCS, FIELDS, BOOSTS, 5)}, ht AS (SELECT ranked.*, text FROM ranked JOIN documents ON doc_id = doc)"


@query("agg06_distractor_ratio", f"WITH {HITS}, an AS (SELECT item_id AS query_id, unnest({D.important('text', 4)}) AS anchor FROM benchmark), m AS (SELECT query_id, doc, max(coalesce(contains(lower(text), anchor), false)) AS ok FROM ht LEFT JOIN an USING (query_id) GROUP BY ALL) SELECT query_id, round(count(*) FILTER (NOT ok)::DOUBLE / count(*), 4) AS distractor_ratio FROM m GROUP BY query_id")
def agg06b(spark, d):
    return W.distractors(hit_texts(spark, d), anchors(spark, d))


@query("agg07_frame_alignment", f"WITH {TURNS}, fr AS (SELECT session_id, turn_index, {D.important('q', 18)} AS active, list_slice({D.terms('q')}, 1, 2) AS avoided, list_distinct({D.terms('a')}) AS t FROM tp), h AS (SELECT *, len(list_intersect(t, active)) AS ha, len(list_intersect(t, avoided)) AS hv FROM fr) SELECT session_id, turn_index, round(least(1.0::DOUBLE, ha::DOUBLE / greatest(1, least(len(active), 12))), 4) AS alignment, round(CASE WHEN len(active) > 0 AND ha = 0 THEN greatest(least(1.0::DOUBLE, hv / 4.0::DOUBLE), 0.25::DOUBLE) ELSE least(1.0::DOUBLE, hv / 4.0::DOUBLE) END, 4) AS drift FROM h")
def agg07b(spark, d):
    p = W.pairs(V.memory_docs(spark, d))
    q = F.col("question")
    frames = p.select("session_id", "turn_index", T.important_terms(q, 18).alias("active"), F.array_distinct(F.slice(T.terms(q), 1, 2)).alias("avoided"))
    return W.frame_alignment(frames, p.select("session_id", "turn_index", "answer"), ["session_id", "turn_index"])


COUNTS = {k: STAND_INS[k] for k in ("n_claims", "n_contradicted", "n_unsupported", "n_prior_conflicts")}
COUNT_SQL = ", ".join(f"({v})::BIGINT AS {k}" for k, v in COUNTS.items())
RATE = lambda c: f"least(1.0::DOUBLE, {c}::DOUBLE / greatest(1, n_claims))"


@query("agg07_consistency_report", f"WITH {TURNS}, fr AS (SELECT session_id, turn_index, {D.important('q', 18)} AS active, list_slice({D.terms('q')}, 1, 2) AS avoided, list_distinct({D.terms('a')}) AS t FROM tp), h AS (SELECT *, len(list_intersect(t, active)) AS ha, len(list_intersect(t, avoided)) AS hv FROM fr), al AS (SELECT session_id, turn_index, {COUNT_SQL}, round(least(1.0::DOUBLE, ha::DOUBLE / greatest(1, least(len(active), 12))), 4) AS alignment, round(CASE WHEN len(active) > 0 AND ha = 0 THEN greatest(least(1.0::DOUBLE, hv / 4.0::DOUBLE), 0.25::DOUBLE) ELSE least(1.0::DOUBLE, hv / 4.0::DOUBLE) END, 4) AS drift FROM h) SELECT session_id, turn_index, alignment, drift, round({RATE('n_contradicted')}, 4) AS contradicted_rate, round({RATE('n_unsupported')}, 4) AS unsupported_rate, round(least(1.0::DOUBLE, n_prior_conflicts / 2.0::DOUBLE), 4) AS prior_conflict_rate, round(least(1.0::DOUBLE, 0.35::DOUBLE * {RATE('n_contradicted')} + 0.20::DOUBLE * {RATE('n_unsupported')} + 0.25::DOUBLE * least(1.0::DOUBLE, n_prior_conflicts / 2.0::DOUBLE) + 0.20::DOUBLE * drift), 4) AS penalty, concat_ws(',', CASE WHEN drift > 0 THEN 'frame_drift' END, CASE WHEN n_contradicted > 0 THEN 'source_contradiction' END, CASE WHEN n_prior_conflicts > 0 THEN 'prior_memory_conflict' END) AS warnings FROM al")
def agg07(spark, d):
    p = W.pairs(V.memory_docs(spark, d))
    q = F.col("question")
    frames = p.select("session_id", "turn_index", T.important_terms(q, 18).alias("active"), F.array_distinct(F.slice(T.terms(q), 1, 2)).alias("avoided"))
    rows = W.frame_alignment(frames, p.select("session_id", "turn_index", "answer"), ["session_id", "turn_index"])
    rows = W.consistency_report(rows.withColumns({k: F.expr(v.replace("//", "div")) for k, v in COUNTS.items()}))
    return rows.drop(*COUNTS).withColumn("warnings", F.array_join("warnings", ","))


@query("agg08_policy_replay")
def agg08(spark, d):
    m = V.memory_docs(spark, d)
    return Rp.replay_summary(m, 300, 3).withColumn("budget", F.lit(300)).unionByName(Rp.replay_summary(m, 120, 3).withColumn("budget", F.lit(120)))


WEIGHTS = {"click": 0.3, "view": 0.2, "purchase": 0.25, "signup": 0.15, "error": 0.1}


@query("agg09_weighted_score", f"WITH {D.EVENTS}, c AS (SELECT scope, state_key, avg(reward) AS value FROM turn_events WHERE reward IS NOT NULL GROUP BY ALL), g AS (SELECT scope, sum(value * w) AS good FROM c JOIN (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {v}::DOUBLE)' for k, v in WEIGHTS.items())}) v(state_key, w) USING (state_key) GROUP BY scope), p AS (SELECT scope, action, max(reward) * 0.02::DOUBLE AS amount FROM turn_events WHERE reward IS NOT NULL AND state_key = 'error' GROUP BY ALL), b AS (SELECT scope, sum(amount) AS bad FROM p GROUP BY scope) SELECT scope, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, good - coalesce(bad, 0.0))), 4) AS score FROM g LEFT JOIN b USING (scope)")
def agg09(spark, d):
    e = V.turn_events(spark, d).filter("reward IS NOT NULL")
    scores = e.groupBy("scope", "state_key").agg(F.avg("reward").alias("value")).withColumnRenamed("state_key", "component")
    weights = spark.createDataFrame(list(WEIGHTS.items()), "component string, weight double")
    pen = e.filter("state_key = 'error'").select("scope", F.col("action").alias("type"), (F.col("reward") * F.lit(0.02)).alias("amount"))
    return W.weighted(scores, weights, pen, "scope")


@query("agg10_capped_penalties", f"WITH {D.EVENTS} SELECT scope, action AS type, max(reward) AS amount, count(*) AS n FROM turn_events WHERE state_key = 'error' AND reward IS NOT NULL GROUP BY ALL")
def agg10(spark, d):
    e = V.turn_events(spark, d).filter("state_key = 'error' AND reward IS NOT NULL")
    return W.capped(e.select("scope", F.col("action").alias("type"), F.col("reward").alias("amount")), "scope")


@query("agg14_run_summary", f"WITH {D.EVENTS}, t AS (SELECT state_key, count(*) AS turns, round(avg(reward), 6) AS mean_reward, count(*) FILTER (reward < 0.1) AS failed FROM turn_events GROUP BY state_key), m AS (SELECT state_key, count(*) AS traps, count(*) FILTER (coalesce(reward, 0.0) < 0.05) AS missed_traps FROM turn_events WHERE action = 3 GROUP BY state_key) SELECT state_key, turns, mean_reward, failed, coalesce(traps, 0) AS traps, coalesce(missed_traps, 0) AS missed_traps FROM t LEFT JOIN m USING (state_key)")
def agg14(spark, d):
    e = V.turn_events(spark, d)
    traps = e.filter("action = 3").select("state_key", (F.coalesce("reward", F.lit(0.0)) < 0.05).alias("missed"))
    return W.run_summary(e, traps, "state_key", 0.1)


@query("agg15_compared_runs", f"WITH {D.EVENTS}, a AS (SELECT scope, round(avg(reward), 6) AS before FROM turn_events WHERE action < 5 GROUP BY scope), b AS (SELECT scope, round(avg(reward), 6) AS after FROM turn_events WHERE action >= 5 GROUP BY scope) SELECT scope, before, after, round(after - before, 4) AS delta FROM a FULL JOIN b USING (scope)")
def agg15(spark, d):
    e = V.turn_events(spark, d)
    mean = lambda x: x.groupBy("scope").agg(F.round(F.avg("reward"), 6).alias("v"))
    return W.compared(mean(e.filter("action < 5")), mean(e.filter("action >= 5")), "scope", "v")


@query("agg16_selected_sources", "SELECT doc_id, source FROM documents WHERE regexp_matches(source, '^src[0-9]$') AND CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 2 = 0")
def agg16(spark, d):
    return V.table(spark, d, "documents").filter(F.col("source").rlike("^src[0-9]$") & (F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 2 == 0)).select("doc_id", "source")


IDEAS = f"{D.MEMORY}, id AS (SELECT session_id, importance AS reward, {D.important('text', 16)} AS ideas FROM memory_docs)"


def idea_turns(spark, d):
    return V.memory_docs(spark, d).select("session_id", "turn_index", F.col("importance").alias("reward"), T.important_terms(F.col("text"), 16).alias("ideas"))


@query("agg19_idea_statistics", f"WITH {IDEAS}, g AS (SELECT idea, count(*) AS frequency, count(DISTINCT session_id) AS sessions, round(avg(reward), 6) AS reward_avg FROM (SELECT session_id, reward, unnest(ideas) AS idea FROM id) GROUP BY idea) SELECT *, round(least(1.0::DOUBLE, 0.40::DOUBLE * ln(1 + frequency) / ln(33.0::DOUBLE) + 0.30::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, reward_avg)) + 0.20::DOUBLE), 4) AS importance FROM g")
def agg19(spark, d):
    return G.idea_statistics(idea_turns(spark, d))


@query("agg19_cooccurrence", f"WITH {IDEAS} SELECT a AS idea, b AS other, count(*) AS n FROM (SELECT a, unnest(ideas) AS b FROM (SELECT ideas, unnest(ideas) AS a FROM id)) WHERE a < b GROUP BY ALL HAVING count(*) >= 2")
def agg19b(spark, d):
    return G.cooccurrence(idea_turns(spark, d), 16)


@query("agg21_provider_summary", f"WITH {D.EVENTS} SELECT state_key AS name, count(*) AS calls, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failure, round(avg(reward), 4) AS mean_value, arg_max(action, (ts, event_id)) AS last_status FROM (SELECT *, reward > 0.2 AS ok FROM turn_events) GROUP BY state_key")
def agg21(spark, d):
    e = V.turn_events(spark, d)
    return G.provider_summary(e.select(F.col("state_key").alias("name"), "ts", "event_id", (F.col("reward") > 0.2).alias("ok"), F.col("reward").alias("value"), F.col("action").alias("status")))


@query("agg22_promoted_terms", f"WITH {D.EVENTS}, p AS (SELECT action AS run, scope AS term FROM turn_events GROUP BY ALL HAVING count(*) >= 3 AND avg(CAST(reward > 0.1 AS DOUBLE)) >= 0.5) SELECT term, count(*) AS runs FROM p WHERE term NOT IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY term HAVING count(*) >= 2".replace("event_type = 'error'", "event_id % 97 = 0"))
def agg22(spark, d):
    e = V.turn_events(spark, d)
    known = V.table(spark, d, "events").filter("event_id % 97 = 0").select(F.col("user_id").alias("term"))
    return G.promoted_terms(e.select(F.col("action").alias("run"), F.col("scope").alias("term"), (F.col("reward") > 0.1).alias("ok")), known, 0.5, 3, 2)


EPISODE = "turn_index // 4 AS episode, importance >= 0.95 AS supported, importance AS reward"


@query("agg25_episodes", f"WITH {D.MEMORY}, m AS (SELECT *, {EPISODE} FROM memory_docs), g AS (SELECT session_id, episode, min(turn_index) AS first_turn, max(turn_index) AS last_turn, count(*) AS n, count(*) FILTER (supported) AS n_supported, max(reward) AS rw, string_agg(coalesce(text, ''), ' ' ORDER BY turn_index) AS joined, list(role || ': ' || substr(coalesce(text, ''), 1, 260) ORDER BY turn_index) FILTER (supported) AS sup, list(role || ': ' || substr(coalesce(text, ''), 1, 260) ORDER BY importance DESC, turn_index DESC) AS best FROM m GROUP BY session_id, episode) SELECT session_id, episode, first_turn, last_turn, n, array_to_string({D.important('joined', 18)}, ' ') AS focus, array_to_string(list_slice(CASE WHEN n_supported > 0 THEN sup ELSE best END, 1, 6), ' | ') AS facts, n_supported, round(greatest(0.4::DOUBLE, least(1.0::DOUBLE, 0.45::DOUBLE + 0.35::DOUBLE * rw + 0.05::DOUBLE * n_supported)), 4) AS importance FROM g")
def agg25(spark, d):
    rows = V.memory_docs(spark, d).withColumns({"episode": F.floor(F.col("turn_index") / 4).cast("int"), "supported": F.col("importance") >= 0.95, "reward": F.col("importance")})
    return Win.episodes(rows, ["session_id", "episode"]).withColumns({"focus": F.array_join("focus", " "), "facts": F.array_join("facts", " | ")})


@query("set01_evidence_union", f"WITH {D.SENTENCES}, u AS (SELECT 'pinned' AS source, 0 AS p, doc_id, pos, sentence AS text FROM sentences WHERE length(sentence) >= 120 UNION ALL SELECT 'memory', 1, doc_id, pos, sentence FROM sentences), e AS (SELECT 'ev_' || substr(sha256(doc_id || chr(10) || pos || chr(10) || substr(text, 1, 240)), 1, 24) AS evidence_id, source, p, text FROM u) SELECT evidence_id, source, text FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY p, text) AS r FROM e) WHERE r = 1")
def set01(spark, d):
    s = V.sentences(spark, d).withColumnRenamed("sentence", "text")
    return G.evidence_union([("pinned", s.filter("length(text) >= 120")), ("memory", s)])


@query("set02_selected_context", f"WITH {D.MEMORY}, {D.SENTENCES} SELECT 'memory' AS origin, session_id AS id, text, CAST(NULL AS BIGINT) AS pos FROM memory_docs UNION ALL SELECT 'document', doc_id, sentence, pos FROM sentences")
def set02(spark, d):
    a = V.memory_docs(spark, d).select(F.lit("memory").alias("origin"), F.col("session_id").alias("id"), "text")
    b = V.sentences(spark, d).select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.col("sentence").alias("text"), "pos")
    return a.unionByName(b, allowMissingColumns=True)


@query("set03_term_sets", f"WITH {TURNS} SELECT session_id, turn_index, len(list_intersect(q80, a120)) AS n_both, len(list_distinct(list_concat(q80, a120))) AS n_any, len(list_filter(q80, lambda x: NOT list_contains(a120, x))) AS n_only FROM tp")
def set03(spark, d):
    q, a = T.important_terms(F.col("question"), 80), T.important_terms(F.col("answer"), 120)
    n = lambda c: F.size(c).cast("long")
    return W.pairs(V.memory_docs(spark, d)).select("session_id", "turn_index", n(F.array_intersect(q, a)).alias("n_both"), n(F.array_union(q, a)).alias("n_any"), n(F.array_except(q, a)).alias("n_only"))


@query("set03_shared_entities", f"WITH {D.TRIPLES} SELECT subject AS name FROM triples INTERSECT SELECT object FROM triples")
def set03b(spark, d):
    t = V.triples(spark, d)
    return t.select(F.col("subject").alias("name")).intersect(t.select("object"))


@query("str03_term_counts", f"WITH {D.EVENTS}, g AS (SELECT scope, action AS term, round(1 + sum(greatest(0.0::DOUBLE, u)), 6) AS alpha, round(1 + sum(greatest(0.0::DOUBLE, -u)), 6) AS beta, count(*) AS updates FROM (SELECT *, reward - 0.25::DOUBLE AS u FROM turn_events WHERE reward IS NOT NULL) GROUP BY ALL HAVING count(*) >= 2) SELECT *, round(alpha / (alpha + beta), 6) AS mean FROM g")
def str03(spark, d):
    e = V.turn_events(spark, d).filter("reward IS NOT NULL")
    return G.term_beta(e.select("scope", F.col("action").alias("term"), (F.col("reward") - F.lit(0.25)).alias("utility")))


@query("clm01_atomic_claims")
def clm01(spark, d):
    return C.atomic_claims(V.table(spark, d, "conversations").filter("role = 'assistant'"), ["conv_id", "turn"], "text")
