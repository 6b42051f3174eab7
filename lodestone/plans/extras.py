"""Queries of anchors, concepts, assembly, multi-level retrieval, comparability and frames (PRJ, RET, JOIN, WIN, AGG, UPS)."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import claims as C
from lodestone.operators import expansion as E
from lodestone.operators import graph as G
from lodestone.operators import retrieval as X
from lodestone.operators import rewards as Rw
from lodestone.operators import stored as St
from lodestone.plans import duck as D
from lodestone.plans import ranked as K
from lodestone.plans.columns import redact_sql
from lodestone.plans.judged import IDEAS, MOST_EVIDENCE, PAIRS, idea_turns, nli_pairs
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


def concept_sql(c):
    t = f"array_to_string(regexp_extract_all(replace(lower(coalesce({c}, '')), '-', ' '), '[a-z0-9]+'), ' ')"
    return f"(SELECT CASE WHEN ends_with(t, 'ies') AND length(t) > 4 THEN substr(t, 1, length(t) - 3) || 'y' WHEN ends_with(t, 's') AND length(t) > 4 AND NOT ends_with(t, 'ss') AND NOT ends_with(t, 'ous') THEN substr(t, 1, length(t) - 1) ELSE t END FROM (SELECT {t} AS t))"


@query("prj11_concepts", f"WITH {D.TRIPLES}, c AS (SELECT triple_id, {concept_sql('subject')} AS k FROM triples), i AS (SELECT triple_id, coalesce(canonical, k) AS idea FROM c LEFT JOIN (VALUES ('the', 'definite article'), ('der', 'definite article')) v(k, canonical) USING (k)) SELECT triple_id, idea, CASE WHEN contains(idea, ' ') THEN split_part(idea, ' ', 1) END AS parent FROM i")
def prj11(spark, d):
    syn = spark.createDataFrame([("the", "definite article"), ("der", "definite article")], "concept string, canonical string")
    return E.concepts(V.triples(spark, d), "triple_id", "subject", syn)


@query("prj16_lettered_options", r"WITH t AS (SELECT doc_id, 'a) ' || replace(text, chr(10), chr(10) || 'b) ') AS t FROM documents), l AS (SELECT doc_id, regexp_extract_all(lower(t), '(?m)^\s*\(?([a-h])[).:]\s+\S', 1) AS l FROM t) SELECT doc_id, len(l) >= 2 AND len(list_filter(l, lambda x, i: ascii(x) <> 96 + i)) = 0 AS offers FROM l")
def prj16(spark, d):
    t = F.concat(F.lit("a) "), F.replace(F.col("text"), F.lit("\n"), F.lit("\nb) ")))
    return V.table(spark, d, "documents").select("doc_id", T.offers_options(t).alias("offers"))


MODES = [("question", r"\?"), ("list", r"(^|[^a-z])(and|und|et)([^a-z]|$)"), ("short", r"^.{0,80}$")]


@query("prj18_answer_mode", r"SELECT conv_id, turn, CASE WHEN contains(text, '?') THEN 'question' WHEN regexp_matches(lower(text), '(^|[^a-z])(and|und|et)([^a-z]|$)') THEN 'list' WHEN regexp_matches(lower(text), '^.{0,80}$') THEN 'short' ELSE 'plain' END AS mode FROM conversations")
def prj18(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", E.answer_mode(F.col("text"), MODES, "plain").alias("mode"))


@query("prj19_correction_terms", f"WITH {D.TRIPLES} SELECT triple_id, array_to_string({D.important('subject', 8)}, ' ') AS avoid, array_to_string({D.important('object', 8)}, ' ') AS prefer FROM triples WHERE subject NOT IN ('use', 'focus') AND position(subject IN object) = 0")
def prj19(spark, d):
    t = V.triples(spark, d).filter("subject NOT IN ('use', 'focus') AND position(subject, object) = 0")
    avoid, prefer = T.correction_terms(F.concat(F.lit("instead of "), "subject", F.lit(", "), "object", F.lit(".")))
    return t.select("triple_id", F.array_join(avoid, " ").alias("avoid"), F.array_join(prefer, " ").alias("prefer"))


@query("prj22_bridge_terms", f"SELECT item_id, array_to_string({D.first_seen('list_concat(list_concat(CASE WHEN contains(lower(text), ' + chr(39) + 'the' + chr(39) + ') THEN [' + chr(39) + 'evidence' + chr(39) + '] ELSE [] END, CASE WHEN contains(lower(text), ' + chr(39) + 'and' + chr(39) + ') THEN [' + chr(39) + 'relationship' + chr(39) + ', ' + chr(39) + 'evidence' + chr(39) + '] ELSE [] END), ' + D.important('text', 3) + ')')}, ' ') AS bridge FROM benchmark")
def prj22(spark, d):
    return V.table(spark, d, "benchmark").select("item_id", F.array_join(T.bridge_terms(F.col("text"), {"the": ["evidence"], "and": ["relationship", "evidence"]}), " ").alias("bridge"))


GENERIC = f"ge AS (SELECT term FROM (SELECT DISTINCT conv_id, turn, unnest({D.terms('text')}) AS term FROM conversations) GROUP BY term HAVING count(*) >= 40)"


def generic(spark, d):
    t = V.table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n")).filter("n >= 40").select("term")


@query("prj23_query_anchors", f"WITH {GENERIC}, t AS (SELECT item_id AS query_id, {D.important('text', 40)} AS l FROM benchmark), x AS (SELECT query_id, unnest(l) AS term, unnest(range(0, len(l))) AS p FROM t) SELECT query_id, place, anchor FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS place, coalesce(expansion, term) AS anchor FROM x LEFT JOIN (VALUES ('thon', 'then or now')) v(term, expansion) USING (term) WHERE term NOT IN (SELECT term FROM ge)) WHERE place <= 6")
def prj23(spark, d):
    aliases = spark.createDataFrame([("thon", "then or now")], "term string, expansion string")
    return E.query_anchors(K.asked(spark, d), generic(spark, d), aliases, 6)


@query("prj24_external_query", f"WITH r AS (SELECT doc_id, regexp_replace({'RED'}, '\\[[a-z]+\\]', ' ', 'g') AS t FROM documents) SELECT doc_id, array_to_string(list_slice(list_filter({D.important('t', 40)}, lambda x: x NOT IN ('einen', 'thing')), 1, 12), ' ') AS query FROM r".replace("RED", redact_sql("text")))
def prj24(spark, d):
    return V.table(spark, d, "documents").select("doc_id", E.external_query(F.col("text"), ["einen", "thing"], 12).alias("query"))


@query("ret15_seed_preserved", f"WITH p AS (SELECT a.item_id AS query_id, {D.important('a.text', 40)} AS s, {D.important('b.text || a.text', 40)} AS c FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1) SELECT query_id, len(list_intersect(s, c)) >= 0.5::DOUBLE * len(s) AND len(list_filter(c, lambda x: NOT list_contains(s, x))) <= 0.6::DOUBLE * greatest(1, len(c)) AS preserved FROM p")
def ret15(spark, d):
    b = V.table(spark, d, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(nxt, "item_id").select(F.col("item_id").alias("query_id"), E.preserves_seed(F.col("text"), F.concat("other", "text")).alias("preserved"))


@query("ret13_ranked_ideas", f"WITH {IDEAS}, g AS (SELECT idea, round(least(1.0::DOUBLE, 0.40::DOUBLE * ln(1 + count(*)) / ln(33.0::DOUBLE) + 0.30::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(avg(reward), 6))) + 0.20::DOUBLE), 4) AS importance FROM (SELECT session_id, reward, unnest(ideas) AS idea FROM id) GROUP BY idea), q AS (SELECT DISTINCT item_id AS query_id, unnest({D.terms('text')}) AS idea FROM benchmark) SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, idea) AS rank, idea, round(importance + 1, 4) AS score FROM q JOIN g USING (idea)) WHERE rank <= 8")
def ret13(spark, d):
    ideas = G.idea_statistics(idea_turns(spark, d)).select("idea", "importance")
    q = K.asked(spark, d).select("query_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("idea"))
    return X.top(q.join(ideas, "idea"), "query_id", [F.desc("importance"), "idea"], 8).select("query_id", "rank", "idea", F.round(F.col("importance") + 1, 4).alias("score"))


ASM = f"{K.HITS}, an AS (SELECT item_id AS query_id, unnest({D.important('text', 4)}) AS anchor FROM benchmark), mm AS (SELECT an.query_id, anchor, doc, coalesce(contains(lower(text), anchor), false) AS ok FROM an LEFT JOIN ht USING (query_id)), nd AS (SELECT query_id, count(*) AS nodes, count(*) FILTER (ok) AS covered FROM (SELECT query_id, anchor, max(ok) AS ok FROM mm GROUP BY ALL) GROUP BY query_id), rn AS (SELECT query_id, count(*) FILTER (k >= 2) AS relations FROM (SELECT query_id, doc, count(*) AS k FROM mm WHERE ok GROUP BY ALL) GROUP BY query_id), asm AS (SELECT query_id, nodes, covered, coalesce(relations, 0) AS relations FROM nd LEFT JOIN rn USING (query_id))"


@query("ret23_evidence_assembly", f"WITH {ASM}, q AS (SELECT *, least(1.0::DOUBLE, 0.7::DOUBLE * covered / greatest(1, nodes) + 0.1::DOUBLE * relations) AS ql FROM asm) SELECT query_id, nodes, covered, relations, CASE WHEN covered = nodes AND relations > 0 THEN 'supported' WHEN covered > 0 THEN 'partial' ELSE 'missing' END AS status, round(CASE WHEN relations = 0 THEN least(ql, 0.5::DOUBLE) ELSE ql END, 4) AS quality FROM q")
def ret23(spark, d):
    return E.assembled(K.hit_texts(spark, d), K.anchors(spark, d))


@query("ret25_merged_sources", f"WITH {K.TEXT_HITS}, {K.NEAR}, u AS (SELECT query_id, doc, round(score + 0.2::DOUBLE, 6) AS score, 'text' AS source FROM ranked UNION ALL SELECT query_id, doc, round(score + 0.5::DOUBLE, 6), 'vector' FROM near), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY score DESC, source) AS r FROM u) WHERE r = 1) SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank, doc, source, score FROM f) WHERE rank <= 6")
def ret25(spark, d):
    return E.merged_sources([("text", 0.2, K.text_hits(spark, d)), ("vector", 0.5, K.near(spark, d))], 6)


@query("ret31_open_nodes", f"WITH {K.HITS}, an AS (SELECT item_id AS query_id, unnest({D.important('text', 4)}) AS node FROM benchmark), h AS (SELECT an.query_id, node, max(coalesce(contains(lower(text), node), false)) AS ok FROM an LEFT JOIN ht USING (query_id) GROUP BY ALL) SELECT query_id, min(ok) AS covered FROM h GROUP BY query_id")
def ret31(spark, d):
    return E.open_nodes_covered(K.anchors(spark, d).withColumnRenamed("anchor", "node"), K.hit_texts(spark, d))


@query("ret32_reusable_notes", f"WITH t AS (SELECT conv_id, turn, {D.important('text', 8)} AS a FROM conversations), q AS (SELECT conv_id, turn, unnest(a) AS x FROM t), n AS (SELECT conv_id, turn, unnest(a) AS x FROM t WHERE turn = 0) SELECT q.conv_id || ':' || q.turn AS query_id, n.conv_id || ':' || n.turn AS note_id, count(*) AS shared FROM q JOIN n ON q.conv_id = n.conv_id AND q.x = n.x WHERE q.turn > 0 GROUP BY ALL HAVING count(*) >= 2")
def ret32(spark, d):
    t = V.table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "turn", T.important_terms(F.col("text"), 8).alias("anchors"))
    return E.reusable_notes(t.filter("turn > 0").withColumnRenamed("id", "query_id"), t.filter("turn = 0").withColumnRenamed("id", "note_id"), 2)


@query("ret19_multilevel_retrieval")
def ret19(spark, d):
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared(spark))
    docs, index = V.table(spark, d, "documents").select("doc_id", "text"), K.stored(spark, d, "documents")
    return E.multilevel(K.asked(spark, d), [("title", docs, index, "text", {"title": 4.0}, 3), ("paper", docs, index, "text", {"title": 1.0, "body": 2.0}, 4), ("sentence", docs, index, "text", {"body": 1.0}, 6)])


@query("prj26_pipeline_trace", f"WITH {ASM}, n AS (SELECT query_id, count(*) AS hits, round(max(score), 4) AS best FROM ht GROUP BY query_id) SELECT item_id AS query_id, coalesce(hits, 0) AS hits, best, coalesce(covered, 0) AS covered, coalesce(relations, 0) AS relations FROM benchmark LEFT JOIN n ON n.query_id = item_id LEFT JOIN asm ON asm.query_id = item_id")
def prj26(spark, d):
    n = K.ret02(spark, d).groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 4).alias("best"))
    a = ret23(spark, d).select("query_id", "covered", "relations")
    return K.asked(spark, d).select("query_id").join(n, "query_id", "left").join(a, "query_id", "left").na.fill(0, ["hits", "covered", "relations"])


#: Common words stand in for relations, diseases and negation.
REL, COND, NEGS = ["was", "ist", "est"], ["for", "pour", "para"], r"(?i)\b(with|nicht)\b"


def ascii_sql(c):
    """Letters beyond ASCII as underscores, so that word boundaries are where Spark sees them."""
    return f"regexp_replace(coalesce({c}, ''), '[^\\x00-\\x7F]', '_', 'g')"


def found_sql(c, pattern, flags="i"):
    return f"list_distinct(list_transform(regexp_extract_all({ascii_sql(c)}, '{pattern.replace('(?i)', '')}', 0, '{flags}'), lambda x: lower(x)))"


def words_sql(c):
    return f"list_distinct(list_filter({D.terms(c)}, lambda x: x NOT IN ({D.quoted(E.COMMON)})))"


def names_sql(c):
    return f"list_distinct(list_concat({found_sql(c, E.NAME, 'c')}, list_intersect({words_sql(c)}, [{D.quoted(E.KNOWN)}])))"


def stems_sql(c):
    return f"list_distinct(list_transform(list_intersect(list_distinct({D.terms(c)}), [{D.quoted(REL)}]), lambda x: regexp_replace(regexp_replace(x, 's$', ''), 'ed$', '')))"


def unlike_sql(a, b):
    return f"(len({a}) > 0 AND len({b}) > 0 AND len(list_intersect({a}, {b})) = 0)"


def cells_sql(c):
    return f"list_transform({found_sql(c, E.CELL_LINE, 'c')}, lambda x: replace(x, ' ', '-'))"


COLS = {"w": words_sql, "e": names_sql, "r": stems_sql, "c": lambda c: f"list_intersect(list_distinct({D.terms(c)}), [{D.quoted(COND)}])", "s": lambda c: found_sql(c, E.SPECIES), "l": cells_sql, "t": lambda c: found_sql(c, E.TIME)}
CMP = f"""{K.bm25_sql(K.DOCS, K.FIELDS, K.BOOSTS, MOST_EVIDENCE)}, cp AS (SELECT query_id, doc_id, b.text AS h, d.text AS p FROM ranked JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = doc),
cl AS (SELECT query_id, doc_id, {D.jaccard(D.important('p', 80), D.important('h', 120))} AS lex, {', '.join(f'{f(c)} AS {c}{k}' for k, f in COLS.items() for c in 'ph')}, regexp_matches({ascii_sql('p')}, '{NEGS}') <> regexp_matches({ascii_sql('h')}, '{NEGS}') AS neg FROM cp),
u AS (SELECT *, {', '.join(f"{unlike_sql('p' + k, 'h' + k)} AS u{k}" for k in 'cerslt')} FROM cl),
sc AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.20::DOUBLE * lex + 0.25::DOUBLE * {D.jaccard('pw', 'hw')} + 0.35::DOUBLE * greatest({D.jaccard('pe', 'he')}, {D.jaccard('pw', 'he')}) + 0.20::DOUBLE * {D.jaccard('pr', 'hr')} {' '.join(f'+ CASE WHEN {k} THEN {x} ELSE 0.0 END::DOUBLE' for k, x in (('uc', -0.25), ('ue', -0.35), ('ur', -0.15), ('us', -0.2), ('ul', -0.2), ('neg', 0.05), ('ut', -0.15)))})), 4) AS score FROM u)"""
REASONS = {"uc": "disease_mismatch", "ue": "entity_mismatch", "ur": "relation_mismatch", "us": "species_or_population_mismatch", "ul": "cell_line_mismatch", "neg": "negation_mismatch", "ut": "temporality_mismatch"}


@query("join07_comparability", f"WITH {CMP} SELECT query_id, doc_id, score, score >= 0.35 AS comparable, concat_ws(',', {', '.join(f'CASE WHEN {k} THEN {chr(39)}{v}{chr(39)} END' for k, v in REASONS.items())}, CASE WHEN score >= 0.65 THEN 'high_overlap' WHEN score >= 0.35 THEN 'low_but_usable_overlap' ELSE 'insufficient_overlap' END) AS reasons, CASE WHEN uc THEN 'disease' WHEN ue THEN 'entity' WHEN us THEN 'species' WHEN ul THEN 'cell_line' WHEN ut THEN 'temporality' WHEN score >= 0.35 THEN 'none' WHEN len(he) > 0 OR len(pe) > 0 THEN 'entity' ELSE 'relation' END AS blocking FROM sc")
def join07(spark, d):
    b = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("h"))
    docs = V.table(spark, d, "documents").select("doc_id", F.col("text").alias("p"))
    hits = K.ret02(spark, d, MOST_EVIDENCE).select("query_id", F.col("doc").alias("doc_id"))
    c = E.comparability(F.col("p"), F.col("h"), REL, COND, NEGS)
    return docs.join(hits, "doc_id").join(b, "query_id").select("query_id", "doc_id", "p", "h").select("query_id", "doc_id", c["score"].alias("score"), c["comparable"].alias("comparable"), F.array_join(c["reasons"], ",").alias("reasons"), c["blocking"].alias("blocking"))


#: Scores of the pairs that CMP compares, under names of their own.
SCORES = "pr AS (" + PAIRS.split(", pr AS (", 1)[1].replace(", sc AS (", ", s2 AS (").replace("FROM sc)", "FROM s2)")


@query("join06_comparable_support", f"WITH {CMP}, {SCORES}, al AS (SELECT sc.query_id, sc.doc_id AS evidence_id, score >= 0.35 AS ok, sc.query_id % 5 <> 0 AS cited, sc.doc_id % 2 = 0 AS prompt FROM sc), ct AS (SELECT query_id, count(*) AS n_candidates, count(*) FILTER (NOT ok) AS n_incomparable, bool_or(cited) AS cited FROM al GROUP BY query_id), fw AS (SELECT al.*, entailment, contradiction, CASE WHEN contradiction >= 0.5 THEN 'contradicted' WHEN entailment >= 0.5 AND entailment >= neutral THEN 'entailed' ELSE 'unsupported' END AS st, row_number() OVER (PARTITION BY al.query_id ORDER BY al.evidence_id) AS r FROM al JOIN nl USING (query_id, evidence_id) WHERE ok AND cited), ck AS (SELECT query_id, count(*) AS n, max(entailment) AS e, max(contradiction) AS c, bool_or(st = 'entailed' AND prompt) AS ps, first(evidence_id ORDER BY contradiction DESC, evidence_id) FILTER (st = 'contradicted') AS bc, first(evidence_id ORDER BY entailment DESC, evidence_id) FILTER (st = 'entailed') AS be FROM fw WHERE r <= 3 GROUP BY query_id), f AS (SELECT ct.query_id, CASE WHEN NOT cited THEN 'not_checked' WHEN bc IS NOT NULL THEN 'contradicted' WHEN be IS NOT NULL THEN 'entailed' ELSE 'unsupported' END AS status, n_candidates, n_incomparable, coalesce(n, 0) AS n_checked, coalesce(e, 0.0)::DOUBLE AS best_entailment, coalesce(c, 0.0)::DOUBLE AS max_contradiction, coalesce(bc, be) AS best_evidence, coalesce(ps, false) AS prompt_supported FROM ct LEFT JOIN ck USING (query_id)) SELECT *, status = 'contradicted' AS needs_confirmation FROM f")
def join06c(spark, d):
    """Claims behind the comparability gate: at most three scored pairs each. Every fifth claim needs no citation; even documents were in the prompt."""
    b = V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("hypothesis"), (F.col("item_id") % 5 != 0).alias("requires_citation"))
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("premise"), (F.col("doc_id") % 2 == 0).alias("in_prompt"))
    hits = K.ret02(spark, d, MOST_EVIDENCE).select("query_id", F.col("doc").alias("evidence_id"))
    return C.claim_support(docs.join(hits, "evidence_id").join(b, "query_id"), ["query_id"], E.comparability(F.col("premise"), F.col("hypothesis"), REL, COND, NEGS)["comparable"], 3)


@query("agg06_gap_closure", f"WITH {K.HITS}, {K.OPEN}, sn AS (SELECT query_id, list_distinct(flatten(list({D.terms('text')}))) AS seen FROM ht GROUP BY query_id) SELECT query_id, (CASE WHEN len(missing) = 0 THEN 0.0 ELSE round(len(list_filter(missing, lambda x: list_contains(coalesce(seen, []), x)))::DOUBLE / len(missing), 4) END)::DOUBLE AS gap_closure FROM (SELECT item_id AS query_id, coalesce(gp.missing, {D.important('text')}) AS missing FROM benchmark LEFT JOIN gp ON gp.query_id = item_id) LEFT JOIN sn USING (query_id)")
def agg06g(spark, d):
    """From the best hit to all hits."""
    hits, q = K.hit_texts(spark, d), K.asked(spark, d)
    return Rw.gap_closure(X.gap_record(q, hits.filter("rank = 1")), X.gap_record(q, hits))


def external_sql(k):
    """The three searches as CTEs of their own, then one table of results."""
    one = lambda name, inner: f"{name} AS (SELECT * FROM ({inner}))"
    docs = f"WITH {K.bm25_sql(K.DOCS, K.FIELDS, K.BOOSTS, 5)} SELECT query_id, doc, score FROM ranked"
    lines = f"WITH {D.SENTENCES}, {K.bm25_sql(K.LINES, {'body': 'sentence'}, {'body': 1.0}, 5)} SELECT query_id, doc, score FROM ranked"
    facts = f"WITH {K.SCORED}, {K.bm25_sql(K.TRIPLE_DOCS, {'spo': 'spo'}, {'spo': 1.0}, 10)} SELECT query_id, doc, score FROM ranked"
    n = "greatest(1, len(q))"
    return f"""WITH {one('r1', docs)}, {one('r2', lines)}, {one('r3', facts)}, {D.TRIPLES},
rs AS (SELECT query_id, 'pubmed' AS source, CAST(r1.doc AS VARCHAR) AS key, string_split(text, chr(10))[1] AS title, text AS snippet, score AS ps, true AS has_id FROM r1 JOIN documents ON doc_id = r1.doc
 UNION ALL SELECT query_id, 'litsense2:x', CAST(s.doc_id AS VARCHAR), '', sentence, score, s.doc_id % 2 = 0 FROM r2 JOIN sentences s ON s.doc_id || ':' || s.pos = r2.doc
 UNION ALL SELECT query_id, 'pubtator3', triple_id, subject, object, score, false FROM r3 JOIN triples ON triple_id = r3.doc),
q AS (SELECT item_id AS query_id, {D.important('text', 64)} AS q, {D.important('text', 2)} AS a FROM benchmark),
z AS (SELECT rs.*, q, a, {D.important('title', 80)} AS t, {D.important('snippet', 160)} AS sn, list_filter(a, lambda x: NOT regexp_matches(lower(title || ' ' || snippet), '(^|[^a-z0-9])' || regexp_replace(x, '([^a-z0-9 ])', '\\\\\\1', 'g') || '($|[^a-z0-9])')) AS ms FROM rs JOIN q USING (query_id)),
y AS (SELECT *, len(list_filter(q, lambda x: list_contains(t, x) OR list_contains(sn, x))) AS n_shared, len(list_filter(q, lambda x: list_contains(t, x))) AS named FROM z),
sc AS (SELECT query_id, key, source, ps, round(n_shared::DOUBLE / {n} + 0.45::DOUBLE * named / least({n}, 12) + CASE split_part(source, ':', 1) WHEN 'litsense2' THEN 0.16 WHEN 'pubtator3' THEN 0.12 ELSE 0.04 END::DOUBLE + CASE WHEN has_id THEN 0.04 ELSE 0.0 END::DOUBLE + CASE WHEN n_shared = 0 THEN -0.20 ELSE 0.0 END::DOUBLE, 4) AS score, CASE WHEN len(ms) = 0 THEN 2 WHEN len(ms) < len(a) THEN 1 ELSE 0 END AS tier, array_to_string(ms, ',') AS missing FROM y),
o1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY tier DESC, score DESC, ps DESC, key, source) AS f FROM sc)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, score DESC, ps DESC, key, source) AS rank, key, source, score, tier, missing FROM o1 WHERE f = 1) WHERE rank <= {k}"""


@query("ret25_external_results", external_sql(8))
def ret25x(spark, d):
    """Document, sentence and triple searches stand in for external sources; a query's first two terms are its required anchors."""
    text = lambda c: F.col(c).cast("string")
    docs = K.hit_texts(spark, d).select("query_id", F.lit("pubmed").alias("source"), text("doc").alias("key"), K.title().alias("title"), F.col("text").alias("snippet"), F.col("score").alias("provider_score"), F.lit(True).alias("has_id"))
    s = V.sentences(spark, d).select(K.by_two("doc_id", "pos"), "doc_id", "sentence")
    lines = K.ret07(spark, d).join(s, "doc").select("query_id", F.lit("litsense2:x").alias("source"), text("doc_id").alias("key"), F.lit("").alias("title"), F.col("sentence").alias("snippet"), F.col("score").alias("provider_score"), (F.col("doc_id") % 2 == 0).alias("has_id"))
    t = V.triples(spark, d).select(F.col("triple_id").alias("doc"), "subject", "object")
    facts = K.ret06(spark, d).join(t, "doc").select("query_id", F.lit("pubtator3").alias("source"), F.col("doc").alias("key"), F.col("subject").alias("title"), F.col("object").alias("snippet"), F.col("score").alias("provider_score"), F.lit(False).alias("has_id"))
    q = K.asked(spark, d).withColumn("anchors", T.important_terms(F.col("query"), 2))
    return E.external_results(q, docs.unionByName(lines).unionByName(facts), 8).withColumn("missing", F.array_join("missing", ","))


@query("join14_filled_abstracts", "SELECT l.doc_id, coalesce(d.text, 'none') AS abstract FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def join14(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.col("text").alias("found"))
    return V.table(spark, d, "labels").join(docs, "doc_id", "left").select("doc_id", F.coalesce("found", F.lit("none")).alias("abstract"))


@query("join15_support_sentences", f"WITH {D.TRIPLES}, s AS (SELECT doc_id, pos FROM sentences) SELECT s.doc_id, s.pos, count(triple_id) AS n_triples, string_agg(subject || ' ' || relation || ' ' || object, '; ' ORDER BY triple_id) AS triples FROM s LEFT JOIN triples t ON t.doc_id = s.doc_id AND t.pos = s.pos GROUP BY ALL")
def join15(spark, d):
    s = V.sentences(spark, d).select("doc_id", "pos")
    t = V.triples(spark, d).select("doc_id", "pos", F.struct("triple_id", F.concat_ws(" ", "subject", "relation", "object").alias("t")).alias("x"))
    g = s.join(t, ["doc_id", "pos"], "left").groupBy("doc_id", "pos").agg(F.count("x").alias("n_triples"), F.array_sort(F.collect_list("x")).alias("xs"))
    return g.select("doc_id", "pos", "n_triples", F.nullif(F.array_join("xs.t", "; "), F.lit("")).alias("triples"))


@query("win12_entailed_evidence", f"WITH {PAIRS}, e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY entailment DESC, evidence_id) AS r FROM nl WHERE entailment >= 0.05) SELECT query_id, evidence_id, r AS rank FROM e WHERE r <= 3")
def win12(spark, d):
    e = nli_pairs(spark, d).filter("entailment >= 0.05")
    return X.top(e, "query_id", [F.desc("entailment"), "evidence_id"], 3).select("query_id", "evidence_id", "rank")


@query("win14_conversation_frames", f"WITH t AS (SELECT conv_id, turn, {D.important('text', 6)} AS t FROM conversations), p AS (SELECT a.conv_id, a.turn, flatten(list(b.t ORDER BY b.turn DESC)) AS l FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn <= a.turn GROUP BY ALL) SELECT conv_id, turn, array_to_string(list_slice({D.first_seen('l')}, 1, 400), ' ') AS active FROM p")
def win14(spark, d):
    return E.frames(V.table(spark, d, "conversations"), "conv_id", "turn", 400).select("conv_id", "turn", F.array_join("active", " ").alias("active"))


LISTS = f"""ln AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM conversations),
lk AS (SELECT conv_id, turn, list(array_to_string({D.important('c', 14)}, ' ') ORDER BY place) AS k FROM ln WHERE contains(lower(c), 'the') AND trim(c) <> '' GROUP BY ALL),
tl AS (SELECT c.conv_id, c.turn, {D.important('text', 2)} AS t, coalesce(k, []) AS k FROM conversations c LEFT JOIN lk ON lk.conv_id = c.conv_id AND lk.turn = c.turn),
rl AS (SELECT a.conv_id, a.turn, flatten(list(b.t ORDER BY b.turn DESC)) AS t, flatten(list(b.k ORDER BY b.turn DESC)) AS k FROM tl a JOIN tl b ON a.conv_id = b.conv_id AND b.turn <= a.turn GROUP BY ALL)"""


@query("win14_frame_lists", f"WITH {LISTS} SELECT conv_id, turn, array_to_string(list_slice({D.first_seen('t')}, 1, 24), ' ') AS avoided, array_to_string(list_slice({D.first_seen('k')}, 1, 12), '|') AS supported FROM rl")
def win14l(spark, d):
    """First terms stand in for terms to avoid, lines with a common word for supported claims."""
    c = V.table(spark, d, "conversations").withColumn("avoid", T.important_terms(F.col("text"), 2))
    c = c.withColumn("claims", F.filter(F.split("text", "\n"), lambda x: F.contains(F.lower(x), F.lit("the"))))
    rows = E.frame_lists(c.select("conv_id", "turn", "avoid", "claims"), "conv_id", "turn", {"avoided": ("avoid", 24)}, {"supported": ("claims", 12)})
    return rows.select("conv_id", "turn", F.array_join("avoided", " ").alias("avoided"), F.array_join("supported.key", "|").alias("supported"))


@query("ups05_merged_ideas", f"WITH {IDEAS} SELECT idea, count(*) AS frequency, count(DISTINCT session_id) AS sessions, round(sum(reward), 4) AS reward_sum FROM (SELECT session_id, reward, unnest(ideas) AS idea FROM id) GROUP BY idea")
def ups05(spark, d):
    """History and delta by (idea, session), then their union re-aggregated."""
    per = lambda t: t.select("session_id", "reward", F.explode("ideas").alias("idea")).groupBy("idea", "session_id").agg(F.count("*").alias("n"), F.sum("reward").alias("r"))
    t = idea_turns(spark, d)
    both = per(t.filter("turn_index < 3")).unionByName(per(t.filter("turn_index >= 3")))
    return both.groupBy("idea").agg(F.sum("n").alias("frequency"), F.count_distinct("session_id").alias("sessions"), F.round(F.sum("r"), 4).alias("reward_sum"))


LINKED = f"""{D.MEMORY}, i0 AS (SELECT session_id, turn_index, importance AS reward, {D.important('text', 16)} AS t FROM memory_docs), i1 AS (SELECT session_id, turn_index, reward, CASE WHEN len(t) >= 2 THEN list_append(t, t[1] || ' ' || t[2]) ELSE t END AS ideas FROM i0),
i2 AS (SELECT *, unnest(ideas) AS idea FROM i1), i3 AS (SELECT idea, session_id, turn_index, list_slice(list_filter(ideas, lambda x: x <> idea), 1, 16) AS near, list_slice(list_filter(ideas, lambda x: contains(x, ' ') AND split_part(x, ' ', 1) = idea), 1, 16) AS child FROM i2),
ln AS (SELECT idea, turn_index, session_id, unnest(near) AS other, unnest(range(0, len(near))) AS place FROM i3), lc AS (SELECT DISTINCT idea, unnest(child) AS other FROM i3),
nn AS (SELECT idea, least(48, count(DISTINCT other)) AS n_cooccurring, first(other ORDER BY turn_index, session_id, place) AS first_cooccurring FROM ln GROUP BY idea), nc AS (SELECT idea, least(48, count(*)) AS n_children FROM lc GROUP BY idea),
gi AS (SELECT idea, count(*) AS frequency, count(DISTINCT session_id) AS sessions, round(sum(reward), 6) AS reward_sum, round(avg(reward), 6) AS reward_avg FROM i2 GROUP BY idea)"""


@query("ups05_stored_ideas", f"WITH {LINKED} SELECT gi.idea, frequency, sessions, reward_sum, coalesce(n_cooccurring, 0)::INT AS n_cooccurring, first_cooccurring, coalesce(n_children, 0)::INT AS n_children, round(least(1.0::DOUBLE, 0.40::DOUBLE * ln(1 + frequency) / ln(33.0::DOUBLE) + 0.30::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, reward_avg)) + 0.20::DOUBLE + 0.10::DOUBLE * ln(1 + coalesce(n_cooccurring, 0) + coalesce(n_children, 0)) / ln(17.0::DOUBLE)), 4) AS importance FROM gi LEFT JOIN nn ON nn.idea = gi.idea LEFT JOIN nc ON nc.idea = gi.idea")
def ups05s(spark, d):
    """Three deltas, one of them written twice, with a snapshot in between. The first two terms of a turn stand in for a phrase."""
    t = T.important_terms(F.col("text"), 16)
    ideas = F.when(F.size(t) >= 2, F.concat(t, F.array(F.array_join(F.slice(t, 1, 2), " ")))).otherwise(t)
    turns = V.memory_docs(spark, d).select("session_id", "turn_index", F.col("importance").alias("reward"), ideas.alias("ideas"))
    kept = St.Ideas(spark, shared(spark))
    kept.add(turns.filter("turn_index < 2"), 0)
    kept.add(turns.filter("turn_index BETWEEN 2 AND 3"), 1)
    kept.compact(1)
    for _ in range(2):
        kept.add(turns.filter("turn_index > 3"), 2)
    rows = kept.read()
    return rows.select("idea", "frequency", "sessions", "reward_sum", F.size("cooccurring").alias("n_cooccurring"), F.get("cooccurring", F.lit(0)).alias("first_cooccurring"), F.size("children").alias("n_children"), "importance")


GRAMS = "(CASE WHEN length(term) < 4 THEN [term] ELSE list_distinct(list_transform(range(1, length(term) - 2), lambda i: substr(term, i, 4))) END)"


def similar_sql(a: str, b: str, least: float) -> str:
    """CTE sm (term, other, similarity) of two tables of terms."""
    both, all_ = "len(list_intersect(x.g, y.g))", "len(list_distinct(list_concat(x.g, y.g)))"
    return f"ga AS (SELECT DISTINCT term, {GRAMS} AS g FROM {a}), gb AS (SELECT DISTINCT term, {GRAMS} AS g FROM {b}), sm AS (SELECT x.term, y.term AS other, round({both}::DOUBLE / {all_}, 4) AS similarity FROM ga x JOIN gb y ON x.term <> y.term WHERE {both} > {least}::DOUBLE * {all_})"


@query("agg23_near_duplicate_terms", f"WITH v AS (SELECT DISTINCT unnest({D.terms('text')}) AS term FROM benchmark), {similar_sql('v', 'v', 0.5)} SELECT * FROM sm WHERE term < other")
def agg23(spark, d):
    terms = V.table(spark, d, "benchmark").select(F.explode(T.terms(F.col("text"))).alias("term"))
    return E.near_duplicate_terms(terms, 0.5)


@query("agg23_promotion_gates", f"WITH c AS (SELECT term, count(DISTINCT item_id % 5) AS runs FROM (SELECT item_id, unnest({D.terms('text')}) AS term FROM benchmark) GROUP BY term), k AS (SELECT DISTINCT unnest({D.terms('text')}) AS term FROM conversations WHERE turn = 0), {similar_sql('c', 'k', 0.6)}, cl AS (SELECT term, first(other ORDER BY similarity DESC, other) AS closest FROM (SELECT * FROM sm UNION ALL SELECT term, term, 1.0 FROM c JOIN k USING (term)) GROUP BY term), d AS (SELECT c.term, CASE WHEN c.term IN ({D.quoted(T.STOP)}) THEN 'stopword' WHEN closest IS NOT NULL THEN 'near_duplicate' WHEN runs < 2 THEN 'single_run' ELSE 'promoted' END AS decision, closest FROM c LEFT JOIN cl ON cl.term = c.term) SELECT term, decision, CASE WHEN decision = 'near_duplicate' THEN closest END AS closest FROM d")
def agg23g(spark, d):
    """Items stand in for runs, five of them; terms of first turns are known."""
    words = lambda t: t.select("*", F.explode(T.terms(F.col("text"))).alias("term"))
    c = words(V.table(spark, d, "benchmark")).groupBy("term").agg(F.count_distinct(F.col("item_id") % 5).alias("runs"))
    known = words(V.table(spark, d, "conversations").filter("turn = 0")).select("term")
    return E.promotion_gates(c, known, spark.createDataFrame([(w,) for w in T.STOP], "term string"), 0.6, 2)
