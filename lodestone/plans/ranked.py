"""Queries of ranked retrieval (RET): benchmark items as queries over documents, embeddings and messages."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import triples as R
from lodestone.operators import index as N
from lodestone.operators import neighbours as NB
from lodestone.operators import retrieval as X
from lodestone.operators import windows as W
from lodestone.plans import duck as D
from lodestone.plans.columns import conf, low_value_sql
from lodestone.plans.sessions import STATES
from lodestone.sources import views as V

Q, S = {}, {}
BOOSTS = {"title": 3.0, "body": 1.0}


def query(name, sql=None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


def asked(spark, d):
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def title(c="text"):
    return F.substring_index(c, "\n", 1)


def by_two(*cs):
    return F.concat_ws(":", *[F.col(c).cast("string") for c in cs]).alias("doc")


def spo_rows(spark, d):
    return scored_triples(spark, d).filter("confidence >= 0.6 AND s_ebio >= 0.5").select(F.col("triple_id").alias("doc"), F.concat_ws(" ", "subject", "relation", "object").alias("spo"))


def kept_memory(spark, d):
    """Memory rows that aren't evicted."""
    return W.with_states(V.memory_docs(spark, d), 3).filter("memory_state <> 'evicted'").select(by_two("session_id", "turn_index"), "text")


def whole(name):
    return F.col(name)


#: For each index: its documents, with the column doc, and for each field what makes it of a column.
INDEXED = {
    "documents": (lambda spark, d: V.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), {"title": ("text", title), "body": ("text", whole)}),
    "triples": (spo_rows, {"spo": ("spo", whole)}),
    "triple_fields": (lambda spark, d: V.triples(spark, d).select(F.col("triple_id").alias("doc"), *X.TRIPLE_BOOSTS), {c: (c, whole) for c in X.TRIPLE_BOOSTS}),
    "sentences": (lambda spark, d: V.sentences(spark, d).select(by_two("doc_id", "pos"), "sentence"), {"body": ("sentence", whole)}),
    "memory": (kept_memory, {"text": ("text", whole)}),
    "answers": (lambda spark, d: V.table(spark, d, "conversations").filter("role = 'assistant'").select(by_two("conv_id", "turn"), "text"), {"text": ("text", whole)}),
}
#: Indexes of short texts, and their documents in a block and in a bucket: small blocks of these would have a maximum for nearly each posting.
SHORT, SHORT_BLOCKS, SHORT_BUCKETS = ("triples", "triple_fields", "sentences"), 4096, 16_000
_WRITTEN: dict[tuple[str, str, str], N.Index] = {}


def stored(spark, d, kind: str) -> N.Index:
    """The index of this kind over a data folder: written by the first query of an application that needs it, read by the others."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _WRITTEN or not N.there(spark, _WRITTEN[key]):
        rows, fields = INDEXED[kind]
        _WRITTEN[key] = N.write_index(rows(spark, d), "doc", {f: make(c) for f, (c, make) in fields.items()}, block_docs=SHORT_BLOCKS if kind in SHORT else N.BLOCK_DOCS, bucket_docs=SHORT_BUCKETS if kind in SHORT else N.BUCKET_DOCS)
    return _WRITTEN[key]


def bm25_sql(docs: str, fields: dict, boosts: dict, k: int, queries="SELECT item_id AS query_id, text AS query FROM benchmark", asked: str = "") -> str:
    """CTEs ending in `ranked (query_id, rank, doc, score)`; docs: SELECT of doc and the fields' sources."""
    parts = " UNION ALL ".join(f"SELECT doc, '{f}' AS field, {D.terms(c)} AS t FROM dd" for f, c in fields.items())
    boost = " ".join(f"WHEN field = '{f}' THEN {b}::DOUBLE" for f, b in boosts.items())
    return f"""dd AS ({docs}), qq AS ({queries}), ft AS ({parts}),
pp AS (SELECT field, term, doc, len, count(*) AS tf FROM (SELECT doc, field, len(t) AS len, unnest(t) AS term FROM ft) GROUP BY ALL),
st AS (SELECT field, (SELECT count(*) FROM dd) AS n, sum(tf)::DOUBLE / (SELECT count(*) FROM dd) AS mean FROM pp GROUP BY field),
dq AS (SELECT field, term, count(*) AS df FROM pp GROUP BY field, term),
aq AS ({asked or f"SELECT DISTINCT query_id, unnest({D.terms('query')}) AS term FROM qq"}),
hits AS (SELECT query_id, doc, field, sum((CASE {boost} END) * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS s FROM aq JOIN pp USING (term) JOIN dq USING (field, term) JOIN st USING (field) WHERE (CASE {boost} END) IS NOT NULL GROUP BY query_id, doc, field),
best AS (SELECT query_id, doc, round(max(s), 6) AS score FROM hits GROUP BY query_id, doc),
ranked AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank, doc, score FROM best) WHERE rank <= {k})"""


DOCS = "SELECT doc_id AS doc, text, string_split(text, chr(10))[1] AS title FROM documents"
FIELDS = {"title": "title", "body": "text"}


@query("ret01_postings", f"WITH {D.SENTENCES} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({D.terms('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def ret01(spark, d):
    postings = spark.table(stored(spark, d, "documents").postings).filter("field = 'body'")
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("ret02_bm25_fields", f"WITH {bm25_sql(DOCS, FIELDS, BOOSTS, 5)} SELECT * FROM ranked")
def ret02(spark, d, k=5):
    return N.bm25(asked(spark, d), stored(spark, d, "documents"), BOOSTS, k)


LEVELS = {"title": {"title": 4.0}, "paper": {"body": 2.0, "title": 1.0}, "sentence": {"body": 1.0}}


@query("ret03_level_search", " UNION ALL ".join(f"SELECT * FROM (WITH {bm25_sql(DOCS, FIELDS, b, 3)} SELECT '{level}' AS level, ranked.* FROM ranked)" for level, b in LEVELS.items()))
def ret03(spark, d):
    out = None
    for level, boosts in LEVELS.items():
        hits = N.bm25(asked(spark, d), stored(spark, d, "documents"), boosts, 3).select(F.lit(level).alias("level"), "query_id", "rank", "doc", "score")
        out = hits if out is None else out.unionByName(hits)
    return out


def scored_triples(spark, d):
    c = F.col
    t = V.triples(spark, d).withColumns({"confidence": conf(), "signature": R.signature(c("subject"), c("relation"), c("object")), "subject_ok": R.informative(c("subject")), "object_ok": R.informative(c("object"))})
    return t.withColumn("quality", F.round(R.quality(c("s_ebio"), c("o_ebio"), c("confidence"), (c("pos") % 30).cast("double")), 6))


SCORED = f"""{D.TRIPLES}, scored AS (SELECT *, {D.CONFIDENCE} AS confidence, {D.normalized('subject')} || '|' || {D.normalized('relation')} || '|' || {D.normalized('object')} AS signature, {D.informative('subject')} AS subject_ok, {D.informative('object')} AS object_ok,
 round((s_ebio + o_ebio) / 2 * 0.3::DOUBLE + {D.CONFIDENCE} * 0.3::DOUBLE + least((pos % 30) / 20.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE, 6) AS quality FROM triples)"""


def edits_sql(asked: str, words: str) -> str:
    """CTEs a (query_id, term), v (match) and n (term, match, distance)."""
    return f"a AS ({asked}), v AS ({words}), w AS (SELECT DISTINCT term, CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS most FROM a), n AS (SELECT term, match, levenshtein(term, match) AS distance FROM w JOIN v ON abs(length(term) - length(match)) <= most WHERE levenshtein(term, match) <= most)"


ASKED = f"SELECT DISTINCT item_id AS query_id, unnest({D.terms('text')}) AS term FROM benchmark"
WORDS = f"SELECT DISTINCT unnest({D.terms('text')}) AS match FROM conversations"


@query("ret04_fuzzy_terms", f"WITH {edits_sql(ASKED, WORDS)} SELECT query_id, term, match, distance FROM a JOIN n USING (term)")
def ret04(spark, d):
    words = V.table(spark, d, "conversations").select(F.explode(T.terms(F.col("text"))).alias("match"))
    return X.expanded_terms(words, asked(spark, d))


def fuzzy_sql(k):
    """Triples of articles named PMC.. stand in for the papers that a user picks."""
    fields = {c: c for c in X.TRIPLE_BOOSTS}
    found = bm25_sql("SELECT triple_id AS doc, subject, object, relation, sentence_text FROM triples", fields, X.TRIPLE_BOOSTS, 0, asked="SELECT DISTINCT query_id, match AS term FROM a JOIN n USING (term)")
    words = "SELECT DISTINCT unnest(t) AS match FROM (" + " UNION ALL ".join(f"SELECT {D.terms(c)} AS t FROM triples" for c in fields) + ")"
    return f"""WITH {SCORED}, {edits_sql(ASKED, words)}, {found},
 ad AS (SELECT query_id, doc, round(best.score + CASE WHEN s_ebio >= 0.3 THEN 2 ELSE 0 END::DOUBLE + CASE WHEN o_ebio >= 0.3 THEN 2 ELSE 0 END::DOUBLE, 6) AS score FROM best JOIN triples ON triple_id = doc WHERE article_id LIKE 'PMC%'),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS r FROM ad),
 kp AS (SELECT query_id, r, triple_id, signature, quality, score, row_number() OVER (PARTITION BY query_id, signature ORDER BY r) AS f FROM rk JOIN scored ON triple_id = doc WHERE r <= {3 * k} AND subject_ok AND object_ok AND confidence >= 0.5 AND (s_ebio >= 0.3 OR o_ebio >= 0.3))
 SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, score DESC, triple_id) AS rank, triple_id, signature, quality, score FROM kp WHERE f = 1) WHERE rank <= {k}"""


@query("ret04_fuzzy_search", fuzzy_sql(10))
def ret04s(spark, d):
    papers = V.triples(spark, d).filter("article_id LIKE 'PMC%'").select("article_id")
    return X.fuzzy_search(asked(spark, d), stored(spark, d, "triple_fields"), scored_triples(spark, d), papers, k=10)


@query("ret05_quality_filter", f"WITH {SCORED} SELECT signature, triple_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY triple_id) AS r FROM scored WHERE subject_ok AND object_ok AND confidence >= 0.5 AND (s_ebio >= 0.3 OR o_ebio >= 0.3)) WHERE r = 1 ORDER BY quality DESC, triple_id LIMIT 50")
def ret05(spark, d):
    return X.filtered_triples(scored_triples(spark, d), 0.5, 0.3, 50)


TRIPLE_DOCS = "SELECT triple_id AS doc, subject || ' ' || relation || ' ' || object AS spo FROM scored WHERE confidence >= 0.6 AND s_ebio >= 0.5"


@query("ret06_triple_search", f"WITH {SCORED}, {bm25_sql(TRIPLE_DOCS, {'spo': 'spo'}, {'spo': 1.0}, 10)} SELECT * FROM ranked")
def ret06(spark, d):
    return N.bm25(asked(spark, d), stored(spark, d, "triples"), {"spo": 1.0}, 10)


LINES = "SELECT doc_id || ':' || pos AS doc, sentence FROM sentences"


@query("ret07_keyword_sentences", f"WITH {D.SENTENCES}, {bm25_sql(LINES, {'body': 'sentence'}, {'body': 1.0}, 5)} SELECT * FROM ranked")
def ret07(spark, d):
    return N.bm25(asked(spark, d), stored(spark, d, "sentences"), {"body": 1.0}, 5)


COS = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / greatest(sqrt(list_sum(list_transform(q.embedding, lambda v: v::DOUBLE * v::DOUBLE))) * sqrt(list_sum(list_transform(e.embedding, lambda v: v::DOUBLE * v::DOUBLE))), 1e-12)"
NEAR = f"near AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank, doc, score FROM (SELECT q.vec_id AS query_id, e.vec_id AS doc, round({COS}, 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)) WHERE rank <= 10)"


def near(spark, d, k=10):
    e = V.table(spark, d, "embeddings")
    return X.nearest(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector")), k).select("query_id", "rank", "doc", "score")


@query("ret08_nearest_vectors", f"WITH {NEAR} SELECT * FROM near")
def ret08(spark, d):
    return near(spark, d)


TEXT_HITS = bm25_sql(DOCS, {"title": "title"}, {"title": 1.0}, 4, "SELECT item_id AS query_id, text AS query FROM benchmark")


def text_hits(spark, d, k=4):
    return N.bm25(asked(spark, d), stored(spark, d, "documents"), {"title": 1.0}, k)


@query("ret08_approximate_neighbours")
def ret08a(spark, d, k=10):
    """No SQL: which lists a query looks through depends on fitted centroids. tests/test_retrieval.py holds its recall against ret08."""
    e = V.table(spark, d, "embeddings")
    lists = NB.write_lists(e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector")))
    return NB.approximate(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), lists, k, 1200)


@query("ret09_vector_fallback", f"WITH {TEXT_HITS}, {NEAR}, w AS (SELECT q.query_id, coalesce(n, 0) AS n FROM qq q LEFT JOIN (SELECT query_id, count(*) AS n, max(score) AS best FROM ranked GROUP BY query_id) USING (query_id) WHERE coalesce(n, 0) < 3 OR best < 12), m AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) + n AS rank, doc, score, 'vector' AS mode FROM near JOIN w USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.query_id = near.query_id AND r.doc = near.doc)) SELECT query_id, rank, doc, score, 'text' AS mode FROM ranked UNION ALL SELECT * FROM m WHERE rank <= 8")
def ret09(spark, d):
    return X.with_fallback(text_hits(spark, d), near(spark, d), asked(spark, d), 8, 3, 12.0)


@query("ret10_rank_fusion", f"WITH {TEXT_HITS}, {NEAR}, u AS (SELECT query_id, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, rank, doc FROM ranked UNION ALL SELECT query_id, rank, doc FROM near) GROUP BY query_id, doc) SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank, doc, score FROM u) WHERE rank <= 10")
def ret10(spark, d):
    return X.fused([text_hits(spark, d), near(spark, d)], 10)


@query("ret11_filter_before_rank", f"WITH {SCORED} SELECT * FROM (SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY quality DESC, triple_id) AS rank, triple_id, confidence FROM scored WHERE confidence >= 0.6) WHERE rank <= 3")
def ret11(spark, d):
    return X.top(scored_triples(spark, d).filter("confidence >= 0.6"), "article_id", [F.desc("quality"), "triple_id"], 3).select("article_id", "rank", "triple_id", "confidence")


MESSAGES = "SELECT conv_id || ':' || turn AS doc, text FROM conversations WHERE role IN ('user', 'assistant')"


KEPT = f"SELECT session_id || ':' || turn_index AS doc, text FROM (WITH {STATES} SELECT * FROM ms WHERE memory_state <> 'evicted')"


@query("ret12_memory_search", f"WITH {bm25_sql(KEPT, {'text': 'text'}, {'text': 2.0}, 5)} SELECT * FROM ranked")
def ret12(spark, d):
    return N.bm25(asked(spark, d), stored(spark, d, "memory"), {"text": 2.0}, 5)


def variant_sql(n):
    syn = "SELECT t AS term, tt AS synonym FROM (VALUES ('the', 'def'), ('der', 'art'), ('und', 'and'), ('que', 'what')) v(t, tt)"
    return f"""q AS (SELECT item_id AS query_id, text, {D.important('text', 10)} AS t FROM benchmark), sy AS ({syn}),
sx AS (SELECT query_id, list(synonym ORDER BY p, synonym) AS s FROM (SELECT DISTINCT query_id, p, synonym FROM (SELECT query_id, unnest(t) AS term, unnest(range(0, len(t))) AS p FROM q) JOIN sy USING (term)) GROUP BY query_id),
r AS (SELECT query_id, 0 AS p, 'original' AS label, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS v FROM q UNION ALL SELECT query_id, 1, 'important_terms', array_to_string(t, ' ') FROM q
 UNION ALL SELECT query_id, 2, 'synonyms', array_to_string({D.first_seen('list_concat(t, s)')}, ' ') FROM q JOIN sx USING (query_id)
 UNION ALL SELECT query_id, 3, 'relation_probe', array_to_string({D.first_seen("list_concat(t, ['evidence', 'relationship'])")}, ' ') FROM q),
f AS (SELECT * FROM (SELECT query_id, p, label, substr(v, 1, 260) AS variant, row_number() OVER (PARTITION BY query_id, lower(substr(v, 1, 260)) ORDER BY p) AS k FROM r WHERE v <> '') WHERE k = 1)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS place, label, variant FROM f) WHERE place <= {n}"""


@query("ret14_query_variants", f"WITH {variant_sql(4)}")
def ret14(spark, d):
    syn = spark.createDataFrame([("the", "def"), ("der", "art"), ("und", "and"), ("que", "what")], "term string, synonym string")
    return X.variants(asked(spark, d), syn, 4)


def anchors(spark, d):
    return asked(spark, d).select("query_id", F.explode(T.important_terms(F.col("query"), 4)).alias("anchor"))


#: Pairs of common words stand in for a domain's aliases.
ANCHOR_ALIASES = [("the", "of a"), ("and", "und"), ("thon", "the t")]
COVERED = f"""{bm25_sql(DOCS, FIELDS, BOOSTS, 5)}, an AS (SELECT item_id AS query_id, unnest({D.important('text', 4)}) AS anchor FROM benchmark),
al AS (SELECT anchor, anchor AS alias FROM an UNION SELECT * FROM (VALUES {', '.join(str(x) for x in ANCHOR_ALIASES)}) v(anchor, alias)),
hm AS (SELECT query_id, doc, anchor, bool_or(regexp_matches(lower(text), '(^|[^a-z0-9])' || replace(regexp_replace(alias, '([^a-z0-9 ])', '\\\\\\1', 'g'), ' ', '[-\\s]+') || '($|[^a-z0-9])')) AS ok FROM ranked JOIN an USING (query_id) JOIN al USING (anchor) JOIN documents ON doc_id = doc GROUP BY ALL),
cv AS (SELECT query_id, doc, count(*) AS n_anchors, count(*) FILTER (ok) AS n_matched, coalesce(string_agg(anchor, ',' ORDER BY anchor) FILTER (NOT ok), '') AS missing, count(*) FILTER (ok) >= greatest(1, count(*) - 1) AS passes FROM hm GROUP BY query_id, doc)"""


@query("ret16_anchor_coverage", f"WITH {COVERED} SELECT * FROM cv")
def ret16(spark, d):
    aliases = spark.createDataFrame(ANCHOR_ALIASES, "anchor string, alias string")
    return X.anchor_coverage(hit_texts(spark, d), anchors(spark, d), aliases).withColumn("missing", F.array_join("missing", ","))


def hit_texts(spark, d):
    return ret02(spark, d).join(V.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")


@query("ret18_level_budgets", "SELECT item_id AS query_id, level, budget::BIGINT AS budget FROM benchmark, (VALUES ('title', 5), ('paper', 5), ('sentence', 12)) v(level, budget)")
def ret18(spark, d):
    return X.level_budgets(asked(spark, d), 22)


HITS = f"{bm25_sql(DOCS, FIELDS, BOOSTS, 5)}, ht AS (SELECT ranked.*, text FROM ranked JOIN documents ON doc_id = doc)"


@query("ret20_feedback_terms", f"WITH {HITS}, ft2 AS (SELECT DISTINCT query_id, doc, unnest({D.important('text', 1000000)}) AS term FROM ht), c AS (SELECT query_id, term, count(DISTINCT doc) AS support FROM ft2 GROUP BY query_id, term HAVING count(DISTINCT doc) >= 2) SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY support DESC, term) AS rank, term, support FROM c WHERE NOT EXISTS (SELECT 1 FROM aq WHERE aq.query_id = c.query_id AND aq.term = c.term)) WHERE rank <= 8")
def ret20(spark, d):
    return X.feedback_terms(hit_texts(spark, d), asked(spark, d), 8)


#: Common words and a pair of words stand in for noise, generic terms and phrases.
NOISY, BROADLY, PHRASES = ("einen", "thing"), ("thon", "ment"), ("of the", "in the", "et les")


def candidate_sql():
    low = low_value_sql("text")
    held = f"unnest(list_filter([{D.quoted(PHRASES)}], lambda w: contains(lower(text), w)))"
    return f"""{HITS}, ow AS (SELECT item_id AS query_id, list_filter({D.important('text', 96)}, lambda x: x NOT IN ({D.quoted(BROADLY)})) AS anchors FROM benchmark),
fr0 AS (SELECT query_id, rank, text, anchors, {D.important('text', 96)} AS item FROM ht JOIN ow USING (query_id) WHERE trim(coalesce(text, '')) <> ''),
fr AS (SELECT *, CASE WHEN NOT {low} AND (len(anchors) = 0 OR len(list_intersect(anchors, item)) > 0) THEN 'accepted' ELSE 'rejected' END AS kind FROM fr0),
tm AS (SELECT query_id, kind, term, 1 AS tier, row_number() OVER (PARTITION BY query_id, kind ORDER BY rank, pos, term) AS place FROM (SELECT query_id, kind, term, min(rank) AS rank, arg_min(pos, rank * 1000 + pos) AS pos FROM (SELECT query_id, kind, rank, unnest(item[1:16]) AS term, unnest(range(0, least(16, len(item)))) AS pos FROM fr) GROUP BY ALL)),
ca AS (SELECT query_id, kind, term, tier, place, [term] AS pieces FROM tm WHERE place <= 16 UNION ALL SELECT query_id, kind, term, 0, list_position([{D.quoted(PHRASES)}], term), {D.important('term', 12)} FROM (SELECT DISTINCT query_id, kind, {held} AS term FROM fr)),
cs AS (SELECT ca.query_id, ca.kind, ca.term, tier, place, count(DISTINCT CASE WHEN len(list_intersect(pieces, item)) > 0 THEN rank END) AS support FROM ca JOIN fr USING (query_id, kind) WHERE length(ca.term) >= 3 AND NOT regexp_matches(ca.term, '(ou|ly)$') AND ca.term NOT IN ({D.quoted(NOISY)}) GROUP BY ALL),
sd AS (SELECT *, round(CASE WHEN contains(term, ' ') THEN 0.8 ELSE 0.0 END::DOUBLE + least(1.5::DOUBLE, greatest(0, support - 1) * 0.5::DOUBLE) - CASE WHEN term IN ({D.quoted(BROADLY)}) THEN 1.2 ELSE 0.0 END::DOUBLE, 4) AS score FROM cs),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, tier, place) AS p FROM sd) WHERE p <= 8)"""


@query("ret20_feedback_report", f"WITH {candidate_sql()} SELECT query_id, kind, row_number() OVER (PARTITION BY query_id, kind ORDER BY p) AS rank, term, support, score FROM bs WHERE kind = 'accepted' OR NOT EXISTS (SELECT 1 FROM bs t WHERE t.query_id = bs.query_id AND t.term = bs.term AND t.kind = 'accepted')")
def ret20r(spark, d):
    hits = hit_texts(spark, d).withColumn("structured", F.lit(False))
    return X.feedback_report(hits, asked(spark, d), 8, 12, NOISY, BROADLY, (), PHRASES)


#: Common words stand in for phrases to avoid and for weak anchors.
AVOID, WEAK = ["idiot", "was", " der "], ["the", "and", "und"]


@query("ret21_off_topic", f"WITH {HITS}, fr AS (SELECT item_id AS query_id, list_filter({D.important('text', 4)}, lambda x: length(x) >= 3) AS al, list_filter({D.important('text', 4)}, lambda x: length(x) >= 3 AND x NOT IN ({D.quoted(WEAK)})) AS fo FROM benchmark) SELECT query_id, doc, {D.contains_any('lower(text)', AVOID)} AND len(list_intersect(CASE WHEN len(fo) > 0 THEN fo ELSE al END, list_filter({D.terms('lower(text)')}, lambda y: y NOT IN ({D.quoted(T.STOP)})))) = 0 AS off_topic FROM ht JOIN fr USING (query_id)")
def ret21(spark, d):
    frames = asked(spark, d).select("query_id", T.lits(AVOID).alias("avoid"), T.important_terms(F.col("query"), 4).alias("anchors"))
    return X.off_topic(hit_texts(spark, d), frames, WEAK).select("query_id", "doc", "off_topic")


@query("ret24_gap_record", f"WITH {HITS}, o AS (SELECT item_id AS query_id, {D.important('text')} AS t FROM benchmark), s AS (SELECT query_id, list_distinct(flatten(list({D.terms('text')}))) AS seen FROM ht GROUP BY query_id) SELECT query_id, array_to_string(c, ' ') AS confirmed, array_to_string(m, ' ') AS missing, round(len(c)::DOUBLE / greatest(1, len(t)), 4) AS coverage FROM (SELECT query_id, t, list_sort(list_filter(t, lambda x: list_contains(coalesce(seen, []), x))) AS c, list_sort(list_filter(t, lambda x: NOT list_contains(coalesce(seen, []), x))) AS m FROM o LEFT JOIN s USING (query_id))")
def ret24(spark, d):
    g = X.gap_record(asked(spark, d), hit_texts(spark, d))
    return g.select("query_id", F.array_join("confirmed", " ").alias("confirmed"), F.array_join("missing", " ").alias("missing"), "coverage")


#: What a query's best hit leaves open.
OPEN = f"gp AS (SELECT item_id AS query_id, list_filter({D.important('b.text')}, lambda x: NOT list_contains(coalesce({D.terms('ht.text')}, []), x)) AS missing FROM benchmark b JOIN ht ON ht.query_id = item_id AND rank = 1)"


@query("ret22_snippet_utility", f"WITH {HITS}, an AS (SELECT item_id AS query_id, unnest({D.important('text', 4)}) AS anchor FROM benchmark), {OPEN}, a AS (SELECT query_id, doc, any_value(score) AS score, count(*) FILTER (contains(lower(text), anchor))::DOUBLE / count(*) AS cover, any_value(text) AS text FROM ht JOIN an USING (query_id) GROUP BY query_id, doc), u AS (SELECT query_id, doc, round(0.35::DOUBLE * least(score / 10.0::DOUBLE, 1.0::DOUBLE) + 0.35::DOUBLE * cover + 0.30::DOUBLE * CASE WHEN len(missing) = 0 THEN 0.0 ELSE len(list_filter(missing, lambda x: contains(lower(text), x)))::DOUBLE / len(missing) END, 6) AS utility FROM a JOIN gp USING (query_id)) SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, doc) AS rank, doc, utility FROM u) WHERE rank <= 3")
def ret22(spark, d):
    hits = hit_texts(spark, d)
    gap = X.gap_record(asked(spark, d), hits.filter("rank = 1")).select("query_id", "missing")
    return X.by_utility(hits.drop("rank"), anchors(spark, d), gap, 3).select("query_id", "rank", "doc", "utility")


@query("ret26_attempt_quality", f"WITH {COVERED}, c AS (SELECT query_id, count(*) AS n, count(*) FILTER (n_matched >= n_anchors) AS f, count(*) FILTER (n_matched > 0 AND n_matched < n_anchors) AS p, count(DISTINCT source) AS s FROM cv JOIN documents ON doc_id = doc GROUP BY query_id) SELECT item_id AS query_id, coalesce(n, 0) AS n, coalesce(f, 0) AS full, coalesce(p, 0) AS partial, coalesce(s, 0) AS sources, round(least(1.0::DOUBLE, 0.25::DOUBLE * coalesce(f, 0) + 0.1::DOUBLE * coalesce(p, 0) + 0.05::DOUBLE * coalesce(s, 0)), 4) AS score FROM benchmark LEFT JOIN c ON query_id = item_id".replace("AS full,", 'AS "full",'))
def ret26(spark, d):
    hits = ret16(spark, d).join(V.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source"), "doc")
    return X.attempt_quality(hits.select("query_id", "source", F.col("n_matched").alias("matched"), F.col("n_anchors").alias("anchors")), asked(spark, d))


ANSWERS = "SELECT conv_id || ':' || turn AS doc, text FROM conversations WHERE role = 'assistant'"


@query("ret28_history_search", f"WITH {bm25_sql(ANSWERS, {'text': 'text'}, {'text': 1.0}, 3)} SELECT * FROM ranked")
def ret28(spark, d):
    return N.bm25(asked(spark, d), stored(spark, d, "answers"), {"text": 1.0}, 3)


@query("ret29_selection_terms", f"WITH {D.SENTENCES} SELECT doc_id, array_to_string(list_slice({D.first_seen('flatten(l)')}, 1, 20), ' ') AS query FROM (SELECT doc_id, list({D.important('sentence', 20)} ORDER BY pos) AS l FROM sentences GROUP BY doc_id)")
def ret29(spark, d):
    s = V.sentences(spark, d).select("doc_id", F.struct("pos", T.important_terms(F.col("sentence"), 20).alias("t")).alias("x"))
    g = s.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("l"))
    return g.select("doc_id", F.array_join(F.slice(F.array_distinct(F.flatten("l.t")), 1, 20), " ").alias("query"))


@query("ret30_external_gate", f"WITH {HITS} SELECT item_id AS query_id, coalesce(n, 0) < 5 OR coalesce(best, 0) < 15 AS external FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS n, max(score) AS best FROM ht GROUP BY query_id) ON query_id = item_id")
def ret30(spark, d):
    have = ret02(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    return asked(spark, d).join(have, "query_id", "left").select("query_id", ((F.coalesce("n", F.lit(0)) < 5) | (F.coalesce("best", F.lit(0.0)) < 15)).alias("external"))
