"""Queries of the column operators (PRJ) over sentences, triples, documents and messages."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import triples as R
from lodestone.plans import duck as D
from lodestone.sources import views as V

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


@query("prj01_terms", f"SELECT conv_id, turn, array_to_string({D.terms('text')}, ' ') AS terms FROM conversations")
def prj01(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.terms(F.col("text")), " ").alias("terms"))


@query("prj02_important_terms", f"SELECT conv_id, turn, array_to_string({D.important('text')}, ' ') AS terms FROM conversations")
def prj02(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.important_terms(F.col("text")), " ").alias("terms"))


@query("prj03_article_ids", f"WITH {D.TRIPLES} SELECT triple_id, CASE WHEN NOT regexp_matches(article_id, '(?i)PMC\\d+') AND regexp_matches(article_id, '^\\d+$') THEN article_id END AS pmid, CASE WHEN regexp_matches(article_id, '(?i)PMC\\d+') THEN 'PMC' || regexp_extract(article_id, '(?i)PMC(\\d+)', 1) END AS pmcid FROM triples")
def prj03(spark, d):
    pmid, pmcid = R.article_ids(F.col("article_id"))
    return V.triples(spark, d).select("triple_id", pmid.alias("pmid"), pmcid.alias("pmcid"))


@query("prj04_stable_ids", f"WITH {D.TRIPLES} SELECT triple_id, substr(md5(article_id || ':' || sentence_text), 1, 12) AS sent_id, 'ev_' || substr(sha256(article_id || chr(10) || subject || chr(10) || object), 1, 24) AS evidence_id, substr(sha256(subject || chr(10) || relation), 1, 32) AS pair_id FROM triples")
def prj04(spark, d):
    c = F.col
    return V.triples(spark, d).select("triple_id", T.sentence_id(c("article_id"), c("sentence_text")).alias("sent_id"), T.stable_id(c("article_id"), c("subject"), c("object"), prefix="ev_").alias("evidence_id"), T.stable_id(c("subject"), c("relation"), length=32).alias("pair_id"))


SIDES = ((F.col, ("s_ebio", "s_ngen", "s_otro")), (F.col, ("o_ebio", "o_ngen", "o_otro")))


def conf():
    return R.confidence(*[tuple(F.col(c) for c in cols) for _, cols in SIDES])


@query("prj05_confidence", f"WITH {D.TRIPLES} SELECT triple_id, {D.CONFIDENCE} AS confidence FROM triples")
def prj05(spark, d):
    return V.triples(spark, d).select("triple_id", conf().alias("confidence"))


@query("prj06_entity_types", f"WITH {D.TRIPLES} SELECT triple_id, CASE WHEN s_ebio >= 0.7 THEN 'EBio' WHEN s_ngen >= s_otro AND s_ngen > 0 THEN 'NGen' ELSE 'other' END AS subject_type, CASE WHEN o_ebio >= 0.6 THEN 'EBio' WHEN o_ngen >= 0.5 THEN 'NGen' WHEN o_otro >= 0.4 THEN 'other' END AS object_type FROM triples")
def prj06(spark, d):
    c = F.col
    return V.triples(spark, d).select("triple_id", R.entity_type(c("s_ebio"), c("s_ngen"), c("s_otro")).alias("subject_type"), R.picked_type(c("o_ebio"), c("o_ngen"), c("o_otro"), {"EBio": 0.6, "NGen": 0.5, "other": 0.4}).alias("object_type"))


@query("prj07_search_hits", f"WITH {D.TRIPLES} SELECT triple_id, article_id AS paper_id, CASE WHEN length(sentence_text) > 100 THEN substr(sentence_text, 1, 100) || '...' ELSE sentence_text END AS title, substr(md5(article_id || ':' || sentence_text), 1, 12) AS sent_id, sentence_text AS text, round({D.CONFIDENCE}, 4) AS confidence, 'sentence' AS search_level FROM triples")
def prj07(spark, d):
    c = F.col
    title = F.when(F.length("sentence_text") > 100, F.concat(F.substring("sentence_text", 1, 100), F.lit("..."))).otherwise(c("sentence_text"))
    return V.triples(spark, d).select("triple_id", c("article_id").alias("paper_id"), title.alias("title"), T.sentence_id(c("article_id"), c("sentence_text")).alias("sent_id"), c("sentence_text").alias("text"), F.round(conf(), 4).alias("confidence"), F.lit("sentence").alias("search_level"))


@query("prj08_signatures", f"WITH {D.TRIPLES} SELECT triple_id, {D.normalized('subject')} || '|' || {D.normalized('relation')} || '|' || {D.normalized('object')} AS signature, {D.normalized('substr(sentence_text, 1, 80)')} AS entity FROM triples")
def prj08(spark, d):
    c = F.col
    return V.triples(spark, d).select("triple_id", R.signature(c("subject"), c("relation"), c("object")).alias("signature"), R.normalized(F.substring("sentence_text", 1, 80)).alias("entity"))


@query("prj09_informative", f"WITH {D.TRIPLES} SELECT triple_id, {D.informative('subject')} AS subject_ok, {D.informative('object')} AS object_ok FROM triples")
def prj09(spark, d):
    return V.triples(spark, d).select("triple_id", R.informative(F.col("subject")).alias("subject_ok"), R.informative(F.col("object")).alias("object_ok"))


@query("prj10_quality", f"WITH {D.TRIPLES} SELECT triple_id, round((s_ebio + o_ebio) / 2 * 0.3::DOUBLE + {D.CONFIDENCE} * 0.3::DOUBLE + least((pos % 30) / 20.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE, 6) AS quality FROM triples")
def prj10(spark, d):
    c = F.col
    return V.triples(spark, d).select("triple_id", F.round(R.quality(c("s_ebio"), c("o_ebio"), conf(), (c("pos") % 30).cast("double")), 6).alias("quality"))


def redact_sql(c):
    out = f"coalesce({c}, '')"
    for p, put in T.REDACTIONS:
        out = f"regexp_replace({out}, '{p}', '{put}', 'g')"
    return out


@query("prj12_redaction", rf"SELECT doc_id, trim(regexp_replace(r, '\s+', ' ', 'g')) AS query, r <> text AS redacted, r <> '' AND NOT contains(r, '[secret]') AS safe_for_web FROM (SELECT doc_id, text, {redact_sql('text')} AS r FROM documents)")
def prj12(spark, d):
    r = V.table(spark, d, "documents").select("doc_id", "text", T.redacted(F.col("text")).alias("r"))
    return r.select("doc_id", T.squeeze(F.col("r")).alias("query"), (F.col("r") != F.col("text")).alias("redacted"), ((F.col("r") != "") & ~F.contains("r", F.lit("[secret]"))).alias("safe_for_web"))


@query("prj13_token_estimates", f"SELECT doc_id, {D.tokens('text')} AS tokens, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT AS quarter_tokens FROM documents")
def prj13(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"), T.quarter_tokens(F.col("text")).alias("quarter_tokens"))


def sentence_sql(c):
    t = rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"
    for a in T.PROTECTED:
        t = f"replace({t}, '{a}', '{a.replace('.', '<dot>')}')"
    marked = rf"regexp_replace({t}, '([.!?])\s+([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g')"
    return rf"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace(replace(s, '<dot>', '.'), '^[ -]+|[ -]+$', '', 'g')), lambda s: s <> '')"


@query("prj14_sentences", f"SELECT conv_id, turn, len(l) AS n, array_to_string(l, chr(10)) AS sentences FROM (SELECT conv_id, turn, {sentence_sql('text')} AS l FROM conversations)")
def prj14(spark, d):
    s = V.table(spark, d, "conversations").select("conv_id", "turn", T.sentences(F.col("text")).alias("l"))
    return s.select("conv_id", "turn", F.size("l").cast("long").alias("n"), F.array_join("l", "\n").alias("sentences"))


#: Common words stand in for a vocabulary of topics.
TOPICS = ["the", "der", "que", "les", "and"]


@query("prj15_tags", f"SELECT doc_id, array_to_string(list_sort(list_filter([{D.quoted(TOPICS)}], lambda w: contains(lower(coalesce(text, '')), w))), ',') AS tags FROM documents")
def prj15(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.array_join(T.tags(F.col("text"), TOPICS), ",").alias("tags"))


INTENT_SQL = f"CASE WHEN {D.contains_any('lower(text)', T.COMPARE)} THEN 'compare' WHEN {D.contains_any('lower(text)', T.MECHANISM)} THEN 'mechanism' WHEN {D.contains_any('lower(text)', T.EVIDENCE)} THEN 'evidence' WHEN contains(text, '?') THEN 'question' ELSE 'statement' END"


@query("prj17_state_keys", f"SELECT conv_id, turn, 'search:v1|len:' || CASE WHEN n <= 5 THEN 'short' WHEN n <= 14 THEN 'medium' ELSE 'long' END || '|intent:' || i || '|selected:' || CASE WHEN turn <= 0 THEN 'none' WHEN turn <= 2 THEN 'few' WHEN turn <= 5 THEN 'medium' ELSE 'many' END AS state_key, CASE WHEN len(k) = 0 THEN 'empty' ELSE array_to_string(list_slice(list_sort(k), 1, 8), '|') END AS terms_key, 'context:' || least(turn, 9) || '|triplets:' || least(n, 9) AS action_key FROM (SELECT conv_id, turn, len({D.important('text', 80)}) AS n, {D.important('text', 12)} AS k, {INTENT_SQL} AS i FROM conversations)")
def prj17(spark, d):
    c = V.table(spark, d, "conversations")
    text = F.col("text")
    key = F.concat(F.lit("search:v1|len:"), T.length_bucket(text), F.lit("|intent:"), T.intent(text), F.lit("|selected:"), T.count_bucket(F.col("turn")))
    return c.select("conv_id", "turn", key.alias("state_key"), T.state_key(T.important_terms(text, 12)).alias("terms_key"), T.action_key({"context": F.col("turn"), "triplets": F.size(T.important_terms(text, 80))}).alias("action_key"))


def low_value_sql(c: str) -> str:
    n = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
    long_words = f"len(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{6,}}')))"
    authors, marks = n(c, T.AUTHOR_INITIAL), n(f"lower({c})", T.CITATION_MARK)
    report = f"{D.contains_any(f'lower({c})', T.CASE_REPORT)} AND NOT {D.contains_any(f'lower({c})', T.ONCOLOGY)}"
    return f"(contains(lower({c}), 'correspondence') OR {authors} >= 4 OR ({authors} >= 2 AND {marks} >= 1) OR ({marks} >= 2 AND {long_words} >= 8) OR (contains(lower({c}), 'physician') AND contains(lower({c}), 'noted') AND {D.contains_any(f'lower({c})', T.ADVICE)}) OR ({report}))"


#: Lines of documents and whole documents, for a query that compares.
@query("prj20_low_value", f"WITH {D.SENTENCES} SELECT doc_id, pos, {low_value_sql('sentence')} AS low_value FROM sentences UNION ALL SELECT doc_id, -1, {low_value_sql('text')} FROM documents WHERE text IS NOT NULL")
def prj20(spark, d):
    rows = V.sentences(spark, d).unionByName(V.table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.lit(-1).cast("long").alias("pos"), F.col("text").alias("sentence")))
    return rows.select("doc_id", "pos", T.low_value(F.col("sentence"), F.lit("compare")).alias("low_value"))


@query("prj21_blended_types", f"WITH {D.TRIPLES} SELECT triple_id, CASE WHEN b >= g THEN 'bio' ELSE 'gen' END AS label, round(greatest(b, g), 6) AS score FROM (SELECT triple_id, 0.6::DOUBLE * s_ebio + 0.4::DOUBLE * o_ebio AS b, 0.6::DOUBLE * s_ngen + 0.4::DOUBLE * o_ngen AS g FROM triples)")
def prj21(spark, d):
    x = R.blended_type({"bio": F.col("s_ebio"), "gen": F.col("s_ngen")}, {"bio": F.col("o_ebio"), "gen": F.col("o_ngen")}, 0.6)
    return V.triples(spark, d).select("triple_id", x["label"].alias("label"), x["score"].alias("score"))


@query("prj25_message_flags", f"SELECT conv_id, turn, len({D.important('text', 80)}) < 4 AS context_poor, regexp_matches(trim(lower(text)), '^[a-h][).]?$') AS option_reply, {D.contains_any('lower(text)', ['as above', 'continue', 'earlier', 'previous', 'summarize that', 'rewrite that'])} AS followup FROM conversations")
def prj25(spark, d):
    low = F.lower("text")
    return V.table(spark, d, "conversations").select("conv_id", "turn", (F.size(T.important_terms(F.col("text"), 80)) < 4).alias("context_poor"), F.trim(low).rlike(r"^[a-h][).]?$").alias("option_reply"), T.contains_any(low, ["as above", "continue", "earlier", "previous", "summarize that", "rewrite that"]).alias("followup"))
