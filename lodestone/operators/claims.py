"""Claims and their support: atomic claims, comparability, heuristic entailment, support status, panels, conflicts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T

# Words that results must agree on.
NLI_NEGATORS = ["no", "not", "never", "without", "absent", "negative", "inhibits", "fails"]
CLAIM_NEGATORS = ["no", "not", "never", "without", "absent", "negative", "fails", "cannot", "can't", "doesn't"]
VERBS = r"inhibits?|activates?|induces?|reduces?|increases?|decreases?|predicts?|improves?|worsens?|causes?|associates?|correlates?|binds?|expresses?|regulates?|is|are|was|were|has|have|had|uses?|used|reports?|reported"
METHOD, ADVICE = ["method", "methods", "cohort", "assay", "sequencing", "trial", "randomized"], ["should", "recommend", "recommended", "consider"]

# What marks speculation, negation, a citation, an acronym and a report of findings.
SPECULATION = r"(?i)\b(may|might|could|possibly|possible|suggests?|suggested|likely|uncertain|unclear|appears?)\b"
NEGATION = r"(?i)\b(no|not|never|without|absent|negative|fails?|cannot|can't|does not|do not|did not)\b"
CITATION = r"(?i)\b(PMID|PMCID|doi)\b|\[[0-9,\s-]+\]|\([A-Z][A-Za-z-]+ et al\.,? \d{4}\)"
ACRONYM = r"\b[A-Z0-9-]{2,}\b"
REPORT = r"\b(study|paper|analysis|result|finding|reports?|reported|shows?|showed)\b"

# Starts of sentences that claim nothing, words of the field, types of claims that need a citation, verbs that relate and verbs that state.
NON_FACTUAL = ["thanks", "thank you", "sure", "here is", "here are", "i can", "i will", "let me know", "please"]
FIELD = ["aggregation", "aspirin", "biomarker", "cancer", "cardiovascular", "cell", "chemotherapy", "clinical", "disease", "expression", "gene", "inflammation", "inhibits", "insulin", "metformin", "mutation", "patient", "platelet", "protein", "risk", "sensitivity", "study", "thrombotic", "treatment", "tumor"]
CITED = ["biomedical_fact", "method", "recommendation", "uncertainty"]
RELATING = r"(?i)\b(inhibits?|activates?|induces?|reduces?|increases?|decreases?|predicts?|improves?|worsens?|causes?|associates?|correlates?|binds?|expresses?|regulates?)\b"
STATING = r"(?i)\b(is|are|was|were|has|have|had|uses?|used|reports?|reported)\b"
NAMES = r"\b[A-Z][A-Za-z0-9-]*(?:\s+[A-Z][A-Za-z0-9-]*){0,3}\b"
NO_NAMES = ["the", "this", "these"]


def non_factual(c: Column) -> Column:
    """Whether a sentence is blank, a question or a courtesy."""
    low = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    out = (low == "") | low.endswith("?")
    for start in NON_FACTUAL:
        out = out | low.startswith(start)
    return out


def claim_type(c: Column) -> Column:
    """The first rule that holds: citation, nothing claimed, method, recommendation, uncertainty, fact (a word of the field, an acronym or a
    reporting word), other."""
    toks = F.array_distinct(T.terms(c))
    has = lambda ws: F.arrays_overlap(toks, T.lits(ws))
    return F.when(c.rlike(CITATION), "citation_statement").when(non_factual(c), "other").when(has(METHOD), "method").when(has(ADVICE), "recommendation").when(c.rlike(SPECULATION), "uncertainty").when(has(FIELD) | c.rlike(ACRONYM) | F.lower(c).rlike(REPORT), "biomedical_fact").otherwise("other")


def claim_entities(c: Column) -> Column:
    """Names (runs of up to four capitalised words, as first written), then words of the field that aren't among them."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NAMES), F.lit(0))
    low = F.transform(found, F.lower)
    names = F.filter(found, lambda x, i: (F.array_position(low, F.lower(x)) == i + 1) & ~F.lower(x).isin(NO_NAMES))
    return F.concat(names, F.array_except(F.array_intersect(F.array_distinct(T.terms(c)), T.lits(FIELD)), low))


def claim_relations(c: Column) -> Column:
    """Verbs of the claim in lower case: those that relate, then those that state."""
    verbs = lambda p: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(1)), F.lower)
    return F.array_distinct(F.concat(verbs(RELATING), verbs(STATING)))


def speculation(c: Column) -> Column:
    """none, likely, uncertain or possible, by the first hedging word."""
    word = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), SPECULATION, 1))
    return F.when(word == "", "none").when(word.isin("likely", "appears", "appear"), "likely").when(word.isin("uncertain", "unclear"), "uncertain").otherwise("possible")


def finished(c: Column) -> Column:
    """Without blanks, commas and semicolons at the ends, and with a full stop where no mark ends it."""
    t = F.regexp_replace(c, r"^[ ,;]+|[ ,;]+$", "")
    return F.when((t == "") | t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def atomic_claims(answers: DataFrame, key: list[str], text: str) -> DataFrame:
    """Keys with place, part, sentence, claim, claim_id, claim_type, entities, relations, negation, speculation, requires_citation.

    Sentences with a subject and verb are split at ';' and 'and', and a part that starts with a verb gets the subject again; other sentences
    are one claim. Questions and courtesies give none.
    """
    s = answers.select(*key, F.posexplode(T.sentences(F.col(text))).alias("place", "sentence")).filter(~non_factual(F.col("sentence")))
    body = F.regexp_replace("sentence", r"[.!?]$", "")
    subject = F.regexp_replace(F.regexp_extract(body, rf"(?i)^(.+?)\s+\b({VERBS})\b", 1), r"^[ ,;]+|[ ,;]+$", "")
    subject = F.when(F.size(F.split(subject, r"\s+")) > 8, "").otherwise(subject)
    parts = F.when(subject == "", F.array(body)).otherwise(F.transform(F.split(body, r"\s*;\s*|\s+\band\b\s+"), lambda p, i: F.when((i > 0) & p.rlike(rf"(?i)^({VERBS})\b"), F.concat_ws(" ", subject, p)).otherwise(p)))
    rows = s.select(*key, F.col("place").cast("long").alias("place"), "sentence", F.posexplode(parts).alias("part", "c"))
    rows = rows.withColumn("claim", finished(T.squeeze(finished(F.col("c"))))).filter((F.col("claim") != "") & ~non_factual(F.col("claim"))).withColumn("claim_type", claim_type(F.col("claim")))
    c = F.col("claim")
    return rows.select(*key, "place", F.col("part").cast("long").alias("part"), "sentence", "claim", T.stable_id(F.col("place").cast("string"), c, prefix="claim_").alias("claim_id"), "claim_type", claim_entities(c).alias("entities"), claim_relations(c).alias("relations"), c.rlike(NEGATION).alias("negation"), speculation(c).alias("speculation"), F.col("claim_type").isin(CITED).alias("requires_citation"))


def heuristic_scores(premise: Column, hypothesis: Column) -> tuple[Column, Column, Column]:
    """(entailment, contradiction, neutral) by overlap and unlike negation."""
    o = T.lexical_overlap(premise, hypothesis)
    unlike = (T.hits(premise, NLI_NEGATORS) > 0) != (T.hits(hypothesis, NLI_NEGATORS) > 0)
    c = F.when((o > 0.15) & unlike, F.least(F.lit(1.0), o + 0.25)).otherwise(0.0)
    e = F.greatest(F.lit(0.0), F.least(F.lit(1.0), o - c * 0.5))
    return e, c, F.greatest(F.lit(0.0), 1.0 - e - c)


def scored_pairs(pairs: DataFrame, premise: str, hypothesis: str) -> DataFrame:
    """pairs with entailment, contradiction, neutral (4 places) and label."""
    rows = pairs.withColumns(dict(zip(("_e", "_c", "_n"), heuristic_scores(F.col(premise), F.col(hypothesis)), strict=True)))
    label = F.when(F.col("_e") >= F.greatest("_c", "_n"), "entailment").when(F.col("_c") >= F.col("_n"), "contradiction").otherwise("neutral")
    return rows.withColumn("label", label).withColumns({k: F.round(c, 4) for k, c in (("entailment", "_e"), ("contradiction", "_c"), ("neutral", "_n"))}).drop("_e", "_c", "_n")


def status(e: Column, c: Column, n: Column, least: float = 0.5, contra: float = 0.5) -> Column:
    return F.when(c >= contra, "contradicted").when((e >= least) & (e >= n), "entailed").otherwise("unsupported")


def candidate_pairs(claims: DataFrame, evidence: DataFrame, session: str, n: int) -> DataFrame:
    """(session, claim_id, evidence_id, shared, overlap): the n best evidence rows of each claim that share a term with it, by Jaccard.

    claims: (session, claim_id, claim); evidence: (session, evidence_id, premise). Pairs come from shared terms within a session.
    """
    c = claims.select(session, "claim_id", F.array_distinct(T.important_terms(F.col("claim"), 80)).alias("ct"))
    e = evidence.select(session, "evidence_id", F.array_distinct(T.important_terms(F.col("premise"), 120)).alias("et"))
    shared = c.select(session, "claim_id", F.size("ct").alias("nc"), F.explode("ct").alias("t")).join(e.select(session, "evidence_id", F.size("et").alias("ne"), F.explode("et").alias("t")), [session, "t"])
    rows = shared.groupBy(session, "claim_id", "evidence_id", "nc", "ne").agg(F.count("*").alias("shared")).withColumn("overlap", F.round(F.col("shared") / (F.col("nc") + F.col("ne") - F.col("shared")), 6))
    w = Window.partitionBy(session, "claim_id").orderBy(F.desc("overlap"), "evidence_id")
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select(session, "claim_id", "evidence_id", "shared", "overlap")


def support(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with status, n_checked, best_evidence: contradicted wins over entailed."""
    rows = scored.withColumn("_s", status(F.col("entailment"), F.col("contradiction"), F.col("neutral")))
    g = rows.groupBy(*keys).agg(F.count("*").alias("n_checked"), F.count_if(F.col("_s") == "contradicted").alias("nc"), F.count_if(F.col("_s") == "entailed").alias("ne"), F.max(F.struct(F.when(F.col("_s") == "contradicted", F.col("contradiction")).alias("s"), (-F.col("evidence_id")).alias("i"))).alias("xc"), F.max(F.struct(F.when(F.col("_s") == "entailed", F.col("entailment")).alias("s"), (-F.col("evidence_id")).alias("i"))).alias("xe"))
    return g.select(*keys, F.when(F.col("nc") > 0, "contradicted").when(F.col("ne") > 0, "entailed").otherwise("unsupported").alias("status"), "n_checked", F.when(F.col("nc") > 0, -F.col("xc.i")).when(F.col("ne") > 0, -F.col("xe.i")).alias("best_evidence"))


def claim_support(pairs: DataFrame, keys: list[str], comparable: Column, most: int = 8) -> DataFrame:
    """Keys with status, n_candidates, n_incomparable, n_checked, best_entailment, max_contradiction, best_evidence, prompt_supported, needs_confirmation.

    pairs: keys, evidence_id, premise, hypothesis, requires_citation, in_prompt. Evidence that can't be compared with the claim is counted and not
    scored; of the rest the first `most` by evidence_id are. Contradicted wins over entailed; ties go to the smaller evidence_id. A claim that needs
    no citation is not_checked.
    """
    rows = pairs.withColumn("_ok", F.coalesce(comparable, F.lit(False)))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_candidates"), F.count_if(~F.col("_ok")).alias("n_incomparable"), F.max("requires_citation").alias("_cited"))
    few = rows.filter("_ok AND requires_citation").withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("evidence_id"))).filter(F.col("_r") <= most)
    scored = scored_pairs(few, "premise", "hypothesis")
    best = scored.groupBy(*keys).agg(F.max("entailment").alias("best_entailment"), F.max("contradiction").alias("max_contradiction"), F.max((status(F.col("entailment"), F.col("contradiction"), F.col("neutral")) == "entailed") & F.coalesce("in_prompt", F.lit(False))).alias("prompt_supported"))
    out = counts.join(support(scored, keys), keys, "left").join(best, keys, "left")
    state = F.when(~F.col("_cited"), "not_checked").otherwise(F.coalesce("status", F.lit("unsupported")))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select(*keys, state.alias("status"), "n_candidates", "n_incomparable", F.coalesce("n_checked", F.lit(0)).alias("n_checked"), zero("best_entailment"), zero("max_contradiction"), "best_evidence", F.coalesce("prompt_supported", F.lit(False)).alias("prompt_supported"), (state == "contradicted").alias("needs_confirmation"))


def claim_conflicts(claims: DataFrame, session: str, negators: list[str] = CLAIM_NEGATORS) -> DataFrame:
    """(session, claim_id, prior_id): the first earlier claim of the session with an overlap of 0.45 and opposite negation.

    claims: (session, claim_id, claim), claim_id in order. Candidates share a term, so no pair without one is built.
    """
    c = claims.select(session, "claim_id", T.important_terms(F.col("claim"), 24).alias("t"), (T.hits(F.col("claim"), negators) > 0).alias("neg"))
    e = c.select(session, "claim_id", "neg", F.size("t").alias("n"), F.explode("t").alias("term"))
    p = e.select(session, F.col("claim_id").alias("prior_id"), F.col("neg").alias("pneg"), F.col("n").alias("pn"), "term")
    pairs = e.join(p, [session, "term"]).filter((F.col("prior_id") < F.col("claim_id")) & (F.col("neg") != F.col("pneg"))).groupBy(session, "claim_id", "prior_id", "n", "pn").agg(F.count("*").alias("k"))
    return pairs.filter(F.col("k") / F.greatest(F.lit(1), F.least("n", "pn")) >= 0.45).groupBy(session, "claim_id").agg(F.min("prior_id").alias("prior_id"))


def triple_conflicts(triples: DataFrame, n: int = 5) -> DataFrame:
    """(article_id, triple_id, other_id): triples of an article with the same two entities either way round whose relation differs
    (overlap under 0.35) or changes polarity; the first n of each. triples: (article_id, triple_id, subject, relation, object)."""
    norm = lambda c: F.array_join(T.terms(F.col(c)), " ")
    t = triples.select("article_id", "triple_id", "relation", F.array_sort(F.array(norm("subject"), norm("object"))).alias("pair")).filter(~F.array_contains("pair", ""))
    o = t.select("article_id", "pair", F.col("triple_id").alias("other_id"), F.col("relation").alias("other"))
    neg = lambda c: T.hits(F.col(c), T.NEGATORS) > 0
    hit = t.join(o, ["article_id", "pair"]).filter(F.col("triple_id") < F.col("other_id")).filter((T.lexical_overlap(F.col("relation"), F.col("other")) < 0.35) | (neg("relation") != neg("other")))
    w = Window.partitionBy("article_id", "triple_id").orderBy("other_id")
    return hit.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select("article_id", "triple_id", "other_id")


def panel(scores: DataFrame, key: str) -> DataFrame:
    """Consensus of several scorers: mean entailment and neutral, largest contradiction, label, and the share that agrees with it."""
    mean = lambda c: (F.floor((2 * F.sum(F.round(F.col(c) * 10000).cast("long")) + F.count("*")) / (2 * F.count("*"))) / 10000.0).alias(c)  # noqa: E731  scores have 4 places: sums of whole numbers don't depend on their order
    g = scores.groupBy(key).agg(mean("entailment"), F.round(F.max("contradiction"), 4).alias("contradiction"), mean("neutral"), F.collect_list("label").alias("_l"))
    label = F.when((F.col("entailment") >= F.col("contradiction")) & (F.col("entailment") >= F.col("neutral")), "entailment").when(F.col("contradiction") >= F.col("neutral"), "contradiction").otherwise("neutral")
    g = g.withColumn("label", label)
    return g.withColumn("agreement", F.round(F.size(F.filter("_l", lambda x: x == F.col("label"))) / F.size("_l"), 4)).drop("_l")
