"""Query anchors, concepts, external queries, evidence assembly, multi-level retrieval, comparability, frames, near-duplicate terms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators import index as N
from lodestone.operators import retrieval as X
from lodestone.operators.claims import NEGATION


# Names, species, cell lines and times in texts; words that don't count, that name diseases and relations, or that count as names;
# sections whose statements are weak.
NAME = r"\b[A-Z][A-Za-z0-9-]*(?:\s+[A-Z][A-Za-z0-9-]*){0,3}\b"
SPECIES = r"(?i)\b(mouse|mice|murine|rat|rats|human|patients?|cell line|in vitro|in vivo|xenograft|organoid)\b"
CELL_LINE = r"\b[A-Z]{1,5}[- ]?\d{1,4}[A-Z]?\b"
TIME = r"(?i)\b(acute|chronic|early|late|baseline|after|before|post[- ]?treatment|pre[- ]?treatment|\d+\s*(day|week|month|year)s?)\b"
COMMON = ["the", "and", "for", "that", "this", "with", "from", "into", "what", "when", "where", "which", "would", "could", "should", "about", "there", "their", "study", "studies", "reports", "reported", "shows", "showed", "used", "using", "risk", "response", "disease"]
DISEASES = ["cancer", "carcinoma", "tumor", "tumour", "cardiovascular", "diabetes", "insulin", "thrombosis", "thrombotic", "inflammation", "infection"]
RELATIONS = ["inhibit", "inhibits", "inhibited", "activate", "activates", "reduce", "reduces", "increase", "increases", "decrease", "decreases", "predict", "predicts", "improve", "improves", "cause", "causes", "associate", "associated", "correlate", "correlates", "bind", "binds", "regulate", "regulates", "use", "uses"]
KNOWN = ["aspirin", "metformin", "platelet", "aggregation", "biomarker", "chemotherapy"]
WEAK_SECTIONS = ["introduction", "background", "discussion"]


def concept(c: Column) -> Column:
    """The normal form of a concept: lower-case words and digits, hyphens as spaces, plural endings folded."""
    t = F.array_join(F.regexp_extract_all(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("-"), F.lit(" ")), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    n = F.length(t)
    return F.when(t.endswith("ies") & (n > 4), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y"))).when(t.endswith("s") & (n > 4) & ~t.endswith("ss") & ~t.endswith("ous"), F.substring(t, F.lit(1), n - 1)).otherwise(t)


def concepts(rows: DataFrame, key: str, term: str, synonyms: DataFrame) -> DataFrame:
    """key, idea, parent: the concept or what it is a synonym of; the parent is the first of several words. synonyms: (concept, canonical)."""
    r = rows.select(key, concept(F.col(term)).alias("concept")).join(synonyms, "concept", "left").select(key, F.coalesce("canonical", "concept").alias("idea"))
    return r.withColumn("parent", F.when(F.contains("idea", F.lit(" ")), F.substring_index("idea", " ", 1)))


def answer_mode(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The first mode whose pattern the message matches."""
    out = F.lit(default)
    for mode, pattern in reversed(rules):
        out = F.when(F.lower(c).rlike(pattern), mode).otherwise(out)
    return out


def query_anchors(queries: DataFrame, generic: DataFrame, aliases: DataFrame, n: int) -> DataFrame:
    """(query_id, place, anchor): the query's terms without generic ones, acronyms expanded; generic: (term); aliases: (term, expansion)."""
    t = queries.select("query_id", F.posexplode(T.important_terms(F.col("query"), 40)).alias("p", "term"))
    kept = t.join(generic, "term", "left_anti").join(aliases, "term", "left").withColumn("anchor", F.coalesce("expansion", "term"))
    return X.top(kept, "query_id", ["p"], n, "place").select("query_id", "place", "anchor")


def external_query(c: Column, task_words: list[str], n: int) -> Column:
    """A privacy-safe query: redacted, without task words, its first n terms."""
    plain = F.regexp_replace(T.redacted(c), r"\[[a-z]+\]", " ")
    return F.array_join(F.slice(F.filter(T.important_terms(plain, 40), lambda t: ~t.isin(task_words)), 1, n), " ")


def preserves_seed(seed: Column, candidate: Column, least: float = 0.5, most_new: float = 0.6) -> Column:
    """Whether a rewritten query keeps enough of the seed's terms and brings in not too many new ones."""
    s, c = T.important_terms(seed, 40), T.important_terms(candidate, 40)
    return (F.size(F.array_intersect(s, c)) >= F.lit(least) * F.size(s)) & (F.size(F.array_except(c, s)) <= F.lit(most_new) * F.greatest(F.lit(1), F.size(c)))


def assembled(hits: DataFrame, anchors: DataFrame) -> DataFrame:
    """(query_id, nodes, covered, relations, status, quality): evidence over a query's nodes. A hit with two nodes is a relation.

    hits: (query_id, doc, text); anchors: (query_id, anchor).
    """
    m = anchors.join(hits, "query_id", "left").withColumn("ok", F.coalesce(F.contains(F.lower("text"), F.col("anchor")), F.lit(False)))
    node = m.groupBy("query_id", "anchor").agg(F.max("ok").alias("ok")).groupBy("query_id").agg(F.count("*").alias("nodes"), F.count_if("ok").alias("covered"))
    hit = m.filter("ok").groupBy("query_id", "doc").agg(F.count("*").alias("k")).groupBy("query_id").agg(F.count_if(F.col("k") >= 2).alias("relations"))
    r = node.join(hit, "query_id", "left").na.fill(0, ["relations"])
    status = F.when((F.col("covered") == F.col("nodes")) & (F.col("relations") > 0), "supported").when(F.col("covered") > 0, "partial").otherwise("missing")
    quality = F.least(F.lit(1.0), 0.7 * F.col("covered") / F.greatest(F.lit(1), F.col("nodes")) + 0.1 * F.col("relations"))
    return r.withColumn("status", status).withColumn("quality", F.round(F.when(F.col("relations") == 0, F.least(quality, F.lit(0.5))).otherwise(quality), 4))


def merged_sources(lists: list[tuple[str, float, DataFrame]], k: int) -> DataFrame:
    """(query_id, rank, doc, source, score): ranked lists (query_id, doc, score) with a prior each; the best entry of a document wins."""
    out = None
    for name, prior, df in lists:
        df = df.select("query_id", "doc", F.round(F.col("score") + prior, 6).alias("score"), F.lit(name).alias("source"))
        out = df if out is None else out.unionByName(df)
    first = out.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "doc").orderBy(F.desc("score"), "source"))).filter("_r = 1").drop("_r")
    return X.top(first, "query_id", [F.desc("score"), "doc"], k).select("query_id", "rank", "doc", "source", "score")


# What a source adds to a result's rank, an id, no shared term; the weight of the title and the most terms that it is measured against.
PRIORS = {"litsense2": 0.16, "pubtator3": 0.12, "pmc_fulltext_sentence": 0.14, "pubmed": 0.04, "pmc": 0.04}
WITH_ID, NOTHING_SHARED, TITLE_WEIGHT, TITLE_TERMS = 0.04, -0.20, 0.45, 12


def external_results(queries: DataFrame, results: DataFrame, k: int, priors: dict[str, float] | None = None) -> DataFrame:
    """(query_id, rank, key, source, score, tier, missing): results of several sources, ranked and merged; the first of each key stays.

    queries: (query_id, query, anchors: array of required anchors, perhaps empty). results: (query_id, source, key, title, snippet, provider_score, has_id).
    The score is the share of the query's terms in title and snippet, 0.45 times their share in the title, the source's prior (a source named
    a or a:b has that of a), and what an id adds. Results with all anchors (tier 2) go first, then those with some (1); then by score,
    provider_score and key.
    """
    prior = F.lit(0.0)
    for name, p in (priors or PRIORS).items():
        prior = F.when(F.substring_index("source", ":", 1) == name, p).otherwise(prior)
    q = queries.select("query_id", T.important_terms(F.col("query"), 64).alias("_q"), F.coalesce("anchors", F.array().cast("array<string>")).alias("_a"))
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    rows = results.join(q, "query_id").withColumns({"_t": T.important_terms(F.col("title"), 80), "_s": T.important_terms(F.col("snippet"), 160)})
    n = F.size("_q")
    both, named = F.size(F.array_intersect("_q", F.array_union("_t", "_s"))), F.size(F.array_intersect("_q", "_t"))
    add = prior + F.when(F.col("has_id"), WITH_ID).otherwise(0.0) + F.when(both == 0, NOTHING_SHARED).otherwise(0.0)
    score = both / F.greatest(F.lit(1), n) + TITLE_WEIGHT * named / F.greatest(F.lit(1), F.least(n, F.lit(TITLE_TERMS))) + add
    missing = F.filter("_a", lambda a: ~F.regexp_like(text, X.alias_pattern(a)))
    rows = rows.select("query_id", "key", "source", "provider_score", F.round(score, 4).alias("score"), missing.alias("missing"), F.when(F.size(missing) == 0, 2).when(F.size(missing) < F.size("_a"), 1).otherwise(0).alias("tier"))
    order = [F.desc("tier"), F.desc("score"), F.desc("provider_score"), "key", "source"]
    return X.top(X.top(rows, ["query_id", "key"], order, 1, "_first").drop("_first"), "query_id", order, k).select("query_id", "rank", "key", "source", "score", "tier", "missing")


def open_nodes_covered(missing: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, covered): whether the results name all of a query's open nodes; missing: (query_id, node), results: (query_id, text)."""
    hit = missing.join(results, "query_id", "left").groupBy("query_id", "node").agg(F.max(F.coalesce(F.contains(F.lower("text"), F.col("node")), F.lit(False))).alias("ok"))
    return hit.groupBy("query_id").agg(F.min("ok").alias("covered"))


def reusable_notes(queries: DataFrame, notes: DataFrame, least: int = 1) -> DataFrame:
    """(query_id, note_id, shared): notes of the session that share anchors with the query. Both: (session, id, anchors: array)."""
    q = queries.select("session", "query_id", F.explode("anchors").alias("a"))
    n = notes.select("session", "note_id", F.explode("anchors").alias("a"))
    return q.join(n, ["session", "a"]).groupBy("query_id", "note_id").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def multilevel(queries: DataFrame, levels: list[tuple[str, DataFrame, N.Index, str, dict, int]], feedback: int = 4) -> DataFrame:
    """(query_id, level, rank, doc, score): one stage a level over all queries; each level's accepted hits give the next level's extra terms.

    levels: (name, docs, index, text column, boosts, budget). A document counts at the first level that finds it.
    """
    asked, out = queries, None
    for name, docs, index, text, boosts, budget in levels:
        hits = N.bm25(asked, index, boosts, budget).select("query_id", F.lit(name).alias("level"), "rank", "doc", "score")
        if out is not None:
            hits = hits.join(out.select("query_id", "doc"), ["query_id", "doc"], "left_anti").select(*out.columns)
        hits = hits.checkpoint()  # the next stage starts from here
        texts = hits.join(docs.withColumnRenamed(docs.columns[0], "doc").select("doc", F.col(text).alias("text")), "doc")
        more = X.feedback_terms(texts, queries, feedback).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("more"))
        asked = queries.join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "query", "more").alias("query"))
        out = hits if out is None else out.unionByName(hits)
    return out


def comparability(premise: Column, hypothesis: Column, relations: list[str] = RELATIONS, diseases: list[str] = DISEASES, negation: str = NEGATION, section: Column | None = None, entities: Column | None = None) -> dict[str, Column]:
    """score (4 places), comparable, reasons and blocking of a pair: weighted overlaps of words, entities and relations, less penalties for unlike
    diseases, entities, relations, species, cell lines, times and for a weak section of the premise.

    entities: the hypothesis' own, if known (else its names). blocking is the first mismatch that forbids a comparison, or what is lacking.
    """
    none = F.array().cast("array<string>")
    words = lambda c: F.array_distinct(F.filter(T.terms(c), lambda t: ~t.isin(COMMON)))
    found = lambda c, p: F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(0)), F.lower))
    names = lambda c: F.array_union(found(c, NAME), F.array_intersect(words(c), T.lits(KNOWN)))
    among = lambda c, ws: F.array_intersect(F.array_distinct(T.terms(c)), T.lits(ws))
    stems = lambda c: F.array_distinct(F.transform(among(c, relations), lambda x: F.regexp_replace(F.regexp_replace(x, "s$", ""), "ed$", "")))
    unlike = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) == 0)
    joined = lambda xs: F.transform(xs, lambda x: F.replace(x, F.lit(" "), F.lit("-")))
    pw, hw, pe, he = words(premise), words(hypothesis), names(premise), names(hypothesis)
    if entities is not None:
        given = F.array_distinct(F.transform(F.coalesce(entities, none), F.lower))
        he = F.when(F.size(given) > 0, given).otherwise(he)
    pr, hr = stems(premise), stems(hypothesis)
    says_no = lambda c: F.coalesce(c, F.lit("")).rlike(negation)
    weak = F.lit(False) if section is None else F.lower(F.coalesce(section, F.lit(""))).isin(WEAK_SECTIONS)
    rules = [  # reason, whether it holds, what it adds, what it blocks
        ("disease_mismatch", unlike(among(premise, diseases), among(hypothesis, diseases)), -0.25, "disease"),
        ("entity_mismatch", unlike(pe, he), -0.35, "entity"),
        ("relation_mismatch", unlike(pr, hr), -0.15, None),
        ("species_or_population_mismatch", unlike(found(premise, SPECIES), found(hypothesis, SPECIES)), -0.20, "species"),
        ("cell_line_mismatch", unlike(joined(found(premise, CELL_LINE)), joined(found(hypothesis, CELL_LINE))), -0.20, "cell_line"),
        ("negation_mismatch", says_no(premise) != says_no(hypothesis), 0.05, None),
        ("temporality_mismatch", unlike(found(premise, TIME), found(hypothesis, TIME)), -0.15, "temporality"),
        ("weak_section_context", weak, -0.05, None),
    ]
    score = 0.20 * T.lexical_overlap(premise, hypothesis) + 0.25 * T.jaccard(pw, hw) + 0.35 * F.greatest(T.jaccard(pe, he), T.jaccard(pw, he)) + 0.20 * T.jaccard(pr, hr)
    for _, cond, x, _ in rules:
        score = score + F.when(cond, x).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)
    level = F.when(score >= 0.65, "high_overlap").when(score >= 0.35, "low_but_usable_overlap").otherwise("insufficient_overlap")
    blocks = F.coalesce(*[F.when(cond, block) for _, cond, _, block in rules if block], F.when(score >= 0.35, "none"), F.when((F.size(he) > 0) | (F.size(pe) > 0), "entity"), F.lit("relation"))
    return {"score": score, "comparable": score >= 0.35, "reasons": F.array_compact(F.array(*[F.when(cond, name) for name, cond, _, _ in rules], level)), "blocking": blocks}


def frames(turns: DataFrame, key: str, order: str, most: int = 12) -> DataFrame:
    """key, order and the active terms after each turn: new terms first, then the earlier ones, `most` in all. An ordered fold that keeps
    term lists only."""
    xs = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, T.important_terms(F.col("text"), 6).alias("t")))).alias("xs"))
    start = F.struct(F.slice(F.get("xs.t", F.lit(0)), 1, 0).alias("a"), F.transform(F.slice("xs", 1, 0), lambda x: F.struct(x[order].alias(order), x["t"].alias("active"))).alias("out"))
    now = lambda s, x: F.slice(F.array_distinct(F.concat(x["t"], s["a"])), 1, most)
    step = lambda s, x: F.struct(now(s, x).alias("a"), F.concat(s["out"], F.array(F.struct(x[order].alias(order), now(s, x).alias("active")))).alias("out"))
    return xs.select(key, F.explode(F.aggregate("xs", start, step, lambda s: s["out"])).alias("x")).select(key, f"x.{order}", "x.active")


def claim_keys(claims: Column) -> Column:
    """(key, claim) of claims: those with the same first 14 terms are one. Blank claims go, long ones keep 1000 characters."""
    kept = F.filter(F.transform(F.coalesce(claims, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.transform(kept, lambda x: F.struct(F.array_join(T.important_terms(x, 14), " ").alias("key"), F.substring(x, 1, 1000).alias("claim")))


def frame_lists(turns: DataFrame, key: str, order: str, terms: dict[str, tuple[str, int]], claims: dict[str, tuple[str, int]]) -> DataFrame:
    """key, order and after each turn the running lists: what the turn brings first, then what was there, each once, as many as the cap allows.

    terms, claims: for each list, the turn's array column and the cap. Lists of claims hold (key, claim) and tell claims apart by their key.
    An ordered fold over capped lists of a key's turns.
    """
    none = F.array().cast("array<string>")
    given = {n: F.coalesce(F.col(c), none) for n, (c, _) in terms.items()} | {n: claim_keys(F.col(c)) for n, (c, _) in claims.items()}
    most = {n: k for n, (_, k) in (terms | claims).items()}
    xs = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*[v.alias(n) for n, v in given.items()]).alias("l")))).alias("xs"))

    def merged(name: str, new: Column, old: Column) -> Column:
        both = F.concat(new, old)
        if name in claims:
            keys = F.transform(both, lambda x: x["key"])
            return F.slice(F.filter(both, lambda x, i: F.array_position(keys, x["key"]) == i + 1), 1, most[name])
        return F.slice(F.array_distinct(both), 1, most[name])

    empty = F.struct(*[F.slice(F.get("xs.l", F.lit(0))[n], 1, 0).alias(n) for n in most])
    start = F.struct(empty.alias("now"), F.transform(F.slice("xs", 1, 0), lambda x: F.struct(x[order].alias(order), x["l"].alias("l"))).alias("out"))
    now = lambda s, x: F.struct(*[merged(n, x["l"][n], s["now"][n]).alias(n) for n in most])
    step = lambda s, x: F.struct(now(s, x).alias("now"), F.concat(s["out"], F.array(F.struct(x[order].alias(order), now(s, x).alias("l")))).alias("out"))
    return xs.select(key, F.explode(F.aggregate("xs", start, step, lambda s: s["out"])).alias("x")).select(key, f"x.{order}", "x.l.*")


def char_grams(term: Column, n: int = 4) -> Column:
    """The distinct n-grams of the lower-cased term, blanks as underscores; a shorter term is its own."""
    t = F.replace(F.lower(term), F.lit(" "), F.lit("_"))
    return F.when(F.length(t) < n, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - n + 1)), lambda i: F.substring(t, i, n))))


def similar_terms(left: DataFrame, right: DataFrame, least: float = 0.75, n: int = 4) -> DataFrame:
    """(term, other, similarity): terms of left and right (both: term) whose character n-grams agree by more than `least` (Jaccard).

    A set-similarity join: grams stand from the rarest on, and two sets that agree enough share one of the first few (k less the overlap that a
    match needs, plus 1), so frequent grams are hardly ever joined; sizes that forbid the similarity are dropped before the exact count.
    """
    sets = lambda df: df.select("term").filter("term IS NOT NULL").distinct().withColumn("g", char_grams(F.col("term"), n))
    a, b = sets(left), sets(right)
    held = a.unionByName(b).distinct().select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("held"))

    def prefix(df):
        rare = df.select("term", "g", F.explode("g").alias("gram")).join(held, "gram").groupBy("term", "g").agg(F.array_sort(F.collect_list(F.struct("held", "gram"))).alias("r"))
        few = F.slice("r", F.lit(1), F.size("g") - F.ceil(F.size("g") * F.lit(least)).cast("int") + 1)
        return rare.select("term", "g", F.explode(few).alias("x")).select("term", "g", "x.gram")

    other = prefix(b).select(F.col("term").alias("other"), F.col("g").alias("o"), "gram")
    fits = F.least(F.size("g"), F.size("o")) > F.lit(least) * F.greatest(F.size("g"), F.size("o"))
    pairs = prefix(a).join(other, "gram").filter(fits & (F.col("term") != F.col("other"))).select("term", "other", "g", "o").dropDuplicates(["term", "other"])
    both = F.size(F.array_intersect("g", "o"))
    return pairs.withColumn("similarity", F.round(both / (F.size("g") + F.size("o") - both), 4)).filter(both > F.lit(least) * (F.size("g") + F.size("o") - both)).select("term", "other", "similarity")


def near_duplicate_terms(terms: DataFrame, least: float = 0.75, n: int = 4) -> DataFrame:
    """(term, other, similarity): similar_terms within one table, each pair once."""
    return similar_terms(terms, terms, least, n).filter(F.col("term") < F.col("other"))


def promotion_gates(candidates: DataFrame, known: DataFrame, stop: DataFrame, least: float = 0.75, runs: int = 2) -> DataFrame:
    """(term, decision, closest): what stops each candidate (term, runs): stopword, near_duplicate (of a known term; the closest, ties to the smaller one),
    single_run, or nothing (promoted). known, stop: (term). A term that is known is its own nearest duplicate."""
    close = similar_terms(candidates, known, least).unionByName(candidates.select("term").join(known.select("term").distinct(), "term").select("term", F.col("term").alias("other"), F.lit(1.0).alias("similarity")))
    close = close.groupBy("term").agg(F.min_by("other", F.struct(-F.col("similarity"), "other")).alias("closest"))
    rows = candidates.join(close, "term", "left").join(stop.select("term").distinct().withColumn("_stop", F.lit(True)), "term", "left")
    decision = F.when(F.col("_stop"), "stopword").when(F.col("closest").isNotNull(), "near_duplicate").when(F.col("runs") < runs, "single_run").otherwise("promoted")
    return rows.select("term", decision.alias("decision"), F.when(decision == "near_duplicate", F.col("closest")).alias("closest"))
