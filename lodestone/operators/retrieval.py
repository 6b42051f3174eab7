"""Ranked retrieval for tables of queries: vectors, fallback, fusion, fuzzy search, expansion, feedback, coverage. BM25 is in index."""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators import index as N
from lodestone.operators import phrases as P

#: Queries whose products with a batch of rows a task holds at once.
TILE = 512


def top(df: DataFrame, key: str | list, order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank; the limit is pushed below the shuffle."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)


def cosine(a: Column, b: Column) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    square = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))) / F.greatest(square(a) * square(b), F.lit(1e-12))


def near_pairs(ids: list, matrix, k: int):
    """A mapInArrow function over (doc, vector): for each query (ids, rows of the matrix) the (query_id, doc, score) of a task's rows that can be
    among the best k. A matrix product decides what is looked at; the scores are summed in order, as cosine() does."""

    def run(batches):
        norm = lambda x: np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
        mine, least = norm(matrix), np.full(len(ids), -np.inf)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            order = np.unique(b.column("doc").to_numpy(zero_copy_only=False), return_inverse=True)[1]
            size = norm(v)
            for lo in range(0, len(ids), TILE):
                q = slice(lo, lo + TILE)
                rough = matrix[q] @ v.T / np.maximum(np.outer(mine[q], size), 1e-12)
                if n >= k:
                    least[q] = np.maximum(least[q], np.partition(rough, n - k, axis=1)[:, n - k])
                i, j = np.nonzero(rough >= least[q, None] - 2e-6)  # beyond rounding to 6 places
                i += lo
                for part in range(0, len(i), 1 << 16):
                    x, y = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                    score = np.cumsum(matrix[x] * v[y], axis=1)[:, -1] / np.maximum(mine[x] * size[y], 1e-12)
                    by = np.lexsort((order[y], -score, x))  # of equal scores the first k docs
                    x, y, score = x[by], y[by], score[by]
                    new = np.r_[True, (x[1:] != x[:-1]) | (score[1:] != score[:-1])]
                    at = np.arange(len(x))
                    kept = at - np.maximum.accumulate(np.where(new, at, 0)) < k
                    yield pa.RecordBatch.from_arrays([pa.array([ids[z] for z in x[kept]]), b.column("doc").take(pa.array(y[kept])), pa.array(score[kept])], names=["query_id", "doc", "score"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, most: int = 10_000) -> DataFrame:
    """(query_id, rank, doc, score) by cosine, exact: the queries are sent to all rows in blocks of about `most` vectors, split by a hash of their id.

    Pairs of which one is null, or holds a null, or differs in length have a null score and come last; rows that aren't finite are scored one by one.
    """
    fine = lambda c: F.col(c).isNotNull() & F.forall(c, lambda v: F.coalesce(F.abs(v.cast("double")) < 1e100, F.lit(False)))
    about = queries.agg(F.count("*").alias("n"), F.min(F.when(fine("query_vector") & (F.size("query_vector") > 0), F.size("query_vector"))).alias("dims")).first()
    dims = F.lit(about["dims"] or -1)
    q = queries.withColumn("_fine", F.coalesce(fine("query_vector") & (F.size("query_vector") == dims), F.lit(False)))
    v = vectors.withColumn("_fine", F.coalesce(fine("vector") & (F.size("vector") == dims), F.lit(False)))
    odd_q, odd_v = q.filter("NOT _fine").count(), v.filter("NOT _fine").count()
    types = dict(queries.dtypes) | dict(vectors.dtypes)
    schema = f"query_id {types['query_id']}, doc {types['doc']}, score double"
    blocks = max(1, -(-about["n"] // most))
    out = None
    for i in range(blocks):  # a block of a bounded size
        block = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        plain = lambda x, y: y.join(F.broadcast(x)).select("query_id", "doc", cosine(F.col("vector"), F.col("query_vector")).alias("score"))
        rows = block.filter("_fine").select("query_id", F.col("query_vector").cast("array<double>").alias("x")).collect()
        found = []
        if rows:
            sent = near_pairs([r["query_id"] for r in rows], np.array([r["x"] for r in rows], float), k)
            found.append(v.filter("_fine").select("doc", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(sent, schema))
        if odd_q or not rows:
            found.append(plain(block.filter("NOT _fine").drop("_fine"), vectors))
        if odd_v:
            found.append(plain(block.filter("_fine").drop("_fine"), v.filter("NOT _fine").drop("_fine")))
        scored = reduce(DataFrame.unionByName, found).withColumn("score", F.round("score", 6))
        hits = top(scored, "query_id", [F.desc("score"), "doc"], k)
        out = hits if out is None else out.unionByName(hits)
    return out


def with_fallback(text_hits: DataFrame, vector_hits: DataFrame, queries: DataFrame, k: int, least_hits: int = 3, least_score: float = 0.0) -> DataFrame:
    """Text hits, and for queries with too few or too weak ones the unseen vector hits behind them, k in all."""
    have = text_hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    weak = queries.select("query_id").join(have, "query_id", "left").filter((F.coalesce("n", F.lit(0)) < least_hits) | ((F.lit(least_score) > 0) & (F.coalesce("best", F.lit(0.0)) < least_score))).select("query_id", F.coalesce("n", F.lit(0)).alias("n"))
    more = vector_hits.join(weak, "query_id").join(text_hits.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
    more = more.select("query_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) + F.col("n")).cast("long").alias("rank"), "doc", "score", F.lit("vector").alias("mode"))
    return text_hits.select("query_id", "rank", "doc", "score", F.lit("text").alias("mode")).unionByName(more).filter(F.col("rank") <= k)


def fused(lists: list[DataFrame], k: int, c: int = 60, depth: int = 50) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, rank, doc): score is the sum of 1 / (c + rank)."""
    both = None
    for x in lists:
        x = x.filter(F.col("rank") <= depth).select("query_id", "doc", (1.0 / (c + F.col("rank"))).alias("s"))
        both = x if both is None else both.unionByName(x)
    return top(both.groupBy("query_id", "doc").agg(F.round(F.sum("s"), 9).alias("score")), "query_id", [F.desc("score"), "doc"], k).select("query_id", "rank", "doc", "score")


def sure_triples(triples: DataFrame, confidence_min: float, ebio_min: float) -> DataFrame:
    """Informative, sure and biomedical enough triples."""
    return triples.filter(F.col("subject_ok") & F.col("object_ok") & (F.col("confidence") >= confidence_min) & ((F.col("s_ebio") >= ebio_min) | (F.col("o_ebio") >= ebio_min)))


def filtered_triples(triples: DataFrame, confidence_min: float, ebio_min: float, k: int) -> DataFrame:
    """Informative, sure and biomedical enough triples, one of each signature (the first id), best quality first. Needs the columns
    confidence, quality, signature, subject_ok, object_ok, s_ebio, o_ebio, triple_id."""
    kept = sure_triples(triples, confidence_min, ebio_min)
    first = kept.groupBy("signature").agg(F.min_by(F.struct("triple_id", "quality"), "triple_id").alias("x")).select("signature", "x.*")
    return first.orderBy(F.desc("quality"), "triple_id").limit(k)


def variants(queries: DataFrame, synonyms: DataFrame, n: int) -> DataFrame:
    """(query_id, place, label, variant): the query itself, its terms, its terms with relation words, its synonyms; n distinct ones.

    synonyms: (term, synonym), of any size: it is joined to the queries' terms.
    """
    q = queries.select("query_id", "query", T.important_terms(F.col("query"), 10).alias("t"))
    syn = q.select("query_id", F.posexplode("t").alias("p", "term")).join(synonyms, "term").groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("p", "synonym"))).alias("s"))
    q = q.join(syn, "query_id", "left")
    words = lambda *xs: F.array_join(F.array_distinct(F.concat(*xs)), " ")
    none = F.array().cast("array<string>")
    all_ = F.array(F.struct(F.lit("original").alias("label"), T.squeeze(F.col("query")).alias("v")), F.struct(F.lit("important_terms").alias("label"), F.array_join("t", " ").alias("v")), F.struct(F.lit("synonyms").alias("label"), F.when(F.size(F.coalesce("s.synonym", none)) > 0, words("t", F.coalesce("s.synonym", none))).otherwise("").alias("v")), F.struct(F.lit("relation_probe").alias("label"), words("t", T.lits(["evidence", "relationship"])).alias("v")))
    rows = q.select("query_id", F.posexplode(all_).alias("p", "x")).select("query_id", "p", "x.label", F.substring("x.v", 1, 260).alias("variant")).filter("variant <> ''")
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", F.lower("variant")).orderBy("p"))).filter("_k = 1")
    return top(first, "query_id", ["p"], n, "place").select("query_id", "place", "label", "variant")


def level_budgets(queries: DataFrame, total: int) -> DataFrame:
    """(query_id, level, budget): a quarter for titles, a quarter for papers, the rest for sentences."""
    quarter = max(1, total // 4)
    return queries.select("query_id", F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.lit(b).cast("long").alias("budget")) for level, b in (("title", quarter), ("paper", quarter), ("sentence", max(1, total - 2 * quarter)))])).alias("x")).select("query_id", "x.*")


def alias_pattern(alias: Column) -> Column:
    """Finds the alias in a lower-cased text, not within a word; a blank stands for blanks and hyphens."""
    quoted = F.regexp_replace(F.lower(alias), r"([^\p{L}\p{N} ])", r"\\$1")
    return F.concat(F.lit("(?<![a-z0-9])"), F.replace(quoted, F.lit(" "), F.lit(r"[-\s]+")), F.lit("(?![a-z0-9])"))


def anchor_coverage(hits: DataFrame, anchors: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, n_anchors, n_matched, missing, passes): anchors of the query that the hit's text names, by themselves or by an alias, and
    those it doesn't (sorted); all but one must match, and a single one.

    hits: (query_id, doc, text); anchors: (query_id, anchor); aliases: (anchor, alias), of any size. A hit's text meets its query's patterns
    as one array, so it isn't repeated for each.
    """
    named = anchors.select("query_id", "anchor", F.col("anchor").alias("alias"))
    if aliases is not None:
        named = named.unionByName(anchors.join(aliases, "anchor").select("query_id", "anchor", "alias"))
    named = named.filter(F.trim("alias") != "").groupBy("query_id", "anchor").agg(F.collect_set(alias_pattern(F.col("alias"))).alias("p"))
    own = named.groupBy("query_id").agg(F.collect_list(F.struct("anchor", "p")).alias("_a"))
    missing = F.array_sort(F.transform(F.filter("_a", lambda a: ~F.exists(a["p"], lambda p: F.regexp_like(F.lower(F.coalesce("text", F.lit(""))), p))), lambda a: a["anchor"]))
    rows = hits.join(own, "query_id").select("query_id", "doc", F.size("_a").cast("long").alias("n_anchors"), missing.alias("missing"))
    rows = rows.select("query_id", "doc", "n_anchors", (F.col("n_anchors") - F.size("missing")).alias("n_matched"), "missing")
    return rows.withColumn("passes", F.col("n_matched") >= F.greatest(F.lit(1), F.col("n_anchors") - 1))


def feedback_terms(hits: DataFrame, queries: DataFrame, n: int, least: int = 2) -> DataFrame:
    """(query_id, rank, term, support): terms of accepted hits (query_id, doc, text) that the query lacks, by the hits that hold them."""
    rows = hits.select("query_id", "doc", F.explode(T.important_terms(F.col("text"), None)).alias("term"))
    rows = rows.groupBy("query_id", "term").agg(F.count_distinct("doc").alias("support")).filter(F.col("support") >= least)
    own = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"))
    return top(rows.join(own, ["query_id", "term"], "left_anti"), "query_id", [F.desc("support"), "term"], n).select("query_id", "rank", "term", "support")


def feedback_report(hits: DataFrame, queries: DataFrame, n: int = 8, most: int = 12, noisy: tuple = (), generic: tuple = (), broad: tuple = (), phrases: tuple = ()) -> DataFrame:
    """(query_id, kind, rank, term, support, score): up to n terms each of a query's accepted and rejected hits, the first `most` by rank.

    hits: (query_id, rank, text, structured). A hit is rejected if its text is of low value, or if the query has anchors (its terms that aren't
    generic) and the hit holds none of them, unless it is structured (a relation). Candidates are the phrases that hits hold and the first 2 n
    terms; they score 0.8 for a phrase, 0.5 for each further hit that supports them (1.5 at most), less 1.2 if generic; earlier ones go first.
    Where all anchors are broad, only anchors are accepted. A term that is accepted isn't listed as rejected.
    """
    own = queries.select("query_id", "query", F.filter(T.important_terms(F.col("query"), 96), lambda t: ~t.isin(*generic) if generic else F.lit(True)).alias("anchors"))
    rows = hits.filter((F.col("rank") <= most) & (F.trim(F.coalesce("text", F.lit(""))) != "")).join(own, "query_id")
    rows = rows.withColumn("item", T.important_terms(F.col("text"), 96))
    fits = (F.size("anchors") == 0) | F.arrays_overlap("anchors", "item") | F.coalesce("structured", F.lit(False))
    rows = rows.withColumn("kind", F.when(~T.low_value(F.col("text"), F.col("query")) & fits, "accepted").otherwise("rejected"))
    keys = ["query_id", "kind"]
    terms = rows.select(*keys, "rank", F.posexplode(F.slice("item", 1, 2 * n)).alias("pos", "term")).groupBy(*keys, "term").agg(F.min(F.struct("rank", "pos")).alias("x"))
    terms = top(terms, keys, ["x", "term"], 2 * n, "place").select(*keys, F.lit(1).alias("tier"), "place", "term", F.array("term").alias("pieces"))
    held = F.filter(T.lits(phrases), lambda w: F.contains(F.lower("text"), w))
    found = rows.select(*keys, F.explode(held).alias("term")).distinct()
    found = found.select(*keys, F.lit(0).alias("tier"), F.array_position(T.lits(phrases), F.col("term")).alias("place"), "term", T.important_terms(F.col("term"), 12).alias("pieces"))
    cand = found.unionByName(terms).filter((F.length("term") >= 3) & ~F.col("term").rlike("(ou|ly)$"))
    cand = cand.filter(~F.col("term").isin(*noisy)) if noisy else cand
    holds = rows.select(*keys, "rank", F.explode("item").alias("piece")).distinct()
    support = cand.select(*keys, "term", F.explode("pieces").alias("piece")).join(holds, [*keys, "piece"]).groupBy(*keys, "term").agg(F.count_distinct("rank").alias("support"))
    cand = cand.join(support, [*keys, "term"], "left").na.fill(0, ["support"])
    score = F.when(F.contains("term", F.lit(" ")), 0.8).otherwise(0.0) + F.least(F.lit(1.5), F.greatest(F.lit(0), F.col("support") - 1) * 0.5) - F.when(F.col("term").isin(*generic) if generic else F.lit(False), 1.2).otherwise(0.0)
    best = top(cand.withColumn("score", F.round(score, 4)), keys, [F.desc("score"), "tier", "place"], n, "_place").select(*keys, "_place", "term", "support", "score")
    vague = (F.size("anchors") > 0) & (F.size(F.array_except("anchors", T.lits(broad))) == 0)
    best = best.join(own, "query_id").filter((F.col("kind") == "rejected") | ~vague | F.array_contains("anchors", F.col("term")))
    taken = best.filter("kind = 'accepted'").select("query_id", "term", F.lit(True).alias("_taken"))
    best = best.join(taken, ["query_id", "term"], "left").filter("kind = 'accepted' OR _taken IS NULL")
    return top(best, keys, ["_place"], n).select("query_id", "kind", "rank", "term", "support", "score")


def gap_record(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, confirmed, missing, coverage): query terms found in the hits' texts or not (both sorted)."""
    own = queries.select("query_id", T.important_terms(F.col("query")).alias("t"))
    seen = hits.select("query_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term")).groupBy("query_id").agg(F.collect_set("term").alias("seen"))
    rows = own.join(seen, "query_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    confirmed, missing = F.array_sort(F.array_intersect("t", "seen")), F.array_sort(F.array_except("t", "seen"))
    return rows.select("query_id", confirmed.alias("confirmed"), missing.alias("missing"), F.round(F.size(confirmed) / F.greatest(F.lit(1), F.size("t")), 4).alias("coverage"))


def by_utility(hits: DataFrame, anchors: DataFrame, gap: DataFrame, k: int) -> DataFrame:
    """The k hits (query_id, doc, score, text) of each query of most use, with utility and rank: the score, the share of the query's anchors
    (query_id, anchor) and the share of its missing entities (gap: query_id, missing) that the text holds. Ties go to the smaller doc."""
    low = F.lower("text")
    cover = hits.join(anchors, "query_id").groupBy("query_id", "doc").agg((F.count_if(F.contains(low, F.col("anchor"))) / F.count("*")).alias("_cover"))
    rows = hits.join(cover, ["query_id", "doc"], "left").join(gap, "query_id", "left")
    closing = F.when(F.coalesce(F.size("missing"), F.lit(0)) > 0, F.size(F.filter("missing", lambda e: F.contains(low, F.lower(e)))) / F.size("missing")).otherwise(0.0)
    utility = F.lit(0.35) * F.least(F.col("score") / F.lit(10.0), F.lit(1.0)) + F.lit(0.35) * F.coalesce("_cover", F.lit(0.0)) + F.lit(0.30) * closing
    return top(rows.withColumn("utility", F.round(utility, 6)).drop("_cover", "missing"), "query_id", [F.desc("utility"), "doc"], k)


# Anchors that say too little to keep a hit by themselves.
WEAK_ANCHORS = ["synergy", "synergistic", "functional", "mechanistic", "effect", "effects"]


def off_topic(hits: DataFrame, frames: DataFrame, weak: list[str] | None = None) -> DataFrame:
    """hits (query_id, doc, text) with off_topic: the text has a phrase its query avoids and, in its whole length, none of the query's anchors (but
    for weak ones, if it has others). frames: (query_id, avoid, anchors), arrays; queries without a frame avoid nothing."""
    low = F.lower(F.coalesce("text", F.lit("")))
    long_ = F.filter(F.transform("anchors", F.lower), lambda x: F.length(x) >= 3)
    focus = F.filter(long_, lambda x: ~x.isin(weak or WEAK_ANCHORS))
    own = F.when(F.size(focus) > 0, focus).otherwise(long_)
    avoided = F.exists("avoid", lambda x: F.contains(low, x))
    rows = hits.join(frames, "query_id", "left")
    return rows.withColumn("off_topic", F.coalesce(avoided & ~F.arrays_overlap(own, T.important_terms(low, None)), F.lit(False))).drop("avoid", "anchors")


def expanded_terms(vocabulary: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, term, match, distance): words of the vocabulary (match) within 0, 1 or 2 edits of a query's term (see phrases.within_edits)."""
    asked = N.asked_terms(queries)
    return asked.join(P.within_edits(asked, vocabulary), "term").select("query_id", "term", "match", "distance")


# How much a biomedical subject or object adds to a score, fields and boosts of the fuzzy search, hits fetched for each result.
BIOMEDICAL, TRIPLE_BOOSTS, FETCHED = 2.0, {"subject": 2.0, "object": 2.0, "relation": 1.0, "sentence_text": 1.0}, 3


def fuzzy_search(queries: DataFrame, index: N.Index, triples: DataFrame, papers: DataFrame | None = None, confidence_min: float = 0.5, ebio_min: float = 0.3, k: int = 50) -> DataFrame:
    """(query_id, rank, triple_id, signature, quality, score): the best triples of each query (query_id, query) by quality, among its 3 k best by search.

    The search takes all words of the index within some edits of a query's terms (BM25, best field), keeps the articles of `papers` (article_id) if it
    is given, and adds 2 for a subject and 2 for an object that is biomedical enough. Hits that aren't informative, sure and biomedical enough go; of
    each signature the best hit stays. triples: triple_id, article_id and what filtered_triples needs.
    """
    spark = queries.sparkSession
    asked = expanded_terms(N.vocabulary(spark, index).withColumnRenamed("term", "match"), queries).select("query_id", F.col("match").alias("term")).distinct()
    facts = triples.select(F.col("triple_id").alias("doc"), "article_id", "s_ebio", "o_ebio")
    facts = facts if papers is None else facts.join(papers.select("article_id").distinct(), "article_id", "left_semi")
    enough = lambda c: F.when(F.col(c) >= ebio_min, BIOMEDICAL).otherwise(0.0)
    facts = facts.select("doc", (enough("s_ebio") + enough("o_ebio")).alias("_more"))
    adjust = lambda hits: hits.join(facts, "doc").select("query_id", "doc", F.round(F.col("score") + F.col("_more"), 6).alias("score"))
    hits = N.search(asked, index, TRIPLE_BOOSTS, FETCHED * k, adjust, 2 * BIOMEDICAL)
    rows = hits.join(triples.withColumn("doc", F.col("triple_id")), "doc")
    kept = top(sure_triples(rows, confidence_min, ebio_min), ["query_id", "signature"], ["rank"], 1, "_first")
    return top(kept.drop("rank").withColumnRenamed("_first", "_"), "query_id", [F.desc("quality"), F.desc("score"), "triple_id"], k).select("query_id", "rank", "triple_id", "signature", "quality", "score")


def attempt_quality(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n, full, partial, sources, score): how well an external search went. hits: (query_id, source, matched, anchors)."""
    full, part = F.col("matched") >= F.col("anchors"), (F.col("matched") > 0) & (F.col("matched") < F.col("anchors"))
    rows = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(full).alias("full"), F.count_if(part).alias("partial"), F.count_distinct("source").alias("sources"))
    out = queries.select("query_id").join(rows, "query_id", "left").na.fill(0, ["n", "full", "partial", "sources"])
    return out.withColumn("score", F.round(F.least(F.lit(1.0), 0.25 * F.col("full") + 0.1 * F.col("partial") + 0.05 * F.col("sources")), 4))
