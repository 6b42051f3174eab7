"""Stored index, pruned search, approximate neighbours, phrases, edits and similar terms against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation, expansion, index, neighbours, phrases, retrieval

TERM = re.compile("[A-Za-z][A-Za-z0-9_-]{2,}")


def terms(t):
    return [w.lower() for w in TERM.findall(t or "")]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in ("an", "el", "ort", "umi") for c in ("", "s", "ing", "ed", "al")]
    pick = lambda: vocab[min(len(vocab) - 1, int(rnd.expovariate(0.06)))]
    rows = [(i, " ".join(pick() for _ in range(rnd.randint(0, 6))), " ".join(pick() for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    return [*rows, (400, None, None), (401, "", "  "), (402, rows[5][1], rows[5][2])]


def ranked(texts, queries, boosts, k):
    """By plain loops over all documents."""
    fields = {"title": 1, "body": 2}
    n, out = len(texts), []
    for qid, q in queries:
        best = {}
        for f, b in boosts.items():
            docs = {r[0]: Counter(terms(r[fields[f]])) for r in texts}
            mean = sum(sum(c.values()) for c in docs.values()) / n
            for doc, c in docs.items():
                s, hit = 0.0, False
                for t in set(terms(q)):
                    if c[t]:
                        df = sum(1 for x in docs.values() if x[t])
                        s += b * math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
                        hit = True
                if hit:
                    best[doc] = max(best.get(doc, 0.0), s)
        out += [(qid, i, doc, round(s, 6)) for i, (doc, s) in enumerate(sorted(best.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k], 1)]
    return out


@pytest.mark.parametrize("boosts", [{"title": 3.0, "body": 1.0}, {"body": 1.0}])
def test_search_matches_all_documents(spark, texts, boosts):
    docs = spark.createDataFrame(texts, "id long, title string, body string")
    written = index.write_index(docs, "id", {"title": F.col("title"), "body": F.col("body")}, block_docs=8)
    queries = [(1, texts[3][2]), (2, texts[5][1] + " bans"), (3, "nothing here"), (4, None), (5, "kumial kumial")]
    q = spark.createDataFrame(queries, "query_id long, query string")
    got = [tuple(r) for r in index.bm25(q, written, boosts, 4).orderBy("query_id", "rank").collect()]
    want = ranked(texts, queries, boosts, 4)
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True))
    assert [tuple(r) for r in index.bm25(q, index.open_index(spark, written.root), boosts, 4).orderBy("query_id", "rank").collect()] == got
    assert index.there(spark, written)
    report = {r["query_id"]: r for r in index.pruning(q, written, boosts, 4).collect()}
    assert sorted(report) == sorted({r[0] for r in got}) and all(r["postings_read"] <= r["postings"] and r["read"] <= r["blocks"] for r in report.values())
    assert report[2]["postings_read"] < report[2]["postings"]
    only = lambda hits: hits.filter("doc % 2 = 0").withColumn("score", F.col("score") + (F.col("doc") % 3) / 2)
    some = index.search(index.asked_terms(q), written, boosts, 4, only, 1.0).orderBy("query_id", "rank").collect()
    every = [(a, d, round(s + d % 3 / 2, 6)) for a, _, d, s in ranked(texts, queries, boosts, 10_000) if d % 2 == 0]
    assert [(r["query_id"], r["doc"]) for r in some] == [(a, d) for qid in (1, 2, 5) for a, d, s in sorted([x for x in every if x[0] == qid], key=lambda x: (-x[2], x[1]))[:4]]


def test_tables_of_the_index_arent_shuffled(spark, texts):
    """Above each scan of the index there is no exchange below the join that it feeds, nor below the sums of a document's scores."""
    docs = spark.createDataFrame(texts, "id long, title string, body string")
    written = index.write_index(docs, "id", {"title": F.col("title"), "body": F.col("body")}, block_docs=8)
    q = spark.createDataFrame([(i, t[2]) for i, t in enumerate(texts[:40])], "query_id long, query string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        weighted = index.durable(index.weighted_terms(spark, index.asked_terms(q), written, {"title": 2.0, "body": 1.0}))
        bounds = index.durable(index.block_bounds(spark, weighted, written, {"title": 2.0, "body": 1.0}))
        with index.as_bucketed(spark):
            plans = [df._jdf.queryExecution().sparkPlan() and df._jdf.queryExecution().executedPlan().toString() for df in (index.scored(spark, bounds.filter("place <= 3"), weighted, written), index.block_bounds(spark, weighted, written, {"title": 2.0, "body": 1.0}))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan, ends in zip(plans, ("max(s", "sum(n"), strict=True):
        lines = plan.split("\n")
        depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
        at = next(i for i, x in enumerate(lines) if "FileScan parquet spark_catalog" in x)
        assert "Bucketed: true" in lines[at]
        above, level = [], depth[at]
        for i in range(at - 1, -1, -1):
            if depth[i] < level:
                above.append(lines[i])
                level = depth[i]
        upto = next(i for i, x in enumerate(above) if ends in x or (ends == "sum(n" and "Join" in x))
        assert not any("Exchange" in x for x in above[: upto + 1]) and any("Join" in x for x in above[: upto + 1])


def test_empty_index(spark):
    none = spark.createDataFrame([], "id long, body string")
    written = index.write_index(none, "id", {"body": F.col("body")})
    q = spark.createDataFrame([(1, "some words")], "query_id long, query string")
    assert index.bm25(q, written, {"body": 1.0}, 3).count() == 0 and index.vocabulary(spark, written).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_approximate_neighbours(spark, monkeypatch, hot):
    monkeypatch.setattr(neighbours, "PART_ROWS", 50)
    rnd = random.Random(1)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [c + rnd.gauss(0, 0.5) for c in centres[0 if hot and i % 3 else i % 12]]) for i in range(1200)]
    vectors = spark.createDataFrame([*rows, (5000, None)], "doc long, vector array<double>")
    queries = vectors.filter("doc % 25 = 0 AND doc < 5000").select(F.col("doc").alias("query_id"), F.col("vector").alias("query_vector"))
    lists = neighbours.write_lists(vectors, 20)
    near = neighbours.approximate(queries, lists, 10, 500).collect()
    exact = {(r["query_id"], r["doc"]): r["score"] for r in retrieval.nearest(queries, vectors.filter("vector IS NOT NULL"), 10).collect()}
    assert len(near) == len(exact) == 480
    assert sum((r["query_id"], r["doc"]) in exact for r in near) >= 0.9 * len(exact)
    assert all(abs(exact.get((r["query_id"], r["doc"]), r["score"]) - r["score"]) < 2e-6 for r in near)
    sizes = {(r["list"], r["part"]): r["n"] for r in lists.sizes.collect()}
    assert max(sizes.values()) <= 110 and sum(sizes.values()) == 1200
    seen = defaultdict(int)
    for r in neighbours.looked_up(queries, lists, 500).collect():
        seen[r["query_id"]] += sizes[r["list"], r["part"]]
    assert max(seen.values()) < 500 + max(sizes.values())


WORDS = re.compile("[^a-z0-9-]+")


@pytest.mark.parametrize("longest", [False, True])
def test_phrases_match_all_places(spark, longest):
    rows = [(1, "The c-MET pathway; the C-Met pathway signaling"), (2, None), (3, ""), (4, "met met MET"), (5, "pathway signaling loss of p53"), (5, "loss of p53")]
    listed = ["c-met pathway", "pathway", "met", "met met", "c-met pathway signaling", "Loss of P53", "", None, "of", "a, b"]
    got = Counter(tuple(r) for r in phrases.phrase_matches(spark.createDataFrame([(*r, 0) for r in rows], "id long, text string, n int").drop("n"), ["id"], "text", spark.createDataFrame([(x,) for x in listed], "phrase string"), longest).collect())
    want = Counter()
    for i, t in rows[:4]:
        w = [x for x in WORDS.split((t or "").lower()) if x]
        every = [(s, len(p.split(" ")), p) for p in {x.lower() for x in listed if x and x.strip()} for s in range(len(w)) if w[s : s + len(p.split(" "))] == p.split(" ")]
        for s, n, p in every:
            if not longest or not any(s2 <= s and s + n <= s2 + n2 and n2 > n for s2, n2, _ in every):
                want[i, s, n, p] += 1
    assert Counter({k: v for k, v in got.items() if k[0] != 5}) == want
    assert {k[3] for k in got if k[0] == 5} >= {"loss of p53"}


@pytest.mark.parametrize("most_bytes", [1 << 20, 60])
def test_contained_pieces(spark, most_bytes):
    rnd = random.Random(2)
    pieces = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 4))) for _ in range(60)] + [None, "ZZ"]
    rows = [(i, "".join(rnd.choice("abé cZ") for _ in range(rnd.randint(0, 40)))) for i in range(50)] + [(99, None)]
    got = Counter(tuple(r) for r in phrases.contained(spark.createDataFrame(rows, "id long, text string"), ["id"], "text", spark.createDataFrame([(p,) for p in pieces], "piece string"), most_bytes).collect())
    assert got == Counter((i, p) for i, t in rows for p in {x.lower() for x in pieces if x} if t and p in t.lower())


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(last[j] + 1, d[j - 1] + 1, last[j - 1] + (x != y)))
    return d[-1]


def test_edits_match_all_pairs(spark):
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(160)}
    asked = set(list(words)[:40]) | {"zabc", "bca", "ab", "abcabcabc"}
    frame = lambda ws, c: spark.createDataFrame([(w,) for w in ws], f"{c} string")
    got = {tuple(r) for r in phrases.within_edits(frame(asked, "term"), frame(words, "match")).collect()}
    most = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    assert got == {(a, b, edits(a, b)) for a in asked for b in words if edits(a, b) <= most(a)}


@pytest.mark.parametrize("least", [0.5, 0.75])
def test_similar_terms_match_all_pairs(spark, least):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 12))) for _ in range(120)] + ["tumor growth", "tumor growths", "tumour growth", "a", "abc"]
    grams = lambda w: {w} if len(w) < 4 else {w[i : i + 4] for i in range(len(w) - 3)}
    s = {w: grams(w.lower().replace(" ", "_")) for w in words}
    got = {(r["term"], r["other"]): r["similarity"] for r in expansion.near_duplicate_terms(spark.createDataFrame([(w,) for w in words] + [(None,)], "term string"), least).collect()}
    want = {(a, b): round(len(s[a] & s[b]) / len(s[a] | s[b]), 4) for a in s for b in s if a < b and len(s[a] & s[b]) / len(s[a] | s[b]) > least}
    assert want and got == want


def test_gold_by_terms_entities_and_aliases(spark):
    claims = spark.createDataFrame([(1, "Red blues and GREENISH light"), (2, "c-met drives it"), (3, "none"), (4, None)], "id long, claim string")
    gold = spark.createDataFrame([(1, "red and blue", []), (2, "yellow with red red", ["MET signaling"]), (3, "green red blue", ["sun"])], "gold_id long, claim string, entities array<string>")
    aliases = spark.createDataFrame([("MET signaling", "c-MET"), ("MET signaling", "met pathway")], "node string, alias string")
    own = spark.createDataFrame([(3, ["SUN", "moon"])], "id long, entities array<string>")
    assert sorted(map(tuple, evaluation.best_gold(claims, ["id"], "claim", gold, own, aliases).collect())) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
    assert sorted(map(tuple, evaluation.best_gold(claims, ["id"], "claim", gold.drop("entities")).collect())) == [(1, 1, 1.0)]


def test_vocabularies_beyond_a_small_table(spark):
    """More aliases and nodes than a configuration table once could have."""
    many = spark.range(30_000)
    answers = spark.createDataFrame([(1, "name123 and name45 x"), (2, "no such thing"), (3, "NODE-7-1 with node-7-2")], "id long, text string")
    aliases = many.select(F.concat(F.lit("c"), F.col("id") % 9).alias("canonical"), F.concat(F.lit("name"), "id").alias("alias"))
    assert [(r["id"], r["entities"]) for r in evaluation.alias_entities(answers, ["id"], "text", aliases).collect()] == [(1, ["c0", "c6"])]
    graphs = many.select(F.floor(F.col("id") / 3).alias("graph_id"), F.concat(F.lit("node-"), F.floor(F.col("id") / 3), F.lit("-"), F.col("id") % 3).alias("node"))
    got = sorted(map(tuple, evaluation.best_graph(answers, ["id"], "text", graphs).collect()))
    assert got == [(1, 0, ["node-0-0", "node-0-1", "node-0-2"], 0.0), (2, 0, ["node-0-0", "node-0-1", "node-0-2"], 0.0), (3, 7, ["node-7-0"], 0.6667)]


def test_anchor_aliases_stand_as_words(spark):
    hits = spark.createDataFrame([(1, 1, "PD L1 blockade in T-cells"), (1, 2, "apd-l1x"), (1, 3, None), (2, 1, "a+b")], "query_id long, doc long, text string")
    anchors = spark.createDataFrame([(1, "checkpoint"), (1, "t cell"), (1, "immune"), (2, "a+b")], "query_id long, anchor string")
    aliases = spark.createDataFrame([("checkpoint", "pd l1"), ("t cell", "t cells")], "anchor string, alias string")
    got = {(r["query_id"], r["doc"]): (r["n_anchors"], r["n_matched"], r["missing"], r["passes"]) for r in retrieval.anchor_coverage(hits, anchors, aliases).collect()}
    assert got == {(1, 1): (3, 2, ["immune"], True), (1, 2): (3, 0, ["checkpoint", "immune", "t cell"], False), (1, 3): (3, 0, ["checkpoint", "immune", "t cell"], False), (2, 1): (1, 1, [], True)}


def test_anchors_behind_many_terms_keep_a_hit(spark):
    """A text is read to its end: an anchor behind hundreds of terms counts."""
    many = " ".join(f"word{i}" for i in range(400))
    hits = spark.createDataFrame([(1, 1, f"idiot {many} Hypoxia"), (1, 2, f"idiot {many}"), (1, 3, f"{many} hypoxia")], "query_id long, doc long, text string")
    frames = spark.createDataFrame([(1, ["idiot"], ["hypoxia"])], "query_id long, avoid array<string>, anchors array<string>")
    assert {r["doc"]: r["off_topic"] for r in retrieval.off_topic(hits, frames).collect()} == {1: False, 2: True, 3: False}


def test_promotion_gates(spark):
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "term string")
    c = spark.createDataFrame([("the", 5), ("tumor growths", 3), ("hypoxia", 2), ("matrix", 1), ("known", 4)], "term string, runs int")
    got = sorted(map(tuple, expansion.promotion_gates(c, frame(["tumor growth", "known"]), frame(["the"])).collect()))
    assert got == [("hypoxia", "promoted", None), ("known", "near_duplicate", "known"), ("matrix", "single_run", None), ("the", "stopword", None), ("tumor growths", "near_duplicate", "tumor growth")]


def test_gold_claims_dont_multiply_rows(spark):
    """Claims meet the bank in their own row (no join, one shuffle of a row a claim), in several parts of it as in one."""
    from lodestone.operators import evaluation

    gold = spark.createDataFrame([(i, f"word{i} shared{i % 3} the", [f"ent{i % 5}"]) for i in range(40)], "gold_id long, claim string, entities array<string>")
    claims = spark.createDataFrame([(j, f"a word{j} with shared{j % 3} and ENT{j % 5}", ["ent1"] if j % 2 else None, [j, 7, 99] if j % 4 == 0 else [99]) for j in range(60)] + [(60, None, None, None)], "id long, claim string, entities array<string>, targets array<long>")
    plan = evaluation.best_gold(claims, ["id"], "claim", gold)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    whole, parts = ([tuple(r) for r in evaluation.with_best_gold(claims, "claim", gold, "entities", None, "targets", n).orderBy("id").select("id", "gold_id", "match").collect()] for n in (1 << 20, 200))
    assert whole == parts and whole[60] == (60, None, None)
    for j, i, m in whole[:60]:
        rates = {}
        for g in range(40):
            kt = (f"word{g}" in f"a word{j} with") + (g % 3 == j % 3)
            ke = (g % 5 == j % 5) or (j % 2 == 1 and g % 5 == 1)
            rates[g] = max(kt / 2, float(ke))
        own = [g for g in (j, 7) if g < 40] if j % 4 == 0 else range(40)
        top = min(own, key=lambda g: (-rates[g], g))
        assert (i, m) == ((top, round(rates[top], 4)) if rates[top] > 0 else (None, None))


def test_phrases_meet_texts_where_they_are(spark):
    """A small vocabulary is sent to the texts; their word n-grams aren't shuffled."""
    from lodestone.operators import phrases

    rows = spark.createDataFrame([(1, "an old dog, an old cat")], "id long, t string")
    found = phrases.phrase_matches(rows, ["id"], "t", spark.createDataFrame([("old dog",), ("an",)], "phrase string"))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.select("start", "phrase").collect())) == [(0, "an"), (1, "old dog"), (3, "an")]


def test_bounds_are_summed_where_blocks_lie(spark, texts, monkeypatch):
    """The rows of a query and block aren't dealt anew, so they don't grow with the number of buckets; queries in several parts give the same bounds."""
    docs = spark.createDataFrame(texts, "id long, title string, body string")
    written = index.write_index(docs, "id", {"title": F.col("title"), "body": F.col("body")}, block_docs=8, bucket_docs=20)
    assert written.buckets == 21 and index.BUCKET_DOCS <= 8_000
    q, boosts = spark.createDataFrame([(i, t[2]) for i, t in enumerate(texts[:40])], "query_id long, query string"), {"title": 2.0, "body": 1.0}
    weighted = index.durable(index.weighted_terms(spark, index.asked_terms(q), written, boosts))
    with index.as_bucketed(spark):
        bounds = index.block_bounds(spark, weighted, written, boosts)
        assert not re.search(r"hashpartitioning\([^)]*block#", bounds._jdf.queryExecution().executedPlan().toString())
        whole = sorted(map(tuple, bounds.collect()))
        monkeypatch.setattr(index, "SENT_BYTES", 20_000)
        parts = sorted(map(tuple, index.block_bounds(spark, weighted, written, boosts).collect()))
    assert len(whole) == len(parts) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 and a[3] == b[3] for a, b in zip(whole, parts, strict=True))


@pytest.mark.parametrize("sizes", [(1 << 18, 1 << 21, 1 << 20), (60, 40, 7)])
def test_hits_are_added_up_in_their_block(spark, texts, monkeypatch, sizes):
    """Pairs of query and posting aren't rows and nothing of the index is dealt anew; in parts as in one, of many equal documents the first ones stay."""
    for name, x in zip(("SENT_PAIRS", "CELLS", "AT_ONCE"), sizes, strict=True):
        monkeypatch.setattr(index, name, x)
    texts = [*texts, *[(i, texts[7][1], texts[7][2]) for i in range(500, 540)]]
    docs = spark.createDataFrame(texts, "id long, title string, body string")
    written = index.write_index(docs, "id", {"title": F.col("title"), "body": F.col("body")}, block_docs=64, bucket_docs=128)
    queries, boosts = [(i, texts[i][2]) for i in range(3, 9)], {"title": 2.0, "body": 1.0}
    asked = index.asked_terms(spark.createDataFrame(queries, "query_id long, query string")).localCheckpoint()
    with index.as_bucketed(spark):
        hits = index.all_hits(spark, asked, written, boosts, 4)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "hashpartitioning(block" not in plan
        count = hits.count()
    if sizes[0] > 1000:
        assert count <= len(queries) * 7 * 3 * 4  # a few for each query and block
    got = [tuple(r) for r in index.search(asked, written, boosts, 4).orderBy("query_id", "rank").collect()]
    want = ranked(texts, queries, boosts, 4)
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True))
    more = lambda hits: hits.filter("doc % 3 > 0").withColumn("score", F.col("score") + (F.col("doc") % 5) / 4)
    some = [(r["query_id"], r["doc"]) for r in index.search(asked, written, boosts, 4, more, 1.0).orderBy("query_id", "rank").collect()]
    every = sorted((a, -round(s + d % 5 / 4, 6), d) for a, _, d, s in ranked(texts, queries, boosts, 10_000) if d % 3 > 0)
    assert some == [(a, d) for qid, _ in queries for a, _, d in [x for x in every if x[0] == qid][:4]]
