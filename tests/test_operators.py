"""Operators on inputs beyond the sizes that are sent to all tasks."""

import random
import re

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import graph, replay, retrieval, windows


def test_nearest_goes_on_in_blocks(spark):
    v = [(i, [float(i % 7), float(i % 5), float(i % 3) - 1.0]) for i in range(40)]
    queries, docs = spark.createDataFrame(v, "query_id long, query_vector array<double>"), spark.createDataFrame(v, "doc long, vector array<double>")
    rows = lambda most: sorted(map(tuple, retrieval.nearest(queries, docs, 3, most).select("query_id", "rank", "doc", "score").collect()))
    assert len(rows(10_000)) == 120 and rows(15) == rows(10_000)


# --- replay of context policies, against a plain walk through each session

STOP = set(T.STOP)


def important(text, n):
    return list(dict.fromkeys(w for w in (x.lower() for x in re.findall("[A-Za-z][A-Za-z0-9_-]{2,}", text or "")) if w not in STOP))[:n]


def overlap(a, b):
    a, b = set(important(a, 80)), set(important(b, 120))
    return len(a & b) / len(a | b) if a and b else 0.0


def walk(session, budget, turns):
    """(reward, tokens, compressed) of both policies for each answered user turn of a session: rows (turn, role, text, importance)."""
    out = []
    by_turn = {r[0]: r for r in session}
    for turn, role, question, _ in session:
        answer = by_turn.get(turn + 1)
        if role != "user" or not answer or answer[1] != "assistant":
            continue
        before = [r for r in session if r[0] < turn]
        picked, used = [], 0
        for r in sorted((r for r in before if r[1] in ("user", "assistant")), reverse=True)[: 2 * turns]:
            if used + replay.estimate(r[2]) <= budget:
                picked.append((r[0], r[2]))
                used += replay.estimate(r[2])
        plans = [(picked, used, 0)]
        q = set(important(question, 12))
        ranked = []
        for r in before:
            state = "working" if r[0] >= max(0, turn - turns) else "evicted" if r[3] < 0.25 or r[1] in ("system", "tool") else "episodic"
            if state != "evicted":
                bonus = min(0.45, len(q & set(important(r[2], 14))) / max(4, len(q)) * 0.9)
                ranked.append((-round({"working": 0.65, "episodic": 0.45}[state] + 0.55 * r[3] + 0.35 / (1 + (turn - r[0]) / turns) + bonus, 4), -r[0], r[2]))
        picked, left, packed = [], budget, 0
        for _, t, text in sorted(ranked):
            short = text if replay.estimate(text) <= left else replay.shortened(text, left) if left >= 24 else ""
            if short:
                packed += short != text
                left -= replay.estimate(short)
                picked.append((-t, short))
        plans.append((picked, budget - left, packed))
        a = answer[2]
        for picked, used, packed in plans:
            texts = [t for _, t in sorted(picked)]
            support = max([overlap(a, "\n".join(texts)), *(overlap(a, t) for t in texts)])
            q40 = set(important(question, 40))
            aligned = len(q40 & set(important(a, 80)).union(*(important(t, 80) for t in texts))) / len(q40) if q40 else 0.0
            score = 0.22 * overlap(question, a) + 0.24 * support + 0.08 * aligned + 0.08 * (1 if texts else 0.25) + 0.08 - 0.05 * min(1, len(a) // 4 / budget)
            out.append((turn, score, used, packed))
    return out


def test_replay_matches_a_plain_walk(spark):
    rnd = random.Random(4)
    vocab = [f"word{i}" for i in range(60)] + ["the", "and"]
    rows = []
    for s in range(8):
        for t in range(rnd.randint(2, 14)):
            text = ". ".join(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 25))) for _ in range(rnd.randint(1, 4))) + "."
            rows.append((s, t, "message", rnd.choice(["user", "assistant"]) if t % 5 == 4 else ("user", "assistant")[t % 2] if s < 7 else "system", text, rnd.randint(0, 10) / 10))
    df = spark.createDataFrame(rows, "session_id long, turn_index int, doc_type string, role string, text string, importance double")
    for budget in (300, 90):
        got = sorted((r["session_id"], r["turn_index"], r["policy"], r["score"], r["context_tokens"], r["compressed"]) for r in replay.replayed(df, budget, 3).collect())
        want = []
        for s in range(8):
            w = walk([(t, role, text, i) for x, t, _, role, text, i in rows if x == s], budget, 3)
            want += [(s, t, ("baseline", "current")[k % 2], score, used, packed) for k, (t, score, used, packed) in enumerate(w)]
        assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in sorted(want)]
        assert all(abs(a[3] - b[3]) < 6e-5 for a, b in zip(got, sorted(want), strict=True))
        total = next(r for r in replay.replay_summary(df, budget, 3).collect() if r["session_id"] is None)
        assert total["turn_pairs"] == len(want) // 2 and abs(total["score_delta"] - (total["current_score"] - total["baseline_score"])) < 1e-4
    assert replay.replay_summary(df.limit(0), 300).filter("session_id IS NOT NULL").count() == 0


def test_shortened_fits():
    rnd = random.Random(9)
    for _ in range(300):
        text = ". ".join(" ".join("w" * rnd.randint(1, 12) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6)))
        for budget in (8, 24, 60, 500):
            assert replay.estimate(replay.shortened(text, budget)) <= budget


def test_updated_edges_replace_those_of_a_batch(spark):
    """Latest triple of an edge wins, a batch replaces stored edges of its own, the rest stays; null ends make no edge."""
    schema = "doc_id long, pos long, triple_id string, subject string, relation string, object string, article_id string, confidence double, sentence_text string"
    row = lambda d, p, i, s, r, o, t="x": (d, p, i, s, r, o, "a", 0.5, t)
    first = [row(1, 0, "t1", "a", "binds", "b"), row(1, 2, "t1", "a", "blocks", "b"), row(1, 1, "t2", "a", "binds", "b", "y" * 2000), row(2, 0, "t3", None, "r", "b"), row(2, 1, None, "a", "r", "b"), row(2, 2, "t1", "b", "r", "a")]
    edges = graph.entity_edges(spark.createDataFrame(first, schema))
    got = {(r["source"], r["target"], r["triple_id"]): (r["relation"], len(r["sentence_text"])) for r in edges.collect()}
    assert got == {("a", "b", "t1"): ("blocks", 1), ("a", "b", "t2"): ("binds", 1000), ("b", "a", "t1"): ("r", 1)}
    later = graph.updated_edges(edges, spark.createDataFrame([row(0, 0, "t1", "a", "cuts", "b"), row(0, 1, "t4", "c", "r", "d", None)], schema))
    got = {(r["source"], r["target"], r["triple_id"]): r["relation"] for r in later.collect()}
    assert got == {("a", "b", "t1"): "cuts", ("a", "b", "t2"): "binds", ("b", "a", "t1"): "r", ("c", "d", "t4"): "r"}
    assert graph.updated_edges(edges, spark.createDataFrame([], schema)).count() == 3


def test_working_set_with_bonuses(spark):
    """The question's terms lift an old row over an equal newer one; supported rows come first; null texts, importances and questions are allowed."""
    schema = "session_id long, turn_index int, doc_type string, role string, text string, importance double"
    rows = [(1, t, "message", "user", f"words number{t} of talk", 0.5) for t in range(12)] + [(1, 12, "message", "user", None, None), (2, 0, "message", "user", "alone here", 0.5)]
    rows[1] = (1, 1, "message", "user", "platelet aggregation rises", 0.5)
    m = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame([(1, "platelet aggregation"), (3, "none")], "session_id long, question string")
    kept = lambda **k: {(r["session_id"], r["turn_index"]) for r in windows.working_set(m, 14, 2, **k).collect()}
    plain, lifted = kept(), kept(questions=asked)
    assert (1, 1) not in plain and (1, 1) in lifted and (2, 0) in plain & lifted
    assert (1, 3) in kept(supported=F.coalesce(F.col("turn_index") == 3, F.lit(False)))
    assert kept(questions=asked.limit(0)) == plain


def test_nearest_is_scored_in_matrix_products(spark):
    """No product of query and row as a Spark row; the same list as all pairs, ties, copies, nulls and rows that aren't finite among them."""
    from pyspark.sql import functions as F

    rows = [(i, [float((i * 7 + d * 3) % 11 - 5) for d in range(4)]) for i in range(60)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(60, 90)] + [(90, None), (91, [1.0, None, 1.0, 1.0]), (92, [1.0]), (93, [0.0] * 4), (94, [float("nan")] * 4)]
    v = spark.createDataFrame(rows, "doc long, vector array<float>")
    q = v.filter("doc % 9 = 0 OR doc > 88").selectExpr("doc AS query_id", "vector AS query_vector")
    pairs = v.crossJoin(q).select("query_id", "doc", F.round(retrieval.cosine(F.col("vector"), F.col("query_vector")), 6).alias("score"))
    want = sorted(map(str, retrieval.top(pairs, "query_id", [F.desc("score"), "doc"], 5).select("query_id", "rank", "doc", "score").collect()))
    got = retrieval.nearest(q, v, 5)
    assert sorted(map(str, got.select("query_id", "rank", "doc", "score").collect())) == want
    plain = retrieval.nearest(q.filter("query_id < 60"), v.filter("doc < 90"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plain and "NestedLoop" not in plain
