"""Streams with state, progress and restarts; stored tables that are updated; judging with targets, traps, focus and tags."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import expansion, judging, stored, windows
from lodestone.operators.folds import fold
from lodestone.operators.windows import with_states
from lodestone.streaming import jobs, observed


def test_progress_late_rows_and_counts(spark, tmp_path):
    """Three files; the last has rows that the watermark has passed. The listener sees each batch and what state dropped."""
    day = 86_400
    files = [[(1, 0), (2, 10_800)], [(3, 5 * day), (4, 5 * day + 60)], [(5, 6 * day), (6, 1800), (7, 2 * day), (8, 6 * day + 1)]]
    for rows in files:
        spark.createDataFrame([(i, t, 1, "a", 0, 0.75) for i, t in rows], "event_id long, t long, scope long, state_key string, action int, reward double").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t").select("event_id", "ts", "scope", "state_key", "action", "reward").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: jobs.read_events(spark, f"{tmp_path}/in")
    seen = observed.Progress()
    spark.streams.addListener(seen)
    try:
        rows = stream().select("scope", F.col("state_key").alias("term"), "ts", "event_id", (F.col("reward") - 0.5).alias("utility"))
        observed.run_stream(observed.expiring_counts(rows, 2 * day, "1 hour"), f"{tmp_path}/rows", "update", f"{tmp_path}/checkpoint", "counts")
        for _ in range(100):
            if sum(x[3] for x in seen.seen) >= 8:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    progress = seen.rows(spark).filter("name = 'counts'")
    assert progress.agg(F.sum("rows")).first()[0] == 8 and progress.agg(F.sum("dropped")).first()[0] >= 0
    out = spark.read.schema(observed.COUNTED + ", part int").parquet(f"{tmp_path}/rows").orderBy("part").collect()
    assert [(r["updates"], r["alpha"]) for r in out] == [(2, 1.5), (2, 1.5), (5, 2.25)]  # anew after five days; the row of the first day is late and dropped
    observed.late_rows(stream(), "ts", 3600, str(tmp_path), ["event_id"]).awaitTermination()
    late = [r["event_id"] for r in spark.read.schema("event_id long").parquet(f"{tmp_path}/late").collect()]
    assert late == [6]  # the first file's newest time less an hour is where the third batch's rows are held against


def test_a_stream_that_was_killed_goes_on(spark, tmp_path):
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []

    def batch(fail):
        def put(df, n):
            seen.append(n)
            df.write.mode("overwrite").parquet(f"{tmp_path}/out/part={n}")
            if n == fail:
                raise RuntimeError("killed")  # after the write, before the batch is done

        return put

    with pytest.raises(Exception, match="killed"):
        jobs.observe(stream(), batch(2), f"{tmp_path}/checkpoint").awaitTermination()
    jobs.observe(stream(), batch(None), f"{tmp_path}/checkpoint").awaitTermination()
    assert seen == [0, 1, 2, 2, 3]
    assert sorted(r["id"] for r in spark.read.schema("id long").parquet(f"{tmp_path}/out").collect()) == list(range(40))


def test_states_of_touched_sessions_alone_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("message", s, t, "user" if t % 2 == 0 else "assistant", 0.1 * (t % 5)) for s in range(40) for t in range(8)], "doc_type string, session_id long, turn_index int, role string, importance double")
    path, keys = f"{tmp_path}/states", ["session_id", "turn_index", "role", "memory_state"]
    stored.update_states(spark, path, rows.filter("turn_index < 4"), 3, 8)
    first = {p: set(os.listdir(p)) for p in glob.glob(f"{path}/part=*")}
    new = rows.filter("session_id = 7 AND turn_index >= 3")  # turn 3 again
    stored.update_states(spark, path, new, 3, 8)
    after = {p: set(os.listdir(p)) for p in glob.glob(f"{path}/part=*")}
    assert sum(first[p] != after[p] for p in first) == 1
    want = with_states(rows.filter("turn_index < 4 OR session_id = 7"), 3)
    assert sorted(map(tuple, spark.read.parquet(path).select(*keys).collect())) == sorted(map(tuple, want.select(*keys).collect()))
    stored.update_states(spark, path, rows.limit(0), 3, 8)
    assert spark.read.parquet(path).count() == 164


def test_ideas_add_up_in_any_order(spark, tmp_path):
    turns = spark.createDataFrame([(s, t, 0.1 * t, [f"i{(s + t) % 5}", "cell", "cell death", f"i{t}"]) for s in range(6) for t in range(6)], "session_id long, turn_index int, reward double, ideas array<string>")
    key = lambda store: sorted(map(tuple, store.read().collect()))
    whole = stored.Ideas(spark, f"{tmp_path}/a")
    whole.add(turns, 0)
    cut = stored.Ideas(spark, f"{tmp_path}/b")
    for n, where in enumerate(("turn_index >= 4", "turn_index < 2", "turn_index IN (2, 3)")):
        cut.add(turns.filter(where), n)
        cut.add(turns.filter(where), n)
        if n == 1:
            cut.compact(1)
            cut.add(turns, 0)  # is in the snapshot: passed over
    assert key(cut) == key(whole)
    cut.compact(2)
    assert key(cut) == key(whole)
    cell = next(r for r in whole.read().collect() if r["idea"] == "cell")
    assert cell["children"] == ["cell death"] and cell["frequency"] == 36 and cell["sessions"] == 6


def test_backfill_scores_each_key_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i % 9}" if i % 7 else None, None if i % 3 else 0.5) for i in range(60)], "id long, key string, p double")
    asked = []

    def score(keys):
        asked.extend(r["key"] for r in keys.collect())
        return keys.withColumn("p", F.length("key") / 10.0)

    done = f"{tmp_path}/done"
    stored.backfill_in_parts(rows, "key", ["p"], score, done, 4, 1)
    some = len(asked)
    out = stored.backfill_in_parts(rows, "key", ["p"], score, done, 4)
    assert 0 < some < 6 and sorted(asked) == [f"k{i}" for i in (1, 2, 4, 5, 7, 8)]
    more = stored.backfill_in_parts(rows.unionByName(spark.createDataFrame([(99, "new", None)], rows.schema)), "key", ["p"], score, done, 4)
    assert asked[6:] == ["new"] and more.count() == 61
    assert {(r["id"], r["p"]) for r in out.collect()} == {(i, 0.5 if i % 3 == 0 else 0.2 if i % 7 else None) for i in range(60)}


def test_sessions_in_state_equal_the_batch_operators(spark, tmp_path):
    from lodestone.operators import claims

    texts = ["alpha beta gamma", "alpha beta never gamma", "delta echo", "never delta echo alpha", "gamma beta alpha"]
    rows = [(s, t, texts[(s + t) % 5], [(t * 10 + i, texts[(s + t + i) % 5]) for i in range(2)]) for s in range(4) for t in range(6)]
    c = spark.createDataFrame(rows, "session_id long, turn long, text string, claims array<struct<claim_id:long,claim:string>>").withColumn("ts", F.timestamp_seconds(F.col("turn") * 60 + 1_700_000_000))
    for lo in (0, 2, 4):
        c.filter((F.col("turn") >= lo) & (F.col("turn") < lo + 2)).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/in")
    observed.run_stream(observed.observe_sessions(observed.turn_rows(stream, ["never"]), 4), f"{tmp_path}/out", "append", f"{tmp_path}/checkpoint")
    got = spark.read.schema(observed.TURN).parquet(f"{tmp_path}/out").collect()
    each = c.select("session_id", F.explode("claims").alias("x")).select("session_id", "x.*")
    want = {(r["session_id"], f"{r['claim_id']}:{r['prior_id']}") for r in claims.claim_conflicts(each, "session_id", ["never"]).collect()}
    assert want and {(r["session_id"], x) for r in got for x in r["conflicts"].split(",") if x} == want
    frames = {(r["session_id"], r["turn"], " ".join(r["active"])) for r in expansion.frames(c, "session_id", "turn", 4).collect()}
    assert {(r["session_id"], r["turn"], r["active"]) for r in got} == frames
    assert {r["total_claims"] for r in got if r["turn"] == 5} == {12}


def test_judging_with_targets_traps_focus_and_tags(spark):
    gold = spark.createDataFrame([(1, "alpha raises beta levels", ["alpha", "beta"], ["alpha", "beta"], ["alpha lowers beta."], "alpha", "beta"), (2, "gamma binds delta", ["gamma"], ["gamma", "delta"], [], "", "")], "gold_id long, claim string, entities array<string>, nodes array<string>, variants array<string>, subject string, object string")
    words = {"boundary": ["no evidence"], "rejects": ["is incorrect"], "drift": ["weather"], "vague": ["affects"], "overgeneral": ["always"], "off_topic": ["sports"], "observing": ["trace"]}
    turns = spark.createDataFrame([("a", [], ["beta"], [1], [("t1", "factual_inversion")], [5]), ("b", ["agent_observability"], [], [2], [("t2", "scope_drift"), ("t3", "scope_drift")], [5]), ("c", [], [], [99], [], [5, 6])], "turn string, tags array<string>, focus array<string>, targets array<long>, traps array<struct<trap_id:string,type:string>>, graphs array<long>")
    told = [("a", 1, "Alpha raises beta levels", ["alpha"]), ("a", 2, "alpha lowers beta", ["alpha"]), ("a", 3, "That alpha lowers beta is incorrect", []), ("a", 4, "It rains", []), ("a", 5, "sports today", []), ("a", 6, "beta", []), ("b", 1, "look at the trace", []), ("b", 2, "weather is fine", []), ("b", 3, "alpha raises beta levels", []), ("b", 4, "there is no evidence", []), ("c", 1, "alpha always raises beta levels", ["alpha"]), ("c", 2, "it affects things", []), ("c", 3, "gamma", ["gamma"])]
    claims = spark.createDataFrame([(*r, "") for r in told], "turn string, claim_id long, claim string, entities array<string>, predicate string")
    said = judging.judge(claims, ["turn"], turns, gold, words)
    got = {(r["turn"], r["claim_id"]): (r["rule"], r["label"], r["trap_id"], r["gold_id"]) for r in said.collect()}
    assert got["a", 1] == ("matched", "supported", None, 1) and got["a", 2] == ("wrong_variant", "contradicted", "t1", 1) and got["a", 3][:2] == ("rejected_variant", "supported")
    assert got["a", 4][0] == "none" and got["a", 5][0] == "off_focus" and got["a", 6][0] == "in_focus"
    assert got["b", 1][0] == "observing" and got["b", 2] == ("drift", "out_of_scope", "t3", None) and got["b", 3] == ("none", "unsupported", None, None) and got["b", 4][0] == "boundary"
    assert got["c", 1][:2] == ("overgeneral", "overgeneralized") and got["c", 1][3] == 1 and got["c", 2][0] == "vague"
    graphs = spark.createDataFrame([(5, "alpha"), (5, "omega"), (6, "zeta"), (6, "iota"), (6, "gamma")], "graph_id long, node string")
    gaps = [(r["turn"], r["graph_id"], r["label"], r["missing"]) for r in judging.mechanism_gaps(said, claims, ["turn"], turns, graphs).collect()]
    assert gaps == [("c", 5, "partially_supported", ["omega"])]  # a has a severe contradiction, b is about the system


@pytest.mark.parametrize("partitions", [1, 7])
def test_folds_go_on_across_partitions(spark, partitions):
    """One key with most of the rows lies in many partitions; a null key is one of its own."""
    rows = [("hot", i, (i * 37 % 101) / 100) for i in range(900)] + [(f"k{i % 30}", i, i / 50) for i in range(90)] + [(None, i, 0.5) for i in range(4)]
    df = spark.createDataFrame(rows, "key string, place long, x double").repartition(5)
    step = lambda s, r: ((s[0] + 1, (s[1] + r["x"]) % 1.0), (r["place"], s[0]))
    last = fold(df, ["key"], ["place"], lambda: (0, 0.0), step, "n long, v double", partitions=partitions)
    want, each = {}, set()
    for k, p, x in sorted(rows, key=lambda r: r[1]):
        s = want.get(k, (0, 0.0))
        each.add((k, p, s[0]))
        want[k] = (s[0] + 1, (s[1] + x) % 1.0)
    assert {r["key"]: (r["n"], r["v"]) for r in last.collect()} == want
    got = fold(df, ["key"], ["place"], lambda: (0, 0.0), step, "place long, n long", True, partitions)
    assert {tuple(r) for r in got.collect()} == each and got.count() == len(rows)
    assert fold(df.limit(0), ["key"], ["place"], lambda: (0, 0.0), step, "n long, v double").count() == 0


def test_long_keys_have_the_same_values(spark, monkeypatch):
    e = spark.createDataFrame([(i % 3, "s", 1 if i % 3 else 2, 1_000 - i // 2, i, (i * 7 % 11) / 10 if i % 10 else None) for i in range(600)], "scope long, state_key string, action int, t long, event_id long, reward double").withColumn("ts", F.timestamp_seconds("t"))
    short = sorted(map(tuple, windows.action_values(e).collect()))
    monkeypatch.setattr(windows, "ARRAY_ROWS", 100)
    assert sorted(map(tuple, windows.action_values(e.unionByName(e.filter("scope = 1 AND event_id < 60").withColumn("scope", F.lit(9)))).filter("scope < 9").collect())) == short


def test_keys_share_their_state_by_bucket(spark, tmp_path):
    """Many keys in two files: one group a bucket, and the same values as a fold of each key, null keys and rewards among them."""
    import random

    rnd = random.Random(5)
    rows = [(i, i * 3600, rnd.choice([None, *range(400)]), rnd.choice([None, "a,\"b", "c"]), rnd.choice([None, 1, 2]), rnd.choice([None, 0.1, 0.9])) for i in range(3000)]
    schema = "event_id long, t long, scope long, state_key string, action int, reward double"
    for part in (rows[:1500], rows[1500:]):
        spark.createDataFrame(part, schema).select("event_id", F.timestamp_seconds("t").alias("ts"), "scope", "state_key", "action", "reward").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = jobs.running_values(jobs.read_events(spark, f"{tmp_path}/in"))
    assert "bucket" in got._jdf.queryExecution().analyzed().toString()
    observed.run_stream(got, f"{tmp_path}/values", "update", f"{tmp_path}/c1")
    observed.run_stream(observed.expiring_counts(jobs.read_events(spark, f"{tmp_path}/in").select("scope", F.col("state_key").alias("term"), "ts", "event_id", F.col("reward").alias("utility")), 36 * 3600, "1 hour"), f"{tmp_path}/counts", "update", f"{tmp_path}/c2")
    values, counts = {}, {}
    for _, t, scope, key, action, reward in rows:
        visits, q = values.get((scope, key, action), (0, 0.0))
        values[scope, key, action] = (visits, q) if reward is None else (visits + 1, round(q + 0.25 * (reward - q), 6))
        if reward is not None:
            a, n, last = counts.get((scope, key), (1.0, 0, t))
            counts[scope, key] = (a + reward, n + 1, t) if t <= last + 36 * 3600 else (1.0 + reward, 1, t)
    seen = {}
    for r in spark.read.schema("scope long, state_key string, action int, visits long, q_value double, part int").parquet(f"{tmp_path}/values").orderBy("part").collect():
        seen[r["scope"], r["state_key"], r["action"]] = (r["visits"], r["q_value"])
    assert seen == values
    seen = {}
    for r in spark.read.schema(observed.COUNTED + ", part int").parquet(f"{tmp_path}/counts").orderBy("part").collect():
        seen[r["scope"], r["term"]] = (round(r["alpha"], 6), r["updates"], r["last_us"] // 1_000_000)
    assert seen == {k: (round(a, 6), n, t) for k, (a, n, t) in counts.items()}
