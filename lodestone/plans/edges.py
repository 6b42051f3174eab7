"""Queries of sources, streams and scorers (SRC, STR, U) over rows derived from the driver's tables."""

from pyspark.sql import functions as F

from lodestone.functions import models as M
from lodestone.functions import text as T
from lodestone.operators import stored as St
from lodestone.plans import duck as D
from lodestone.plans.columns import conf
from lodestone.sources import files as S_
from lodestone.sources import views as V
from lodestone.sources.store import shared
from lodestone.streaming import jobs as J
from lodestone.streaming import observed as O

Q, S = {}, {}


def query(name, sql=None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


def as_csv_rows(spark, d):
    """Triples as the CSV's string rows, every seventh without a subject and every eleventh with a bad number."""
    t = V.triples(spark, d)
    names = dict(zip(S_.PROBS, ("s_ebio", "s_ngen", "s_otro", "o_ebio", "o_ngen", "o_otro"), strict=True))
    bad = lambda c: F.when((F.col("doc_id") + F.col("pos")) % 11 == 0, "n/a").otherwise(F.col(c).cast("string"))
    return t.select("article_id", F.concat(F.col("sentence_text"), F.lit("  ")).alias("sentence_text"), F.when((F.col("doc_id") + F.col("pos")) % 7 == 0, "").otherwise(F.col("subject")).alias("subject"), "relation", "object", *[bad(v).alias(k) for k, v in names.items()], F.col("triple_id").alias("row_id"))


CSV = f"""{D.TRIPLES}, cv AS (SELECT triple_id AS row_id, trim(regexp_replace(sentence_text, '\\s+', ' ', 'g')) AS sentence_text, CASE WHEN (doc_id + pos) % 7 = 0 THEN '' ELSE subject END AS subject, object, """ + ", ".join(f"CASE WHEN (doc_id + pos) % 11 = 0 THEN 0.0 ELSE {c} END::DOUBLE AS {c}" for c in ("s_ebio", "s_ngen", "s_otro", "o_ebio", "o_ngen", "o_otro")) + " FROM triples)"


@query("src01_permissive_rows", f"WITH {CSV} SELECT row_id, CASE WHEN subject = '' OR object = '' THEN 'missing_entity' END AS reject_reason, {D.CONFIDENCE} AS confidence FROM cv")
def src01(spark, d):
    return S_.checked(as_csv_rows(spark, d)).select("row_id", "reject_reason", "confidence")


@query("src02_thresholded_rows", f"WITH {CSV} SELECT row_id, CASE WHEN subject = '' OR object = '' OR sentence_text = '' THEN 'missing_text' WHEN s_ebio < 0.70 AND o_ebio < 0.70 THEN 'low_ebio' WHEN {D.CONFIDENCE} < 0.60 THEN 'low_confidence' END AS reject_reason FROM cv")
def src02(spark, d):
    return S_.checked(as_csv_rows(spark, d), "thresholded").select("row_id", "reject_reason")


@query("src03_graph_rows", f"WITH {CSV}, r AS (SELECT CASE WHEN subject = '' OR object = '' OR sentence_text = '' THEN 'missing_text' WHEN {D.CONFIDENCE} < 0.60 THEN 'low_confidence' END AS reason FROM cv) SELECT count(*) FILTER (reason IS NULL) AS ingested, count(*) FILTER (reason IS NOT NULL) AS rejected FROM r")
def src03(spark, d):
    return S_.counts(S_.checked(as_csv_rows(spark, d), "graph"))


@query("src08_store_scan", f"WITH {D.TRIPLES} SELECT article_id, count(*) AS n, count(DISTINCT subject) AS subjects, round(max({D.CONFIDENCE}), 4) AS best FROM triples WHERE subject <> '' AND object <> '' GROUP BY article_id")
def src08(spark, d):
    t = V.triples(spark, d).filter("subject <> '' AND object <> ''").withColumn("c", conf())
    return t.groupBy("article_id").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"), F.round(F.max("c"), 4).alias("best"))


@query("src10_csv_rows", f"WITH {D.TRIPLES} SELECT triple_id, article_id, sentence_text, subject, relation, object, s_ebio AS subject_probably_EBio, s_ngen AS subject_probably_NGen, s_otro AS subject_probably_otro, o_ebio AS object_probably_EBio, o_ngen AS object_probably_NGen, o_otro AS object_probably_otro FROM triples")
def src10(spark, d):
    names = dict(zip(S_.PROBS, ("s_ebio", "s_ngen", "s_otro", "o_ebio", "o_ngen", "o_otro"), strict=True))
    return V.triples(spark, d).select("triple_id", *S_.COLUMNS[:5], *[F.col(v).alias(k) for k, v in names.items()])


@query("src12_latest_traces", f"WITH {D.EVENTS} SELECT substr(sha256(scope || chr(10) || state_key), 1, 24) AS id, max(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY scope, state_key ORDER BY event_id DESC) AS r FROM turn_events) WHERE r = 1 GROUP BY 1")
def src12(spark, d):
    from lodestone.operators.windows import latest

    log = V.turn_events(spark, d).withColumn("id", T.stable_id(F.col("scope").cast("string"), F.col("state_key")))
    return latest(log, ["id"], [F.desc("event_id")]).select("id", "event_id")


@query("src13_linearised_triples", f"WITH {D.TRIPLES} SELECT triple_id, subject, relation, object FROM triples")
def src13(spark, d):
    t = V.triples(spark, d).select("triple_id", F.concat(F.lit("<triplet> "), "subject", F.lit(" <subj> "), "object", F.lit(" <obj> "), "relation").alias("g"))
    return S_.linearised(t, "triple_id", "g").drop("place")


@query("src15_extractor_payloads", f"WITH {D.TRIPLES} SELECT triple_id, subject, relation, object, CASE WHEN doc_id % 3 = 0 THEN s_ebio ELSE 1.0 END::DOUBLE AS confidence FROM triples")
def src15(spark, d):
    c = F.col
    one = lambda rel, *more: F.array(F.struct(c("subject").alias("subject"), c("relation").alias(rel), c("object").alias("object"), *more))
    payload = F.when(c("doc_id") % 3 == 0, F.to_json(F.struct(one("relation", c("s_ebio").alias("confidence")).alias("triples")))).when(c("doc_id") % 3 == 1, F.to_json(F.struct(one("predicate").alias("tuples")))).otherwise(F.to_json(F.struct(one("predicate").alias("triplets"))))
    return S_.extractor_payloads(V.triples(spark, d).select("triple_id", payload.alias("p")), "triple_id", "p")


@query("src16_entity_markup", f"WITH {D.TRIPLES} SELECT triple_id, 'GENE=' || subject || ';DISEASE=' || object AS ids, subject || ' and ' || object || ' here' AS text FROM triples")
def src16(spark, d):
    c = F.col
    raw = F.concat(F.lit("@GENE_"), c("subject"), F.lit(" @@@"), c("subject"), F.lit("@@@ and @DISEASE_"), c("object"), F.lit(" @@@"), c("object"), F.lit("@@@ here"))
    by, text = S_.entity_markup(raw)
    return V.triples(spark, d).select("triple_id", F.concat(F.lit("GENE="), F.array_join(by["GENE"], ","), F.lit(";DISEASE="), F.array_join(by["DISEASE"], ",")).alias("ids"), text.alias("text"))


@query("ret27_fulltext_sentences")
def ret27(spark, d):
    articles = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pmcid"), F.split("text", "\n").alias("paragraphs"))
    return S_.fulltext_sentences(articles, ["the", "and", "der", "die", "les", "que"], 2)


@query("u02_label_scores")
def u02(spark, d):
    b = V.table(spark, d, "benchmark").select("item_id", "text")
    return M.scored(b, ["text"], M.dictionary_labels({"article": ["the", "a"], "joiner": ["and"]}), "article double, joiner double")


@query("u03_entity_classes")
def u03(spark, d):
    t = V.triples(spark, d).select("triple_id", "subject")
    got = M.scored(t, ["subject"], M.dictionary_labels({"bio": ["the", "thin"], "gen": ["and", "der"]}), "bio double, gen double")
    return got.withColumn("label", F.when(F.col("bio") >= F.col("gen"), "bio").otherwise("gen"))


@query("u04_extracted_triples")
def u04(spark, d):
    s = V.sentences(spark, d).select("doc_id", "sentence")
    return M.scored(s, ["sentence"], M.pattern_triples(), "subject string, relation string, object string")


@query("ret17_repaired_terms")
def ret17(spark, d):
    terms = V.table(spark, d, "benchmark").select("item_id", F.explode(T.important_terms(F.col("text"), 8)).alias("term"))
    return M.scored(terms, ["term"], M.spelling_repair(["thering", "ertion", "inthat", "ofthe", "heering"]), "repaired string")


@query("str01_observed_turns", f"WITH {D.EVENTS} SELECT scope, count(*) AS n, round(sum(reward), 6) AS reward FROM turn_events GROUP BY scope")
def str01(spark, d):
    """A stream of the events file; each micro-batch writes its sums to a folder of its own, which the result adds up."""
    out = shared(spark)
    stream = spark.readStream.schema(V.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    stream = stream.select("event_id", F.col("user_id").alias("scope"), F.least(F.col("value") / F.lit(200.0), F.lit(1.0)).alias("reward"))

    def batch(df, n):
        df.groupBy("scope").agg(F.count("*").alias("n"), F.sum("reward").alias("reward")).write.mode("overwrite").parquet(f"{out}/rows/batch={n}")

    J.observe(stream, batch, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("scope").agg(F.sum("n").alias("n"), F.round(F.sum("reward"), 6).alias("reward"))


@query("str02_running_values")
def str02(spark, d):
    """Running values with state over a stream of the events file; the last row of each key."""
    out = shared(spark)
    raw = spark.readStream.schema(V.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    e = raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("scope"), F.col("event_type").alias("state_key"), (F.get_json_object("props", "$.k").cast("int") % 10).alias("action"), F.least(F.col("value") / F.lit(200.0), F.lit(1.0)).alias("reward"))
    values = J.running_values(e)
    q = values.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema("scope long, state_key string, action int, visits long, q_value double").parquet(f"{out}/rows")
    return rows.groupBy("scope", "state_key", "action").agg(F.max_by(F.struct("visits", "q_value"), "visits").alias("x")).select("scope", "state_key", "action", "x.*")


@query("str06_backfill", f"WITH {D.TRIPLES} SELECT triple_id, CASE WHEN pos % 3 = 0 THEN length(subject) / 100.0 ELSE s_ebio END::DOUBLE AS s_ebio FROM triples")
def str06(spark, d):
    t = V.triples(spark, d).select("triple_id", "subject", F.when(F.col("pos") % 3 != 0, F.col("s_ebio")).alias("s_ebio"))
    scored = t.filter("s_ebio IS NULL").select("subject").distinct().withColumn("s_ebio", F.length("subject") / F.lit(100.0))
    return J.backfill(t, scored, "subject", ["s_ebio"]).select("triple_id", "s_ebio")


@query("str06_restarted_backfill", f"WITH {D.TRIPLES} SELECT triple_id, CASE WHEN pos % 3 = 0 THEN length(subject) / 100.0 ELSE s_ebio END::DOUBLE AS s_ebio FROM triples")
def str06r(spark, d):
    """A run that is stopped after two parts, and one that goes on."""
    t, done = V.triples(spark, d).select("triple_id", "subject", F.when(F.col("pos") % 3 != 0, F.col("s_ebio")).alias("s_ebio")), shared(spark)
    score = lambda keys: keys.withColumn("s_ebio", F.length("subject") / F.lit(100.0))
    for most in (2, None):
        out = St.backfill_in_parts(t, "subject", ["s_ebio"], score, done, 6, most)
    return out.select("triple_id", "s_ebio")


@query("str07_sessions", f"WITH {D.EVENTS}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM turn_events WINDOW w AS (PARTITION BY scope ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY scope ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT scope, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s, count(*) AS n, round(avg(reward) + 1e-9::DOUBLE, 6) AS mean_reward FROM s GROUP BY scope, k")
def str07(spark, d):
    s = J.session_activity(V.turn_events(spark, d), "12 hours")
    return s.select("scope", F.unix_timestamp("start").alias("start_s"), (F.unix_timestamp("end") - 12 * 3600).alias("last_s"), "n", F.round(F.col("mean_reward") + F.lit(1e-9), 6).alias("mean_reward"))


@query("str07_daily_means", f"WITH {D.EVENTS} SELECT epoch(date_trunc('day', ts))::BIGINT AS day_s, state_key, count(*) AS n, round(avg(reward) + 1e-9::DOUBLE, 6) AS mean_reward FROM turn_events GROUP BY ALL")
def str07b(spark, d):
    return J.windowed_means(V.turn_events(spark, d)).select(F.unix_timestamp("start").alias("day_s"), "state_key", "n", F.round(F.col("mean_reward") + F.lit(1e-9), 6).alias("mean_reward"))


@query("str04_ranked_terms", f"WITH {D.EVENTS}, g AS (SELECT scope, action AS term, round(1 + sum(greatest(0.0::DOUBLE, u)), 6) AS alpha, round(1 + sum(greatest(0.0::DOUBLE, -u)), 6) AS beta FROM (SELECT *, reward - 0.25::DOUBLE AS u FROM turn_events WHERE reward IS NOT NULL) GROUP BY ALL HAVING count(*) >= 2) SELECT * FROM (SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY round(alpha / (alpha + beta), 6) DESC, term) AS rank, term, round(alpha / (alpha + beta), 6) AS value FROM g) WHERE rank <= 5")
def str04(spark, d):
    from lodestone.operators.graph import term_beta

    e = V.turn_events(spark, d).filter("reward IS NOT NULL")
    return J.ranked_terms(term_beta(e.select("scope", F.col("action").alias("term"), (F.col("reward") - F.lit(0.25)).alias("utility"))), 5)


#: Files that events come in, and seconds: how late a row may be, and how long a term is remembered.
N_FILES, DELAY, TTL = 5, 6 * 3600, 48 * 3600


def event_files(spark, d) -> str:
    """The events in five files by time; every thirteenth comes with the last file, late."""
    out = f"{shared(spark)}/events"
    e = V.turn_events(spark, d)
    ends = e.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b"))
    place = F.least(F.lit(N_FILES - 1), F.floor((F.unix_micros("ts") - F.col("a")) * N_FILES / (F.col("b") - F.col("a") + 1)))
    rows = e.join(F.broadcast(ends)).withColumn("file", F.when(F.col("event_id") % 13 == 0, N_FILES - 1).otherwise(place).cast("int")).drop("a", "b")  # one row
    for i in range(N_FILES):  # one after another: a stream takes files in the order of their times
        rows.filter(F.col("file") == i).drop("file").repartition(1).write.mode("append").parquet(out)
    return out


def event_stream(spark, path):
    return J.read_events(spark, path, J.EVENTS, 1).withColumn("ts", F.col("ts"))


LATE = f"""{D.EVENTS}, ev AS (SELECT *, epoch_us(ts) AS us FROM turn_events), en AS (SELECT min(us) AS a, max(us) AS b FROM ev),
fl AS (SELECT ev.*, CASE WHEN event_id % 13 = 0 THEN {N_FILES - 1} ELSE least({N_FILES - 1}, CAST(floor((us - a) * {N_FILES}::DOUBLE / (b - a + 1)) AS INT)) END AS f FROM ev, en),
mk AS (SELECT f, max(us) AS m FROM fl GROUP BY f), wm AS (SELECT x.f, (max(y.m) // 1000 - {DELAY * 1000}) * 1000 AS w FROM (SELECT DISTINCT f FROM fl) x LEFT JOIN mk y ON y.f <= x.f - 2 GROUP BY x.f),
lt AS (SELECT fl.*, w, coalesce(us <= w, false) AS late FROM fl JOIN wm USING (f))"""


@query("str03_expiring_counts", f"""WITH {LATE}, o AS (SELECT scope, state_key AS term, f, us, event_id, reward - 0.5::DOUBLE AS u, max(us) OVER p AS before FROM lt WHERE NOT late AND reward IS NOT NULL WINDOW p AS (PARTITION BY scope, state_key ORDER BY f, us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(CASE WHEN us > before + {TTL}::BIGINT * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY scope, term ORDER BY f, us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM o), h AS (SELECT *, max(k) OVER (PARTITION BY scope, term) AS last_k, max(us) OVER (PARTITION BY scope, term) AS last FROM g)
SELECT scope, term, round(1 + sum(greatest(u, 0.0)), 6) AS alpha, round(1 + sum(greatest(-u, 0.0)), 6) AS beta, count(*) AS updates, any_value(last) + {TTL}::BIGINT * 1000000 < (SELECT max(us) FROM lt) AS expired FROM h WHERE k = last_k GROUP BY scope, term""")
def str03e(spark, d):
    """Counts over a stream of several files, with late rows: the last state of each term, and whether it is past its time at the stream's end."""
    path, out = event_files(spark, d), shared(spark)
    rows = event_stream(spark, path).select("scope", F.col("state_key").alias("term"), "ts", "event_id", (F.col("reward") - 0.5).alias("utility"))
    O.run_stream(O.expiring_counts(rows, TTL, f"{DELAY} seconds"), f"{out}/rows", "update", f"{out}/checkpoint")
    seen = spark.read.schema(O.COUNTED + ", part int").parquet(f"{out}/rows")
    last = seen.groupBy("scope", "term").agg(F.max_by(F.struct("alpha", "beta", "updates", "last_us"), "part").alias("x")).select("scope", "term", "x.*")
    end = spark.read.parquet(path).agg(F.max(F.unix_micros("ts")).alias("_end"))
    return last.join(F.broadcast(end)).select("scope", "term", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "updates", (F.col("last_us") + TTL * 1_000_000 < F.col("_end")).alias("expired"))  # one row


@query("str07_late_rows", f"WITH {LATE}, dy AS (SELECT epoch(date_trunc('day', ts))::BIGINT AS day_s, state_key, reward, late, coalesce((epoch(date_trunc('day', ts))::BIGINT + 86400) * 1000000 <= w, false) AS shut FROM lt) SELECT day_s, state_key, count(*) FILTER (NOT shut) AS n, round(avg(reward) FILTER (NOT shut) + 1e-9::DOUBLE, 6) AS mean_reward, count(*) FILTER (late) AS n_late FROM dy GROUP BY ALL")
def str07l(spark, d):
    """Daily means over a stream of several files with a watermark: windows that are shut take no more rows; rows behind the watermark are counted."""
    path, out = event_files(spark, d), shared(spark)
    O.run_stream(J.windowed_means(event_stream(spark, path), late=f"{DELAY} seconds"), f"{out}/rows", "update", f"{out}/checkpoint")
    O.late_rows(event_stream(spark, path), "ts", DELAY, out, ["ts", "state_key"]).awaitTermination()
    seen = spark.read.schema("start timestamp, state_key string, n long, mean_reward double, part int").parquet(f"{out}/rows")
    days = seen.groupBy(F.unix_timestamp("start").alias("day_s"), "state_key").agg(F.max_by(F.struct("n", "mean_reward"), "part").alias("x")).select("day_s", "state_key", "x.n", F.round(F.col("x.mean_reward") + F.lit(1e-9), 6).alias("mean_reward"))
    late = spark.read.schema("ts timestamp, state_key string").parquet(f"{out}/late").groupBy(F.unix_timestamp(F.date_trunc("day", "ts")).alias("day_s"), "state_key").agg(F.count("*").alias("n_late"))
    return days.join(late, ["day_s", "state_key"], "full").na.fill(0, ["n", "n_late"]).select("day_s", "state_key", "n", "mean_reward", "n_late")


#: The texts are invented: frequent words stand in for negations. Lines of a turn are its claims.
DRIVER_NEGATORS = ["with", "was", "nicht", "pas", "por"]
OBSERVED = f"""ln AS (SELECT conv_id, turn, turn * 1000 + place - 1 AS claim_id, trim(c) AS claim FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM conversations) WHERE trim(c) <> ''),
nn AS (SELECT conv_id, turn, claim_id, {D.important('claim', 24)} AS t, {D.hits('claim', DRIVER_NEGATORS)} > 0 AS neg FROM ln),
cf AS (SELECT a.conv_id, a.turn, a.claim_id, min(b.claim_id) AS prior_id FROM nn a JOIN nn b ON a.conv_id = b.conv_id AND b.claim_id < a.claim_id AND a.neg <> b.neg WHERE len(list_intersect(a.t, b.t)) > 0 AND len(list_intersect(a.t, b.t))::DOUBLE / greatest(1, least(len(a.t), len(b.t))) >= 0.45 GROUP BY ALL),
tf AS (SELECT conv_id, turn, {D.important('text', 6)} AS t FROM conversations), fr AS (SELECT a.conv_id, a.turn, flatten(list(b.t ORDER BY b.turn DESC)) AS l FROM tf a JOIN tf b ON a.conv_id = b.conv_id AND b.turn <= a.turn GROUP BY ALL),
cn AS (SELECT conv_id, turn, count(*) AS n FROM ln GROUP BY ALL), ck AS (SELECT conv_id, turn, count(*) AS n, string_agg(claim_id || ':' || prior_id, ',' ORDER BY claim_id) AS conflicts FROM cf GROUP BY ALL)"""


@query("str01_observed_sessions", f"WITH {OBSERVED} SELECT fr.conv_id AS session_id, fr.turn, coalesce(cn.n, 0) AS n_claims, coalesce(ck.n, 0) AS n_conflicts, coalesce(conflicts, '') AS conflicts, array_to_string(list_slice({D.first_seen('l')}, 1, {O.FRAME_TERMS}), ' ') AS active, (sum(coalesce(cn.n, 0)) OVER w)::BIGINT AS total_claims, (sum(coalesce(ck.n, 0)) OVER w)::BIGINT AS total_conflicts FROM fr LEFT JOIN cn ON cn.conv_id = fr.conv_id AND cn.turn = fr.turn LEFT JOIN ck ON ck.conv_id = fr.conv_id AND ck.turn = fr.turn WINDOW w AS (PARTITION BY fr.conv_id ORDER BY fr.turn ROWS UNBOUNDED PRECEDING)")
def str01s(spark, d):
    """Turns come in three files; state carries claims, frames and totals from one to the next."""
    path, out = f"{shared(spark)}/turns", shared(spark)
    c = V.table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.timestamp_seconds(F.col("turn") * 60 + 1_700_000_000).alias("ts"), "text")
    for lo, hi in ((None, 2), (2, 4), (4, None)):  # one after another: a stream takes files in the order of their times
        c.filter((F.lit(lo is None) | (F.col("turn") >= (lo or 0))) & (F.lit(hi is None) | (F.col("turn") < (hi or 0)))).write.mode("append").parquet(path)
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((F.col("turn") * 1000 + i).alias("claim_id"), F.trim(x).alias("claim")))
    rows = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 8).parquet(path).withColumn("claims", F.filter(lines, lambda x: x["claim"] != ""))
    O.run_stream(O.observe_sessions(O.turn_rows(rows, DRIVER_NEGATORS)), f"{out}/rows", "append", f"{out}/checkpoint")
    return spark.read.schema(O.TURN).parquet(f"{out}/rows").drop("part")
