"""Queries of readers and writers: rows derived from the tables are written in a source's format and read with its reader (SRC, STR-5)."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans import duck as D
from lodestone.plans.edges import CSV, as_csv_rows, shared
from lodestone.sources import files as S_
from lodestone.sources import views as V
from lodestone.streaming import jobs as J

Q, S = {}, {}


def query(name, sql=None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


def type_sql(side, ebio, ngen):
    return f"CASE WHEN {side}_ebio >= {ebio} THEN 'biomedical' WHEN {side}_ngen >= {ngen} THEN 'generic' ELSE 'other' END"


GRAPH = f"{CSV}, gr AS (SELECT cv.*, t.article_id, t.relation, t.triple_id FROM cv JOIN triples t ON t.triple_id = row_id WHERE cv.subject <> '' AND cv.object <> '' AND cv.sentence_text <> '' AND least(greatest(cv.s_ebio, cv.s_ngen, cv.s_otro), greatest(cv.o_ebio, cv.o_ngen, cv.o_otro)) >= 0.60), en AS (SELECT subject AS canonical, 'AS_SUBJECT_OF' AS role, row_id, 0 AS side, {type_sql('s', 0.8, 0.5)} AS type, s_ebio AS ebio, s_ngen AS ngen, s_otro AS other FROM gr UNION ALL SELECT object, 'AS_OBJECT_OF', row_id, 1, {type_sql('o', 0.7, 0.6)}, o_ebio, o_ngen, o_otro FROM gr)"


def graph_parts(spark, d):
    rows = S_.checked(as_csv_rows(spark, d), "graph").withColumn("triple_id", F.col("row_id"))
    return S_.graph_tables(rows, {"EBio": 0.8, "NGen": 0.5}, {"EBio": 0.7, "NGen": 0.6})


@query("src03_graph_nodes", f"WITH {GRAPH} SELECT canonical, type, ebio, ngen, other FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY row_id, side) AS r FROM en) WHERE r = 1")
def src03n(spark, d):
    return graph_parts(spark, d)[0]


@query("src03_graph_edges", f"WITH {GRAPH} SELECT DISTINCT canonical, role, row_id AS triple_id FROM en")
def src03e(spark, d):
    return graph_parts(spark, d)[1]


@query("src03_graph_triples", f"WITH {GRAPH} SELECT row_id AS triple_id, subject, relation AS predicate, object, least(greatest(s_ebio, s_ngen, s_otro), greatest(o_ebio, o_ngen, o_otro)) AS confidence, 'csv' AS method FROM gr")
def src03t(spark, d):
    return graph_parts(spark, d)[2]


@query("src04_turns", f"SELECT CAST(conv_id AS VARCHAR) AS conversation_id, CAST(turn AS INT) AS turn, CASE WHEN turn % 3 = 0 THEN 'user' ELSE role END AS role, CASE WHEN turn % 2 = 0 THEN text ELSE upper(role) END AS user_message, array_to_string({D.important('text', 3)}, ' ') AS focus FROM conversations")
def src04(spark, d):
    """Turns as JSON lines: every other one without a message, every third without a role; focus terms come from what must be mentioned."""
    c, path = V.table(spark, d, "conversations"), shared(spark)
    c.select(F.col("conv_id").cast("string").alias("conversation_id"), "turn", F.when(F.col("turn") % 3 != 0, F.col("role")).alias("role"), "text", F.when(F.col("turn") % 2 != 0, F.upper("role")).alias("user_message"), T.important_terms(F.col("text"), 3).alias("must_mention")).write.json(path)
    return S_.turns(spark, path).select("conversation_id", "turn", "role", "user_message", F.array_join("expected_focus_terms", " ").alias("focus"))


@query("src05_gold_claims", f"WITH n AS (SELECT *, {D.important('text', 4)} AS nodes FROM benchmark) SELECT CAST(item_id AS VARCHAR) AS claim_id, CASE WHEN item_id % 3 = 0 THEN 'later' ELSE text END AS claim, CASE WHEN item_id % 3 <> 0 AND item_id % 2 = 0 THEN 'given' ELSE array_to_string(nodes, ' ') END AS entities, array_to_string(nodes, ' ') AS nodes FROM n")
def src05(spark, d):
    """A seed bank with entities for every other claim, and a generated one that replaces every third claim."""
    b, path = V.table(spark, d, "benchmark"), shared(spark)
    nodes = T.important_terms(F.col("text"), 4)
    claim = lambda text, entities: F.struct(F.col("item_id").cast("string").alias("claim_id"), text.alias("claim"), entities.alias("entities"), nodes.alias("required_nodes"))
    given = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("given")))
    b.select(F.array(claim(F.col("text"), given)).alias("claims")).write.json(f"{path}/seed")
    b.filter("item_id % 3 = 0").select(F.array(claim(F.lit("later"), F.array().cast("array<string>"))).alias("claims")).write.json(f"{path}/generated")
    rows = S_.gold_claims(spark, [f"{path}/seed", f"{path}/generated"], lines=True)
    return rows.select("claim_id", "claim", F.array_join("entities", " ").alias("entities"), F.array_join("required_mechanism_nodes", " ").alias("nodes"))


LINES = "ln AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)"


def lines_of(spark, d):
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")  # F.trim itself would take the place as the characters to trim
    return V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 2 == 0).alias("even"), lines.alias("l"))


@query("src06_pubmed_rows", f"WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS pmid, l[1] AS title, array_to_string(l, ' ') AS abstract, CASE WHEN doc_id % 2 = 0 THEN 'PMC' || doc_id END AS pmcid FROM ln WHERE len(l) > 0")
def src06(spark, d):
    """Documents as PubMed articles: the first line as title, all lines as the abstract's parts."""
    path = shared(spark)
    ident = lambda kind, v: F.struct(F.lit(kind).alias("_IdType"), v.alias("_VALUE"))
    ids = F.array_compact(F.array(ident("doi", F.concat(F.lit("d"), "id")), F.when(F.col("even"), ident("pmc", F.concat(F.lit("PMC"), "id")))))
    article = F.struct(F.get("l", F.lit(0)).alias("ArticleTitle"), F.struct(F.col("l").alias("AbstractText")).alias("Abstract")).alias("Article")
    rows = lines_of(spark, d).filter("size(l) > 0").select(F.struct(F.col("id").alias("PMID"), article).alias("MedlineCitation"), F.struct(F.struct(ids.alias("ArticleId")).alias("ArticleIdList")).alias("PubmedData"))
    rows.write.option("rootTag", "PubmedArticleSet").option("rowTag", "PubmedArticle").xml(path)
    return S_.pubmed(spark, path)


@query("src07_article_rows", f"WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN doc_id % 2 = 0 THEN 'PMC' || doc_id END AS pmcid, l[1] AS title, l[2] AS abstract, array_to_string(l[3:], chr(10)) AS body FROM ln WHERE len(l) >= 2")
def src07(spark, d):
    """Documents as articles: title, abstract, one paragraph of the body, the rest in a section and in a section of it."""
    path = shared(spark)
    ident = lambda kind, v: F.struct(F.lit(kind).alias("_pub-id-type"), v.alias("_VALUE"))
    ids = F.array_compact(F.array(ident("pmid", F.col("id")), F.when(F.col("even"), ident("pmc", F.concat(F.lit("PMC"), "id")))))
    part = lambda a, n: F.slice("l", a, n)
    meta = F.struct(ids.alias("article-id"), F.struct(F.get("l", F.lit(0)).alias("article-title")).alias("title-group"), F.struct(part(2, 1).alias("p")).alias("abstract"))
    body = F.struct(part(3, 1).alias("p"), F.array(F.struct(part(4, 2).alias("p"), F.array(F.struct(F.slice("l", F.lit(6), F.size("l")).alias("p"))).alias("sec"))).alias("sec"))
    rows = lines_of(spark, d).filter("size(l) >= 2").select(F.struct(meta.alias("article-meta")).alias("front"), body.alias("body"))
    rows.write.option("rootTag", "articles").option("rowTag", "article").xml(path)
    return S_.jats(spark, path).select("pmid", "pmcid", "title", "abstract", F.array_join("paragraphs", "\n").alias("body"))


@query("src08_scan_statistics", f"WITH {CSV} SELECT count(*) FILTER (subject <> '' AND object <> '') AS synced, count(*) FILTER (subject = '' OR object = '') AS skipped FROM cv")
def src08s(spark, d):
    return S_.store_scan(as_csv_rows(spark, d).withColumnRenamed("row_id", "triple_id"))[1]


@query("src09_exported_annotations", "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS paper_id, event_type AS kind, CAST(floor(epoch(ts)) AS BIGINT) AS created_s, props AS payload FROM events")
def src09(spark, d):
    path = shared(spark)
    rows = V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("paper_id"), F.col("event_type").alias("kind"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"), F.col("props").alias("payload"))
    S_.export_annotations(rows, path)
    return spark.read.schema("id long, paper_id string, kind string, created_at long, payload string").json(path).withColumnRenamed("created_at", "created_s")


@query("src11_run_artefacts", "SELECT 'turns' AS artefact, 'a' AS run_id, count(*) AS n FROM conversations UNION ALL SELECT 'turns', 'b', count(*) FILTER (role = 'user') FROM conversations UNION ALL SELECT 'answers', 'a', count(*) FILTER (role = 'assistant') FROM conversations UNION ALL SELECT 'answers', 'b', count(*) FILTER (role = 'assistant') FROM conversations")
def src11(spark, d):
    """Two runs' artefacts, the second run written twice: it replaces its own partition and leaves the first."""
    c, path = V.table(spark, d, "conversations"), shared(spark)
    answers = c.filter("role = 'assistant'")
    for turns, run in ((c, "a"), (c, "b"), (c.filter("role = 'user'"), "b")):
        S_.write_run({"turns": turns, "answers": answers}, path, run)
    read = lambda name: spark.read.parquet(f"{path}/{name}").groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count("*").alias("n")).select(F.lit(name).alias("artefact"), "run_id", "n")
    return read("turns").unionByName(read("answers"))


@query("src14_predictions", f"WITH {D.TRIPLES} SELECT doc_id AS sent_id, subject, relation AS predicate, object FROM triples")
def src14(spark, d):
    """Triples as prediction files; each third tuple without brackets, each with a pair that is passed over."""
    t, path = V.triples(spark, d), shared(spark)
    tup = F.concat_ws("; ", "subject", "relation", "object")
    block = F.concat(F.lit("SENT "), F.col("doc_id").cast("string"), F.lit(": "), "sentence_text", F.lit("\nTUP 0.9: "), F.when(F.col("pos") % 3 == 0, tup).otherwise(F.concat(F.lit("("), tup, F.lit(")"))), F.lit("\nTUP 0.1: (a; b)"))
    t.select(block.alias("value")).write.text(path)
    return S_.openie(spark, path).drop("place")


@query("src16_evidence_records", f"WITH {D.TRIPLES} SELECT triple_id, 'pubtator3' AS source, subject AS title, object AS snippet, 'https://www.ncbi.nlm.nih.gov/research/pubtator3/publication/' || doc_id AS url, 'GENE' AS kinds FROM triples WHERE pos % 2 = 0 UNION ALL SELECT triple_id, 'litsense2', CASE WHEN doc_id % 2 = 0 THEN 'LitSense Sentence | PMID ' || doc_id ELSE 'LitSense Sentence | PMCID PMC' || doc_id END, object, CASE WHEN doc_id % 2 = 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' ELSE 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || doc_id || '/' END, '' FROM triples WHERE pos % 2 = 1")
def src16r(spark, d):
    """Even lines' triples as annotated records, odd ones' as sentence records, in one schema."""
    t = V.triples(spark, d).withColumn("ident", F.col("doc_id").cast("string")).withColumn("even", F.col("doc_id") % 2 == 0)
    marked = t.filter("pos % 2 = 0").select("triple_id", F.col("ident").alias("pmid"), F.lit(None).cast("string").alias("pmcid"), F.concat(F.lit("@GENE_"), "subject", F.lit(" @@@<m>"), "subject", F.lit("</m>@@@")).alias("title"), F.concat(F.lit("@@@"), "object", F.lit("@@@  ")).alias("text_hl"), F.lit("").alias("doi"))
    plain = t.filter("pos % 2 = 1").select("triple_id", F.when(F.col("even"), F.col("ident")).alias("pmid"), F.when(~F.col("even"), F.concat(F.lit("PMC"), "ident")).alias("pmcid"), F.col("object").alias("text"), F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("section"))
    out = S_.annotated_records(marked, ("triple_id",)).unionByName(S_.sentence_records(plain, "litsense2", "Sentence", ("triple_id",)))
    return out.select("triple_id", "source", "title", "snippet", "url", F.array_join(F.map_keys(F.coalesce("entities", F.create_map().cast("map<string,array<string>>"))), ",").alias("kinds"))


@query("str05_ingested_files", f"WITH {CSV} SELECT coalesce(CASE WHEN subject = '' OR object = '' THEN 'missing_entity' END, 'ingested') AS outcome, count(*) AS n FROM cv GROUP BY ALL")
def str05(spark, d):
    """CSV files of triples ingested as a stream, a second run finding nothing new; rows of both tables by outcome."""
    path = shared(spark)
    as_csv_rows(spark, d).select(*S_.COLUMNS).write.csv(f"{path}/in", header=True, quote='"', escape='"')
    for _ in range(2):
        J.ingest_files(spark, f"{path}/in", f"{path}/good", f"{path}/bad", f"{path}/checkpoint").awaitTermination()
    schema = "reject_reason string"
    rows = spark.read.schema(schema).parquet(f"{path}/good").unionByName(spark.read.schema(schema).parquet(f"{path}/bad"))
    return rows.groupBy(F.coalesce("reject_reason", F.lit("ingested")).alias("outcome")).agg(F.count("*").alias("n"))
