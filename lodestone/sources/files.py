"""Readers and writers: triplet CSV under three rule sets, turns, evidence banks, article XML, extractor outputs, exports, logs."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.functions import triples as R

# The CSV's header.
COLUMNS = ["article_id", "sentence_text", "subject", "relation", "object", "subject_probably_EBio", "subject_probably_NGen", "subject_probably_otro", "object_probably_EBio", "object_probably_NGen", "object_probably_otro"]
PROBS = COLUMNS[5:]
TURN = "conversation_id string, scenario_id string, variant_index int, turn int, role string, text string, user_message string, expected_behavior string, target_gold_claims array<string>, trap_ids array<string>, must_mention array<string>, must_not_claim array<string>, scope string, tags array<string>, expected_focus_terms array<string>, correction_terms array<string>"


def raw_triples(spark: SparkSession, path: str) -> DataFrame:
    """The CSV's rows as strings; quoted fields may span lines."""
    return spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).csv(path, header=True, multiLine=True, quote='"', escape='"')


def checked(rows: DataFrame, policy: str = "permissive") -> DataFrame:
    """rows with numbers cast (bad ones are 0), text squeezed, and reject_reason (null: accepted). Policies:

    permissive: subject and object. thresholded: sentence, subject and object; one EBio of 0.70, confidence of 0.60.
    graph: sentence, subject and object; confidence of 0.60; no number that can't be read.
    """
    bad = F.exists(F.array(*PROBS), lambda x: (F.trim(x) != "") & x.try_cast("double").isNull())
    out = rows.withColumn("_bad", F.coalesce(bad, F.lit(False))).withColumns({c: T.squeeze(F.col(c)) for c in COLUMNS[:5]} | {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in PROBS})
    conf = R.confidence(tuple(F.col(c) for c in PROBS[:3]), tuple(F.col(c) for c in PROBS[3:]))
    missing = (F.col("subject") == "") | (F.col("object") == "")
    reason = F.when(missing, "missing_entity")
    if policy != "permissive":
        reason = F.when(missing | (F.col("sentence_text") == ""), "missing_text")
        if policy == "thresholded":
            reason = reason.when((F.col(PROBS[0]) < 0.70) & (F.col(PROBS[3]) < 0.70), "low_ebio")
        reason = reason.when(conf < 0.60, "low_confidence")
        if policy == "graph":
            reason = reason.when(F.col("_bad"), "bad_number")
    types = {"subject_type": R.entity_type(*[F.col(c) for c in PROBS[:3]]), "object_type": R.entity_type(*[F.col(c) for c in PROBS[3:]])}
    return out.withColumns(types | {"confidence": conf, "triple_id": T.stable_id(*[F.col(c) for c in COLUMNS[:5]]), "reject_reason": reason}).drop("_bad")


def counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("reject_reason").isNull()).alias("ingested"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))


# Types of the graph's entities, by the label that reaches its threshold.
GRAPH_TYPES = (("EBio", "biomedical"), ("NGen", "generic"))


def graph_tables(rows: DataFrame, subject: dict[str, float], object_: dict[str, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, triples) of checked rows that the graph takes; thresholds by label for subjects and for objects (0.7 where missing).

    nodes: (canonical, type, ebio, ngen, other), of rows that share a name those of the smallest triple_id, the subject's first.
    edges: (canonical, role, triple_id). triples: (triple_id, subject, predicate, object, confidence, method), one for each id.
    """
    good = rows.filter("reject_reason IS NULL")

    def end(name: str, role: str, side: int, probs: list[str], least: dict[str, float]) -> DataFrame:
        kind = F.lit("other")
        for (label, called), c in reversed(list(zip(GRAPH_TYPES, probs, strict=False))):
            kind = F.when(F.col(c) >= least.get(label, 0.7), called).otherwise(kind)
        return good.select(F.col(name).alias("canonical"), F.lit(role).alias("role"), "triple_id", F.lit(side).alias("side"), kind.alias("type"), *[F.col(c).alias(n) for c, n in zip(probs, ("ebio", "ngen", "other"), strict=True)])

    ends = end("subject", "AS_SUBJECT_OF", 0, PROBS[:3], subject).unionByName(end("object", "AS_OBJECT_OF", 1, PROBS[3:], object_))
    first = F.min(F.struct("triple_id", "side", "type", "ebio", "ngen", "other")).alias("x")
    nodes = ends.groupBy("canonical").agg(first).select("canonical", "x.type", "x.ebio", "x.ngen", "x.other")
    triples = good.groupBy("triple_id").agg(F.min(F.struct("subject", F.col("relation").alias("predicate"), "object", "confidence")).alias("x")).select("triple_id", "x.*", F.lit("csv").alias("method"))
    return nodes, ends.select("canonical", "role", "triple_id").distinct(), triples


def store_scan(triples: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with subject and object, one row of statistics: synced, skipped) of a scan by triple_id that ends at the `most`-th good row, if given."""
    good = (F.coalesce("subject", F.lit("")) != "") & (F.coalesce("object", F.lit("")) != "")
    rows = triples.filter(good)
    seen = triples
    if most is not None:
        rows = rows.orderBy("triple_id").limit(most)
        last = rows.agg(F.max("triple_id").alias("_last"), F.count("*").alias("_n"))
        seen = triples.join(F.broadcast(last), (F.col("_n") < most) | (F.col("triple_id") <= F.col("_last")))  # one row
    synced = F.count_if(good) if most is None else F.least(F.count_if(good), F.lit(most))
    return rows, seen.agg(synced.alias("synced"), F.count_if(~good).alias("skipped"))


def turns(spark: SparkSession, path: str) -> DataFrame:
    """Conversation turns from JSON lines; empty lists and roles where they are missing, the text where there is no message, and what must be
    mentioned where there are no focus terms. Order by turn where they are used."""
    rows = spark.read.schema(TURN).json(path)
    lists = [f.name for f in rows.schema if f.dataType.simpleString() == "array<string>"]
    rows = rows.withColumn("user_message", F.coalesce("user_message", "text", F.lit(""))).withColumn("expected_focus_terms", F.coalesce("expected_focus_terms", "must_mention"))
    return rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists} | {"role": F.coalesce("role", F.lit("user")), "text": F.coalesce("text", F.lit(""))})


def bank(spark: SparkSession, paths: list[str], root: str | None, schema: str, key: str, lines: bool = False) -> DataFrame:
    """Rows of JSON files, below a root key or as bare lists; of rows that share a key, the later file's.

    A file is one document (a few configuration files), or with `lines` each of its lines is one, so that large banks are read in parts."""
    out = None
    for i, path in enumerate(paths):  # a few configuration files
        kind = f"struct<{root}:array<struct<{schema}>>>" if root else f"array<struct<{schema}>>"
        df = spark.read.text(path, wholetext=not lines).select(F.from_json("value", kind).alias("v")).select(F.inline(F.col(f"v.{root}") if root else F.col("v"))).withColumn("_p", F.lit(i))
        out = df if out is None else out.unionByName(df)
    w = Window.partitionBy(key).orderBy(F.desc("_p"))
    return out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_p")


GOLD = "claim_id:string,claim:string,entities:array<string>,required_nodes:array<string>,required_mechanism_nodes:array<string>"


def gold_claims(spark: SparkSession, paths: list[str], root: str | None = "claims", lines: bool = False) -> DataFrame:
    """The bank of gold claims: mechanism nodes default to the required nodes, and entities, where there are none, to those."""
    rows = bank(spark, paths, root, GOLD, "claim_id", lines)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("required_mechanism_nodes", F.coalesce("required_mechanism_nodes", "required_nodes", none))
    empty = F.coalesce(F.size("entities"), F.lit(0)) <= 0
    wanted = F.when(F.size("required_mechanism_nodes") > 0, F.col("required_mechanism_nodes")).otherwise(F.coalesce("required_nodes", none))
    return rows.withColumn("entities", F.when(empty, wanted).otherwise(F.col("entities")))


def pubmed(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, abstract, pmcid) of PubMed article XML."""
    schema = "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
    rows = spark.read.schema(schema).option("rowTag", "PubmedArticle").xml(path)
    ids = F.filter("PubmedData.ArticleIdList.ArticleId", lambda x: x["_IdType"] == "pmc")
    return rows.select(F.col("MedlineCitation.PMID").alias("pmid"), F.col("MedlineCitation.Article.ArticleTitle").alias("title"), F.array_join("MedlineCitation.Article.Abstract.AbstractText", " ").alias("abstract"), F.get(ids, F.lit(0))["_VALUE"].alias("pmcid"))


def jats(spark: SparkSession, path: str, depth: int = 4) -> DataFrame:
    """(pmid, pmcid, title, abstract, paragraphs) of JATS article XML, for articles with a title and an abstract or a pmcid.

    Sectioned abstracts count as well as plain ones. Paragraphs are those of the body, then of its sections, down to `depth` levels; a
    section's own come before those of the sections in it.
    """
    sec = "struct<p:array<string>>"
    for _ in range(depth - 1):
        sec = f"struct<p:array<string>,sec:array<{sec}>>"
    schema = f"front struct<`article-meta`:struct<`article-id`:array<struct<`_pub-id-type`:string,_VALUE:string>>,`title-group`:struct<`article-title`:string>,abstract:struct<p:array<string>,sec:array<struct<p:array<string>>>>>>, body struct<p:array<string>,sec:array<{sec}>>"
    rows = spark.read.schema(schema).option("rowTag", "article").xml(path)
    none = F.array().cast("array<string>")
    own = lambda x: F.coalesce(x, none)

    def below(x, level: int):
        """A section's paragraphs with those of its sections."""
        if level == depth:
            return own(x["p"])
        return F.concat(own(x["p"]), F.coalesce(F.flatten(F.transform(x["sec"], lambda y: below(y, level + 1))), none))

    meta = "front.`article-meta`"
    one = lambda *kinds: F.get(F.filter(F.col(f"{meta}.`article-id`"), lambda x: x["_pub-id-type"].isin(*kinds)), F.lit(0))["_VALUE"]
    abstract = F.concat(own(F.col(f"{meta}.abstract.p")), F.coalesce(F.flatten(F.transform(F.col(f"{meta}.abstract.sec"), lambda x: own(x["p"]))), none))
    paragraphs = F.concat(own(F.col("body.p")), F.coalesce(F.flatten(F.transform(F.col("body.sec"), lambda x: below(x, 1))), none))
    out = rows.select(one("pmid").alias("pmid"), one("pmc", "pmcid").alias("pmcid"), F.trim(f"{meta}.`title-group`.`article-title`").alias("title"), F.array_join(abstract, " ").alias("abstract"), paragraphs.alias("paragraphs"))
    return out.filter("title <> '' AND (abstract <> '' OR pmcid IS NOT NULL)")


def fulltext_sentences(articles: DataFrame, query_terms: list[str], k: int) -> DataFrame:
    """(pmcid, rank, sentence, score): the k sentences of each article that share most terms with the query."""
    s = articles.select("pmcid", F.posexplode("paragraphs").alias("p", "text")).select("pmcid", "p", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    s = s.withColumn("score", T.hits(F.col("sentence"), query_terms)).filter("score > 0 AND length(sentence) BETWEEN 60 AND 900")
    w = Window.partitionBy("pmcid").orderBy(F.desc("score"), "p", "i")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("pmcid", "rank", "sentence", "score")


def linearised(generations: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, subject, relation, object) of '<triplet> s <subj> o <obj> r' texts; also 's | r | o' pieces."""
    p = generations.select(key, F.posexplode(F.split(text, r"(?i)<triplet>")).alias("place", "t"))
    full = r"(?is)^\s*(.+?)\s*<subj>\s*(.+?)\s*<obj>\s*(.+?)\s*(?:</s>)?\s*$"
    bars = r"^\s*([^|<]+?)\s*\|\s*([^|<]+?)\s*\|\s*([^|<]+?)\s*$"
    get = lambda i, j: F.coalesce(F.nullif(F.regexp_extract("t", full, i), F.lit("")), F.nullif(F.regexp_extract("t", bars, j), F.lit("")))
    return p.select(key, "place", get(1, 1).alias("subject"), get(3, 2).alias("relation"), get(2, 3).alias("object")).filter("subject IS NOT NULL AND object IS NOT NULL")


def openie(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, place, subject, predicate, object) of prediction files: lines 'SENT <n>: text', each with lines 'TUP ..: (s; p; o)' behind it.

    Files are read in blocks of one sentence, so they may be of any size. Tuples of fewer than three parts are passed over, parts beyond the third
    too; a heading without a number, or none, gives -1.
    """
    b = spark.read.text(path, lineSep="\nSENT").select(F.coalesce(F.nullif(F.regexp_extract("value", r"^(?:SENT)?\s+(\d+)(?:[\s:]|$)", 1), F.lit("")).cast("long"), F.lit(-1)).alias("sent_id"), F.posexplode(F.split("value", "\n")).alias("place", "line"))
    tup = F.trim(F.regexp_extract("line", r"^\s*TUP[^:]*:(.*?)\s*$", 1))
    tup = F.when(tup.rlike(r"^\(.*\)$"), F.substring(tup, F.lit(2), F.length(tup) - 2)).otherwise(tup)
    parts = F.transform(F.split(tup, ";"), lambda x: F.trim(x))
    return b.withColumn("x", parts).filter("size(x) >= 3").select("sent_id", "place", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(("subject", "predicate", "object"))])


def extractor_payloads(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, subject, relation, object, confidence) of JSON payloads under any of the extractors' names."""
    item = "subject:string,relation:string,predicate:string,object:string,confidence:double,score:double"
    v = F.from_json(payload, f"struct<triples:array<struct<{item}>>,tuples:array<struct<{item}>>,triplets:array<struct<{item}>>>")
    x = rows.select(key, v.alias("v")).select(key, F.inline(F.coalesce("v.triples", "v.tuples", "v.triplets")))
    return x.select(key, "subject", F.coalesce("relation", "predicate").alias("relation"), "object", F.coalesce("confidence", "score", F.lit(1.0)).alias("confidence"))


# Types of entities in annotated text, and character references in it.
MARKED = "GENE|DISEASE|CHEMICAL|VARIANT|SPECIES|CELLLINE"
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def entity_markup(c: Column) -> tuple[Column, Column]:
    """(ids by type, text without markup) of '@TYPE_ID @@@<m>entity</m>@@@' annotated text."""
    found = F.create_map(*[x for kind in MARKED.split("|") for x in (F.lit(kind), F.array_distinct(F.regexp_extract_all(c, F.lit(rf"@{kind}_(\S+)"), F.lit(1))))])
    by = F.map_filter(found, lambda _, ids: F.size(ids) > 0)
    plain = c
    for ref, char in REFERENCES.items():
        plain = F.replace(plain, F.lit(ref), F.lit(char))
    plain = F.replace(F.regexp_replace(plain, "</?m>", ""), F.lit("@@@"), F.lit(""))
    return by, T.squeeze(F.regexp_replace(plain, rf"@(?:{MARKED})_\S+", ""))


# Addresses of publications.
PUBMED, PMC, ANNOTATED = "https://pubmed.ncbi.nlm.nih.gov/", "https://pmc.ncbi.nlm.nih.gov/articles/", "https://www.ncbi.nlm.nih.gov/research/pubtator3/publication/"
EVIDENCE = ("source", "title", "snippet", "url", "pmid", "pmcid", "pmc_url", "doi", "score", "section", "entities")


def annotated_records(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Evidence rows of annotated search records (pmid, pmcid, title, text_hl, doi); those without title or snippet go."""
    z = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = F.when(z("text_hl") != "", F.col("text_hl")).otherwise(z("title"))
    entities, _ = entity_markup(F.concat_ws(" ", z("title"), raw))
    url = lambda base, c: F.when(z(c) != "", F.concat(F.lit(base), c)).otherwise("")
    out = rows.select(*keep, F.lit("pubtator3").alias("source"), entity_markup(z("title"))[1].alias("title"), entity_markup(raw)[1].alias("snippet"), url(ANNOTATED, "pmid").alias("url"), z("pmid").alias("pmid"), z("pmcid").alias("pmcid"), F.when(z("pmcid") != "", F.concat(F.lit(PMC), "pmcid", F.lit("/"))).otherwise("").alias("pmc_url"), z("doi").alias("doi"), F.lit(None).cast("double").alias("score"), F.lit("").alias("section"), entities.alias("entities"))
    return out.filter("title <> '' AND snippet <> ''")


def sentence_records(rows: DataFrame, source: str, label: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Evidence rows of sentence search records (pmid, pmcid, text, score, section), in the same schema; those without text go."""
    z = lambda c: F.coalesce(F.col(c), F.lit(""))
    of = F.when(z("pmid") != "", F.concat(F.lit("PMID "), "pmid")).when(z("pmcid") != "", F.concat(F.lit("PMCID "), "pmcid")).otherwise("NCBI result")
    pmc = F.when(z("pmcid") != "", F.concat(F.lit(PMC), "pmcid", F.lit("/"))).otherwise("")
    url = F.when(z("pmid") != "", F.concat(F.lit(PUBMED), "pmid", F.lit("/"))).otherwise(pmc)
    out = rows.select(*keep, F.lit(source).alias("source"), F.concat(F.lit(f"LitSense {label} | "), of).alias("title"), T.squeeze(z("text")).alias("snippet"), url.alias("url"), z("pmid").alias("pmid"), z("pmcid").alias("pmcid"), pmc.alias("pmc_url"), F.lit("").alias("doi"), "score", z("section").alias("section"), F.lit(None).cast("map<string,array<string>>").alias("entities"))
    return out.filter("snippet <> ''")


def export_annotations(rows: DataFrame, path: str, paper: str | None = None, kind: str | None = None) -> None:
    """NDJSON, oldest first over the files in order of their names; of one paper or kind (columns paper_id and kind), if given."""
    for c, v in (("paper_id", paper), ("kind", kind)):
        rows = rows if v is None else rows.filter(F.col(c) == v)
    rows.repartitionByRange("created_at", "id").sortWithinPartitions("created_at", "id").write.mode("overwrite").json(path)


def export_triples(triples: DataFrame, path: str) -> None:
    """The 11-column CSV."""
    triples.select(*COLUMNS).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_run(artefacts: dict[str, DataFrame], path: str, run_id: str) -> None:
    """One table an artefact, partitioned by run; a rerun replaces its own partition."""
    for name, df in artefacts.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def append_log(rows: DataFrame, path: str, parts: list[str], prefix: str) -> None:
    """Appends rows with an id hashed from `parts`; read them with windows.latest."""
    rows.withColumn("id", T.stable_id(*[F.col(p).cast("string") for p in parts], prefix=prefix)).write.mode("append").parquet(path)
