"""Readers, writers, streams and scorers on small files."""

import json

from pyspark.sql import functions as F

from lodestone.functions import models as M
from lodestone.functions import text as T
from lodestone.functions import triples as R
from lodestone.operators import claims as C
from lodestone.operators import expansion as E
from lodestone.operators import windows as W
from lodestone.sources import files as S
from lodestone.streaming import jobs as J

HEAD = ",".join(S.COLUMNS)


def csv(tmp_path):
    p = tmp_path / "t.csv"
    p.write_text(HEAD + '\nPMC1.txt,"A long\n sentence, quoted",HGF,activates,MET,0.9,0.05,0.05,0.8,0.1,0.1\n2,text,,is,b,0.9,0,0,0.9,0,0\n3,text,a,is,b,bad,0.3,,0.2,0.5,0.1\n4,,a,is,b,0.9,0,0,0.9,0,0\n')
    return str(p)


def test_csv_policies(spark, tmp_path):
    raw = S.raw_triples(spark, csv(tmp_path))
    by = {p: {r["article_id"]: r["reject_reason"] for r in S.checked(raw, p).collect()} for p in ("permissive", "thresholded", "graph")}
    assert by["permissive"] == {"PMC1.txt": None, "2": "missing_entity", "3": None, "4": None}
    assert by["thresholded"] == {"PMC1.txt": None, "2": "missing_text", "3": "low_ebio", "4": "missing_text"}
    assert by["graph"]["3"] == "low_confidence" and by["graph"]["PMC1.txt"] is None
    one = S.checked(raw).filter("article_id = 'PMC1.txt'").first()
    assert one["sentence_text"] == "A long sentence, quoted" and one["confidence"] == 0.8 and one["subject_type"] == "EBio"
    c = S.counts(S.checked(raw)).first()
    assert (c["ingested"], c["rejected"]) == (3, 1)
    S.export_triples(S.checked(raw), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, multiLine=True).columns == S.COLUMNS


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "turns.jsonl").write_text(json.dumps({"conversation_id": "c", "turn": 0, "text": "hi"}) + "\n")
    t = S.turns(spark, str(tmp_path / "turns.jsonl")).first()
    assert t["role"] == "user" and t["tags"] == []
    (tmp_path / "a.json").write_text(json.dumps({"claims": [{"claim_id": "1", "claim": "old"}, {"claim_id": "2", "claim": "two"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"claims": [{"claim_id": "1", "claim": "new"}]}))
    got = {r["claim_id"]: r["claim"] for r in S.bank(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], "claims", "claim_id:string,claim:string", "claim_id").collect()}
    assert got == {"1": "new", "2": "two"}
    (tmp_path / "p.xml").write_text("<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>One.</AbstractText><AbstractText>Two.</AbstractText></Abstract></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>x</ArticleId><ArticleId IdType='pmc'>PMC7</ArticleId></ArticleIdList></PubmedData></PubmedArticle></S>")
    r = S.pubmed(spark, str(tmp_path / "p.xml")).first()
    assert tuple(r) == ("7", "T", "One. Two.", "PMC7")
    (tmp_path / "j.xml").write_text("<r><article><front><article-meta><article-id pub-id-type='pmid'>8</article-id><article-id pub-id-type='pmc'>PMC8</article-id><title-group><article-title>J</article-title></title-group><abstract><p>Abs.</p></abstract></article-meta></front><body><sec><p>The cells were activated by growth factor signalling in these samples of lung tissue. No.</p></sec></body></article></r>")
    j = S.jats(spark, str(tmp_path / "j.xml"))
    r = j.first()
    assert r["pmid"] == "8" and r["pmcid"] == "PMC8" and r["title"] == "J" and len(r["paragraphs"]) == 1
    s = S.fulltext_sentences(j, ["growth", "lung"], 2).collect()
    assert len(s) == 1 and s[0]["score"] == 2


def test_extractor_outputs(spark, tmp_path):
    g = spark.createDataFrame([(1, "<triplet> HGF <subj> MET <obj> activates <triplet> a | b | c"), (2, None), (3, "nothing")], "id long, g string")
    assert [(r["subject"], r["relation"], r["object"]) for r in S.linearised(g, "id", "g").orderBy("place").collect()] == [("HGF", "activates", "MET"), ("a", "b", "c")]
    (tmp_path / "o.txt").write_text("SENT 3: One sentence.\nTUP 0.9: (A; is; B)\nTUP: C ; has; D; in E\nTUP 1: (x; y)\nSENT 12 : Two.\r\nTUP 2: (F (a); of; G)\r\nSENT none: Three.\nTUP 1: (h; i; j)\n")
    got = S.openie(spark, str(tmp_path / "o.txt")).orderBy("sent_id", "place").collect()
    assert [(r["sent_id"], r["subject"], r["predicate"], r["object"]) for r in got] == [(-1, "h", "i", "j"), (3, "A", "is", "B"), (3, "C", "has", "D"), (12, "F (a)", "of", "G")]
    (tmp_path / "p.txt").write_text("TUP 1: (a; b; c)\n")
    assert [tuple(r) for r in S.openie(spark, str(tmp_path / "p.txt")).drop("place").collect()] == [(-1, "a", "b", "c")]
    (tmp_path / "none.txt").write_text("")
    assert S.openie(spark, str(tmp_path / "none.txt")).count() == 0


def test_banks_turns_and_records(spark, tmp_path):
    claims = [{"claim_id": "1", "claim": "a", "required_nodes": ["x", "y"]}, {"claim_id": "2", "claim": "b", "entities": ["e"], "required_nodes": ["x"], "required_mechanism_nodes": ["m"]}, {"claim_id": "3", "claim": "c", "entities": [], "required_mechanism_nodes": ["m"]}, {"claim_id": "4", "claim": "d"}]
    (tmp_path / "g.json").write_text(json.dumps({"claims": claims}, indent=1))
    got = {r["claim_id"]: (r["entities"], r["required_mechanism_nodes"]) for r in S.gold_claims(spark, [str(tmp_path / "g.json")]).collect()}
    assert got == {"1": (["x", "y"], ["x", "y"]), "2": (["e"], ["m"]), "3": (["m"], ["m"]), "4": ([], [])}
    (tmp_path / "t.jsonl").write_text(json.dumps({"turn": 1, "text": "hi", "must_mention": ["k"]}) + "\n" + json.dumps({"turn": 0, "user_message": "u", "expected_focus_terms": []}) + "\n")
    t = S.turns(spark, str(tmp_path / "t.jsonl")).orderBy("turn").collect()
    assert [(r["user_message"], r["expected_focus_terms"]) for r in t] == [("u", []), ("hi", ["k"])]
    a = spark.createDataFrame([("7", "PMC1", "T @GENE_7157 @@@<m>p53</m>@@@", "S &lt; @DISEASE_D1 @@@x@@@ @OTHER_1", "d"), ("8", None, None, None, None), ("", "", "only", "", "")], "pmid string, pmcid string, title string, text_hl string, doi string")
    rows = S.annotated_records(a).orderBy("pmid").collect()
    assert len(rows) == 2 and rows[1]["title"] == "T p53" and rows[1]["snippet"] == "S < x @OTHER_1" and rows[1]["entities"] == {"GENE": ["7157"], "DISEASE": ["D1"]} and rows[1]["url"].endswith("/7") and rows[0]["snippet"] == "only" and rows[0]["url"] == ""
    b = spark.createDataFrame([("7", None, " a  b ", 0.5, None), (None, "PMC2", "c", None, "intro"), (None, None, "d", None, None), ("9", None, None, None, None)], "pmid string, pmcid string, text string, score double, section string")
    got = S.sentence_records(b, "litsense2", "Sentence")
    assert [(r["title"], r["snippet"], r["url"]) for r in got.orderBy("snippet").collect()] == [("LitSense Sentence | PMID 7", "a b", S.PUBMED + "7/"), ("LitSense Sentence | PMCID PMC2", "c", S.PMC + "PMC2/"), ("LitSense Sentence | NCBI result", "d", "")]
    assert S.annotated_records(a).unionByName(got).count() == 5 and set(got.columns) == set(S.EVIDENCE)


def test_graph_tables_and_scan(spark, tmp_path):
    rows = S.checked(S.raw_triples(spark, csv(tmp_path)), "graph")
    nodes, edges, triples = S.graph_tables(rows, {"EBio": 0.95, "NGen": 0.05}, {"EBio": 0.7})
    assert {r["canonical"]: r["type"] for r in nodes.collect()} == {"HGF": "generic", "MET": "biomedical"}
    assert {(r["canonical"], r["role"]) for r in edges.collect()} == {("HGF", "AS_SUBJECT_OF"), ("MET", "AS_OBJECT_OF")} and triples.first()["method"] == "csv"
    (tmp_path / "bad.csv").write_text(HEAD + "\n1,text,a,is,b,0.9,x,0,0.9,0,0\n")
    assert S.checked(S.raw_triples(spark, str(tmp_path / "bad.csv")), "graph").first()["reject_reason"] == "bad_number"
    t = spark.createDataFrame([("1", "a", "b"), ("2", "", "b"), ("3", None, "b"), ("4", "c", "d"), ("5", "", ""), ("6", "e", "f")], "triple_id string, subject string, object string")
    for most, want in ((None, (3, 3)), (2, (2, 2)), (9, (3, 3)), (1, (1, 0))):
        good, stats = S.store_scan(t, most)
        assert good.count() == want[0] and tuple(stats.first()) == want


def test_runs_logs_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(2, "2024-01-02"), (1, "2024-01-01"), (3, "2024-01-02")], "id long, created_at string")
    S.export_annotations(df, str(tmp_path / "a"))
    lines = [json.loads(x)["id"] for f in sorted((tmp_path / "a").glob("part*")) for x in f.read_text().splitlines()]
    assert lines == [1, 2, 3]
    rows = spark.createDataFrame([(1, "b", "p", "note"), (2, "a", "p", "like"), (3, "a", "q", "note")], "id long, created_at string, paper_id string, kind string")
    for i, (paper, kind, want) in enumerate(((None, None, {1, 2, 3}), ("p", None, {1, 2}), ("p", "note", {1}), (None, "x", set()))):
        S.export_annotations(rows, str(tmp_path / f"x{i}"), paper, kind)
        assert {r["id"] for r in spark.read.schema("id long").json(str(tmp_path / f"x{i}")).collect()} == want
    for n in (1, 2):
        S.write_run({"turns": df.limit(n)}, str(tmp_path / "run"), "r1")
    assert spark.read.parquet(str(tmp_path / "run/turns")).count() == 2
    for _ in range(2):
        S.append_log(df, str(tmp_path / "log"), ["id"], "tr_")
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 6 and W.latest(log, ["id"], [F.desc("created_at")]).count() == 3


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", 1, "s", i % 2, 0.5) for i in range(8)] + [(9, "2024-01-01 00:09:00", 1, "s", 0, None)]
    df = spark.createDataFrame(rows, "event_id long, ts string, scope long, state_key string, action int, reward double").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "ev"))
    out = {}
    q = J.running_values(J.read_events(spark, str(tmp_path / "ev"), files=10)).writeStream.outputMode("update").foreachBatch(lambda d, n: out.update({(r["action"]): (r["visits"], r["q_value"]) for r in d.collect()})).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {r["action"]: (r["visits"], r["q_value"]) for r in W.action_values(df).collect()}
    assert {k: v for k, v in out.items()} == batch
    terms = {}
    s = J.read_events(spark, str(tmp_path / "ev"), files=10).select("scope", F.col("state_key").alias("term"), "ts", (F.col("reward") - F.lit(0.25)).alias("utility"))
    q = J.term_counts(s).writeStream.outputMode("update").foreachBatch(lambda d, n: terms.update({r["term"]: (r["alpha"], r["updates"]) for r in d.collect()})).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert terms == {"s": (3.0, 8)}
    one = J.session_activity(df, "5 minutes").collect()
    assert len(one) == 1 and one[0]["n"] == 9
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.csv").write_text(open(csv(tmp_path)).read())
    J.ingest_files(spark, str(tmp_path / "in"), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    ranked = J.ranked_terms(spark.createDataFrame([(1, "a", 3.0, 1.0, 5), (1, "b", 1.0, 3.0, 5), (1, "c", 9.0, 1.0, 1)], "scope long, term string, alpha double, beta double, updates long"), 5)
    assert [r["term"] for r in ranked.orderBy("rank").collect()] == ["a", "b"]


def test_columns_on_odd_values(spark):
    df = spark.createDataFrame([(None,), ("",), ("Dr. Smith et al. showed it. This is 2. Mail a@b.com, token=abc123",), ("a) one\nb) two\nc) three",), ("instead of hypoxia, focus on fibroblast signalling.",)], "t string")
    t = F.col("t")
    avoid, prefer = T.correction_terms(t)
    r = df.select(T.terms(t).alias("terms"), T.tokens(t).alias("tok"), T.sentences(t).alias("s"), T.redacted(t).alias("red"), T.offers_options(t).alias("opt"), avoid.alias("av"), prefer.alias("pr"), T.sentiment(t).alias("sen"), R.informative(t).alias("inf")).collect()
    assert r[0]["terms"] == [] and r[0]["tok"] == 0 and r[1]["s"] == [] and r[0]["inf"] is False
    assert r[2]["s"][0] == "Dr. Smith et al. showed it." and "[email]" in r[2]["red"] and "[secret]" in r[2]["red"]
    assert r[3]["opt"] is True and r[2]["opt"] is False
    assert r[4]["av"] == ["hypoxia"] and "fibroblast" in r[4]["pr"]


def test_claims_and_scorers(spark):
    a = spark.createDataFrame([(1, "HGF activates MET and reduces apoptosis. Is that so? Maybe the trial showed it.")], "id long, text string")
    got = C.atomic_claims(a, ["id"], "text").orderBy("place", "part").collect()
    assert [r["claim"] for r in got] == ["HGF activates MET.", "HGF reduces apoptosis.", "Maybe the trial showed it."]
    assert got[2]["claim_type"] == "method" and got[0]["claim_type"] == "biomedical_fact"
    a = spark.createDataFrame([(1, "Thanks for asking. The TP53 gene may not predict Risk in TP53 carriers. Please see below. Aspirin appears safe [1, 2]. It was unclear; they had no data.",), (2, None), (3, "")], "id long, text string")
    got = C.atomic_claims(a, ["id"], "text").orderBy("place", "part").collect()
    assert [(r["claim"], r["claim_type"], r["speculation"], r["negation"], r["requires_citation"]) for r in got] == [("The TP53 gene may not predict Risk in TP53 carriers.", "uncertainty", "possible", True, True), ("Aspirin appears safe [1, 2].", "citation_statement", "likely", False, False), ("It was unclear.", "uncertainty", "uncertain", False, True), ("they had no data.", "other", "none", True, False)]
    assert got[0]["entities"] == ["The TP53", "Risk", "TP53", "gene"] and got[0]["relations"] == ["predict"] and got[1]["entities"] == ["Aspirin"]
    p = C.scored_pairs(spark.createDataFrame([("HGF activates MET signalling", "HGF activates MET signalling"), ("HGF never activates MET", "HGF activates MET"), ("apples", "HGF activates MET")], "p string, h string"), "p", "h").collect()
    assert [r["label"] for r in p] == ["entailment", "contradiction", "neutral"]
    rows = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string")
    out = M.scored(rows, ["t"], M.dictionary_labels({"x": ["a"]}), "x double").collect()
    assert sorted(r["x"] for r in out) == [0.0, 0.5, 0.5]
    fix = M.scored(spark.createDataFrame([("hypoxa",), ("zzz",)], "t string"), ["t"], M.spelling_repair(["hypoxia"]), "fixed string").collect()
    assert {r["fixed"] for r in fix} == {"hypoxia", "zzz"}


def test_comparability(spark):
    rows = [("Aspirin inhibits platelet aggregation", "Aspirin inhibits platelet aggregation", None, None), ("Mice with A549 tumours improved after 3 weeks", "Human MCF7 cancer did not improve at 5 weeks", "Discussion", None), (None, "", None, []), ("nothing alike", "Quite other words", None, ["Nothing"])]
    df = spark.createDataFrame(rows, "p string, h string, section string, ents array<string>")
    c = E.comparability(F.col("p"), F.col("h"), section=F.col("section"), entities=F.col("ents"))
    got = df.select(*[x.alias(k) for k, x in c.items()]).collect()
    assert got[0]["comparable"] and got[0]["score"] == 1.0 and got[0]["reasons"] == ["high_overlap"] and got[0]["blocking"] == "none"
    assert got[1]["reasons"] == ["entity_mismatch", "species_or_population_mismatch", "cell_line_mismatch", "negation_mismatch", "temporality_mismatch", "weak_section_context", "insufficient_overlap"] and got[1]["blocking"] == "entity" and got[1]["score"] == 0.0
    assert got[2]["blocking"] == "relation" and got[3]["blocking"] == "entity"


def test_jats_nested_sections(spark, tmp_path):
    meta = lambda i, title, abstract: f"<front><article-meta><article-id pub-id-type='pmid'>{i}</article-id><title-group><article-title>{title}</article-title></title-group>{abstract}</article-meta></front>"
    docs = [meta(1, "One", "<abstract><sec><title>A</title><p>first</p></sec><sec><p>second</p></sec></abstract>") + "<body><p>lead</p><sec><p>a</p><sec><p>b</p><sec><p>c</p></sec></sec></sec><sec><p>d</p></sec></body>", meta(2, "Two", "<abstract><p>plain</p></abstract>"), meta(3, "Three", ""), meta(4, "", "<abstract><p>x</p></abstract>")]
    (tmp_path / "a.xml").write_text("<articles>" + "".join(f"<article>{x}</article>" for x in docs) + "</articles>")
    got = {r["pmid"]: r for r in S.jats(spark, str(tmp_path / "a.xml")).collect()}
    assert set(got) == {"1", "2"} and got["1"]["abstract"] == "first second" and got["1"]["paragraphs"] == ["lead", "a", "b", "c", "d"] and got["2"]["paragraphs"] == []


def test_lines_keep_their_last_digits(spark, tmp_path):
    """A line's place in its text is no character to trim."""
    from lodestone.plans import roundtrips

    spark.createDataFrame([(2, "call 555-8630\n 1st of 171 \n\n2022")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert roundtrips.lines_of(spark, str(tmp_path)).first()["l"] == ["call 555-8630", "1st of 171", "2022"]
    for q in (roundtrips.src06, roundtrips.src07):
        assert q(spark, str(tmp_path)).first()["title"] == "call 555-8630"
