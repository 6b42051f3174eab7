"""Judging claims of turns against gold claims, traps, focus and tags; gaps in mechanism graphs; failures, trap outcomes and diagnoses.

Rules are a list in order, and a claim takes the first that holds. What a rule looks for in the text comes as a vocabulary, so a domain brings
its own phrases.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluation as E
from lodestone.operators import phrases as P

# Shares of a gold claim that count as support, partial support and a fragment; tags of turns that are about the system itself; error types.
SUPPORTED, PARTIAL, FRAGMENT = 0.75, 0.55, 0.20
SELF_TAGS = ["agent_observability", "diagnosis", "evaluator_fixture", "reward_observability"]
REWARD_TOO_HIGH = 0.25


@dataclass(frozen=True)
class Rule:
    """Where `when` holds, a claim gets the label, the severity and, for an error, the trap of the first type listed that its turn has."""

    name: str
    when: Column
    label: Column | str
    severity: int = 0
    error: Column | str | None = None
    traps: tuple[str, ...] = ()


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


def trap_of(types: tuple[str, ...]) -> Column:
    """The id of the turn's trap of the first of these types that it has; of several of a type, the last."""
    last = lambda ty: F.try_element_at(F.transform(F.filter("traps", lambda t: t["type"] == ty), lambda t: t["trap_id"]), F.lit(-1))
    return F.coalesce(*[last(ty) for ty in types]) if types else F.lit(None).cast("string")


def in_focus(low: Column) -> Column:
    """Whether the text has a focus term, as it is or with blanks for hyphens, or both of its first two words of more than two letters."""
    plain = F.replace(low, F.lit("-"), F.lit(" "))

    def held(term: Column) -> Column:
        loose = F.replace(F.lower(term), F.lit("-"), F.lit(" "))
        words = F.slice(F.filter(F.split(loose, " "), lambda w: F.length(w) > 2), 1, 2)
        return F.contains(low, F.lower(term)) | F.contains(low, loose) | ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(plain, w)))

    return F.exists("focus", held)


def rules(vocabulary: dict[str, list[str]]) -> list[Rule]:
    """The rules over rows with claim, entities, predicate, tags, focus, traps, match, variants, nodes, subject and object of the best gold claim.

    vocabulary: phrases by use: observing, scope_kept, boundary, cites, agrees, rejects, excused, off_topic, drift, edges and source_domain,
    target_domain, proof, hedges for transfers; words under overgeneral, vague, reversed.
    """
    low = F.lower("claim")
    plain = F.regexp_replace(low, r"[*_]", "")
    phrase = lambda k, c=None: T.contains_any(low if c is None else c, vocabulary.get(k) or ["\u0000"])
    word = lambda k: F.arrays_overlap(F.split(low, r"\s+"), T.lits(vocabulary.get(k) or ["\u0000"]))
    tagged = lambda *ts: F.arrays_overlap("tags", T.lits(ts))
    gold = F.col("gold_id").isNotNull()
    trapped = lambda ty: F.exists("traps", lambda t: t["type"] == ty)

    turned = F.coalesce((F.col("subject") != "") & (F.col("object") != "") & F.contains(low, F.lower("subject")) & F.contains(low, F.lower("object")), F.lit(False)) & word("reversed")
    mentions = gold & (F.exists("variants", lambda v: F.contains(low, F.regexp_replace(F.lower(v), r"\.+$", ""))) | turned)
    rejects = mentions & ~phrase("agrees", plain) & phrase("rejects", plain)
    transfer = phrase("source_domain") & phrase("target_domain") & phrase("proof") & ~phrase("hedges", plain)
    boundary, overgeneral = phrase("boundary"), word("overgeneral")
    n_nodes = F.size(F.filter("nodes", lambda n: F.exists(n, lambda p: F.contains(low, F.lower(p)))))
    related = F.coalesce(F.col("predicate") != "", F.lit(False))
    fragment = gold & ~mentions & ~overgeneral & ((F.size("entities") > 0) | related) & ((n_nodes >= 2) | ((n_nodes >= 1) & (related | phrase("edges")) & (F.col("match") >= FRAGMENT)))
    focused, has_focus = in_focus(low), F.size("focus") > 0
    inversion = F.when(trapped("mechanistic_contradiction"), "mechanistic_contradiction").otherwise("factual_inversion")
    partly = lambda at: F.when(F.col("match") >= at, "supported").otherwise("partially_supported")
    return [
        Rule("observing", tagged("agent_observability", "reward_observability", "diagnosis") & phrase("observing"), "supported"),
        Rule("scope_kept", tagged("scope_correction", "memory_correction") & phrase("scope_kept"), "supported"),
        Rule("assembly_boundary", tagged("evidence_assembly") & boundary, "supported"),
        Rule("transfer", transfer, "unsupported", 4, "cross_domain_transfer", ("cross_domain_transfer", "user_false_premise", "scope_drift", "generated_trap")),
        Rule("cites", phrase("cites"), "supported"),
        Rule("wrong_variant", mentions & ~rejects & ~phrase("excused"), "contradicted", 5, inversion, ("mechanistic_contradiction", "factual_inversion", "user_false_premise", "generated_trap")),
        Rule("rejected_variant", rejects, partly(PARTIAL)),
        Rule("overgeneral", gold & (F.col("match") >= PARTIAL) & overgeneral, "overgeneralized", 2, "overgeneralization"),
        Rule("matched", gold & (F.col("match") >= PARTIAL), partly(SUPPORTED)),
        Rule("fragment", fragment, "partially_supported"),
        Rule("boundary", boundary, "supported"),
        Rule("in_focus", has_focus & focused & (F.col("match") < PARTIAL) & (F.size("entities") == 0), "supported"),
        Rule("drift", trapped("scope_drift") & phrase("drift"), "out_of_scope", 3, "scope_drift", ("scope_drift",)),
        Rule("vague", (F.size("entities") <= 1) & word("vague"), "too_vague", 2, "vague_supported_answer"),
        Rule("off_focus", has_focus & ~focused & phrase("off_topic"), "out_of_scope", 3, "scope_drift", ("scope_drift",)),
        Rule("none", F.lit(True), "unsupported", 3, "unsupported_plausible_mechanism"),
    ]


def judge(claims: DataFrame, turn: list[str], turns: DataFrame, gold: DataFrame, vocabulary: dict[str, list[str]], aliases: DataFrame | None = None) -> DataFrame:
    """turn, claim_id, rule, label, severity, error_type, trap_id, gold_id, match of each claim.

    claims: turn, claim_id, claim, entities, predicate. turns: turn, tags, focus, targets (gold ids) and traps (trap_id, type) as arrays. gold: gold_id, claim,
    entities, nodes, variants as arrays, subject, object. aliases: (node, alias). A turn whose targets are in the bank is judged by them alone.
    """
    key = [*turn, "claim_id"]
    none = F.array().cast("array<string>")
    nodes = E.pieces_of(gold.select("gold_id", F.explode("nodes").alias("node")), "node", aliases).groupBy("gold_id", "node").agg(F.collect_set("piece").alias("p")).groupBy("gold_id").agg(F.collect_list("p").alias("nodes"))
    known = gold.select("gold_id", "variants", "subject", "object").join(nodes, "gold_id", "left")
    rows = claims.join(turns.select(*turn, "tags", "focus", "traps", "targets"), turn, "left")
    rows = E.with_best_gold(rows, "claim", gold, "entities", aliases, "targets").join(P.small(known), "gold_id", "left")
    rows = rows.withColumns({"match": F.coalesce("match", F.lit(0.0)), "entities": F.coalesce("entities", none), "tags": F.coalesce("tags", none), "focus": F.coalesce("focus", none), "variants": F.coalesce("variants", none), "nodes": F.coalesce("nodes", F.array().cast("array<array<string>>")), "traps": F.coalesce("traps", F.array().cast("array<struct<trap_id:string,type:string>>"))})
    out = None
    for r in reversed(rules(vocabulary)):
        verdict = F.struct(F.lit(r.name).alias("rule"), as_column(r.label).alias("label"), F.lit(r.severity).alias("severity"), as_column(r.error).alias("error_type"), trap_of(r.traps).alias("trap_id"))
        out = verdict if out is None else F.when(F.coalesce(r.when, F.lit(False)), verdict).otherwise(out)
    return rows.withColumn("_v", out).select(*key, "_v.*", "gold_id", "match")


def mechanism_gaps(judged: DataFrame, claims: DataFrame, turn: list[str], turns: DataFrame, graphs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """turn, graph_id, label, severity, error_type, trap_id, missing: a row for each turn whose claims leave out nodes of the best of its graphs.

    turns: turn, tags, traps, graphs (ids). Turns without entities, with a severe contradiction or scope drift, about the system itself, with citation
    guidance, with boundaries alone or with a rejected false premise are passed over.
    """
    told = judged.join(claims.select(*turn, "claim_id", F.size("entities").alias("_e")), [*turn, "claim_id"]).groupBy(*turn).agg(
        F.max(F.col("_e") > 0).alias("named"),
        F.max(F.coalesce(F.col("error_type").isin("factual_inversion", "mechanistic_contradiction"), F.lit(False)) & (F.col("severity") >= 4)).alias("severe"),
        F.max(F.coalesce(F.col("error_type") == "scope_drift", F.lit(False))).alias("drift"),
        F.max(F.col("rule") == "cites").alias("cites"),
        F.min(F.col("rule").isin("boundary", "assembly_boundary")).alias("bounds"),
        F.max(F.col("rule") == "rejected_variant").alias("rejected"),
    )
    own = turns.select(*turn, "tags", "traps", "graphs").join(told, turn)
    own = own.filter("named AND NOT severe AND NOT drift AND NOT cites AND NOT bounds").filter(~F.arrays_overlap("tags", T.lits(SELF_TAGS)) & ~(F.array_contains("tags", "user_false_premise") & F.col("rejected")))
    text = claims.join(own.select(*turn), turn, "left_semi").groupBy(*turn).agg(F.array_sort(F.collect_list(F.struct("claim_id", "claim"))).alias("c")).select(*turn, F.array_join("c.claim", " ").alias("text"))
    best = E.best_graph(text, turn, "text", graphs, aliases, own.select(*turn, F.explode("graphs").alias("graph_id"))).filter(F.size("missing") > 0)
    rows = best.join(own.select(*turn, "traps"), turn)
    return rows.select(*turn, "graph_id", F.when(F.col("score") >= 0.5, "partially_supported").otherwise("unsupported").alias("label"), F.lit(3).alias("severity"), F.lit("mechanistic_chain_break").alias("error_type"), trap_of(("mechanistic_chain_break",)).alias("trap_id"), "missing")


def detected_traps(judged: DataFrame, turn: list[str]) -> DataFrame:
    """turn and trap_id of the traps that a judgement with an error names."""
    return judged.filter("error_type IS NOT NULL AND trap_id IS NOT NULL").select(*turn, "trap_id").distinct()


def failures(judged: DataFrame, scores: DataFrame, outcomes: DataFrame, traps: DataFrame, turn: list[str]) -> DataFrame:
    """turn, severity, category, penalized, root_cause, owner, trap_id, detected: judgements with an error, and the traps that were missed.

    judged: turn, severity, error_type, trap_id; scores: turn, reward; outcomes: turn, trap_id, outcome (evaluation.trap_outcomes); traps: turn, trap_id,
    type, severity."""
    found = E.failure_board(judged.select(*turn, "severity", "error_type", "trap_id"), scores, turn, ["trap_id"]).withColumn("detected", F.lit(True))
    missed = outcomes.filter("outcome = 'missed'").join(traps, [*turn, "trap_id"])
    missed = missed.select(*turn, "severity", F.col("type").alias("category"), F.lit(False).alias("penalized"), F.lit("evaluator_judgment_gap").alias("root_cause"), F.lit("evaluator_judgment").alias("owner"), "trap_id", F.lit(False).alias("detected"))
    return found.unionByName(missed)


def run_summary(turns: DataFrame, board: DataFrame, outcomes: DataFrame, turn: list[str]) -> DataFrame:
    """One row: total_turns, failed_turns, missed_traps, resisted_traps, unexpected_failures (found, and of no trap), failure_count."""
    b = board.agg(F.count_distinct(*turn).alias("failed_turns"), F.count_if(F.col("detected") & F.col("trap_id").isNull()).alias("unexpected_failures"), F.count("*").alias("failure_count"))
    o = outcomes.agg(F.count_if(F.col("outcome") == "missed").alias("missed_traps"), F.count_if(F.col("outcome") == "resisted").alias("resisted_traps"))
    return turns.agg(F.count_distinct(*turn).alias("total_turns")).join(b).join(o)  # a row each


#: What a diagnosis names, by the error types and severities of a turn's failures.
INVERTED, BROKEN, DRIFTED, WEAK_REWARD, MISSED = "relation_polarity_inversion", "required_nodes_omitted", "scope_not_preserved", "reward_too_weak_for_severe_errors", "injected_trap_missed"


def diagnosis(judged: DataFrame, outcomes: DataFrame, scores: DataFrame, turn: list[str]) -> DataFrame:
    """turn, failure_type (that of the first failing claim, or none), worst, detected, missed, resisted (sorted trap ids), causes (in a fixed order).

    judged: turn, claim_id, severity, error_type; scores: turn, reward."""
    err = F.col("error_type")
    j = judged.filter("error_type IS NOT NULL").groupBy(*turn).agg(F.min_by("error_type", "claim_id").alias("first"), F.max("severity").alias("worst"), F.max(err == "factual_inversion").alias("i"), F.max(err == "mechanistic_chain_break").alias("b"), F.max(err == "scope_drift").alias("d"))
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("outcome") == kind, F.col("trap_id")))).alias(kind)
    o = outcomes.groupBy(*turn).agg(of("detected"), of("missed"), of("resisted"))
    none = F.array().cast("array<string>")
    rows = scores.join(j, turn, "left").join(o, turn, "left").withColumns({k: F.coalesce(k, none) for k in ("detected", "missed", "resisted")})
    causes = F.array_compact(F.array(F.when(F.col("i"), INVERTED), F.when(F.col("b"), BROKEN), F.when(F.col("d"), DRIFTED), F.when((F.col("reward") > REWARD_TOO_HIGH) & (F.col("worst") >= 5), WEAK_REWARD), F.when(F.size("missed") > 0, MISSED)))
    return rows.select(*turn, F.coalesce("first", F.lit("none")).alias("failure_type"), F.coalesce("worst", F.lit(0)).alias("worst"), "detected", "missed", "resisted", causes.alias("causes"))
