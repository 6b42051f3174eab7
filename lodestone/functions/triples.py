"""Columns of subject-relation-object triples: confidence, types, signatures, quality."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities that say nothing.
UNINFORMATIVE = [
    "we", "they", "it", "he", "she", "i", "you", "them", "us", "our", "their", "this", "that", "these", "those", "which", "what", "who", "whom",
    "study", "studies", "result", "results", "data", "analysis", "method", "methods", "approach", "paper", "article", "research", "work", "finding", "findings",
    "experiment", "experiments", "observation", "observations", "factor", "factors", "phenomenon", "part", "parts", "case", "cases",
    "example", "examples", "type", "types", "form", "forms", "kind", "group", "patient", "patients", "effect", "effects", "level", "levels", "rate", "rates",
    "one", "two", "three", "many", "several", "some", "all", "most", "both", "other", "others", "another", "same", "different", "various", "multiple",
    "first", "second", "third", "new", "recent", "previous", "current", "use", "using", "used", "show", "shown", "found", "reported",
]


def article_ids(c: Column) -> tuple[Column, Column]:
    """(pmid, pmcid) of an article's file name."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\.(txt|pdf|xml)$", "")
    pmc = F.regexp_extract(clean, r"(?i)PMC(\d+)", 1)
    return F.when((pmc == "") & clean.rlike(r"^\d+$"), clean), F.when(pmc != "", F.concat(F.lit("PMC"), pmc))


def confidence(s: tuple, o: tuple) -> Column:
    """The smaller of the two largest label probabilities; nulls count as 0."""
    return F.least(F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in s]), F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in o]))


def entity_type(ebio: Column, ngen: Column, other: Column, least: float = 0.7) -> Column:
    """EBio from `least` on, else the likelier of the rest."""
    return F.when(ebio >= least, "EBio").when((ngen >= other) & (ngen > 0), "NGen").otherwise("other")


def picked_type(ebio: Column, ngen: Column, other: Column, thresholds: dict) -> Column:
    """The first label that reaches its own threshold."""
    return F.when(ebio >= thresholds["EBio"], "EBio").when(ngen >= thresholds["NGen"], "NGen").when(other >= thresholds["other"], "other")


def normalized(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " "), r"(?U)[^\w\s]", "")


def signature(s: Column, r: Column, o: Column) -> Column:
    return F.concat_ws("|", normalized(s), normalized(r), normalized(o))


def informative(c: Column) -> Column:
    clean = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    first = F.element_at(F.split(clean, r"\s+"), 1)
    kinds = F.size(F.array_distinct(F.filter(F.split(F.replace(clean, F.lit(" "), F.lit("")), ""), lambda x: x != "")))
    return (F.length(clean) >= 3) & ~clean.isin(UNINFORMATIVE) & ~first.isin(UNINFORMATIVE) & ~clean.rlike(r"^\d+$") & (kinds >= 2)


def quality(s_ebio: Column, o_ebio: Column, conf: Column, search_score: Column) -> Column:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return (z(s_ebio) + z(o_ebio)) / 2 * 0.3 + z(conf) * 0.3 + F.when(z(search_score) > 0, F.least(z(search_score) / 20.0, F.lit(1.0))).otherwise(0.0) * 0.4


def blended_type(scores: dict[str, Column], prior: dict[str, Column], weight: float) -> dict[str, Column]:
    """label and score of the class with the best blend, weight * score + (1 - weight) * prior; of equal ones the first named."""
    total = {k: F.lit(weight) * F.coalesce(c, F.lit(0.0)) + F.lit(round(1 - weight, 12)) * F.coalesce(prior.get(k, F.lit(None)), F.lit(0.0)) for k, c in scores.items()}
    best = F.greatest(*total.values()) if len(total) > 1 else next(iter(total.values()))
    label = F.lit(None).cast("string")
    for k, v in reversed(total.items()):
        label = F.when(v == best, k).otherwise(label)
    return {"label": label, "score": F.round(best, 6)}
