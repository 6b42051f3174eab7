"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation many times, each time some turns longer. Every turn gets a hash of its place, role and text; running sums of
the hashes (four lanes of 31 bits) are rolling hashes of all turn prefixes. A conversation whose whole hash is another's proper
prefix is a snapshot and goes by an anti-join; of equal ones the smallest id stays. What is left is rendered.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import dealt, running, ships, table

ships(__name__)

LANES = ["_l0", "_l1", "_l2", "_l3"]
KEY = ["n_turns", *LANES]
#: The common chat markup of open chat models.
TURN = "<|im_start|>%s\n%s<|im_end|>\n"


def marked(turns: DataFrame) -> DataFrame:
    """Turns with _m, the md5 of the text (null for null), which stands for the text until the rendering."""
    return turns.select("conv_id", "turn", "role", "text", F.md5("text").alias("_m"))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the maximal conversations among turns (conv_id, turn, role, text).

    Exact repeated rows count once. Turns are ordered by turn, role and the text's md5, nulls first; nulls are values of their own. A null
    conv_id is a conversation like any other. Texts aren't shuffled, and a very long conversation is spread over many partitions.
    """
    order = ["turn", "role", "_m"]
    rows = marked(turns).drop("text").distinct()
    rows = running(dealt(rows, ["conv_id"], order), ["conv_id"], order, {"place": F.lit(1)})
    lanes = {k: F.xxhash64(F.lit(i), "place", F.coalesce("role", F.lit("")), F.coalesce("_m", F.lit("")), F.col("role").isNull()).bitwiseAND(0x7FFFFFFF) for i, k in enumerate(LANES)}
    rows = rows.withColumns({f"_h{k}": v for k, v in lanes.items()})
    prefix = running(rows, ["conv_id"], order, {k: F.col(f"_h{k}") for k in LANES}).select((F.col("place") + 1).alias("n_turns"), *[(F.col(k) + F.col(f"_h{k}")).alias(k) for k in LANES])
    whole = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), *[F.sum(f"_h{k}").alias(k) for k in LANES])
    logs = whole.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    longer = prefix.groupBy(*KEY).agg(F.count("*").alias("_n")).join(logs, KEY).filter("_n > n_copies").select(*KEY)  # more conversations go on from here
    return logs.join(longer, KEY, "left_anti").select("conv_id", "n_turns", "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """One row for each kept conversation: conv_id, n_turns, n_copies, rendered. Null roles and texts are rendered empty.

    A conversation's text is one value, so a task holds one conversation at a time; turns meet only at this last step.
    """
    rows = marked(turns)
    ids = kept.withColumnRenamed("conv_id", "_id")
    rows = rows.join(ids, rows["conv_id"].eqNullSafe(ids["_id"]))
    together = rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "_m", "text"))).alias("t"))
    text = F.transform("t", lambda x: F.format_string(TURN, F.coalesce(x["role"], F.lit("")), F.coalesce(x["text"], F.lit(""))))
    return together.select("conv_id", "n_turns", "n_copies", F.array_join(text, "").alias("rendered"))


def op1_chat(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return render(turns, collapse(turns))


SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS l,
             string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS rendered
      FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT md5(CAST(l[1:k] AS VARCHAR)) AS h FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c))
SELECT min(conv_id) AS conv_id, len(l) AS n_turns, count(*) AS n_copies, any_value(rendered) AS rendered
FROM c WHERE md5(CAST(l AS VARCHAR)) NOT IN (SELECT h FROM p) GROUP BY l
"""
