"""SQL text in DuckDB's dialect: the derived views and the text functions, to be put into the queries' oracles."""

from lodestone.functions import text as T
from lodestone.functions import triples as R

SENTENCES = """sentences AS (SELECT doc_id, pos, trim(s) AS sentence FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE trim(s) <> '')"""


def terms(c: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({c}, ''), '{T.TERM}'), lambda x: lower(x))"


def quoted(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def first_seen(l: str) -> str:
    """The distinct values of a list, in the order of their first places."""
    return f"(CASE WHEN len({l}) = 0 THEN [] ELSE list_reduce(list_transform({l}, lambda v: [v]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) END)"


def important(c: str, n: int = 24) -> str:
    return f"list_slice({first_seen(f'list_filter({terms(c)}, lambda y: y NOT IN ({quoted(T.STOP)}))')}, 1, {n})"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / greatest(1, len(list_distinct(list_concat({a}, {b})))) END)"


TRIPLES = (
    SENTENCES
    + f""", triples AS (SELECT doc_id || '-' || pos AS triple_id, CASE WHEN doc_id % 2 = 0 THEN 'PMC' || doc_id || '.txt' ELSE CAST(doc_id AS VARCHAR) END AS article_id, doc_id, pos, sentence AS sentence_text,
 t[1] AS subject, t[2] AS relation, t[3] AS object, """
    + ", ".join(f"(((doc_id * 31 + pos * {k}) % 101) / 100.0)::DOUBLE AS {n}" for n, k in {"s_ebio": 17, "s_ngen": 29, "s_otro": 43, "o_ebio": 59, "o_ngen": 71, "o_otro": 83}.items())
    + f" FROM (SELECT *, {terms('sentence')} AS t FROM sentences) WHERE len(t) >= 3)"
)
MEMORY = "memory_docs AS (SELECT 'message' AS doc_type, conv_id AS session_id, CAST(turn AS INT) AS turn_index, role, text, (((conv_id * 7 + turn * 13) % 101) / 100.0)::DOUBLE AS importance FROM conversations)"
EVENTS = "turn_events AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS scope, event_type AS state_key, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS action, least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS reward FROM events)"
CONFIDENCE = "least(greatest(s_ebio, s_ngen, s_otro), greatest(o_ebio, o_ngen, o_otro))"


def tokens(c: str) -> str:
    t = rf"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')"
    return rf"(CASE WHEN {t} = '' THEN 0 ELSE greatest(1, CAST(ceil(len(regexp_extract_all({t}, '\S+')) * 1.25) AS BIGINT), CAST(ceil(length({t}) / 4.0) AS BIGINT)) END)::BIGINT"


def informative(c: str) -> str:
    w = quoted(R.UNINFORMATIVE)
    l = f"trim(lower(coalesce({c}, '')))"
    return rf"(length({l}) >= 3 AND {l} NOT IN ({w}) AND regexp_split_to_array({l}, '\s+')[1] NOT IN ({w}) AND NOT regexp_matches({l}, '^\d+$') AND len(list_distinct(string_split(replace({l}, ' ', ''), ''))) >= 2)"


def normalized(c: str) -> str:
    return rf"regexp_replace(regexp_replace(trim(lower(coalesce({c}, ''))), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g')"


def hits(c: str, words) -> str:
    return f"len(list_intersect(list_distinct({terms(c)}), [{quoted(words)}]))"


def contains_any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
