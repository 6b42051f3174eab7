"""PII surrogates, by DataFrame functions alone.

Entities (email, phone, ssn, card, ip, name after an honorific) are found by one pattern, which only texts see that a cheaper one lets
pass. Each is brought to a normal form (digits, lower case; a name gives one for each of its words), which a keyed Feistel network maps to another
of the same form: every character moves within its own alphabet (digits, vowels and consonants by script, ranges of the larger scripts), so type,
script, length and layout stay; honorific and last letter of a name stay, and with them its gender; country codes, top-level domains, a
card's first digit and its Luhn remainder stay too. The network is a bijection: one entity has one surrogate wherever and however it is
written, a family name has one beside whatever first name (coreference), and different ones have different ones (distinctness).

Collision check: where a surrogate is itself an entity of the corpus (or the entity itself), further keys are tried until it is none, nor
another's surrogate. What is left after that (its form has hardly any free values) gets a keyed hash instead. The few entities that this
changes form a table, which is joined to the documents that hold them; all others need no join.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, free_name, ships, table, text_hash

ships(__name__)

KINDS = ("email", "phone", "ssn", "card", "ip", "name")
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
HONORIFIC = r"(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señora?|Sra?|Г-жа|Г-н|г-жа|г-н|[Гг]осподин|[Гг]оспожа)"
NAME = r"(?:\p{Lu}[\p{L}'’-]+|\p{Lo}[\p{L}\p{M}'’-]*)"
PATTERNS = [
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    r"(?<![A-Za-z0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![A-Za-z0-9-])",
    rf"(?<![A-Za-z0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![A-Za-z0-9]|\.[0-9])",
    r"(?<![A-Za-z0-9-])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![A-Za-z0-9-])",
    r"(?<![A-Za-z0-9])[0-9]{13,19}(?![A-Za-z0-9])",
    rf"(?<!\p{{L}}){HONORIFIC}\.? {NAME}(?: {NAME})?",
]
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS)
#: Texts without a match of this hold no entity; it is cheap.
MAYBE = rf"@|[0-9][0-9 .()-]{{5}}|{HONORIFIC}\.? [\p{{Lu}}\p{{Lo}}]"
# Country codes of one and two digits (the others have three).
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Letters move among their like; a letter of none of these or the ranges stays.
NAME_ALPHABETS = [
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "áéíóúàèìòùâêîôûäëïöüãõåæøāēīōūăĕĭŏŭąęįųėőűœýÿ",
    "çñćĉčďđĝğģĥķĺļľłńņňŕřśŝşšţťźżžþðșț",
    "аеиоуыэюяё",
    "бвгджзйклмнпрстфхцчшщъь",
    "єіїґўђјљњћџѓќѕ",
    "αεηιουωάέήίόύώϊϋ",
    "βγδζθκλμνξπρστφχψ",
]
#: Georgian, Armenian, Hebrew, Arabic, Devanagari, Thai, Hiragana, Katakana, Han, Hangul.
RANGES = [(0x10D0, 0x10F0), (0x0561, 0x0586), (0x05D0, 0x05EA), (0x0620, 0x064A), (0x0904, 0x0939), (0x0E01, 0x0E2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
ROUNDS, TRIES = 4, 12
#: Where op2_pii and the pipeline find their key; without one they use a key that anyone can read here, which protects nobody.
KEY_CONF, OPEN_KEY = "spark.lodestone.pii.key", "not a secret"
#: Rows of the exception table up to which it is broadcast.
FEW = 10_000


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c), with c computed once."""
    return F.element_at(F.transform(F.array(c), body), 1)


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def symbol(kind: str, c: Column, keep: Column) -> Column:
    """What the character moves within, as a struct: an alphabet, or the first code of a range (else 0), and its size; itself, if it stays."""
    of = lambda a, base, n: F.struct(F.lit(a).alias("a") if isinstance(a, str) else a.alias("a"), F.lit(base).alias("base"), F.lit(n).alias("n"))
    out = of(c, 0, 1)
    for lo, hi in RANGES if kind == "name" else []:
        out = F.when(F.ascii(c).between(lo, hi), of("", lo, hi - lo + 1)).otherwise(out)
    for a in [DIGITS, LETTERS] if kind == "email" else NAME_ALPHABETS if kind == "name" else [DIGITS]:
        out = F.when(F.contains(F.lit(a), c), of(a, 0, len(a))).otherwise(out)
    return F.when(keep, of(c, 0, 1)).otherwise(out)


def feistel(values: Column, radix: Column, salt: Column) -> Column:
    """A keyed bijection of the arrays of numbers that are below their radix."""
    half = lambda i, n, r: (i < F.floor(n / 2)) if r % 2 == 0 else (i >= F.floor(n / 2))

    def rounds(v: Column, r: int) -> Column:
        if r == ROUNDS:
            return v
        n = F.size(v)
        other = F.array_join(F.filter(v, lambda _, i: ~half(i, n, r)).cast("array<string>"), ",")
        moved = lambda d: F.transform(v, lambda x, i: F.when(half(i, n, r), F.pmod(x + F.conv(F.substring(d, (i * 4) % 124 + 1, 4), 16, 10).cast("int"), F.get(radix, i))).otherwise(x))
        return let(F.sha2(F.concat(salt, F.lit(f"|{r}|"), other), 512), lambda d: let(moved(d), lambda x: rounds(x, r + 1)))

    return rounds(values, 0)


def moved_text(kind: str, norm: Column, key: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """norm with every character moved within its alphabet; keep(i, n) says which stay."""
    salt = F.concat(key, F.lit(f"|{kind}"))

    value = lambda c, y: F.when(y["base"] > 0, F.ascii(c) - y["base"]).otherwise(F.position(c, y["a"]) - 1)
    letter = lambda v, y: F.when(y["base"] > 0, F.decode(F.unhex(F.lpad(F.hex(y["base"] + v), 4, "0")), "UTF-16BE")).otherwise(F.substring(y["a"], v + 1, 1))

    def body(cs: Column) -> Column:
        n = F.size(cs)
        return let(F.transform(cs, lambda c, i: symbol(kind, c, keep(i, n))), lambda ys: F.array_join(F.zip_with(feistel(F.zip_with(cs, ys, value), F.transform(ys, lambda y: y["n"]), salt), ys, letter), ""))

    return let(chars(norm), body)


def luhn(digits: Column) -> Column:
    """The check digit that makes the digits valid."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    n = F.size(digits)
    parts = F.transform(digits, lambda d, i: F.when((n - 1 - i) % 2 == 0, twice(d)).otherwise(d))
    return F.pmod(-F.aggregate(parts, F.lit(0), lambda a, x: a + x), F.lit(10))


def kind_of(e: Column) -> Column:
    return F.when(F.contains(e, F.lit("@")), "email").when(e.rlike(r"^[^0-9+(]"), "name").when(e.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), "ip").when(e.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(e.rlike(r"^\+|^\(|^[0-9]{3}[.-][0-9]{3}[.-]"), "phone").otherwise("card")


def normal(kind: Column, e: Column) -> Column:
    """What all ways to write an entity have in common: an array, of a name's words, else of one form."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    one = F.when(kind == "email", F.lower(e)).when(kind == "ip", e).when((kind == "phone") & e.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    return F.when(kind == "name", F.split(F.lower(F.regexp_replace(e, rf"^{HONORIFIC}\.? ", "")), " ")).otherwise(F.array(one))


def surrogate(kind: Column, norm: Column, key: str | Column) -> Column:
    """The normal form's surrogate, a normal form of the same kind."""
    key = F.lit(key) if isinstance(key, str) else key
    dot = lambda c: F.length(c) - F.length(F.substring_index(c, ".", -1))
    code = F.length(F.regexp_extract(norm, COUNTRY, 0))
    octets = lambda o: F.concat_ws(".", F.slice(o, 1, 1), feistel(F.transform(F.slice(o, 2, 3), lambda x: x.cast("int")), F.array(*[F.lit(256)] * 3), F.concat(key, F.lit("|ip|"), F.get(o, 0))).cast("array<string>"))

    def card(d: Column) -> Column:
        body = F.substring(norm, F.lit(1), F.length(norm) - 1)
        moved = moved_text("card", body, key, lambda i, n: i == 0)
        number = lambda c: F.transform(chars(c), lambda x: x.cast("int"))
        return let(moved, lambda m: F.concat(m, F.pmod(luhn(number(m)) + d - luhn(number(body)), F.lit(10)).cast("string")))

    return (
        F.when(kind == "email", let(dot(norm), lambda k: moved_text("email", norm, key, lambda i, n: i >= k)))
        .when(kind == "phone", let(code, lambda k: moved_text("phone", norm, key, lambda i, n: i < k)))
        .when(kind == "ip", let(F.split(norm, r"\."), octets))
        .when(kind == "card", card(F.substring(norm, -1, 1).cast("int")))
        .when(kind == "ssn", moved_text("ssn", norm, key, lambda i, n: F.lit(False)))
        .otherwise(moved_text("name", norm, key, lambda i, n: (i == n - 1) & (n > 3)))
    )


def laid_out(kind: Column, e: Column, surs: Column) -> Column:
    """The surrogate (an array, as of normal()) in the layout of the entity as written: its separators, capitals and honorific."""
    title = F.regexp_extract(e, rf"^{HONORIFIC}\.? ", 0)
    sur = F.get(surs, 0)
    letters = lambda text, new: F.array_join(F.zip_with(chars(text), chars(new), lambda c, s: F.when(c != F.lower(c), F.upper(s)).otherwise(s)), "")
    words = F.zip_with(F.split(F.substring(e, F.length(title) + 1, F.length(e)), " "), surs, letters)
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("k"))
    digit = lambda s: lambda acc, c: F.when(c.between("0", "9"), F.struct(F.concat(acc["t"], F.substring(s, acc["k"], 1)).alias("t"), (acc["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(acc["t"], c).alias("t"), acc["k"].alias("k")))
    digits = let(F.regexp_replace(sur, "[^0-9]", ""), lambda s: F.aggregate(chars(e), start, digit(s), lambda acc: acc["t"]))
    return F.when(kind == "name", F.concat(title, F.array_join(words, " "))).when(sur.startswith("["), sur).when(kind == "email", letters(e, sur)).when(kind == "ip", sur).otherwise(digits)


def marker(kind: Column, norm: Column, key: str) -> Column:
    """A keyed hash instead of a surrogate: a long word for a name, else the kind and the hash in brackets."""
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mark"), kind, norm), 256), 1, 16)
    return F.when(kind == "name", F.translate(digest, DIGITS, "ghijklmnop")).otherwise(F.concat(F.lit("["), kind, F.lit(" "), digest, F.lit("]")))


def entities(text: Column) -> Column:
    """The text's entities in order, as written; null texts have none."""
    return F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def moved_on(docs: DataFrame, key: str, text_col: str, tries: int = TRIES) -> DataFrame:
    """(kind, norm, sur) of the entities whose first surrogate is itself an entity of the corpus, with another surrogate.

    Try t takes another key. A surrogate is good if it is no entity, no entity's first surrogate, and no other's new one; of two that
    meet, the smaller form keeps it. What still clashes after `tries` (a nearly full space, such as all names of two letters) gets a marker.
    The surrogates of all tries are computed in one job; a form that no key moves (a name in letters without an alphabet here) has none
    that is free, so it takes no part in the tries.
    """
    found = docs.select(F.explode(entities(F.col(text_col))).alias("e")).select(kind_of(F.col("e")).alias("kind"), "e").select("kind", F.explode(normal(F.col("kind"), F.col("e"))).alias("norm"))
    known = durable(found.distinct().withColumn("sur", surrogate(F.col("kind"), F.col("norm"), key)))
    real = known.select("kind", F.col("norm").alias("sur"))
    left = durable(known.join(real, ["kind", "sur"], "left_semi").select("kind", "norm"))
    stuck = (F.col("kind") == "name") & F.forall(chars(F.col("norm")), lambda c: symbol("name", c, F.lit(False))["n"] == 1)
    movable = left.filter(~stuck)
    if not tries or movable.isEmpty():  # as a rule; spares the plan of the tries
        return left.withColumn("sur", marker(F.col("kind"), F.col("norm"), key))
    free = movable.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    # written before the joins, which would otherwise be pushed below the surrogates and compute them once more for each
    free = durable(free.withColumn("sur", surrogate(F.col("kind"), F.col("norm"), F.concat(F.lit(f"{key}|"), F.col("t").cast("string")))))
    free = durable(free.join(real, ["kind", "sur"], "left_anti").join(known.select("kind", "sur"), ["kind", "sur"], "left_anti"))
    done = durable(left.limit(0).withColumn("sur", F.col("norm")))
    for t in range(1, tries + 1):
        if free.filter(F.col("t") >= t).isEmpty():
            break
        new = free.filter(F.col("t") == t).join(done.select("kind", "sur"), ["kind", "sur"], "left_anti")
        new = durable(new.groupBy("kind", "sur").agg(F.min("norm").alias("norm")).select("kind", "norm", "sur"))
        done = durable(done.unionByName(new))
        free = durable(free.filter(F.col("t") > t).join(new, ["kind", "norm"], "left_anti"))
    left = left.join(done, ["kind", "norm"], "left_anti")
    return done.unionByName(left.withColumn("sur", marker(F.col("kind"), F.col("norm"), key)))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", tries: int = TRIES) -> DataFrame:
    """docs with entities in text_col replaced, and n_<kind> for each kind. Clashing columns are replaced.

    Whoever has the key can undo the replacement, so there is none by default. Null texts stay null. Repeated rows and ids are independent: a
    surrogate depends on key, kind and normal form alone. Texts are whole; those without an entity are unchanged. Without an exception
    there is no shuffle of texts; with up to FEW documents that hold one these are broadcast; beyond that the texts are joined by id and hash.
    """
    if not key:
        raise ValueError("replace_pii needs a key")
    base = docs.drop(*[f"n_{k}" for k in KINDS])
    found, forms, hashed, ident, hashed2, own_col = (free_name(c, base) for c in ("_e", "_m", "_h", "_id", "_h2", "_own"))
    moved = moved_on(base, key, text_col, tries)
    rows = base.withColumn(found, entities(F.col(text_col)))
    marked = lambda e: let(kind_of(e), lambda k: F.struct(e.alias("e"), k.alias("kind"), normal(k, e).alias("norms")))
    rows = rows.withColumn(forms, F.transform(found, marked))
    own = F.lit(None).cast("map<string,string>")
    if not moved.isEmpty():
        rows = rows.withColumn(hashed, text_hash(text_col))
        held = rows.filter(F.size(found) > 0).select(F.col(id_col).alias(ident), hashed, F.explode(forms).alias("m")).select(ident, hashed, "m.kind", F.explode("m.norms").alias("norm")).distinct().join(moved, ["kind", "norm"])
        held = durable(held.groupBy(ident, hashed).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "sur"))).alias(own_col)).withColumnRenamed(hashed, hashed2))
        held = F.broadcast(held) if held.count() <= FEW else held
        rows = rows.join(held, rows[id_col].eqNullSafe(held[ident]) & (rows[hashed] == held[hashed2]), "left")
        own = F.col(own_col)
    one = lambda k: lambda n: F.coalesce(F.element_at(own, F.concat_ws("|", k, n)), surrogate(k, n, key))
    change = lambda m: laid_out(m["kind"], m["e"], F.transform(m["norms"], one(m["kind"])))
    text = F.when(F.size(found) == 0, F.col(text_col)).otherwise(F.array_join(F.zip_with(F.split(text_col, PATTERN, -1), F.transform(forms, change), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), ""))
    is_ = lambda k: lambda m: m["kind"] == k
    counts = [F.size(F.filter(forms, is_(k))).alias(f"n_{k}") for k in KINDS]
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in base.columns], *counts)


def session_key(spark) -> str:
    return spark.conf.get(KEY_CONF, OPEN_KEY)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
