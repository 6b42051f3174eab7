"""Vocabularies of any size in texts: whole phrases by word n-grams, substrings by an automaton; and terms within some edits by deletions."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of strings that one automaton holds; larger vocabularies take several passes over the texts.
AUTOMATON_BYTES = 8 << 20


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it takes no more than an automaton's bytes; rows that meet it then stay where they are."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= AUTOMATON_BYTES else df


def words(c: Column) -> Column:
    """Lower-case words: letters a-z, digits and hyphens."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9-]+", " "), " "), lambda w: w != "")


def phrase_matches(rows: DataFrame, key: list[str], text: str, phrases: DataFrame, longest: bool = False) -> DataFrame:
    """key, start (word, from 0), n (words) and phrase: the places where the lower-cased phrase stands as whole words.

    phrases: (phrase), of any size. Texts give their word n-grams of the lengths that phrases have, which meet the phrases by a join: no text is
    tried against every phrase. With longest, a match inside a longer one is left out. Blank and null phrases match nothing.
    """
    p = phrases.select(F.lower("phrase").alias("phrase")).filter(F.trim("phrase") != "").distinct().withColumn("n", F.size(F.split("phrase", " ")))
    lengths = sorted(r["n"] for r in p.select("n").distinct().collect())  # a few small numbers
    w = rows.select(*key, words(F.col(text)).alias("_w"))

    def of_length(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - n + 1)), lambda i: F.struct((i - 1).alias("start"), F.lit(n).alias("n"), F.array_join(F.slice("_w", i, n), " ").alias("phrase")))

    grams = F.flatten(F.array(*map(of_length, lengths))) if lengths else F.array().cast("array<struct<start:int,n:int,phrase:string>>")
    found = w.select(*key, F.explode(grams).alias("g")).select(*key, "g.*").join(small(p), ["phrase", "n"]).select(*key, "start", "n", "phrase")
    if not longest:
        return found
    ends = Window.partitionBy(*key).orderBy("start", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.col("start") + F.col("n")).over(ends)
    return found.withColumn("_reached", reached).filter(F.col("_reached").isNull() | (F.col("start") + F.col("n") > F.col("_reached"))).drop("_reached")


def contained(rows: DataFrame, key: list[str], text: str, pieces: DataFrame, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """key and piece: the pieces (piece), lower-cased, that the lower-cased text holds anywhere. Each pair once for each row.

    One pass over the texts for each `most_bytes` of pieces, through an automaton that a task builds from them; the time doesn't depend on
    how many pieces there are. Null and empty pieces and texts hold nothing.
    """
    p = pieces.select(F.lower("piece").alias("piece")).filter("piece <> ''").distinct()
    size = p.agg(F.sum(F.length("piece") * 4)).first()[0] or 0  # a character has up to 4 bytes
    parts = max(1, -(-5 * size // (4 * most_bytes)))
    texts = rows.select(*key, F.lower(text).alias("_t"))
    schema = ", ".join(f"`{k}` {t}" for k, t in texts.drop("_t").dtypes) + ", piece string"
    out = None
    for i in range(parts):
        mine = [r["piece"] for r in p.filter(F.pmod(F.xxhash64("piece"), F.lit(parts)) == i).collect()]  # about most_bytes
        sent = rows.sparkSession.sparkContext.broadcast(mine)

        def run(batches, sent=sent):
            import ahocorasick

            machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
            for x in sent.value:
                machine.add_word(x, x)
            if len(machine):
                machine.make_automaton()
            for b in batches:
                at, found = [], []
                for row, t in enumerate(b.column("_t").to_pylist()):
                    hit = {x for _, x in machine.iter(t)} if t and len(machine) else ()
                    at.extend([row] * len(hit))
                    found.extend(hit)
                place = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(place) for k in key), pa.array(found, pa.string())], names=[*key, "piece"])

        hits = texts.mapInArrow(run, schema)
        out = hits if out is None else out.unionByName(hits)
    return out


def deletions(term: Column, most: int) -> Column:
    """(variant, gone) of a term: what is left of it without `gone` characters, up to `most` (0 to 2)."""
    shorter = lambda c: F.transform(F.filter(F.sequence(F.lit(0), F.length(c)), lambda i: i > 0), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    levels = [F.array(term)]
    for _ in range(most):
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], shorter))))

    def tagged(gone: int) -> Column:
        return F.transform(levels[gone], lambda x: F.struct(x.alias("variant"), F.lit(gone).alias("gone")))

    return F.concat(*map(tagged, range(most + 1)))


def within_edits(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, match, distance): words of the vocabulary (match) within 0, 1 or 2 edits of a term (of up to 2, 5 and more characters).

    Two words that are d edits apart have a form in common after at most d deletions from each; these forms are joined, so neither the first
    letter nor the length is a hot key, and the few pairs that meet are measured.
    """
    most = F.when(F.length("term") <= 2, 0).when(F.length("term") <= 5, 1).otherwise(2)
    want = terms.select("term").distinct().withColumn("most", most)
    want = want.select("term", "most", F.explode(deletions(F.col("term"), 2)).alias("x")).filter(F.col("x.gone") <= F.col("most")).select("term", "most", F.xxhash64("x.variant").alias("v"))
    have = vocabulary.select("match").distinct().select("match", F.explode(deletions(F.col("match"), 2)).alias("x"))
    # a term of 3 to 5 characters keeps 2 of them at least, a longer one 4: shorter forms of a word can't be met
    have = have.filter((F.col("x.gone") == 0) | (F.length("x.variant") >= F.when(F.col("x.gone") == 1, 2).otherwise(4)))
    have = have.select("match", F.col("x.gone").alias("gone"), F.xxhash64("x.variant").alias("v"))
    near = want.join(have, "v").filter(F.col("gone") <= F.col("most")).select("term", "most", "match").distinct()
    return near.withColumn("distance", F.levenshtein("term", "match").cast("long")).filter(F.col("distance") <= F.col("most")).select("term", "match", "distance")
