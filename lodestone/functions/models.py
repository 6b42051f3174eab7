"""Pluggable scorers over whole tables: distinct inputs go to `mapInPandas`, models are loaded once a task, results are joined back."""

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get these functions with the job

Loader = Callable[[], Callable[[list], list]]


def scored(rows: DataFrame, inputs: list[str], load: Loader, schema: str, batch: int = 64) -> DataFrame:
    """rows with the columns of `schema` that the scorer gives for its inputs. `load()` returns a function from a list of input tuples to a list of
    output tuples. Null inputs are passed as None."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    keys = rows.select(*inputs).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for f in frames:
            items = list(f[inputs].itertuples(index=False, name=None))
            out = [x for i in range(0, len(items), batch) for x in score(items[i : i + batch])]
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)
    got = keys.mapInPandas(run, f"{kinds}, {schema}")
    renamed = got.select(*[got[c].alias(f"_k{i}") for i, c in enumerate(inputs)], *names)
    on = None
    for i, c in enumerate(inputs):
        e = rows[c].eqNullSafe(renamed[f"_k{i}"])
        on = e if on is None else on & e
    return rows.join(renamed, on, "left").select(*[rows[c] for c in rows.columns], *names)


def dictionary_labels(words: dict[str, list[str]]) -> Loader:
    """A deterministic scorer for tests and defaults: the share of a label's words among the text's."""

    def load():
        def score(items):
            out = []
            for (text,) in items:
                toks = (text or "").lower().split()
                out.append(tuple(sum(t in ws for t in toks) / max(1, len(toks)) for ws in words.values()))
            return out

        return score

    return load


def pattern_triples() -> Loader:
    """A deterministic extractor: first, second and third word of a sentence."""

    def load():
        return lambda items: [tuple((w + ["", "", ""])[:3]) for w in ((t or "").lower().split() for (t,) in items)]

    return load


def spelling_repair(vocabulary: list[str], least: float = 0.82) -> Loader:
    """The closest vocabulary word by matching-block ratio, or the word itself. The vocabulary is a small list."""

    def load():
        import difflib

        return lambda items: [((difflib.get_close_matches(w or "", vocabulary, 1, least) or [w])[0],) for (w,) in items]

    return load
