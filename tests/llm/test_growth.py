"""What keeps work and memory small on large inputs."""

import tracemalloc

import numpy as np

from lodestone.llm import search, simhash


def test_alike_queries_stand_together():
    """Queries of two languages come in turn; a group's queries then share their terms and pass over the same blocks."""
    languages = [(7, 1000), (9, 900)]  # a widespread term of each, with its frequency
    rows = []
    for i in range(40):
        common, df = languages[i % 2]
        terms = {common: df, 100 + i: 1}
        rows.append({"query_id": i, "terms": np.array(list(terms), np.uint64).tobytes(), "dfs": np.array(list(terms.values()), np.int64).tobytes()})
    q = search.Queries(rows, 2000)
    assert sorted(q.ids.tolist()) == list(range(40))
    assert (np.diff(q.ids % 2) != 0).sum() == 1
    for i, query in enumerate(q.ids.tolist()):  # terms go with their query
        assert set(q.terms[q.starts[i] : q.starts[i + 1]].tolist()) == {languages[query % 2][0], 100 + query}


def test_a_bucket_of_near_copies_takes_little_memory():
    """Nearly all of its million pairs are links; but a forest of them is returned, and they aren't held as Python numbers."""
    fp = np.unique(np.uint64(0x5A5A << 40) ^ np.array([1 << a | 1 << b for a in range(60) for b in range(60)], np.uint64))
    tracemalloc.start()
    left, right = simhash.forest(fp, 0, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(left) == len(right) == len(fp) - 1
    assert peak < 9 << 20
