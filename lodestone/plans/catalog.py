"""All registered queries of the library's own operators."""

from lodestone.plans import columns, edges, evals, extras, judged, judges, ranked, roundtrips, sessions

PARTS = [columns, ranked, sessions, judged, evals, judges, edges, extras, roundtrips]
QUERIES: dict = {}
ORACLES: dict = {}
for part in PARTS:
    QUERIES |= part.Q
    ORACLES |= part.S
