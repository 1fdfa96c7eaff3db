"""All registered queries of the library and their DuckDB SQL."""

from . import evaluate, intervals, repeats, rollup, scorer, sequences, sources, structure

MODULES = (intervals, evaluate, scorer, sequences, rollup, repeats, structure, sources)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
