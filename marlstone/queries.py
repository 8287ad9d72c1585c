"""The registered queries of the engine and their SQL."""

from marlstone.registered import flows, logs, search, state, texts
from marlstone.registered.search import search_entry  # noqa: F401

MODULES = [search, state, texts, logs, flows]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
