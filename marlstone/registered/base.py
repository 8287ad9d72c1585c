"""A registry of queries with their SQL."""

from __future__ import annotations

from marlstone.plans.views import with_views

_LINES = r"string_split_regex(regexp_replace({0}, '\r\n', chr(10), 'g'), '[\n\r\x0B\f\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"


def lines_sql(text: str) -> str:
    """The lines of a text in DuckDB; no last empty one."""
    cut = _LINES.format(text)
    return f"(case when {cut}[-1] = '' then {cut}[:-2] else {cut} end)"


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, sql: str | None = None, *views: str):
        """Decorate a function of (spark, sf_dir); sql is its twin in DuckDB over the named views."""

        def add(f):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = with_views(sql, *views) if views else sql
            return f

        return add
