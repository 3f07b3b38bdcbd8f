"""Text search compiled to expressions or to SQL: CONTAINS and FREETEXT over one column and a constant query."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words between the words of a CONTAINS query that say nothing.
CONNECTIVES = ("and", "or", "not")


def terms(query: str) -> list[tuple[str, str]]:
    """What a CONTAINS query asks for, all of it: ("has", text) occurs, ("begins", text) begins some word."""
    query = query.strip().lower()
    if len(query) > 1 and query[0] == query[-1] == '"':
        return [("has", query[1:-1])]
    return [("begins", w[:-1]) if w.endswith("*") else ("has", w.strip('"')) for w in query.split() if w not in CONNECTIVES]


def _begins(stem: str):
    return lambda t: t.startswith(stem)


def contains(c: Column, query: str) -> Column:
    """A "phrase" occurs; else all words occur as substrings; word* begins some word. Null texts do not match."""
    hits = [F.exists(F.split(F.lower(c), r"\s+"), _begins(w)) if kind == "begins" else F.contains(F.lower(c), F.lit(w)) for kind, w in terms(query)]
    return F.coalesce(reduce(and_, hits, F.lit(True)), F.lit(False))


def freetext(c: Column, query: str) -> Column:
    """Any word of the query occurs as a substring."""
    return F.coalesce(reduce(or_, (F.contains(F.lower(c), F.lit(w)) for w in query.lower().split()), F.lit(False)), F.lit(False))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_sql(c: str, query: str) -> str:
    """contains() as SQL text."""
    hits = [f"exists(split(lower({c}), '\\\\s+'), w -> startswith(w, {_quoted(w)}))" if kind == "begins" else f"contains(lower({c}), {_quoted(w)})" for kind, w in terms(query)]
    return f"coalesce({' AND '.join(hits) or 'true'}, false)"


def freetext_sql(c: str, query: str) -> str:
    """freetext() as SQL text."""
    return f"coalesce({' OR '.join(f'contains(lower({c}), {_quoted(w)})' for w in query.lower().split()) or 'false'}, false)"
