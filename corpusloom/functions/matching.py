"""Many terms as substrings of texts: an automaton over all terms, in Arrow batches.

A chain of substring tests costs a pass over the text for each term.  Above CHAIN terms an
automaton (Aho-Corasick) takes one pass whatever their number.  Both compare lower-cased
texts and terms, and both are exact.  Terms are a parameter: they travel with the function,
and a worker builds the automaton once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .workers import joined, parts, ship

ship(__name__)

#: So many terms are tested one after another in generated code.
CHAIN = 64
#: A list of terms that comes from a table must be no longer than this.
MOST_TERMS = 1_000_000


def needed(terms: list[str]) -> list[str]:
    """The lower-cased terms without those that hold another one: they add nothing to a test for any."""
    low = sorted({t.lower() for t in terms}, key=lambda t: (len(t), t))
    if len(low) <= CHAIN or "" in low:
        return [t for i, t in enumerate(low) if not any(s in t for s in low[:i])]
    kept: list[str] = []
    machine = automaton(low)
    for t in low:
        if not any(len(s) < len(t) for _, s in machine.iter(t)):
            kept.append(t)
    return kept


def automaton(terms: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for t in terms:
        machine.add_word(t, t)
    machine.make_automaton()
    return machine


def contains_any(c: Column, terms: list[str]) -> Column:
    """Case-insensitive: any term is a substring.  The empty term is in every text; NULL has none and gives NULL."""
    if len(set(terms)) <= CHAIN or "" in terms:
        return tx.contains_any(c, terms)
    own = needed(terms)
    held: list = []

    def found(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(automaton(own))
        has = lambda t: None if t is None else next(held[0].iter(t), None) is not None
        return joined([pa.array([has(t) for t in part.to_pylist()], pa.bool_()) for part in parts(texts)], pa.bool_())

    return F.arrow_udf(found, "boolean")(F.lower(c))


def terms_in(c: Column, terms: list[str]) -> Column:
    """The distinct terms, lower-cased and in order, that a text holds as substrings; NULL has none."""
    own = sorted({t.lower() for t in terms if t})
    held: list = []

    def found(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(automaton(own) if own else None)
        kind = pa.list_(pa.string())
        within = lambda t: sorted({s for _, s in held[0].iter(t)}) if held[0] and t else []
        return joined([pa.array([within(t) for t in part.to_pylist()], kind) for part in parts(texts)], kind)

    return F.arrow_udf(found, "array<string>")(F.lower(c))


def terms_of(df: DataFrame, column: str, most: int = MOST_TERMS) -> list[str]:
    """The distinct values of a column as a list of terms; more than ``most`` are an error."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return sorted(r[0] for r in rows)
