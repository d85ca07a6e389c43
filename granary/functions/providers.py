"""Stand-ins for hosted models: deterministic, offline, as column expressions. They don't reach a hosted model's quality.

Pass other functions of the same form to use a model.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import context_block, tokens


#: Entries of the vectors that stand in for a hosted model's.
DIMS = 64


def bucket(term: Column) -> Column:
    """The entry of a vector that a term counts in: the first 32 bits of its md5."""
    return (F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long") % DIMS).cast("int")


def overlap_planner(sentences: Column, least: float = 0.15) -> Column:
    """Breaks where neighbouring sentences share less than this part of their words."""
    bags = F.transform(sentences, lambda s: F.array_distinct(tokens(s)))

    def apart(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return F.size(F.array_intersect(a, b)) < least * F.greatest(F.size(F.array_union(a, b)), F.lit(1))

    # neighbours by zip, so that every sentence is cut into tokens twice only, however often places are asked for
    pairs = F.zip_with(F.slice(bags, F.lit(1), F.greatest(F.size(sentences) - 1, F.lit(0))), F.slice(bags, F.lit(2), F.greatest(F.size(sentences) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    flagged = F.transform(pairs, lambda p, i: F.when(apart(p), i))
    return F.when(F.size(sentences) > 1, F.filter(flagged, lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))


def passage(query: Column) -> Column:
    """A hypothetical passage that answers a query."""
    return F.concat(F.lit("The following passage answers the question. "), query)


def answer(query: Column, contexts: Column) -> Column:
    return F.concat(F.lit("Question: "), query, F.lit("\n\nContext:\n"), context_block(contexts))


def judge(answer: Column, reference: Column) -> Column:
    """1 if the answer holds the reference, else 0."""
    return F.coalesce(F.contains(F.lower(answer), F.lower(reference)).cast("int"), F.lit(0))
