"""Text search: terms, matches, ranks and the reasons for an empty answer."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_TERM = 3
LIMIT = 20
#: Fixed values of the public ranking formula.
K1, B = 1.2, 0.75


def search_terms(query: str) -> list[str]:
    """Runs of letters, digits and underscores of at least three characters, lower-cased."""
    return list(dict.fromkeys(t.lower() for t in re.findall(r"\w+", query) if len(t) >= LEAST_TERM))


def matches_any(text: Column, query: str) -> Column:
    """Whether the text holds any term anywhere, whatever the case."""
    terms = search_terms(query)
    return reduce(lambda a, b: a | b, (F.lower(text).contains(t) for t in terms), F.lit(False))


def count_matches(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """(documents, indexed, matched)."""
    return docs.agg(F.count("*").alias("documents"), F.count(text).alias("indexed"), F.count_if(F.coalesce(matches_any(F.col(text), query), F.lit(False))).alias("matched"))


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs, overlaps included."""
    return F.size(F.regexp_extract_all(text, F.lit(f"(?=({re.escape(term)}))"), F.lit(1)))


def search(docs: DataFrame, query: str, key: str = "id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, score): the best matches by BM25 over trigram lengths, statistics of all documents.

    One pass gathers the length sum and each term's document count (a row for each task), another scores matching rows only.
    """
    terms = search_terms(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).filter(F.lit(False))
    low, size = F.lower(F.col(text)), F.greatest(F.length(text) - 2, F.lit(0))
    stats = docs.filter(F.col(text).isNotNull()).agg(F.count("*").alias("n"), F.avg(size).alias("mean"), *(F.count_if(low.contains(t)).alias(f"df{i}") for i, t in enumerate(terms))).head()
    score: Column = F.lit(0.0)
    for i, term in enumerate(terms):
        idf = max(1e-6, __import__("math").log((stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))) if stats["n"] else 0.0
        tf = occurrences(low, term)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / (stats["mean"] or 1.0)))
    found = docs.filter(F.coalesce(matches_any(F.col(text), query), F.lit(False))).select(key, score.alias("score"))
    return found.orderBy(F.desc("score"), key).limit(limit)


def property_value_matches(long: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """(property, value, n): measured values (property, state, value) that hold a term, most frequent first."""
    found = long.filter((F.col("state") == "measured") & F.coalesce(matches_any(F.col("value"), query), F.lit(False)))
    return found.groupBy("property", "value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "property", "value").limit(limit)


def assist_reason(rows: int, entries: int, indexed: int) -> str:
    """Why a search returned what it did."""
    return "rows-returned" if rows else "type-empty" if not entries else "nothing-indexed" if not indexed else "no-match"


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")
