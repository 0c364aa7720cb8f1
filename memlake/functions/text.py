"""Text functions as built-in column expressions: no Python runs for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words that tokenising drops (fixed values).
STOP_WORDS = (
    "a an and are as at be been being but by did do does for from had has have he her here him his how i if in into is it its "
    "me my of on or our she so than that the their them then there they this to up us was we were what when where which who "
    "why will with would you your"
).split()


def stem(w: Column) -> Column:
    """A light stem of a lower-case ASCII word (-ing, -ies, -ed, plural s); other words stay."""
    n = F.length(w)
    cut = lambda k: F.substring(w, 1, n - k)
    return (
        F.when(~w.rlike(r"^[\x00-\x7F]*$"), w)
        .when((n > 4) & w.endswith("ing"), cut(3))
        .when((n > 3) & w.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 3) & w.endswith("ed"), cut(2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss") & ~w.endswith("us"), cut(1))
        .otherwise(w)
    )


def tokenize(text: Column) -> Column:
    """Stemmed lower-case terms without stop words, in order; split before lower-casing. Null gives no terms."""
    words = F.split(F.coalesce(text, F.lit("")), r"[^\p{IsAlphabetic}\p{N}]+")
    lowered = F.transform(F.filter(words, lambda w: w != ""), F.lower)
    return F.transform(F.filter(lowered, lambda w: ~w.isin(STOP_WORDS)), stem)


def words(text: Column) -> Column:
    """Lower-case words, unstemmed and with stop words."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[^\p{IsAlphabetic}\p{N}]+"), F.lower), lambda w: w != "")


def normalize_subject(c: Column) -> Column:
    """Lower-case, trimmed, runs of Unicode white space as one space; idempotent."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def normalize_key(c: Column, scope: Column | None = None) -> Column:
    """The exact-match key of a cached question, within its scope."""
    key = normalize_subject(c)
    return key if scope is None else F.concat(F.coalesce(scope, F.lit("")), F.lit("\u001f"), key)


def embed_prefixes(model: str) -> tuple[str, str]:
    """The prefixes of queries and documents that a family of embedding models expects."""
    m = model.lower()
    if "nomic-embed" in m:
        return "search_query: ", "search_document: "
    return ("query: ", "passage: ") if "e5" in m else ("", "")


def token_f1(predicted: Column, gold: Column) -> Column:
    """Bag-of-words F1 of two texts; two empty ones agree."""
    p, g = words(predicted), words(gold)
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    common = F.aggregate(F.transform(F.array_distinct(p), lambda t: F.least(count(p, t), count(g, t))), F.lit(0), lambda a, x: a + x)
    precision, recall = common / F.size(p), common / F.size(g)
    both = (F.size(p) == 0) & (F.size(g) == 0)
    return F.when(both, 1.0).when((F.size(p) == 0) | (F.size(g) == 0) | (common == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))
