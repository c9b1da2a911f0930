"""Ranked full-text search over page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from quire.functions import text as X
from quire.session import durable, pinned

MAX_TOKENS = 12
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
FACETS = ("unit", "course", "document_type", "academic_year")
MARK_START, MARK_END, ELLIPSIS = "\u0002", "\u0003", "…"


def query_tokens(spark, query: str) -> list[str]:
    """The words of a query in matching form, at most twelve; each is a prefix and all must occur."""
    norm = spark.range(1).select(X.normalize(F.lit(query)).alias("n")).first().n
    return norm.split()[:MAX_TOKENS]


def solid(text: str) -> Column:
    return F.trim(F.regexp_replace(F.col(text), "\\s+", " ")) != ""


def page_index(pages: DataFrame, text: str = "text") -> DataFrame:
    """Searchable pages: blank ones left out, both text columns in their folded form, and the page
    length in tokens of both."""
    folded = F.lower(X.strip_accents(F.col(text)))
    # every figure below reads the folded forms, which cost the most
    return (pinned(pages.filter(solid(text)), pages.columns, folded=folded, norm=X.normalize(text))
            .withColumn("length", F.regexp_count("folded", F.lit("[\\p{L}\\p{N}]+"))
                        + X.word_count("norm")))


def postings(index: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """term, page, occurrences over both columns."""
    tokens = F.concat(F.filter(F.split("folded", "[^\\p{L}\\p{N}]+"), lambda t: t != ""),
                      X.words("norm"))
    return (index.select(*keys, F.explode(tokens).alias("term"))
            .groupBy("term", *keys).agg(F.count("*").alias("tf")))


def term_statistics(index: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Pages and occurrences per term. Terms are reduced inside each page, so that the shuffle
    carries one row per term and task."""
    tokens = F.concat(F.filter(F.split("folded", "[^\\p{L}\\p{N}]+"), lambda t: t != ""),
                      X.words("norm"))
    listed = index.select(F.explode(tokens).alias("term"))
    paged = index.select(F.explode(F.array_distinct(tokens)).alias("term"))
    both = (listed.select("term", F.lit(1).alias("tf"), F.lit(0).alias("df"))
            .unionByName(paged.select("term", F.lit(0).alias("tf"), F.lit(1).alias("df"))))
    return both.groupBy("term").agg(F.sum("df").alias("pages"), F.sum("tf").alias("occurrences"))


def _occurrences(token: str) -> Column:
    # the literal comes first, so that few positions reach the look-behind
    return (F.regexp_count("folded", F.lit(f"{token}(?<![\\p{{L}}\\p{{N}}]{token})"))
            + F.regexp_count("norm", F.lit(f"{token}(?<![a-z0-9]{token})")))


def visible_to(viewer: str, strict: bool = False) -> Column:
    """Own pages, and those of others that are not private (`strict`: only public ones)."""
    others = F.col("visibility") == "public" if strict else F.col("visibility") != "private"
    return (F.col("owner") == viewer) | others


def search(index: DataFrame, query: str, viewer: str | None = None,
           filters: dict[str, str] | None = None, limit: int = 50,
           keep: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Pages that hold every query word as a prefix, best first (lower score is better).

    One pass over the index: the corpus figures are observed while the matching pages are written.
    """
    spark = index.sparkSession
    tokens = query_tokens(spark, query)
    keys = [c for c in ("doc_id", "page") if c in index.columns]
    if not tokens:
        return index.limit(0).select(*keys, *keep, F.lit(0.0).alias("score"))
    counted = index.select(
        *dict.fromkeys([*keys, *keep, *(c for c in ("owner", "visibility") if viewer is not None),
                        *(f for f in FACETS if (filters or {}).get(f) is not None)]),
        "length", *[_occurrences(t).alias(f"_tf{i}") for i, t in enumerate(tokens)])
    counted, corpus = with_figures(counted, len(tokens), F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))
    wanted = allowed(viewer, filters, strict)
    for i in range(len(tokens)):
        wanted = wanted & (F.col(f"_tf{i}") > 0)
    hits = durable(counted.filter(wanted), "hits")
    figures = corpus.get
    return ranked(hits, figures, figures["n"] or 0, figures["total"] or 0, len(tokens), keys, keep, limit)


def with_figures(counted: DataFrame, words: int, *more: Column) -> tuple[DataFrame, Observation]:
    """The pages each word is on, observed while `counted` is read."""
    seen = Observation()
    return counted.observe(seen, *more, *[F.sum(F.when(F.col(f"_tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(words)]), seen


def allowed(viewer: str | None, filters: dict[str, str] | None, strict: bool = False) -> Column:
    wanted = F.lit(True)
    if viewer is not None:
        wanted = wanted & visible_to(viewer, strict)
    for facet in FACETS:
        value = (filters or {}).get(facet)
        if value is not None:
            wanted = wanted & (F.col(facet) == value)
    return wanted


def ranked(hits: DataFrame, figures: dict, n: int, total: int, words: int, keys: list[str], keep: tuple[str, ...], limit: int) -> DataFrame:
    """The best of the hits; `n` pages of `total` words in all, df of each word in `figures`."""
    average = total / n if n else 1.0
    score = F.lit(0.0)
    for i in range(words):
        df = figures[f"df{i}"] or 0
        idf = F.greatest(F.log(F.lit((n - df + 0.5) / (df + 0.5))), F.lit(IDF_FLOOR))
        tf = F.col(f"_tf{i}").cast("double")
        norm = 1 - B + B * F.col("length") / F.lit(float(average))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * norm)
    return (hits.select(*keys, *[k for k in keep if k not in keys],
                        F.round(-score, 6).alias("score"))
            .orderBy("score", *keys).limit(limit))


def snippet(text: Column | str, tokens: list[str], size: int = 16) -> Column:
    """Up to `size` words of the text around the first match, matches marked."""
    text = F.col(text) if isinstance(text, str) else text
    listed = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    folded = F.transform(listed, lambda w: F.regexp_replace(
        F.lower(X.strip_accents(w)), "^[^\\p{L}\\p{N}]+", ""))
    pattern = "^(" + "|".join(tokens) + ")"
    flags = F.transform(folded, lambda w: w.rlike(pattern))
    first = F.greatest(F.array_position(flags, F.lit(True)).cast("int"), F.lit(1))
    total = F.size(listed)
    start = F.greatest(F.least(first - 7, total - size + 1), F.lit(1))
    pieces = F.zip_with(F.slice(listed, start, F.lit(size)), F.slice(flags, start, F.lit(size)),
                        lambda w, hit: F.when(hit, F.concat(F.lit(MARK_START), w, F.lit(MARK_END)))
                        .otherwise(w))
    return F.concat(F.when(start > 1, F.lit(ELLIPSIS)).otherwise(""), F.array_join(pieces, " "),
                    F.when(start + size - 1 < total, F.lit(ELLIPSIS)).otherwise(""))
