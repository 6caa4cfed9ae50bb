"""TF-IDF term features in exact form.

Terms are lower-cased runs of two or more letters, digits or underscores, without
stop words.  The ``max_features`` most frequent ones (ties: the smaller term) are
the columns, in code-point order; weights are tf * (ln((1 + n) / (1 + df)) + 1),
scaled to length 1.  All steps are DataFrame functions:

* term counts: one partial aggregation; only the chosen terms reach the driver;
* document frequencies: each text gives its chosen terms once, so no more than
  ``max_features`` groups meet;
* weights: narrow, in the row.  No (document, term) pair is shuffled.

The vocabulary is a parameter of the fit: another stop-word list gives the values
of a library that uses that list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx

TERM = r"[\p{L}\p{N}_]{2,}"


@dataclass(frozen=True)
class TfidfModel:
    terms: tuple[str, ...]
    n: tuple[int, ...]              # occurrences
    n_docs: tuple[int, ...]         # documents that hold the term
    idf: tuple[float, ...]


def terms_of(text: Column, stop_words=lx.STOP_WORDS) -> Column:
    """All terms of a text, in order; null counts as empty."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    stop = list(stop_words)
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def items(df: DataFrame, array: Column, out: str, *keep: str) -> DataFrame:
    """``keep`` and ``out``: a row per item of an array without nulls.  Not by
    ``explode``: for it the optimizer puts a filter on the array below the
    projection, and the array of every row is computed twice."""
    return df.select(*keep, F.explode_outer(array).alias(out)).where(F.col(out).isNotNull())


def fit(df: DataFrame, text: Column, max_features: int = 100, stop_words=lx.STOP_WORDS) -> TfidfModel:
    """The model of a text column."""
    staged = df.select(terms_of(text, stop_words).alias("t"))
    top = (items(staged, F.col("t"), "term").groupBy("term").agg(F.count("*").alias("n"))
           .orderBy(F.desc("n"), "term").limit(max_features).collect())        # at most max_features rows
    n = {r["term"]: r["n"] for r in top}
    terms = sorted(n)
    docs = df.count()
    chosen = items(staged, F.array_distinct(F.filter("t", lambda t: t.isin(terms))), "term")
    freq = chosen.groupBy("term").agg(F.count("*").alias("df")).select(
        "term", "df", (F.log(F.lit(1.0 + docs) / (1 + F.col("df"))) + 1).alias("idf")).collect() if terms else []
    df_idf = {r["term"]: (r["df"], r["idf"]) for r in freq}
    return TfidfModel(tuple(terms), tuple(n[t] for t in terms), tuple(df_idf[t][0] for t in terms), tuple(df_idf[t][1] for t in terms))


def transform(df: DataFrame, model: TfidfModel, text: Column, out: str = "tfidf", stop_words=lx.STOP_WORDS) -> DataFrame:
    """Adds ``out``: the weights of a text, one per term of the model (zeros for
    a text without any)."""
    terms = F.array(*[F.lit(t) for t in model.terms]).cast("array<string>")
    idf = F.array(*[F.lit(v) for v in model.idf]).cast("array<double>")
    kept = F.filter(terms_of(text, stop_words), lambda t: t.isin(list(model.terms)))
    raw = _bind(kept, lambda k: F.zip_with(F.transform(terms, lambda v: F.size(k) - F.size(F.array_remove(k, v))), idf, lambda a, b: a * b))
    unit = _bind(raw, lambda r: _bind(F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(
        r, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))
    return df.withColumn(out, unit)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row: as the name of a
    lambda it cannot be copied into what uses it."""
    return F.get(F.transform(F.array(value), use), 0)


def vocabulary(spark, model: TfidfModel) -> DataFrame:
    """term, n, n_docs, idf of a model."""
    return spark.createDataFrame(list(zip(model.terms, model.n, model.n_docs, model.idf, strict=True)),
                                 "term string, n long, n_docs long, idf double")
