"""Feature preparation.

Statistics (means, medians, modes, min/max, std) are one aggregate row --
bounded by the number of columns -- applied back as literals, so scaling is
a single narrow projection.  Text vectorisation is done with DataFrame
expressions (tokens, counts, document frequencies), keeping the long
``(doc, term, value)`` form; Spark ML vectors are built only for models.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.frames import melt, numeric_columns, q
from cohortlens.functions.quantiles import exact_mode, quantile_columns
from cohortlens.session import Scratch

# Fixed value: token pattern equal to ``\w\w+`` over Unicode letters/digits.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _cols(df: DataFrame, columns, key) -> list[str]:
    return list(columns) if columns else numeric_columns(df, exclude={key} if key else ())


# ------------------------------------------------------------------------ P1
def impute(df: DataFrame, method: str = "drop", columns=None, key: str | None = "key") -> DataFrame:
    """Missing values: ``drop`` rows with any null, or fill each column with its
    ``mean`` / ``median`` (exact) / ``mode`` (smallest on ties).

    A column that is entirely null has no statistic and stays null.
    """
    cols = _cols(df, columns, key)
    if method == "drop":
        return df.na.drop(how="any")
    if method == "mean":
        row = df.agg(*[F.avg(q(c)).alias(c) for c in cols]).first()
        fill = {c: row[c] for c in cols if row[c] is not None}
    elif method in ("median", "mode"):
        # exact and distributed (no column's values buffered in one task); one row per column
        long = melt(df, [], cols, "column_name")
        stat = (quantile_columns(long, ["column_name"], "value", {"s": 0.5}) if method == "median"
                else exact_mode(long, ["column_name"], "value").withColumnRenamed("mode", "s"))
        fill = {r["column_name"]: r["s"] for r in stat.collect() if r["s"] is not None}
    else:
        raise ValueError(f"Invalid missing value handling method: {method}")
    out = df.select(*[F.coalesce(q(c), F.lit(fill[c]).cast(df.schema[c].dataType)).alias(c)
                      if c in fill else q(c) for c in df.columns])
    return out


# ------------------------------------------------------------------- P2 - P5
def scale(df: DataFrame, method: str | None = "standard", columns=None, key: str | None = "key") -> DataFrame:
    """``standard`` (population std; zero variance -> 0), ``minmax`` (constant
    column -> 0), ``normalize`` (row L2; zero rows stay 0) or ``None``."""
    cols = _cols(df, columns, key)
    keep = [q(c) for c in df.columns if c not in cols]
    if method is None or method == "none":
        return df
    if method == "standard":
        row = df.agg(*[x for c in cols for x in (F.avg(q(c)).alias(f"{c}__m"),
                                                 F.stddev_pop(q(c)).alias(f"{c}__s"))]).first()
        out = []
        for c in cols:
            m, s = row[f"{c}__m"], row[f"{c}__s"]
            v = q(c).cast("double") - F.lit(m)
            out.append((v / F.lit(s) if s else v * F.lit(0.0)).alias(c))
        return df.select(*keep, *out)
    if method == "minmax":
        row = df.agg(*[x for c in cols for x in (F.min(q(c)).alias(f"{c}__lo"),
                                                 F.max(q(c)).alias(f"{c}__hi"))]).first()
        out = []
        for c in cols:
            lo, hi = row[f"{c}__lo"], row[f"{c}__hi"]
            v = q(c).cast("double") - F.lit(lo)
            out.append((v / F.lit(float(hi - lo)) if hi is not None and hi != lo else v * F.lit(0.0)).alias(c))
        return df.select(*keep, *out)
    if method == "normalize":
        # the row norm is computed once per row, then every column is divided by it;
        # a row with a null has no norm and stays null
        norm = F.sqrt(F.aggregate(F.array(*[q(c).cast("double") for c in cols]), F.lit(0.0),
                                  lambda acc, x: acc + x * x))
        with_norm = df.withColumn("__norm", norm)
        nn = F.col("__norm")
        return with_norm.select(*keep, *[F.when(nn > 0, q(c) / nn).when(nn == 0, F.lit(0.0)).alias(c) for c in cols])
    raise ValueError(f"Invalid preprocessing method: {method}")


def preprocess(df: DataFrame, method: str = "standard", handle_missing: str = "drop", columns=None,
               key: str | None = "key") -> DataFrame:
    return scale(impute(df, handle_missing, columns, key), method, columns, key)


# ------------------------------------------------------------------- P6 / P7
def pca(df: DataFrame, k: int = 2, columns=None, key: str = "key") -> tuple[DataFrame, list[float]]:
    """Principal component scores ``(key, pc1..pck)`` and explained variance ratios.

    Columns are centred first (Spark's PCA does not centre), so scores equal
    the textbook definition up to the sign of each component.
    """
    cols = _cols(df, columns, key)
    means = df.agg(*[F.avg(q(c)).alias(c) for c in cols]).first()
    centred = df.select(key, *[(q(c) - F.lit(means[c])).alias(c) for c in cols])
    vec = VectorAssembler(inputCols=cols, outputCol="_v").transform(centred)
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    scores = model.transform(vec).select(key, vector_to_array("_p").alias("_a"))
    out = scores.select(key, *[F.col("_a")[i].alias(f"pc{i + 1}") for i in range(k)])
    return out, [float(x) for x in model.explainedVariance]


def _gram_partials(cols: list[str]):
    def run(batches):
        import numpy as np
        import pandas as pd
        d = len(cols)
        g = np.zeros((d, d))
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype="float64", na_value=0.0)
            g += x.T @ x
        iu = np.triu_indices(d)
        yield pd.DataFrame({"i": iu[0].astype("int32"), "j": iu[1].astype("int32"), "v": g[iu]})
    return run


def gram_matrix(df: DataFrame, cols: list[str]) -> np.ndarray:
    """X'X (d x d, bounded by the number of columns) of rows without nulls.

    Each task folds its Arrow batches into one d x d partial with numpy; only
    d(d+1)/2 numbers per task are shuffled and summed.
    """
    d = len(cols)
    parts = df.select(*[q(c).cast("double").alias(c) for c in cols]).mapInPandas(
        _gram_partials(cols), "i int, j int, v double")
    G = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        G[r["i"], r["j"]] = G[r["j"], r["i"]] = r["v"]
    return G


def truncated_svd(df: DataFrame, k: int = 2, columns=None, key: str = "key") -> tuple[DataFrame, list[float]]:
    """Uncentred truncated SVD scores ``X V_k``.

    The Gram matrix X'X is one distributed pass (:func:`gram_matrix`); its
    eigenvectors are the right singular vectors; scores are a projection with
    literal coefficients.  Returns the explained variance ratio of each
    component's scores.  Rows with a null feature are left out of both.
    """
    cols = _cols(df, columns, key)
    df = df.na.drop(subset=cols)
    d = len(cols)
    G = gram_matrix(df, cols)
    w, V = np.linalg.eigh(G)
    order = np.argsort(w)[::-1][:k]
    V = V[:, order]
    for c in range(V.shape[1]):  # deterministic sign: largest |coefficient| positive
        if V[np.argmax(np.abs(V[:, c])), c] < 0:
            V[:, c] = -V[:, c]
    x = F.array(*[q(c).cast("double") for c in cols])
    comps = []
    for c in range(V.shape[1]):
        coef = F.array(*[F.lit(float(V[i, c])) for i in range(d)])
        comps.append(F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), F.lit(0.0),
                                 lambda acc, v: acc + v).alias(f"pc{c + 1}"))
    out = df.select(key, *comps)
    var = out.agg(*[F.var_pop(f"pc{c + 1}").alias(f"v{c}") for c in range(V.shape[1])]).first()
    total = df.agg(reduce(lambda a, b: a + b, [F.var_pop(q(c)) for c in cols]).alias("t")).first()["t"]
    return out, [float(var[f"v{c}"] / total) if total else 0.0 for c in range(V.shape[1])]


# ------------------------------------------------------------------------ P8
def documents_from_sequences(seq: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """One document per sequence; items stay whole tokens (null items dropped)."""
    return seq.select(key, F.filter(sequence, lambda x: x.isNotNull()).alias("tokens"))


def documents_from_histories(df: DataFrame, key: str, item: str) -> DataFrame:
    """Documents of whole histories as long counts ``(key, term, n)``: every item counts (null
    items and keys dropped), and no history has to fit a row."""
    return (df.where(F.col(key).isNotNull() & F.col(item).isNotNull())
              .groupBy(key, F.col(item).alias("term")).agg(F.count(F.lit(1)).alias("n")))


def documents_from_text(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))


# ------------------------------------------------------------------- P9 / P10
def tokenize(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """Lower-case, then every maximal run of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), 0)


def term_counts(docs: DataFrame, key: str, text: str | None = "text", tokens: str | None = None) -> DataFrame:
    """(key, term, n) over whole documents."""
    tok = F.col(tokens) if tokens else tokenize(F.col(text))
    # the outer form: of the inner one Spark infers a filter that takes every text apart a second time
    return (docs.select(key, F.explode_outer(tok).alias("term")).where(F.col("term").isNotNull())
                .groupBy(key, "term").agg(F.count(F.lit(1)).alias("n")))


def vocabulary(counts: DataFrame, max_features: int | None = 1000) -> DataFrame:
    """Terms by corpus count (ties by term); the top ``max_features`` kept."""
    v = counts.groupBy("term").agg(F.sum("n").alias("corpus_n"), F.count(F.lit(1)).alias("df"))
    if max_features:
        v = v.orderBy(F.desc("corpus_n"), F.asc("term")).limit(int(max_features))
    return v


def tfidf(counts: DataFrame, key: str, max_features: int | None = 1000, n_docs: int | None = None) -> DataFrame:
    """Smoothed TF-IDF, L2-normalised per document.

    idf = ln((1 + n_docs) / (1 + df)) + 1 over the documents in ``counts``'s
    corpus (``n_docs`` -- pass the document count when some documents have
    no tokens); the vocabulary cap keeps the top terms by corpus count (the
    cap's list is bounded, so it is broadcast).
    """
    # tokenising happens once; read by column for the vocabulary with its df, and for the weights
    scratch = Scratch(counts.sparkSession, "tfidf")
    counts = scratch.keep(counts)
    if n_docs is None:
        n_docs = counts.select(key).distinct().count()
    # (key, term) pairs are unique, so a term's rows are its documents: one aggregate gives the
    # vocabulary and the document frequencies, one join the weights
    idf = (vocabulary(counts, max_features)
           .select("term", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf")))
    idf = scratch.keep(idf)
    w = counts.join(F.broadcast(idf) if max_features else idf, "term").withColumn("w", F.col("n") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("tfidf"))
