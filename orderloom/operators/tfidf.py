"""TF-IDF retrieval as posting lists: gram, document and weight are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_grams(text: Column) -> Column:
    """Words of two characters or more, and pairs of such words in a row."""
    words = F.filter(F.split(text, " "), lambda w: F.length(w) >= 2)
    pairs = F.transform(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), F.get(words, i + 1).alias("n"))), lambda x: x["n"].isNotNull()), lambda x: F.concat_ws(" ", x["w"], x["n"]))
    return F.concat(words, pairs)


def char_grams(text: Column) -> Column:
    """Three to five characters within words padded by blanks; a shorter padded word counts once whole."""
    words = F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column) -> Column:
        n = F.length(w)
        cut = lambda k: F.when(n > k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(w, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        # the first length the word doesn't exceed gives the word itself, and ends it
        whole = F.when(n <= 5, F.array(w)).otherwise(F.array().cast("array<string>"))
        return F.concat(cut(3), cut(4), cut(5), whole)

    return F.flatten(F.transform(words, of))


def _counted(df: DataFrame, keys: list[str], grams: Column) -> DataFrame:
    counts = df.select(*keys, F.explode(grams).alias("gram")).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, "gram", (F.lit(1e0) + F.log("n")).alias("tf"))


def postings(docs: DataFrame, grams: Column, scope: str = "tenant", doc: str = "item_code") -> tuple[DataFrame, DataFrame]:
    """Normalised weights (scope, doc, gram, w) and idf (scope, gram, idf) of one corpus per scope."""
    tf = _counted(docs, [scope, doc], grams)
    total = docs.groupBy(scope).agg(F.count_distinct(doc).alias("total"))
    df = tf.groupBy(scope, "gram").agg(F.count(F.lit(1)).alias("df")).join(total, scope)
    idf = df.select(scope, "gram", (F.log((F.lit(1e0) + F.col("total")) / (F.lit(1e0) + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, [scope, "gram"]).select(scope, doc, "gram", (F.col("tf") * F.col("idf")).alias("x"))
    norm = raw.groupBy(scope, doc).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, [scope, doc]).select(scope, doc, "gram", (F.col("x") / F.col("norm")).alias("w")), idf


def top_k(queries: DataFrame, docs: DataFrame, grams, k: int = 20, scope: str = "tenant", query: str = "q", doc: str = "item_code", digits: int = 8) -> DataFrame:
    """(scope, query, doc, score, place): the k best documents of each distinct query text.

    queries: scope and the normalised text in ``query``; texts are scored once
    however many rows share them. docs: scope, doc, text. Only grams both sides
    share meet; ties by doc. Scores of 0 are no candidates.
    """
    from orderloom.operators.retrieval import search

    found = search(queries, docs, {"score": grams}, k, scope=scope, query=query, doc=doc, digits=digits).select(scope, query, F.inline("found"))
    w = Window.partitionBy(scope, query).orderBy(F.desc("score"), F.asc(doc))
    return found.select(scope, query, doc, "score", F.row_number().over(w).alias("place"))
