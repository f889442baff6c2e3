"""Lexical retrieval: term counts, postings, BM25 over one or several fields, fuzzy terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvath.functions.text import STOPWORDS, index_terms, occurrences, query_terms
from corvath.session import cut_lineage

K1, B = 1.2, 0.75


def term_count_score(title: Column, content: Column, terms: list[str]) -> tuple[Column, Column]:
    """Whether any term stands in title or content, and 3 x its count in the title + its count in the content, summed.

    A term that comes twice in the query counts twice.
    """
    t, c = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    hit, score = F.lit(False), F.lit(0)
    for term in terms:
        hit = hit | t.contains(term) | c.contains(term)
        score = score + 3 * occurrences(t, term) + occurrences(c, term)
    return hit, F.round(F.greatest(score.cast("double"), F.lit(0.5)), 3)


def term_count_search(hits: DataFrame, query: str, limit: int, source_type: str | None = None, offset: int = 0) -> DataFrame:
    """The best hits (chunk_id, title, content, ...) by term counts, with `score`; ties by chunk_id."""
    own = hits.where(F.col("source_type") == source_type) if source_type else hits
    hit, score = term_count_score(F.col("title"), F.col("content"), query_terms(query))
    return own.where(hit).withColumn("score", score).orderBy(F.col("score").desc(), "chunk_id").offset(offset).limit(limit)


def postings(hits: DataFrame, field: str, only: list[str] | None = None) -> DataFrame:
    """chunk_id, term, tf, dl of one field; stop words aren't indexed. Where `only` is given, the postings of these terms."""
    terms = hits.select("chunk_id", index_terms(F.col(field)).alias("terms")).withColumn("dl", F.size("terms"))
    if only is not None:  # the others needn't be counted, nor moved
        terms = terms.withColumn("terms", F.filter("terms", lambda t: t.isin(only)))
    return terms.select("chunk_id", "dl", F.explode("terms").alias("term")).groupBy("chunk_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def lengths(hits: DataFrame, field: str) -> DataFrame:
    """One row: n and avgdl of the hits that have terms in a field."""
    dl = hits.select(F.size(index_terms(F.col(field))).alias("dl")).where("dl > 0")
    return dl.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def bm25(indexed: DataFrame, stats: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, score over postings for all queries at once. queries: query_id, term (each term once).

    The inverse document frequencies are the whole corpus's, whatever is filtered later. stats is one row.
    """
    wanted = indexed.join(queries.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # the one row of statistics stands beside every term's frequency
    both = df.withColumn("one", F.lit(1)).join(F.broadcast(stats.select(F.lit(1).alias("one"), F.col("n").cast("double").alias("n"), F.coalesce(F.col("avgdl").cast("double"), F.lit(1.0)).alias("avgdl"))), "one")
    # scores per posting come before the queries, so a term that many queries share is weighed once
    weighed = wanted.join(both, "term").select("term", "chunk_id", _weight(*map(F.col, ("tf", "dl", "df", "n", "avgdl"))).alias("w"))
    return weighed.join(queries, "term").groupBy("query_id", "chunk_id").agg(F.sum("w").alias("score"))


def _weight(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return idf * (tf / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avgdl)))


def bm25_multifield(hits: DataFrame, query: str, boosts: dict[str, float]) -> DataFrame:
    """chunk_id, score (4 places): for one query, the best of the fields' boosted scores.

    The texts are read and cut into words once: what stays of them are their lengths and the query's terms.
    """
    terms = [t for t in query_terms(query, distinct=True) if t not in STOPWORDS]
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(b)).alias("boost"), index_terms(F.col(f)).alias("terms")) for f, b in boosts.items()])
    each = hits.select("chunk_id", F.explode(fields).alias("x")).select("chunk_id", "x.field", "x.boost", F.size("x.terms").alias("dl"), F.filter("x.terms", lambda t: t.isin(terms)).alias("terms"))
    rows = cut_lineage(each.where("dl > 0"))
    stats = rows.groupBy("field").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    tf = rows.select("chunk_id", "field", "boost", "dl", F.explode("terms").alias("term")).groupBy("chunk_id", "field", "boost", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).join(stats, "field")
    scored = tf.join(df, ["field", "term"]).groupBy("chunk_id", "field", "boost").agg(F.sum(_weight(*map(F.col, ("tf", "dl", "df", "n", "avgdl")))).alias("score"))
    return scored.groupBy("chunk_id").agg(F.round(F.max(F.col("score") * F.col("boost")), 4).alias("score"))


def allowed_edits(term: str) -> int:
    """As usual: none up to two characters, one up to five, two beyond."""
    return 0 if len(term) < 3 else 1 if len(term) < 6 else 2


def swaps(term: str) -> list[str]:
    """The terms with two neighbouring characters exchanged: one edit, where plain edit distance counts two."""
    return sorted({term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)} - {term})


def fuzzy_terms(vocabulary: DataFrame, query: str) -> DataFrame:
    """query_term, term of the vocabulary's terms within the allowed edits of a query's terms."""
    parts = []
    for q in query_terms(query, distinct=True):
        k = allowed_edits(q)
        near = (F.levenshtein(F.col("term"), F.lit(q), k) >= 0) & (F.abs(F.length("term") - len(q)) <= k)
        if k:
            near = near | F.col("term").isin(swaps(q))
        parts.append(F.when(near, F.lit(q)))
    found = F.array_compact(F.array(*parts))
    return vocabulary.select("term", F.explode(found).alias("query_term")).select("query_term", "term")
