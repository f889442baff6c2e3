"""Re-ranking: title, authority, freshness and phrase signals, their product and their explanation."""

from __future__ import annotations

import math
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvath.functions.text import query_terms, words

# How far kinds of sources are trusted, and which hosts more than others.
AUTHORITY = {"note": 1.30, "upload": 1.20, "code": 1.15, "web": 1.00}
CURATED = ("docs.", "wiki.", "developer.", "github.io")
HALF_LIFE_DAYS = 90.0
WINDOW = 15


def base_score(score: Column) -> Column:
    return F.greatest(F.lit(0.1), F.round(F.coalesce(F.nullif(score.cast("double"), F.lit(0.0)), F.lit(1.0)), 4))


def title_boost(title: Column, anchor: Column, query: str) -> Column:
    """1 + 0.5 for the query in the title, or 0.3 for all its terms, or 0.2 x their share; + 0.1 for a term in the anchor."""
    q, terms = query.strip().lower(), query_terms(query, distinct=True)
    t, a = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(anchor, F.lit("")))
    matched = sum((F.when(t.contains(x), 1).otherwise(0) for x in terms), F.lit(0))
    part = F.when(matched > 0, F.round(F.lit(0.2) * matched / F.lit(float(len(terms))), 2)).otherwise(0.0)
    own = F.when(t.contains(q), 0.5).when(matched == len(terms), 0.3).otherwise(part)
    in_anchor = F.lit(False)
    for x in terms:
        in_anchor = in_anchor | a.contains(x)
    return F.round(F.least(F.lit(1.6), F.lit(1.0) + own + F.when(in_anchor, 0.1).otherwise(0.0)), 3)


def authority_boost(source_type: Column, host: Column) -> Column:
    known = F.lit(1.0)
    for k, v in AUTHORITY.items():
        known = F.when(source_type == k, v).otherwise(known)
    curated = F.lit(False)
    for part in CURATED:
        curated = curated | F.coalesce(host, F.lit("")).contains(part)
    return F.round(known + F.when((source_type == "web") & curated, 0.1).otherwise(0.0), 3)


def freshness_boost(created_at: Column, as_of: datetime) -> Column:
    """From 1 towards 0.5 with a half life of 90 days; 0.9 where the time isn't known; the future counts as now."""
    days = F.greatest(F.lit(0.0), (F.lit(int(as_of.timestamp() * 1_000_000)) - F.unix_micros(created_at)) / F.lit(86_400_000_000.0))
    value = F.lit(0.5) + F.lit(0.5) * F.exp(F.lit(-math.log(2) / HALF_LIFE_DAYS) * days)
    return F.when(created_at.isNull(), 0.9).otherwise(F.round(F.greatest(F.lit(0.5), F.least(F.lit(1.0), value)), 3))


def phrase_boost(content: Column, query: str) -> Column:
    """1.25 for the terms in a row, 1.1 for all of them within 15 words, else 1; always 1 for a single term."""
    terms = [t for t in re.findall(r"\w+", query.lower()) if len(t) > 1]
    if len(terms) < 2:
        return F.lit(1.0)
    text, distinct = F.lower(F.coalesce(content, F.lit(""))), sorted(set(terms))
    row = "(?U)\\b" + "\\s+".join(map(re.escape, terms)) + "\\b"
    w = words(text)
    # a window that holds all terms may as well start at one of them
    all_in = lambda x: F.forall(F.array(*map(F.lit, distinct)), lambda t: F.array_contains(x, t))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w))), lambda i: F.coalesce(F.get(w, i - 1).isin(distinct), F.lit(False)))
    near = all_in(w) & F.exists(starts, lambda i: all_in(F.slice(w, i, F.lit(WINDOW))))
    return F.when(text.rlike(row), 1.25).when(near, 1.1).otherwise(1.0)


def rerank(hits: DataFrame, query: str, as_of: datetime) -> DataFrame:
    """hits with base, title_boost, authority_boost, freshness_boost, phrase_boost, final_score and explanation.

    hits: chunk_id, title, content, source_type, created_at, score and, where there are, anchor_label and host.
    """
    have = set(hits.columns)
    optional = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    scored = hits.withColumns(
        {
            "base": base_score(F.col("score")), "title_boost": title_boost(F.col("title"), optional("anchor_label"), query),
            "authority_boost": authority_boost(F.col("source_type"), optional("host")), "freshness_boost": freshness_boost(F.col("created_at"), as_of), "phrase_boost": phrase_boost(F.col("content"), query),
        }
    )
    # exact halves go up, whichever way the last bit of the product falls
    final = F.round(F.col("base") * F.col("title_boost") * F.col("authority_boost") * F.col("freshness_boost") * F.col("phrase_boost") + F.lit(1e-9), 4)
    return scored.withColumn("final_score", final).withColumn("explanation", explanation(have, query, as_of))


def explanation(have: set[str], query: str, as_of: datetime) -> Column:
    """What made up a hit's score, a line for each signal that there is."""
    optional = lambda c: F.col(c) if c in have else F.lit(None)
    fixed = lambda c, n: F.format_string(f"%.{n}f", c)
    ranks = F.lit(None).cast("string")
    if {"lexical_rank", "semantic_rank"} <= have:
        lex, sem = F.col("lexical_rank"), F.col("semantic_rank")
        ranks = (
            F.when(lex.isNotNull() & sem.isNotNull(), F.concat(F.lit("Ranks: lexical #"), lex, F.lit(", semantic #"), sem))
            .when(lex.isNotNull(), F.concat(F.lit("Lexical rank #"), lex)).when(sem.isNotNull(), F.concat(F.lit("Semantic rank #"), sem))
        )
    in_anchor = F.lit(False)
    for x in query_terms(query, distinct=True):
        in_anchor = in_anchor | F.lower(F.coalesce(optional("anchor_label").cast("string"), F.lit(""))).contains(x)
    curated = F.lit(False)
    for x in CURATED:
        curated = curated | F.coalesce(optional("host").cast("string"), F.lit("")).contains(x)
    days = F.greatest(F.lit(0.0), (F.lit(int(as_of.timestamp() * 1_000_000)) - F.unix_micros("created_at")) / F.lit(86_400_000_000.0))
    age = (
        F.when(F.col("created_at").isNull(), "unknown age").when(days < 1, "today").when(days < 30, F.concat(F.floor(days).cast("string"), F.lit(" days")))
        .when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit(" months"))).otherwise(F.concat(fixed(days / 365, 1), F.lit(" years")))
    )
    similarity = optional("semantic_score").cast("double")
    return F.array_compact(
        F.array(
            F.concat(F.when(optional("rrf_score").isNotNull(), "Fused base: ").otherwise("Base: "), fixed(F.col("base"), 4)),
            F.when(F.col("title_boost") > 1, F.concat(F.lit("Title: x"), fixed(F.col("title_boost"), 2))), F.when(in_anchor, "Anchor: a term of the query"),
            F.concat(F.lit("Authority of "), F.coalesce("source_type", F.lit("unknown")), F.lit(": x"), fixed(F.col("authority_boost"), 2)),
            F.when((F.col("source_type") == "web") & curated, "Curated host"),
            F.concat(F.lit("Freshness: x"), fixed(F.col("freshness_boost"), 3), F.lit(" ("), age, F.lit(")")),
            F.when(F.col("phrase_boost") > 1, F.concat(F.lit("Phrase: x"), fixed(F.col("phrase_boost"), 2))),
            F.when(similarity.isNotNull(), F.concat(F.lit("Similarity: "), fixed(similarity, 3))), ranks,
        )
    )
