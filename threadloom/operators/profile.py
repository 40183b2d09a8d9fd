"""Terrain of a result: where it comes from, when, what it talks about, and what it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import month_of, tokens

#: Terms of a profile, and the fewest characters of one.
TERMS, TERM_LENGTH = 8, 4


def source_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("source").agg(F.count("*").alias("n"))


def month_clusters(hits: DataFrame, stamp: str = "stamp") -> DataFrame:
    """Rows by month of their time; rows without a readable time have month null."""
    return hits.groupBy(month_of(stamp).alias("month")).agg(F.count("*").alias("n"))


def top_terms(hits: DataFrame, text: str = "text", leave_out: list[str] = (), top: int = TERMS) -> DataFrame:
    """The words that most rows hold, each row counted once; ties by word. A top-k report."""
    words = F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) >= TERM_LENGTH) & ~w.rlike("^[0-9]+$")))
    counted = hits.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counted.filter(~F.col("term").isin(*leave_out) if leave_out else F.lit(True)).orderBy(F.desc("n"), "term").limit(top)


def negative_space(hits: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Search words and the rows that hold them; a word with 0 rows is what the result lacks."""
    if not words:
        return hits.select(F.lit("").alias("word"), F.lit(0).cast("bigint").alias("n")).filter("false")
    counts = hits.select(tokens(text).alias("toks")).agg(*[F.count(F.when(F.array_contains("toks", w), 1)).alias(w) for w in words])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"`{w}`").alias("n")) for w in words])).alias("x")).select("x.word", "x.n")


def terrain(hits: DataFrame, words: list[str]) -> dict[str, DataFrame]:
    return {"sources": source_counts(hits), "months": month_clusters(hits), "terms": top_terms(hits, leave_out=words), "absent": negative_space(hits, words)}


def strongest_claim(rows: list[tuple[str, float]]) -> str | None:
    """What may be said of the leader of a ranking: more than the next ones together, or about double the next."""
    ranked = sorted(((n, v) for n, v in rows if v is not None), key=lambda r: -r[1])
    if len(ranked) < 2 or ranked[0][1] <= 0:
        return None
    lead = ranked[0][1]
    for k in range(len(ranked) - 1, 1, -1):
        if lead > sum(v for _, v in ranked[1 : k + 1]):
            return f"{ranked[0][0]} has more than the next {k} together"
    second = ranked[1][1]
    if second > 0 and lead >= 2 * second:
        return f"{ranked[0][0]} has at least double of {ranked[1][0]}"
    if second > 0 and lead >= 1.8 * second:
        return f"{ranked[0][0]} has nearly double of {ranked[1][0]}"
    return None
