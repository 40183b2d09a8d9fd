"""Ranked full-text search, its LIKE floor, and the union over the archive's text sources."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import author, fold, fold_text, like_all, like_any, tokens
from threadloom.model import SEARCH_EXCLUDED, current, thinking_blocks

# Constants of the ranking function.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Hits of a search, and of each of its branches, by default.
TOP = 20


def postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The index: ``(token, key, col, tf, positions)``. Frequencies combine before the shuffle by token."""
    parts = [df.select(key, F.lit(c).alias("col"), F.posexplode(tokens(c)).alias("pos", "token")) for c in columns]
    return reduce(DataFrame.unionByName, parts).groupBy("token", key, "col").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def doc_lengths(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.select(key, reduce(Column.__add__, [F.size(tokens(c)) for c in columns]).alias("length"))


def _equals(word: str):
    return lambda x: x == word


def _statistics(base: DataFrame, words: list[str]) -> dict:
    """Rows, average length and document frequencies: one aggregate, one row on the driver."""
    held = [F.count(F.when(F.array_contains("own", w), 1)).alias(f"n{i}") for i, w in enumerate(words)]
    return base.agg(F.count("*").alias("rows"), F.avg(F.size("toks")).alias("average"), *held).first().asDict()


def bm25(df: DataFrame, key: str, columns: list[str], words: list[str], match: str = "all", only: list[str] | None = None, carry: list[str] = ()) -> DataFrame:
    """``(key, *carry, rank)`` of rows that hold all or any of the words; more negative is better.

    ``only`` restricts where words may stand; lengths still count all ``columns``. The text is read
    twice, nothing of it is shuffled. Null text is empty; no words match nothing.
    """
    words = list(dict.fromkeys(fold_text(w) for w in words))
    held = only or columns
    every = F.concat(*[tokens(c) for c in columns])
    base = df.select(key, *carry, *columns, every.alias("toks"), (F.concat(*[tokens(c) for c in held]) if only else every).alias("own"))
    if not words:
        return base.select(key, *carry, F.lit(0.0).alias("rank")).filter("false")
    stats = _statistics(base, words)
    average, join = stats["average"], Column.__and__ if match == "all" else Column.__or__
    # a substring test on the raw text is cheap and leaves few rows to cut into tokens a second time
    near = [reduce(Column.__or__, [F.coalesce(fold(c).contains(w), F.lit(False)) for c in held]) for w in words]
    base = base.filter(reduce(join, near)).filter(reduce(join, [F.array_contains("own", w) for w in words]))
    score = F.lit(0.0)
    for i, w in enumerate(words):
        n, rows = stats[f"n{i}"], stats["rows"]
        idf = max(math.log((rows - n + 0.5) / (n + 0.5)), IDF_FLOOR)
        tf = F.size(F.filter("own", _equals(w)))
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("toks") / F.lit(average or 1.0)))
    return base.select(key, *carry, (-score).alias("rank"))


def rank_postings(index: DataFrame, lengths: DataFrame, key: str, words: list[str]) -> DataFrame:
    """``bm25`` over a stored index: only the postings of the query's words are read."""
    words = list(dict.fromkeys(fold_text(w) for w in words))
    stats = lengths.agg(F.count("*").alias("rows"), F.avg("length").alias("average")).first()
    own = index.filter(F.col("token").isin(words)).groupBy(key, "token").agg(F.sum("tf").alias("tf"))
    frequency = own.groupBy("token").agg(F.count("*").alias("n"))  # one row a word of the query
    idf = F.greatest(F.log((F.lit(stats["rows"]) - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(IDF_FLOOR))
    scored = own.join(F.broadcast(frequency), "token").join(lengths, key)
    one = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(stats["average"])))
    return scored.groupBy(key).agg((-F.sum(one)).alias("rank"), F.count("*").alias("words"))


def phrase_rows(df: DataFrame, columns: list[str], phrase: str) -> DataFrame:
    """Rows in which the words of the phrase stand side by side in one of the columns."""
    needle = " " + " ".join(fold_text(phrase).split()) + " "
    return df.filter(reduce(Column.__or__, [F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" ")).contains(needle) for c in columns]))


def layer_filter(memories: DataFrame, layer: str | None = None) -> DataFrame:
    """Memories of one layer, or of all layers that search does not leave out."""
    return memories.filter(F.col("layer") == layer) if layer else memories.filter(~F.coalesce(F.col("layer").isin(*SEARCH_EXCLUDED), F.lit(False)))


def spoken(exchanges: DataFrame) -> DataFrame:
    """Exchanges whose question is not a notification of a task."""
    return exchanges.filter(~F.coalesce(F.col("human_text").ilike("<task-notification%"), F.lit(False)))


def _branches(tables: dict[str, DataFrame], layer: str | None) -> list[tuple[str, int, DataFrame, str, list[str], list[str]]]:
    """(source, priority, rows, key, indexed columns, columns that may match) of every text source."""
    out = []
    if "memories" in tables:
        rows = layer_filter(current(tables["memories"]), layer).withColumn("by", author("source_agent", "source_model", "source_surface"))
        out.append(("memory", 0, rows.withColumn("text", F.col("content")).withColumn("stamp", F.col("created_at")), "id", ["content"], ["content"]))
    if "exchanges" in tables and layer is None:
        rows = tables["exchanges"].withColumn("by", F.coalesce("model", F.lit("unknown"))).withColumn("stamp", F.col("human_timestamp"))
        out.append(("exchange", 1, rows.withColumn("text", F.col("agent_text")), "id", ["human_text", "agent_text"], ["agent_text"]))
        out.append(("human", 1, spoken(rows).withColumn("text", F.col("human_text")), "id", ["human_text", "agent_text"], ["human_text"]))
        thinking = thinking_blocks(tables["exchanges"]).withColumn("by", F.lit("unknown")).withColumn("stamp", F.lit(None).cast("string"))
        out.append(("thinking", 2, thinking.withColumn("text", F.col("full_text")), "id", ["full_text"], ["full_text"]))
    return out


def search(tables: dict[str, DataFrame], words: list[str], match: str = "all", layer: str | None = None, top: int = TOP) -> DataFrame:
    """Best hits of every source, then of all: memories first, then exchanges, then reasoning, by rank within.

    A layer leaves only memories. Each branch is cut to its top hits before the union.
    """
    parts = []
    for source, priority, rows, key, columns, only in _branches(tables, layer):
        ranked = bm25(rows, key, columns, words, match, only if only != columns else None, carry=["text", "stamp", "by"])
        best = ranked.filter(F.trim("text") != "").orderBy("rank", key).limit(top)
        parts.append(best.select(F.lit(source).alias("source"), F.lit(priority).alias("priority"), F.col(key).cast("string").alias("id"), "text", "stamp", "by", "rank"))
    return reduce(DataFrame.unionByName, parts).orderBy("priority", "rank", "source", "id").limit(top)


def like_search(tables: dict[str, DataFrame], words: list[str], match: str = "all", layer: str | None = None) -> DataFrame:
    """The floor without ranking: substring hits, questions once for each session, time and text, all sources stacked."""
    hit = like_all if match == "all" else like_any
    parts = []
    for source, priority, rows, key, _, only in _branches(tables, layer):
        found = rows.filter(reduce(Column.__or__, [hit(c, words) for c in only]))
        if source == "human":
            found = found.groupBy("session_id", "human_timestamp", "text").agg(F.min(key).alias(key), F.first("stamp").alias("stamp"), F.first("by").alias("by"))
        parts.append(found.select(F.lit(source).alias("source"), F.lit(priority).alias("priority"), F.col(key).cast("string").alias("id"), "text", "stamp", "by"))
    return reduce(DataFrame.unionByName, parts)


def dedup_hits(hits: DataFrame) -> DataFrame:
    """One hit for each source and text, the best one."""
    best = F.min(F.struct("priority", "rank", "id", "stamp", "by")).alias("b")
    return hits.groupBy("source", "text").agg(best).select("source", "text", "b.priority", "b.rank", "b.id", "b.stamp", "b.by")


def rerank(hits: DataFrame, question: str) -> DataFrame:
    """A stable order: memories, then the rest, then reasoning; a text that quotes the question goes one place back within its kind."""
    kind = F.when(F.col("source") == "memory", 0).when(F.col("source") == "thinking", 20).otherwise(10)
    quoted = F.when(F.lower("text").contains(question.lower()), 1).otherwise(0)
    return hits.withColumn("order", kind + quoted).orderBy("order", "rank", "id")


def rescue(tables: dict[str, DataFrame], words: list[str], top: int = 100) -> DataFrame:
    """Any-word search over all sources without repeats, newest first among equals; empty without words."""
    hits = dedup_hits(search(tables, words, "any", top=top))
    return hits.orderBy("priority", "rank", F.coalesce("stamp", F.lit("")).desc(), "id").limit(top)
