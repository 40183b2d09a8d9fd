"""Chunks, embeddings, quantized shortlists and exact nearest neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import framed_digest

# Characters of a chunk and of the overlap of two chunks, hits and shortlist of a search.
CHUNK, OVERLAP = 4_000, 400
MOST_HITS, SHORTLIST = 100, 800
#: Words put before a text when it is embedded as document or as query.
DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "


def chunks(df: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(key, chunk_index, chunk)``: windows with overlap, no window that repeats only the overlap. Empty and null texts have none."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - F.lit(overlap + 1), F.lit(0)), F.lit(size - overlap))
    cut = F.transform(starts, lambda i: F.substring(F.col(text), i + 1, F.lit(size)))
    return df.filter(F.length(text) > 0).select(key, F.posexplode(cut).alias("chunk_index", "chunk"))


def chunk_identity(frame: DataFrame, kind: str, key: str, chunk: str = "chunk") -> DataFrame:
    """The chunk's locator and the digest by which a stored embedding is known to be of this text."""
    return frame.withColumn("locator", F.concat(F.lit(kind + ":"), F.col(key).cast("string"))).withColumn("fingerprint", framed_digest(F.lit(kind), F.col(key).cast("string"), chunk))


def chunk_delta(desired: DataFrame, stored: DataFrame) -> DataFrame:
    """``(locator, chunk_index, action)``: added, updated, unchanged or removed, by fingerprint."""
    keys = ["locator", "chunk_index"]
    both = desired.select(*keys, F.col("fingerprint").alias("want")).join(stored.select(*keys, F.col("fingerprint").alias("have")), keys, "full_outer")
    action = F.when(F.col("have").isNull(), "added").when(F.col("want").isNull(), "removed").when(F.col("want") == F.col("have"), "unchanged").otherwise("updated")
    return both.select(*keys, action.alias("action"))


def reusable(desired: DataFrame, old: DataFrame) -> DataFrame:
    """Desired chunks whose embedding an older store already holds under the same fingerprint and place."""
    held = old.select("fingerprint", "chunk_index", "embedding").dropDuplicates(["fingerprint", "chunk_index"])
    return desired.join(held, ["fingerprint", "chunk_index"], "left")


def hash_embedder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An offline stand-in for an embedding service: signed hashed words, unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % dimensions] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    return run


def embed(frame: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]] | None = None, prefix: str = DOCUMENT_PREFIX, batch: int = 64) -> DataFrame:
    """``frame`` with ``embedding``; the embedder gets at most ``batch`` texts at once."""
    run = embedder or hash_embedder()

    @F.pandas_udf("array<float>")
    def of(texts: pd.Series) -> pd.Series:
        values = [prefix + (t or "") for t in texts]
        return pd.Series([v for at in range(0, len(values), batch) for v in run(values[at : at + batch])], dtype=object)

    return frame.withColumn("embedding", of(text))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def quantized(embedding: Column) -> Column:
    """A vector in one byte a component, relative to its largest; a null or zero vector stays null or zero."""
    most = F.greatest(F.array_max(F.transform(embedding, lambda x: F.abs(x))), F.lit(1e-30))
    return F.transform(embedding, lambda x: F.round(x / most * 127).cast("tinyint"))


def sign_bits(embedding: Column) -> Column:
    """The one-bit form of a vector as longs of 64 signs, for storage beside the floats."""
    n = F.size(embedding)
    words = F.sequence(F.lit(0), F.ceil(n / 64).cast("int") - 1)
    return F.transform(words, lambda w: F.aggregate(F.slice(embedding, w * 64 + 1, F.lit(64)), F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))))


def knn(df: DataFrame, key: str, embedding: str, query: list[float], k: int = 10, shortlist: int | None = None, source: str | None = None, small: str | None = None) -> DataFrame:
    """``(key, score)`` of the k nearest by cosine, ties by key.

    With ``shortlist`` only that many rows of best cosine between query and ``quantized`` vector (the column
    ``small`` where it is stored) are measured exactly; with ``source`` each source gives its best row only. k is at most MOST_HITS.
    """
    if not 1 <= k <= MOST_HITS:
        raise ValueError(f"k is 1 to {MOST_HITS}")
    target = F.array(*[F.lit(float(x)) for x in query])
    rows = df.filter(F.size(embedding) == len(query))
    if shortlist:
        rows = rows.withColumn("near", cosine(F.col(small) if small else quantized(F.col(embedding)), target)).orderBy(F.desc("near"), key).limit(shortlist)
    scored = rows.withColumn("score", cosine(F.col(embedding), target))
    if source:
        best = W.partitionBy(source).orderBy(F.desc("score"), key)
        scored = scored.withColumn("place", F.row_number().over(best)).filter("place = 1")
    return scored.select(key, "score", *([source] if source else [])).orderBy(F.desc("score"), key).limit(k)


def knn_block(df: DataFrame, key: str, embedding: str, queries: list[tuple[object, list[float]]], k: int = 10, shortlist: int | None = None) -> DataFrame:
    """``(query, key, score)`` of the k nearest of every query of one block, by cosine, ties by key.

    The block is sent to every task; each Arrow batch gives its best rows of every query, so what is
    shuffled is k rows a query and batch. With ``shortlist`` only that many rows a batch of best quantized
    cosine are measured exactly. Null vectors and those of another size are left out.
    """
    ids, targets = [q for q, _ in queries], np.array([v for _, v in queries], dtype=np.float64).reshape(len(queries), -1)
    targets = targets / np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-30)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch) or not ids:
                continue
            keys, rows = batch["k"].to_numpy(), np.stack(batch["e"].to_numpy()).astype(np.float64)
            unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)
            exact = targets @ unit.T
            if shortlist and shortlist < len(keys):
                small = np.rint(rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1e-30) * 127)
                near = targets @ (small / np.maximum(np.linalg.norm(small, axis=1, keepdims=True), 1e-30)).T
                cut = np.partition(near, -shortlist, axis=1)[:, -shortlist][:, None]
                exact = np.where(near >= cut, exact, -np.inf)
            for i, q in enumerate(ids):
                best = np.lexsort((keys, -exact[i]))[:k]
                yield pd.DataFrame({"query": q, "key": keys[best], "score": exact[i][best]})

    kinds = dict(df.dtypes)
    held = df.filter(F.size(embedding) == targets.shape[1]).select(F.col(key).alias("k"), F.col(embedding).alias("e"))
    found = held.mapInPandas(run, f"query {kinds[key]}, key {kinds[key]}, score double").filter("score > double('-infinity')")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))  # k rows a batch of rows
    return found.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def recall(df: DataFrame, key: str, embedding: str, queries: list[tuple[object, list[float]]], k: int, shortlist: int) -> DataFrame:
    """``(queries, recall)`` of the shortlist against the exact neighbours of one block of queries."""
    exact = knn_block(df, key, embedding, queries, k)
    found = knn_block(df, key, embedding, queries, k, shortlist).select("query", "key", F.lit(1).alias("hit"))
    return exact.join(found, ["query", "key"], "left").agg(F.count_distinct("query").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))


def federated_knn(stores: dict[str, tuple[str, DataFrame]], key: str, embedding: str, queries: dict[str, list[float]], k: int = 10) -> tuple[DataFrame | None, list[str]]:
    """Nearest rows over several stores. Stores of the asked models merge; others are named in a notice."""
    out, notices = None, []
    for name, (model, frame) in sorted(stores.items()):
        if model not in queries:
            notices.append(f"{name} was embedded by {model}, for which there is no query vector")
            continue
        part = knn(frame, key, embedding, queries[model], k).withColumn("database", F.lit(name)).withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    return (None if out is None else out.orderBy(F.desc("score"), "database", key).limit(k)), notices


def parity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side holds, with the side."""
    only_left = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("left"))
    only_right = right.select(*keys).distinct().join(left.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def surface_text(*columns: str) -> Column:
    """The text of a declared surface: its columns with blank lines between, empties kept, ends trimmed."""
    return F.trim(F.concat_ws("\n\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def clean_for_embedding(texts: pd.Series) -> pd.Series:
    """Question texts without JSON values, identifiers and long hexadecimal runs, up to the first file path."""
    import json
    import re

    path = re.compile(r"(?:^|\s)(?:/|~/|[A-Za-z]:\\)\S+")
    noise = re.compile(r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b|\b[0-9a-f]{12,}\b", re.I)
    decoder = json.JSONDecoder()
    out = []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        kept, at = "", 0
        while at < len(text):
            if text[at] in "{[":
                try:
                    _, end = decoder.raw_decode(text, at)
                    at = end
                    continue
                except ValueError:
                    pass
            kept += text[at]
            at += 1
        m = path.search(kept)
        out.append(re.sub(r"\s+", " ", noise.sub(" ", kept[: m.start()] if m else kept)).strip())
    return pd.Series(out, dtype=object)
