"""Stored search structures: an inverted index in segments, and a vector store that follows its texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import fold_text, framed_digest, tokens
from threadloom.operators import search, vector
from threadloom.session import checkpoint
from threadloom.sources.sinks import VerificationError, VersionedTable, content_state

#: Counts up when words are cut or folded otherwise: an index of another generation is built anew.
GENERATION = "1"
#: Buckets of words in a segment.
BUCKETS = 64


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


class SearchIndex:
    """Postings of a table's text columns, written in segments by word bucket, beside the documents they hold.

    A build takes only rows that are new or changed and forgets rows that are gone; it writes the segment
    first and the documents last, so a build that was cut short leaves no half-indexed row and is taken up by the
    next. A search reads the buckets of its words. Rows with a null key are left out; null text is empty.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, columns: list[str]) -> None:
        self.spark, self.path, self.key, self.columns = spark, path, key, columns
        self.docs = VersionedTable(spark, f"{path}/docs")

    def build(self, df: DataFrame) -> dict[str, int]:
        """Bring the index up to ``df``; gives rows added, changed and removed. The same rows again change nothing."""
        length = reduce(Column.__add__, [F.size(tokens(c)) for c in self.columns]).cast("bigint").alias("length")
        want = df.filter(F.col(self.key).isNotNull()).select(self.key, *self.columns, framed_digest(F.lit(GENERATION), *self.columns).alias("fingerprint"))
        held = self.docs.read()
        known = held.select(self.key, F.col("fingerprint").alias("have")) if held is not None else want.select(self.key, F.lit("").alias("have")).limit(0)
        both = checkpoint(want.select(self.key, "fingerprint").join(known, self.key, "full_outer").filter("NOT fingerprint <=> have"))
        n = both.agg(F.expr("count_if(have IS NULL)"), F.expr("count_if(have IS NOT NULL AND fingerprint IS NOT NULL)"), F.expr("count_if(fingerprint IS NULL)")).first()
        if sum(n):
            segment = f"s-{uuid.uuid4().hex}"
            todo = want.join(both.filter("fingerprint IS NOT NULL").select(self.key), self.key, "left_semi")
            found = search.postings(todo, self.key, self.columns).withColumn("bucket", _bucket(F.col("token")))
            found.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
            rows = todo.select(self.key, length, "fingerprint", F.lit(segment).alias("segment"))
            gone = both.filter("fingerprint IS NULL").select(self.key, F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("string").alias("fingerprint"), F.lit(None).cast("string").alias("segment"))

            def change(old: DataFrame | None, new: DataFrame) -> DataFrame:
                live = new.filter("segment IS NOT NULL")
                return live if old is None else old.join(new.select(self.key), self.key, "left_anti").unionByName(live)

            self.docs.merge(checkpoint(rows.unionByName(gone)), [self.key], change)
        return {"added": n[0], "changed": n[1], "removed": n[2]}

    def postings(self, words: list[str]) -> DataFrame:
        """The live postings of some words: the buckets of the words are read, and of a row only its newest segment."""
        words = list(dict.fromkeys(fold_text(w) for w in words))
        rows = self.spark.read.option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings")
        buckets = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(_bucket(F.col("w"))).collect()]  # one a word
        own = rows.filter(F.col("bucket").isin(buckets) & F.col("token").isin(words))
        return own.join(self.docs.read().select(self.key, "segment"), [self.key, "segment"], "left_semi").select("token", self.key, "col", "tf", "positions")

    def rank(self, words: list[str]) -> DataFrame:
        """``(key, rank, words)`` from the index alone."""
        return search.rank_postings(self.postings(words), self.docs.read().select(self.key, "length"), self.key, words)


class VectorStore:
    """Embeddings of chunks by locator. Only chunks whose fingerprint is new are embedded; another model starts anew."""

    def __init__(self, spark: SparkSession, path: str, model: str, embedder: Callable[[list[str]], list[list[float]]] | None = None) -> None:
        self.spark, self.model, self.embedder = spark, model, embedder
        self.table = VersionedTable(spark, path)

    def refresh(self, desired: DataFrame) -> dict[str, int]:
        """Follow ``desired(locator, chunk_index, chunk, fingerprint)``; gives chunks added, updated, unchanged and removed."""
        held = self.table.read()
        reset = held is not None and not held.filter(F.col("model") != self.model).isEmpty()
        stored = desired.select("locator", "chunk_index", "fingerprint").limit(0) if held is None or reset else held.select("locator", "chunk_index", "fingerprint")
        delta = checkpoint(vector.chunk_delta(desired, stored))
        counts = {r.action: r.n for r in delta.groupBy("action").agg(F.count("*").alias("n")).collect()}
        fresh = desired.join(delta.filter("action IN ('added', 'updated')"), ["locator", "chunk_index"], "left_semi")
        made = vector.embed(fresh, "chunk", self.embedder).select("locator", "chunk_index", "fingerprint", "embedding", vector.quantized(F.col("embedding")).alias("small"), F.lit(self.model).alias("model"))
        if reset:
            self.table.write(made)
        elif counts.keys() - {"unchanged"}:
            gone = delta.filter("action = 'removed'").select("locator", "chunk_index", F.lit(None).cast("string").alias("fingerprint"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("array<tinyint>").alias("small"), F.lit(None).cast("string").alias("model"))
            keys = ["locator", "chunk_index"]

            def change(old: DataFrame | None, new: DataFrame) -> DataFrame:
                live = new.filter("fingerprint IS NOT NULL")
                return live if old is None else old.join(new.select(*keys), keys, "left_anti").unionByName(live)

            self.table.merge(checkpoint(made.unionByName(gone)), ["locator"], change)
        return {a: counts.get(a, 0) for a in ("added", "updated", "unchanged", "removed")}

    def verify(self, desired: DataFrame) -> dict[str, int]:
        """Chunks by kind, after a check that store and texts hold the same fingerprints; VerificationError otherwise."""
        held = self.table.read()
        if not vector.parity(desired, held, ["locator", "chunk_index", "fingerprint"]).isEmpty():
            raise VerificationError("the vector store does not hold its texts")
        return {r.kind: r.n for r in held.groupBy(F.substring_index("locator", ":", 1).alias("kind")).agg(F.count("*").alias("n")).collect()}

    def compact(self, desired: DataFrame) -> int:
        """Rewrite the store as one version without old folders, verified before the old ones go."""
        self.table.write(checkpoint(self.table.read()))
        self.verify(desired)
        return self.table.vacuum(1)

    def seal(self) -> tuple[int, int, str]:
        """Version, rows and digest of what the store holds now."""
        return (self.table.version(), *content_state(self.table.read().select("locator", "chunk_index", "fingerprint", "model")))

    def is_unchanged(self, sealed: tuple[int, int, str]) -> bool:
        """Whether the store still holds what was sealed, whatever was written and taken back in between."""
        return self.table.version() == sealed[0] or self.seal()[1:] == sealed[1:]

    def search(self, query: list[float], live: DataFrame, k: int = 10) -> DataFrame:
        """``(locator, chunk_index, score)`` of the nearest chunks whose text is still the one that was embedded."""
        rows = self.table.read().join(live.select("locator", "chunk_index", "fingerprint"), ["locator", "chunk_index", "fingerprint"], "left_semi")
        keyed = rows.withColumn("place", F.struct("locator", "chunk_index"))
        return vector.knn(keyed, "place", "embedding", query, k, shortlist=vector.SHORTLIST, small="small").select("place.*", "score")
