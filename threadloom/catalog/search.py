"""Search, text, profile and vector queries with their SQL."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.model import current, thinking_blocks
from threadloom.operators import profile, search, vector
from threadloom.session import shared_folder, table
from threadloom.sources.index import SearchIndex, VectorStore

WORDS = ["ranking", "cursor"]
#: Queries that are sent to all tasks at once.
BLOCK = 1_024
_FOLD = f"translate(lower({{0}}), '{T.FOLD_FROM}', '{T.FOLD_TO}')"
_TOK = "regexp_extract_all(" + _FOLD.format("coalesce({0}, '')") + r", '[\p{{L}}\p{{N}}\p{{Co}}]+')"


def _tok(column: str) -> str:
    return _TOK.format(column)


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in ("memories", "exchanges")}


def _bm25_sql(rows: str, key: str, every: str, own: str, words: list[str], match: str, tail: str = "", name: str = "rank") -> str:
    """DuckDB ranking of ``rows`` (a FROM clause) by the same formula."""
    tf = lambda w: f"len(list_filter(own, lambda x: x = '{w}'))"
    idf = lambda i: f"greatest(ln((s.n - s.n{i} + 0.5) / (s.n{i} + 0.5)), 1e-6)"
    score = " + ".join(f"{idf(i)} * {tf(w)} * 2.2 / ({tf(w)} + 1.2 * (0.25 + 0.75 * len(toks) / s.average))" for i, w in enumerate(words))
    joined = (" AND " if match == "all" else " OR ").join(f"list_contains(own, '{w}')" for w in words)
    held = ", ".join(f"count(*) FILTER (WHERE list_contains(own, '{w}')) AS n{i}" for i, w in enumerate(words))
    return f"""
WITH d AS (SELECT *, {every} AS toks, {own} AS own FROM {rows}),
s AS (SELECT count(*) AS n, avg(len(toks)) AS average, {held} FROM d)
SELECT d.{key}, round(-({score}), 6) AS {name} FROM d, s WHERE {joined}{tail}"""


def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), "doc_id", ["text"], WORDS).select("doc_id", F.round("rank", 6).alias("rank"))


def bm25_or(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "memories"), "id", ["content"], ["kettle", "índice", "orbit"], "any").select("id", F.round("rank", 6).alias("rank"))


def bm25_column_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "exchanges"), "id", ["human_text", "agent_text"], WORDS, "any", ["human_text"]).select("id", F.round("rank", 6).alias("rank"))


def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    """The flagship query: the best twenty documents for a few words."""
    ranked = search.bm25(table(spark, d, "documents"), "doc_id", ["text"], ["snapshot", "reader", "layer", "registry"], "any").select("doc_id", F.round("rank", 6).alias("rank"))
    return ranked.orderBy("rank", "doc_id").limit(20)


def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    """The same ranks from the index instead of the text."""
    index = _stored_index(spark, d)
    return index.rank(WORDS).filter("words = 2").select("doc_id", F.round("rank", 6).alias("rank"))


def _stored_index(spark: SparkSession, d: str) -> SearchIndex:
    """The stored index of the documents, brought up to them: built once, later calls add what changed."""
    place = hashlib.sha256(f"{spark.sparkContext.applicationId}{d}".encode()).hexdigest()[:16]
    index = SearchIndex(spark, f"{shared_folder(spark)}/index-{place}", "doc_id", ["text"])
    index.build(table(spark, d, "documents"))
    return index


def index_follows(spark: SparkSession, d: str) -> DataFrame:
    """What three builds of one index do: half of the documents, all with some changed, the same again."""
    docs = table(spark, d, "documents").filter("doc_id IS NOT NULL").select("doc_id", "text")
    index = SearchIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", "doc_id", ["text"])
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" beacon"))).otherwise(F.col("text"))).filter("doc_id % 5 <> 0")
    runs = [index.build(docs.filter("doc_id % 2 = 0")), index.build(changed), index.build(changed)]
    counts = spark.createDataFrame([(i, r["added"], r["changed"], r["removed"]) for i, r in enumerate(runs, 1)], "run int, added bigint, changed bigint, removed bigint")
    return counts.crossJoin(index.rank(["beacon"]).agg(F.count("*").alias("hits")))  # one row of hits


def vector_store_follows(spark: SparkSession, d: str) -> DataFrame:
    """What refreshes of one vector store do: half of the notes, all with some changed, the same again, another model."""
    chunks = lambda rows: vector.chunk_identity(vector.chunks(rows, "id", "content", 400, 40), "memory", "id").select("locator", "chunk_index", "chunk", "fingerprint")
    notes = table(spark, d, "memories").select("id", "content")
    changed = chunks(notes.withColumn("content", F.when(F.col("id") % 7 == 0, F.upper("content")).otherwise(F.col("content"))).filter("id % 5 <> 0"))
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    store = VectorStore(spark, path, "m1")
    runs = [store.refresh(chunks(notes.filter("id % 2 = 0"))), store.refresh(changed), store.refresh(changed)]
    sealed = store.seal()
    store.compact(changed)
    assert store.is_unchanged(sealed)
    runs.append(VectorStore(spark, path, "m2").refresh(changed))
    return spark.createDataFrame([(i, r["added"], r["updated"], r["unchanged"], r["removed"]) for i, r in enumerate(runs, 1)], "run int, added bigint, updated bigint, unchanged bigint, removed bigint")


def knn_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 20 of a shortlist of 160 a batch, for every query whose id is divisible by 50, against all rows."""
    rows = table(spark, d, "embeddings")
    queries = [(r.vec_id, list(r.embedding)) for r in rows.filter("vec_id % 50 = 0").select("vec_id", "embedding").limit(BLOCK).collect()]  # one block of stated queries
    return vector.recall(rows, "vec_id", "embedding", queries, 20, 160).select((F.col("recall") >= 0.9).alias("enough"))


def knn_block(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest rows of every query whose id is divisible by 50, block by block."""
    rows = table(spark, d, "embeddings")
    asked = [(r.vec_id, list(r.embedding)) for r in rows.filter("vec_id % 50 = 0").select("vec_id", "embedding").toLocalIterator()]
    parts = [vector.knn_block(rows, "vec_id", "embedding", asked[at : at + BLOCK], 5, 160) for at in range(0, len(asked), BLOCK)]
    return reduce(DataFrame.unionByName, parts).select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), F.round("score", 5).alias("score"))


def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(table(spark, d, "memories"), "id", ["content"]).groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"))


def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    return search.phrase_rows(table(spark, d, "exchanges"), ["human_text", "agent_text"], "the open turn").select("id")


def search_union_four_sources(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_tables(spark, d), ["layer", "registry"]).select("source", "priority", "id", F.round("rank", 6).alias("rank"))


def search_layer(spark: SparkSession, d: str) -> DataFrame:
    return search.search(_tables(spark, d), ["layer", "registry"], layer="decision").select("source", "priority", "id", F.round("rank", 6).alias("rank"))


def search_rescue(spark: SparkSession, d: str) -> DataFrame:
    return search.rescue(_tables(spark, d), T.term_words("what about the compaction pass and copper?")).select("source", "id", F.round("rank", 6).alias("rank"))


def search_dedup_rank(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = search.bm25(docs, "doc_id", ["text"], ["anchor"], carry=["text", "source"]).withColumn("priority", F.lit(0)).withColumn("stamp", F.lit(None).cast("string")).withColumn("by", F.lit(""))
    hits = hits.withColumn("source", F.lit("documents")).withColumn("id", F.col("doc_id"))
    return search.dedup_hits(hits.withColumn("rank", F.round("rank", 6))).select("id", "rank")


def rerank_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = search.like_search(_tables(spark, d), ["snapshot reader"]).withColumn("rank", F.lit(0.0))
    return search.rerank(hits, "the snapshot reader").select("source", "id", "order")


def like_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(T.like_all("text", ["snapshot", "entries"])).select("doc_id")


def like_any(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(T.like_any("text", ["100%", "naïve"])).select("doc_id")


def like_accent_variant(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(T.contains_like("text", "señal") | T.contains_like("text", "facade")).select("doc_id")


def like_floor(spark: SparkSession, d: str) -> DataFrame:
    return search.like_search(_tables(spark, d), ["vector", "shortlist"]).select("source", "id")


def superseded_excluded(spark: SparkSession, d: str) -> DataFrame:
    return current(table(spark, d, "memories")).select("id", "layer")


def layer_filter(spark: SparkSession, d: str) -> DataFrame:
    return search.layer_filter(table(spark, d, "memories"), "decision").select("id")


def layer_excluded(spark: SparkSession, d: str) -> DataFrame:
    return search.layer_filter(table(spark, d, "memories")).select("id", "layer")


def task_notifications(spark: SparkSession, d: str) -> DataFrame:
    return search.spoken(table(spark, d, "exchanges")).select("id")


def fts_census_by_month(spark: SparkSession, d: str) -> DataFrame:
    hits = search.phrase_rows(table(spark, d, "exchanges"), ["human_text", "agent_text"], "compaction pass")
    return hits.groupBy(T.month_of(F.coalesce("human_timestamp", "agent_timestamp")).alias("month")).agg(F.countDistinct("id").alias("exchanges"), F.countDistinct("session_id").alias("sessions"))


def fts_frame(spark: SparkSession, d: str) -> DataFrame:
    hits = search.phrase_rows(table(spark, d, "exchanges"), ["human_text", "agent_text"], "turn builder")
    return hits.agg(F.countDistinct("id").alias("exchanges"), F.countDistinct("session_id").alias("sessions"), F.min("human_timestamp").alias("first"), F.max("human_timestamp").alias("last"))


def fold_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.fold("text").alias("folded"))


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(T.tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def search_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "exchanges").filter("human_text IS NOT NULL").select("id", T.search_term_col("human_text").alias("term"))


def author_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").groupBy(T.author("source_agent", "source_model", "source_surface").alias("author")).agg(F.count("*").alias("n"))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", T.excerpt("text", "manifest", 200).alias("excerpt"))


def clip_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clip("text", 500).alias("clipped"))


def format_distribution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "exchanges").groupBy(T.time_format("human_timestamp").alias("format")).agg(F.count("*").alias("n"))


def redact_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tool_uses").select("id", T.redact_log("tool_params_summary").alias("redacted"))


def redact_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tool_uses").select("id", T.redact_text("tool_params_summary").alias("redacted"))


def missing_referents(spark: SparkSession, d: str) -> DataFrame:
    """Open slots in texts, as a question with such words would leave them."""
    from threadloom.plans.question import FILLED, OPEN_SLOT

    said = table(spark, d, "memories").select("id", F.regexp_replace("content", r"(?i)\bthe (\w+)", "a specific $1").alias("q"))
    tail = F.expr("substring(q, locate(whole, q) + length(whole))")
    found = said.withColumn("whole", F.regexp_extract("q", OPEN_SLOT, 0)).filter("whole <> ''").withColumn("slot", F.lower(F.regexp_extract("q", OPEN_SLOT, 1)))
    return found.filter(~tail.rlike(FILLED)).select("id", "slot")


def hostile_questions(spark: SparkSession, d: str) -> DataFrame:
    from threadloom.plans.question import HOSTILE, LONGEST

    hostile = F.lit(False)
    for pattern in HOSTILE:
        hostile = hostile | F.col("human_text").rlike(pattern)
    asked = table(spark, d, "exchanges").filter("human_text IS NOT NULL")
    verdict = F.when(F.trim("human_text") == "", "empty").when(F.length("human_text") > LONGEST, "long").when(hostile, "hostile").otherwise("fine")
    return asked.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").select("id", T.framed_digest("layer", "content").alias("digest"))


# -- profile ------------------------------------------------------------------------------------------


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return search.like_search(_tables(spark, d), ["snapshot"])


def terrain_sources(spark: SparkSession, d: str) -> DataFrame:
    return profile.source_counts(_hits(spark, d))


def terrain_months(spark: SparkSession, d: str) -> DataFrame:
    return profile.month_clusters(_hits(spark, d))


def terrain_terms(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_terms(table(spark, d, "memories"), "content")


def negative_space(spark: SparkSession, d: str) -> DataFrame:
    return profile.negative_space(table(spark, d, "memories"), ["kettle", "zeppelin", "snapshot"], "content")


# -- vectors ------------------------------------------------------------------------------------------

QUERY_ID = 1


def _query(spark: SparkSession, d: str) -> list[float]:
    """One stored vector as the query: one row on the driver."""
    return list(table(spark, d, "embeddings").filter(F.col("vec_id") == QUERY_ID).first()["embedding"])


def _scored(frame: DataFrame) -> DataFrame:
    return frame.withColumn("score", F.round("score", 6))


def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return _scored(vector.knn(table(spark, d, "embeddings"), "vec_id", "embedding", _query(spark, d), 20))


def knn_quantized(spark: SparkSession, d: str) -> DataFrame:
    return _scored(vector.knn(table(spark, d, "embeddings"), "vec_id", "embedding", _query(spark, d), 20, shortlist=160))


def knn_dedup_source(spark: SparkSession, d: str) -> DataFrame:
    return _scored(vector.knn(table(spark, d, "embeddings"), "vec_id", "embedding", _query(spark, d), 5, source="label"))


def knn_filtered_label(spark: SparkSession, d: str) -> DataFrame:
    return _scored(vector.knn(table(spark, d, "embeddings").filter("label = 3"), "vec_id", "embedding", _query(spark, d), 10))


def federated_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    stores = {"a": ("m", rows.filter("vec_id % 2 = 0")), "b": ("m", rows.filter("vec_id % 2 = 1")), "c": ("other", rows)}
    return _scored(vector.federated_knn(stores, "vec_id", "embedding", {"m": _query(spark, d)}, 20)[0])


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return vector.chunks(table(spark, d, "documents"), "doc_id", "text", 400, 40).select("doc_id", "chunk_index", "chunk")


def chunk_delta(spark: SparkSession, d: str) -> DataFrame:
    """Against a store in which documents of even id are missing and every third was another text."""
    now = vector.chunk_identity(vector.chunks(table(spark, d, "documents"), "doc_id", "text", 400, 40), "doc", "doc_id")
    old = table(spark, d, "documents").filter("doc_id % 2 = 1").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))
    stored = vector.chunk_identity(vector.chunks(old, "doc_id", "text", 400, 40), "doc", "doc_id")
    return vector.chunk_delta(now, stored).groupBy("action").agg(F.count("*").alias("n"))


def embedding_parity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return vector.parity(docs, vectors, ["id"])


def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    made = vector.embed(vector.chunks(table(spark, d, "documents"), "doc_id", "text"), "chunk")
    return made.select("doc_id", "chunk_index", F.size("embedding").alias("dimensions"), vector.sign_bits(F.col("embedding")).alias("bits"))


def hybrid_census(spark: SparkSession, d: str) -> DataFrame:
    """Documents near a text, counted by kind and language: vector hits first, then their frame."""
    rows = vector.embed(table(spark, d, "documents").filter("text IS NOT NULL"), "text")
    near = vector.knn(rows, "doc_id", "embedding", vector.hash_embedder()([vector.QUERY_PREFIX + "snapshot reader of the layer registry"])[0], 100)
    return rows.join(F.broadcast(near.select("doc_id")), "doc_id", "left_semi").groupBy("doc_kind", "lang").agg(F.count("*").alias("n"))


def cleaned_questions(spark: SparkSession, d: str) -> DataFrame:
    clean = F.pandas_udf(vector.clean_for_embedding, "string")
    return table(spark, d, "exchanges").filter("human_text IS NOT NULL").select("id", clean("human_text").alias("cleaned"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_and, bm25_or, bm25_column_filter, bm25_top, bm25_postings, index_follows, vector_store_follows, knn_recall, knn_block, postings_stats, phrase_match, search_union_four_sources, search_layer, search_rescue, search_dedup_rank, rerank_hits,
        like_all, like_any, like_accent_variant, like_floor, superseded_excluded, layer_filter, layer_excluded, task_notifications, fts_census_by_month, fts_frame,
        fold_words, tokenize_counts, search_terms, author_label, excerpts, clip_text, format_distribution, redact_log, redact_text, missing_referents, hostile_questions, digests,
        terrain_sources, terrain_months, terrain_terms, negative_space,
        knn_exact, knn_quantized, knn_dedup_source, knn_filtered_label, federated_merge, chunk_documents, chunk_delta, embedding_parity, embed_documents, hybrid_census, cleaned_questions,
    )
}

_THINK = "(SELECT id, agent_text AS full_text FROM exchanges WHERE tokens_reasoning IS NOT NULL AND agent_text IS NOT NULL)"
_CURRENT = "(SELECT * FROM memories WHERE id NOT IN (SELECT supersedes FROM memories WHERE supersedes IS NOT NULL))"
_SHOWN = f"(SELECT * FROM {_CURRENT} WHERE coalesce(layer, '') NOT IN ('question', 'review', 'issue'))"
_SPOKEN = "(SELECT * FROM exchanges WHERE coalesce(human_text, '') NOT ILIKE '<task-notification%')"


def _holds(column: str, *words: str, how: str = " AND ") -> str:
    return "(" + how.join(f"({column} ILIKE '{T.like_pattern(w)}' ESCAPE '\\' OR {_FOLD.format(column)} LIKE '{T.like_pattern(T.fold_text(w))}' ESCAPE '\\')" for w in words) + ")"


def _branch(source: str, priority: int, rows: str, every: str, own: str, text: str, words: list[str], match: str, top: int) -> str:
    ranked = _bm25_sql(rows, "id", every, own, words, match, f" AND trim({text}) <> ''", "r")
    return f"SELECT '{source}' AS source, {priority} AS priority, CAST(id AS VARCHAR) AS id, r AS rank FROM (SELECT * FROM ({ranked}) ORDER BY r, id LIMIT {top})"


def _union_sql(words: list[str], match: str, top: int, layer: str | None = None) -> str:
    shown = f"(SELECT * FROM {_CURRENT} WHERE layer = '{layer}')" if layer else _SHOWN
    both = f"list_concat({_tok('human_text')}, {_tok('agent_text')})"
    parts = [_branch("memory", 0, shown, _tok("content"), _tok("content"), "content", words, match, top)]
    if not layer:
        parts += [
            _branch("exchange", 1, "exchanges", both, _tok("agent_text"), "agent_text", words, match, top), _branch("human", 1, _SPOKEN, both, _tok("human_text"), "human_text", words, match, top),
            _branch("thinking", 2, _THINK, _tok("full_text"), _tok("full_text"), "full_text", words, match, top),
        ]
    return " UNION ALL ".join(f"({p})" for p in parts)


def _like_sql(words: list[str], extra: str = "") -> str:
    return f"""
SELECT 'memory' AS source, CAST(id AS VARCHAR) AS id, created_at AS stamp, content AS text, 0 AS kind FROM {_SHOWN} WHERE {_holds("content", *words)}
UNION ALL SELECT 'exchange', CAST(id AS VARCHAR), human_timestamp, agent_text, 10 FROM exchanges WHERE {_holds("agent_text", *words)}
UNION ALL SELECT 'human', CAST(min(id) AS VARCHAR), human_timestamp, human_text, 10 FROM {_SPOKEN} WHERE {_holds("human_text", *words)} GROUP BY session_id, human_timestamp, human_text
UNION ALL SELECT 'thinking', CAST(id AS VARCHAR), NULL, full_text, 20 FROM {_THINK} WHERE {_holds("full_text", *words)}"""


_COS = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"
_Q = f"(SELECT embedding FROM embeddings WHERE vec_id = {QUERY_ID})"
_PHRASE = "(contains(' ' || array_to_string({0}, ' ') || ' ', ' {2} ') OR contains(' ' || array_to_string({1}, ' ') || ' ', ' {2} '))"


def _phrase(words: str) -> str:
    return _PHRASE.format(_tok("human_text"), _tok("agent_text"), words)


# The rules of questions and redaction, written for the SQL by themselves.
_HOSTILE_SQL = r"""(?i)(ignore\s+((all|previous|prior|above|my|the|your|these)\s+)*(instruction|prompt|rule)|disregard\s+((all|your|previous|prior|above|the|my|these)\s+)*(instruction|prompt|rule)|forget\s+(everything|all|your)
|do\s+not\s+follow\s+(your|the|any)|override\s+(your|the|all|any)\s+(instruction|prompt|rule)|you\s+are\s+now\b|\bact\s+as\s+((a|an)\s+)?(database|system|admin|root|super|helpful|unrestricted|unfiltered)\b|\bsystem\s+prompt\b|\bjailbreak\b
|\b(you\s+are\s+DAN|enable\s+DAN|DAN\s+mode)\b|```|\[INST\]|<<SYS>>|\b(base64|hex)\s+decode\s+(this|the|it)\b|\bdecode\s+(this|the|it)\s+(string|payload|text|base64|hex|code)\b|\b0x[0-9a-f]{8,}\b)""".replace("\n", "")
_REDACT_SQL = "tool_params_summary"
for _shape, _into in (
    (r"(?i)\b(bearer\s)\s*[A-Za-z0-9._~+/=-]+", r"\1[REDACTED]"), (r"(?i)\b((?:api[_-]?key|token|password|passwd|secret)\s*[:=])\s*[^\s,;]+", r"\1[REDACTED]"), (r"\b(?:sk-[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9_]{8,}|github_pat_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9-]{8,})\b", "[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "[REDACTED]"), (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[REDACTED]"), (r"\bAIza[0-9A-Za-z_-]{35}\b", "[REDACTED]"), (r"(?s)-----BEGIN [^-]*PRIVATE KEY-----.*?-----END [^-]*PRIVATE KEY-----", "[REDACTED]"),
):
    _REDACT_SQL = f"regexp_replace({_REDACT_SQL}, '{_shape}', '{_into}', 'g')"

_CHUNKS = "(SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substring(text, CAST(i * 360 + 1 AS BIGINT), 400) AS chunk FROM (SELECT doc_id, {0} AS text, unnest(range(0, CAST(floor(greatest(length({0}) - 41, 0) / 360) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0 {1}))"

ORACLES = {
    "bm25_and": _bm25_sql("documents", "doc_id", _tok("text"), _tok("text"), WORDS, "all"),
    "bm25_or": _bm25_sql("memories", "id", _tok("content"), _tok("content"), ["kettle", "indice", "orbit"], "any"),
    "bm25_column_filter": _bm25_sql("exchanges", "id", f"list_concat({_tok('human_text')}, {_tok('agent_text')})", _tok("human_text"), WORDS, "any"),
    "bm25_top": f"SELECT * FROM ({_bm25_sql('documents', 'doc_id', _tok('text'), _tok('text'), ['snapshot', 'reader', 'layer', 'registry'], 'any')}) ORDER BY rank, doc_id LIMIT 20",
    "bm25_postings": _bm25_sql("documents", "doc_id", _tok("text"), _tok("text"), WORDS, "all"),
    "postings_stats": f"SELECT token, count(DISTINCT id) AS docs, count(*) AS uses FROM (SELECT id, unnest({_tok('content')}) AS token FROM memories) GROUP BY token",
    "phrase_match": f"SELECT id FROM exchanges WHERE {_phrase('the open turn')}",
    "search_union_four_sources": f"SELECT * FROM ({_union_sql(['layer', 'registry'], 'all', 20)}) ORDER BY priority, rank, source, id LIMIT 20",
    "search_layer": f"SELECT * FROM ({_union_sql(['layer', 'registry'], 'all', 20, 'decision')}) ORDER BY priority, rank, source, id LIMIT 20",
    "search_dedup_rank": f"SELECT min(d.doc_id) AS id, r.rank FROM documents d JOIN ({_bm25_sql('documents', 'doc_id', _tok('text'), _tok('text'), ['anchor'], 'all')}) r ON r.doc_id = d.doc_id GROUP BY d.text, r.rank",
    "rerank_hits": f"SELECT source, id, CAST(kind + CASE WHEN contains(lower(text), 'the snapshot reader') THEN 1 ELSE 0 END AS INTEGER) AS \"order\" FROM ({_like_sql(['snapshot reader'])})",
    "like_all": f"SELECT doc_id FROM documents WHERE {_holds('text', 'snapshot', 'entries')}",
    "like_any": f"SELECT doc_id FROM documents WHERE {_holds('text', '100%', 'naïve', how=' OR ')}",
    "like_accent_variant": f"SELECT doc_id FROM documents WHERE {_holds('text', 'señal')} OR {_holds('text', 'facade')}",
    "like_floor": f"SELECT source, id FROM ({_like_sql(['vector', 'shortlist'])})",
    "superseded_excluded": "SELECT id, layer FROM memories WHERE id NOT IN (SELECT supersedes FROM memories WHERE supersedes IS NOT NULL)",
    "layer_filter": "SELECT id FROM memories WHERE layer = 'decision'",
    "layer_excluded": "SELECT id, layer FROM memories WHERE coalesce(layer, '') NOT IN ('question', 'review', 'issue')",
    "task_notifications": "SELECT id FROM exchanges WHERE coalesce(human_text, '') NOT ILIKE '<task-notification%'",
    "fts_census_by_month": f"SELECT nullif(regexp_extract(coalesce(human_timestamp, agent_timestamp), '^(\\d{{4}}-\\d{{2}})', 1), '') AS month, count(DISTINCT id) AS exchanges, count(DISTINCT session_id) AS sessions FROM exchanges WHERE {_phrase('compaction pass')} GROUP BY 1",
    "fts_frame": f"SELECT count(DISTINCT id) AS exchanges, count(DISTINCT session_id) AS sessions, min(human_timestamp) AS first, max(human_timestamp) AS last FROM exchanges WHERE {_phrase('turn builder')}",
    "fold_words": f"SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents",
    "tokenize_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({_tok('text')}) AS token FROM documents) GROUP BY token",
    "author_label": "SELECT coalesce(nullif(trim(source_agent), ''), 'unknown') || '/' || coalesce(nullif(trim(source_model), ''), 'unknown') || ' via ' || coalesce(nullif(trim(source_surface), ''), 'unknown') AS author, count(*) AS n FROM memories GROUP BY 1",
    "digests": "SELECT id, sha256(unhex(lpad(to_hex(octet_length(encode(coalesce(layer, '')))), 16, '0')) || encode(coalesce(layer, '')) || unhex(lpad(to_hex(octet_length(encode(coalesce(content, '')))), 16, '0')) || encode(coalesce(content, ''))) AS digest FROM memories",
    "excerpts": f"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN a <= 100 THEN substring(text, 1, 200) || '…' ELSE substring(text, 1, 100) || ' … ' || substring(text, greatest(a - 50, 101), 100) END AS excerpt FROM (SELECT *, strpos({_FOLD.format('text')}, 'manifest') AS a FROM documents WHERE text IS NOT NULL)",
    "clip_text": "SELECT doc_id, substring(text, 1, 500) AS clipped FROM documents",
    "format_distribution": r"SELECT CASE WHEN human_timestamp IS NULL THEN NULL WHEN regexp_full_match(human_timestamp, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z') THEN 'utc' WHEN regexp_full_match(human_timestamp, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?[+-]\d{2}:\d{2}') THEN 'offset' ELSE 'other' END AS format, count(*) AS n FROM exchanges GROUP BY 1",
    "redact_text": f"SELECT id, {_REDACT_SQL} AS redacted FROM tool_uses",
    "missing_referents": r"""WITH q AS (SELECT id, regexp_replace(content, '(?i)\bthe (\w+)', 'a specific \1', 'g') AS q FROM memories),
m AS (SELECT id, q, regexp_extract(q, '(?i)\b(?:a|an)\s+(?:specific|particular|given|named)\s+([a-z][a-z0-9_-]*)\b', 0) AS whole, lower(regexp_extract(q, '(?i)\b(?:a|an)\s+(?:specific|particular|given|named)\s+([a-z][a-z0-9_-]*)\b', 1)) AS slot FROM q)
SELECT id, slot FROM m WHERE whole <> '' AND NOT regexp_matches(substr(q, strpos(q, whole) + length(whole)), '(?i)^\s+(?:called|named|with\s+(?:the\s+)?(?:name|id|key|value))\s+["'']?[a-z0-9]|^\s*[:,]\s*["'']?[a-z0-9]|^\s*["''][a-z0-9]')""",
    "hostile_questions": f"SELECT CASE WHEN trim(human_text, ' ') = '' THEN 'empty' WHEN length(human_text) > 1000 THEN 'long' WHEN regexp_matches(human_text, '{_HOSTILE_SQL}') THEN 'hostile' ELSE 'fine' END AS verdict, count(*) AS n FROM exchanges WHERE human_text IS NOT NULL GROUP BY 1",
    "terrain_sources": f"SELECT source, count(*) AS n FROM ({_like_sql(['snapshot'])}) GROUP BY source",
    "terrain_months": f"SELECT nullif(regexp_extract(stamp, '^(\\d{{4}}-\\d{{2}})', 1), '') AS month, count(*) AS n FROM ({_like_sql(['snapshot'])}) GROUP BY 1",
    "terrain_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter({_tok('content')}, lambda w: length(w) >= 4 AND NOT regexp_full_match(w, '[0-9]+')))) AS term FROM memories) GROUP BY term ORDER BY n DESC, term LIMIT 8",
    "negative_space": f"SELECT w.word, (SELECT count(*) FROM memories WHERE list_contains({_tok('content')}, w.word)) AS n FROM (VALUES ('kettle'), ('zeppelin'), ('snapshot')) w(word)",
    "knn_exact": f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q} q ORDER BY {_COS} DESC, e.vec_id LIMIT 20",
    "knn_quantized": f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q} q ORDER BY {_COS} DESC, e.vec_id LIMIT 20",
    "knn_recall": "SELECT true AS enough",
    "knn_block": f"SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 5) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) <= 5",
    "index_follows": """WITH d AS (SELECT doc_id, coalesce(text, '') AS old, CASE WHEN doc_id % 7 = 0 THEN coalesce(text || ' beacon', '') ELSE coalesce(text, '') END AS new FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT 1 AS run, count(*) FILTER (WHERE doc_id % 2 = 0) AS added, 0 AS changed, 0 AS removed FROM d
  UNION ALL SELECT 2, count(*) FILTER (WHERE doc_id % 2 = 1 AND doc_id % 5 <> 0), count(*) FILTER (WHERE doc_id % 2 = 0 AND doc_id % 5 <> 0 AND old <> new), count(*) FILTER (WHERE doc_id % 2 = 0 AND doc_id % 5 = 0) FROM d
  UNION ALL SELECT 3, 0, 0, 0)
SELECT r.*, (SELECT count(*) FROM d WHERE doc_id % 5 <> 0 AND regexp_matches(lower(new), '(^|[^\\p{L}\\p{N}])beacon([^\\p{L}\\p{N}]|$)')) AS hits FROM r""",
    "vector_store_follows": """WITH m AS (SELECT id, CAST(floor(greatest(length(content) - 41, 0) / 360) AS BIGINT) + 1 AS n FROM memories WHERE length(content) > 0),
c AS (SELECT m.id, m.n, i, substring(content, CAST(i * 360 + 1 AS BIGINT), 400) AS old, CASE WHEN m.id % 7 = 0 THEN substring(upper(content), CAST(i * 360 + 1 AS BIGINT), 400) ELSE substring(content, CAST(i * 360 + 1 AS BIGINT), 400) END AS new FROM m JOIN memories USING (id), LATERAL (SELECT unnest(range(0, m.n)) AS i))
SELECT 1 AS run, count(*) FILTER (WHERE id % 2 = 0) AS added, 0 AS updated, 0 AS unchanged, 0 AS removed FROM c
UNION ALL SELECT 2, count(*) FILTER (WHERE id % 2 = 1 AND id % 5 <> 0), count(*) FILTER (WHERE id % 2 = 0 AND id % 5 <> 0 AND old <> new), count(*) FILTER (WHERE id % 2 = 0 AND id % 5 <> 0 AND old = new), count(*) FILTER (WHERE id % 2 = 0 AND id % 5 = 0) FROM c
UNION ALL SELECT 3, 0, 0, count(*) FILTER (WHERE id % 5 <> 0), 0 FROM c
UNION ALL SELECT 4, count(*) FILTER (WHERE id % 5 <> 0), 0, 0, 0 FROM c""",
    "knn_dedup_source": f"SELECT vec_id, round(s, 6) AS score, label FROM (SELECT e.vec_id, e.label, {_COS} AS s FROM embeddings e, {_Q} q QUALIFY row_number() OVER (PARTITION BY e.label ORDER BY {_COS} DESC, e.vec_id) = 1) ORDER BY s DESC, vec_id LIMIT 5",
    "knn_filtered_label": f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q} q WHERE e.label = 3 ORDER BY {_COS} DESC, e.vec_id LIMIT 10",
    "federated_merge": f"SELECT e.vec_id, round({_COS}, 6) AS score, CASE WHEN e.vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS database, 'm' AS model FROM embeddings e, {_Q} q ORDER BY {_COS} DESC, database, e.vec_id LIMIT 20",
    "chunk_documents": f"SELECT * FROM {_CHUNKS.format('text', '')}",
    "chunk_delta": f"WITH now AS (SELECT * FROM {_CHUNKS.format('text', '')}), old AS (SELECT * FROM {_CHUNKS.format('(CASE WHEN doc_id % 3 = 0 THEN text || chr(32) || chr(111) || chr(108) || chr(100) ELSE text END)', 'AND doc_id % 2 = 1')}) SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN n.chunk = o.chunk THEN 'unchanged' ELSE 'updated' END AS action, count(*) AS n FROM now n FULL JOIN old o ON n.doc_id = o.doc_id AND n.chunk_index = o.chunk_index GROUP BY 1",
    "embedding_parity": "SELECT doc_id AS id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'right' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)",
}
