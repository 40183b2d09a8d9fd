import random
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import ingest, profile, quality, search, vector


def test_dedup_is_null_safe_and_guarded(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "x", "a"), (4, "x", None), (5, "", None), (6, None, "a")], "id int, s string, t string")
    mapping = quality.remap(rows, "id", ["s", "t"])
    assert sorted(tuple(r) for r in mapping.collect()) == [(2, 1), (6, 1)]
    seen = quality.manifest(mapping)[1]
    refs = spark.createDataFrame([(2,), (3,), (None,)], "ref int")
    out = quality.apply_remap(rows, "id", ["s", "t"], seen, {"refs": (refs, "ref")})
    assert out["rows"].count() == 4 and sorted(r.ref or 0 for r in out["refs"].collect()) == [0, 1, 3]
    with pytest.raises(quality.DriftError):
        quality.apply_remap(rows.filter("id <> 6"), "id", ["s", "t"], seen)
    assert quality.remap(rows.filter("id < 0"), "id", ["s", "t"]).count() == 0


def test_layers_resolve_through_chains_and_circles(spark):
    layers = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x")], "name string, alias_of string")
    assert {r.name: r.resolved for r in quality.resolve_layers(layers).collect()} == {"a": "c", "b": "c", "c": "c", "x": None, "y": None}
    assert quality.add_layer(layers, "new", "d").count() == 6 and quality.add_layer(layers, "a", "d").count() == 5


def test_store_custody_and_drift(spark):
    stored = spark.createDataFrame([("l", "a", None)], "layer string, content string, project string")
    new = spark.createDataFrame([("l", "a", None), ("l", "b", None), ("l", "b", None)], stored.schema)
    assert [r.content for r in quality.store_rows(stored, new, stored.columns).collect()] == ["b"]
    assert quality.custody_union({"x": new, "y": stored}, ["content"]).count() == quality.custody_expectation({"x": new, "y": stored}, ["content"]).first().expected == 3
    assert quality.adoption(stored, new) == ("current", []) and quality.adoption(stored.drop("project"), new)[0] == "migratable" and quality.adoption(stored.select(F.lit(1).alias("z")), new)[0] == "foreign"
    gone = spark.createDataFrame([(1, "2020-01-01T00:00:00Z"), (2, None), (3, "never")], "id int, e string")
    assert sorted(r.id for r in quality.unexpired(gone, "e", "2025-01-01 00:00:00").collect()) == [2, 3]


def test_nearest_within_rejects_ties_and_crosses_buckets(spark):
    left = spark.createDataFrame([(1, "t", "2030-01-01T00:00:29Z"), (2, "t", "2030-01-01T01:00:00Z"), (3, "t", None)], "id int, k string, at string")
    right = spark.createDataFrame([(10, "t", "2030-01-01T00:00:31Z"), (11, "t", "2030-01-01T01:00:10Z"), (12, "t", "2030-01-01T02:00:10+01:00"), (13, "u", "2030-01-01T00:00:30Z")], "id int, k string, at string")
    assert [tuple(r) for r in ingest.nearest_within(left, right, ["k"], "at", "at", "id", "id").collect()] == [(1, 10, 2.0)]


def test_cascade_claims_once_and_names_ambiguity(spark):
    stored = spark.createDataFrame([(1, "s", "a", 1), (2, "s", "b", 2), (3, "s", "b", 3), (4, "s", "c", 4)], "id int, s string, t string, n int")
    incoming = spark.createDataFrame([(10, "s", "a", 9), (11, "s", "b", 9), (12, "s", None, 4), (13, "s", "z", 77), (14, "q", "a", 1)], stored.schema)
    out = {r.in_id: (r.stored_id, r.stage, r.outcome) for r in ingest.match_cascade(incoming, stored, "id", "id", "s", [("text", ["t"]), ("number", ["n"])]).collect()}
    assert out == {10: (1, "text", "matched"), 11: (None, "text", "ambiguous"), 12: (4, "number", "matched"), 13: (None, None, "unmatched"), 14: (None, None, "unmatched")}


def test_turns_latency_and_enrichment(spark):
    rows = spark.createDataFrame([("c", 1, "assistant", "lost", "2030-01-01T00:00:00Z"), ("c", 2, "human", "q", "2030-01-01T00:00:05Z"), ("c", 3, "assistant", "a", "2030-01-01T00:00:04Z"), ("c", 4, "assistant", "b", None)], "c string, i int, role string, text string, at string")
    turn = ingest.turns(rows, "c", ["i"], "role", "text", "at").first()
    assert (turn.human_text, turn.agent_text, turn.latency_ms) == ("q", "a\nb", 0)
    old = spark.createDataFrame([(1, None, "m", None), (2, "h", None, None)], "id int, h string, model string, tokens int")
    new = spark.createDataFrame([(1, "n", "other", 5), (2, "n", None, None)], old.schema)
    assert sorted(tuple(r) for r in ingest.enrich(old, new, "id", ["h"], ["model", "tokens"]).collect()) == [(1, "n", "other", 5), (2, "h", None, None)]


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "Kettle señal kettle"), (2, None), (3, ""), (4, "kettles only"), (5, "a kettle")], "id int, text string")
    ranked = search.bm25(docs, "id", ["text"], ["kettle"]).orderBy("rank").collect()
    assert [r.id for r in ranked] == [1, 5] and search.bm25(docs, "id", ["text"], []).count() == 0 and search.bm25(docs.filter("id = 99"), "id", ["text"], ["x"]).count() == 0
    assert [r.id for r in search.phrase_rows(docs, ["text"], "senal kettle").collect()] == [1]
    assert T.term_words("What is the señal of 123 of ab?") == ["what", "the", "senal"] and T.like_pattern("a%b_") == "%a\\%b\\_%"
    long = spark.createDataFrame([("a" * 60 + " señal " + "b" * 60,), (None,), ("short",)], "text string")
    head, null, short = [r.x for r in long.select(T.excerpt("text", "senal", 40).alias("x")).collect()]
    assert head.startswith("a" * 20 + " … ") and "señal" in head and null is None and short == "short"
    assert profile.strongest_claim([("a", 10), ("b", 3), ("c", 2)]) == "a has more than the next 2 together" and profile.strongest_claim([("a", 1)]) is None


def test_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(1, 9)], "id int, e array<float>")
    assert vector.knn(rows, "id", "e", [1.0, 1.0, 1.0], 3).count() == 3
    with pytest.raises(ValueError):
        vector.knn(rows, "id", "e", [1.0], 101)
    assert vector.federated_knn({"a": ("m", rows), "b": ("n", rows)}, "id", "e", {"m": [1.0, 1.0, 1.0]}, 2)[1] == ["b was embedded by n, for which there is no query vector"]
    text = spark.createDataFrame([(1, "x" * 100), (2, ""), (3, None), (4, "short")], "id int, t string")
    for size, overlap in ((10, 3), (40, 39), (200, 10)):
        got = {}
        for r in vector.chunks(text, "id", "t", size, overlap).collect():
            got.setdefault(r.id, []).append(len(r.chunk))
        want, at = [], 0
        while True:
            want.append(min(size, 100 - at))
            if at + size >= 100:
                break
            at += size - overlap
        assert got == {1: want, 4: [5]}
    assert vector.clean_for_embedding(pd.Series(['look {"a": [1]} at 0123456789abcdef now /tmp/x rest', None])).tolist() == ["look at now", None]


def test_one_key_of_half_the_rows_is_spread_with_the_same_result(spark):
    from threadloom.operators.skew import join_unique, numbered, running_sum

    rows = spark.range(400).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 5 = 0 THEN NULL ELSE concat('k', id % 7) END AS k", "id % 3 AS v")
    want: dict = {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        n, total = want.get(r.k, [(0, 0, None)])[-1][:2]
        want.setdefault(r.k, []).append((n + 1, total + r.v, r.id))
    flat = {i: (n, t) for own in want.values() for n, t, i in own}
    assert {r.id: r.n for r in numbered(rows, ["k"], ["id"], "n").collect()} == {i: n for i, (n, _) in flat.items()}
    assert {r.id: r.s for r in running_sum(rows, ["k"], ["id"], F.col("v"), "s").collect()} == {i: t for i, (_, t) in flat.items()}
    right = rows.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    for hot in (1, 10**6):
        joined = join_unique(rows, right, "k", "n", 400, "left", hot_rows=hot)
        assert joined.count() == 400 and joined.filter("top IS NULL").count() == rows.filter("k IS NULL").count()
    assert numbered(rows.limit(0), ["k"], ["id"], "n").count() == 0
    spans = spark.createDataFrame([("s", 0, 10**6 * 86_400 * 3), ("s", 5, 5), ("t", 7, 9)], "k string, o bigint, c bigint")
    signals = spark.createDataFrame([("s", 1), ("s", 86_400 * 10**6 * 2), ("s", 0), ("t", 9), ("t", 7), ("u", 8)], "k string, at bigint")
    assert sorted((r.k, r.at) for r in ingest.within_spans(signals, spans, "k", "at", "o", "c").select("s.k", "s.at").collect()) == [("s", 1), ("s", 86_400 * 10**6 * 2), ("t", 9)]


def test_route_counts_equal_the_pairs(spark):
    from threadloom.sources.enrichment import routing_counts, routing_rows

    r = random.Random(5)
    sessions = [(r.choice(["s1", "s2", "s3", "s4", "s5", "", None]), r.choice(["a", "b", "c", "", None])) for _ in range(14)]
    entry = lambda s: r.choice([None, "{", f'{{"session_id": "{s}"}}'])
    routes = [(r.choice([None, *range(25)]), r.choice(["a", "b", "c", "d", "", None]), entry(r.choice(["s1", "s3", "s5", "s9", ""]))) for _ in range(60)]
    left, right = spark.createDataFrame(sessions, "session_id string, session_key string"), spark.createDataFrame(routes, "row bigint, session_key string, entry_json string")
    want = {}
    for x in routing_rows(left, right).collect():
        want.setdefault(x.session_id, []).append(x.row)
    want = {s: (len(rows := [x for x in found if x is not None]), min(rows, default=None)) for s, found in want.items()}
    got = routing_counts(left, right).collect()
    assert {x.session_id: (x.routes, x.first_row) for x in got} == want and len(got) == len(want)


def test_one_key_of_all_sessions_and_routes_makes_no_pairs(spark, tmp_path):
    from threadloom.catalog.families import source_hermes_routing

    n = 60_000  # 3.6 billion pairs
    spark.range(n).selectExpr("concat('s', id) AS session_id", "'p' AS project").write.parquet(f"{tmp_path}/sessions.parquet")
    spark.range(n).selectExpr("id", "'p' AS project", "concat('s', id) AS source_session").write.parquet(f"{tmp_path}/memories.parquet")
    timer = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        assert [tuple(x) for x in source_hermes_routing(spark, str(tmp_path)).groupBy("routes", "first_row").count().collect()] == [(n, 0, n)]
    finally:
        timer.cancel()
