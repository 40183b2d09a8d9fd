import itertools
import json
import random

from threadloom.operators.schema_drift import best_matching, drift_report, name_similarity, parse_object, paths_of, unified

SCHEMA = "record_id bigint, kind string, stream_name string, file_path string, file_no int, payload string, key string"


def records(spark, files):
    rows = [(i, "k", "s", f"f{n}", n, p if isinstance(p, (str, type(None))) else json.dumps(p), p.get("id") if isinstance(p, dict) else None) for i, (n, p) in enumerate((n, p) for n, own in files.items() for p in own)]
    return spark.createDataFrame(rows, SCHEMA)


def changes(frame, **kw):
    return sorted((r.file_path, r.change, r.old_path, r.new_path) for r in drift_report(frame, **kw).collect())


def test_every_kind_of_change(spark):
    frame = records(spark, {
        1: [{"id": "a", "title": "x", "n": 1, "gone": True, "u": {"in": 3}}, {"id": "b", "title": "y", "n": 2, "gone": False, "u": {"in": 4}}, "broken{", None, "", "[1]"],
        2: [{"id": "b", "name": "y", "n": "2", "u": {"tokens": 4}, "fresh": None}, {"id": "c", "name": "z", "n": "3", "u": {"tokens": 4}}],
    })
    want = [("f2", "added", "", "fresh"), ("f2", "removed", "gone", ""), ("f2", "renamed", "title", "name"), ("f2", "renamed", "u.in", "u.tokens"), ("f2", "retyped", "n", "n")]
    assert changes(frame) == want and changes(frame, hot_rows=1) == want


def test_unequal_null_or_unshared_values_are_no_renames(spark):
    frame = records(spark, {1: [{"id": "a", "p": 1, "q": None}], 2: [{"id": "a", "r": 2, "s": None}], 3: [{"id": "z", "t": 2, "s": None}]})
    assert changes(frame) == [("f2", "added", "", "r"), ("f2", "added", "", "s"), ("f2", "removed", "p", ""), ("f2", "removed", "q", ""), ("f3", "added", "", "t"), ("f3", "removed", "r", "")]


def test_objects_are_equal_in_any_key_order(spark):
    frame = records(spark, {1: [{"id": "a", "v": {"x": 1, "y": 2}}], 2: [{"id": "a", "w": {"y": 2, "x": 1}}]})
    assert changes(frame) == [("f2", "renamed", "v", "w"), ("f2", "renamed", "v.x", "w.x"), ("f2", "renamed", "v.y", "w.y")]


def test_single_file_and_empty_table(spark):
    assert changes(records(spark, {1: [{"id": "a"}]})) == []
    assert changes(spark.createDataFrame([], SCHEMA)) == []


def test_repeats_and_extra_columns_change_nothing(spark):
    frame = records(spark, {1: [{"id": "a", "x": 1}], 2: [{"id": "a", "y": 1}]})
    noisy = frame.unionByName(frame).selectExpr("*", "1 AS gone", "2 AS place", "3 AS fields")
    assert changes(noisy) == changes(frame) == [("f2", "renamed", "x", "y")]


def test_unified_table_has_one_column_for_a_renamed_field(spark):
    frame = records(spark, {1: [{"id": "a", "title": "x"}, {"id": "q", "title": "w"}], 2: [{"id": "a", "name": "x"}]})
    table = unified(frame, drift_report(frame), "k")
    assert table.columns == ["record_id", "file_path", "id", "title", "rest"] and table.filter("rest IS NOT NULL").isEmpty() and sorted(r.title for r in table.collect()) == ["w", "x", "x"]


def test_matching_is_of_greatest_weight():
    r = random.Random(3)
    for _ in range(60):
        left, right = "abcd"[: r.randint(1, 4)], "wxyz"[: r.randint(1, 4)]
        weights = {(a, b): r.randint(1, 9) + 0.5 for a in left for b in right if r.random() < 0.7}
        best = max((sum(weights.get(p, 0) for p in zip(order, right)) for order in itertools.permutations(left + "-" * len(right), len(right))), default=0)
        found = best_matching(weights)
        assert len({a for a, _ in found}) == len({b for _, b in found}) == len(found)
        assert abs(sum(weights[p] for p in found) - best) < 1e-9


def test_small_helpers():
    assert parse_object(None) is None and parse_object("[]") is None and parse_object('{"a"') is None
    assert sorted(p for p, _, _ in paths_of({"a": {"b": [1], "c": None}})) == ["a", "a.b", "a.c"]
    assert name_similarity("createdAtMs", "created_at_ms") == 1.0


def test_unified_table_is_typed_keeps_both_values_and_renames_by_stream(spark):
    frame = records(spark, {1: [{"id": "a", "title": "x", "n": 1, "f": 1, "b": True, "m": 1}], 2: [{"id": "a", "name": "x", "n": 2, "f": 1.5, "b": False, "m": "t"}, {"id": "b", "name": "y", "title": "z", "n": 9007199254740993}]})
    other = spark.createDataFrame([(90, "k", "other", "g1", 1, '{"id": "o", "name": "own"}', "o")], SCHEMA)
    report = drift_report(frame)
    table = unified(frame.unionByName(other), report.filter("change = 'renamed'").unionByName(spark.createDataFrame([("f2", "renamed", "title", "name")], report.schema)).distinct(), "k")
    assert dict(table.dtypes) | {"n": "bigint", "f": "double", "b": "boolean", "m": "string"} == dict(table.dtypes)
    found = {r.record_id: r for r in table.collect()}
    assert found[2].n == 9007199254740993 and json.loads(found[2].rest) in ({"title": "z"}, {"name": "y"}) and found[90].name == "own"
    named = unified(records(spark, {1: [{"id": "a", "rest": 1, "Title": "x", "title": "y", "file_path": "f"}]}), report, "k")
    assert len({c.lower() for c in named.columns}) == len(named.columns) == 8 and named.first().rest_ == 1
    few = unified(frame, report, "k", most=2)
    assert len(few.columns) == 5 and "m" in json.loads(few.filter("record_id = 0").first().rest)
