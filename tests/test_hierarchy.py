import random

import pytest

from threadloom.operators.components import connected_components
from threadloom.operators.hierarchy import descendant_pairs, hierarchy


def brute(rows):
    """(scope, node) to (root, depth, marked) by walking up; None root on circles."""
    up, marks = {}, {}
    for scope, node, parent, mark in rows:
        up.setdefault((scope, node), parent)
        marks[scope, node] = mark
    out = {}
    for scope, node in up:
        seen, at, depth, near = {node}, node, 0, None
        while (p := up[scope, at]) is not None and (scope, p) in up:
            if p in seen:
                depth = -1
                break
            if near is None and marks[scope, p]:
                near = p
            seen.add(p)
            at, depth = p, depth + 1
        out[scope, node] = (None, -1, None) if depth < 0 else (at, depth, near)
    return out


def forest(seed, n=120):
    r = random.Random(seed)
    return [(r.choice("ab"), str(i), None if r.random() < 0.15 else str(r.randrange(n + 5)), r.random() < 0.5) for i in range(n)]


@pytest.mark.parametrize("seed,limit,hot", [(1, 10**6, 10**6), (2, 3, 2), (3, 0, 1)])
def test_scoped_forest_matches_brute_force(spark, seed, limit, hot):
    rows = forest(seed)
    frame = spark.createDataFrame(rows, "s string, n string, p string, m boolean")
    found = hierarchy(frame, "n", "p", scope="s", mark="m", component_limit=limit, hot_rows=hot)
    assert {(r.scope, r.node): (r.root, r.depth, r.marked) for r in found.collect()} == brute(rows)


@pytest.mark.parametrize("limit,hot", [(10**6, 10**6), (2, 1)])
def test_unscoped_leaves_out_rows_without_links(spark, limit, hot):
    rows = [(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 6), (8, 8), (9, None)]
    frame = spark.createDataFrame(rows, "id bigint, up bigint")
    got = {r.node: (r.root, r.depth) for r in hierarchy(frame, "id", "up", component_limit=limit, hot_rows=hot).collect()}
    assert got == {"1": ("1", 0), "2": ("1", 1), "3": ("1", 2), "5": (None, -1), "6": (None, -1), "7": (None, -1), "8": (None, -1)}


def test_deep_chain_and_paths(spark):
    n = 300
    frame = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "id bigint, up bigint")
    tree = hierarchy(frame, "id", "up", with_paths=True)
    deepest = tree.filter("node = '299'").first()
    assert deepest.depth == n - 1 and deepest.path == [str(i) for i in range(n)]
    assert tree.filter("node = '0'").first().descendants == n - 1
    assert descendant_pairs(tree).count() == n * (n - 1) // 2
    assert hierarchy(frame, "id", "up", component_limit=10).filter("node = '299'").first().depth == n - 1


def test_empty_nulls_repeats_and_clashing_names(spark):
    empty = spark.createDataFrame([], "id string, up string")
    assert hierarchy(empty, "id", "up").count() == 0
    assert hierarchy(empty.selectExpr("id", "up", "'x' AS s"), "id", "up", scope="s").count() == 0
    rows = spark.createDataFrame([(None, "a", 1, True), ("a", None, 2, True), ("b", "a", 3, False), ("b", "a", 3, False)], "node string, parent string, component int, mark boolean")
    assert sorted((r.node, r.root, r.depth) for r in hierarchy(rows, "node", "parent").collect()) == [("a", "a", 0), ("b", "a", 1)]


def test_components_ignore_order_and_repeats(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    label = {}

    def top(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            label[y] = x
    for hot in (1, 10**6):
        got = {n.node: n.component for n in connected_components(spark.createDataFrame(edges * 2 + [(None, 3)], "a bigint, b bigint"), hot_rows=hot).collect()}
        assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}


def test_large_components_get_paths_descendants_order_and_back_edges(spark):
    r = random.Random(4)
    rows = [("ab"[i % 2], str(i), None if i < 4 else str(i - r.choice((2, 2, 4, 20)) if i > 22 else i % 2)) for i in range(60)] + [("a", f"c{i}", f"c{(i + 1) % 5}") for i in range(5)] + [("a", "below", "c3")]
    frame = spark.createDataFrame(rows, "s string, n string, p string")
    want, tree = ({(x.scope, x.node): x for x in hierarchy(frame, "n", "p", scope="s", with_paths=True).collect()}, hierarchy(frame, "n", "p", scope="s", with_paths=True, component_limit=1).cache())
    got = {(x.scope, x.node): x for x in tree.collect()}
    assert len(got) == len(rows) and all((got[k].root, got[k].depth, got[k].descendants, got[k].path) == (x.root, x.depth, x.descendants, x.path) for k, x in want.items())

    def order(found):
        return {(s, root): [x.node for x in sorted((x for x in found.values() if (x.scope, x.root) == (s, root)), key=lambda x: x.visit)] for s, root in {(x.scope, x.root) for x in found.values() if x.root}}

    assert order(got) == order(want)
    placed = [(x.scope, x.visit) for x in got.values() if not x.in_cycle]
    assert len(set(placed)) == len(placed) and sum(x.back_edge for x in got.values()) == 1
    assert {tuple(p) for p in descendant_pairs(tree).collect()} == {(s, a, n, len(x.path) - 1 - i) for (s, n), x in want.items() if x.path for i, a in enumerate(x.path[:-1])}


@pytest.mark.parametrize("limit", [10**6, 5, 0])
def test_latest_row_holds_carries_columns_and_knows_its_replies(spark, limit):
    rows = [("s", "1", None, True, False, 1, "old"), ("s", "1", None, True, False, 2, "new"), ("s", "2", "1", False, False, 1, None), ("s", "3", "2", True, True, 1, "c"), ("s", "4", "1", True, False, 1, "d"),
            ("s", "5", "6", True, True, 1, "e"), ("s", "6", "5", True, True, 1, "f"), ("t", "1", "9", True, True, 1, "g")]
    frame = spark.createDataFrame(rows, "s string, n string, p string, m boolean, r boolean, v int, said string")
    tree = hierarchy(frame, "n", "p", scope="s", mark="m", reply="r", carry=["said"], latest=frame.v, component_limit=limit)
    assert {(x.scope, x.node): (x.said, x.marked, x.answered, x.depth) for x in tree.collect()} == {
        ("s", "1"): ("new", None, True, 0), ("s", "2"): (None, "1", False, 1), ("s", "3"): ("c", "1", False, 2), ("s", "4"): ("d", "1", False, 1),
        ("s", "5"): ("e", None, False, -1), ("s", "6"): ("f", None, False, -1), ("t", "1"): ("g", None, False, 0),
    }


def test_paths_of_a_long_chain_come_in_bounded_batches():
    from threadloom.operators import hierarchy as h

    parts = list(h._with_paths(*_walk(h, 2_000)))
    assert max(len(p) for p in parts) <= h.BATCH_ROWS and max(sum(map(len, p["path"])) for p in parts if p["path"].notna().any()) < h.BATCH_ENTRIES + 2_001
    assert sum(len(p) for p in parts) == 2_000


def _walk(h, n):
    keys = [("", f"{i:06d}") for i in range(n)]
    out, visited = h._traverse(keys, [None, *keys[:-1]], [False] * n, [False] * n)
    return out, keys, visited


def test_every_node_has_its_row_and_its_descendants_at_any_size(spark, tmp_path, monkeypatch):
    from functools import partial

    from threadloom.catalog import trees

    notes = [(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, None), (8, 8)]
    spark.createDataFrame(notes, "id bigint, supersedes bigint").write.parquet(f"{tmp_path}/memories.parquet")
    said = [("c", "a", None), ("c", "b", " a "), ("c", "d", "b"), ("c", "e", "a"), ("c", "x", "y"), ("c", "y", "x"), ("t", "a", "b")]
    spark.createDataFrame(said, "conversation_uuid string, uuid string, parent_message_uuid string").write.parquet(f"{tmp_path}/chat_messages.parquet")
    for limit in (10**6, 1):
        monkeypatch.setattr(trees, "hierarchy", partial(hierarchy, component_limit=limit))
        of = lambda frame: {(x.src, x.scope, x.node): x.descendants for x in frame.collect()}
        linked = of(trees._trees(spark, str(tmp_path), False))
        assert linked == {
            **{("memories", "", n): k for n, k in (("1", 2), ("2", 1), ("3", 0), ("5", -1), ("6", -1), ("8", -1))},
            **{("chat_messages", "c", n): k for n, k in (("a", 3), ("b", 1), ("d", 0), ("e", 0), ("x", -1), ("y", -1))}, ("chat_messages", "t", "a"): 0,
        }
        nodes = trees.p5_nodes(spark, str(tmp_path)).cache()
        assert of(nodes) == linked | {("memories", "", "4"): 0, ("memories", "", "7"): 0}
        assert [(x.root, x.path, x.depth, x.in_cycle) for x in nodes.filter("node = '7'").collect()] == [("7", "7", 0, False)]
