"""Parent-child rows to full hierarchies: root, depth, path, descendants, cycles.

Components are brought together in one bucket, and an iterative depth-first traversal with node colours
runs over each of them. Rows without a scope are searched for components first; a scope is a union of
components, so its rows are brought together by scope and parted into components in the bucket. A
component too large for one task is resolved by pointer doubling instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.components import connected_components
from threadloom.operators.skew import HOT_ROWS, join_unique
from threadloom.session import checkpoint

#: Largest component, in nodes, that one task traverses.
COMPONENT_LIMIT = 500_000
#: Nodes a bucket of small components holds on average.
BUCKET_ROWS = 100_000
#: Rows and path entries that a task hands over at once.
BATCH_ROWS, BATCH_ENTRIES = 20_000, 500_000


class Finish(NamedTuple):
    """More columns for the nodes of a scope, computed twice with one meaning.

    ``bucket`` sees whole scopes as pandas rows in the task that traversed them, ``frame`` sees the nodes
    of scopes too large for a task.
    """

    schema: str
    bucket: Callable[[pd.DataFrame], pd.DataFrame]
    frame: Callable[[DataFrame], DataFrame]


def _components(up: list[int]) -> list[list[int]]:
    """The connected components of the links, by union and find; each in the order of its nodes."""
    over = list(range(len(up)))

    def find(i: int) -> int:
        while over[i] != i:
            over[i] = i = over[over[i]]
        return i

    for i, p in enumerate(up):
        if p >= 0:
            over[find(i)] = find(p)
    members: dict[int, list[int]] = {}
    for i in range(len(up)):
        members.setdefault(find(i), []).append(i)
    return list(members.values())


def _traverse(keys: list, parents: list, marks: list, replies: list) -> tuple[pd.DataFrame, list[int]]:
    """Each component's iterative depth-first traversal. Colours: 0 unseen, 1 on the stack, 2 finished.

    Also gives the nodes of trees in the order of their visits.
    """
    n = len(keys)
    place = {k: i for i, k in enumerate(keys)}
    up = [place.get(p, -1) if p is not None else -1 for p in parents]
    below: list[list[int]] = [[] for _ in range(n)]
    for i, p in enumerate(up):
        if p >= 0:
            below[p].append(i)
    colour, root, depth, size, order = bytearray(n), [-1] * n, [-1] * n, [0] * n, [0] * n
    seen_mark, answered, back = [-1] * n, bytearray(n), bytearray(n)
    visited: list[int] = []
    # a component has one root, or none where its links close a cycle; roots are visited in key order
    starts = [(next((i for i in component if up[i] < 0), None), component) for component in _components(up)]
    for first, component in sorted(starts, key=lambda x: (x[0] is None, keys[x[0]] if x[0] is not None else keys[x[1][0]])):
        stack = [first] if first is not None else []
        while stack:
            i = stack[-1]
            if colour[i] == 0:
                colour[i] = 1
                order[i] = len(visited)
                visited.append(i)
                p = up[i]
                root[i], depth[i] = (root[p], depth[p] + 1) if p >= 0 else (i, 0)
                if p >= 0:
                    seen_mark[i] = p if marks[p] else seen_mark[p]
                    if replies[i] and seen_mark[i] >= 0:
                        answered[seen_mark[i]] = 1
                stack.extend(sorted(below[i], key=keys.__getitem__, reverse=True))
            else:
                stack.pop()
                if colour[i] == 1:
                    colour[i] = 2
                    size[i] = sum(size[c] + 1 for c in below[i])
        for start in component:  # what no root reaches lies on a cycle or below one
            i, trail = start, []
            while colour[i] == 0:
                colour[i] = 1
                trail.append(i)
                i = up[i]
            if trail and colour[i] == 1:  # the parent is still grey: a cycle is closed, and its smallest node stands for the edge
                back[min(trail[trail.index(i) :], key=keys.__getitem__)] = 1
            for j in trail:
                colour[j] = 2
    out = {
        "root": [keys[r] if r >= 0 else None for r in root],
        "depth": depth,
        "in_cycle": [d < 0 for d in depth],
        "back_edge": [bool(b) for b in back],
        "has_parent": [p >= 0 for p in up],
        "descendants": [s if d >= 0 else -1 for s, d in zip(size, depth)],
        "visit": order,
        "marked": [keys[m] if m >= 0 else None for m in seen_mark],
        "answered": [bool(a) for a in answered],
    }
    return pd.DataFrame(out), visited


def _with_paths(out: pd.DataFrame, keys: list, visited: list[int]) -> Iterator[pd.DataFrame]:
    """The rows in order of visit with their paths, a bounded number of path entries at once."""
    trail: list = []
    at: list[int] = []
    paths: list = []
    entries = 0
    depth = out["depth"].tolist()
    for i in visited:
        del trail[depth[i] :]
        trail.append(keys[i][1])
        at.append(i)
        paths.append(list(trail))
        entries += len(trail)
        if len(at) >= BATCH_ROWS or entries >= BATCH_ENTRIES:
            yield out.iloc[at].assign(path=paths)
            at, paths, entries = [], [], 0
    if at:
        yield out.iloc[at].assign(path=paths)
    cyclic = out[out["depth"] < 0]
    if len(cyclic):
        yield cyclic.assign(path=[None] * len(cyclic))


FIELDS = "scope string, node string, root string, depth bigint, in_cycle boolean, back_edge boolean, has_parent boolean, descendants bigint, visit bigint, marked string, answered boolean"


def _schema(with_paths: bool, more: str = "") -> T.StructType:
    return T._parse_datatype_string(FIELDS + (", path array<string>" if with_paths else "") + (f", {more}" if more else ""))


def _bucket_traversal(rows: DataFrame, with_paths: bool, carried: str, apart: bool = False, finish: Finish | None = None) -> DataFrame:
    """Traverses the partitions of ``rows``, each of which holds whole components, or whole scopes.

    ``apart`` sets the visits of each partition above those of the others, for scopes that lie in several.
    """
    schema = _schema(with_paths, ", ".join(x for x in (carried, finish.schema if finish else "") if x))
    names = schema.names
    own = [c for c in rows.columns if c not in ("scope", "node", "parent", "mark", "reply", "component")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        whole = pd.concat(parts, ignore_index=True)
        del parts
        keys = list(zip(whole["scope"], whole["node"]))
        ups = [(s, p) if p is not None else None for s, p in zip(whole["scope"], whole["parent"])]
        out, visited = _traverse(keys, ups, whole["mark"].tolist(), whole["reply"].tolist())
        for c in ("root", "marked"):
            out[c] = [x[1] if x is not None else None for x in out[c]]
        if apart:
            out["visit"] += (TaskContext.get().partitionId() + 1) << 40
        for c in ("scope", "node", *own):
            out[c] = whole[c]
        del whole
        if finish:
            out = finish.bucket(out)
        if with_paths:
            yield from (part[names] for part in _with_paths(out, keys, visited))
        else:
            for at in range(0, len(out), BATCH_ROWS):
                yield out[names].iloc[at : at + BATCH_ROWS]

    return rows.mapInPandas(run, schema)


def _sorted_nodes(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """The nodes of trees, siblings side by side in key order, numbered in ``at``.

    ``pk`` is the parent with a mark before it, ``0`` for a root, ``k`` the node with that mark; ``next`` is the
    following sibling, or for a root the following root of its scope. The order is a distributed sort.
    """
    trees = rows.select("scope", "node", "parent").join(whole.filter("root IS NOT NULL").select("scope", "node", "has_parent"), ["scope", "node"])
    trees = trees.select("scope", "node", F.when(F.col("has_parent"), F.concat(F.lit("1"), "parent")).otherwise("0").alias("pk"), F.concat(F.lit("1"), "node").alias("k"))
    ranged = checkpoint(trees.repartitionByRange("scope", "pk", "k").sortWithinPartitions("scope", "pk", "k").withColumn("at", F.monotonically_increasing_id()))
    ends = sorted(ranged.groupBy(F.shiftright("at", 33)).agg(F.min("at"), F.max("at")).collect())  # one row a partition
    after = rows.sparkSession.createDataFrame([(x[2], y[1]) for x, y in zip(ends, ends[1:])], "at bigint, begins bigint")
    following = ranged.select(F.col("at").alias("next"), F.col("scope").alias("s"), F.col("pk").alias("p"))
    linked = ranged.join(F.broadcast(after), "at", "left").withColumn("next", F.coalesce("begins", F.col("at") + 1)).drop("begins").join(following, "next", "left")
    return checkpoint(linked.select("scope", "node", "pk", "k", "at", F.when((F.col("s") == F.col("scope")) & (F.col("p") == F.col("pk")), F.col("next")).alias("next")))


def _visits(nodes: DataFrame) -> DataFrame:
    """``(scope, node, visit, descendants)``: the Euler tour of the trees of a scope, ranked by pointer doubling.

    Every node is entered (arc 2 at) and left (arc 2 at + 1). An arc has one successor and one
    predecessor, so no join is skewed, and the rows are two a node however deep the trees are.
    """
    first = nodes.filter("pk <> '0'").groupBy("scope", F.col("pk").alias("k")).agg(F.min("at").alias("first"))
    above = nodes.select("scope", F.col("k").alias("pk"), F.col("at").alias("above"))
    entered = nodes.join(first, ["scope", "k"], "left").select((2 * F.col("at")).alias("arc"), F.coalesce(2 * F.col("first"), 2 * F.col("at") + 1).alias("to"), F.lit(1).cast("bigint").alias("n"))
    left_last = nodes.filter("next IS NULL").join(above, ["scope", "pk"], "left").select((2 * F.col("at") + 1).alias("arc"), (2 * F.col("above") + 1).alias("to"), F.lit(0).cast("bigint").alias("n"))
    left = nodes.filter("next IS NOT NULL").select((2 * F.col("at") + 1).alias("arc"), (2 * F.col("next")).alias("to"), F.lit(0).cast("bigint").alias("n"))
    arcs = checkpoint(entered.unionByName(left_last).unionByName(left))
    while arcs.filter("`to` IS NOT NULL").limit(1).count():
        ahead = arcs.select(F.col("arc").alias("to"), F.col("to").alias("far"), F.col("n").alias("more"))
        arcs = checkpoint(arcs.join(ahead, "to", "left").select("arc", F.col("far").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), in_loop=True)
    enter = F.col("arc") % 2 == 0
    ranks = arcs.groupBy(F.shiftright("arc", 1).alias("at")).agg(F.max(F.when(enter, F.col("n"))).alias("entered"), F.max(F.when(~enter, F.col("n"))).alias("left"))
    counts = nodes.groupBy("scope").agg(F.count("*").alias("all"))  # each scope holds a component beyond the limit
    out = nodes.select("scope", "node", "at").join(ranks, "at").join(F.broadcast(counts), "scope")
    return out.select("scope", "node", (F.col("all") - F.col("entered")).alias("visit"), (F.col("entered") - F.col("left") - 1).alias("descendants"))


def _long_paths(nodes: DataFrame, total: int, hot_rows: int) -> DataFrame:
    """``(scope, node, path)`` from all ancestor links: a round joins the links so far to jumps of 1, 2, 4, ... steps.

    Every link is made once, so there are as many rows as the result itself demands.
    """

    def joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        return join_unique(left, right.join(left.groupBy(key).agg(F.count("*").alias("times")), key), key, "times", max(total, left.count()), "inner", hot_rows)

    below = nodes.filter("pk <> '0'").select("at", F.struct("scope", "pk").alias("key"))
    jumps = checkpoint(joined(below, nodes.select(F.struct("scope", F.col("k").alias("pk")).alias("key"), F.col("at").alias("to")), "key").select("at", "to"))
    links, step = jumps.select("at", F.col("to").alias("above"), F.lit(1).cast("bigint").alias("distance")), 1
    while jumps.limit(1).count():
        more = jumps.join(links.select(F.col("at").alias("to"), "above", "distance"), "to").select("at", "above", (F.col("distance") + step).alias("distance"))
        links = links.unionByName(checkpoint(more, in_loop=True))
        jumps = checkpoint(joined(jumps, jumps.select(F.col("at").alias("to"), F.col("to").alias("far")), "to").select("at", F.col("far").alias("to")), in_loop=True)
        step *= 2
    named = joined(links, nodes.select(F.col("at").alias("above"), F.col("node").alias("name")), "above")
    paths = named.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("distance", "name")), asc=False)["name"].alias("up"))
    return nodes.join(paths, "at", "left").select("scope", "node", F.concat(F.coalesce("up", F.array().cast("array<string>")), F.array("node")).alias("path"))


def _doubling(rows: DataFrame, total: int, with_paths: bool, hot_rows: int, own: Sequence[str]) -> DataFrame:
    """Exact way for components beyond COMPONENT_LIMIT: ancestors 1, 2, 4, ... steps up, one join a round.

    ``visit`` and ``descendants`` come from the ranked Euler tour, paths, where asked for, from the closed ancestor
    links. The smallest node of a cycle has its ``back_edge``.
    """
    key = F.struct("scope", "node")
    state = rows.select(
        "scope", "node", "mark", key.alias("k"), F.when(F.col("parent").isNotNull(), F.struct("scope", F.col("parent").alias("node"))).alias("up")
    )
    parents = state.select(F.col("k").alias("up"), F.col("mark").alias("up_mark"), F.lit(True).alias("found"))
    degree = state.filter("up IS NOT NULL").groupBy("up").agg(F.count("*").alias("n"))
    state = join_unique(state.drop("mark"), parents.join(degree, "up"), "up", "n", total, "left", hot_rows)
    state = state.select(
        "scope", "node", "k", F.when(F.col("found"), F.col("up")).alias("up"), F.coalesce("found", F.lit(False)).alias("has_parent"),
        F.when(F.col("found"), 1).otherwise(0).cast("bigint").alias("depth"), F.when(F.col("up_mark"), F.col("up")).alias("marked"),
    )
    state = checkpoint(state.withColumn("root", F.when(F.col("up").isNull(), F.col("k"))))
    done, active = state.filter("root IS NOT NULL"), state.filter("root IS NULL")
    left, rounds = active.count(), 0
    while left and 2**rounds <= 2 * total:
        known = state.select(F.col("k").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"), F.col("marked").alias("far_mark"), F.coalesce("root", F.when(F.col("up").isNull(), F.col("k"))).alias("far_root"))
        degree = active.groupBy("up").agg(F.count("*").alias("n"))
        stepped = join_unique(active.drop("root"), known.join(degree, "up"), "up", "n", left, "inner", hot_rows)
        active_next = checkpoint(stepped.select("scope", "node", "k", F.col("far").alias("up"), "has_parent", (F.col("depth") + F.col("more")).alias("depth"), F.coalesce("marked", "far_mark").alias("marked"), F.col("far_root").alias("root")), in_loop=True)
        done = done.unionByName(active_next.filter("root IS NOT NULL"))
        active = active_next.filter("root IS NULL")
        state = done.unionByName(active)
        left, rounds = active.count(), rounds + 1
    whole = done.unionByName(active)
    cyclic = F.col("root").isNull()
    # after more steps than there are nodes every jump ends on the cycle, and each node of the cycle is such an end
    on_cycle = active.select("up.scope", "up.node").distinct().join(rows.select("scope", "node", "component"), ["scope", "node"])
    closing = on_cycle.groupBy("component").agg(F.min(F.struct("scope", "node")).alias("c")).select("c.scope", "c.node", F.lit(True).alias("closes"))
    out = whole.join(closing, ["scope", "node"], "left").select(
        "scope", "node", F.col("root.node").alias("root"), F.when(cyclic, F.lit(-1)).otherwise(F.col("depth")).cast("bigint").alias("depth"), cyclic.alias("in_cycle"),
        F.coalesce("closes", F.lit(False)).alias("back_edge"), "has_parent", F.when(~cyclic, F.col("marked.node")).alias("marked"),
    )
    nodes = _sorted_nodes(rows, whole)
    out = out.join(_visits(nodes), ["scope", "node"], "left").withColumn("visit", F.when(F.col("in_cycle"), 0).otherwise(F.col("visit"))).withColumn("descendants", F.when(F.col("in_cycle"), -1).otherwise(F.col("descendants")))
    if with_paths:
        out = out.join(_long_paths(nodes, total, hot_rows), ["scope", "node"], "left")
    out = checkpoint(out.join(rows.select("scope", "node", "reply", *own), ["scope", "node"]))
    asked = out.filter("reply AND marked IS NOT NULL").select("scope", F.col("marked").alias("node")).distinct().withColumn("answered", F.lit(True))
    out = out.join(asked, ["scope", "node"], "left").withColumn("answered", F.coalesce("answered", F.lit(False)))
    return out.select(*_schema(with_paths).names, *own)


def hierarchy(
    rows: DataFrame, node: str, parent: str, scope: str | None = None, mark: str | None = None, reply: str | None = None, carry: Sequence[str] = (), latest: Column | None = None,
    finish: Finish | None = None, with_paths: bool = False, component_limit: int = COMPONENT_LIMIT, bucket_rows: int = BUCKET_ROWS, hot_rows: int = HOT_ROWS, alone: bool = False,
) -> DataFrame:
    """Every node of ``rows`` with root, depth, descendants and cycle flags.

    A parent counts if it is a node of the same ``scope``; without ``scope`` all rows are one scope, and
    nodes without any link are roots of their own with ``alone``, else they are left out. Null nodes are ignored; an empty input gives an empty
    result. Of repeated nodes the row with the largest ``latest`` holds, or without it the smallest
    non-null parent and any mark. A node on a cycle or below one has ``in_cycle``, depth -1 and no root.
    ``mark`` names a boolean column; ``marked`` is then the nearest ancestor that has it, and ``answered``
    tells whether a node is that of one with ``reply``. ``carry`` names columns that are handed through;
    they need ``latest`` and names other than those of the result. Children are visited in key order, so
    ``visit`` is stable and no two nodes of trees in one scope share it. ``finish`` adds columns that depend on the whole scope.
    A scope of at most ``component_limit`` rows is brought together in one shuffle; larger scopes are cut
    into components, and components beyond the limit take doubling.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(False)
    base = rows.select(
        F.coalesce(F.col(scope).cast("string") if scope else F.lit(""), F.lit("")).alias("scope"), F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent"),
        flag(mark).alias("mark"), flag(reply).alias("reply"), *carry, *([latest.alias("latest")] if latest is not None else []),
    ).filter("node IS NOT NULL")
    kinds = dict(base.dtypes)
    carried = ", ".join(f"`{c}` {kinds[c]}" for c in carry)

    def folded(df: DataFrame) -> DataFrame:
        grouped = df.groupBy("scope", "node")
        if latest is None:
            return grouped.agg(F.min("parent").alias("parent"), F.max("mark").alias("mark"), F.max("reply").alias("reply"))
        return grouped.agg(F.max(F.struct("latest", "parent", "mark", "reply", *carry)).alias("v")).select("scope", "node", *(f"v.{c}" for c in ("parent", "mark", "reply", *carry)))

    def buckets(total: int) -> int:
        return max(1, -(-total // bucket_rows), rows.sparkSession.sparkContext.defaultParallelism if total > 10_000 else 1)

    small = None
    if scope:
        sizes = base.groupBy("scope").agg(F.count("*").alias("rows_in_scope"))
        total, largest = sizes.agg(F.coalesce(F.sum("rows_in_scope"), F.lit(0)), F.coalesce(F.max("rows_in_scope"), F.lit(0))).first()
        whole = base
        if largest > component_limit:
            large = F.broadcast(sizes.filter(F.col("rows_in_scope") > component_limit).select("scope"))  # at most total / component_limit rows
            whole, base = base.join(large, "scope", "left_anti"), checkpoint(folded(base.join(large, "scope", "left_semi")))
        # one exchange by scope; the fold of repeated nodes and the traversal both keep it
        small = _bucket_traversal(folded(whole.repartition(buckets(total), "scope")), with_paths, carried, finish=finish)
        if largest <= component_limit:
            return small
    else:
        base = checkpoint(folded(base))
        total = base.count()
    links = base.filter("parent IS NOT NULL").join(base.select("scope", F.col("node").alias("parent")), ["scope", "parent"], "left_semi")
    links = checkpoint(links.select(F.xxhash64("scope", "node").alias("a"), F.xxhash64("scope", "parent").alias("b")))
    labels = connected_components(links, hot_rows).unionByName(links.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))).groupBy(F.col("node").alias("h")).agg(F.min("component").alias("component"))
    labelled = checkpoint(base.withColumn("h", F.xxhash64("scope", "node")).join(labels, "h", "left" if scope or alone else "inner").withColumn("component", F.coalesce("component", "h")).drop("h"))
    sizes = labelled.groupBy("component").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    ordinary = labelled
    if largest > component_limit:
        huge = F.broadcast(sizes.filter(F.col("n") > component_limit).select("component"))  # at most total / component_limit rows
        ordinary = labelled.join(huge, "component", "left_anti")
    out = _bucket_traversal(ordinary.repartition(buckets(total), "component"), with_paths, carried, apart=True)
    if largest > component_limit:
        out = out.unionByName(_doubling(checkpoint(labelled.join(huge, "component", "left_semi")), total, with_paths, hot_rows, carry))
    if finish:
        out = finish.frame(out)
    return out if small is None else small.unionByName(out)


def descendant_pairs(tree: DataFrame) -> DataFrame:
    """``(scope, ancestor, descendant, distance)`` from a hierarchy made with paths; nodes in cycles have none."""
    pairs = tree.filter("path IS NOT NULL").select("scope", F.col("node").alias("descendant"), F.posexplode("path").alias("at", "ancestor"), F.size("path").alias("n"))
    return pairs.filter("at < n - 1").select("scope", "ancestor", "descendant", (F.col("n") - 1 - F.col("at")).cast("bigint").alias("distance"))
