"""Schemas that drift between the files of a stream: one report of changes and one consistent table.

Every file is profiled (types and value sketches for each path), consecutive files are compared, and
renames are the maximum-weight bipartite matching of vanished and new paths over the records which
both files hold, weighted by agreeing records, sketch overlap and name similarity.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.skew import HOT_ROWS, join_unique
from threadloom.session import checkpoint

#: Hashes kept in a value sketch (the smallest ones, so sketches merge).
SKETCH = 16
_TYPES = {str: "string", bool: "boolean", int: "number", float: "number", dict: "object", list: "array", type(None): "null"}


def parse_object(payload: str | None) -> dict | None:
    """The JSON object in a payload; None for null, blank or broken lines and other JSON values."""
    if not payload or "{" not in payload:
        return None
    try:
        found = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def paths_of(record: dict) -> Iterator[tuple[str, str, object]]:
    """(path, type, value) of every field, through nested objects with dots, not into arrays."""
    stack = [("", record)]
    while stack:
        prefix, at = stack.pop()
        for key, value in at.items():
            yield prefix + key, _TYPES[type(value)], value
            if isinstance(value, dict):
                stack.append((f"{prefix}{key}.", value))


def _digest(value: object) -> int:
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    text = value if isinstance(value, str) else json.dumps(value, sort_keys=True)
    return xxhash.xxh64_intdigest(text) >> 1


def profile(records: DataFrame) -> DataFrame:
    """(stream_name, file_no, path, type, seen, sketch), pre-aggregated within each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict = defaultdict(int)
            sketch: dict = defaultdict(set)
            for stream, file_no, payload in zip(batch["stream_name"], batch["file_no"], batch["payload"]):
                for path, kind, value in paths_of(parse_object(payload) or {}):
                    key = (stream, file_no, path, kind)
                    seen[key] += 1
                    if kind != "null":
                        sketch[key].add(_digest(value))
            yield pd.DataFrame(
                [(*key, n, sorted(sketch[key])[:SKETCH]) for key, n in seen.items()], columns=["stream_name", "file_no", "path", "type", "seen", "sketch"]
            )

    partial = records.select("stream_name", "file_no", "payload").mapInPandas(run, "stream_name string, file_no int, path string, type string, seen bigint, sketch array<bigint>")
    return partial.groupBy("stream_name", "file_no", "path", "type").agg(
        F.sum("seen").alias("seen"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, SKETCH).alias("sketch")
    )


def name_similarity(a: str, b: str) -> float:
    """0 to 1, on the words of the last part: createdAtMs, created_at_ms and created are alike."""
    words = [" ".join(re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+", x.rpartition(".")[2])).lower() for x in (a, b)]
    return SequenceMatcher(None, *words).ratio()


def best_matching(weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Maximum-weight bipartite matching of positive weights, by augmenting paths of largest gain."""
    left = sorted({a for a, _ in weights})
    right = sorted({b for _, b in weights})
    pair: dict[str, str] = {}
    while True:
        # longest path from an unmatched left node: forward edges add their weight, matched edges give theirs back
        gain = {("L", a): 0.0 for a in left if a not in pair}
        before: dict = {}
        back = {b: a for a, b in pair.items()}
        for _ in range(len(left) + len(right)):
            moved = False
            for (a, b), w in weights.items():
                if ("L", a) in gain and pair.get(a) != b and gain["L", a] + w > gain.get(("R", b), float("-inf")) + 1e-12:
                    gain["R", b], before["R", b], moved = gain["L", a] + w, a, True
            for b, a in back.items():
                if ("R", b) in gain and gain["R", b] - weights[a, b] > gain.get(("L", a), float("-inf")) + 1e-12:
                    gain["L", a], before["L", a], moved = gain["R", b] - weights[a, b], b, True
            if not moved:
                break
        ends = [(g, b) for (side, b), g in gain.items() if side == "R" and b not in back and g > 1e-12]
        if not ends:
            return sorted(pair.items())
        b: str | None = max(ends, key=lambda x: (x[0], x[1]))[1]
        while b is not None:
            a = before["R", b]
            nxt = before.get(("L", a)) if a in pair else None
            pair[a] = b
            b = nxt


def _agreements(pairs: DataFrame) -> DataFrame:
    """For each consecutive pair of files, vanished and new path: records that hold both, and those with equal values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both: dict = defaultdict(lambda: [0, 0])
            for stream, file_no, old, new, gone, come in zip(batch["stream_name"], batch["file_no"], batch["old_payload"], batch["payload"], batch["gone"], batch["come"]):
                gone, come = set(gone), set(come)
                before = [(p, k, v) for p, k, v in paths_of(parse_object(old) or {}) if p in gone]
                after = [(p, k, v) for p, k, v in paths_of(parse_object(new) or {}) if p in come]
                for p, k, v in before:
                    for q, kind, value in after:
                        count = both[stream, file_no, p, q]
                        count[0] += 1
                        count[1] += k == kind != "null" and _digest(v) == _digest(value)
            yield pd.DataFrame([(*key, *n) for key, n in both.items()], columns=["stream_name", "file_no", "old_path", "new_path", "together", "equal"])

    found = pairs.mapInPandas(run, "stream_name string, file_no int, old_path string, new_path string, together bigint, equal bigint")
    return found.groupBy("stream_name", "file_no", "old_path", "new_path").agg(F.sum("together").alias("together"), F.sum("equal").alias("equal"))


def drift_report(records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(file_path, change, old_path, new_path)`` of each file against the one before it in its stream.

    records: kind, stream_name, file_path, file_no, payload, key (the identity of a record, null if
    it has none). Rows without stream or file number and payloads that hold no JSON object are
    ignored; a stream of one file has no changes; repeated rows change nothing; an empty table gives
    an empty report.
    """
    records = records.filter("stream_name IS NOT NULL AND file_no IS NOT NULL")
    files = records.groupBy("stream_name", "file_no").agg(F.min("file_path").alias("file_path"))
    order = files.withColumn("before", F.lag("file_no").over(W.partitionBy("stream_name").orderBy("file_no"))).filter("before IS NOT NULL")  # rows are files, not records
    order = checkpoint(order)

    shape = profile(records).groupBy("stream_name", "file_no", "path").agg(
        F.array_sort(F.array_except(F.collect_set("type"), F.array(F.lit("null")))).alias("types"), F.flatten(F.collect_list("sketch")).alias("sketch")
    )
    whole = checkpoint(shape.groupBy("stream_name", "file_no").agg(F.collect_list(F.struct("path", "types", "sketch")).alias("fields")))
    empty = F.coalesce("fields", F.array().cast("array<struct<path:string,types:array<string>,sketch:array<bigint>>>"))
    two = order.join(whole, ["stream_name", "file_no"], "left").withColumn("fields", empty)
    old = whole.select("stream_name", F.col("file_no").alias("before"), F.col("fields").alias("old_fields"))
    two = two.join(old, ["stream_name", "before"], "left").withColumn("old_fields", F.coalesce("old_fields", F.array().cast("array<struct<path:string,types:array<string>,sketch:array<bigint>>>")))
    two = two.withColumn("gone", F.array_except(F.transform("old_fields", lambda x: x["path"]), F.transform("fields", lambda x: x["path"])))
    two = checkpoint(two.withColumn("come", F.array_except(F.transform("fields", lambda x: x["path"]), F.transform("old_fields", lambda x: x["path"]))))

    # records held by both files of a pair in which paths vanished and came
    open_pairs = two.filter("size(gone) > 0 AND size(come) > 0").select("stream_name", "file_no", "before", "gone", "come")
    keyed = records.filter("key IS NOT NULL").select("stream_name", "file_no", "key", "payload")
    now = keyed.withColumn("place", F.struct("stream_name", "file_no"))
    rows, sizes = records.count(), now.groupBy("place").agg(F.count("*").alias("n"))
    watched = open_pairs.withColumn("place", F.struct("stream_name", "file_no")).drop("stream_name", "file_no").join(sizes, "place")
    after = join_unique(now, watched, "place", "n", rows, hot_rows=hot_rows).drop("place")
    wanted = open_pairs.select("stream_name", F.col("before").alias("file_no")).distinct().withColumn("place", F.struct("stream_name", "file_no")).select("place").join(sizes, "place")
    earlier = join_unique(now, wanted, "place", "n", rows, hot_rows=hot_rows).select("stream_name", F.col("file_no").alias("before"), "key", F.col("payload").alias("old_payload"))
    agreed = _agreements(after.join(earlier, ["stream_name", "before", "key"]).select("stream_name", "file_no", "old_payload", "payload", "gone", "come"))
    possible = agreed.filter("together > 0 AND together = equal").groupBy("stream_name", "file_no").agg(F.collect_list(F.struct("old_path", "new_path", "together")).alias("possible"))

    def changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file_path, before, after_, gone, come, links in zip(batch["file_path"], batch["old_fields"], batch["fields"], batch["gone"], batch["come"], batch["possible"]):
                was, now_ = {f["path"]: f for f in before}, {f["path"]: f for f in after_}
                weights = {}
                for link in links if links is not None else ():
                    a, b = link["old_path"], link["new_path"]
                    x, y = set(was[a]["sketch"]), set(now_[b]["sketch"])
                    weights[a, b] = 1 + link["together"] + len(x & y) / max(1, len(x | y)) + name_similarity(a, b)
                renamed = best_matching(weights)
                lost, new = {a for a, _ in renamed}, {b for _, b in renamed}
                out += [(file_path, "renamed", a, b) for a, b in renamed]
                out += [(file_path, "removed", p, "") for p in gone if p not in lost]
                out += [(file_path, "added", "", p) for p in come if p not in new]
                out += [(file_path, "retyped", p, p) for p in was if p in now_ and len(was[p]["types"]) and len(now_[p]["types"]) and list(was[p]["types"]) != list(now_[p]["types"])]
            yield pd.DataFrame(out, columns=["file_path", "change", "old_path", "new_path"])

    ready = two.join(possible, ["stream_name", "file_no"], "left").select("file_path", "old_fields", "fields", "gone", "come", "possible")
    return ready.mapInPandas(changes, "file_path string, change string, old_path string, new_path string").distinct()


#: Columns of a unified table; the fields seen least stay in its ``rest``.
MOST_COLUMNS = 2_000
_LEAF_TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean"}


def _leaf(kind: str, value: object) -> str:
    return "integer" if kind == "number" and isinstance(value, int) and abs(value) < 1 << 63 else kind


def _leaves(records: DataFrame) -> DataFrame:
    """(stream_name, path, type, n) of the fields that hold values, integers apart from other numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict = defaultdict(int)
            for stream, payload in zip(batch["stream_name"], batch["payload"]):
                for path, kind, value in paths_of(parse_object(payload) or {}):
                    if kind not in ("object", "null"):
                        seen[stream, path, _leaf(kind, value)] += 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["stream_name", "path", "type", "n"])

    return records.select("stream_name", "payload").mapInPandas(run, "stream_name string, path string, type string, n bigint").groupBy("stream_name", "path", "type").agg(F.sum("n").alias("n"))


def unified(records: DataFrame, report: DataFrame, kind: str, most: int = MOST_COLUMNS) -> DataFrame:
    """All records of one kind in one wide table: paths renamed within a stream share the column of their commonest name.

    Columns are record_id, file_path, one for each leaf field (objects are opened, arrays stay JSON text) and
    ``rest``. A column whose values are all integers, numbers or truth values has that type, any other is
    text; a field that a record lacks is null. ``rest`` holds as JSON what has no column of its own: the second of
    two values of one record that share a column, and fields beyond the ``most`` commonest. No value is lost.
    """
    own = records.filter(F.col("kind") == kind)
    leaves = checkpoint(_leaves(own))
    common = leaves.groupBy("path").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "path").limit(most)  # the columns: at most ``most`` names come to the driver
    total = {r["path"]: r["n"] for r in common.collect()}
    files = own.select("file_path", "stream_name").distinct()
    renames = report.filter("change = 'renamed'").join(files, "file_path").select("stream_name", "old_path", "new_path").distinct()
    names = sorted(total)
    kept = F.broadcast(records.sparkSession.createDataFrame([(n,) for n in names], "path string"))
    renames = renames.join(kept.withColumnRenamed("path", "old_path"), "old_path").join(kept.withColumnRenamed("path", "new_path"), "new_path")
    group: dict[tuple[str, str], str] = {}  # (stream, path) to the path that names its column; one entry a renamed path of the kept ones

    def top(stream: str, p: str) -> str:
        while group.get((stream, p), p) != p:
            p = group[stream, p]
        return p

    for r in sorted(renames.select("stream_name", "old_path", "new_path").toLocalIterator()):
        a, b = sorted((top(r[0], r[1]), top(r[0], r[2])), key=lambda p: (-total[p], p))
        group[r[0], b] = a
    column = {k: top(*k) for k in group}
    mapping = records.sparkSession.createDataFrame([(s, p, c) for (s, p), c in column.items()], "stream_name string, path string, shown string")
    kinds = leaves.join(kept, "path").join(F.broadcast(mapping), ["stream_name", "path"], "left").groupBy(F.coalesce("shown", "path").alias("column"), "type").agg(F.sum("n").alias("n")).collect()
    types: dict[str, set[str]] = defaultdict(set)
    for r in kinds:
        types[r["column"]].add(r["type"])
    shown = sorted(types)
    of = {c: "double" if types[c] == {"integer", "number"} else _LEAF_TYPES.get(next(iter(types[c])), "string") if len(types[c]) == 1 else "string" for c in shown}
    place = {c: i for i, c in enumerate(shown)}
    labels: list[str] = []  # column names: not those of the table itself, and no two alike but for letter case
    taken = {"record_id", "file_path", "rest"}
    for c in shown:
        label = c
        while label.lower() in taken:
            label += "_"
        taken.add(label.lower())
        labels.append(label)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record_id, file_path, stream, payload in zip(batch["record_id"], batch["file_path"], batch["stream_name"], batch["payload"]):
                record = parse_object(payload)
                if record is None:
                    continue
                row: list = [None] * len(shown)
                rest = {}
                for path, kind_, value in sorted(paths_of(record), key=lambda x: x[0]):
                    if kind_ in ("object", "null"):
                        continue
                    name = column.get((stream, path), path)
                    at = place.get(name)
                    if at is None or row[at] is not None:
                        rest[path] = value
                    elif of[name] == "string":
                        row[at] = value if isinstance(value, str) else json.dumps(value)
                    else:
                        row[at] = float(value) if of[name] == "double" else value
                out.append((record_id, file_path, *row, json.dumps(rest, sort_keys=True) if rest else None))
            frame = pd.DataFrame(out, columns=["record_id", "file_path", *labels, "rest"])
            for name, label in zip(shown, labels):
                if of[name] in ("bigint", "double"):
                    frame[label] = frame[label].astype("Int64" if of[name] == "bigint" else "Float64")
            yield frame

    columns = "".join(f", `{label.replace('`', '``')}` {of[n]}" for n, label in zip(shown, labels))
    return own.select("record_id", "file_path", "stream_name", "payload").mapInPandas(run, f"record_id bigint, file_path string{columns}, rest string")
