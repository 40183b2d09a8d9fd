"""Merging incoming records into the archive: turns, spans, matches, outcomes and enrichment, set by set."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.json_edit import merge_patch
from threadloom.functions.text import instant
from threadloom.operators.quality import typed_digest
from threadloom.operators.skew import join_unique, numbered, running_sum
from threadloom.session import checkpoint


#: Microseconds of a day, the width of a time bucket.
DAY = 86_400_000_000


def turn_ids(records: DataFrame, stream: str, order: list[str], opens: Column) -> DataFrame:
    """``records`` with ``turn``: a running count of the records that open a turn; 0 before the first."""
    return running_sum(records, [stream], order, F.when(opens, 1).otherwise(0), "turn")


def turns(records: DataFrame, stream: str, order: list[str], role: str, text: str, stamp: str) -> DataFrame:
    """Human question with the answers up to the next question: one row a turn, its latency never negative."""
    numbered = turn_ids(records, stream, order, F.col(role) == "human").filter("turn > 0")
    said = F.array_sort(F.collect_list(F.when((F.col(role) == "assistant") & (F.trim(text) != ""), F.struct(*order, F.col(text).alias("t")))))
    latency = F.greatest(F.unix_millis(F.min(F.when(F.col(role) == "assistant", instant(stamp)))) - F.unix_millis(F.max(F.when(F.col(role) == "human", instant(stamp)))), F.lit(0))
    return numbered.groupBy(stream, "turn").agg(F.max(F.when(F.col(role) == "human", F.col(text))).alias("human_text"), F.array_join(F.transform(said, lambda x: x["t"]), "\n").alias("agent_text"), latency.alias("latency_ms"))


def session_span(exchanges: DataFrame) -> DataFrame:
    """First question, last answer and whole minutes between them, for each session."""
    started, ended = F.min(instant("human_timestamp")), F.max(instant("agent_timestamp"))
    return exchanges.filter("session_id IS NOT NULL").groupBy("session_id").agg(started.alias("started"), ended.alias("ended"), F.greatest(F.floor((F.unix_micros(ended) - F.unix_micros(started)) / 60_000_000), F.lit(0)).alias("minutes"))


def usage_tally(exchanges: DataFrame, by: str) -> DataFrame:
    """Token and cost sums that are null where no row states them, never zero."""
    return exchanges.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "tokens_reasoning")], F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def nearest_within(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, left_id: str, right_id: str, seconds: int = 30) -> DataFrame:
    """As-of match: rows of equal ``on`` with 0 to ``seconds`` from left to right; the nearest right row wins if it is alone.

    Rows are bucketed by time, so a text that repeats without end is split over its buckets; each left
    row looks into its own bucket and the next. Ties for the nearest are no match.
    """
    size = seconds * 1_000_000
    a = left.select(*on, F.col(left_id).alias("left_id"), F.unix_micros(instant(left_at)).alias("a")).filter("a IS NOT NULL").withColumn("bucket", F.explode(F.array(F.floor(F.col("a") / size), F.floor(F.col("a") / size) + 1)))
    b = right.select(*on, F.col(right_id).alias("right_id"), F.unix_micros(instant(right_at)).alias("b")).filter("b IS NOT NULL").withColumn("bucket", F.floor(F.col("b") / size))
    near = a.join(b, [*on, "bucket"]).withColumn("gap", F.col("b") - F.col("a")).filter((F.col("gap") >= 0) & (F.col("gap") <= size))
    per = near.groupBy("left_id").agg(F.min("gap").alias("gap"), F.min_by("right_id", F.struct("gap", "right_id")).alias("right_id"))
    ties = near.join(per.select("left_id", F.col("gap").alias("least")), "left_id").filter("gap = least").groupBy("left_id").agg(F.count("*").alias("n"))
    return per.join(ties.filter("n = 1"), "left_id").select("left_id", "right_id", (F.col("gap") / 1_000_000).alias("gap_seconds"))


def within_spans(signals: DataFrame, spans: DataFrame, stream: str, at: str, opened: str, closed: str, bucket: int = DAY) -> DataFrame:
    """Signals with the span in which they fall: opened < at <= closed, within one stream.

    Times are numbers. Spans are cut at the borders of ``buckets`` of time, so a stream with a third of all rows is
    spread over its buckets; a signal lies in one bucket and meets only the spans that touch it.
    """
    cut = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(opened) / bucket), F.floor(F.col(closed) / bucket)))).filter(F.col(closed) >= F.col(opened)) if bucket else spans.withColumn("__b", F.lit(0))
    placed = signals.withColumn("__b", F.floor(F.col(at) / bucket) if bucket else F.lit(0))
    cond = (F.col(f"s.{stream}") == F.col(f"p.{stream}")) & (F.col("s.__b") == F.col("p.__b")) & (F.col(f"s.{at}") > F.col(f"p.{opened}")) & (F.col(f"s.{at}") <= F.col(f"p.{closed}"))
    return placed.alias("s").join(cut.alias("p"), cond)


def match_cascade(incoming: DataFrame, stored: DataFrame, key_in: str, key_stored: str, session: str, stages: list[tuple[str, list[str]]], loose: tuple[str, ...] = ("number",)) -> DataFrame:
    """``(in_id, stored_id, stage, outcome)``: each stage matches by its columns what earlier stages left.

    A stored row is claimed once. Several candidates on either side make a match ambiguous; an incoming row whose
    candidate by a stage was claimed by another row is ``claimed``, except by the ``loose`` stages, which tell a
    place and no identity; what no stage matches is ``unmatched``.
    """
    open_in, open_stored, out = incoming, stored, None
    for name, columns in stages:
        keys = [session, *columns]
        solid = [F.col(c).isNotNull() for c in columns]
        a, b = open_in, open_stored
        for s in solid:
            a, b = a.filter(s), b.filter(s)
        ga = a.groupBy(*keys).agg(F.min(key_in).alias("in_id"), F.count("*").alias("n_in"))
        gb = b.groupBy(*keys).agg(F.min(key_stored).alias("stored_id"), F.count("*").alias("n_stored"))
        hit = ga.join(gb, keys).withColumn("stage", F.lit(name))
        one = hit.filter("n_in = 1 AND n_stored = 1").select("in_id", "stored_id", "stage", F.lit("matched").alias("outcome"))
        many = hit.filter("n_in > 1 OR n_stored > 1").select(*keys)
        vague = a.join(many, keys, "left_semi").select(F.col(key_in).alias("in_id"), F.lit(None).cast(stored.schema[key_stored].dataType).alias("stored_id"), F.lit(name).alias("stage"), F.lit("ambiguous").alias("outcome"))
        found = checkpoint(one.unionByName(vague))  # each stage reads what the last one left: cut the lineage here
        out = found if out is None else out.unionByName(found)
        open_in = open_in.join(found.select(F.col("in_id").alias(key_in)), key_in, "left_anti")
        open_stored = open_stored.join(found.filter("outcome = 'matched'").select(F.col("stored_id").alias(key_stored)), key_stored, "left_anti")
    taken = None
    for name, columns in stages:
        if out is None or name in loose:
            continue
        keys = [session, *columns]
        claimed = stored.join(out.filter("outcome = 'matched'").select(F.col("stored_id").alias(key_stored)), key_stored, "left_semi").select(*keys).distinct()
        late = open_in.join(claimed, keys, "left_semi").select(F.col(key_in).alias("in_id"), F.lit(name).alias("stage"))
        taken = late if taken is None else taken.unionByName(late)
    if taken is not None:
        first = F.lit(len(stages))
        for i, (name, _) in reversed(list(enumerate(stages))):
            first = F.when(F.col("stage") == name, i).otherwise(first)
        taken = taken.groupBy("in_id").agg(F.min_by("stage", first).alias("stage"))
        late = checkpoint(taken.select("in_id", F.lit(None).cast(stored.schema[key_stored].dataType).alias("stored_id"), "stage", F.lit("claimed").alias("outcome")))
        out = out.unionByName(late)
        open_in = open_in.join(late.select(F.col("in_id").alias(key_in)), key_in, "left_anti")
    rest = open_in.select(F.col(key_in).alias("in_id"), F.lit(None).cast(stored.schema[key_stored].dataType).alias("stored_id"), F.lit(None).cast("string").alias("stage"), F.lit("unmatched").alias("outcome"))
    return rest if out is None else out.unionByName(rest)


def fresh_numbers(unmatched: DataFrame, stored: DataFrame, session: str, number: str, order: str) -> DataFrame:
    """Numbers for new rows: after the session's largest, in order."""
    top = stored.groupBy(session).agg(F.max(number).alias("top"))
    place = numbered(unmatched.drop(number), [session], [order], "__place")
    return place.join(top, session, "left").withColumn(number, F.coalesce("top", F.lit(0)) + F.col("__place")).drop("top", "__place")


EXCHANGE_FILLED = ("human_text", "agent_text", "human_timestamp", "agent_timestamp", "source_id", "response_latency_ms", "is_after_compaction")
EXCHANGE_PROVENANCE = ("model", "provider", "tokens_in", "tokens_out", "tokens_reasoning")
#: How a delivered exchange finds its stored one, the surest way first.
EXCHANGE_STAGES = (("source_id", ["source_id"]), ("timestamps", ["human_timestamp", "agent_timestamp"]), ("content", ["__content"]), ("prompt", ["__prompt"]), ("number", ["exchange_number"]))


def merge_exchanges(stored: DataFrame, incoming: DataFrame, authoritative: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored exchanges after a delivery, and what became of each delivered one: ``(session_id, in_number, number, outcome)``.

    ``matched`` fills the gaps of the stored row and may lead its provenance; ``conflict`` met another question
    under its number; ``ambiguous`` and ``claimed`` ones change nothing. ``unmatched`` and ``conflict`` rows are
    inserted with a fresh number if theirs is taken. ``authoritative(session_id)`` names sessions whose numbers are
    the source's own: there a conflict replaces the stored row. Null values never overwrite, so a second
    delivery with fewer fields takes nothing away, and the same delivery again changes nothing.
    """
    said = lambda c: F.when(F.trim(c) != "", F.col(c))
    keyed = lambda df: df.withColumn("__key", F.concat_ws("\0", "session_id", F.col("exchange_number").cast("string"))).withColumn("__content", F.when(said("human_text").isNotNull() & said("agent_text").isNotNull(), typed_digest(["human_text", "agent_text"]))).withColumn("__prompt", F.when(said("human_text").isNotNull(), typed_digest(["human_text"])))
    new, old = checkpoint(keyed(incoming)), keyed(stored)
    found = match_cascade(new, old, "__key", "__key", "session_id", list(EXCHANGE_STAGES))
    both = found.join(new.select(F.col("__key").alias("in_id"), "session_id", F.col("exchange_number").alias("in_number"), F.col("human_text").alias("nh")), "in_id").join(old.select(F.col("__key").alias("stored_id"), F.col("exchange_number").alias("number"), F.col("human_text").alias("oh")), "stored_id", "left")
    differs = (F.col("stage") == "number") & F.coalesce(F.col("nh") != F.col("oh"), F.lit(False)) & (F.trim("nh") != "") & (F.trim("oh") != "")
    both = checkpoint(both.withColumn("outcome", F.when((F.col("outcome") == "matched") & differs, "conflict").otherwise(F.col("outcome"))))
    replaced = both.filter("outcome = 'conflict'").join(authoritative, "session_id", "left_semi") if authoritative is not None else both.limit(0)
    fresh = both.filter("outcome IN ('unmatched', 'conflict')")
    if authoritative is not None:
        fresh = fresh.join(replaced.select("in_id"), "in_id", "left_anti")
    enriched = enrich(
        old.join(both.filter("outcome = 'matched'").select(F.col("stored_id").alias("__key")), "__key", "left_semi"), new.join(both.filter("outcome = 'matched'").select(F.col("in_id").alias("__key"), "stored_id"), "__key").drop("__key").withColumnRenamed("stored_id", "__key"),
        "__key", list(EXCHANGE_FILLED), list(EXCHANGE_PROVENANCE),
    )
    columns = [c for c in stored.columns if c not in (*EXCHANGE_FILLED, *EXCHANGE_PROVENANCE)]
    enriched = old.select("__key", *columns).join(enriched, "__key").select(*stored.columns)
    held = old.join(both.filter("outcome = 'matched'").select(F.col("stored_id").alias("__key")).unionByName(replaced.select(F.col("stored_id").alias("__key"))), "__key", "left_anti").select(*stored.columns)
    rows = new.join(fresh.select(F.col("in_id").alias("__key")), "__key", "left_semi")
    free = rows.join(old.select("session_id", "exchange_number"), ["session_id", "exchange_number"], "left_anti")
    taken = rows.join(free.select("__key"), "__key", "left_anti")
    tops = old.select("session_id", "exchange_number").unionByName(new.select("session_id", "exchange_number"))
    moved = checkpoint(fresh_numbers(taken.withColumn("in_number", F.col("exchange_number")), tops, "session_id", "exchange_number", "in_number").withColumn("exchange_number", F.col("exchange_number").cast("int")))
    in_place = new.join(replaced.select(F.col("in_id").alias("__key")), "__key", "left_semi")
    merged = held.unionByName(enriched).unionByName(free.select(*stored.columns)).unionByName(moved.select(*stored.columns)).unionByName(in_place.select(*stored.columns))
    placed = moved.select("session_id", "in_number", F.col("exchange_number").alias("given"))
    outcomes = both.join(placed, ["session_id", "in_number"], "left").select("session_id", "in_number", F.coalesce("given", F.when(F.col("outcome").isin("unmatched", "conflict"), F.col("in_number")).otherwise(F.col("number"))).alias("number"), "outcome")
    return merged, outcomes


def merge_memories(stored: DataFrame, incoming: DataFrame, keys: list[str], observed: DataFrame | None = None) -> DataFrame:
    """Stored notes after a delivery, by what ``memory_actions`` says of each.

    An update takes the delivered row, a stamp its time, a project its project; ``observed`` names the files (first
    key) that were read whole: notes of theirs that are gone become ``resolved`` and are marked superseded.
    """
    actions = memory_actions(stored, incoming, keys)
    gone = F.col("action") == "resolve"
    held = stored.join(actions, keys, "left")
    if observed is not None:
        held = held.join(observed.select(keys[0]).distinct().withColumn("__read", F.lit(True)), keys[0], "left")
        gone = gone & F.coalesce("__read", F.lit(False))
    else:
        gone = F.lit(False)
    new = incoming.select(*keys, *[F.col(c).alias(f"__{c}") for c in incoming.columns if c not in keys])
    both = held.join(new, keys, "left")
    out = []
    for c in stored.columns:
        value = F.col(c)
        if c not in keys and c in incoming.columns:
            value = F.when(F.col("action") == "update", F.coalesce(f"__{c}", c))
            value = value.when(F.col("action") == "stamp", F.col("__updated_at")) if c == "updated_at" else value
            value = value.when(F.col("action") == "project", F.col("__project")) if c == "project" else value
            value = value.otherwise(F.col(c))
        if c == "status":
            value = F.when(gone, "resolved").otherwise(value)
        if c == "metadata":
            value = F.when(gone & ~F.coalesce(F.col(c).contains('"superseded"'), F.lit(False)), F.when(F.trim(c).rlike(r"^\{\s*\}$") | F.col(c).isNull(), '{"superseded": true}').otherwise(F.regexp_replace(c, r"\}\s*$", ', "superseded": true}'))).otherwise(value)
        out.append(value.alias(c))
    inserted = incoming.join(actions.filter("action = 'insert'"), keys, "left_semi")
    return both.select(*out).unionByName(inserted, allowMissingColumns=True).select(stored.columns)


def enrich(old: DataFrame, new: DataFrame, key: str, columns: list[str], provenance: list[str]) -> DataFrame:
    """Stored rows completed by incoming ones. Gaps are filled; of provenance the side that states more fields leads.

    A side that states nothing never leads.
    """
    stated = lambda side: sum((F.when(F.col(f"{side}.{c}").isNotNull(), 1).otherwise(0) for c in provenance), F.lit(0))
    richer = stated("n") > stated("o")
    both = old.alias("o").join(new.alias("n"), key)
    filled = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in columns]
    led = [F.when(richer, F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).otherwise(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))).alias(c) for c in provenance]
    return both.select(key, *filled, *led)


def refresh_sessions(old: DataFrame, new: DataFrame, snapshot: str = "snapshot", updated: str = "updated_at") -> DataFrame:
    """Sessions after a refresh. A snapshot's values win unless it is older than the stored one; else gaps are filled.

    The agent changes only within its family, the first title that is not blank stays.
    """
    both = old.alias("o").join(new.alias("n"), "session_id", "full_outer")
    stale = F.coalesce(instant(F.col(f"n.{updated}")) < instant(F.col(f"o.{updated}")), F.lit(False))
    wins = F.coalesce(F.col(f"n.{snapshot}"), F.lit(False)) & ~stale
    value = lambda c: F.when(wins, F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.coalesce(f"o.{c}", f"n.{c}")).alias(c)
    family = lambda c: F.substring_index(c, "-", 1)
    agent = F.when(wins & F.col("n.source_agent").isNotNull(), F.col("n.source_agent")).when(family(F.col("o.source_agent")) == family(F.col("n.source_agent")), F.col("n.source_agent")).otherwise(F.coalesce("o.source_agent", "n.source_agent"))
    title = F.coalesce(F.when(F.trim("o.title") != "", F.col("o.title")), F.when(F.trim("n.title") != "", F.col("n.title")))
    return both.select("session_id", agent.alias("source_agent"), *[value(c) for c in ("project", "started_at", "ended_at", "duration_minutes", "source_surface")], title.alias("title"))


def merge_metadata(target: str = "old", patch: str = "new") -> Column:
    """Merge-patch of two JSON texts, Arrow-batched; an unreadable side gives the other."""
    import json

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def load(text: str | None) -> object:
            try:
                return json.loads(text) if text else None
            except ValueError:
                return None

        out = []
        for x, y in zip(a, b):
            left, right = load(x), load(y)
            out.append(x if right is None else y if left is None else json.dumps(merge_patch(left, right), sort_keys=True))
        return pd.Series(out, dtype=object)

    return run(F.col(target), F.col(patch))


def memory_actions(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """What each incoming note does: insert, unchanged, project, stamp, update or stale; vanished notes resolve.

    Equal content with a new project attributes it, with a newer time only stamps it; older content is stale.
    """
    a = stored.select(*keys, F.col("content").alias("oc"), F.col("project").alias("op"), F.col("updated_at").alias("ou"), F.lit(True).alias("held"))
    b = incoming.select(*keys, F.col("content").alias("nc"), F.col("project").alias("np"), F.col("updated_at").alias("nu"), F.lit(True).alias("seen"))
    same = F.col("oc").eqNullSafe(F.col("nc"))
    newer = F.coalesce(instant("nu") > instant("ou"), F.col("ou").isNull())
    action = (
        F.when(F.col("held").isNull(), "insert").when(F.col("seen").isNull(), "resolve")
        .when(same & F.col("op").isNull() & F.col("np").isNotNull(), "project").when(same & newer & F.col("nu").isNotNull(), "stamp").when(same, "unchanged").when(newer, "update").otherwise("stale")
    )
    return a.join(b, keys, "full_outer").select(*keys, action.alias("action"))


def missing_rows(stored: DataFrame, incoming: DataFrame, same: list[str]) -> DataFrame:
    """Incoming rows without an equal stored row, null-safe over all columns; a row repeated without end stays spread."""
    new = incoming.withColumn("__d", typed_digest(same))
    times = new.groupBy("__d").agg(F.count("*").alias("__n"))
    held = stored.select(typed_digest(same).alias("__d")).distinct().withColumn("__held", F.lit(True)).join(times, "__d")
    return join_unique(new, held, "__d", "__n", incoming.count(), "left").filter("__held IS NULL").select(incoming.columns)


def keep_mapped(stored: DataFrame, mapped: DataFrame, session: str, key: str) -> DataFrame:
    """Stored rows after an authoritative snapshot: its sessions keep only mapped rows, others keep all."""
    covered = mapped.select(session).distinct()
    inside = stored.join(covered, session, "left_semi").join(mapped.select(session, key).distinct(), [session, key], "left_semi")
    return inside.unionByName(stored.join(covered, session, "left_anti"))


def surviving_parents(nodes: DataFrame, scope: str, node: str, parent: str, survives: str) -> DataFrame:
    """Survivors with their nearest surviving ancestor; nodes in circles are left out."""
    from threadloom.operators.hierarchy import hierarchy

    tree = hierarchy(nodes, node, parent, scope=scope, mark=survives)
    kept = nodes.filter(F.col(survives)).select(F.col(scope).alias("scope"), F.col(node).cast("string").alias("node"))
    return kept.join(tree.filter("NOT in_cycle"), ["scope", "node"]).select("scope", "node", F.col("marked").alias("parent"))


def file_outcomes(files: DataFrame, state: DataFrame) -> DataFrame:
    """One of excluded, error, skipped, pending or parsed for each file, by fingerprint against the stored state."""
    both = files.join(state.select("path", F.col("fingerprint").alias("known"), "last_error"), "path", "left")
    outcome = F.when(F.col("excluded"), "excluded").when(F.col("unreadable"), F.when(F.col("fingerprint").eqNullSafe(F.col("known")), "skipped").otherwise("error")).when(F.col("growing"), "pending").when(F.col("fingerprint").eqNullSafe(F.col("known")) & F.col("last_error").isNull(), "skipped").otherwise("parsed")
    return both.select("path", outcome.alias("outcome"))


def coverage(source: DataFrame, landed: DataFrame, key: str, by: str) -> DataFrame:
    """What a source holds against what landed, for each group, both ways."""
    a = source.select(by, key).distinct().withColumn("in_source", F.lit(1))
    b = landed.select(by, key).distinct().withColumn("in_archive", F.lit(1))
    return a.join(b, [by, key], "full_outer").groupBy(by).agg(F.count("in_source").alias("source"), F.count("in_archive").alias("landed"), F.count(F.when(F.col("in_archive").isNull(), 1)).alias("missing"), F.count(F.when(F.col("in_source").isNull(), 1)).alias("extra"))


def table_deltas(before: dict[str, int], after: dict[str, int]) -> list[dict]:
    """Rows before and after a run, table by table; a second run over the same files changes nothing."""
    return [{"table": t, "before": before.get(t, 0), "after": after.get(t, 0), "delta": after.get(t, 0) - before.get(t, 0)} for t in sorted(before.keys() | after.keys())]
