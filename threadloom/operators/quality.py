"""Exact deduplication with remaps, health of the archive, layers, retention, versions and custody."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import framed_digest, instant, time_format
from threadloom.operators.skew import join_unique, numbered


class DriftError(RuntimeError):
    """The data changed between inspection and change."""


def typed_digest(columns: list[str]) -> Column:
    """SHA-256 over values that keeps null, empty text and numbers apart."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return framed_digest(*parts)


# -- exact duplicates ---------------------------------------------------------------------------------


def duplicate_groups(df: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """``(digest, canonical, copies)`` of payloads that occur more than once; nulls equal nulls.

    Only digests are shuffled, and they combine before the shuffle, so a payload of any count is no burden.
    """
    return df.select(F.col(key), typed_digest(payload).alias("digest")).groupBy("digest").agg(F.min(key).alias("canonical"), F.count("*").alias("copies")).filter("copies > 1")


def remap(df: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """``(old_id, canonical_id)`` of every row that an equal row with a smaller id replaces."""
    rows = df.select(F.col(key).alias("old_id"), typed_digest(payload).alias("digest"))
    groups = duplicate_groups(df, key, payload).withColumnRenamed("canonical", "canonical_id")
    return join_unique(rows, groups, "digest", "copies", df.count()).filter("old_id <> canonical_id").select("old_id", "canonical_id")


def ambiguous_identities(df: DataFrame, identity: list[str], payload: list[str]) -> DataFrame:
    """Identities under which different payloads are stored, with their number."""
    return df.withColumn("digest", typed_digest(payload)).groupBy(*identity).agg(F.countDistinct("digest").alias("payloads"), F.count("*").alias("n")).filter("payloads > 1")


def manifest(mapping: DataFrame) -> tuple[int, str]:
    """Number of remaps and one digest over them in any order: what an inspection hands to the change."""
    n, total = mapping.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("old_id", "canonical_id").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return n, f"{n}:{total}"


def apply_remap(df: DataFrame, key: str, payload: list[str], inspected: str, references: dict[str, tuple[DataFrame, str]] | None = None) -> dict[str, DataFrame]:
    """Rows without duplicates and tables whose references follow; refused if the data no longer fit the inspection."""
    mapping = remap(df, key, payload)
    if manifest(mapping)[1] != inspected:
        raise DriftError("the rows changed since they were inspected")
    out = {"rows": df.join(mapping.select(F.col("old_id").alias(key)), key, "left_anti")}
    for name, (frame, column) in (references or {}).items():
        out[name] = follow(frame, column, mapping)
    return out


def follow(frame: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``frame`` with references to replaced rows pointed at their canonical row."""
    moved = mapping.select(F.col("old_id").alias(column), "canonical_id")
    times = frame.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__times"))
    total = frame.count()
    return join_unique(frame, moved.join(times, column), column, "__times", total, "left").withColumn(column, F.coalesce("canonical_id", column)).drop("canonical_id").select(frame.columns)


def remap_chains(mapping: DataFrame) -> DataFrame:
    """Remaps that lead to a row which is itself remapped; a sound mapping has none."""
    return mapping.alias("a").join(mapping.alias("b"), F.col("a.canonical_id") == F.col("b.old_id")).select(F.col("a.old_id"), F.col("a.canonical_id"), F.col("b.canonical_id").alias("next_id"))


def winner_guards(df: DataFrame, key: str, payload: list[str], stamp: str, metadata: str) -> DataFrame:
    """Groups that must not be collapsed blindly: the smallest id is not the earliest row, or its metadata is no JSON."""
    rows = df.withColumn("digest", typed_digest(payload))
    first = F.min_by(key, F.struct(F.coalesce(F.col(stamp), F.lit("")), F.col(key)))
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(key).alias("winner"), first.alias("earliest"), F.min_by(metadata, key).alias("meta"))
    bad_json = F.col("meta").isNotNull() & F.try_parse_json("meta").isNull()
    return groups.filter("n > 1").filter((F.col("winner") != F.col("earliest")) | bad_json).select("winner", "earliest", bad_json.alias("bad_metadata"))


def resolve_ids(wanted: DataFrame, key: str, mappings: list[DataFrame]) -> DataFrame:
    """``wanted`` with ``canonical_id`` looked up in the mappings in order; an unmapped id stays itself."""
    out = wanted
    found = []
    times, total = wanted.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__times")), wanted.count()
    for i, mapping in enumerate(mappings):
        name = f"__c{i}"
        found.append(name)
        out = join_unique(out, mapping.select(F.col("old_id").alias(key), F.col("canonical_id").alias(name)).join(times, key), key, "__times", total, "left")
    return out.withColumn("canonical_id", F.coalesce(*found, F.col(key))).drop(*found)


# -- health -------------------------------------------------------------------------------------------


def orphan_replacements(memories: DataFrame) -> DataFrame:
    """Memories that replace one that does not exist."""
    return memories.filter("supersedes IS NOT NULL").join(memories.select(F.col("id").alias("supersedes")), "supersedes", "left_anti").select("id", "supersedes")


def unregistered_layers(memories: DataFrame, layers: DataFrame) -> DataFrame:
    return memories.join(F.broadcast(layers.select(F.col("name").alias("layer"))), "layer", "left_anti").groupBy("layer").agg(F.count("*").alias("n"))  # the registry is a dozen rows


def alias_rows(memories: DataFrame, layers: DataFrame) -> DataFrame:
    aliases = layers.filter("alias_of IS NOT NULL").select(F.col("name").alias("layer"), "alias_of")
    return memories.join(F.broadcast(aliases), "layer").groupBy("layer", "alias_of").agg(F.count("*").alias("n"))


def ghost_sessions(sessions: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Stored sessions without start and end that rows belong to."""
    silent = sessions.filter("started_at IS NULL AND ended_at IS NULL").select("session_id")
    ids = reduce(DataFrame.unionByName, [u.select("session_id").filter("session_id IS NOT NULL").distinct() for u in used]).distinct()
    return silent.join(ids, "session_id", "left_semi")


def sessions_without_row(sessions: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Session ids that rows carry but no session has."""
    ids = reduce(DataFrame.unionByName, [u.select("session_id").filter("session_id IS NOT NULL").distinct() for u in used]).distinct()
    return ids.join(sessions.select("session_id"), "session_id", "left_anti")


# What marks a test's memory, and the agents of tests.
TEST_MARKS, TEST_AGENTS = ("1", "true", "True"), ("test-agent", "test")


def marked_tests(memories: DataFrame) -> DataFrame:
    """Memories whose metadata say that they are tests."""
    return memories.filter(F.get_json_object("metadata", "$._test").isin(*TEST_MARKS)).select("id")


# The spellings of a note's time that a health check tells apart.
ISO_OFFSET, SQLITE_BARE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def created_at_formats(memories: DataFrame) -> DataFrame:
    at = F.col("created_at")
    spelling = F.when(at.rlike(ISO_OFFSET), "iso_offset").when(at.rlike(SQLITE_BARE), "sqlite_bare").otherwise("date_only_or_other")
    return memories.filter(at.isNotNull()).groupBy(spelling.alias("format")).agg(F.count("*").alias("n"))


def time_spellings(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(time_format(column).alias("format")).agg(F.count("*").alias("n"))


def health(memories: DataFrame, sessions: DataFrame, layers: DataFrame, exchanges: DataFrame, tools: DataFrame) -> DataFrame:
    """One row for each check: its count and verdict (pass, warn or fail)."""
    formats = created_at_formats(memories)
    mixed = (F.count("*") > 1) | (F.coalesce(F.sum(F.when(F.col("format") == "date_only_or_other", F.col("n"))), F.lit(0)) > 0)
    total = lambda df: df.agg(F.count("*").alias("n"))
    counts = [
        ("orphan_supersedes", "fail", total(orphan_replacements(memories))),
        ("test_metadata_rows", "fail", total(marked_tests(memories))),
        ("test_source_agent_rows", "fail", total(memories.filter(F.col("source_agent").isin(*TEST_AGENTS)))),
        ("runtime_layers_not_in_registry", "fail", total(unregistered_layers(memories, layers))),
        ("physical_alias_layer_rows", "fail", alias_rows(memories, layers).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))),
        ("ghost_sessions", "warn", total(ghost_sessions(sessions, [exchanges, tools]))),
    ]
    parts = [n.select(F.lit(name).alias("check"), F.col("n").cast("bigint").alias("n"), F.when(F.col("n") == 0, "pass").otherwise(bad).alias("verdict")) for name, bad, n in counts]
    parts.append(formats.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), F.when(mixed, "warn").otherwise("pass").alias("verdict")).select(F.lit("memory_created_at_formats").alias("check"), "n", "verdict"))
    return reduce(DataFrame.unionByName, parts)


def worst(verdicts: DataFrame) -> DataFrame:
    """The verdict of the whole: the worst of the checks."""
    order = F.max(F.when(F.col("verdict") == "fail", 2).when(F.col("verdict") == "warn", 1).otherwise(0))
    return verdicts.agg(order.alias("o")).select(F.when(F.col("o") == 2, "fail").when(F.col("o") == 1, "warn").otherwise("pass").alias("verdict"))


# -- layers, storage, retention -----------------------------------------------------------------------


def resolve_layers(layers: DataFrame, most: int = 8) -> DataFrame:
    """``(name, resolved)``: the layer at the end of a chain of aliases of at most ``most`` steps; circles resolve to null."""
    out = layers.select("name", F.col("name").alias("resolved"), F.col("alias_of").alias("next"))
    step = layers.select(F.col("name").alias("next"), F.col("alias_of").alias("after"))
    for _ in range(most):
        out = out.join(F.broadcast(step), "next", "left").select("name", F.coalesce("next", "resolved").alias("resolved"), F.col("after").alias("next"))
    return out.select("name", F.when(F.col("next").isNull(), F.col("resolved")).alias("resolved"))


def migrate_layers(memories: DataFrame, layers: DataFrame) -> DataFrame:
    """Memories with alias layers replaced by what they stand for; other layers stay."""
    chain = resolve_layers(layers).select(F.col("name").alias("layer"), "resolved")
    return memories.join(F.broadcast(chain), "layer", "left").withColumn("layer", F.coalesce("resolved", "layer")).drop("resolved").select(memories.columns)


def add_layer(layers: DataFrame, name: str, description: str, alias_of: str | None = None) -> DataFrame:
    """The registry with one more layer; an existing name is kept as it is."""
    row = layers.sparkSession.createDataFrame([(name, description, alias_of)], "name string, description string, alias_of string")
    return layers.unionByName(row.join(layers.select("name"), "name", "left_anti"), allowMissingColumns=True)


def store_rows(stored: DataFrame, incoming: DataFrame, same: list[str]) -> DataFrame:
    """Incoming rows that are not stored yet; equality is null-safe, and repeats within the batch are taken once."""
    new = incoming.withColumn("__d", typed_digest(same))
    first = new.groupBy("__d").agg(F.min_by(F.struct(*incoming.columns), F.struct(*same)).alias("__r")).select("__d", "__r.*")
    return first.join(stored.select(typed_digest(same).alias("__d")), "__d", "left_anti").drop("__d")


def unexpired(df: DataFrame, expires: str, cutoff: str) -> DataFrame:
    """Rows that do not expire by the cutoff; unreadable and missing expiry times never do."""
    return df.filter(~F.coalesce(instant(expires) <= F.to_timestamp(F.lit(cutoff)), F.lit(False)))


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest ``order``, nulls smallest; a combinable aggregate, so a key of any size is no burden."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*").select(df.columns)


# -- versions and custody -----------------------------------------------------------------------------


def versions(sources: dict[str, DataFrame], payload: list[str]) -> DataFrame:
    """``(digest, sources, n)``: content-addressed versions over several sources."""
    parts = [f.select(typed_digest(payload).alias("digest"), F.lit(name).alias("source")) for name, f in sources.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("n"))


def occurrence_ordinals(df: DataFrame, key: str, group: list[str], payload: list[str]) -> DataFrame:
    """Which occurrence of its payload within the group a row is, from 0."""
    rows = df.withColumn("digest", typed_digest(payload))
    return numbered(rows.select(key, *group, "digest"), [*group, "digest"], [key], "place").select(key, *group, (F.col("place") - 1).alias("ordinal"))


def custody_expectation(sources: dict[str, DataFrame], payload: list[str]) -> DataFrame:
    """Physical rows that a union of the sources must have: over digests, the most that one source holds."""
    parts = [f.select(typed_digest(payload).alias("digest")).groupBy("digest").agg(F.count("*").alias("n")) for f in sources.values()]
    return reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("expected"), F.count("*").alias("distinct_rows"))


def custody_union(sources: dict[str, DataFrame], payload: list[str]) -> DataFrame:
    """The multiset union: a row represents at most one row of each source, repeats within a source stay."""
    parts = []
    for name, frame in sources.items():
        rows = frame.select(*payload).withColumn("digest", typed_digest(payload))
        parts.append(numbered(rows, ["digest"], [], "ordinal"))
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["digest", "ordinal"]).select(*payload)


def drift(stored: DataFrame, now: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """``(key, action)`` of a source against its stored versions: new, changed, same or deleted."""
    a = stored.select(key, typed_digest(payload).alias("have"))
    b = now.select(key, typed_digest(payload).alias("got"))
    action = F.when(F.col("have").isNull(), "new").when(F.col("got").isNull(), "deleted").when(F.col("have") == F.col("got"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def reconcile(source: DataFrame, archive: DataFrame, group: str, key: str) -> DataFrame:
    """Coverage of each group: rows of the source, rows of the archive, missing ones and percent."""
    both = source.select(group, key).distinct().join(archive.select(group, key, F.lit(1).alias("held")).distinct(), [group, key], "left")
    out = both.groupBy(group).agg(F.count("*").alias("source_rows"), F.count("held").alias("archived"))
    return out.withColumn("missing", F.col("source_rows") - F.col("archived")).withColumn("percent", F.round(100.0 * F.col("archived") / F.col("source_rows"), 2))


def inventory(df: DataFrame, group: str, payload: list[str]) -> DataFrame:
    """Rows, distinct rows and an order-free digest of each group, from combinable aggregates."""
    rows = df.select(group, typed_digest(payload).alias("digest"))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct("digest").alias("distinct_rows"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("inventory"))


def shadow_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with repeats, that only one of two results holds."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def adoption(found: DataFrame, wanted: DataFrame) -> tuple[str, list[str]]:
    """How a table stands to its schema: current, migratable, incompatible or foreign, with what differs."""
    have, want = dict(found.dtypes), dict(wanted.dtypes)
    missing, other = [c for c in want if c not in have], [c for c in want if c in have and have[c] != want[c]]
    notes = [f"missing {c}" for c in missing] + [f"{c} is {have[c]}, not {want[c]}" for c in other]
    if not set(have) & set(want):
        return "foreign", notes
    if other:
        return "incompatible", notes
    return ("migratable" if missing else "current"), notes
