"""Message rows folded like an event log into final turns, ordered and validated conversation by conversation.

Every delivery of a message is an event: the first creates it, a later one with the same uuid replaces it
(with a blank text it deletes it), another message of the same speaker under the same visible ancestor is
an edited question or a retried answer. One fold by version keeps the last delivery of a uuid; the trees
of a conversation are then traversed once, and order, alternatives and the reason to leave the whole
conversation out come from that traversal.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.blank import is_blank
from threadloom.operators.hierarchy import COMPONENT_LIMIT, Finish, hierarchy
from threadloom.operators.skew import join_unique, numbered
from threadloom.session import checkpoint

# Spellings of the two speakers.
HUMAN, ASSISTANT = ("human", "user"), ("assistant", "ai")
# A uuid without any digit but zeros, apart from those of its version and variant: exports put it where there is no parent.
NO_PARENT = r"^[0-]*$|^0{8}-?0{4}-?[0-8]0{3}-?[089abAB]0{3}-?0{12}$"


def trimmed(column: str) -> Column:
    return F.trim(column, F.lit(" \t\r\n\xa0"))


def role(sender: Column) -> Column:
    """human, assistant, other, or null where the sender is missing or blank."""
    name = F.lower(F.trim(F.regexp_replace(sender, r"[\s\p{Z}]+", " ")))
    return F.when(name.isin(*HUMAN), "human").when(name.isin(*ASSISTANT), "assistant").when(name != "", "other")


def message_events(events: DataFrame) -> DataFrame:
    """One narrow row for each delivery: keys, role, whether it can be seen, and its ``version``.

    Versions are ordered by ingested_at, then created_at; within one instant a digest of the whole content
    decides, so repeated rows and ties fold to one defined row, the same wherever they are folded.
    """
    conversation, uuid, parent = (trimmed(c) for c in ("conversation_uuid", "uuid", "parent_message_uuid"))
    rows = events.select(
        conversation.alias("conv_key"), uuid.alias("uuid"), F.when(~parent.rlike(NO_PARENT), parent).alias("parent"), role(F.col("sender")).alias("role"), (~is_blank("text")).alias("spoken"),
        "created_at", F.struct("ingested_at", "created_at", F.xxhash64("text", "sender", "parent_message_uuid").alias("digest")).alias("version"), "text",
    ).filter("conv_key IS NOT NULL AND uuid IS NOT NULL")
    visible = F.col("spoken") & F.coalesce(F.col("role").isin("human", "assistant"), F.lit(False))
    return rows.withColumn("visible", visible).withColumn("replies", visible & (F.col("role") == "assistant")).withColumn("names_parent", F.col("parent").isNotNull())


_MORE = "reason string, versions bigint, final boolean, current boolean, turn_no bigint"


def _finish_bucket(nodes: pd.DataFrame) -> pd.DataFrame:
    """``_MORE`` for whole conversations in one task."""
    out = nodes.copy()
    role, visible = out["role"], out["visible"].astype(bool)
    faults = pd.DataFrame({
        "scope": out["scope"], "seen": visible, "broken": role.isna() | out["in_cycle"] | (out["names_parent"] & ~out["has_parent"]),
        "open": visible & (role == "human") & ~out["answered"],
    })
    state = faults.groupby("scope", sort=False)[["seen", "broken", "open"]].transform("max")
    out["reason"] = None
    for fault, reason in ((state["open"], "no_reply"), (state["broken"], "broken"), (~state["seen"], "empty")):
        out.loc[fault.astype(bool), "reason"] = reason
    out["versions"], out["final"], out["current"], out["turn_no"] = 0, False, False, 0
    shown = out[visible].sort_values(["created_at", "node"], na_position="first")
    beside = shown.groupby(["scope", "role", "marked"], dropna=False, sort=False)["node"]
    out.loc[shown.index, "versions"] = beside.transform("size")
    out.loc[shown.index, "final"] = beside.transform("last") == shown["node"]
    current: dict = {}
    walked = out.loc[shown.index].sort_values("visit")
    out.loc[walked.index, "turn_no"] = walked.groupby("scope", sort=False).cumcount() + 1
    for i, scope, node, marked, final in walked[["scope", "node", "marked", "final"]].itertuples():
        current[scope, node] = (i, bool(final and (marked is None or current.get((scope, marked), (0, False))[1])))
    found = list(current.values())
    out.loc[[i for i, _ in found], "current"] = [c for _, c in found]
    return out


def _finish_frame(nodes: DataFrame) -> DataFrame:
    """``_MORE`` for conversations beyond one task: aggregates that combine before the shuffle, joined back without bringing a conversation together."""
    nodes = checkpoint(nodes)
    total = nodes.count()
    fault = F.col("role").isNull() | F.col("in_cycle") | (F.col("names_parent") & ~F.col("has_parent"))
    unanswered = F.col("visible") & (F.coalesce(F.col("role"), F.lit("")) == "human") & ~F.col("answered")
    state = nodes.groupBy("scope").agg(F.max("visible").alias("seen"), F.max(fault).alias("broken"), F.max(unanswered).alias("open"), F.count("*").alias("n"))
    state = state.select("scope", "n", F.when(~F.col("seen"), "empty").when(F.col("broken"), "broken").when(F.col("open"), "no_reply").alias("reason"))
    group = F.struct("scope", "role", F.coalesce("marked", F.lit("")).alias("marked"), F.col("marked").isNull().alias("first"))
    beside = nodes.filter("visible").groupBy(group.alias("of")).agg(F.count("*").alias("versions"), F.max(F.struct("created_at", "node"))["node"].alias("latest"))
    shown = join_unique(nodes.filter("visible").withColumn("of", group), beside.withColumn("n", F.col("versions")), "of", "n", total).withColumn("final", F.col("node") == F.col("latest")).drop("of", "latest")
    shown = checkpoint(shown)
    above = hierarchy(shown.select("scope", "node", "marked", (~F.col("final")).alias("replaced")), "node", "marked", scope="scope", mark="replaced")
    shown = shown.join(above.select("scope", "node", F.col("marked").isNull().alias("kept")), ["scope", "node"]).withColumn("current", F.col("final") & F.col("kept")).drop("kept")
    shown = numbered(shown, ["scope"], ["visit"], "turn_no")
    hidden = nodes.filter("NOT visible").withColumn("versions", F.lit(0).cast("bigint")).withColumn("final", F.lit(False)).withColumn("current", F.lit(False)).withColumn("turn_no", F.lit(0).cast("bigint"))
    whole = shown.unionByName(hidden)
    return join_unique(whole, state, "scope", "n", total).select(*nodes.columns, "reason", "versions", "final", "current", "turn_no")


def message_trees(events: DataFrame, limit: int = COMPONENT_LIMIT) -> DataFrame:
    """Folded messages of ``message_events`` with tree, reason and alternatives, from one traversal."""
    finish = Finish(_MORE, _finish_bucket, _finish_frame)
    carry = ["role", "visible", "names_parent", "created_at"]
    return hierarchy(
        events.drop("text"), "uuid", "parent", scope="conv_key", mark="visible", reply="replies", carry=carry, latest=F.col("version"), finish=finish, component_limit=limit
    ).withColumnsRenamed({"scope": "conv_key", "node": "uuid", "marked": "asked_by"})


def _left_out(trees: DataFrame, conversations: DataFrame) -> DataFrame:
    state = trees.groupBy("conv_key").agg(F.max(F.coalesce("reason", F.lit(""))).alias("reason"))
    known = conversations.select(trimmed("uuid").alias("conv_key"), F.lit(None).cast("string").alias("reason")).filter("conv_key IS NOT NULL")
    state = state.unionByName(known).groupBy("conv_key").agg(F.max("reason").alias("reason"))
    return state.select("conv_key", F.coalesce("reason", F.lit("empty")).alias("reason")).filter("reason <> ''")


def broken_chats(events: DataFrame, conversations: DataFrame, limit: int = COMPONENT_LIMIT) -> DataFrame:
    """``(conv_key, reason)``: empty, broken or no_reply, the first that applies; sound conversations have no row.

    A message without uuid or conversation is dropped; a conversation of ``conversations`` without messages
    is empty; of empty tables there are no rows.
    """
    return _left_out(message_trees(message_events(events), limit=limit), conversations)


def broken_sessions(exchanges: DataFrame, sessions: DataFrame) -> DataFrame:
    """``(conv_key, reason)`` of numbered turns, deliveries of a number folded first.

    Only aggregates that combine before the shuffle are used, first by session and number, so a session
    with a third of all rows is no burden. Rows without a session belong to none.
    """
    turns = exchanges.filter("session_id IS NOT NULL").select(
        "session_id", "exchange_number", F.xxhash64("human_text", "agent_text").alias("h1"), F.hash("agent_text", "human_text", F.lit(7)).alias("h2"),
        is_blank("agent_text").alias("unanswered"), is_blank("human_text").alias("unasked"),
    )
    numbered = turns.groupBy("session_id", "exchange_number").agg(
        ((F.max("h1") != F.min("h1")) | (F.max("h2") != F.min("h2"))).alias("differs"), F.min("unanswered").alias("unanswered"), F.max(~(F.col("unanswered") & F.col("unasked"))).alias("said"),
    )
    # number and flag in one integer: the largest is that of the last number
    last = F.max(F.col("exchange_number").cast("bigint") * 2 + F.col("unanswered").cast("int"))
    state = numbered.groupBy("session_id").agg(
        F.max("said").alias("said"),
        (F.max(F.col("exchange_number").isNull()) | F.max("differs") | ~((F.min("exchange_number") == 1) & (F.max("exchange_number") == F.count("exchange_number")))).alias("broken"),
        (F.pmod(last, F.lit(2)) == 1).alias("unanswered"),
    )
    known = sessions.select("session_id").filter("session_id IS NOT NULL").distinct()
    state = known.join(state, "session_id", "full_outer")
    said, broken, unanswered = (F.coalesce(F.col(c), F.lit(False)) for c in ("said", "broken", "unanswered"))
    return state.select(F.col("session_id").alias("conv_key"), F.when(~said, "empty").when(broken, "broken").when(unanswered, "no_reply").alias("reason")).filter("reason IS NOT NULL")


def chat_turns(events: DataFrame, limit: int = COMPONENT_LIMIT) -> DataFrame:
    """Visible turns of the sound conversations in reading order.

    turn_no counts the turns of a conversation from 1, depth first. ``versions`` counts the alternatives of one speaker under one visible
    ancestor, ``change`` tells what the turn is (create, edit of a question, retry of an answer), ``final``
    marks the latest alternative and ``current`` the turns that only latest alternatives lead to. Texts are
    joined last, to the kept turns alone, from the same delivery that gave the flags.
    """
    deliveries = message_events(events)
    turns = message_trees(deliveries, limit=limit).filter("visible AND reason IS NULL")
    turns = turns.withColumn("change", F.when(F.col("versions") == 1, "create").when(F.col("role") == "human", "edit").otherwise("retry"))
    texts = deliveries.groupBy("conv_key", "uuid").agg(F.max_by("text", "version").alias("text"))
    return turns.join(texts, ["conv_key", "uuid"]).select("conv_key", "turn_no", "depth", "role", "uuid", "asked_by", "versions", "change", "final", "current", "text")


def session_turns(exchanges: DataFrame, sessions: DataFrame) -> DataFrame:
    """Question and answer turns of the sound sessions; repeated deliveries of a number give one turn."""
    left_out = broken_sessions(exchanges, sessions)
    once = exchanges.filter("session_id IS NOT NULL AND exchange_number IS NOT NULL").groupBy("session_id", "exchange_number").agg(F.min(F.struct("id", "human_text", "agent_text")).alias("x"))
    kept = once.join(left_out.withColumnRenamed("conv_key", "session_id"), "session_id", "left_anti")
    said = F.array(F.struct(F.lit("human").alias("role"), F.col("x.human_text").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("x.agent_text").alias("text")))
    turns = kept.select(F.col("session_id").alias("conv_key"), "exchange_number", F.posexplode(said).alias("side", "turn"))
    return turns.select("conv_key", (F.col("exchange_number").cast("bigint") * 2 + F.col("side") - 1).alias("turn_no"), "turn.role", "turn.text").filter(~is_blank("text"))
