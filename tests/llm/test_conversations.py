import pytest

from threadloom.llm.blank import blank, is_blank
from threadloom.llm.conversations import broken_chats, broken_sessions, chat_turns, message_events, message_trees, session_turns

MESSAGE = "conversation_uuid string, uuid string, text string, sender string, created_at string, parent_message_uuid string, ingested_at timestamp"


def chats(spark, rows):
    from datetime import datetime

    full = [(c, u, t, s, f"2030-01-01T00:00:{i:02d}Z", p, datetime(2030, 1, 1, 0, i)) for i, (c, u, t, s, p) in enumerate(rows)]
    return spark.createDataFrame(full, MESSAGE)


def reasons(spark, rows, known=(), limit=500_000):
    frame = spark.createDataFrame([(k,) for k in known], "uuid string")
    return {r.conv_key: r.reason for r in broken_chats(chats(spark, rows), frame, limit).collect()}


def test_blank():
    for text in (None, "", " ", "​", "[tool use]", " [x] ", "...", "—"):
        assert blank(text)
    for text in ("a", "[a] b", "[a][b]", "1"):
        assert not blank(text)


def test_blank_column_agrees(spark):
    texts = [None, "", "​", "[tool use]", "[a] b", "a", "1", "  [x]\n", "№", "é", "[]"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(is_blank("t")).collect()] == [blank(t) for t in texts]


@pytest.mark.parametrize("limit", [500_000, 1])
def test_reasons_of_chats(spark, limit):
    rows = [
        ("ok", "1", "q", " Human ", "00000000-0000"), ("ok", "2", "", "tool", "1"), ("ok", "3", "a", "AI", " 2 "), ("ok", "3", "a", "AI", "2"),
        ("silent", "1", " ", "human", None), ("silent", "2", "x", "system", "1"),
        ("sender", "1", "q", " ", None), ("sender", "2", "a", "assistant", "1"), ("lost", "1", "q", "human", "nowhere"), ("lost", "2", "a", "assistant", "1"),
        ("circle", "1", "q", "human", "2"), ("circle", "2", "a", "assistant", "1"), ("open", "1", "q", "human", None), ("open", "2", "a", "assistant", "1"), ("open", "3", "again", "user", "2"),
        ("zero", "1", "q", "human", "00000000-0000-4000-8000-000000000000"), ("zero", "2", "a", "assistant", "1"), ("missing", "1", "q", "human", "00000000-0000-4000-8000-000000000001"), ("missing", "2", "a", "ai", "1"),
        ("between", "1", "q", "human", None), ("between", "2", "q2", "human", "1"), ("between", "3", "a", "assistant", "2"),
    ]
    assert reasons(spark, rows, ["none", "ok", None], limit) == {"silent": "empty", "sender": "broken", "lost": "broken", "circle": "broken", "missing": "broken", "open": "no_reply", "between": "no_reply", "none": "empty"}


def test_empty_tables_and_clashing_columns(spark):
    assert reasons(spark, []) == {}
    frame = chats(spark, [("c", "1", "q", "human", None), (None, "2", "x", "ai", "1"), ("c", None, "x", "ai", "1")]).selectExpr("*", "'x' AS scope", "1 AS visible", "2 AS conv_key", "3 AS depth")
    assert message_trees(message_events(frame)).count() == 1


@pytest.mark.parametrize("limit", [500_000, 1])
def test_turns_are_ordered_and_tell_edits_and_retries(spark, limit):
    rows = [("c", "1", "q", "human", None), ("c", "2", "a", "assistant", "1"), ("c", "3", "b", "assistant", "1"), ("c", "4", "next", "human", "3"), ("c", "5", "fine", "assistant", "4"), ("d", "1", "q", "human", None),
            ("c", "6", "more", "human", "2"), ("c", "7", "old", "assistant", "6"), ("c", "7", "new", "assistant", "6"), ("c", "8", "gone", "assistant", "5"), ("c", "8", " ", "assistant", "5")]
    turns = chat_turns(chats(spark, rows), limit).orderBy("turn_no").collect()
    assert [(t.text, t.change, t.final, t.current) for t in turns] == [
        ("q", "create", True, True), ("a", "retry", False, False), ("more", "create", True, False), ("new", "create", True, False), ("b", "retry", True, True), ("next", "create", True, True), ("fine", "create", True, True),
    ]


def test_flags_and_text_come_from_one_delivery_in_a_tie(spark):
    frame = chats(spark, [("c", "1", "first", "human", None), ("c", "1", " ", "human", None), ("c", "2", "a", "ai", "1")]).selectExpr("conversation_uuid", "uuid", "text", "sender", "'t' AS created_at", "parent_message_uuid", "timestamp'2030-01-01' AS ingested_at")
    turns = chat_turns(frame).collect()
    assert {t.uuid: t.text for t in turns} in ({"1": "first", "2": "a"}, {"2": "a"})


EXCHANGE = "id bigint, session_id string, exchange_number int, human_text string, agent_text string"


def test_reasons_of_sessions(spark):
    rows = [
        (1, "ok", 1, "q", "a"), (2, "ok", 2, "q", "a"), (3, "ok", 2, "q", "a"), (4, "gap", 1, "q", "a"), (5, "gap", 3, "q", "a"), (6, "null", None, "q", "a"), (7, "two", 1, "q", "a"), (8, "two", 1, "q", "b"), (9, "nulls", 1, "q", None), (10, "nulls", 1, "q", ""),
        (11, "open", 1, "q", "a"), (12, "open", 2, "q", "[tool use]"), (13, "blank", 1, " ", None), (14, None, 1, "q", "a"),
    ]
    exchanges = spark.createDataFrame(rows, EXCHANGE)
    sessions = spark.createDataFrame([("ok",), ("none",), (None,)], "session_id string")
    assert {r.conv_key: r.reason for r in broken_sessions(exchanges, sessions).collect()} == {"gap": "broken", "null": "broken", "two": "broken", "nulls": "broken", "open": "no_reply", "blank": "empty", "none": "empty"}
    assert [(r.turn_no, r.role) for r in session_turns(exchanges, sessions).orderBy("turn_no").collect()] == [(1, "human"), (2, "assistant"), (3, "human"), (4, "assistant")]
    assert broken_sessions(exchanges.limit(0), sessions.limit(0)).count() == 0
