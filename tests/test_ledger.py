import json

import pytest

from threadloom.operators.ledger import Ledger, LedgerError, dispose
from threadloom.sources.call_logs import import_calls, recent
from threadloom.sources.sinks import VersionedTable


def test_states_follow_each_other(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.range(3)
    assert ledger.state("a") == "absent"
    with pytest.raises(LedgerError):
        ledger.commit("a", rows, 3)
    ledger.prepare("a")
    with pytest.raises(LedgerError):
        ledger.commit("a", rows, 4)
    ledger.commit("a", rows, 3)
    with pytest.raises(LedgerError):
        ledger.verify("a", 9)
    assert ledger.verify("a", 3) == "verified"
    with pytest.raises(LedgerError):
        ledger.prepare("a")
    ledger.prepare("b")
    assert ledger.verify("b", 0) == "verified-empty"
    ledger.prepare("b")
    assert ledger.state("b") == "prepared"


def test_disposition(spark):
    rows = spark.createDataFrame([(1, None)], "id int, t string")
    assert dispose(rows, {"x": "keep"}, "x").columns == ["id", "t"] and json.loads(dispose(rows, {"x": "archive"}, "x").first().record_json) == {"id": 1, "t": None}
    with pytest.raises(LedgerError):
        dispose(rows, {}, "x")


def test_call_segments_resume(spark, tmp_path):
    log = tmp_path / "logs"
    log.mkdir()
    one = json.dumps({"id": "1", "at": "2030-01-01T00:00:00Z", "verb": "exec", "token": "abc123"})
    two = json.dumps({"id": "2", "at": "2029-01-01T00:00:00Z", "verb": "query", "error": "boom"})
    (log / "a.jsonl").write_text(one + "\n")
    archive = str(tmp_path / "archive")
    assert import_calls(spark, str(log), archive) == 1 and import_calls(spark, str(log), archive) == 0
    (log / "a.jsonl").write_text(f"{one}\n{two[:20]}")
    assert import_calls(spark, str(log), archive) == 0  # still being written
    (log / "a.jsonl").write_text(f"{one}\n{two}\nbroken\n")
    assert import_calls(spark, str(log), archive) == 2
    calls = VersionedTable(spark, f"{archive}/calls").read()
    assert calls.count() == 2 and calls.filter("failed").first().message == "boom"
    assert [r.call_id for r in recent(calls, "2030-01-02 00:00:00").collect()] == ["1"]
