"""A ledger of migration batches: what was moved, what each batch must hold, and when a family is verified."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.sinks import VersionedTable

SCHEMA = "family string, batch int, rows bigint, state string"
#: The states in order; a family verified without rows may be opened again.
STATES = ("absent", "prepared", "batch", "verified", "verified-empty")


class LedgerError(RuntimeError):
    """A step that the ledger's state does not allow."""


class Ledger:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, VersionedTable(spark, path)

    def _entries(self, family: str) -> list:
        held = self.table.read()
        return [] if held is None else held.filter(F.col("family") == family).orderBy("batch").collect()  # one row a batch

    def state(self, family: str) -> str:
        entries = self._entries(family)
        return entries[-1]["state"] if entries else "absent"

    def _add(self, family: str, rows: int, state: str) -> None:
        step = len(self._entries(family))
        self.table.upsert(self.spark.createDataFrame([(family, step, rows, state)], SCHEMA), ["family", "batch"])

    def prepare(self, family: str) -> None:
        if self.state(family) not in ("absent", "verified-empty"):
            raise LedgerError(f"{family} is {self.state(family)}")
        self._add(family, 0, "prepared")

    def commit(self, family: str, moved: DataFrame, expected: int) -> None:
        """Note a batch; it must hold the rows that were announced."""
        if self.state(family) not in ("prepared", "batch"):
            raise LedgerError(f"{family} is {self.state(family)}")
        held = moved.count()
        if held != expected:
            raise LedgerError(f"the batch of {family} holds {held} rows, not {expected}")
        self._add(family, held, "batch")

    def verify(self, family: str, source_rows: int) -> str:
        """Close a family: its batches must hold all rows of the source; without any it is verified empty."""
        entries = self._entries(family)
        if self.state(family) not in ("prepared", "batch"):
            raise LedgerError(f"{family} is {self.state(family)}")
        begun = max(i for i, e in enumerate(entries) if e["state"] == "prepared")
        moved = sum(e["rows"] for e in entries[begun:])
        if moved != source_rows:
            raise LedgerError(f"{family} moved {moved} of {source_rows} rows")
        done = "verified" if source_rows else "verified-empty"
        self._add(family, moved, done)
        return done


def dispose(rows: DataFrame, rules: dict[str, str], table: str) -> DataFrame:
    """What becomes of a legacy table's rows: kept as they are, or archived as JSON records, or refused without a rule."""
    rule = rules.get(table)
    if rule == "keep":
        return rows
    if rule == "archive":
        return rows.select(F.lit(table).alias("legacy_table"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record_json"))
    raise LedgerError(f"no rule says what becomes of {table}")
