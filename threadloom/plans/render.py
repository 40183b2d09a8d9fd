"""Results as text: compact tables for agents, and envelopes with how a result came about."""

from __future__ import annotations

import json
import re

from threadloom.plans.engine import Answer

#: Characters of a cell.
CELL = 160


def number_text(value: float) -> str:
    """Six significant digits, whole numbers without a point."""
    return str(int(value)) if float(value).is_integer() and abs(value) < 1e15 else f"{value:.6g}"


def cell(value: object) -> str:
    """A value as one cell: quoted where it would be read as something else."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return number_text(value)
    if isinstance(value, int):
        return str(value)
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
    text = text if len(text) <= CELL else text[: CELL - 1] + "…"
    plain = text != "" and text == text.strip() and not re.search(r"[,\"\n\r\t:{}\[\]\\]", text) and not re.fullmatch(r"null|true|false|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|-.*", text)
    return text if plain else json.dumps(text, ensure_ascii=False)


def toon(rows: list[dict], columns: list[str] | None = None, name: str = "rows") -> str:
    """``rows[N]{a,b}:`` and one indented line a row; columns keep their order."""
    columns = columns or list(rows[0] if rows else {})
    head = f"{name}[{len(rows)}]{{{','.join(columns)}}}:"
    return "\n".join([head, *("  " + ",".join(cell(r.get(c)) for c in columns) for r in rows)])


def envelope(answer: Answer) -> dict:
    return {"path": answer.path, "sql": answer.sql, "count": len(answer.rows), "rows": answer.rows, "notes": answer.notes, "milliseconds": round(answer.seconds * 1000)}


def explore_envelope(question: str, parts: dict) -> dict:
    return {"question": question, "terrain": parts, "summary": " ".join(f"{r['n']} from {r['source']}." for r in parts.get("sources", []))}


def health_envelope(checks: list[dict]) -> dict:
    order = ["pass", "warn", "fail"]
    return {"verdict": max((c["verdict"] for c in checks), key=order.index, default="pass"), "checks": checks}


def store_envelope(stored: int, offered: int) -> dict:
    return {"stored": stored, "already_there": offered - stored}
