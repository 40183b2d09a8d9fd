"""What a parser makes of one file: sessions with their turns, notes, and what was left out and why."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

#: Characters kept of a tool's parameters and of an error message.
PARAMS_BUDGET, ERROR_BUDGET = 500, 1_000


@dataclass
class Artefact:
    """One file: its path, its bytes, and where it was found."""

    path: str
    content: bytes
    project: str | None = None

    @property
    def text(self) -> str:
        return self.content.decode("utf-8", "replace")

    @property
    def stem(self) -> str:
        return re.sub(r"\.\w+$", "", self.path.rsplit("/", 1)[-1])


@dataclass
class Turn:
    """A question and its answer with what the source states about them; None is not stated."""

    human_text: str = ""
    agent_text: str = ""
    human_timestamp: str | None = None
    agent_timestamp: str | None = None
    source_id: str | None = None
    model: str | None = None
    provider: str | None = None
    tokens_in: int | None = None
    tokens_out: int | None = None
    tokens_reasoning: int | None = None
    is_after_compaction: bool = False
    tools: list[dict] = field(default_factory=list)
    thinking: list[str] = field(default_factory=list)

    @property
    def latency_ms(self) -> int | None:
        a, b = instant(self.human_timestamp), instant(self.agent_timestamp)
        return max(0, round((b - a).total_seconds() * 1000)) if a and b else None

    @property
    def signal(self) -> int:
        """How many provenance fields the source states."""
        return sum(v is not None for v in (self.model, self.provider, self.tokens_in, self.tokens_out, self.tokens_reasoning))


@dataclass
class Session:
    session_id: str
    source_agent: str
    project: str | None = None
    title: str | None = None
    started_at: str | None = None
    ended_at: str | None = None
    metadata: dict = field(default_factory=dict)
    turns: list[Turn] = field(default_factory=list)


@dataclass
class Memory:
    source_id: str
    layer: str
    content: str
    source_agent: str
    project: str | None = None
    created_at: str | None = None
    metadata: dict = field(default_factory=dict)


@dataclass
class Records:
    sessions: list[Session] = field(default_factory=list)
    memories: list[Memory] = field(default_factory=list)
    discards: list[tuple[str, str, bool]] = field(default_factory=list)  # record, reason, left out by design
    deferred: list[str] = field(default_factory=list)  # turns still open: read again when the file has grown

    def drop(self, record: str, reason: str, by_design: bool = False) -> None:
        self.discards.append((record, reason, by_design))


def instant(stamp: str | None) -> datetime | None:
    """A time with a zone; times without one are not accepted."""
    try:
        found = datetime.fromisoformat(stamp) if stamp else None
    except (TypeError, ValueError):
        return None
    return found if found is not None and found.tzinfo is not None else None


def iso(epoch: float | int | None) -> str | None:
    """Epoch seconds, or milliseconds beyond 1e11, as ISO 8601 UTC."""
    if not isinstance(epoch, (int, float)) or isinstance(epoch, bool):
        return None
    moment = datetime.fromtimestamp(epoch / 1000 if abs(epoch) >= 1e11 else epoch, UTC)
    return moment.isoformat(timespec="milliseconds" if moment.microsecond else "seconds").replace("+00:00", "Z")


def json_lines(text: str, records: Records) -> Iterator[tuple[int, dict]]:
    """Numbered JSON objects of a text; broken lines are noted, an unended last line is deferred."""
    lines = text.split("\n")
    for number, line in enumerate(lines, 1):
        if not line.strip():
            continue
        try:
            found = json.loads(line)
        except ValueError:
            if number == len(lines):
                records.deferred.append(f"line {number}")
            else:
                records.drop(f"line {number}", "no JSON")
            continue
        if isinstance(found, dict):
            yield number, found
        else:
            records.drop(f"line {number}", "no JSON object")


def basename(path: str | None) -> str | None:
    return path.rstrip("/\\").replace("\\", "/").rsplit("/", 1)[-1] or None if path else None


def parts_text(content: object, kind: str = "text") -> str:
    """The text of a message whose content is a string or a list of typed parts."""
    if isinstance(content, str):
        return content if kind == "text" else ""
    if not isinstance(content, list):
        return ""
    return "\n".join(p[kind] for p in content if isinstance(p, dict) and p.get("type") == kind and isinstance(p.get(kind), str) and p[kind].strip())


def finish(session: Session) -> Session:
    """Start and end of a session from its turns, where the source gives none."""
    starts = [t.human_timestamp for t in session.turns if instant(t.human_timestamp)]
    ends = [t.agent_timestamp or t.human_timestamp for t in session.turns if instant(t.agent_timestamp or t.human_timestamp)]
    session.started_at = session.started_at or min(starts, key=instant, default=None)
    session.ended_at = session.ended_at or max(ends, key=instant, default=None)
    return session
