"""Parsers of agent transcripts, exports and note files. Each is a pure function from an artefact to records."""

from __future__ import annotations

import hashlib
import json
import re
import sqlite3
from collections.abc import Callable
from dataclasses import dataclass

from threadloom.sources.records import ERROR_BUDGET, PARAMS_BUDGET, Artefact, Memory, Records, Session, Turn, basename, finish, instant, iso, json_lines, parts_text


def _clip(value: object, budget: int) -> str:
    return (value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))[:budget]


def _message_turns(lines: list[tuple[int, dict]], stamp: str, records: Records) -> list[Turn]:
    """Turns of user and assistant lines: a user line with text opens one, tool results complete earlier calls."""
    turns: list[Turn] = []
    compacted = False
    calls: dict[str, dict] = {}
    for number, line in lines:
        kind, message = line.get("type"), line.get("message") or {}
        if kind == "summary" or line.get("isCompactSummary"):
            compacted = True
            continue
        content = message.get("content")
        if kind == "user":
            for part in content if isinstance(content, list) else ():
                if isinstance(part, dict) and part.get("type") == "tool_result" and part.get("tool_use_id") in calls:
                    call = calls[part["tool_use_id"]]
                    call["had_error"] = bool(part.get("is_error"))
                    if call["had_error"]:
                        call["error_message"] = _clip(part.get("content"), ERROR_BUDGET)
            text = parts_text(content)
            if text.strip():
                turns.append(Turn(text, human_timestamp=line.get(stamp), is_after_compaction=compacted, source_id=line.get("uuid")))
                compacted = False
        elif kind == "assistant":
            if not turns:
                records.drop(f"line {number}", "answer without a question")
                continue
            turn, usage = turns[-1], message.get("usage") or {}
            text = parts_text(content)
            turn.agent_text = "\n".join(t for t in (turn.agent_text, text) if t.strip())
            turn.agent_timestamp = line.get(stamp) or turn.agent_timestamp
            turn.model = message.get("model") or turn.model
            for own, theirs in (("tokens_in", "input_tokens"), ("tokens_out", "output_tokens")):
                if isinstance(usage.get(theirs), int):
                    setattr(turn, own, (getattr(turn, own) or 0) + usage[theirs])
            thought = parts_text(content, "thinking")
            if thought and thought not in turn.thinking:
                turn.thinking.append(thought)
            for part in content if isinstance(content, list) else ():
                if isinstance(part, dict) and part.get("type") == "tool_use":
                    call = {"tool_name": part.get("name"), "params": _clip(part.get("input") or {}, PARAMS_BUDGET), "had_error": False, "error_message": None}
                    calls[part.get("id")] = call
                    turn.tools.append(call)
    return turns


def claude_session(a: Artefact) -> Records:
    records = Records()
    lines = list(json_lines(a.text, records))
    side = any(line.get("isSidechain") or line.get("agentId") for _, line in lines)
    turns = _message_turns(lines, "timestamp", records)
    first = next((line for _, line in lines if line.get("cwd")), {})
    own = next((line["sessionId"] for _, line in lines if line.get("sessionId")), a.stem)
    agent = next((line["agentId"] for _, line in lines if line.get("agentId")), None)
    session = Session(agent if side and agent else own, "claude-subagent" if side else "claude", basename(first.get("cwd")) or a.project, metadata={"parent": own} if side else {})
    session.turns = _without_open_turn(turns, records)
    if compactions := sum(line.get("type") == "summary" for _, line in lines):
        session.metadata["compactions"] = compactions
    records.sessions.append(finish(session))
    return records


def _without_open_turn(turns: list[Turn], records: Records) -> list[Turn]:
    """A last question without any answer is still open: it is read again when the file has grown."""
    if turns and not (turns[-1].agent_text or turns[-1].tools or turns[-1].thinking):
        records.deferred.append(turns.pop().human_text[:80])
    return turns


def cowork_audit(a: Artefact) -> Records:
    records = Records()
    lines = list(json_lines(a.text, records))
    own = next((line["session_id"] for _, line in lines if line.get("session_id")), a.stem)
    session = Session(own, "cowork", a.project, turns=_without_open_turn(_message_turns(lines, "_audit_timestamp", records), records))
    records.sessions.append(finish(session))
    return records


def session_metadata(a: Artefact) -> Records:
    found = json.loads(a.text)
    own = found.get("sessionId") or found.get("session_id") or a.stem
    session = Session(own, "claude", basename(found.get("cwd")), found.get("title"), iso(found.get("createdAt")) or found.get("created_at"), iso(found.get("lastActivityAt")) or found.get("updated_at"), {"snapshot": True})
    return Records([session])


def codex_rollout(a: Artefact) -> Records:
    """Turns of the event stream; tokens, tools and reasoning belong to the turn whose records enclose them."""
    records = Records()
    session = Session(a.stem, "codex", a.project)
    events: list[tuple[int, Turn]] = []
    fallback: list[Turn] = []
    calls: dict[str, dict] = {}
    open_turn: Turn | None = None
    model = None
    for number, line in json_lines(a.text, records):
        payload, stamp = line.get("payload") or {}, line.get("timestamp")
        kind, inner = line.get("type"), payload.get("type")
        if kind == "session_meta":
            session.session_id, session.project = payload.get("id") or session.session_id, basename(payload.get("cwd")) or session.project
            session.started_at = payload.get("timestamp") or stamp
        elif kind == "turn_context":
            model = payload.get("model") or model
        elif kind == "event_msg" and inner == "user_message":
            open_turn = Turn(payload.get("message") or "", human_timestamp=stamp, model=model)
            events.append((number, open_turn))
        elif kind == "event_msg" and inner in ("task_complete", "agent_message") and open_turn:
            text = payload.get("last_agent_message") if inner == "task_complete" else payload.get("message")
            open_turn.agent_text = text or open_turn.agent_text
            open_turn.agent_timestamp = stamp
        elif kind == "event_msg" and inner == "token_count" and open_turn:
            usage = (payload.get("info") or {}).get("last_token_usage") or {}
            for own, theirs in (("tokens_in", "input_tokens"), ("tokens_out", "output_tokens"), ("tokens_reasoning", "reasoning_output_tokens")):
                if isinstance(usage.get(theirs), int):
                    setattr(open_turn, own, (getattr(open_turn, own) or 0) + usage[theirs])
        elif kind == "event_msg" and inner == "agent_reasoning" and open_turn:
            if payload.get("text") and payload["text"] not in open_turn.thinking:
                open_turn.thinking.append(payload["text"])
        elif kind == "response_item":
            if inner == "function_call" and open_turn:
                call = {"tool_name": payload.get("name"), "params": _clip(payload.get("arguments") or "", PARAMS_BUDGET), "had_error": False, "error_message": None}
                calls[payload.get("call_id")] = call
                open_turn.tools.append(call)
            elif inner == "function_call_output" and payload.get("call_id") in calls:
                output = payload.get("output")
                failed = isinstance(output, dict) and output.get("success") is False
                calls[payload["call_id"]].update(had_error=failed, error_message=_clip(output, ERROR_BUDGET) if failed else None)
            elif inner == "message":
                text = "\n".join(p.get("text", "") for p in payload.get("content") or () if isinstance(p, dict))
                if payload.get("role") == "user":
                    fallback.append(Turn(text, human_timestamp=stamp, model=model))
                elif payload.get("role") == "assistant" and fallback:
                    fallback[-1].agent_text = "\n".join(t for t in (fallback[-1].agent_text, text) if t)
                    fallback[-1].agent_timestamp = stamp
    turns = [t for _, t in events] or fallback
    if turns and not turns[-1].agent_text:
        records.deferred.append(turns.pop().human_text[:80])
    session.turns = turns
    records.sessions.append(finish(session))
    return records


def codex_history(a: Artefact) -> Records:
    records = Records()
    sessions: dict[str, Session] = {}
    for number, line in json_lines(a.text, records):
        if not line.get("session_id") or not isinstance(line.get("text"), str):
            records.drop(f"line {number}", "no session or text")
            continue
        stamp = iso(line.get("ts"))
        own = sessions.setdefault(line["session_id"], Session(line["session_id"], "codex", a.project))
        digest = hashlib.sha256(f"{line['session_id']}\0{line.get('ts')}\0{line['text']}".encode()).hexdigest()
        own.turns.append(Turn(line["text"], human_timestamp=stamp, source_id=digest))
    records.sessions = [finish(s) for s in sessions.values()]
    return records


def codex_aggregate(a: Artefact) -> Records:
    records = Records()
    for block in re.split(r"(?m)^(?=## Thread `)", a.text):
        thread = re.match(r"## Thread `([^`]+)`", block)
        if thread:
            updated = re.search(r"(?m)^updated_at:\s*(\S+)", block)
            cwd = re.search(r"(?m)^cwd:\s*(\S+)", block)
            records.memories.append(Memory(f"thread:{thread.group(1)}", "feedback", block.strip(), "codex", basename(cwd.group(1)) if cwd else a.project, updated.group(1) if updated else None))
        elif block.strip():
            records.drop(block.strip()[:60], "text outside a thread", True)
    return records


#: Layer of a note by the type its head states.
_LAYERS = {"user": "user", "feedback": "feedback", "project": "project", "reference": "lookup", "pattern": "pattern", "decision": "decision"}


def markdown_memory(a: Artefact) -> Records:
    head, body = {}, a.text
    m = re.match(r"---\s*\n(.*?)\n---\s*\n?(.*)\Z", a.text, re.S)
    if m:
        head = dict(re.findall(r"(?m)^([\w-]+):\s*(.*?)\s*$", m.group(1)))
        body = m.group(2)
    if not body.strip():
        return Records(discards=[(a.path, "empty note", True)])
    layer = _LAYERS.get(head.get("type", "").lower(), "user")
    return Records(memories=[Memory(head.get("name") or a.path, layer, body.strip(), "claude-code", a.project, metadata={"file_path": a.path} | {k: v for k, v in head.items() if k != "type"})])


def whole_file(layer: str, agent: str) -> Callable[[Artefact], Records]:
    def parse(a: Artefact) -> Records:
        if not a.text.strip():
            return Records(discards=[(a.path, "empty file", True)])
        return Records(memories=[Memory(a.path, layer, a.text.strip(), agent, a.project, metadata={"file_path": a.path})])

    return parse


# What tells the layer of a block.
_USER_CUE = re.compile(r"\b(i am|my name|lives in|based in|identity|biography)\b", re.I)
_FEEDBACK_CUE = re.compile(r"\b(prefer|prefers|review|expect|expects|never|do not|don't|wants|hate|hates)\b", re.I)


def hermes_memory(a: Artefact) -> Records:
    """Blocks between section signs, each known by its file and content; the layer follows from what a block talks about."""
    records = Records()
    for block in a.text.replace("\r\n", "\n").split("§"):
        text = block.strip()
        if text:
            layer = "user" if _USER_CUE.search(text) else "feedback" if _FEEDBACK_CUE.search(text) else "pattern"
            digest = hashlib.sha256(text.encode()).hexdigest()
            records.memories.append(Memory(f"{a.path}#block={digest}", layer, text, "hermes", a.project, metadata={"file_path": a.path, "block_hash": digest}))
    return records


def pi_session(a: Artefact) -> Records:
    """A message tree: the branch from the last message up to the root is the conversation."""
    records = Records()
    lines = list(json_lines(a.text, records))
    header = next((line for _, line in lines if line.get("type") == "session"), None)
    if header is None or not header.get("id"):
        return Records(discards=[(a.path, "no session header", False)])
    nodes = {line["id"]: line for _, line in lines if line.get("type") == "message" and line.get("id")}
    roots = [n for n in nodes.values() if n.get("parentId") not in nodes]
    if len(roots) > 1:
        records.drop(a.path, f"{len(roots)} roots")
    branch, seen, at = [], set(), next(reversed(nodes), None)
    while at in nodes and at not in seen:
        seen.add(at)
        branch.append(nodes[at])
        at = nodes[at].get("parentId")
    session = Session(f"pi:{header['id']}", "pi", basename(header.get("cwd")), started_at=header.get("timestamp"))
    calls: dict[str, dict] = {}
    for node in reversed(branch):
        message = node.get("message") or {}
        content = message.get("content")
        if message.get("role") == "user":
            session.turns.append(Turn(parts_text(content), human_timestamp=node.get("timestamp"), source_id=node["id"]))
        elif message.get("role") == "toolResult" and message.get("toolCallId") in calls:
            failed = bool(message.get("isError"))
            calls.pop(message["toolCallId"]).update(had_error=failed, error_message=_clip(content, ERROR_BUDGET) if failed else None)
        elif message.get("role") == "assistant" and session.turns:
            turn = session.turns[-1]
            turn.agent_text = "\n".join(t for t in (turn.agent_text, parts_text(content)) if t)
            turn.agent_timestamp, turn.model, turn.provider = node.get("timestamp"), message.get("model") or turn.model, message.get("provider") or turn.provider
            turn.thinking += [t for t in [parts_text(content, "thinking")] if t]
            for part in content if isinstance(content, list) else ():
                if isinstance(part, dict) and part.get("type") == "toolCall":
                    calls[part.get("id")] = call = {"tool_name": part.get("name"), "params": _clip(part.get("arguments") or {}, PARAMS_BUDGET), "had_error": False, "error_message": None}
                    turn.tools.append(call)
    if session.turns and (calls or not session.turns[-1].agent_text):
        records.deferred.append(session.turns.pop().human_text[:80])
    records.sessions.append(finish(session))
    return records


def qwen_session(a: Artefact) -> Records:
    records = Records()
    lines = list(json_lines(a.text, records))
    own = next((line["sessionId"] for _, line in lines if line.get("sessionId")), a.stem)
    session = Session(own, "qwen-code", a.project)
    open_calls = 0
    for number, line in lines:
        if line.get("sessionId") != own:
            records.drop(f"line {number}", "record of another session")
            continue
        session.project = basename(line.get("cwd")) or session.project
        parts = (line.get("message") or {}).get("parts") or []
        text = "\n".join(p["text"] for p in parts if isinstance(p, dict) and p.get("text") and not p.get("thought"))
        if line.get("type") == "user" and text:
            session.turns.append(Turn(text, human_timestamp=line.get("timestamp"), source_id=line.get("uuid")))
            open_calls = 0
        elif line.get("type") == "assistant" and session.turns:
            turn, usage = session.turns[-1], line.get("usageMetadata") or {}
            turn.agent_text = "\n".join(t for t in (turn.agent_text, text) if t)
            turn.agent_timestamp, turn.model = line.get("timestamp"), line.get("model") or turn.model
            turn.thinking += [p["text"] for p in parts if isinstance(p, dict) and p.get("thought") and p.get("text")]
            for key, theirs in (("tokens_in", "promptTokenCount"), ("tokens_out", "candidatesTokenCount"), ("tokens_reasoning", "thoughtsTokenCount")):
                if isinstance(usage.get(theirs), int):
                    setattr(turn, key, (getattr(turn, key) or 0) + usage[theirs])
            for p in parts:
                if isinstance(p, dict) and p.get("functionCall"):
                    open_calls += 1
                    turn.tools.append({"tool_name": p["functionCall"].get("name"), "params": _clip(p["functionCall"].get("args") or {}, PARAMS_BUDGET), "had_error": False, "error_message": None})
        elif line.get("type") in ("tool_result", "tool"):
            open_calls = max(0, open_calls - 1)
    if session.turns and (open_calls or not session.turns[-1].agent_text):
        records.deferred.append(session.turns.pop().human_text[:80])
    records.sessions.append(finish(session))
    return records


def grok_updates(a: Artefact) -> Records:
    """Chunks of an update stream put together again, question by question."""
    records = Records()
    session = Session(a.stem, "grok", a.project)
    prompt = None
    tools: dict[str, dict] = {}
    for _, line in json_lines(a.text, records):
        params = line.get("params") or {}
        update = params.get("update") or {}
        kind, stamp = update.get("sessionUpdate"), iso(line.get("timestamp"))
        session.session_id = params.get("sessionId") or session.session_id
        content = update.get("content")
        text = content.get("text", "") if isinstance(content, dict) else ""
        meta = update.get("_meta") or {}
        if kind == "user_message_chunk":
            if not session.turns or meta.get("promptIndex") != prompt or session.turns[-1].agent_text:
                session.turns.append(Turn("", human_timestamp=stamp, model=meta.get("modelId")))
                prompt = meta.get("promptIndex")
            session.turns[-1].human_text += text
        elif not session.turns:
            continue
        elif kind == "agent_message_chunk":
            session.turns[-1].agent_text += text
            session.turns[-1].agent_timestamp = stamp
        elif kind in ("agent_thought_chunk", "plan"):
            thought = text or json.dumps(update.get("entries") or [])
            session.turns[-1].thinking.append(thought)
        elif kind == "tool_call":
            tools[update.get("toolCallId")] = call = {"tool_name": update.get("title") or update.get("kind"), "params": _clip(update.get("rawInput") or {}, PARAMS_BUDGET), "had_error": False, "error_message": None}
            session.turns[-1].tools.append(call)
        elif kind == "tool_call_update" and update.get("toolCallId") in tools:
            tools[update["toolCallId"]].update(had_error=update.get("status") == "failed", error_message=_clip(content, ERROR_BUDGET) if update.get("status") == "failed" else None)
    for turn in session.turns:
        turn.thinking = ["".join(turn.thinking)] if turn.thinking else []
    records.sessions.append(finish(session))
    return records


def grok_metadata(a: Artefact) -> Records:
    found = json.loads(a.text)
    info = found.get("info") or {}
    return Records([Session(info.get("id") or a.stem, "grok", basename(info.get("cwd")), found.get("generated_title"), found.get("created_at"), found.get("updated_at"), {"snapshot": True, "model": found.get("current_model_id")})])


def _tree_pairs(nodes: dict[str, dict], records: Records) -> list[tuple[dict, dict]]:
    """(question, answer) pairs: an answer belongs to the nearest shown ancestor, if that is a question."""
    pairs = []
    for key, node in nodes.items():
        if node["role"] != "assistant" or not node["shown"]:
            continue
        seen, at = {key}, node["parent"]
        while at in nodes and not nodes[at]["shown"] and at not in seen:
            seen.add(at)
            at = nodes[at]["parent"]
        if at in seen:
            records.drop(key, "parents run in a circle")
        elif at in nodes and nodes[at]["role"] == "human":
            pairs.append((nodes[at], node))
        else:
            records.drop(key, "answer without a question")
    return pairs


def claude_export(a: Artefact) -> Records:
    records = Records()
    for conversation in json.loads(a.text):
        nodes: dict[str, dict] = {}
        previous = None
        for place, message in enumerate(conversation.get("chat_messages") or ()):
            key, sender, text = message.get("uuid"), message.get("sender"), message.get("text") or ""
            if not key or key in nodes:
                records.drop(str(key), "message repeated or without identity")
                continue
            role = {"human": "human", "assistant": "assistant"}.get(sender)
            if role is None:
                records.drop(key, f"unsupported sender {sender}")
            elif not text.strip():
                records.drop(key, "empty text")
            parent = message.get("parent_message_uuid") or previous
            nodes[key] = {"key": key, "role": role, "text": text, "parent": parent, "at": message.get("created_at"), "place": place, "shown": role is not None and bool(text.strip())}
            previous = key
        pairs = sorted(_tree_pairs(nodes, records), key=lambda p: (p[0]["place"], p[1]["place"]))
        session = Session(conversation.get("uuid"), "claude-web", None, conversation.get("name"), conversation.get("created_at"), conversation.get("updated_at"))
        session.turns = [Turn(q["text"], r["text"], q["at"], r["at"], r["key"]) for q, r in pairs]
        records.sessions.append(session)
    return records


def chatgpt_export(a: Artefact) -> Records:
    records = Records()
    for conversation in json.loads(a.text):
        nodes: dict[str, dict] = {}
        for place, (key, node) in enumerate((conversation.get("mapping") or {}).items()):
            message = node.get("message") or {}
            role = {"user": "human", "assistant": "assistant"}.get((message.get("author") or {}).get("role"))
            text = "\n".join(p for p in (message.get("content") or {}).get("parts") or () if isinstance(p, str))
            hidden = (message.get("metadata") or {}).get("is_visually_hidden_from_conversation")
            shown = role is not None and bool(text.strip()) and not hidden
            if message and not shown:
                records.drop(key, "hidden, empty or of a system or tool", True)
            nodes[key] = {"key": key, "role": role, "text": text, "parent": node.get("parent"), "at": iso(message.get("create_time")), "place": place, "shown": shown, "model": (message.get("metadata") or {}).get("model_slug")}
        session = Session(conversation.get("conversation_id") or conversation.get("id"), "chatgpt-web", conversation.get("gizmo_id"), conversation.get("title"), iso(conversation.get("create_time")), iso(conversation.get("update_time")))
        pairs = sorted(_tree_pairs(nodes, records), key=lambda p: (p[0]["at"] or "", p[1]["at"] or "", p[1]["place"]))
        session.turns = [Turn(q["text"], r["text"], q["at"], r["at"], r["key"], r["model"]) for q, r in pairs]
        records.sessions.append(session)
    return records


def claude_web_memories(a: Artefact) -> Records:
    records = Records()
    for account in json.loads(a.text):
        who = account.get("account_uuid")
        if (account.get("conversations_memory") or "").strip():
            records.memories.append(Memory(f"memory-account:{who}", "user", account["conversations_memory"], "claude-web"))
        for project, text in (account.get("project_memories") or {}).items():
            if (text or "").strip():
                records.memories.append(Memory(f"memory-project:{project}", "user", text, "claude-web", project))
        for file in account.get("memory_files") or ():
            if (file.get("content") or "").strip():
                records.memories.append(Memory(f"memory-file:{file.get('path')}", "user", file["content"], "claude-web", created_at=file.get("updated_at")))
    return records


def claude_web_project(a: Artefact) -> Records:
    found = json.loads(a.text)
    records = Records()
    body = next((found[k] for k in ("description", "prompt_template", "name") if (found.get(k) or "").strip()), None)
    if body:
        records.memories.append(Memory(f"project-entity:{found.get('uuid')}", "project", body, "claude-web", found.get("name")))
    for doc in found.get("docs") or ():
        if (doc.get("content") or "").strip():
            records.memories.append(Memory(f"project-doc:{doc.get('uuid')}", "project", doc["content"], "claude-web", found.get("name"), doc.get("created_at")))
    return records


def claude_web_design(a: Artefact) -> Records:
    found = json.loads(a.text)
    records = Records()
    session = Session(found.get("uuid"), "claude-web", (found.get("project") or {}).get("name"), found.get("title"))
    before = None
    for message in found.get("messages") or ():
        role = message.get("role") or message.get("sender")
        text = message.get("text") or parts_text(message.get("content"))
        if role == "assistant" and before is not None and text.strip():
            session.turns.append(Turn(before[0], text, before[1], message.get("created_at"), message.get("uuid")))
        before = (text, message.get("created_at")) if role in ("user", "human") and text.strip() else None
    records.sessions.append(finish(session))
    return records


def _sqlite(a: Artefact, needed: dict[str, set[str]], run: Callable[[sqlite3.Connection, Records], None]) -> Records:
    """Open a database in memory, check that it has the columns, and read it."""
    records = Records()
    db = sqlite3.connect(":memory:")
    db.row_factory = sqlite3.Row
    try:
        db.deserialize(a.content)
        for name, columns in needed.items():
            have = {r["name"] for r in db.execute(f"PRAGMA table_info({name})")}
            if columns - have:
                records.drop(a.path, f"table {name} lacks {', '.join(sorted(columns - have))}")
                return records
        run(db, records)
    except sqlite3.DatabaseError as error:
        records.drop(a.path, f"no database: {error}")
    finally:
        db.close()
    return records


def _verdict(content: str) -> tuple[bool, str | None]:
    """Whether a tool's own words say that it failed: an error, its error flag, or an exit code that is not zero."""
    try:
        found = json.loads(content)
    except ValueError:
        return False, None
    if not isinstance(found, dict):
        return False, None
    if found.get("error"):
        return True, str(found["error"])[:PARAMS_BUDGET]
    code = found.get("exit_code")
    failed = bool(found.get("isError")) or isinstance(code, (int, float)) and not isinstance(code, bool) and code != 0
    return failed, content[:PARAMS_BUDGET] if failed else None


def hermes_database(a: Artefact) -> Records:
    """A user message opens a turn, the last answer with text closes it, tool results find their call."""

    def run(db: sqlite3.Connection, records: Records) -> None:
        for s in db.execute("SELECT * FROM sessions ORDER BY id"):
            session = Session(str(s["id"]), "hermes", a.project, title=s["title"] if "title" in s.keys() else None)
            calls: dict[str, dict] = {}
            for m in db.execute("SELECT * FROM messages WHERE session_id = ? ORDER BY id", (s["id"],)):
                named = "tool_name" in m.keys() and m["tool_name"]
                stamp, text = iso(m["timestamp"]), m["content"] or ""
                if m["role"] == "user":
                    session.turns.append(Turn(text, human_timestamp=stamp))
                elif session.turns and m["role"] == "assistant":
                    turn = session.turns[-1]
                    for call in json.loads(m["tool_calls"] or "[]"):
                        spec = call.get("function") or {}
                        calls[call.get("id")] = own = {"tool_name": spec.get("name"), "params": _clip(spec.get("arguments") or "", PARAMS_BUDGET), "had_error": False, "error_message": None}
                        turn.tools.append(own)
                    if text.strip():
                        turn.agent_text, turn.agent_timestamp = text, stamp
                elif m["role"] == "tool" and (call := calls.get(m["tool_call_id"]) or next((c for c in calls.values() if named and c["tool_name"] == m["tool_name"]), None)):
                    call.update(zip(("had_error", "error_message"), _verdict(text)))
            for turn in session.turns:
                turn.agent_text = turn.agent_text or ("[tool use]" if turn.tools else "[thinking only]")  # labels of answers without words
            records.sessions.append(finish(session))

    return _sqlite(a, {"sessions": {"id"}, "messages": {"id", "session_id", "role", "content", "timestamp", "tool_calls", "tool_call_id"}}, run)


def opencode_database(a: Artefact) -> Records:
    """Sessions of messages of parts; a session with a row that cannot be read is skipped whole."""

    def run(db: sqlite3.Connection, records: Records) -> None:
        for s in db.execute("SELECT * FROM session ORDER BY id"):
            session = Session(str(s["id"]), "opencode", basename(s["directory"]) if "directory" in s.keys() else a.project, s["title"] if "title" in s.keys() else None)
            try:
                for m in db.execute("SELECT id, data FROM message WHERE session_id = ? ORDER BY id", (s["id"],)):
                    data = json.loads(m["data"])
                    parts = [json.loads(p["data"]) for p in db.execute("SELECT data FROM part WHERE message_id = ? ORDER BY id", (m["id"],))]
                    text = "\n".join(p["text"] for p in parts if p.get("type") == "text" and p.get("text"))
                    stamp = iso((data.get("time") or {}).get("created"))
                    if data.get("role") == "user":
                        session.turns.append(Turn(text, human_timestamp=stamp, source_id=str(m["id"])))
                    elif session.turns:
                        turn = session.turns[-1]
                        turn.agent_text = "\n".join(t for t in (turn.agent_text, text) if t)
                        turn.agent_timestamp, turn.model, turn.provider = stamp, data.get("modelID"), data.get("providerID")
                        turn.thinking += [p["text"] for p in parts if p.get("type") == "reasoning" and p.get("text")]
                        for p in parts:
                            if p.get("type") == "tool":
                                state = p.get("state") or {}
                                if state.get("status") == "running":
                                    records.deferred.append(str(s["id"]))
                                turn.tools.append({"tool_name": p.get("tool"), "params": _clip(state.get("input") or {}, PARAMS_BUDGET), "had_error": state.get("status") == "error", "error_message": _clip(state["error"], ERROR_BUDGET) if state.get("error") else None})
            except (ValueError, KeyError, TypeError, AttributeError):
                records.drop(str(s["id"]), "a row cannot be read")
                continue
            records.sessions.append(finish(session))

    return _sqlite(a, {"session": {"id"}, "message": {"id", "session_id", "data"}, "part": {"message_id", "data"}}, run)


def cursor_database(a: Artefact) -> Records:
    """Composer documents name their bubbles in order; bubbles they do not name are left out."""

    def run(db: sqlite3.Connection, records: Records) -> None:
        rows = {r["key"]: r["value"] for r in db.execute("SELECT key, value FROM cursorDiskKV WHERE key LIKE 'composerData:%' OR key LIKE 'bubbleId:%'")}
        for key, value in sorted(rows.items()):
            if not key.startswith("composerData:"):
                continue
            composer = json.loads(value)
            own = composer.get("composerId") or key.split(":", 1)[1]
            session = Session(own, "cursor-ide", a.project, composer.get("name"), iso(composer.get("createdAt")), iso(composer.get("lastUpdatedAt")))
            for header in composer.get("fullConversationHeadersOnly") or ():
                raw = rows.get(f"bubbleId:{own}:{header.get('bubbleId')}")
                if raw is None:
                    records.drop(str(header.get("bubbleId")), "bubble is missing")
                    continue
                bubble = json.loads(raw)
                stamp = iso(bubble.get("createdAt")) if not isinstance(bubble.get("createdAt"), str) else bubble["createdAt"]
                if header.get("type") == 1:
                    session.turns.append(Turn(bubble.get("text") or "", human_timestamp=stamp, source_id=header.get("bubbleId")))
                elif session.turns:
                    turn = session.turns[-1]
                    turn.agent_text = "\n".join(t for t in (turn.agent_text, bubble.get("text") or "") if t)
                    turn.agent_timestamp, turn.model = stamp, (bubble.get("modelInfo") or {}).get("modelName") or turn.model
            if session.turns and not session.turns[-1].agent_text:
                last = session.turns.pop()
                (records.deferred.append(own) if composer.get("status") == "none" else records.drop(str(last.source_id), "question without an answer"))
            records.sessions.append(finish(session))

    return _sqlite(a, {"cursorDiskKV": {"key", "value"}}, run)


def cursor_store(a: Artefact) -> Records:
    """A store of JSON blobs by content hash: a list blob names its children, messages are the leaves in order."""

    def run(db: sqlite3.Connection, records: Records) -> None:
        blobs = {r["id"]: r["data"] for r in db.execute("SELECT id, data FROM blobs")}
        messages: list[dict] = []
        seen: set[str] = set()

        def varint(data: bytes, at: int) -> tuple[int, int]:
            value = shift = 0
            while at < len(data):
                value |= (data[at] & 127) << shift
                shift += 7
                at += 1
                if not data[at - 1] & 128:
                    return value, at
            raise ValueError("unended number")

        def children(data: bytes) -> list[str]:
            """Child hashes of a list blob: fields 1 of 32 bytes; a blob that is no message of fields has none."""
            out, at = [], 0
            try:
                while at < len(data):
                    key, at = varint(data, at)
                    wire = key & 7
                    if wire == 2:
                        size, at = varint(data, at)
                        if size > len(data) - at:
                            return []
                        if size == 32 and key >> 3 == 1:
                            out.append(data[at : at + 32].hex())
                        at += size
                    elif wire == 0:
                        _, at = varint(data, at)
                    elif wire in (1, 5):
                        at += 8 if wire == 1 else 4
                    else:
                        return []
            except ValueError:
                return []
            return out

        named = {c for d in blobs.values() for c in children(d if isinstance(d, bytes) else d.encode())}
        stack = sorted(set(blobs) - named, reverse=True)
        while stack:
            key = stack.pop()
            if key in seen or key not in blobs:
                continue
            seen.add(key)
            data = blobs[key] if isinstance(blobs[key], bytes) else blobs[key].encode()
            kids = children(data)
            if kids:
                stack.extend(reversed(list(dict.fromkeys(kids))))
                continue
            try:
                found = json.loads(data)
            except ValueError:
                records.drop(key, "blob cannot be read")
                continue
            if isinstance(found, dict) and found.get("role"):
                messages.append(found)
        session = Session(a.stem, "cursor-cli", a.project)
        for m in messages:
            text = parts_text(m.get("content"))
            if m["role"] == "user" and text:
                session.turns.append(Turn(text))
            elif m["role"] == "assistant" and session.turns:
                session.turns[-1].agent_text = "\n".join(t for t in (session.turns[-1].agent_text, text) if t)
        records.sessions.append(finish(session))

    return _sqlite(a, {"blobs": {"id", "data"}}, run)


def cursor_sidecar(a: Artefact) -> Records:
    found = json.loads(a.text)
    return Records([Session(a.path.rsplit("/", 2)[-2] if "/" in a.path else a.stem, "cursor-cli", basename(found.get("cwd")), found.get("title"), iso(found.get("createdAtMs")), iso(found.get("updatedAtMs")), {"snapshot": True})])


@dataclass(frozen=True)
class Kind:
    """A family of files: how it is told, how it is read, where its records go."""

    name: str
    detect: Callable[[str, bytes], bool]
    parse: Callable[[Artefact], Records]
    destination: str = "corpus"


def _first(content: bytes) -> dict:
    """The first JSON object of a file, without reading more than its first lines."""
    for line in content[:65_536].split(b"\n")[:5]:
        try:
            found = json.loads(line)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return {}


def _whole(content: bytes) -> object:
    try:
        return json.loads(content)
    except ValueError:
        return None


def _has(*keys: str) -> Callable[[str, bytes], bool]:
    return lambda path, content: path.endswith(".jsonl") and all(k in _first(content) for k in keys)


def _export(key: str, inner: str) -> Callable[[str, bytes], bool]:
    def run(path: str, content: bytes) -> bool:
        if not content[:64].lstrip().startswith(b"["):
            return False
        found = _whole(content)
        return isinstance(found, list) and bool(found) and isinstance(found[0], dict) and key in found[0] and inner in found[0]

    return run


def _object(*keys: str) -> Callable[[str, bytes], bool]:
    def run(path: str, content: bytes) -> bool:
        if not path.endswith(".json") or not content[:64].lstrip().startswith(b"{"):
            return False
        found = _whole(content)
        return isinstance(found, dict) and all(k in found for k in keys)

    return run


def _database(table: str) -> Callable[[str, bytes], bool]:
    return lambda path, content: content.startswith(b"SQLite format 3") and f"CREATE TABLE {table}".encode() in content[:262_144]


#: The families in the order in which a file is tried.
KINDS = (
    Kind("pi-session", lambda p, c: p.endswith(".jsonl") and _first(c).get("type") == "session" and "version" in _first(c), pi_session),
    Kind("codex-session", lambda p, c: p.endswith(".jsonl") and _first(c).get("type") == "session_meta", codex_rollout),
    Kind("cowork-audit", _has("_audit_timestamp", "session_id"), cowork_audit),
    Kind("grok-session", _has("method", "params"), grok_updates),
    Kind("codex-history", _has("session_id", "text", "ts"), codex_history),
    Kind("qwen-code-session", lambda p, c: p.endswith(".jsonl") and "sessionId" in _first(c) and ("parts" in (_first(c).get("message") or {}) or "systemPayload" in _first(c)), qwen_session),
    Kind("claude-session", lambda p, c: p.endswith(".jsonl") and _first(c).get("type") in ("user", "assistant", "summary"), claude_session),
    Kind("chatgpt-web-conversations", _export("mapping", "title"), chatgpt_export),
    Kind("claude-web-conversations", _export("chat_messages", "uuid"), claude_export),
    Kind("claude-web-memories", _export("account_uuid", "memory_files"), claude_web_memories, "store"),
    Kind("claude-web-design-chats", _object("messages", "uuid", "title"), claude_web_design),
    Kind("claude-web-projects", _object("docs", "uuid"), claude_web_project, "store"),
    Kind("grok-session-metadata", _object("info", "generated_title"), grok_metadata),
    Kind("cursor-sidecar", _object("schemaVersion", "createdAtMs"), cursor_sidecar),
    Kind("session-metadata", _object("sessionId", "title"), session_metadata),
    Kind("hermes-database", _database("messages"), hermes_database),
    Kind("opencode-database", _database("part"), opencode_database),
    Kind("cursor-database", _database("cursorDiskKV"), cursor_database),
    Kind("cursor-store", _database("blobs"), cursor_store),
    Kind("codex-memory-aggregate", lambda p, c: p.endswith(".md") and c.lstrip().startswith(b"## Thread `"), codex_aggregate, "store"),
    Kind("hermes-memory", lambda p, c: p.endswith("MEMORY.md") and "§".encode() in c, hermes_memory, "store"),
    Kind("glm-skill", lambda p, c: p.endswith("SKILL.md"), whole_file("user", "glm"), "store"),
    Kind("codex-file", lambda p, c: p.endswith("AGENTS.md"), whole_file("pattern", "codex"), "store"),
    Kind("claude-memory", lambda p, c: p.endswith(".md"), markdown_memory, "store"),
)


def kind_of(path: str, content: bytes) -> Kind | None:
    return next((k for k in KINDS if k.detect(path, content)), None)


def conforms(kind: Kind, records: Records) -> bool:
    """Whether a parser made only what its family declares: sessions for the corpus, notes for the store."""
    return not records.memories if kind.destination == "corpus" else not records.sessions
