"""Which databases speak to a question, and which search method answers it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from threadloom.functions.text import fold_text

# What a declared question, a shared word and the database's own name count.
PHRASE, WORD, NAME = 1_000, 10, 30
#: Letters of the shortest word that counts.
SHORTEST = 3
METHODS = ("fts", "like")


@dataclass
class Description:
    """What a database says of itself: texts of its tables, and questions that it declares to answer."""

    name: str
    text: str = ""
    tables: list[tuple[str, str]] = field(default_factory=list)
    questions: list[str] = field(default_factory=list)


def _words(text: str) -> set[str]:
    return {w for w in fold_text(text).split() if len(w) >= SHORTEST}


def relevance(question: str, database: Description) -> int:
    """Declared phrases within the question, words it shares with the description, and the database's name; 0 without words."""
    asked, wanted = " ".join(fold_text(question).split()), _words(question)
    if not wanted:
        return 0
    phrases = (" ".join(fold_text(q).split()) for q in database.questions)
    shared = _words(" ".join([database.name, database.text, *(x for pair in database.tables for x in pair)])) & wanted
    return PHRASE * sum(bool(p) and p in asked for p in phrases) + WORD * len(shared) + NAME * (fold_text(database.name).strip() in wanted)


def relevant(question: str, databases: Iterable[Description]) -> list[str]:
    """Names of the databases that speak to a question, best first, ties by name. None is cut off."""
    scored = [(relevance(question, d), d.name) for d in databases]
    return [name for score, name in sorted(scored, key=lambda x: (-x[0], x[1])) if score > 0]


def choose_method(asked: str | None, indexed: bool) -> tuple[str, list[str]]:
    """The method that runs and why it is not the one asked for. An unknown method is refused, not answered under its name."""
    method = asked or "fts"
    if method not in METHODS:
        raise ValueError(f"there is no search method {method}: it is {' or '.join(METHODS)}")
    if method == "fts" and not indexed:
        return "like", ["fts became like: the database has no index of words"]
    return method, []


def declared_sql(parts: list[tuple[str, str, str]], words: list[str], method: str, limit: int) -> str:
    """One statement that gives the rows of a merged answer again: ``parts`` are (database, table, text column)."""
    quoted = lambda w: w.replace("'", "''")
    out = []
    for database, table, column in parts:
        hit = " OR ".join(f"{column} LIKE '%{quoted(w)}%'" for w in words) if method == "like" else f"{table}_fts MATCH '{' OR '.join(quoted(w) for w in words)}'"
        source = f"{database}.{table}" if method == "like" else f"{database}.{table}_fts"
        out.append(f"SELECT '{database}' AS database, '{table}' AS source, id, {column} AS text FROM {source} WHERE {hit}")
    return f"{' UNION ALL '.join(out)} ORDER BY database, source, id LIMIT {limit}" if out else ""
