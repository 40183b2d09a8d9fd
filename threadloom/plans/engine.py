"""Queries over one or many databases: gated SQL, questions, profiles of results, unions across origins."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.json_edit import register
from threadloom.functions.text import TEXT_BUDGET, search_term, term_words
from threadloom.operators.profile import terrain
from threadloom.operators.search import rescue
from threadloom.plans.gate import ROW_CAP, GateError, admit, is_bare_count
from threadloom.plans.question import check_question, missing_referent
from threadloom.plans.repair import repair
from threadloom.plans.routing import declared_sql

#: Seconds a statement may run; 0 turns the bound off.
TIME_BOUND = 5.0
#: Databases that a query reads when it names none.
DEFAULT_SCOPE = ("corpus", "core")
#: Databases beside the archive's own that may be attached at once.
MOST_ATTACHED = 10
#: Rows of a recursive statement after which Spark ends it by an error; its own 1,000,000 are fewer than large archives need.
RECURSION_ROWS = "spark.sql.cteRecursionRowLimit"


@dataclass
class Answer:
    """Rows of a statement with how they came about."""

    rows: list[dict]
    columns: list[str]
    sql: str
    path: str = "sql"
    notes: list[str] = field(default_factory=list)
    seconds: float = 0.0


class Engine:
    """Databases are sets of named DataFrames; the core database is also visible without its prefix."""

    def __init__(self, spark: SparkSession, databases: dict[str, dict[str, DataFrame]], main: str = "core", bare_names: bool = True) -> None:
        """With ``bare_names`` off only qualified names are visible, so no name shadows another's table."""
        self.spark, self.databases, self.main, self.bare_names = spark, databases, main, bare_names
        register(spark)

    def attach(self, name: str, tables: dict[str, DataFrame], manifest: dict[str, list[str]]) -> None:
        """One more database, if its tables have the columns that its manifest declares and the limit is not reached.

        ``manifest`` is table to columns; tables that it does not declare are not visible. A name in use is refused.
        """
        if name in self.databases or not re.fullmatch(r"[A-Za-z_]\w*", name):
            raise GateError(f"{name} cannot be the name of another database")
        if len(self.databases.keys() - {self.main, *DEFAULT_SCOPE}) >= MOST_ATTACHED:
            raise GateError(f"at most {MOST_ATTACHED} databases are attached")
        for table, columns in manifest.items():
            missing = sorted(set(columns) - set(tables[table].columns)) if table in tables else ["the table itself"]
            if missing:
                raise GateError(f"{name}.{table} lacks {', '.join(missing)}")
        self.databases[name] = {t: tables[t] for t in manifest}

    # -- scope ----------------------------------------------------------------------------------------

    def scope(self, wanted: Iterable[str] | str | None = None) -> list[str]:
        """Names of the databases of a query: the default ones, a list, or ``all``. Unknown names are refused."""
        if wanted is None:
            return [d for d in DEFAULT_SCOPE if d in self.databases] or [self.main]
        if wanted == "all":
            return sorted(self.databases)
        names = [wanted] if isinstance(wanted, str) else list(wanted)
        unknown = [n for n in names if n not in self.databases]
        if unknown:
            raise GateError(f"no such database: {', '.join(unknown)}")
        return names

    def visible(self, scope: list[str]) -> dict[str, tuple[str, str]]:
        """Visible table name to (database, table)."""
        found = {f"{d}.{t}": (d, t) for d in scope for t in self.databases[d]}
        if self.bare_names and self.main in scope:
            found |= {t: (self.main, t) for t in self.databases[self.main]}
        return found

    # -- statements -----------------------------------------------------------------------------------

    def sql(self, statement: str, scope: Iterable[str] | str | None = None, cap: int | None = None) -> DataFrame:
        """The result of an admitted statement as a DataFrame. A negative ``cap`` lifts the row cap, for results that stay distributed."""
        chosen = self.scope(scope)
        visible = self.visible(chosen)
        said, used = admit(self.spark, statement, visible, cap or ROW_CAP)
        self.spark.conf.set(RECURSION_ROWS, "-1")  # read when the frame is run, so it stays; time and levels stay bounded
        for name in used:
            database, tab = visible[name]
            view = f"threadloom_{database}_{tab}"
            self.databases[database][tab].createOrReplaceTempView(view)
        return self.spark.sql(_rename(said, {n: f"threadloom_{d}_{t}" for n, (d, t) in visible.items() if n in used}))

    def exec(self, statement: str, scope: Iterable[str] | str | None = None, budget: int = TEXT_BUDGET, bound: float = TIME_BOUND) -> Answer:
        """Run a statement within the time bound and clip long texts of its rows."""
        frame = self.sql(statement, scope)
        began = time.monotonic()
        rows = self._bounded(frame, bound)
        notes = ["a bare count says how many rows there are, not what they hold"] if is_bare_count(statement) else []
        clipped = [{k: v[:budget] if isinstance(v, str) and budget else v for k, v in r.asDict().items()} for r in rows]
        used = sorted({d for n, (d, _) in self.visible(self.scope(scope)).items() if n in statement.lower()} or {self.main})
        return Answer([r | {"database": "+".join(used)} if "database" not in r else r for r in clipped], [*frame.columns, *([] if "database" in frame.columns else ["database"])], statement, notes=notes, seconds=time.monotonic() - began)

    def _bounded(self, frame: DataFrame, bound: float) -> list:
        if not bound:
            return frame.collect()
        sc, group = self.spark.sparkContext, f"threadloom-{uuid.uuid4()}"
        sc.setJobGroup(group, "bounded statement", interruptOnCancel=True)
        timer = threading.Timer(bound, lambda: sc.cancelJobGroup(group))
        timer.start()
        try:
            return frame.collect()
        except Exception as error:
            if not timer.is_alive():
                raise GateError(f"the statement took more than {bound:g} seconds") from error
            raise
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    # -- questions ------------------------------------------------------------------------------------

    def query(self, question: str, provider: Callable[[str], str] | None = None, scope: Iterable[str] | str | None = None, attempts: int = 2, bound: float = TIME_BOUND) -> Answer:
        """Answer a question with SQL of ``provider`` (repaired, gated, once corrected), else by keyword search.

        Without a provider the keyword search answers at once. A scope without hits is widened to all databases.
        """
        check_question(question)
        if slot := missing_referent(question):
            return Answer([], [], "", path="ask", notes=[f"Which {slot} should I use? Please name it in the question."])
        chosen = self.scope(scope)
        notes: list[str] = []
        prompt = self.prompt(question, chosen)
        for _ in range(attempts if provider else 0):
            statement, said = repair(provider(prompt))
            notes += said
            try:
                answer = self.exec(statement, chosen, bound=bound)
            except GateError as error:
                if "took more than" in str(error):
                    notes.append(str(error))
                    break
                notes.append(f"refused: {error}")
                prompt = f"{prompt}\nThe statement was refused: {error}. Write another one."
                continue
            if answer.rows:
                answer.path, answer.notes = "model", notes + answer.notes
                return answer
            break
        words = term_words(question)
        for names in (chosen, sorted(self.databases)):
            found = [self._rescue(d, question) for d in names if self._searchable(d)]
            rows = [r for part in found for r in part]
            if rows:
                parts = [(d, t, c) for d in names if self._searchable(d) for t, c in (("memories", "content"), ("exchanges", "human_text"), ("exchanges", "agent_text")) if t in self.databases[d]]
                return Answer(rows, list(rows[0]), declared_sql(parts, words, "like", 1_000), path="keyword", notes=[*notes, f"keyword search for {search_term(question)}"])
            if names == sorted(self.databases):
                break
            notes.append("nothing found in the chosen databases, all were searched")
        return Answer([], [], "", path="unresolved", notes=notes)

    def _searchable(self, database: str) -> bool:
        return "memories" in self.databases[database] or "exchanges" in self.databases[database]

    def _rescue(self, database: str, question: str) -> list[dict]:
        rows = rescue(self.databases[database], term_words(question)).limit(20).collect()
        return [r.asDict() | {"database": database} for r in rows]

    def explore(self, question: str, scope: Iterable[str] | str | None = None) -> dict:
        """Keyword hits of a question with their terrain: sources, months, terms and what is absent."""
        check_question(question)
        hits = [rescue(self.databases[d], term_words(question)).withColumn("database", F.lit(d)) for d in self.scope(scope) if self._searchable(d)]
        if not hits:
            raise GateError("none of the chosen databases holds texts")
        whole = hits[0]
        for other in hits[1:]:
            whole = whole.unionByName(other)
        return {part: [r.asDict() for r in frame.collect()] for part, frame in terrain(whole, term_words(question)).items()}

    # -- across origins -------------------------------------------------------------------------------

    def cross(self, statement: str, origins: Iterable[str]) -> DataFrame:
        """The same statement on several databases, stacked by column name with an ``origin`` column."""
        out = None
        for name in self.scope(list(origins)):
            part = Engine(self.spark, {name: self.databases[name]}, main=name).sql(statement, [name])
            out = _stack(out, part, name)
        if out is None:
            raise GateError("no origin was named")
        return out

    def prompt(self, question: str, scope: list[str] | None = None) -> str:
        """Tables, columns and search tables of a scope as text for a model that writes SQL."""
        lines = []
        for name, (database, tab) in sorted(self.visible(self.scope(scope)).items()):
            columns = ", ".join(f"{c} {t}" for c, t in self.databases[database][tab].dtypes)
            lines.append(f"{name}({columns})" + (" -- search with MATCH" if tab.endswith("_fts") else ""))
        return "\n".join([*lines, f"Question: {question}"])


def _stack(whole: DataFrame | None, part: DataFrame, origin: str) -> DataFrame:
    lower = [c.lower() for c in part.columns]
    if "origin" in lower or len(set(lower)) < len(lower):
        raise GateError("a result column is named twice or named origin")
    part = part.withColumn("origin", F.lit(origin))
    return part if whole is None else whole.unionByName(part, allowMissingColumns=True)


def _rename(sql: str, names: dict[str, str]) -> str:
    """The statement over its views: relation names after FROM, JOIN and commas are replaced, columns keep theirs."""
    from threadloom.plans.scanner import scan, text_of

    tokens = scan(sql)
    solid = [i for i, t in enumerate(tokens) if t.kind not in ("space", "comment")]
    out = list(tokens)
    expecting, depth_from = False, []
    depth = 0
    for place, i in enumerate(solid):
        t = tokens[i]
        if t.kind == "op" and t.text == "(":
            depth += 1
        elif t.kind == "op" and t.text == ")":
            depth -= 1
            depth_from = [d for d in depth_from if d <= depth]
        if t.is_word("FROM", "JOIN"):
            expecting = True
            if t.is_word("FROM"):
                depth_from.append(depth)
            continue
        if t.is_word("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "ON", "UNION", "SELECT", "INTERSECT", "EXCEPT"):
            depth_from = [d for d in depth_from if d != depth]
        if t.text == "," and depth in depth_from:
            expecting = True
            continue
        if expecting and t.kind in ("word", "name"):
            bare = t.text.strip("`").lower()
            ahead = [tokens[j] for j in solid[place + 1 : place + 3]]
            if len(ahead) == 2 and ahead[0].text == "." and f"{bare}.{ahead[1].text.strip('`').lower()}" in names:
                full = f"{bare}.{ahead[1].text.strip('`').lower()}"
                last = solid[place + 2]
                alias = _alias(tokens, solid, place + 3, ahead[1].text)
                out[i] = type(t)("op", names[full] + alias)
                for j in range(i + 1, last + 1):
                    out[j] = type(t)("space", "")
            elif bare in names:
                out[i] = type(t)("op", names[bare] + _alias(tokens, solid, place + 1, t.text))
        expecting = False
    return text_of(out)


def _alias(tokens: list, solid: list[int], place: int, name: str) -> str:
    """`` AS name`` unless the statement gives its own alias, so qualified columns still resolve."""
    following = tokens[solid[place]] if place < len(solid) else None
    stops = ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "ON", "UNION", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "USING", "INTERSECT", "EXCEPT", "OFFSET", "WINDOW", "SEMI", "ANTI")
    if following is not None and (following.is_word("AS") or (following.kind in ("word", "name") and not following.is_word(*stops))):
        return ""
    return f" AS {name}"
