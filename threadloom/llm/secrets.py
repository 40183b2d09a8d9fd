"""Credentials embedded in source code and configuration: find, report, redact.

Token formats, key armour, connection strings and naming cues are anchors of one deterministic
automaton (``automaton.Automaton``). At each anchor the grammar of its kind states the exact span in
the whole text, so a span may leave the chunk in which its anchor was seen. Overlapping spans are
settled by kind, and placeholders are spliced in from the back.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.automaton import Automaton
from threadloom.llm.spans import disjoint, splice

# Literal starts of issued tokens, each with the grammar of the whole token.
FORMATS = {
    "sk-": r"sk-[A-Za-z0-9_\-]{20,}",
    "akia": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "asia": r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "aiza": r"AIza[0-9A-Za-z_\-]{35}",
    "xox": r"xox[abeoprs]-[0-9A-Za-z\-]{10,}",
    "ghp_": r"ghp_[A-Za-z0-9]{20,}",
    "gho_": r"gho_[A-Za-z0-9]{20,}",
    "ghu_": r"ghu_[A-Za-z0-9]{20,}",
    "ghs_": r"ghs_[A-Za-z0-9]{20,}",
    "ghr_": r"ghr_[A-Za-z0-9]{20,}",
    "github_pat_": r"github_pat_[A-Za-z0-9_]{20,}",
    "glpat-": r"glpat-[A-Za-z0-9_\-]{16,}",
    "npm_": r"npm_[A-Za-z0-9]{30,}",
    "pypi-": r"pypi-[A-Za-z0-9_\-]{30,}",
    "_live_": r"[a-z]{2,5}_live_[A-Za-z0-9]{16,}",
    "hf_": r"hf_[A-Za-z0-9]{30,}",
    "dop_v1_": r"dop_v1_[a-f0-9]{64}",
    "sg.": r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}",
    "glsa_": r"glsa_[A-Za-z0-9]{20,}_[A-Fa-f0-9]{8}",
    "dckr_pat_": r"dckr_pat_[A-Za-z0-9_\-]{20,}",
    "xapp-": r"xapp-\d-[A-Za-z0-9\-]{20,}",
    "shpat_": r"shpat_[a-fA-F0-9]{32}",
    "nvapi-": r"nvapi-[A-Za-z0-9_\-]{40,}",
    "eyj": r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
}
# Words that name a secret when they end the name before a separator.
CUES = ["password", "passwd", "pwd", "passphrase", "token", "secret", "secret_key", "secret-key", "secretkey", "api_key", "apikey", "api-key", "access_key", "access-key", "accesskey", "access_key_id", "accesskeyid", "private_key", "auth_key", "credential", "_key", "-key", "accountkey", "sharedaccesskey"]
# Anchors of other grammars.
OTHERS = ["key", "-----begin ", "://", "bearer ", "basic ", "`token ", " -u ", " -p ", "sudo -s", "auth=(", 'variable "', "// password", "// token", "// secret", "# password", "with password ", "identified by "]

_BEFORE = r"(?<![A-Za-z0-9_])"
# Every value runs to its own end, whatever its length: the classes exclude what ends it, and nothing is tried twice.
_QUOTED = r"(?:\"([^\"\n]*+)\"|'([^'\n]*+)'|`([^`\n]*+)`)"
# The first character of a bare value: where its run ends is looked up, since many values may lie in one run.
_BARE = r"([^\s\"'`\\,;&<>(){}\[\]|])"
_RUN = re.compile(r"[^\s\"'`\\,;&<>(){}\[\]|]++")
_ASSIGN = re.compile(r">([^<>\n]*+)</|[\"']?\s*(?:=>|:=|==?|:(?!:))\s*(?:" + _QUOTED + r"|\\\"([^\"\\\n]*+)\\\"|" + _BARE + ")")
_SPACED = re.compile(r"[ \t]+(?:" + _QUOTED + "|" + _BARE + ")")
_BEARER = re.compile(r"[ \t]*" + _BARE)
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY( BLOCK)?-----")
_ARMOUR_END = re.compile(r"(?=(-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----))")
_LOGIN_URL = re.compile(r"://[^\s/:@\"'<>]*+:")
_LOGIN = re.compile(r"[^\s@\"'<>\\]*+")
_TOKEN_URL = re.compile(r"://([^\s/:@\"'<>]{16,}+)@")
_USER = re.compile(r" -u [\"']?([^\s:\"']+):([^\s\"'|]+)")
_PLAIN = re.compile(r" -p (?:" + _QUOTED + r"|([^\s\"'`|]++))")
_LOGS_IN = re.compile(r"login|sshpass|mysql|passw")
_AUTH = re.compile(r"auth=\(\s*[\"'][^\"'\n]*+[\"']\s*,\s*" + _QUOTED)
_VARIABLE = re.compile(r"variable \"([^\"\n]*+)\"\s*\{([^{}]*+)", re.I)
_DEFAULT = re.compile(r"default\s*=\s*\"([^\"\n]*+)\"", re.I)
_ECHOED = re.compile(r"echo\s+(?:-n\s+)?[\"']?([^\s\"'|]+)[\"']?\s*\|\s*")

# What no credential begins with or is as a whole, and what none holds or ends with.
_REFERS = re.compile(
    r"(?:\$|<|\{|\[|%\(|env[:.]|-----BEGIN|process\.env|os\.environ)|(.)\1*$|(?:sk-|ghp_|xox[a-z]-)?([xX*.\-#0])\2{5,}"
    r"|YOUR[_-]|v?\d+(?:[.\-:/]\d+)*%?$|https?:|(?:sha\d+|md5)[-:]",
    re.I,
)
_MASKED = re.compile(r"(?=redacted|changeme|placeholder|masked|dummy|[_-]HERE$)", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_SNAKE = re.compile(r"[A-Za-z]+(?:_[A-Za-z]+)+")
# Symbols that no name, path or reference has between its letters; the words inside camel case; letters in which no language's words run on.
_SYMBOLS = re.compile(r"(?=[^\W_][!%^&*?#$|]+[^\W_])")
_HUMP = re.compile(r"[A-ZÀ-Þ]?[a-zß-ÿ]+|[A-ZÀ-Þ]+(?![a-zß-ÿ])")
_CLUSTER = re.compile(r"sch|tch|cht|ch|ck|ph|th|sh|st|ng|([^\W\d_aeiouy])\1", re.I)
_UNSPEAKABLE = re.compile(r"[^\W\d_aeiouyà-ÿ]{5}", re.I)
_VOWEL = re.compile(r"[aeiouyà-ÿ]", re.I)
# Abbreviations without a vowel that stand in camel case.
_SHORT = frozenset("db js ts tx fn sh pwd str cfg ctx tmp src http https html css sql ssh ssl tls jwt tcp png cmd msg srv svc mgr ptr dns xml pdf gcp vpc rds cdn npm hmac pg pk kb mb ms ws rpc grpc s3 k8s".split())
_MIXED = re.compile(r"(?=[A-Za-z0-9+/_\-]{20,}+={0,2}\Z)(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])(?=\D*+\d)[A-Za-z0-9+/_\-]{20,}+={0,2}")
_FORMAT = {k: re.compile(_BEFORE + v) for k, v in FORMATS.items()}
_ANCHORS = [*FORMATS, *CUES, *OTHERS]
_MACHINE: list[Automaton] = []


def _wordy(run: str) -> bool:
    """Whether a run of letters is a word or camel case of words, not letters drawn at random."""
    humps = _HUMP.findall(run)
    if len(humps) > 1 and (len(run) < 3 * len(humps) or any(len(h) > 1 and not _VOWEL.search(h) and h.lower() not in _SHORT for h in humps)):
        return False
    return not any(_UNSPEAKABLE.search(_CLUSTER.sub("k", h)) for h in humps if not (h.isupper() and len(h) <= 5))


class _Tails:
    """Judges the values that end where ``value`` ends; what they have in common is found once for all of them."""

    def __init__(self, value: str) -> None:
        self.value = value
        self.masked = self._last(_MASKED)
        self.digit = next((i for i in range(len(value) - 1, -1, -1) if value[i].isdecimal()), -1)
        self.slashes = [i for i, c in enumerate(value) if c == "/"] if "/" in value else []

    def _last(self, pattern: re.Pattern) -> int:
        return max((m.start() for m in pattern.finditer(self.value)), default=-1)

    @cached_property
    def _runs(self) -> tuple[list[int], ...]:
        """Begins and ends of the runs of letters, and sums before each: letters, runs that are no words, runs of two letters or more."""
        runs = [m.span() for m in _LETTERS.finditer(self.value)]
        return (
            [a for a, _ in runs], [b for _, b in runs], [0, *accumulate(b - a for a, b in runs)],
            [0, *accumulate(not _wordy(self.value[a:b]) for a, b in runs)], [0, *accumulate(b - a > 1 for a, b in runs)],
        )

    @cached_property
    def _symbol(self) -> tuple[int, int]:
        return self._last(_SYMBOLS), self.value.rfind(" ")

    @cached_property
    def _alnum(self) -> int:
        """From where on all characters are letters and digits."""
        return next((i + 1 for i in range(len(self.value) - 1, -1, -1) if not self.value[i].isalnum()), 0)

    def _letters(self, start: int, end: int) -> tuple[int, int, int]:
        """Letters, runs that are no words and runs of two letters or more from ``start`` to ``end``, which is no place inside a run."""
        begins, ends, *sums = self._runs
        i, j = bisect_left(begins, start), bisect_left(begins, end)
        letters, odd, longer = (s[j] - s[i] for s in sums)
        if i and ends[i - 1] > start:  # the rest of a run
            rest = self.value[start : ends[i - 1]]
            letters, odd, longer = letters + len(rest), odd + (not _wordy(rest)), longer + (len(rest) > 1)
        return letters, odd, longer

    def _named(self, start: int, end: int) -> int:
        """The length of a part of a path if it is made of words."""
        letters, odd, longer = self._letters(start, end)
        return end - start if longer and not odd and 2 * letters >= end - start else 0

    @cached_property
    def _paths(self) -> list[tuple[int, int]]:
        """For each slash the named and all characters of the parts after it."""
        sums, end = [(0, 0)], len(self.value)
        for at in reversed(self.slashes):
            sums.append((sums[-1][0] + self._named(at + 1, end), sums[-1][1] + end - at - 1))
            end = at
        return sums[:0:-1]

    def _path(self, start: int) -> bool:
        """Whether the value is a file path: most of it lies in parts made of words."""
        k = bisect_left(self.slashes, start)
        named, whole = self._paths[k]
        return 5 * (named + self._named(start, self.slashes[k])) >= 3 * (whole + self.slashes[k] - start)

    def _random(self, start: int) -> bool:
        """Whether the value, digits apart, looks drawn: odd symbols between letters, case that changes inside words, or unspeakable letters."""
        if self._letters(start, len(self.value))[1]:
            return True
        symbol, blank = self._symbol
        return blank < start <= symbol

    def live(self, start: int) -> bool:
        """Whether the value from ``start`` on looks like a real credential: no reference, mask, path, name, number or prose word."""
        value, size = self.value, len(self.value) - start
        if size < 6 or self.masked >= start or _REFERS.match(value, start):
            return False
        if len(self.slashes) - bisect_left(self.slashes, start) > 1 and self._path(start) or _SNAKE.fullmatch(value, start) and not self._random(start):
            return False
        return self.digit >= start or self._random(start) or (size >= 24 and self._alnum <= start and value[start:].lower() != value[start:] != value[start:].upper())


def live(value: str | None) -> bool:
    """Whether a value looks like a real credential; see ``_Tails.live``."""
    return bool(value) and _Tails(value).live(0)


class _Text:
    """One text with what several anchors ask of it, each found once: a run of many values is read once, not from each anchor."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.logs_in: dict[int, int] = {}
        self._reach: dict[re.Pattern, tuple[int, int]] = {}
        self._tails: dict[re.Pattern, tuple[int, int, _Tails]] = {}
        self._echo: tuple[int, int, int, re.Match | None] = (-1, 0, -1, None)

    @cached_property
    def _lines(self) -> list[int]:
        return [0, *(m.end() for m in re.finditer("\n", self.text))]

    def line(self, at: int) -> int:
        """Where the line of a place begins."""
        return self._lines[bisect_right(self._lines, at) - 1]

    @cached_property
    def _armour_ends(self) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        for m in _ARMOUR_END.finditer(self.text):
            found.setdefault(m.group(1), []).append(m.end(1))
        return found

    def armour_end(self, stop: str, start: int) -> int:
        """The end of the first ``stop`` from ``start`` on, else of the text."""
        ends = self._armour_ends.get(stop, [])
        at = bisect_left(ends, start + len(stop))
        return ends[at] if at < len(ends) else len(self.text)

    def run_end(self, run: re.Pattern, start: int) -> int:
        """Where the run that holds ``start`` ends."""
        low, high = self._reach.get(run, (0, 0))
        if not low <= start < high:
            self._reach[run] = low, high = start, run.match(self.text, start).end()
        return high

    def live(self, start: int, end: int, run: re.Pattern) -> bool:
        """Whether the value, which runs to the end of its ``run``, is live."""
        low, high, tails = self._tails.get(run, (0, -1, None))
        if tails is None or high != end or start < low:
            low, tails = start, _Tails(self.text[start:end])
            self._tails[run] = low, end, tails
        return tails.live(start - low)

    def echoed(self, line: int, start: int) -> re.Match | None:
        """The last ``echo`` of the line before ``start`` if it is piped into what begins there."""
        held, upto, at, m = self._echo
        if held != line:
            upto, at, m = line, -1, None
        found = self.text.rfind("echo", max(line, upto - 3), start)
        if found > at:
            at, m = found, _ECHOED.match(self.text, found)
        self._echo = line, start, at, m
        return m if m and m.end() == start else None


def _pick(m: re.Match) -> tuple[int, int] | None:
    """The one group that took part."""
    return next((m.span(g) for g in range(1, m.re.groups + 1) if m.start(g) >= 0), None)


def _spanned(held: _Text, m: re.Match, bare: int) -> tuple[int, int, bool] | None:
    """The span that a match names. That of the group ``bare`` goes to the end of its run, and is none where a call or an index follows."""
    if not bare or m.start(bare) < 0:
        span = _pick(m)
        return (*span, False) if span else None
    end = held.run_end(_RUN, m.start(bare))
    return None if held.text[end : end + 1] in ("(", "[") else (m.start(bare), end, True)


def _quoted_last(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The quoted value that ends the line before ``end``, closing brackets and stops apart."""
    stop = end
    while stop > start and (text[stop - 1] in ";,)" or text[stop - 1].isspace()):
        stop -= 1
    quote = text[stop - 1 : stop]
    opened = text.rfind(quote, start, stop - 1) if quote and quote in "\"'`" else -1
    return (opened + 1, stop - 1) if opened >= 0 else None


def _word_before(text: str, line: int, at: int) -> tuple[int, int]:
    """The span of the last word of the line before ``at``, empty where there is none."""
    while at > line and text[at - 1].isspace():
        at -= 1
    end = at
    while at > line and not text[at - 1].isspace():
        at -= 1
    return at, end


def _takes_value_after_blank(text: str, line: int, start: int, anchor: str) -> bool:
    """Whether the value may follow without a separator: netrc lines, ENV instructions, listed key ids."""
    if anchor in ("access_key", "access-key") or text.endswith("ENV ", line, start):
        return True
    a, b = _word_before(text, line, start)
    before = text[slice(*_word_before(text, line, a))]
    return before.endswith("login") or before == "ENV" and text[a:b].replace("_", "").isalnum()


def _value(held: _Text, line: int, start: int, end: int, anchor: str) -> tuple[int, int, bool] | None:
    """The span of the value that the grammar of a cue names, live or not, and whether it is a bare one."""
    text, bare = held.text, 0
    if anchor == "key":  # the end of a name in camel case, which may also name plain ids: only a long mixed value counts
        m = _ASSIGN.match(text, end) if text[start] == "K" and text[start - 1 : start].islower() else None
        span = _spanned(held, m, m.re.groups) if m else None
        return span if span and _MIXED.fullmatch(text, *span[:2]) else None
    if anchor in ("bearer ", "basic ", "`token "):
        m = _BEARER.match(text, end)
        return (m.start(1), held.run_end(_RUN, m.start(1)), True) if m else None
    elif anchor == " -u ":
        m = _USER.match(text, start)
        return (*m.span(2), False) if m else None
    elif anchor == " -p ":
        if line not in held.logs_in:  # the first such word of the line, looked for once
            stop = text.find("\n", line)
            found = _LOGS_IN.search(text, line, stop if stop >= 0 else len(text))
            held.logs_in[line] = found.end() if found else len(text) + 1
        m = _PLAIN.match(text, start) if held.logs_in[line] <= start else None
    elif anchor == "sudo -s":
        m = held.echoed(line, start)
    elif anchor == "auth=(":
        m = _AUTH.match(text, start)
    elif anchor == 'variable "':
        m = _VARIABLE.match(text, start)
        named = m and any(w in m.group(1).lower() for w in ("secret", "token", "password", "key"))
        m = _DEFAULT.search(text, *m.span(2)) if named else None
    elif anchor in ("// password", "// token", "// secret", "# password"):
        span = _quoted_last(text, line, start)
        return (*span, False) if span else None
    elif anchor in ("with password ", "identified by "):
        m = _SPACED.match(text, end - 1)
        bare = m.re.groups if m else 0
    else:
        m = _ASSIGN.match(text, end)
        if span := _spanned(held, m, m.re.groups) if m else None:
            return span
        m = _SPACED.match(text, end)
        if m and not _takes_value_after_blank(text, line, start, anchor):
            m = None
        bare = m.re.groups if m else 0
    return _spanned(held, m, bare) if m else None


def _at(held: _Text, end: int, anchor: str) -> Iterator[tuple[int, int, int]]:
    """Spans (rank, start, end) of credentials that the grammar of the anchor ending at ``end`` finds."""
    text, start = held.text, end - len(anchor)
    if anchor in FORMATS:
        at = start
        if anchor == "_live_":
            while at > 0 and text[at - 1].islower() and start - at < 5:
                at -= 1
        m = _FORMAT[anchor].match(text, at)
        if m and not (_REFERS.match(m.group()) or _MASKED.search(m.group())):
            yield 1, m.start(), m.end()
    elif anchor == "-----begin ":
        m = _ARMOUR.match(text, start)
        if m:
            yield 0, start, held.armour_end(f"-----END {m.group(1)}PRIVATE KEY{m.group(2) or ''}-----", m.end())
    elif anchor == "://":
        m = _LOGIN_URL.match(text, start)
        stop = held.run_end(_LOGIN, m.end()) if m else len(text)
        if text[stop : stop + 1] == "@":
            if held.live(m.end(), stop, _LOGIN):
                yield 2, m.end(), stop
        elif (m := _TOKEN_URL.match(text, start)) and live(m.group(1)):
            yield 2, *m.span(1)
    elif span := _value(held, held.line(start), start, end, anchor):
        if held.live(*span[:2], _RUN) if span[2] else live(text[span[0] : span[1]]):
            yield 3, *span[:2]


def _spans(text: str, events: list[tuple[int, int]]) -> set[tuple[int, int, int]]:
    held = _Text(text)
    return {span for end, pattern in events for span in _at(held, end, _ANCHORS[pattern])}


def find_secrets(texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """For each text the disjoint spans of its credentials, in order; null, empty and clean texts have none."""
    if not _MACHINE:
        _MACHINE.append(Automaton(_ANCHORS))
    out = []
    for text, events in zip(texts, _MACHINE[0].scan(texts)):
        spans = sorted(_spans(text, events) if events else (), key=lambda s: (s[0], s[1] - s[2], s[1]))
        out.append(disjoint((a, b) for _, a, b in spans))
    return out


def secret_spans(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(row_id, secret_text)``, one row for each distinct credential of a text. Null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["t"].tolist()
            rows = {(k, texts[i][a:b]) for i, (k, spans) in enumerate(zip(batch["k"].tolist(), find_secrets(texts))) for a, b in spans}
            yield pd.DataFrame(sorted(rows), columns=["row_id", "secret_text"])

    return df.select(F.col(key).alias("k"), F.col(column).alias("t")).filter("t IS NOT NULL").mapInPandas(run, "row_id bigint, secret_text string")


def redact(df: DataFrame, column: str, into: str, placeholder: str = "[CREDENTIAL]") -> DataFrame:
    """``df`` with ``into``: the text with each credential replaced, all other characters as they were. Null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        out = [text if not spans else splice(text, [(a, b, placeholder) for a, b in spans]) for text, spans in zip(values, find_secrets(values))]
        return pd.Series(out, dtype=object)

    return df.withColumn(into, run(F.col(column)))
