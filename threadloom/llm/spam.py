"""Pages of repeated key phrases, bare links or product tags instead of sentences.

The repeated substrings of a page come from the ranks of a suffix array over words, built for hundreds of
pages at once; they have the substrings and counts that a suffix automaton of each page has. Text is cut
into units (lines, sentences, list items); units without clause structure that repeats cover, units that
only repeat one of the page's key phrases, links with their labels, and tags are junk. A page is junk if they
hold more than half of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a page's words beyond which the page is junk.
SHARE = 0.5
#: Times a phrase occurs on a page before it can be a key phrase, its longest size in words, and how often units repeat it within themselves.
REPEATS, PHRASE, DOUBLED = 5, 5, 3
#: Times a word or phrase occurs before it counts as repeated within lists of tags.
LIST_REPEATS = 3
#: Pages whose substrings are counted together.
PAGES = 500
#: Items that make a list of tags, and the share of its characters that repeated substrings cover.
LIST_ITEMS, LIST_COVER = 12, 0.25
_WORD = re.compile(r"[^\W_]+")
_ANCHOR = re.compile(r"<a\b[^<>]*+>", re.I)
_LINK = re.compile(r"!?\[[^\[\]\n]*+\]\([^()\s]*+(?:\([^()\s]*+\)[^()\s]*+)*+\)|(?:https?://|www\.)[^\s<>\")\]]+", re.I)
_TAG = re.compile(r"(?<![\w&])#[^\W\d_][\w\-]*|(?<![\w&])#\d+[^\W\d_][\w\-]*")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>\n]*+>")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_UNIT = re.compile(r"[^.!?\n]+[.!?]*")
_ITEM = re.compile(r"[,;|·•»→]")
# Function words and verbs that give a clause its structure (en, de, fr, es).
_FUNCTION = frozenset(
    "the a an and or of to in is are was were that this for it its with on as at by from not no be has have had will would can but when which than then so if our your every you we they each only both because before after until"
    " der die das den dem des ein eine und oder nicht ist sind war waren wird werden mit von zu im in auf für an bei aus nach dass als wenn weil sich wir sie hat haben denn unser"
    " le la les un une des du de j l d qu s n c m t ai as avez avons et ou est sont a ont que qui dans pour sur avec ne pas au aux ce cette ces il elle nous vous par car si notre se"
    " el los las una y o es son fue que en por para con sin del al se lo no su sus este esta porque si nuestro ha han como".split()
)
# What is laid out rather than written, and no junk: log lines, table rows, path lists, name: value, code.
_LAID_OUT = re.compile(
    r"\s*\||.*\|\s*$|\s*(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\b|\s*\[?\d{4}-\d\d-\d\d[T ]"
    r"|\s*[\w.\-]+\s*[:=]\s*[\"'\[{\d]|\s*[{}\[\]()]|.*[;{}]\s*$|\s*(?:def|class|func|return|import|from|select|const|let|var)\b.*[(\[=;:]"
)


_FILE = re.compile(r"\.\w{1,5}\Z")


def _names_file(line: str) -> bool:
    """Whether a line is a path, alone or before a number."""
    parts = line.split(None, 2)
    return bool(parts) and "/" in parts[0] and _FILE.search(parts[0][-8:]) is not None and (len(parts) == 1 or parts[1][0].isdigit())


class Repeats:
    """Substrings of up to ``PHRASE`` words of many pages at once, each numbered and counted within its page.

    The ranks of a suffix array, by doubling: a substring of n words is the pair of the numbers of its first
    and last part, and one sort numbers all pairs of a batch. A substring never leaves its unit.
    """

    def __init__(self, words: np.ndarray, pages: np.ndarray, units: np.ndarray) -> None:
        self.units = units
        _, first = np.unique(pages * (int(words.max(initial=0)) + 1) + words, return_inverse=True)
        self.ranks = {1: first}
        for n, left in ((2, 1), (3, 2), (4, 2), (5, 4)):
            self.ranks[n] = self._joined(left, n - left, n)

    def _joined(self, left: int, right: int, n: int) -> np.ndarray:
        """The number of the n words from each place on, -1 where the unit ends before."""
        out = np.full(len(self.units), -1, dtype=np.int64)
        at = np.arange(max(0, len(self.units) - n + 1))
        at = at[self.units[at] == self.units[at + n - 1]]
        a, b = self.ranks[left][at], self.ranks[right][at + left]
        _, out[at] = np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)
        return out

    def phrases(self, n: int, least: int, allowed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number, place) of the n-word substrings that occur ``least`` times and begin and end at ``allowed`` places."""
        rank = self.ranks[n]
        at = np.flatnonzero(rank >= 0)
        at = at[allowed[at] & allowed[at + n - 1]]
        number, times = np.unique(rank[at], return_counts=True)
        keep = np.isin(rank[at], number[times >= least])
        return rank[at][keep], at[keep]


def _units(text: str) -> tuple[int, int, list[tuple[list[str], bool]], int]:
    """(words of the text, junk words of links and tags, units as words and whether they have clause structure, fragments)."""
    total = len(_WORD.findall(text))
    junk = 0

    def take(m: re.Match) -> str:
        nonlocal junk
        junk += len(_WORD.findall(m.group()))
        return " "

    rest = _FENCE.sub("\n", text) if "```" in text else text
    if "<" in rest:
        rest, junk = _without_anchors(rest)
    if "](" in rest or "://" in rest or "www." in rest.lower():
        rest = _LINK.sub(take, rest)
    if "<" in rest:
        rest = _MARKUP.sub("\n", rest)
    if "#" in rest:
        rest = _TAG.sub(take, rest)
    units: list[tuple[list[str], bool]] = []
    fragments = 0
    for line in rest.split("\n"):
        if not line.strip() or line.lstrip().startswith("#") or _names_file(line) or (_LAID_OUT.match(line) and not _row_of_items(line)):
            continue
        for sentence in _UNIT.findall(line):
            own = _WORD.findall(sentence.lower())
            if not own:
                continue
            items = _ITEM.split(sentence)
            split = [_WORD.findall(i.lower()) for i in items] if len(items) >= 6 else []
            if split and sum(0 < len(i) <= 6 for i in split) >= 0.9 * len(items):
                units += [(i, False) for i in split if i]
                fragments += len(split)
            else:
                functional = sum(map(_FUNCTION.__contains__, own))
                clause = functional >= 1 and len(own) >= 4 and (sentence.rstrip()[-1:] in ".!?" or functional >= 2)
                units.append((own, clause))
                fragments += not clause
    return total, junk, units, fragments


def _without_anchors(text: str) -> tuple[str, int]:
    """The text without ``<a ...>...</a>``, and the words in them; one pass, whatever their length."""
    out, last, words, lower = [], 0, 0, None
    for m in _ANCHOR.finditer(text):
        if m.start() < last:
            continue
        lower = lower or text.lower()
        end = lower.find("</a>", m.end())
        if end < 0:
            break
        out += [text[last : m.start()], " "]
        last = end + 4
        words += len(_WORD.findall(text, m.start(), last))
    return ("".join([*out, text[last:]]), words) if out else (text, 0)


def _row_of_items(line: str) -> bool:
    """Whether a line that does not begin with a bar is a run of four or more items between bars."""
    if line.lstrip().startswith("|") or line.count("|") < 3:
        return False
    cells = [c.strip() for c in line.strip().strip("|").split("|")]
    return sum(bool(a and b and (a[-1].isalnum() or a[-1] == "_") and (b[0].isalnum() or b[0] == "_")) for a, b in zip(cells, cells[1:])) >= 3


def junk_shares(texts: list[str | None]) -> list[float]:
    """For each text the share of its words that are junk, 0 for null, empty and wordless texts."""
    pages = [_units(t) if t else (0, 0, [], 0) for t in texts]
    words = [w for _, _, units, _ in pages for own, _ in units for w in own]
    sizes = np.array([len(own) for _, _, units, _ in pages for own, _ in units], dtype=np.int64)
    clause = np.array([c for _, _, units, _ in pages for _, c in units], dtype=bool)
    page_of = np.repeat(np.arange(len(pages)), [len(units) for _, _, units, _ in pages])
    junk = np.array([j for _, j, _, _ in pages], dtype=float)
    if words:
        index: dict[str, int] = {}
        ids = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
        unit = np.repeat(np.arange(len(sizes)), sizes)
        repeats = Repeats(ids, page_of[unit], unit)
        stuffed = _stuffed(repeats, np.array([w not in _FUNCTION for w in index])[ids], unit, clause, len(sizes))
        # a place lies in a substring that occurs LIST_REPEATS times exactly if its own word does
        times = np.bincount(repeats.ranks[1])
        chars = np.array([len(w) for w in index])[ids]
        held = np.bincount(unit, chars * (times[repeats.ranks[1]] >= LIST_REPEATS), len(sizes)) / np.maximum(1, np.bincount(unit, chars, len(sizes)))
        listed = ~stuffed & ~clause & (sizes <= 6)
        junk += np.bincount(page_of, sizes * stuffed, len(pages))
        listed_words, covered = np.bincount(page_of, sizes * listed, len(pages)), np.bincount(page_of, held * sizes * listed, len(pages))
        fragments = np.array([f for *_, f in pages])
        junk += np.where((fragments >= LIST_ITEMS) & (listed_words > 0) & (covered >= LIST_COVER * listed_words), listed_words, 0)
    return [float(j / t) if t else 0.0 for j, (t, *_) in zip(junk, pages)]


def _stuffed(repeats: Repeats, allowed: np.ndarray, unit: np.ndarray, clause: np.ndarray, units: int) -> np.ndarray:
    """Units that hold a key phrase of their page: one that units repeat within themselves, or that many fragments hold."""
    out = np.zeros(units, dtype=bool)
    for n in range(2, PHRASE + 1):
        number, at = repeats.phrases(n, REPEATS, allowed)
        if not len(at):
            continue
        pair, times = np.unique(number * units + unit[at], return_counts=True)
        phrase, of = pair // units, pair % units
        _, phrase = np.unique(phrase, return_inverse=True)
        again, fragments = np.bincount(phrase, times - 1), np.bincount(phrase, ~clause[of])
        out[of[((again >= DOUBLED) | (fragments >= REPEATS))[phrase]]] = True
    return out


def junk_share(text: str | None) -> float:
    return junk_shares([text])[0]


def junk_pages(df: DataFrame, key: str, column: str, share: float = SHARE) -> DataFrame:
    """``(key, junk_share)`` of the rows whose text is junk by more than ``share``. Repeated rows are repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, texts = batch["k"].tolist(), batch["t"].tolist()
            found = [(k, s) for at in range(0, len(keys), PAGES) for k, s in zip(keys[at : at + PAGES], junk_shares(texts[at : at + PAGES])) if s > share]
            yield pd.DataFrame(found, columns=[key, "junk_share"])

    return df.select(F.col(key).alias("k"), F.col(column).alias("t")).filter("t IS NOT NULL").mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, junk_share double")
