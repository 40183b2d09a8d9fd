"""Evaluation passages inside documents: a hash set of normalised n-grams, scanned and verified.

The n-grams of the passages form a hash set that goes to every task; documents are scanned window by
window, hits are verified against the passage words, and leaked spans can be cut out. A set beyond
BLOCK_GRAMS is scanned in blocks, so what is sent to a task is bounded whatever the test material.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
GRAM = 12
#: n-grams of one block, about 100 MB in a task.
BLOCK_GRAMS = 400_000
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _rolling(ids: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of every window of ``gram`` word ids."""
    n = len(ids) - gram + 1
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            out = out * _BASE + ids[k : k + n] + np.uint64(1)
    return out


class Passages:
    """Word ids, hashed windows and exact windows of a block of passages."""

    def __init__(self, items: list[tuple[int, str | None]], gram: int = GRAM) -> None:
        self.gram = gram
        self.ids: dict[str, int] = {}
        self.owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, passage in items:
            own = [self.ids.setdefault(w, len(self.ids)) for w in words(passage)]
            for at in range(len(own) - gram + 1):
                self.owners[tuple(own[at : at + gram])].add(item)
        self.owners = dict(self.owners)
        grams = np.array(list(self.owners), dtype=np.uint64).reshape(-1, gram)
        self.hashes = np.unique(np.concatenate([_rolling(g, gram) for g in grams])) if len(grams) else np.zeros(0, np.uint64)

    def hits(self, text_words: list[str]) -> Iterator[tuple[int, int]]:
        """(first word of the window, item) for every window of the text that a passage holds."""
        if len(text_words) < self.gram or not len(self.hashes):
            return
        ids = np.fromiter((self.ids.get(w, -1) for w in text_words), dtype=np.int64, count=len(text_words))
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        whole = np.flatnonzero(unknown[self.gram :] == unknown[: -self.gram])
        if not len(whole):
            return
        hashed = _rolling(ids.astype(np.uint64), self.gram)[whole]
        place = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        for at in whole[self.hashes[place] == hashed].tolist():
            for item in self.owners.get(tuple(ids[at : at + self.gram].tolist()), ()):
                yield at, item


def passage_blocks(items: DataFrame, key: str, column: str, gram: int = GRAM, block: int = BLOCK_GRAMS) -> Iterator[Passages]:
    """The held-out material in blocks of at most ``block`` n-grams, plus one passage."""
    held: list[tuple[int, str]] = []
    grams = 0
    for row in items.select(key, column).filter(F.col(column).isNotNull() & F.col(key).isNotNull()).toLocalIterator():
        held.append((row[0], row[1]))
        grams += len(words(row[1]))
        if grams >= block:
            yield Passages(held, gram)
            held, grams = [], 0
    if held:
        yield Passages(held, gram)


def _scan(docs: DataFrame, passages: Passages) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["k"].tolist(), batch["t"].tolist()):
                spans: dict[int, list[list[int]]] = defaultdict(list)
                for at, item in passages.hits(words(text)):
                    own = spans[item]
                    if own and at <= own[-1][1]:
                        own[-1][1] = at + passages.gram
                    else:
                        own.append([at, at + passages.gram])
                rows += [(doc, item, a, b) for item, own in spans.items() for a, b in own]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "end_word"])

    return docs.mapInPandas(run, "doc_id bigint, item_id bigint, first_word bigint, end_word bigint")


def leaked_spans(docs: DataFrame, key: str, column: str, items: DataFrame, item_key: str, passage: str, gram: int = GRAM, block: int = BLOCK_GRAMS) -> DataFrame:
    """``(doc_id, item_id, first_word, end_word)``: word spans of documents that stand in a passage.

    Null and short texts, and passages of fewer than ``gram`` words, leak nothing; repeated rows give
    repeated spans; without items or documents the result is empty.
    """
    slim = docs.select(F.col(key).alias("k"), F.col(column).alias("t")).filter("t IS NOT NULL")
    found = None
    for passages in passage_blocks(items, item_key, passage, gram, block):
        part = _scan(slim, passages)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else _scan(slim, Passages([], gram))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word spans; what lies between words goes with the word before it."""
    places = [m.span() for m in _WORD.finditer(text.lower())] if len(text.lower()) == len(text) else [m.span() for m in _WORD.finditer(text)]
    for a, b in sorted(spans, reverse=True):
        text = text[: places[a][0]] + text[places[b - 1][1] :]
    return text


def without_leaks(docs: DataFrame, key: str, column: str, spans: DataFrame) -> DataFrame:
    """``(key, column)`` of the documents that leak, with the leaked spans removed."""
    whole = spans.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "end_word")).alias("spans"))  # bounded by the words of one document

    @F.pandas_udf("string")
    def cut(texts: pd.Series, every: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, every):
            merged: list[list[int]] = []
            for a, b in sorted((s["first_word"], s["end_word"]) for s in own):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            out.append(cut_spans(text, [tuple(m) for m in merged]))
        return pd.Series(out, dtype=object)

    return docs.select(F.col(key).alias("doc_id"), F.col(column).alias("text")).join(whole, "doc_id").select("doc_id", cut("text", "spans").alias("text"))
