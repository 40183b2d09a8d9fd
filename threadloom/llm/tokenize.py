"""Encoding of a text column with a public byte-level BPE tokenizer.

Whole words that the vocabulary holds are frequent by construction of the vocabulary; they are compiled
into a lexicon automaton (``lexicon.Lexicon``) that maps a word to its id. Words outside it are merged
exactly, lowest rank first. Empty, null and whitespace-free edge cases are defined: null and empty texts
have an empty list of ids, and text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.lexicon import Lexicon
from threadloom.session import shared_folder

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("THREADLOOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how the tokenizer splits text into words before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a task remembers before it starts afresh.
MEMO_WORDS = 500_000
#: Words longer than this are merged anew each time instead of being remembered.
MEMO_CHARS = 64

_READY: dict[tuple, tuple] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank is merged until none is left, leftmost first.

    A heap of pairs over a linked list, so a run of any length takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(ranks[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else len(parts)
        if j >= len(parts) or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j] = joined, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else len(parts)
            if left >= 0 and right < len(parts) and (pair := parts[left] + parts[right]) in ranks:
                heapq.heappush(heap, (ranks[pair], left, pair))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], lexicon: Lexicon, pattern: str = PATTERN) -> None:
        self.ranks, self.lexicon = ranks, lexicon
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text. A batch's unknown words take the lexicon together, the rest is merged."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        pieces = [self.split(t) if t else () for t in texts]
        unknown = list({p for own in pieces for p in own if p not in memo})
        raw = [p.encode("utf-8", "replace") for p in unknown]
        passing: dict[str, tuple[int, ...]] = {}
        for piece, word, number in zip(unknown, raw, self.lexicon.find(raw).tolist()):
            ids = (number,) if number >= 0 else tuple(merge(word, self.ranks))
            (memo if len(piece) <= MEMO_CHARS else passing)[piece] = ids
        if passing:
            look = lambda p: memo.get(p) or passing[p]
        else:
            look = memo.__getitem__
        return [list(chain.from_iterable(map(look, own))) for own in pieces]


def _publish(spark: SparkSession, vocabulary: str) -> tuple[str, dict[bytes, int]]:
    """Compile the lexicon once into the shared folder and hand it to every executor; gives the file's name.

    The file is written through the cluster's file system, whatever that is, and executors fetch it from there.
    """
    ranks = load_ranks(vocabulary)
    with open(vocabulary, "rb") as file:
        name = f"lexicon-{hashlib.sha256(file.read()).hexdigest()[:16]}.npy"
    where = f"{shared_folder(spark)}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(where).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(where)):
        part = path(f"{where}.{uuid.uuid4().hex}")
        stream = fs.create(part, True)
        stream.write(bytearray(Lexicon.build(ranks).to_bytes()))
        stream.close()
        if not fs.rename(part, path(where)):
            fs.delete(part, False)  # another session was first
    spark.sparkContext.addFile(where)
    return name, ranks


def encode_column(df: DataFrame, key: str, column: str, vocabulary: str | None = None) -> DataFrame:
    """``(key, ids array<int>)`` of every row; repeated rows are repeated, null keys are kept.

    ``vocabulary`` is a rank file of TOKENIZERS.
    """
    vocabulary = vocabulary or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    spark = df.sparkSession
    lexicon, ranks = _publish(spark, vocabulary)
    sent = spark.sparkContext.broadcast(ranks)  # a vocabulary, not data: its size is fixed by the tokenizer
    name = (vocabulary, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _READY:
            _READY[name] = (Encoder(sent.value, Lexicon.load(SparkFiles.get(lexicon))),)
        encoder = _READY[name][0]
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                ids = encoder.encode(texts[at : at + 500])
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1])))
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(ids)), pa.ListArray.from_arrays(pa.array(offsets), flat)], [key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(column).alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
