"""A minimal acyclic automaton over byte strings with numbers as output, kept in flat arrays.

Built from sorted words by sharing suffixes as it goes; every state knows how many words lie below
it, so the sum of skipped counts along a path is the word's place and the place gives its output. The
arrays are written to one file and memory-mapped by every task of a machine. Lookups run in lockstep:
all words of a batch take one transition a step.
"""

from __future__ import annotations

import io

import numpy as np


class Lexicon:
    """``keys``: (state, byte) of each edge as one sorted number, so a transition is one binary search, vectorised over words.

    All arrays are used as they are mapped: a task holds no copy of them.
    """

    def __init__(self, keys: np.ndarray, targets: np.ndarray, skips: np.ndarray, final: np.ndarray, outputs: np.ndarray) -> None:
        self.keys, self.targets, self.skips, self.final, self.outputs = keys, targets, skips, final, outputs

    @classmethod
    def build(cls, words: dict[bytes, int]) -> Lexicon:
        ordered = sorted(words)
        register: dict[tuple, int] = {}
        frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def freeze(node: list) -> int:
            signature = (node[0], tuple(node[1]))
            state = register.get(signature)
            if state is None:
                state = register[signature] = len(frozen)
                frozen.append(signature)
            return state

        path: list[list] = [[False, []]]  # [is a word, edges (byte, state)]
        before = b""
        for word in ordered:
            shared = 0
            while shared < min(len(before), len(word)) and before[shared] == word[shared]:
                shared += 1
            for at in range(len(before), shared, -1):
                path[at - 1][1].append((before[at - 1], freeze(path.pop())))
            path += [[False, []] for _ in range(len(word) - shared)]
            path[-1][0] = True
            before = word
        for at in range(len(before), 0, -1):
            path[at - 1][1].append((before[at - 1], freeze(path.pop())))
        root = freeze(path[0])
        below = []  # words from each state on; children are frozen before parents
        for is_word, edges in frozen:
            below.append(is_word + sum(below[t] for _, t in edges))
        order = [root, *(s for s in range(len(frozen)) if s != root)]
        place = {s: i for i, s in enumerate(order)}
        keys, targets, skips, final = [], [], [], []
        for s in order:
            is_word, edges = frozen[s]
            skip = int(is_word)
            for byte, t in edges:
                keys.append(place[s] * 256 + byte)
                targets.append(place[t])
                skips.append(skip)
                skip += below[t]
            final.append(int(is_word))
        return cls(*(np.array(a, dtype=np.int64) for a in (keys, targets, skips, final, [words[w] for w in ordered])))

    def to_bytes(self) -> bytes:
        """The arrays in one numpy file, which ``load`` maps."""
        sizes = np.array([len(self.keys), len(self.final), len(self.outputs)])
        out = io.BytesIO()
        np.save(out, np.concatenate([sizes, self.keys, self.targets, self.skips, self.final, self.outputs]))
        return out.getvalue()

    @classmethod
    def load(cls, path: str) -> Lexicon:
        flat = np.load(path, mmap_mode="r")
        edges, states, words = (int(x) for x in flat[:3])
        cuts = np.cumsum([3, edges, edges, edges, states, words])
        return cls(*(flat[a:b] for a, b in zip(cuts, cuts[1:])))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The output of each word, -1 for words that are not in the lexicon."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not words:
            return out
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        text = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        live = np.flatnonzero(lengths > 0)
        state, number = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        step = 0
        while len(live):
            wanted = state[live] * 256 + text[starts[live] + step]
            edge = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            known = self.keys[edge] == wanted
            live, edge = live[known], edge[known]
            state[live] = self.targets[edge]
            number[live] += self.skips[edge]
            step += 1
            ended = live[lengths[live] == step]
            ended = ended[self.final[state[ended]] != 0]
            out[ended] = self.outputs[number[ended]]
            live = live[lengths[live] > step]
        return out
