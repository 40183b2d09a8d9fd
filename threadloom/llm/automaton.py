"""A deterministic automaton over a fixed pattern set, run over many texts in lockstep.

The patterns are compiled once into a dense transition table (goto and failure links resolved, so one
lookup per character). Texts are cut into overlapping chunks of equal length; all chunks of a batch
advance together, one vectorised table lookup per position. Absolute ends found twice, in the overlap
of two chunks, are reported once.
"""

from __future__ import annotations

from collections import deque

import numpy as np


class Automaton:
    def __init__(self, patterns: list[str], chunk: int = 256) -> None:
        """``patterns`` match without regard to ASCII case; a pattern's id is its place in the list."""
        self.patterns = [p.lower() for p in patterns]
        goto: list[dict[int, int]] = [{}]
        out: list[set[int]] = [set()]
        for number, pattern in enumerate(self.patterns):
            state = 0
            for byte in pattern.encode("latin-1"):
                state = goto[state].setdefault(byte, len(goto))
                if state == len(goto):
                    goto.append({})
                    out.append(set())
            out[state].add(number)
        table = np.zeros((len(goto), 256), dtype=np.int32)
        fail = [0] * len(goto)
        queue = deque()
        for byte, state in goto[0].items():
            table[0, byte] = state
            queue.append(state)
        while queue:
            state = queue.popleft()
            table[state] = table[fail[state]]
            out[state] |= out[fail[state]]
            for byte, after in goto[state].items():
                fail[after] = table[fail[state], byte]
                table[state, byte] = after
                queue.append(after)
        for upper in range(ord("A"), ord("Z") + 1):
            table[:, upper] = table[:, upper + 32]
        self.table = table.reshape(-1)
        self.accepts = np.array([bool(o) for o in out])
        self.out = [sorted(o) for o in out]
        self.overlap = max(map(len, self.patterns)) - 1
        self.chunk = chunk + self.overlap

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """For each text the (end, pattern) pairs in order of end; null and empty texts have none."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        step = self.chunk - self.overlap
        owner, offset, pieces = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            raw = text.encode("latin-1", "replace")  # one byte a code point: positions are kept
            for at in range(0, max(1, len(raw) - self.overlap), step):
                owner.append(i)
                offset.append(at)
                pieces.append(raw[at : at + self.chunk].ljust(self.chunk, b"\0"))
        if not pieces:
            return found
        block = np.frombuffer(b"".join(pieces), dtype=np.uint8).reshape(len(pieces), self.chunk)
        columns = np.ascontiguousarray(block.T).astype(np.int32)
        state = np.zeros(len(pieces), dtype=np.int32)
        hits = []
        for at in range(self.chunk):
            state = self.table[state * 256 + columns[at]]
            accepted = np.flatnonzero(self.accepts[state])
            if len(accepted):
                hits.append((accepted, np.full(len(accepted), at + 1), state[accepted]))
        if hits:
            rows, ends, states = (np.concatenate(x) for x in zip(*hits))
            seen: list[set] = [set() for _ in texts]
            for row, end, s in zip(rows.tolist(), ends.tolist(), states.tolist()):
                for pattern in self.out[s]:
                    seen[owner[row]].add((offset[row] + end, pattern))
            found = [sorted(s) for s in seen]
        return found
