"""Double-array trie over bytes, walked for many places at once."""

from collections.abc import Mapping

import numpy as np

ROOT = 1


class DoubleArrayTrie:
    """Words to whole numbers (from 0): the child of state s by byte b is ``base[s] + b`` if its check is s."""

    def __init__(self, base: np.ndarray, check: np.ndarray, value: np.ndarray):
        self.base, self.check, self.value = base, check, value

    @classmethod
    def build(cls, words: Mapping[bytes, int]) -> "DoubleArrayTrie":
        keys = sorted(words)
        # every node could start a row of its own, so that the search below always ends
        size = 1024 + 4 * (1 + sum(map(len, keys)))
        base, check, value = np.zeros(size, np.int32), np.zeros(size, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = used[ROOT] = 1
        # where the search for so many children goes on; it never goes back
        begin: dict[int, int] = {}
        # ranges of keys that share a prefix of some length, by their state
        waiting = [(ROOT, 0, len(keys), 0)]
        while waiting:
            state, first, end, depth = waiting.pop()
            if first < end and len(keys[first]) == depth:
                value[state] = words[keys[first]]
                first += 1
            children = []
            at = first
            while at < end:
                byte, start = keys[at][depth], at
                while at < end and keys[at][depth] == byte:
                    at += 1
                children.append((byte, start, at))
            if not children:
                continue
            low, kind = children[0][0], min(len(children), 16)
            place = max(begin.get(kind, 0), low + 1)
            while used[place] or any(used[place - low + code] for code, *_ in children):
                place += 1
            begin[kind] = max(begin.get(kind, 0), place - 255)
            base[state] = offset = place - low
            for code, start, stop in children:
                used[offset + code] = 1
                check[offset + code] = state
                waiting.append((offset + code, start, stop, depth + 1))
        top = used.rfind(1) + 257
        return cls(base[:top].copy(), check[:top].copy(), value[:top].copy())

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children of many states; 0 where there is none."""
        found = self.base[states] + codes
        return np.where((self.check[found] == states) & (self.base[states] > 0), found, 0)
