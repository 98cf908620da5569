"""Count-only Viterbi over a double-array trie, for unigram vocabularies.

The trie's transitions are two integer arrays, ``base`` and ``check``: from state s the symbol c leads
to t = base[s] + c, which exists where check[t] = s. Symbols are the bytes of the UTF-8 text plus 1.
For each position only the best score and the number of tokens of the best path are kept, no path, so
the memory for a segment is two numbers a byte. Counts of short segments are kept in a cache.
"""

from __future__ import annotations

import json
import re

#: Score below that of the worst piece which a character outside of the vocabulary gets.
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 200_000
SPACE = "▁"


class DoubleArrayTrie:
    """A static map of byte strings to numbers."""

    def __init__(self, keys: list[bytes]):
        root: dict = {}
        for value, key in enumerate(keys):
            node = root
            for byte in key:
                node = node.setdefault(byte + 1, {})
            node[0] = value
        self.base, self.check = [0] * 512, [-1] * 512
        self.check[0] = 0
        start, todo = 1, [(0, root)]
        while todo:
            state, node = todo.pop()
            symbols = sorted(node)
            while self.check[start] >= 0:
                start += 1
                self._grow(start + 512)
            base = max(1, start - symbols[0])
            while True:
                self._grow(base + 512)
                if all(self.check[base + c] < 0 for c in symbols):
                    break
                base += 1
            self.base[state] = base
            for c in symbols:
                self.check[base + c] = state
            for c in symbols:
                if c:
                    todo.append((base + c, node[c]))
                else:
                    self.base[base] = -node[0] - 1

    def _grow(self, n: int) -> None:
        if n >= len(self.base):
            more = n - len(self.base) + 1024
            self.base += [0] * more
            self.check += [-1] * more

    def prefixes(self, data: bytes, at: int):
        """Every key that ``data`` has at ``at``, as (end, value)."""
        base, check = self.base, self.check
        state = 0
        for end in range(at, len(data)):
            to = base[state] + data[end] + 1
            if check[to] != state:
                return
            state = to
            leaf = base[state]
            if check[leaf] == state and base[leaf] < 0:
                yield end + 1, -base[leaf] - 1


class UnigramCounter:
    """Numbers of tokens under a unigram model: a list of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.trie = DoubleArrayTrie([p.encode() for p, _ in pieces])
        self.scores = [float(s) for _, s in pieces]
        self.unknown = min(self.scores) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def segment(self, text: str) -> int:
        """Tokens on the best path through one segment; runs of unknown characters count as one."""
        known = self.cache.get(text)
        if known is not None:
            return known
        data = text.encode("utf-8", "surrogatepass")
        n = len(data)
        worst = float("-inf")
        score, count, unknown = [worst] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        for at in range(n):
            if score[at] == worst:
                continue
            step = 1
            while at + step < n and data[at + step] & 0xC0 == 0x80:
                step += 1
            single = False
            for end, value in self.trie.prefixes(data, at):
                single |= end == at + step
                if (s := score[at] + self.scores[value]) > score[end]:
                    score[end], count[end], unknown[end] = s, count[at] + 1, False
            if not single and (s := score[at] + self.unknown) > score[at + step]:
                score[at + step], count[at + step], unknown[at + step] = s, count[at] + (not unknown[at]), True
        if len(text) <= 32:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[text] = count[n]
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of a text; null and empty text have none. Each word begins with the space mark."""
        return sum(self.segment(SPACE + w) for w in re.split(r" +", text.strip(" "))) if text and text.strip(" ") else 0


def is_unigram(path: str) -> bool:
    """Whether a vocabulary file holds a unigram model."""
    if not path.endswith(".json"):
        return False
    if path not in _KIND:
        with open(path, encoding="utf-8") as f:
            _KIND[path] = json.load(f)["model"].get("type") == "Unigram"
    return _KIND[path]


_KIND: dict[str, bool] = {}
_LOADED: dict[str, UnigramCounter] = {}


def load(path: str) -> UnigramCounter:
    """The counter of a vocabulary file, built once per Python worker."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            _LOADED[path] = UnigramCounter([(p, s) for p, s in json.load(f)["model"]["vocab"]])
    return _LOADED[path]
