"""Exact byte-level BPE by backtracking over longest matches (linear in the length of a piece).

The vocabulary is read from a public tokenizer file whose path is a parameter. Bytes are mapped to
Latin-1 characters so that an Aho-Corasick automaton over strings finds, in one pass, the longest
vocabulary entry that starts at each byte. The encoder then walks the piece from left to right,
always trying the longest entry first, and keeps a token only if it is compatible with the one
before it, that is if BPE would not have merged across their border. Where no entry fits, it goes
back one token and tries that token's next shorter prefix; a bitmap of positions known to be dead
keeps the walk linear. The compatibility of two adjacent tokens is memoised.

Defined results: null text and empty text both give an empty list; text that looks like a special
token is ordinary text; no special token is ever added.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import ahocorasick

#: Where the public tokenizer files lie; a parameter of every operator that needs one.
TOKENIZER_DIR = os.environ.get("SESSIONLOOM_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"

#: Entries kept by a worker's piece cache before it is emptied.
CACHE_ENTRIES = 400_000
#: Longer pieces are encoded each time instead of being kept.
CACHE_PIECE_CHARS = 64
UNIT_CHARS = 24

#: Units between white space, cut as the pieces are; texts with one of the four separators, which
#: the engine's whitespace class holds but White_Space doesn't, go the slow way.
_UNITS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _char_class(test) -> str:
    """A regular-expression class of all code points for which ``test`` holds, as ranges."""
    out, start, last = [], None, None
    for c in range(0x40000):  # beyond lie no letters, numbers or white space
        if test(c):
            if start is None:
                start = c
            last = c
        elif start is not None:
            out.append((start, last))
            start = None
    if start is not None:
        out.append((start, last))
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _is_white(c: int) -> bool:
    """White_Space of the Unicode standard; the four separators 1C-1F don't belong to it."""
    return chr(c).isspace() and not 0x1C <= c <= 0x1F


def piece_pattern() -> re.Pattern[str]:
    """The splitting pattern of the byte-level vocabulary, for the standard library's engine.

    Letters are \\w without digits, underscore and the other numerics; numerics are \\d and the
    categories Nl and No.
    """
    other_numbers = _char_class(lambda c: unicodedata.category(chr(c)) in ("Nl", "No"))
    white = _char_class(_is_white)
    # \w also holds whatever str.isalnum holds; what is neither letter nor number must be left out
    odd = _char_class(lambda c: chr(c).isalnum() and unicodedata.category(chr(c))[0] not in "LN")
    letter = rf"[^\W\d_{other_numbers}{odd}]"
    number = rf"[\d{other_numbers}]"
    rest = rf"(?:[^\w{white}]|[_{odd}])"
    return re.compile(
        rf"'(?:[sdmt]|ll|ve|re)| ?{letter}+| ?{number}+| ?{rest}+|[{white}]+(?![^{white}])|[{white}]+"
    )


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins that vocabulary files use for the 256 bytes, as character to byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    table.update({chr(256 + i): b for i, b in enumerate(others)})
    return table


class BacktrackingBPE:
    """Encoder for one byte-level vocabulary whose ids follow the order of its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = byte_alphabet()
        latin = lambda s: "".join(chr(back[c]) for c in s)
        vocab: dict[str, int] = {latin(t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: rank of each token: bytes first, then merges in their order
        self.token_of: list[str] = [chr(b) for b in range(256)]
        rank: dict[str, int] = {t: r for r, t in enumerate(self.token_of)}
        self.left, self.right = list(range(256)), list(range(256))
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            a, b = latin(a), latin(b)
            pair = (rank[a], rank[b])
            if a + b not in rank:
                rank[a + b] = len(self.token_of)
                self.token_of.append(a + b)
                self.left.append(pair[0])
                self.right.append(pair[1])
            self.merged.setdefault(pair, rank[a + b])
        self.id_of = [vocab[t] for t in self.token_of]
        self.length = [len(t) for t in self.token_of]
        #: the longest other token that a token begins with
        self.shorter = [next((rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in rank), -1) for t in self.token_of]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, r in rank.items():
            self.automaton.add_word(t, r)
        self.automaton.make_automaton()
        self.rank = rank
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = piece_pattern()
        self.cache: dict[str, tuple[int, ...]] = {}
        self.units: dict[str, tuple[int, ...]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves token a followed by token b as they are (memoised)."""
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self._compatible(a, b)
            if len(self.fits) > 4_000_000:
                self.fits.clear()
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens' last merges again and again; at each level the facing
        # halves must not have a merge that would have come before what was undone.
        bound = len(self.token_of)
        while True:
            if self.merged.get((a, b), bound) < bound:
                return False
            if a > b:
                bound, inner = a, self.right[a]
                if inner == a:
                    return True
                a = inner
            else:
                bound, inner = b + 1, self.left[b]
                if inner == b:
                    # a byte on the right: only the left token can still be opened
                    bound, inner = a, self.right[a]
                    if inner == a:
                        return True
                    a = inner
                    continue
                b = inner

    def ranks(self, piece: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        s = piece.decode("latin-1")
        whole = self.rank.get(s)
        n = len(s)
        if n == 1:
            return [whole]
        longest = [-1] * n
        length = self.length
        for end, r in self.automaton.iter(s):
            start = end + 1 - length[r]
            if longest[start] < 0 or length[longest[start]] < length[r]:
                longest[start] = r
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if alive[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:
                token = self.shorter[token]
                while token < 0:
                    alive[at] = 0
                    token = out.pop()
                    at -= length[token]
                    token = self.shorter[token]

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece, from the cache where it is short."""
        ids = self.cache.get(text)
        if ids is None:
            id_of = self.id_of
            ids = tuple(id_of[r] for r in self.ranks(text.encode("utf-8", "surrogatepass")))
            if len(text) <= CACHE_PIECE_CHARS:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[text] = ids
        return ids

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of one unit between white space, from the cache where it is short."""
        get, piece = self.cache.get, self.piece
        found = self.pieces.findall(text)
        ids = piece(found[0]) if len(found) == 1 else tuple(chain.from_iterable([get(p) or piece(p) for p in found]))
        if len(text) <= UNIT_CHARS:
            if len(self.units) >= CACHE_ENTRIES:
                self.units.clear()
            self.units[text] = ids
        return ids

    def parts(self, text: str) -> list[tuple[int, ...]]:
        """Ids of a text, one tuple for each unit. Pieces never cross from one unit into the next."""
        if _SEPARATORS.search(text):
            return [self.piece(p) for p in self.pieces.findall(text)]
        get, unit = self.units.get, self.unit
        return [get(u) or unit(u) for u in _UNITS.findall(text)]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty text give an empty list."""
        return list(chain.from_iterable(self.parts(text))) if text else []

    def count(self, text: str | None) -> int:
        """Number of tokens of a text."""
        return sum(map(len, self.parts(text))) if text else 0


_LOADED: dict[str, BacktrackingBPE] = {}


def load(path: str) -> BacktrackingBPE:
    """The encoder of a vocabulary file, built once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = BacktrackingBPE(path)
    return _LOADED[path]
