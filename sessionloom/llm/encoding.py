"""Problem 8: text that was decoded with the wrong character encoding.

A hidden Markov model with one clean state and one state for each pair (encoding taken wrongly, encoding meant)
labels the characters of a text. The clean state emits a character with its probability after the one before; the
state of a pair emits together the characters that stand for one original character, or the stretch of a wrong
encoding of several bytes, with the probability of what its inverse transform gives, and cannot emit them where the
transform is undefined. Stretches of non-ASCII characters that one transform undoes as a whole are one step; in all
others the steps are single characters, so that garbled characters beside proper ones are cut out. Each labelled
span gets its state's inverse transform. One further state emits the replacement character, whose original is lost.

Probabilities after a character are counts of character pairs, backed by counts of pairs of classes (script, case,
kind) and of characters in their class. All are counted over all texts, into a table of a fixed number of hashed
cells; only that table is sent to the executors. Stretches that hold UTF-8 under a wrong single-byte decoding, or
rows of bytes that no script writes, are left out of the counts, as they would teach the clean state what garbled
text looks like.

Defined results: null, empty and ASCII texts are never garbled; texts are read whole; repeated rows give repeated
rows; a text of which only a part can be undone has null as ``restored``.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.plans.runtime import arrow_map

#: Cells of the hashed table of character pairs: the bound of what is collected and broadcast.
CELLS = 1 << 19
#: Log-probability costs: of entering a garbled state, of going back, of each stretch inside it.
ENTER, LEAVE, STAY = 5.5, 1.0, 1.0
#: Characters from which on a stretch whose two-byte units are all printable ASCII is no chance.
TAKEN_AS_PAIRS = 8
#: What entering a state costs more whose transform undoes any characters whatever: fitting it proves nothing.
LOOSE = 14.0
#: Weight of the class model beside a character's own counts, of a class's share beside its counts after another
#: class, and what is added to the counts of single characters.
BACKED, BACKED_CLASS, FLOOR = 2000.0, 1000.0, 0.1
#: The probability that any character has after any other.
ANY = 1e-7
LOST = "�"
LOST_GAIN = 30.0
CACHE_ENTRIES = 300_000

#: The pairs (taken wrongly, meant). "c1252" is cp1252 whose undefined bytes stay controls.
PAIRS = (
    ("latin-1", "utf-8"),
    ("c1252", "utf-8"),
    ("cp1250", "utf-8"),
    ("cp1251", "utf-8"),
    ("cp850", "utf-8"),
    ("cp437", "utf-8"),
    ("cp866", "utf-8"),
    ("koi8-r", "utf-8"),
    ("mac_roman", "utf-8"),
    ("gbk", "utf-8"),
    ("utf-16-le", "utf-8"),
    ("utf-16-be", "utf-8"),
    ("utf-16-le", "utf-16-be"),
    ("latin-1", "cp1251"),
    ("c1252", "cp1251"),
    ("latin-1", "koi8-r"),
    ("c1252", "koi8-r"),
    ("cp1251", "koi8-r"),
    ("koi8-r", "cp1251"),
    ("cp866", "cp1251"),
    ("cp1251", "cp866"),
    ("mac_roman", "cp1251"),
    ("latin-1", "gbk"),
    ("c1252", "gbk"),
    ("cp1251", "c1252"),
    ("koi8-r", "c1252"),
    ("cp850", "c1252"),
    ("cp437", "c1252"),
    ("mac_roman", "c1252"),
    ("c1252", "cp850"),
    ("c1252", "mac_roman"),
)
#: The states: clean, each pair, each UTF-8 pair applied twice, and characters that are lost.
STATES = (
    "clean",
    *(f"{right}>{wrong}" for wrong, right in PAIRS),
    "utf-8>latin-1 twice",
    "utf-8>c1252 twice",
    "lost",
)

#: What each state takes the text for.
_MEANT = ("", *(right for _, right in PAIRS), "utf-8", "utf-8", "")

_LOOSE = frozenset(i for i, (wrong, right) in enumerate(PAIRS, 1) if right not in ("utf-8", "gbk") or wrong in ("utf-16-le", "utf-16-be"))

_RUN = re.compile("[^\x00-\x7f]+")
#: Four or more signs and letters of Latin-1 in a row, or a small letter before capitals.
_BYTES = re.compile("[\xa1-\xff]{4}|[а-яё][А-ЯЁ]{2}")


#: What texts are mostly made of: accented Latin letters, Cyrillic, Chinese, typographic signs and emoji.
_COMMON = re.compile("[\xa0-\u017f\u0300-\u036fЁА-яё\u2010-\u203a\u20ac\u2122\u3000-\u303f\u4e00-\u9fff\uff00-\uffef\U0001f300-\U0001faff\u200d\ufe0f]+")
#: Cost of a Cyrillic letter that would stand right beside a Latin one.
MIXED = 12.0


def _mixed_1252() -> tuple[dict[str, int], list[str]]:
    """cp1252 whose five undefined bytes stand for the control characters of the same number."""
    chars = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)]
    return {c: b for b, c in enumerate(chars)}, chars


_BYTE_OF, _CHAR_OF = _mixed_1252()


def _to_bytes(s: str, encoding: str) -> bytes | None:
    try:
        if encoding == "c1252":
            return bytes([_BYTE_OF[c] for c in s])
        return s.encode(encoding)
    except (UnicodeError, KeyError):
        return None


def _to_text(data: bytes, encoding: str) -> str | None:
    try:
        if encoding == "c1252":
            return "".join(_CHAR_OF[b] for b in data)
        return data.decode(encoding)
    except UnicodeError:
        return None


def inverse(s: str, state: int) -> str | None:
    """What ``s`` was before the wrong decoding of a state; None where it can't come from it."""
    name = STATES[state]
    if name.endswith(" twice"):
        wrong, right, times = name[6:-6], "utf-8", 2
    else:
        (wrong, right), times = PAIRS[state - 1], 1
    for _ in range(times):
        data = _to_bytes(s, wrong)
        if data is None:
            return None
        s = _to_text(data, right)
        if s is None:
            return None
    return s


def _hashed(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    """Cell of each pair of numbers."""
    mixed = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(y, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)).astype(np.int64) % CELLS


#: Where blocks of characters begin that differ in what they hold.
_BLOCKS = (0, 0x80, 0xA0, 0x100, 0x180, 0x250, 0x300, 0x370, 0x400, 0x460, 0x530, 0x600, 0x2000, 0x2070, 0x20A0, 0x2100, 0x2190, 0x2500, 0x25A0, 0x2E80, 0x3000, 0x3040, 0x3400, 0xA000, 0xAC00, 0xE000, 0xF900, 0xFF00, 0xFFF0)
_KINDS = {"Ll": 0, "Lu": 1, "Lo": 0, "Nd": 2, "Zs": 3, "Cc": 3, "Mn": 4}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point of the first plane (all others share the last one), and the classes' sizes."""
    block = np.searchsorted(_BLOCKS, np.arange(0x10000), side="right")
    kinds = [_KINDS.get(c := unicodedata.category(chr(i)), 5 if c[0] == "P" else 6) for i in range(0x10000)]
    _, number = np.unique(block * 8 + np.array(kinds), return_inverse=True)
    return np.append(number, number.max() + 1).astype(np.int64), np.append(np.bincount(number), 0x10000).astype(float)


_CLASS, _SIZE = _classes()
#: Second numbers of the cells of single characters and of single classes, beyond all code points.
_ONE, _KIND, _KIND_PAIR = 1 << 22, 1 << 23, 1 << 24


def _class_of(codes: np.ndarray) -> np.ndarray:
    return _CLASS[np.minimum(codes, 0x10000)]


def _counted(codes: np.ndarray) -> list[np.ndarray]:
    """All cells that the characters count in: pairs, single ones, pairs of classes, single classes."""
    own = _class_of(codes)
    return [_hashed(codes[:-1], codes[1:]), _hashed(codes, _ONE), _hashed(own[:-1], own[1:] + _KIND_PAIR), _hashed(own, _KIND)]


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sequences(state: int) -> re.Pattern[str]:
    """What the bytes of one character in UTF-8 look like under the wrong single-byte encoding of a state."""
    chars = [_to_text(bytes([b]), PAIRS[state - 1][0]) or "" for b in range(256)]
    some = lambda a, b: "[" + re.escape("".join(chars[a:b])) + "]"
    more = some(0x80, 0xC0)
    return re.compile(f"(?:{some(0xC2, 0xE0)}{more}|{some(0xE0, 0xF0)}{more}{{2}}|{some(0xF0, 0xF5)}{more}{{3}})+")


#: Single-byte states whose garbled characters can be cut out of a stretch, with their patterns.
_SEQUENCES = [(i, _sequences(i)) for i, (wrong, right) in enumerate(PAIRS, 1) if right == "utf-8" and wrong not in ("gbk", "utf-16-le", "utf-16-be")]
_SEQUENCES.sort(key=lambda x: PAIRS[x[0] - 1][0] not in ("c1252", "latin-1"))


def _undone(pattern: re.Pattern[str], state: int, run: str) -> str:
    return "".join(inverse(m.group(), state) or LOST for m in pattern.finditer(run))


def _looks_garbled(run: str) -> bool:
    """Whether a stretch is valid UTF-8 under a wrong single-byte decoding, or has lost characters."""
    if LOST in run or _BYTES.search(run):
        return True
    if any(p.search(run) and _COMMON.fullmatch(_undone(p, i, run)) for i, p in _SEQUENCES[:2]):
        return True
    if len(run) >= TAKEN_AS_PAIRS:
        for wrong in ("utf-16-le", "utf-16-be"):
            data = _to_bytes(run, wrong)
            if data is not None and data.isascii() and _to_text(data, "utf-8").isprintable():
                return True
    for wrong in ("c1252", "latin-1", "cp1251", "cp850", "cp437", "koi8-r", "mac_roman"):
        data = _to_bytes(run, wrong)
        was = _to_text(data, "utf-8") if data is not None and len(data) > 1 else None
        if was is not None and was != run and (_COMMON.fullmatch(was) or _looks_garbled(was)):
            return True
    return False


def pair_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts ``cell, n`` of hashed character pairs over all texts; at most CELLS rows."""
    cache: dict[str, bool] = {}

    def clean(text: str) -> str:
        if text.isascii():
            return text

        def judge(m: re.Match[str]) -> str:
            run = m.group()
            known = cache.get(run)
            if known is None:
                if len(cache) > CACHE_ENTRIES:
                    cache.clear()
                known = cache[run] = _looks_garbled(run)
            return "\x00" if known else run

        return _RUN.sub(judge, text)

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            text = "\n".join([clean(t) for t in batch.column(0).to_pylist() if t])
            for at in range(0, len(text), 1 << 20):
                codes = _codes(text[at : at + (1 << 20) + 1])
                if len(codes) > 1:
                    for cells in _counted(codes):
                        counts += np.bincount(cells, minlength=CELLS)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], names=["cell", "n"])

    return docs.select(text_col).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


class Labeller:
    """The model of one corpus: log-probabilities of characters after others and the path through a text."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        self.n = np.zeros(CELLS)
        self.n[cells] = counts
        number = np.arange(len(_SIZE))
        kinds = self.n[_hashed(number, _KIND)]
        share = (kinds + FLOOR) / (kinds + FLOOR).sum()
        met = self.n[_hashed(*(x.ravel() for x in np.meshgrid(number, number + _KIND_PAIR, indexing="ij")))].reshape(len(number), -1)
        #: Of each class the share of each class after it, and what a character's count is divided by.
        self.follows = (met + BACKED_CLASS * share) / (kinds + BACKED_CLASS)[:, None]
        self.members = kinds + FLOOR * _SIZE
        self.cache: dict[str, list[tuple[int, int, dict[int, float]]]] = {}
        self.open: dict[str, list[int]] = {}
        self.pairs: dict[str, float] = {}

    def score(self, s: str) -> float:
        """Log-probability of all characters but the first, each after the one before it."""
        get = self.pairs.get
        found = [get(p) for p in map(str.__add__, s, s[1:])]
        if None in found:
            new = sorted({s[i : i + 2] for i, v in enumerate(found) if v is None})
            if len(self.pairs) > CACHE_ENTRIES:
                self.pairs.clear()
            self.pairs.update(zip(new, self._after(_codes("".join(new)).astype(np.int64).reshape(-1, 2)).tolist()))
            if None in (found := [get(p) for p in map(str.__add__, s, s[1:])]):  # cleared between: once more, in full
                return float(self._after(np.stack([c := _codes(s).astype(np.int64), np.roll(c, -1)], axis=1)[:-1]).sum())
        return sum(found)

    def _after(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of the second of two characters after the first, for rows of two."""
        x, y = codes.T
        cy = _class_of(y)
        pairs, ones, after = self.n[_hashed(x, y)], self.n[_hashed(x, _ONE)], self.n[_hashed(y, _ONE)]
        backed = self.follows[_class_of(x), cy] * (after + FLOOR) / self.members[cy]
        return np.log((pairs + BACKED * backed) / (ones + BACKED) + ANY)

    def candidates(self, char: str) -> list[int]:
        """States that can emit a character at the beginning of a stretch."""
        known = self.open.get(char)
        if known is None:
            wrong_of = [*(w for w, _ in PAIRS), "latin-1", "c1252"]
            known = self.open[char] = [i + 1 for i, w in enumerate(wrong_of) if _to_bytes(char, w) is not None]
        return known

    def gains(self, before: str, run: str, after: str) -> dict[int, float]:
        """For each garbled state that can emit the characters, how much better than clean it does so."""
        if LOST in run:
            return {len(STATES) - 1: LOST_GAIN}
        out, clean, key = {}, None, f"{before}{run}{after}"
        scored: dict[str, float] = {}
        for state in self.candidates(run[0]):
            was = inverse(run, state)
            if was is None or was == run:
                continue
            if clean is None:
                clean = self.score(key)
            if was not in scored:
                scored[was] = self.score(f"{before}{was}{after}")
            gain = scored[was] - clean - STAY
            if _MEANT[state] in ("cp1251", "koi8-r"):
                gain -= MIXED * ((before.isascii() and before.isalpha()) + (after.isascii() and after.isalpha()))
            out[state] = gain
        return out

    def steps(self, before: str, run: str, after: str) -> list[tuple[int, int, dict[int, float]]]:
        """The steps (start, end, gains by state) of a stretch of non-ASCII characters: itself, or characters of it."""
        key = f"{before}{run}{after}"
        known = self.cache.get(key)
        if known is not None:
            return known
        whole = self.gains(before, run, after)
        best = [(0, len(run), whole)]
        most = max([g for g in whole.values() if g > ENTER], default=0.0)
        if LOST in run:
            most = LOST_GAIN
        for state, pattern in _SEQUENCES:
            if not pattern.search(run):
                continue
            own, total, at = [], 0.0, 0
            for m in pattern.finditer(run):
                a, b = m.span()
                gain = self.gains(run[a - 1] if a else before, m.group(), run[b] if b < len(run) else after)
                kept = {s: g for s, g in gain.items() if s == state or s not in _LOOSE}
                if a > at:
                    own.append((at, a, {}))
                own.append((a, b, kept))
                total += max([g for g in kept.values() if g > 0], default=0.0)
                at = b
            if at < len(run):
                own.append((at, len(run), {}))
            if total > most and len(own) > 1:
                best, most = own, total
        if len(self.cache) >= CACHE_ENTRIES:
            self.cache.clear()
        self.cache[key] = best
        return best

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """Garbled stretches as (start, end, state); none for clean text."""
        if not text or text.isascii():
            return []
        units, any_gain = [], False
        last = len(text)
        for m in _RUN.finditer(text):
            a, b = m.span()
            for x, y, own in self.steps(text[a - 1] if a else "\n", m.group(), text[b] if b < last else "\n"):
                units.append((a + x, a + y, own))
                any_gain |= any(g > 0 for g in own.values())
        if not any_gain:  # no path through a garbled state can win
            return []
        return self._path(units)

    def _path(self, units: list[tuple[int, int, dict[int, float]]]) -> list[tuple[int, int, int]]:
        """Viterbi over the steps; scores are relative to the clean state's emissions."""
        states = sorted({s for _, _, own in units for s, g in own.items() if g > 0})
        enter = {s: ENTER + LOOSE * (s in _LOOSE) for s in states}
        score = {0: 0.0} | {s: -enter[s] for s in states}
        back: list[dict[int, int]] = []
        for _, _, own in units:
            best = max(states, key=score.__getitem__)
            new, came = {}, {}
            came[0] = 0 if score[0] >= score[best] - LEAVE else best
            new[0] = max(score[0], score[best] - LEAVE)
            for s in states:
                if score[s] >= score[0] - enter[s]:
                    came[s], new[s] = s, score[s]
                else:
                    came[s], new[s] = 0, score[0] - enter[s]
                new[s] += own.get(s, -60.0)
            score = new
            back.append(came)
        at = max(score, key=lambda s: score[s] - (LEAVE if s else 0))
        labels = []
        for came in reversed(back):
            labels.append(at)
            at = came[at]
        labels.reverse()
        return [(a, b, s) for (a, b, _), s in zip(units, labels) if s]

    def restore(self, text: str, spans: list[tuple[int, int, int]]) -> str | None:
        """The original text; None where lost characters leave no way back."""
        out, at = [], 0
        for a, b, state in spans:
            was = inverse(text[a:b], state) if STATES[state] != "lost" else None
            if was is None:
                return None
            out += [text[at:a], was]
            at = b
        return "".join([*out, text[at:]])


def find_garbled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Garbled rows as ``id_col, states array<string>, restored string``.

    ``states`` has the distinct labels that occur, ``restored`` the original text, null where it can't
    be regained. Two narrow passes over the texts; between them only the table of pair counts goes
    through the driver (at most CELLS rows).
    """
    table = pair_counts(docs, text_col).toPandas()
    cells, counts = table["cell"].to_numpy(np.int64), table["n"].to_numpy(np.float64)
    model = docs.sparkSession.sparkContext.broadcast((cells.astype(np.int32), counts.astype(np.float32)))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        labeller = _labeller(model)
        rows, states, restored = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            spans = labeller.spans(text)
            if spans:
                rows.append(i)
                states.append(sorted({STATES[s] for _, _, s in spans}))
                restored.append(labeller.restore(text, spans))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(states, pa.list_(pa.string())),
                pa.array(restored, pa.string()),
            ],
            names=[id_col, "states", "restored"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(
        docs.select(id_col, text_col), kernel, f"`{id_col}` {kind}, states array<string>, restored string"
    )


_MODELS: dict[int, Labeller] = {}


def _labeller(model) -> Labeller:
    """The labeller of a broadcast model, built once per Python worker."""
    key = id(model.value)
    if key not in _MODELS:
        _MODELS.clear()
        cells, counts = model.value
        _MODELS[key] = Labeller(cells.astype(np.int64), counts.astype(np.float64))
    return _MODELS[key]


