"""Problem 1: broken pairs of a prompt and a reference.

Ordered rules name every defect that a pair triggers: ``empty``, ``copy``, ``refusal``, ``truncated`` and
``language``. Emptiness, copies, refusals and unclosed delimiters are decided from the pair alone.
Abrupt endings are decided against the corpus: for each word it is counted how often it occurs at all and
how often a phrase ends with it (before a mark or at the end of a closed text); an unclosed text whose
last word hardly ever ends a phrase, or is the mere beginning of a known word, was cut off. The language of
a text is its script, and within Latin script the best of the languages under word and letter-triple
counts, learned from all pairs whose prompt's function words name its language.

The texts are read once: one pass gives the language counts, the word statistics, what the pair alone shows and,
where function words don't settle the language, the cells of the reference; the language model then sees these
cells only. The word statistics are joined, not collected; the language counts live in a table of a fixed number
of hashed cells (CELLS times the number of languages), the bound of what is collected and broadcast.

Defined results: a null, blank or invisible reference is ``empty`` whatever the prompt, and has no other defect,
as it has no text; for every other reference all the other rules are tried; a null prompt counts as an empty text,
which nothing copies and which has no language; texts are read whole; rows with one probe_index count once, in the
statistics too, as the row whose (prompt, reference) comes first, nulls as empty texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.plans.runtime import cut

#: Kinds of rows of the one pass over the texts.
PAIR, WORD, CELL = 0, 1, 2
ORDER = ("empty", "copy", "refusal", "truncated", "language")
CELLS = 1 << 16
#: Function words of the expected language, beyond those of any other, that settle the question.
CLEAR = 2
#: A word that occurs so often and ends a phrase more rarely than this share marks a cut.
SEEN, FINAL_SHARE = 8, 0.004
#: A whole text of so many words, or runs of so many Chinese signs, is a phrase that needs no mark at its end.
PHRASE_WORDS, PHRASE_SIGNS = 2, 24
#: Mean advantage per feature, and in all, that another language must have.
MARGIN, MARGIN_ALL = 0.35, 4.0

#: Words that stand in for no answer, without their brackets and marks, in small letters.
STAND_INS = {
    "na", "n a", "none", "null", "nil", "nan", "todo", "tbd", "tba", "blank", "empty", "no answer", "no response",
    "no reply", "undefined", "missing", "placeholder", "not available", "not applicable", "unanswered", "fixme", "xxx",
    "answer", "no data", "n v", "k a", "keine angabe", "keine antwort", "leer", "s o", "sans réponse", "aucune réponse",
    "vide", "sin respuesta", "vacío", "нет ответа", "пусто", "н д", "无", "空", "暂无", "无答案", "没有答案", "待定",
}
_STAND_IN_WORDS = max(len(x.split()) for x in STAND_INS)

#: Function words that tell the language of a prompt.
FUNCTION_WORDS = {
    "en": "the of and to in at what who where when which how did does do is was were on for with that explain summarize",
    "de": "der die das den dem des und was wer wo wann welche welcher wie hat ist wurde mit im am auf fasse erkläre nach zu",
    "fr": "le la les l du des et est ce que qu quand où quelle quel qui a été dans au aux pour résume explique combien en d",
    "es": "el la los las de del y qué quién dónde cuándo cuál cómo ha es en al por para con lo resume explica cuánto que",
}

_ALNUM = re.compile(r"[^\W_]+")
_ASCII_ALNUM = re.compile(r"[a-z0-9]+")
_HAN = re.compile("[㐀-鿿]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_TERMINAL = re.compile(r"""[.!?。！？…"'”’»」』)\]}）】`]\s*$""")
_PHRASE = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]+(?:[-'’][^\W\d_㐀-鿿]+)*|[#\d_]\w*|[.,;:!?。，；：！？、()\[\]{}\"“”]")

#: Phrases by which the answerer declines. Reports of a third person's refusal lack them.
REFUSALS = re.compile(
    r"""
    \bi(?:['’]?m|\s+am)\s+(?:very\s+|really\s+)?(?:sorry|afraid)\b.{0,30}?\b(?:i|my|no|this|it)\b
  | \bi\s*(?:can\s*not|can['’]?t|could\s*n['’]t|won['’]?t|will\s+not|must\s+not|may\s+not|shall\s+not)\s+(?:be\s+able\s+to\s+)?
        (?:help|assist|answer|share|provide|discuss|respond|comment|reply|do|go|give|fulfil|fulfill|comply|say|talk|disclose|support|offer|continue|engage)
  | \bi(?:['’]?m|\s+am)\s+(?:not\s+(?:able|allowed|permitted|comfortable|in\s+a\s+position|willing)|unable|going\s+to\s+leave)
  | \bi\s+(?:must|have\s+to|need\s+to|will|would\s+like\s+to|am\s+forced\s+to|['’]d\s+like\s+to)\s+(?:respectfully\s+|politely\s+)?(?:decline|refuse|pass|refrain|abstain)
  | \bi\s+(?:decline|refuse)\s+(?:to|this)
  | \bi(?:['’]d|\s+would|\s+should|\s+will)?\s+(?:rather\s+not|prefer\s+(?:not\s+to|to\s+keep))
  | \bi\s+(?:do\s*n['’]?t|do\s+not)\s+feel\s+(?:comfortable|able)
  | \b(?:against|violates?|outside|beyond)\s+(?:of\s+)?(?:my|what\s+i\s+can)\s*(?:guidelines|polic\w+|rules|instructions|principles|scope|programming|discuss|talk|share|help|answer|do)?
  | \bmy\s+(?:instructions|guidelines|rules|polic\w+|programming)\s+(?:do\s*n['’]?t|do\s+not|does\s+not|forbid|prohibit|prevent|won['’]?t)
  | \b(?:answer|reply|response)\s+can(?:not|\s*['’]t|\s+not)?\s+be\s+given\s+by\s+me
  | \bno\s+comment\b
  | \blet['’]?s\s+(?:talk\s+about|discuss|change|move\s+on|speak\s+about)\b.{0,30}\b(?:else|different|other|subject|topic)
  | \b(?:declined|refused|withheld|redacted)\s+by\s+(?:the\s+)?(?:assistant|model|bot|ai)\b
  | \bas\s+an?\s+(?:ai|artificial\s+intelligence|language\s+model|assistant)\b.{0,60}\b(?:not|can['’]?t|cannot|unable|n['’]t|decline|against|pass|leave|rather|outside|no)\b
  | \brequests?\s+like\s+this\b.{0,40}\b(?:filtered|blocked|refused|declined)
  | \b(?:kann|darf|möchte|will|werde)\s+ich\s+.{0,40}?(?:nicht|keine?)\b
  | \bich\s+(?:kann|darf|möchte|will|werde)\s+.{0,40}?(?:nicht|keine?)\b
  | \bich\b.{0,30}\b(?:ablehnen|verweigern)\b | \bmuss\s+ich\s+.{0,40}(?:ablehnen|verweigern|passen)
  | \bes\s+tut\s+mir\s+leid\b
  | \bkein\s+kommentar\b | \bmeine\s+(?:richtlinien|regeln|vorgaben)\b
  | \bje\s+(?:ne\s+)?(?:peux|puis|suis|veux|dois|préfère|souhaite)\b.{0,40}?\b(?:pas|refuser|décliner|désolée?|m['’]abstenir|impossible)\b
  | \b(?:mes|ma)\s+(?:règles|consignes|directives|politique)\b.{0,40}\b(?:interdisent|interdit|empêchent|permettent|permet)
  | \bpas\s+de\s+commentaire\b | \bil\s+m['’]est\s+(?:impossible|interdit)
  | \b(?:lo\s+siento|me\s+temo)\b.{0,60}\bno\b | \bno\s+(?:puedo|debo|me\s+está\s+permitido|me\s+es\s+posible|estoy\s+autorizad[oa]|quiero)\b
  | \b(?:debo|tengo\s+que|he\s+de)\s+(?:rechazar|declinar|negarme|abstenerme)\b | \bprefiero\s+no\b | \bsin\s+comentarios\b
  | \bmis\s+(?:reglas|normas|directrices|instrucciones|políticas)\b
  | \bя\s+не\s+(?:могу|буду|вправе|имею\s+права|стану|готов)\b | \bне\s+могу\s+(?:с\s+этим\s+)?(?:помочь|ответить|отвечать|обсуждать|предоставить|поделиться)
  | \b(?:вынужден[аы]?|должен|должна|приходится)\s+отказать(?:ся)?\b | \bотказываюсь\b | \bбез\s+комментариев\b | \bмои\s+(?:правила|инструкции)\b
  | \bмне\s+(?:не\s+разрешено|нельзя|запрещено)\b
  | 我(?:不能|无法|不可以|不会|不便|没办法|拒绝|不得不拒绝|必须拒绝|只能拒绝)|(?:抱歉|对不起|很遗憾).{0,12}(?:不能|无法|不便|不可以|拒绝)|无可奉告|恕(?:我)?(?:不能|无法|难)|不予(?:回答|置评)|不被允许|我的(?:规则|准则|政策)
    """,
    re.I | re.X | re.S,
)
#: Each phrase above has one of these words, or of these Chinese signs; other texts need no search.
_REFUSAL_WORDS = set(
    """i my me comment let lets assistant model bot ai request requests declined refused withheld redacted ich leid kommentar meine je mes ma pas
    impossible interdit siento temo puedo debo permitido posible estoy quiero tengo he prefiero comentarios mis я могу вынужден вынуждена вынуждены
    должен должна приходится отказываюсь комментариев мои мне artificial intelligence""".split()
)
_REFUSAL_SIGNS = re.compile("[我抱对遗无恕不]")


def is_refusal(text: str, own: list[str]) -> bool:
    """Whether the answerer declines; ``own`` are the words of the text."""
    if _REFUSAL_WORDS.isdisjoint(own) and (text.isascii() or not _REFUSAL_SIGNS.search(text)):
        return False
    return bool(REFUSALS.search(text))


#: What may follow a prompt that is given back, in small letters without marks.
AFTERWORDS = re.compile(
    r"^(?:thatisthequestion|thatsthequestion|isthequestion|goodquestion|yousay|youask|youasked|wasthequestion|dasistdiefrage|"
    r"lautetdiefrage|cestlaquestion|telleestlaquestion|esaeslapregunta|vottakojvopros|вотвопрос|воттаковвопрос|таковвопрос|这就是问题|是这个问题)?$"
)
#: Letters and digits that may stand before a prompt that is given back whatever they say; a longer introduction
#: must be a single clause, as anything that ends a sentence tells something of its own.
INTRODUCTION = 60
_SENTENCE_END = re.compile(r"[.!?](?=\s)|[。！？]")

_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "“": "”", "«": "»", "《": "》"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_BRACKETS = re.compile("[" + re.escape("".join([*_OPEN, *_CLOSE])) + "]")
_END = re.compile(r"(?:[,;:(\[{，、；：（=+]|\s[-–—]|(?:^|\n)\s*(?:\d+[.)]|[-*•]))$")


def visible(text: str | None) -> str:
    """The text without white space, controls and invisible signs at its ends."""
    if not text:
        return ""
    gone = lambda c: unicodedata.category(c)[0] in "ZC" or c in "⠀ㅤᅟᅠﾠ"
    a, b = 0, len(text)
    while a < b and gone(text[a]):
        a += 1
    while b > a and gone(text[b - 1]):
        b -= 1
    return text[a:b]


def flat(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_ALNUM.findall(text.lower())
    return _ALNUM.findall(unicodedata.normalize("NFKC", text).casefold())


def is_empty(found: list[str]) -> bool:
    """Whether these are all words of an answer that is none."""
    return not found or len(found) <= _STAND_IN_WORDS and " ".join(found) in STAND_INS


def is_copy(asked: list[str], own: list[str], text: str = "") -> bool:
    """The prompt comes back, alone, repeated or after an introduction; by the words of prompt and text."""
    p, r = "".join(asked), "".join(own)
    if len(p) < 4 or p not in r:
        return False
    first, last = r.index(p), r.rindex(p) + len(p)
    if r[first:last].replace(p, "") or not AFTERWORDS.match(r[last:]):
        return False
    return first <= INTRODUCTION or not _SENTENCE_END.search(before(text, first))


def before(text: str, n: int) -> str:
    """The part of a text that holds its first ``n`` letters and digits, as :func:`flat` counts them."""
    for i, c in enumerate(text):
        if n <= 0:
            return text[:i]
        n -= sum(map(len, flat(c)))
    return text


def unclosed(text: str) -> bool:
    """A bracket, quotation or code block stays open, or the text ends where more must come."""
    if text.count("```") % 2 or text.count('"') % 2:
        return True
    stack: list[str] = []
    for c in _BRACKETS.findall(text):
        if c in _OPEN:
            stack.append(c)
        elif c in _CLOSE and stack and stack[-1] == _CLOSE[c]:
            stack.pop()
    if stack:
        return True
    end = text.rstrip()
    return bool(_END.search(end))


def run_at_end(text: str, inner: str) -> int:
    """Where the run of letters, digits and signs of ``inner`` begins that ends the text; read from the end, at any length."""
    at = len(text)
    while at and (text[at - 1].isalnum() or text[at - 1] in inner):
        at -= 1
    return at


def last_word(text: str) -> str | None:
    """The word that a text without a closing mark breaks off at; None where it is closed or ends in a code."""
    end = visible(text)
    if _TERMINAL.search(end[-2:]):
        return None
    if _HAN.match(end[-1:]):
        return end[-2:] if _HAN.match(end[-2:-1]) else end[-1:]
    run = end[run_at_end(end, "_-'’") :]
    m = re.search(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*$", run)
    return m.group() if m and not re.search(r"[\d_-]$", run[: m.start()]) else None


def word_events(text: str) -> tuple[list[str], list[str]]:
    """Words of a text, and those with which a phrase ends; Chinese by pairs of characters.

    A whole text of a few words is a phrase, with or without a mark.
    """
    found = _PHRASE.findall(text)
    if found and (len(found) <= PHRASE_WORDS and len(found[0]) <= PHRASE_SIGNS or len(text) <= PHRASE_SIGNS and _HAN.search(text)):
        found.append(".")
    words, ends = [], []
    after = "a"  # the end of a text that is no phrase: its last word ends none
    for w in reversed(found):
        first = w[0]
        if first.isalpha():
            final = not (after.isalnum() or after in "_#")
            if "㐀" <= first <= "鿿":
                words += [w[k : k + 2] for k in range(len(w) - 1)]
                words.append(w[-1])
                if final:
                    ends += [w[-2:], w[-1]] if len(w) > 1 else [w]
            else:
                words.append(w)
                if final:
                    ends.append(w)
        after = first
    return words, ends


def script(text: str) -> str | None:
    """The script of most letters: han, cyrillic or latin; names in Latin letters don't outweigh the others."""
    if text.isascii():
        return "latin" if _LATIN.search(text) else None
    han, cyr, lat = len(_HAN.findall(text)), len(_CYRILLIC.findall(text)), len(_LATIN.findall(text))
    if han and han * 3 >= lat:
        return "zh"
    if cyr and cyr * 2 >= lat:
        return "ru"
    return "latin" if lat else None


LANGUAGES = tuple(FUNCTION_WORDS)
_LANGUAGES_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(FUNCTION_WORDS.values()):
    for _word in _words.split():
        _LANGUAGES_OF.setdefault(_word, []).append(_i)


def votes(found: list[str]) -> list[int]:
    """Function words of each language among the words."""
    out = [0] * len(LANGUAGES)
    for w in found:
        if w in _LANGUAGES_OF:
            for i in _LANGUAGES_OF[w]:
                out[i] += 1
    return out


def prompt_language(prompt: str, found: list[str] | None = None) -> str | None:
    """Language of a prompt by script and function words; ``found`` are its words."""
    s = script(prompt)
    if s != "latin":
        return s
    own = votes(flat(prompt) if found is None else found)
    best = max(own)
    return LANGUAGES[own.index(best)] if own.count(best) == 1 else None


def plain(text: str) -> str:
    """A text without code blocks, keys of objects and identifiers, for telling its language."""
    text = re.sub(r"```.*?(?:```|$)|`[^`]*`", " ", text, flags=re.S)
    text = re.sub(r'"\w+"\s*:', " ", text)
    return re.sub(r"\b\w*[\d_]\w*\b", " ", text)


def features(text: str) -> list[int]:
    """Cells of the words and letter triples of a text in Latin script; names count only where nothing else is there."""
    found = _LETTERS_RUN.findall(text)
    out = []
    for w in found:
        known = _COUNTED.get(w)
        if known is None:
            if len(_COUNTED) > 300_000:
                _COUNTED.clear()
            known = _COUNTED[w] = _cells(w.casefold()) if not w[0].isupper() or w.isupper() or len(w) <= 3 else []
        out += known
    if not out:
        for w in found:
            out += _cells(w.casefold())
    return out


_LETTERS_RUN = re.compile(r"[^\W\d_]+")
_COUNTED: dict[str, list[int]] = {}
_CELLS: dict[str, list[int]] = {}


def _cells(word: str) -> list[int]:
    known = _CELLS.get(word)
    if known is None:
        if len(_CELLS) > 300_000:
            _CELLS.clear()
        padded = f"^{word}$"
        grams = [f"w{word}", *(padded[i : i + 3] for i in range(len(padded) - 2))]
        known = _CELLS[word] = [xxhash.xxh3_64_intdigest(g.encode()) % CELLS for g in grams]
    return known


def by_script(language: str | None, text: str, found: list[str], bare: str) -> bool | None:
    """Whether a text is in another language than the given one, or None where the counts must tell.

    ``found`` are the words of the text, ``bare`` is the text as :func:`plain` gives it.
    """
    if language is None:
        return False
    if language in LANGUAGES and script(text) == "latin":
        # function words that clearly tell the expected language leave nothing to score
        own, i = votes(found), LANGUAGES.index(language)
        if own[i] >= CLEAR + max(v for k, v in enumerate(own) if k != i):
            return False
    s = script(bare)
    if s is None:
        return False
    if s != "latin" or language not in LANGUAGES:
        # codes and names alone tell nothing about the language of a text in Latin letters
        return s != language and (s != "latin" or len(re.findall(r"\b[a-zß-ÿ]{2,}\b", bare)) >= 2)
    return None if len(re.findall(r"[^\W\d_]{2,}", bare)) >= 2 else False


class LanguageModel:
    """Counts of cells by language, from all pairs with a prompt whose language is told by its function words."""

    def __init__(self, cells: np.ndarray, languages: np.ndarray, counts: np.ndarray):
        table = np.full((len(LANGUAGES), CELLS), 0.2)
        table[languages, cells] += counts
        self.log = np.log(table / table.sum(axis=1, keepdims=True))

    def other(self, language: int, cells: np.ndarray) -> bool:
        """Whether the cells of a text are clearly those of another language."""
        if not len(cells):
            return False
        scores = self.log[:, cells].sum(axis=1)
        gain = scores.max() - scores[language]
        return bool(gain > MARGIN_ALL and gain > MARGIN * len(cells))


def survey(prompt: str, reference: str | None) -> tuple[list[str], str | None, bool, int | None, list[int], list[int]]:
    """What a pair alone shows: its defects, the word it may break off at, whether a word of the prompt is cut, the
    language of the prompt, the cells of prompt and reference that count for it, and those that are to be judged
    (None as language where nothing is).
    """
    own = flat(reference or "")
    asked = flat(prompt)
    language = prompt_language(prompt, asked)
    known = LANGUAGES.index(language) if language in LANGUAGES else None
    bare = plain(reference or "") if language is not None else ""
    of_text = features(bare) if known is not None and script(bare) == "latin" else []
    counted = features(prompt) + of_text if known is not None else []
    if is_empty(own):
        return ["empty"], None, False, known, counted, []
    out = []
    if is_copy(asked, own, reference):
        out.append("copy")
    if is_refusal(reference, own):
        out.append("refusal")
    if unclosed(reference):
        out.append("truncated")
    other = by_script(language, reference, own, bare)
    if other:
        out.append("language")
    end = reference.rstrip()
    begun = False
    if not _TERMINAL.search(end[-1:]):
        tail = end[run_at_end(end, "_.#-") :].casefold()
        if re.search(r"\d", tail):
            words = re.findall(r"[\w.#-]+", prompt.rstrip("?？.").casefold())
            begun = tail not in words and any(a.startswith(tail) and a != tail for a in words)
    return out, last_word(reference), begun, known, counted, of_text if other is None else []


def find_defects(probes: DataFrame, id_col: str = "probe_index") -> DataFrame:
    """Defective pairs as ``id_col, defects array<string>, defect``; ``defect`` is the first in ORDER."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    pairs = probes.groupBy(id_col).agg(F.min(F.struct(text("prompt"), text("reference"))).alias("r")).select(id_col, "r.*")
    # the exact pass is heavy for its bytes: its tasks must not be merged by size
    pairs = pairs.repartition(int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    kind = probes.schema[id_col].dataType.simpleString()
    columns = {
        "part": pa.int32(), id_col: None, "defects": pa.list_(pa.string()), "word": pa.string(), "begun": pa.bool_(),
        "language": pa.int32(), "cells": pa.list_(pa.int32()), "cell": pa.int64(), "n": pa.int64(), "final": pa.int64(),
    }
    schema = f"part int, `{id_col}` {kind}, defects array<string>, word string, begun boolean, language int, cells array<int>, cell bigint, n bigint, final bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_type = np.zeros((len(LANGUAGES), CELLS), np.int64), None

        def rows(size: int, part: int, own: dict) -> pa.RecordBatch:
            own["part"] = pa.array(np.full(size, part, np.int32))
            return pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(size, t or id_type) for c, t in columns.items()], names=list(columns))

        for batch in batches:
            id_type = batch.column(0).type
            found: list[list[int]] = [[] for _ in LANGUAGES]
            total, final = Counter(), Counter()
            kept, defects, words, begun, languages, cells = [], [], [], [], [], []
            for i, (prompt, reference) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                d, word, is_begun, language, counted, judged = survey(prompt, reference)
                if language is not None:
                    found[language] += counted
                for own in (prompt, reference):
                    seen_words, ends = word_events(own)
                    total.update(seen_words)
                    final.update(ends)
                if d or word is not None or is_begun or judged:
                    kept.append(i)
                    defects.append(d)
                    words.append(word)
                    begun.append(is_begun)
                    languages.append(language)
                    cells.append(judged)
            for k, own in enumerate(found):
                counts[k] += np.bincount(np.array(own, np.int64), minlength=CELLS)
            yield rows(len(kept), PAIR, {
                id_col: batch.column(0).take(pa.array(kept, pa.int64())), "defects": pa.array(defects, columns["defects"]), "word": pa.array(words, pa.string()),
                "begun": pa.array(begun, pa.bool_()), "language": pa.array(languages, pa.int32()), "cells": pa.array(cells, columns["cells"]),
            })
            yield rows(len(total), WORD, {
                "word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64()), "final": pa.array([final[w] for w in total], pa.int64())
            })
        if id_type is not None:
            language, cell = np.nonzero(counts)
            yield rows(len(cell), CELL, {"language": pa.array(language.astype(np.int32)), "cell": pa.array(cell), "n": pa.array(counts[language, cell])})

    seen = cut(pairs.mapInArrow(run, schema))
    table = seen.where(F.col("part") == CELL).groupBy("cell", "language").agg(F.sum("n").alias("n")).toPandas()
    shared = probes.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy(np.int64) for c in ("cell", "language", "n")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*shared.value)
        for batch in batches:
            lists = batch.column(2)
            flat_cells, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.array([len(x) if x.is_valid else 0 for x in lists]))]).astype(int)
            foreign = [k is not None and model.other(k, flat_cells[at[i] : at[i + 1]]) for i, k in enumerate(batch.column(1).to_pylist())]
            hits = pa.array(np.flatnonzero(foreign), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(hits)], names=[id_col])

    mine = seen.where(F.col("part") == PAIR)
    foreign = mine.where(F.size("cells") > 0).select(id_col, "language", "cells").mapInArrow(judge, f"`{id_col}` {kind}").withColumn("foreign", F.lit(True))
    statistics = seen.where(F.col("part") == WORD).groupBy("word").agg(F.sum("n").alias("total"), F.sum("final").alias("final"))
    asked = mine.where("word is not null").select("word").distinct()
    known = asked.join(statistics, "word", "left").select("word", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("final", F.lit(0)).alias("final"))
    length = F.length("word")
    beginnings = (
        statistics.where((F.col("total") >= SEEN) & (length > 1))
        .select(F.explode(F.transform(F.sequence(F.lit(1), length - 1), lambda n: F.substring("word", F.lit(1), n))).alias("word"))
        .distinct()
        .withColumn("beginning", F.lit(True))
    )
    # an unclosed text's last word is itself among the counts, never as the end of a phrase
    hardly = (F.col("total") >= SEEN) & (F.col("final") < FINAL_SHARE * F.col("total"))
    fragment = F.coalesce("beginning", F.lit(False)) & (F.col("final") == 0) & (F.col("total") < SEEN)
    cuts = known.join(beginnings, "word", "left").where(hardly | fragment).select("word", F.lit(True).alias("cut"))
    late = F.coalesce("cut", F.lit(False)) | F.coalesce("begun", F.lit(False))
    more = F.array_compact(F.array(F.when(late, F.lit("truncated")), F.when(F.col("foreign"), F.lit("language"))))
    rank = F.array(*[F.lit(d) for d in ORDER])
    return (
        mine.select(id_col, "defects", "word", "begun")
        .join(cuts, "word", "left")
        .join(foreign.withColumnRenamed(id_col, "_id"), F.col(id_col).eqNullSafe(F.col("_id")), "left")
        .withColumn("_all", F.concat("defects", more))
        .select(id_col, F.filter(rank, lambda d: F.array_contains("_all", d)).alias("defects"))
        .where("size(defects) > 0")
        .withColumn("defect", F.col("defects")[0])
    )
