"""Problem 3: personal information inside free text.

Weak supervision. Wide patterns propose spans of five kinds (``email``, ``phone``, ``id_number``,
``address``, ``name``); labelers vote on each: formats, gazetteers and contexts on either side, some for
and some against. The votes of a span and a few of its own features make a small pattern of bits. The
patterns are counted over all rows; expectation-maximisation estimates the reliability of each labeler
and the posterior of each pattern, and a logistic classifier is trained on the patterns with these
posteriors. Spans at or above one half are mentions; of mentions that overlap the better, then the longer,
then the earlier stays.

Texts are read once. Only spans travel after that, and only pattern counts (at most 2 to the number of
bits for each kind) reach the driver.

Defined results: null, empty and blank contents have no mentions; an event that was delivered again counts
once; positions are code points of the stored content; placeholders replace the mentions and nothing else,
so that the rest stays as it is, and null content stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.plans.runtime import cut

KINDS = ("email", "phone", "id_number", "address", "name")
THRESHOLD = 0.5
EM_ROUNDS, FIT_ROUNDS = 60, 4000
#: Code points of the stretches within which overlapping mentions are compared.
STRETCH = 256

#: Given names, in small letters, without accents where they vary.
GIVEN = set(
    """yusuf ingrid peter leila anna lucía lucia tobias femke jonas owen marek dmitri mirela matteo priya bruno hugo greta zoë zoe
    kofi aldo sanna renata nadia chiara callum james john robert michael william david richard thomas charles mary
    patricia jennifer linda elizabeth susan jessica sarah karen emma olivia noah liam lucas ethan sophia mia daniel matthew andrew paul
    mark kevin brian laura julia anne marie claire sophie camille pierre jean louis antoine nicolas françois isabelle hans klaus stefan
    jürgen wolfgang sabine petra monika katrin heike lena felix maximilian carlos josé juan luis miguel antonio pedro maría carmen ana
    elena isabel sofía diego javier pablo ivan sergei alexei olga natalia tatiana svetlana wei li ming fatima ahmed mohammed omar aisha
    rajesh priyanka sanjay deepak sunita arjun oluwaseun chinedu ngozi kwame amara zbigniew agnieszka krzysztof katarzyna piotr malgorzata jan pavel
    tomas lukas lars bjorn erik astrid giulia marco francesca paolo giovanni mehmet ayse emre hiroshi yuki kenji sakura minh linh nguyen joão
    beatriz rafael thiago camila valentina mateo hannah emily grace jack harry george alice arthur ruth rachel samuel benjamin nina eva
    иван сергей алексей ольга наталья татьяна светлана анна мария елена дмитрий николай""".split()
)
#: Words that announce a mention of each kind, and words that announce other numbers.
NEAR = {
    "email": r"mail|contact|reach|reset|receipt|forward|\bcc\b|author|write|почт|联系|écrivez|escrib|correo|schreib|adresse|\bto\b|<\s*$|\(\s*$",
    "phone": r"phone|call|tel\b|tel\"|\"tel|text\s|mobile|fax|numéro|nummer|número|teléfono|telefon|téléphone|телефон|тел\.|电话|手机|@\S+[,;]\s*$|\.[a-z]{2,},\s*$|\bor\s*$|back at",
    "id_number": r"passport|national id|\bid\b|ssn|social security|tax|licen[cs]e|insurance|ausweis|steuer|dni|nif|\bnie\b|паспорт|инн|снилс|身份证|护照|pièce|permis|document|verification|identity|form|registered|booking|angaben|证件",
    "address": r"ship|deliver|lives? at|resid|address|enviar|livrer|адрес|wohn|bitte an|ship_to|送|寄|住|moved to|envoyer|liefer|резид|прожива|lauten",
    "against": r"order|tracking|isbn|invoice|total|\blot\b|\bref\b|build|batch|case|rev|error|version|parcel|nr|номер заказа|订单|pkg|icon|#\s*$|0x\s*$|commande|bestell|pedido|заказ",
}
_NEAR = {k: re.compile(v, re.I) for k, v in NEAR.items()}

_TOKEN = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
_NAME = rf"(?:{_TOKEN}(?:[ ][^\W\d_]\.)?[ ]{_TOKEN}|[^\W\d_]\.(?:[ ][^\W\d_]\.)?[ ]{_TOKEN}|{_TOKEN},[ ]{_TOKEN}(?:[ ][^\W\d_]\.)?)"
#: Phrases and titles before a person's name.
_TITLE = r"(?:Dr|Mr|Mrs|Ms|Miss|Prof|Herrn?|Frau|Mme|Mlle|Sr|Sra|Srta|Don|Doña|[Ss]eñora?|[Mm]adame|[Mm]onsieur|г-н|г-жа|господин|госпожа)\b\.?"
_PHRASE = (
    r"(?:[Mm]y name is|[Nn]ame is|[Jj]e m['’]appelle|[Mm]on nom est|[Ii]ch heiße|[Mm]ein [Nn]ame ist|[Mm]e llamo|[Mm]i nombre es|"
    r"[Мм]еня зовут|[Мм]о[её] имя|我叫|我的名字是|姓名[:：]?|for user|[Uu]ser:|[Ss]poke with|[Ss]poke to|[Aa]uthor:|[Ss]igned(?: off)?(?: by:?|:)|"
    r"booking is under|[Rr]each|(?:demandez|appelez|contactez|contacter) M\.|[Rr]egards,|[Ss]incerely,|[Aa]ttn:?)\s*|"
    r"\"(?:contact|name|customer|author|user|patient|person)\"\s*:\s*\""
)
_NAMED = re.compile(rf"(?P<phrase>{_PHRASE})(?P<title1>{_TITLE}\s+)?(?P<n1>{_NAME})|(?<![\w.])(?P<title2>{_TITLE}\s+)(?P<n2>{_NAME}|[A-ZÀ-ÞА-Я]{_TOKEN})")
_GIVEN_FIRST = re.compile(rf"(?<![\w@.\-])({_TOKEN})(?:[ ][^\W\d_]\.)?[ ]({_TOKEN})(?![\w@])")
#: Without any of these (phrases in small letters, titles as they are) no name is announced. They are
#: beginnings of what the patterns accept, without the white space that may follow.
_NAME_HINTS = tuple("name|appelle|mon nom|heiße|llamo|nombre|зовут|имя|叫|名|user|spoke|author|signed|booking|reach|demandez|appelez|contact|regards|sincerely|attn|customer|patient|person".split("|"))
_TITLE_HINTS = tuple("Dr|Mr|Ms|Miss|Prof|Herr|Frau|Mme|Mlle|Sr|Don|Doña|eñor|adame|onsieur|г-н|г-жа|господин|госпожа".split("|"))
#: Without any of these no address is given; the words of streets stand after white space.
_ADDRESS_HINTS = tuple("straße|strasse|str.|weg|allee|platz|gasse|ufer|damm|Calle|Avenida|Avda.|Plaza|Paseo|Camino|C/|Box|Postfach|Apartado|BP|ул.|улица|пр.|проспект|пер.|号".split("|"))
_STREETS = r"Street|Road|Lane|Avenue|Close|Drive|Court|Way|Square|Terrace|Boulevard|Place|Crescent|Row|St\b\.?|Rd\b\.?|Ave\b\.?|Ln\b\.?|Dr\b\.?|Blvd\b\.?"
_RUES = "rue|avenue|boulevard|place|chemin|allée|impasse|quai"
_STREET_GATE = re.compile(rf"\s(?:{_STREETS}|(?:{_RUES})\s)")


_EMAIL_LOCAL = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9.+%_-]*\s?@\s?(?:[A-Za-z0-9-]+\.)+[A-Za-z][A-Za-z0-9]+")
#: Words for the sign of an address, and the forms in which they stand there.
_AT_WORDS = "at|arroba|chez|собака"
_AT_SPELLED = rf"\s+(?:{_AT_WORDS})\s+|\s*[\[({{]\s*at\s*[\])}}]\s*"
_DOT_SPELLED = r"\s+(?:dot|punkt|punto|point|точка)\s+|\s*[\[({]\s*dot\s*[\])}]\s*"
#: Where the sign is spelled, the dots may be plain.
_SPELLED = re.compile(
    rf"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._+%-]*(?:(?P<at>{_AT_SPELLED})|\s*@\s*)"
    rf"[A-Za-z0-9-]+(?:(?:{_DOT_SPELLED}|\.)[A-Za-z0-9-]+)*(?:{_DOT_SPELLED}|(?(at)\.|(?!)))[A-Za-z]{{2,}}",
    re.I,
)
#: What every match of both patterns has: a sign or word and a first dot. Without it no text is searched.
_AT_GATE = re.compile(rf"(?:@|[\s\[({{](?:{_AT_WORDS})[\s\])}}])[\s\])}}]*[A-Za-z0-9-]+(?:{_DOT_SPELLED}|\.)[A-Za-z0-9-]", re.I)
_FILE = re.compile(r"\.(?:png|jpe?g|gif|svg|py|js|ts|md|txt|json|csv|zip|tar|gz|html?)$", re.I)
_AT = re.compile(rf"@|\b(?:{_AT_WORDS})\b", re.I)

_RUN = re.compile(r"(?<![A-Za-z0-9_.\-#])(?:\+|\(\+?)?\d(?:[ ().\-/]{0,2}\d){6,16}(?:\s?(?:ext|x|доб)\.?\s?\d{1,5})?(?![A-Za-z0-9_])", re.I)
#: Seventeen digits and a digit or X, together or grouped; ``_RUN`` ends before these.
_RESIDENT = re.compile(r"(?<![A-Za-z0-9_.\-#])\d(?:[ .\-]?\d){16}[ .\-]?[\dXx](?![A-Za-z0-9_])")
#: Groupings of telephone numbers.
_PHONE_FORMATS = re.compile(
    r"^(?:\+\d{8,15}|\+\d{1,3}(?:[ .\-/]\(?\d{1,5}\)?){2,6}|00\d{2}(?:[ .\-]?\d{2,6}){2,5}|\(\d{2,5}\)[ ]?\d{3,4}[ \-.]?\d{3,4}|\d{3}([ \-.])\d{3}\1\d{4}|"
    r"0\d{2,4}[ /\-]\d{3,8}(?:[ \-]\d{3,5})?|0\d(?:([ .\-])\d{2})(?:\2\d{2}){3}|1[3-9]\d{9}|8[ \-(]*\d{3}[) \-]*\d{3}[ \-]\d{2}[ \-]\d{2})(?:\s?(?:ext|x|доб)\.?\s?\d{1,5})?$",
    re.I,
)
#: Groupings of identity numbers.
_ID_FORMATS = re.compile(
    r"^(?:\d{3}([ \-])\d{2}\1\d{4}|(?:19|20)\d{6}-\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{6}[ \-]\d{2,6}|\d{17}[\dXx]|\d{6}([ .\-])\d{8}\2\d{3}[\dXx]|\d{3}-\d{3}-\d{3} \d{2}|\d{4} \d{6})$"
)
_CODE = re.compile(
    r"(?<![A-Za-z0-9_.\-#])(?:[A-Z]{1,3}\d{3,}[A-Z0-9]{0,8}(?:-\d{2,6}){0,3}|[A-Z]\d{2}X\d{4,6}[A-Z]?|[A-Z]\d[A-Z0-9]{6,9}|[A-Z]{2}(?:[ ]?\d{2}){3}[ ]?[A-D]|\d{7,8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z])(?![A-Za-z0-9_\-])"
)
_ID_LABEL = re.compile(
    r"(?:passport|passeport|pasaporte|reisepass|паспорт|护照|national id|personal id|identity card|ssn|social security|tax id|tin|driver['’]?s? licen[cs]e|"
    r"licen[cs]e|führerschein|permis|insurance|nino|ausweis|personalausweis|steuer-?id|dni|nif|nie|инн|снилс|身份证|id card|identity|sécurité sociale|seguro)"
    r"(?:[- ]?(?:no|nr|number|num|numéro|nummer|número|n[.°º]))?\.?\s*[:：#]?\s*$",
    re.I,
)

_PLACE = r"[A-ZÀ-Þ][\w'’\-]*"
_CITY = rf"(?:,?\s+(?:\d{{4,6}}\s+{_PLACE}(?:\s{_PLACE})?|{_PLACE}(?:\s{_PLACE})?(?:,?\s+\d{{4,6}})?))"
_ADDRESS = re.compile(
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Wohnung|Appt\.?|Piso|кв\.)\s?\d+\w?,?\s+)?(?<![\w\-.])(?:"
    rf"\d{{1,4}}\s?[A-Za-z]?\s+(?:{_PLACE}\s+){{1,3}}(?:{_STREETS})"
    rf"|\d{{1,4}}\s?(?:bis|ter|[A-Za-z])?,?\s+(?:{_RUES})\s+(?:de\s+la\s+|de\s+l['’]|des?\s+|du\s+|d['’])?{_PLACE}"
    rf"|{_PLACE}(?:straße|strasse|str\.|weg|allee|platz|gasse|ufer|damm)\s+\d{{1,4}}\s?[a-z]?\b"
    rf"|(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|C/)\s+(?:de\s+(?:la\s+)?|del\s+)?{_PLACE},?\s+\d{{1,4}}"
    rf"|(?:P\.\s?O\.\s?Box|PO Box|Postfach|Apartado|BP)\s+\d{{1,6}}"
    rf"|(?:ул\.|улица|пр\.|проспект|пер\.)\s+[А-ЯЁA-Z][\w\-]*,?\s+(?:д\.\s?)?\d{{1,4}}"
    rf"|[\w一-鿿]{{2,12}}(?:路|街|大道|巷)\d{{1,4}}号"
    rf")(?:,?\s+(?:Apt\.?|Flat|Unit|Suite|#|кв\.)\s?\d+\w?)?(?:,\s*\d{{1,2}}\.?[ºª°]\s?[A-Z]?)?(?P<city>{_CITY})?"
)
_PAIR = re.compile(r"(?<=[a-z] )[A-Z][a-zà-ÿ]+ [A-Z][a-zà-ÿ]+(?![\w@])")


def bits(*votes: bool) -> int:
    return sum(bool(v) << i for i, v in enumerate(votes))


def _around(text: str, start: int, n: int = 64) -> str:
    return text[max(0, start - n) : start]


def _emails(text: str) -> Iterator[tuple[str, int, int, int]]:
    seen = set()
    for pattern, spelled in ((_EMAIL_LOCAL, False), (_SPELLED, True)):
        for m in pattern.finditer(text):
            if m.start() in seen:
                continue
            seen.add(m.start())
            span = m.group()
            before = _around(text, m.start())
            domain = _AT.split(span)[-1]
            proper = not _FILE.search(span) and not re.fullmatch(r"[\d.\sx]+\w?", domain) and bool(re.search(r"[A-Za-z]{2,}\s*$", domain))
            marked = "@" in span or bool(re.search(r"[\[({]|AT|DOT", span))
            local = bool(re.search(r"[._+\-\d]", span.split("@")[0].split(" ")[0])) or len(span.split("@")[0]) > 6
            against = bool(re.search(r"(?:pkg|icon|version|git|ssh|installed|install)\W*$", before + span.split("@")[0], re.I))
            yield "email", m.start(), m.end(), bits(not spelled, marked, proper, bool(_NEAR["email"].search(before)), local, against)


def _numbers(text: str) -> Iterator[tuple[str, int, int, int]]:
    for m in _RUN.finditer(text):
        span, start = m.group(), m.start()
        digits = sum(c.isdigit() for c in span)
        before = _around(text, start)
        label = bool(_ID_LABEL.search(before))
        close = before[-14:]
        against = bool(_NEAR["against"].search(close)) and not label
        dated = bool(re.fullmatch(r"(?:19|20)\d\d[-./]\d\d[-./]\d\d(?: \d\d)?", span))
        phone, ident = bool(_PHONE_FORMATS.match(span)), bool(_ID_FORMATS.match(span))
        near_phone = bool(_NEAR["phone"].search(before)) and not label
        near_id = bool(_NEAR["id_number"].search(before))
        yield "phone", start, m.end(), bits(phone, near_phone, span[0] in "+(" or span[:2] == "00", 9 <= digits <= 15, ident and not phone, against or dated, label)
        yield "id_number", start, m.end(), bits(ident, label, near_id, 8 <= digits <= 18, phone, against or dated, False)
    for m in _RESIDENT.finditer(text):
        before = _around(text, m.start())
        label = bool(_ID_LABEL.search(before))
        against = bool(_NEAR["against"].search(before[-14:])) and not label
        yield "id_number", m.start(), m.end(), bits(bool(_ID_FORMATS.match(m.group())), label, bool(_NEAR["id_number"].search(before)), True, False, against, False)


def _codes(text: str) -> Iterator[tuple[str, int, int, int]]:
    for m in _CODE.finditer(text):
        span, start = m.group(), m.start()
        if sum(c.isdigit() for c in span) < 5:
            continue
        before = _around(text, start)
        label = bool(_ID_LABEL.search(before))
        against = bool(_NEAR["against"].search(before[-14:])) and not label
        yield "id_number", start, m.end(), bits(True, label, bool(_NEAR["id_number"].search(before)), True, False, against, True)


def _addresses(text: str) -> Iterator[tuple[str, int, int, int]]:
    for m in _ADDRESS.finditer(text):
        before = _around(text, m.start())
        numbered = bool(re.search(r"\d", m.group()))
        against = bool(re.search(r"(?:lot|build|batch|case|rev|ref\.?|#|nr|version)\s*$", before, re.I))
        quoted = before[-1:] in "\"'(,:" or bool(re.search(r"(?:at|to|of|an|au|a|in|по адресу|goes to|到)\s*$", before))
        yield "address", m.start(), m.end(), bits(numbered, bool(m.group("city")), bool(_NEAR["address"].search(before)), quoted, against)


def _is_given(word: str) -> bool:
    return word.split("-")[0].lower() in GIVEN


def _names(text: str, announced: bool, given: bool) -> Iterator[tuple[str, int, int, int]]:
    seen = set()
    if announced:
        for m in _NAMED.finditer(text):
            n = "n1" if m.group("n1") else "n2"
            name, start = m.group(n), m.start(n)
            seen.update(range(start, m.end(n)))
            own = re.findall(_TOKEN, name)
            titled = bool(m.group("title1") or m.group("title2"))
            yield "name", start, m.end(n), bits(True, titled, any(_is_given(w) for w in own), all(w[0].isupper() for w in own), len(own) >= 2 or name[1:2] == ".")
    if given:
        for m in _GIVEN_FIRST.finditer(text):
            if m.start() not in seen and _is_given(m.group(1)) and m.group(1)[0].isupper() and m.group(2)[0].isupper():
                seen.update(range(m.start(), m.end()))
                yield "name", m.start(), m.end(), bits(False, False, True, True, True)
    for m in _PAIR.finditer(text):
        if m.start() not in seen:
            yield "name", m.start(), m.end(), bits(False, False, False, True, False)


_LETTERS = re.compile(r"[^\W\d_]{2,}")


def candidates(text: str | None) -> list[tuple[str, int, int, int]]:
    """Spans (kind, start, end, pattern of votes) that some pattern proposes."""
    if not text:
        return []
    low = text.lower()
    out = [*_numbers(text), *_codes(text)]
    if _AT_GATE.search(text):
        out += _emails(text)
    if any(h in text for h in _ADDRESS_HINTS) or _STREET_GATE.search(text):
        out += _addresses(text)
    announced = any(h in low for h in _NAME_HINTS) or any(h in text for h in _TITLE_HINTS)
    out += _names(text, announced, not GIVEN.isdisjoint(_LETTERS.findall(low)))
    return out


#: For each kind the names of its bits and, of those that are labelers, the rates at which they
#: are expected to be set in mentions and in other spans; the others are features of the final classifier only.
LABELERS = {
    "email": (("strict form", None), ("marked", (0.9, 0.5)), ("proper domain", (0.95, 0.1)), ("context", (0.7, 0.2)), ("local part", (0.7, 0.4)), ("other context", (0.02, 0.4))),
    "phone": (("form", (0.9, 0.1)), ("context", (0.8, 0.1)), ("prefix", (0.5, 0.1)), ("digits", (0.95, 0.6)), ("identity form", (0.05, 0.3)), ("other context", (0.02, 0.5)), ("identity label", (0.01, 0.2))),
    "id_number": (("form", (0.95, 0.1)), ("label", (0.6, 0.03)), ("context", (0.9, 0.1)), ("digits", None), ("phone form", (0.02, 0.4)), ("other context", (0.02, 0.5)), ("letters", None)),
    "address": (("number", (0.98, 0.5)), ("place", (0.8, 0.1)), ("context", (0.7, 0.1)), ("position", (0.8, 0.4)), ("other context", (0.02, 0.5))),
    "name": (("announced", (0.85, 0.05)), ("title", None), ("gazetteer", (0.8, 0.05)), ("cased", None), ("two words", (0.95, 0.3))),
}
#: Weight of these expectations against the spans that were counted.
PRIOR = 0.25


def reliabilities(kind: str, patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over two hidden classes: rates of each labeler's bit in true and in other spans, and posteriors."""
    used = [i for i, (_, expected) in enumerate(LABELERS[kind]) if expected]
    first = np.array([LABELERS[kind][i][1] for i in used])
    x = (patterns[:, None] >> np.array(used) & 1).astype(float)
    true, other, share = first[:, 0], first[:, 1], 0.5
    virtual = PRIOR * counts.sum() + 5
    posterior = np.zeros(len(patterns))
    for _ in range(EM_ROUNDS):
        a = np.log(share) + x @ np.log(true) + (1 - x) @ np.log(1 - true)
        b = np.log(1 - share) + x @ np.log(other) + (1 - x) @ np.log(1 - other)
        posterior = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
        p, q = posterior * counts, (1 - posterior) * counts
        true = (x.T @ p + virtual * first[:, 0]) / (p.sum() + virtual)
        other = (x.T @ q + virtual * first[:, 1]) / (q.sum() + virtual)
        share = float(np.clip((p.sum() + 1) / (counts.sum() + 2), 0.05, 0.95))
    return true, other, posterior


def classifier(kind: str, patterns: np.ndarray, counts: np.ndarray) -> dict[int, float]:
    """Score of each pattern by a logistic classifier of all bits, fitted to the posteriors."""
    _, _, posterior = reliabilities(kind, patterns, counts)
    n = len(LABELERS[kind])
    x = np.hstack([(patterns[:, None] >> np.arange(n) & 1).astype(float), np.ones((len(patterns), 1))])
    weight = np.sqrt(counts) / np.sqrt(counts).sum()
    w = np.zeros(n + 1)
    for _ in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (weight * (p - posterior)) + 1e-4 * w)
    return dict(zip(patterns.tolist(), (1 / (1 + np.exp(-x @ w))).tolist()))


_DDL = "session_id string, event_id string, kind string, start_pos int, end_pos int, pattern int"


def find_mentions(events: DataFrame) -> DataFrame:
    """Mentions ``session_id, event_id, kind, start_pos, end_pos, score`` of the distinct events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, spans = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = candidates(text)
                spans += own
                at += [i] * len(own)
            take = pa.array(at, pa.int64())
            kinds, starts, ends, patterns = zip(*spans) if spans else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(kinds, pa.string())]
                + [pa.array(c, pa.int32()) for c in (starts, ends, patterns)],
                names=["session_id", "event_id", "kind", "start_pos", "end_pos", "pattern"],
            )

    found = cut(events.select("session_id", "event_id", "content").mapInArrow(run, _DDL).distinct())
    counts = found.groupBy("kind", "pattern").count().collect()  # at most 2 ** 7 patterns of 5 kinds
    scores: list[tuple[str, int, float]] = []
    for kind in KINDS:
        own = [(r["pattern"], r["count"]) for r in counts if r["kind"] == kind]
        if own:
            patterns, n = (np.array(c) for c in zip(*sorted(own)))
            scores += [(kind, p, s) for p, s in classifier(kind, patterns, n.astype(float)).items() if s >= THRESHOLD]
    table = events.sparkSession.createDataFrame(
        scores, T.StructType([T.StructField("kind", T.StringType()), T.StructField("pattern", T.IntegerType()), T.StructField("score", T.DoubleType())])
    )
    kept = found.join(F.broadcast(table), ["kind", "pattern"])  # at most 640 rows
    # of mentions that overlap the best stays; they share a stretch of the text, which holds few spans
    better = F.struct("score", F.col("end_pos") - F.col("start_pos"), -F.col("start_pos"), "kind")
    stretch = F.explode(F.sequence(F.expr(f"start_pos div {STRETCH}"), F.expr(f"(end_pos - 1) div {STRETCH}"))).alias("stretch")
    w = Window.partitionBy("session_id", "event_id", "stretch")
    placed = kept.withColumn("b", better).select("*", stretch)
    spans = placed.withColumn("spans", F.collect_list(F.struct("start_pos", "end_pos", "b")).over(w))
    beaten = F.exists(
        "spans",
        lambda s: (s["start_pos"] < F.col("end_pos")) & (F.col("start_pos") < s["end_pos"]) & (s["b"] > F.col("b")),
    )
    columns = ["session_id", "event_id", "kind", "start_pos", "end_pos", "score"]
    return spans.groupBy(*columns).agg(F.bool_or(beaten).alias("beaten")).where(~F.col("beaten")).select(*columns)


def replace_mentions(events: DataFrame, mentions: DataFrame) -> DataFrame:
    """``session_id, event_id, content`` of the distinct events, with ``[KIND]`` in place of each mention."""
    spans = mentions.groupBy("session_id", "event_id").agg(
        F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", F.upper("kind").alias("kind")))).alias("spans")
    )
    one = events.groupBy("session_id", "event_id").agg(F.min("content").alias("content"))
    # code points: Spark counts characters of a string the same way
    built = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.concat(a["out"], F.substring("content", a["at"] + 1, s["start_pos"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"),
            s["end_pos"].alias("at"),
        ),
    )
    rest = F.substring("content", built["at"] + 1, F.length("content"))
    return one.join(spans, ["session_id", "event_id"], "left").select(
        "session_id",
        "event_id",
        F.when(F.col("spans").isNull(), F.col("content")).otherwise(F.concat(built["out"], rest)).alias("content"),
    )
