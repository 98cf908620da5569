"""Problem 2: abusive, hateful or sexual language.

A factorization machine over hashed terms scores every window of every sentence; a text's score is that of its
worst window. Terms are all words after disguises are undone (invisible signs, look-alike letters, digits and
signs for letters, spaced or stretched letters, starred letters), their character n-grams and all pairs of
neighbouring words; signs of Chinese are words. No list of words decides what is scored, and none is a term.

What the machine is fitted on is bounded, and all of it rests on the judged sample:

* the judged sample itself, at most MAX_LABELS rows in the order of their ids;
* weak labels. A small machine (the teacher) learns from the judged sample alone how a general word list's senses
  (insult, group of people, threat, addressed person ...) offend together. It then labels WEAK_ROWS events of the
  corpus, those first by a hash of their key and of at most WEAK_CHARS characters, and COMBINATIONS combinations of
  the list's words for each pair of senses. Where the teacher is not sure, nothing is taken;
  nor
  where they are against nobody (no insult, addressed person, group or sexual word beside them); combinations
  of such words are shown as harmless, as are windows without any word of the list that could offend.

So the list only carries to other words and languages what the judged sample says: with its labels shuffled the
teacher is sure of nothing that offends, and nothing is found.

Everything else covers all rows. The model (DIM weights and DIM times RANK factors) has a fixed size.

Defined results: null, empty and blank contents have score 0; an event that was delivered again counts
once; labels that are null are left out; without any label of either kind every score is 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.tokens import session_facts

MAX_LABELS = 50_000
#: Events of the corpus that get weak labels, and the length up to which an event can be one of them.
WEAK_ROWS, WEAK_CHARS = 30_000, 2_000
#: Word combinations for each pair of senses.
COMBINATIONS = 60
#: Of the windows that are weakly labelled as harmless every n-th is taken, with n times the weight.
EVERY = 12
#: The teacher's probability from which a weak label is taken, for and against.
SURE, SURE_NOT = 0.7, 0.2
#: Harmless windows that occur so often are all taken, with the root of their number as weight.
OFTEN = 4
#: Scores of weakly harmless windows that are shown again: below, nothing is to be learned; above, the teacher may err.
DOUBT = (0.1, 0.95)
#: Rounds of the machine that only tells which these are.
DOUBT_EPOCHS = 12
#: Weight of a window that is weakly labelled as offending.
WEAK_WEIGHT = 5.0
DIM, RANK = 1 << 18, 8
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 512, 0.15, 1e-5, 7
THRESHOLD = 0.4
#: Tokens of a window, and the step to the next.
WINDOW, STEP = 14, 7
#: Lengths of character n-grams; values of n-grams (of a word together) and of pairs of words, where a word has 1.
GRAMS, GRAM_VALUE, PAIR_VALUE = (3, 4, 5), 0.7, 0.5
CACHE_ENTRIES = 200_000

#: A general word list of six languages by sense, in small letters; read by the teacher only.
SENSES = {
    "insult": """idiot idiots idiotic moron morons imbecile imbeciles cretin cretins dumbass dumbasses dumbasss scumbag scumbags jackass
        jackasses asshole assholes arsehole bitch bitches bastard bastards loser losers retard retards retarded whore slut sluts wanker
        twat cunt prick dickhead shithead motherfucker fucktard halfwit dimwit nitwit numbskull bonehead degenerate lowlife
        vollidiot vollidioten idioten trottel depp hurensohn hurensöhne arschloch arschlöcher wichser schlampe fotze missgeburt drecksau
        drecksack spast spasti mistkerl schwachkopf dummkopf vollpfosten arschgeige penner miststück
        connard connards connasse salope salopes enculé enculés abruti abrutis crétin crétins débile débiles bâtard pute putain ordure
        salaud salauds imbécile imbéciles idiote pétasse raclure
        idiota gilipollas imbécil imbéciles cabrón cabrones puta putas pendejo pendejos idiotas estúpido estúpida estúpidos mierdoso
        subnormal zorra malparido hijoputa capullo maricón maldito perra
        идиот идиоты идиотка дебил дебилы урод уроды сволочь сволочи мразь тварь твари ублюдок ублюдки сука суки мудак мудаки козёл козел
        придурок придурки тупица кретин скотина гад падла гнида гандон пидор пидорас чмо шлюха дура дурак шалава выродок""",
    "nasty": """stupid ugly dumb lazy useless worthless pathetic filthy disgusting brainless miserable fat smelly dirty rotten spineless
        braindead clueless incompetent revolting trashy
        dumm dumme dummer hässlich hässlicher hässliche wertlos wertloser wertlose nutzlos nutzloser nutzlose dreckig dreckiger dreckige
        faul fauler blöd blöde blöder erbärmlich erbärmlicher widerlich widerlicher ekelhaft
        stupide stupides con cons conne connes bête moche laid inutile inutiles nul nulle minable pathétique sale sales dégoûtant dégoûtante répugnant fainéant
        inútil inútiles feo fea asqueroso asquerosa patético patética sucio sucia tonto tonta vago vaga miserable repugnante
        тупой тупая тупые уродливый жалкий жалкая никчёмный никчемный никчёмная мерзкий мерзкая бесполезный грязный вонючий ленивый""",
    "group": """immigrants immigrant refugees refugee foreigners foreigner women woman girls gays gay lesbians lesbian trans transgender
        muslims muslim jews jew jewish christians asians asian arabs arab africans mexicans disabled         migrants migrant gypsies gypsy homeless elderly ausländer flüchtlinge flüchtling frauen
        lesben juden muslime migranten behinderte zigeuner         étrangers immigrés réfugiés femmes homosexuels gays juifs musulmans arabes migrants handicapés gitans         extranjeros inmigrantes refugiados mujeres homosexuales gais judíos musulmanes árabes discapacitados gitanos         беженцы беженцев иммигранты иммигрантов мигранты мигрантов женщины женщин геи геев евреи евреев мусульмане мусульман инвалиды
        инвалидов цыгане приезжие приезжих иностранцы иностранцев старики стариков бабы""",
    "dehuman": """vermin subhuman subhumans parasites parasite rats cockroaches animals beasts disease plague filth scum trash garbage
        criminals thieves savages apes monkeys pigs inferior breed infest invaders
        ungeziefer untermenschen parasiten ratten tiere abschaum dreck pack gesindel seuche verbrecher schmarotzer schweine
        vermine parasites cafards rats animaux racaille ordures déchets criminels voleurs sauvages sous-hommes maladie
        alimañas parásitos ratas cucarachas animales escoria basura criminales ladrones salvajes plaga infrahumanos
        паразиты паразит крысы тараканы животные скот мусор отбросы преступники воры нелюди чума зараза недочеловеки грязь""",
    "expel": """deport deported exterminate exterminated gas gassed eradicate expel expelled hate despise hang lynch burn
        ban banned eliminate
        vertreiben vergasen ausrotten abschieben hasse hassen verbrennen vernichten 
        expulser exterminer déporter brûler gazer déteste haïs hais éliminer 
        expulsar exterminar deportar quemar odio eliminar 
        выгнать истребить уничтожить ненавижу депортировать сжечь вышвырнуть""",
    "threat": """kill kills beat smash break stab shoot strangle choke burn hurt destroy murder rape punch bleed bloody legs teeth face
        neck throat skull grave coffin hunt suffer dead kneecaps bones
        umbringen töten schlag schlage schlagen brechen breche abstechen zähne fresse verrecken verreck erwürgen knochen stirb
        tuer tue tuerai buter crever crève casser casserai gueule étrangler égorger frapper
        matar mataré mato partir partiré romper romperé cara piernas reventar muérete muerte estrangular degollar
        убью убить зарежу морду разобью сломаю сдохни сдохнешь придушу ноги зубы прибью урою пожалеешь закопаю""",
    "harm": """yourself sterben toi-même suicide-toi suicídate mátate убейся повесься сдохни kys""",
    "explicit": """fuck fucking fucked cock cocks dick dicks pussy pussies tits boobs blowjob handjob nudes porn porno sext sexting horny cum
        cumming moaning clit orgasm dildo milf masturbate masturbating fick ficken gefickt titten schwanz muschi nacktbilder geil geile
        pornos möse nichons bander niquer bite chatte porno follar follarte polla coño tetas chúpamela cachonda correrme verga
        трахнуть трахать трахну хуй член пизда сиськи ебать ебал ебу минет отсосать отсоси порно""",
    "sexual": """sex sexual nude naked tit boob boobies ass arse bra thong underwear vagina penis anal hardcore stripper erection hard sucked suck
        sucking lick licking nipples nipple slutty kinky undress bed nackt blasen seins nue nues nu sucer suce cul baiser
        baise desnuda desnudas desnudo chupar chupa culo голая голые голую секс жопа попка раздеться""",
    "curse": """fuck fucking fucked shit shitty damn hell screw crap piss pissed bullshit off scheiße scheiss verpiss fick fresse halt maul
        merde bordel ferme gueule dégage nique mierda joder jódete cállate vete lárgate блядь бля нахуй хрен пошёл пошел заткнись отвали
        shut""",
    "you": """you your yours yourself u ur youre ya du dich dir dein deine deiner deinem deinen euch ihr tu te toi ton ta tes vous votre vos
        ti tú tus usted ustedes vosotros os eres ты тебя тебе тобой твой твоя твоё твою твои вы вас вам ваш ваша вами""",
    "me": """i me my mine am im ich mir mich mein meine je moi mon ma mes yo mi mis мне меня мой моя я""",
    "they": """they them their these those sie ihnen ils elles eux leur ellos ellas они их им all every every-one alle tous toutes todos
        todas все""",
}
#: Phrases of each sense that several words make, or that are written without spaces.
PHRASES = {
    "insult": r"piece of shit|waste of (?:air|space|oxygen)|son of a bitch|stück scheiße|fils de pute|tas de merde|hijo de (?:la gran )?puta|pedazo de mierda|кусок (?:говна|дерьма)|сукин сын|傻逼|白痴|蠢货|混蛋|王八蛋|贱人|婊子|狗娘养的|废物|智障|脑残|笨蛋|蠢猪|畜生",
    "group": r"(?:old|gay|disabled|black|brown|trans) people|(?:外国|外地|残疾|老年|犹太|黑|穆斯林|乡下)人|难民|移民|女人|女性|同性恋者?",
    "dehuman": r"害虫|寄生虫|老鼠|蟑螂|畜生|劣等|人渣|垃圾|渣滓|瘟疫|罪犯|小偷|不是人",
    "expel": r"wiped out|driven out|滚出|赶出|消灭|灭绝|驱逐|憎恨|滚回",
    "threat": r"打死|杀了?你|弄死|打断|揍|砍死|宰了|掐死|付出代价",
    "harm": r"kill yourself|drop dead|better off dead|bring dich um|tue-toi|pends-toi|убей себя|去死",
    "sexual": r"脱光|裸体|上床",
    "explicit": r"having sex|裸照|做爱|操我|鸡巴|奶子|色情|口交|性交|约炮|干你",
    "curse": r"fuck off|screw you|shut up|piss off|get lost|go to hell|verpiss dich|halt die fresse|halt's maul|va te faire|ta gueule|ferme-la|vete a la mierda|que te jodan|пош[её]л (?:на|к)|иди на|闭嘴|滚|他妈|操你妈",
    "you": r"你们?|您",
    "me": r"我们?",
    "they": r"他们|她们|它们|所有",
}

_SENSE_OF: dict[str, list[int]] = {}
SENSE_NAMES = tuple(SENSES)
for _i, _words in enumerate(SENSES.values()):
    for _word in _words.split():
        _SENSE_OF.setdefault(_word, []).append(_i)
_PHRASES = [(SENSE_NAMES.index(k), re.compile(v)) for k, v in PHRASES.items()]
_ANY_PHRASE = re.compile("|".join(PHRASES.values()))
#: Words that starred letters can stand for.
_STARRED = sorted({w for s in ("insult", "explicit", "sexual", "curse") for w in SENSES[s].split() if w.isascii()})

#: Cyrillic and Greek letters that look like Latin ones, and signs that stand for letters.
LOOKALIKES = dict(zip("асеорхуіјѕкмтвнАВСЕНКМОРТХУαοερικυν", "aceopxyijskmtbhABCEHKMOPTXYaoepikuv"))
LEET = dict(zip("013457@$!|", "oieastasil"))
_SPACED = re.compile(r"(?<![^\W\d_])([^\W\d_](?:([ .\-_*])[^\W\d_])(?:\2[^\W\d_]){2,})(?![^\W\d_])")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\u180e\ufe00-\ufe0f]")
#: What a text must have for the patterns below to match, which are slower.
_TWO_SCRIPTS = re.compile(r"[A-Za-z][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-z]")
_APART = re.compile(r"[ .\-_*][^\W\d_]([ .\-_*])[^\W\d_]\1")
_SIGN = re.compile(r"[0134578@$!|*][a-z*]")
_THRICE = re.compile(r"(.)\1\1")
_MIXED = re.compile(r"(?<!\w)\w*(?:[A-Za-z][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z])\w*")
_SIGNED = re.compile(r"(?<![A-Za-z])[A-Za-z]*(?:[A-Za-z][0134578@$!|*]+(?=[A-Za-z*])|(?<![\w.-])[0134578@$](?=[A-Za-z]{2}))[A-Za-z0134578@$!|*]*")
_WORD = r"[^\W\d_㐀-鿿]+(?:['’-][^\W\d_㐀-鿿]+)*"
#: Words, signs of Chinese, and ends of sentences.
_TOKEN = re.compile(_WORD + r"|[㐀-鿿]|[.!?](?=\s|$)|[\n。！？]")
_ASCII_TOKEN = re.compile(r"[a-z]+(?:['-][a-z]+)*|[.!?](?=\s|$)|\n")
_LETTERS = re.compile(_WORD)
_ENDS = frozenset(".!?\n。！？")


def undisguise(text: str) -> str:
    """The text in small letters with disguised words written out."""
    if not text.isascii():
        if _INVISIBLE.search(text):
            text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if _TWO_SCRIPTS.search(text):
            text = _MIXED.sub(lambda m: "".join(LOOKALIKES.get(c, c) for c in m.group()), text)
    text = text.lower()
    if _APART.search(text):
        text = _SPACED.sub(lambda m: m.group(1).replace(m.group(2), ""), text)
    if _SIGN.search(text):
        text = _SIGNED.sub(_unsigned, text)
    if _THRICE.search(text):
        text = _LETTERS.sub(_unstretched, text)
    return text


def _unsigned(m: re.Match[str]) -> str:
    word = m.group()
    if "*" in word:
        pattern = re.compile("".join(".+" if len(p) > 1 else "." if p == "*" else re.escape(p) for p in re.findall(r"\*{3,}|.", word)) + "$")
        return next((x for x in _STARRED if pattern.match(x)), word)
    body = word.rstrip("!|")
    plain = "".join(LEET.get(c, c) for c in body)
    return plain + word[len(body) :] if plain in _SENSE_OF else word


def _unstretched(m: re.Match[str]) -> str:
    if not _STRETCH.search(m.group()):
        return m.group()
    once, twice = _STRETCH.sub(r"\1", m.group()), _STRETCH.sub(r"\1\1", m.group())
    return twice if twice in _SENSE_OF else once


def tokens_of(text: str) -> list[str]:
    """Words and ends of sentences of a text, disguises undone."""
    plain = undisguise(text)
    return (_ASCII_TOKEN if plain.isascii() else _TOKEN).findall(plain)


def windows(tokens: list[str]) -> list[tuple[int, int]]:
    """First and last but one place of each window of the sentences."""
    out, start = [], 0
    for i, t in enumerate([*tokens, "."]):
        if t in _ENDS:
            n = i - start
            if n:
                at = 0
                while at + WINDOW < n:
                    out.append((start + at, start + at + WINDOW))
                    at += STEP
                out.append((start + max(0, min(at, n - WINDOW)), i))
            start = i + 1
    return out


_MASK = np.uint64(DIM - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_cells(word: str) -> tuple[int, list[int]]:
    """The hash of a word and the cells of its n-grams."""
    h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    padded = f"<{word}>"
    grams = {padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1)} if len(word) > 1 else ()
    return h, [xxhash.xxh3_64_intdigest(g.encode("utf-8", "surrogatepass"), 1) % DIM for g in sorted(grams)]


def pair_cells(hashes: np.ndarray) -> np.ndarray:
    """Cells of neighbouring words by the hashes of the words."""
    x = (hashes[:-1] * _MIX) ^ (hashes[1:] >> np.uint64(7)) ^ hashes[1:]
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return (x >> np.uint64(17)) & _MASK


def expand(words: list[str], cache: dict[str, tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Cells and values of a window."""
    cells: list[int] = []
    values: list[float] = []
    hashes = []
    for w in words:
        known = cache.get(w)
        if known is None:
            known = cache[w] = word_cells(w)
        h, grams = known
        hashes.append(h)
        cells.append(h % DIM)
        values.append(1.0)
        cells += grams
        values += [GRAM_VALUE / max(1, len(grams))] * len(grams)
    pairs = pair_cells(np.array(hashes, np.uint64))
    return np.concatenate([np.array(cells, np.int32), pairs.astype(np.int32)]), np.array(values + [PAIR_VALUE] * len(pairs), np.float32)


class FactorizationMachine:
    """score = bias + sum of weights + sum over pairs of terms of the product of their factors."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def score(self, cells: np.ndarray, values: np.ndarray) -> float:
        v = self.factors[cells] * values[:, None]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[cells] @ values + 0.5 * (s @ s - (v * v).sum()))

    @classmethod
    def train(cls, samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, size: int, rate: float = RATE, decay: float = DECAY, epochs: int = EPOCHS) -> FactorizationMachine:
        """Fit by AdaGrad on the weighted log loss, in batches of BATCH; cells that no sample has say nothing."""
        rng = np.random.default_rng(SEED)
        lengths = np.array([len(c) for c, _ in samples])
        used, flat = np.unique(np.concatenate([c for c, _ in samples]), return_inverse=True)
        flat = flat.astype(np.int32)
        values = np.concatenate([v for _, v in samples])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        w, v = np.zeros(len(used)), rng.normal(0, 0.05, (len(used), RANK))
        gw, gv, bias, gb = np.full(len(used), 1e-3), np.full((len(used), RANK), 1e-3), 0.0, 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(samples))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                n = lengths[rows]
                place = np.repeat(ends[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                of = np.repeat(np.arange(len(rows)), n)
                cells, own = np.unique(flat[place], return_inverse=True)
                x = values[place]
                vx = v[cells][own] * x[:, None]
                s = np.stack([np.bincount(of, vx[:, k], len(rows)) for k in range(RANK)], axis=1)
                z = bias + np.bincount(of, w[cells][own] * x, len(rows)) + 0.5 * ((s * s).sum(1) - np.bincount(of, (vx * vx).sum(1), len(rows)))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) * weight[rows]
                gx = g[of] * x
                dw = np.bincount(own, gx, len(cells)) + decay * w[cells]
                dv = np.stack([np.bincount(own, gx * (s[of, k] - vx[:, k]), len(cells)) for k in range(RANK)], axis=1) + decay * v[cells]
                gb += g.sum() ** 2
                gw[cells] += dw * dw
                gv[cells] += dv * dv
                bias -= rate * g.sum() / np.sqrt(gb)
                w[cells] -= rate * dw / np.sqrt(gw[cells])
                v[cells] -= rate * dv / np.sqrt(gv[cells])
        weights, factors = np.zeros(size, np.float32), np.zeros((size, RANK), np.float32)
        weights[used], factors[used] = w, v
        return cls(float(bias), weights, factors)


class Teacher:
    """Labels windows by the senses of their words, as the judged sample says."""

    #: Senses of which one must be there: words against things alone (mild swearing) offend nobody.
    AIMED = frozenset(SENSE_NAMES.index(s) for s in ("insult", "you", "they", "group", "explicit", "sexual", "harm"))
    #: Senses of which one must be there: words that only address somebody or name things say nothing bad.
    HARMFUL = frozenset(SENSE_NAMES.index(s) for s in ("insult", "nasty", "dehuman", "expel", "threat", "harm", "explicit", "sexual", "curse"))
    #: Its own epochs and penalty: it has few terms and few samples.
    EPOCHS, DECAY = 60, 2e-3

    def __init__(self, parts: list[list[str]], labels: np.ndarray):
        self.cache: dict[tuple[int, ...], float] = {}
        samples = [self.features(p) for p in parts]
        self.machine = FactorizationMachine.train(samples, labels, np.ones(len(labels)), len(SENSE_NAMES) + 1, 0.15, self.DECAY, self.EPOCHS)

    @staticmethod
    def senses(words: list[str]) -> tuple[int, ...]:
        found = set()
        for w in words:
            own = _SENSE_OF.get(w) or (_SENSE_OF.get(w[:-2]) if w[-2:] in ("'s", "’s") else None)
            if own:
                found.update(own)
        text = re.sub(r"(?<=[㐀-鿿]) (?=[㐀-鿿])", "", " ".join(words))
        if _ANY_PHRASE.search(text):
            found.update(k for k, p in _PHRASES if p.search(text))
        return tuple(sorted(found))

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.senses(words)
        return np.array([*found, len(SENSE_NAMES)]), np.ones(len(found) + 1)

    def aimed(self, words: list[str]) -> bool:
        return not self.AIMED.isdisjoint(self.senses(words))

    def probability(self, words: list[str]) -> float:
        key = self.senses(words)
        if self.HARMFUL.isdisjoint(key):
            return 0.0
        if key not in self.cache:
            z = self.machine.score(np.array([*key, len(SENSE_NAMES)]), np.ones(len(key) + 1))
            self.cache[key] = 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))
        return self.cache[key]


def judged_windows(labels: list[tuple[str, bool]]) -> tuple[list[list[str]], np.ndarray]:
    """Windows of the judged sample: all of a harmless text, and a short offending text as a whole."""
    parts, y = [], []
    for text, flagged in labels:
        tokens = tokens_of(text)
        words = [t for t in tokens if t not in _ENDS]
        own = [words] if flagged and len(words) <= 2 * WINDOW else [tokens[a:b] for a, b in windows(tokens)]
        own = [p for p in own if p]
        parts += own
        y += [flagged] * len(own)
    return parts, np.array(y, float)


def train(labels: list[tuple[str, bool]], corpus: list[str] = ()) -> FactorizationMachine | None:
    """The machine of a judged sample and of weakly labelled texts; None where the sample lacks one of the labels."""
    if len({y for _, y in labels}) < 2:
        return None
    parts, y = judged_windows(labels)
    teacher = Teacher(parts, y)
    weight = np.full(len(y), 3.0)
    rng = np.random.default_rng(SEED)
    weak: dict[tuple[str, ...], int] = {}
    for text in corpus:
        tokens = tokens_of(text)
        for a, b in windows(tokens):
            key = tuple(tokens[a:b])
            weak[key] = weak.get(key, 0) + 1
    found = [(p, teacher.probability(list(p))) for p in weak]
    harmless = [p for p, q in found if q <= SURE_NOT]
    often = [(p, 0.0, float(np.sqrt(weak[p]))) for p in harmless if weak[p] >= OFTEN]
    seldom = [p for p in harmless if weak[p] < OFTEN]
    against = often + [(p, 0.0, float(EVERY)) for p in seldom[::EVERY]]
    rest = [p for i, p in enumerate(seldom) if i % EVERY]
    more = [(p, 1.0, WEAK_WEIGHT) for p, q in found if q >= SURE and teacher.aimed(list(p))] + against
    split = {k: [x for x in v.split()] for k, v in SENSES.items()}
    listed = [[w] for w in _SENSE_OF]
    for i, a in enumerate(SENSE_NAMES):
        for b in SENSE_NAMES[i:]:
            one, two = rng.permutation(split[a]), rng.permutation(split[b])
            listed += [[str(one[k % len(one)]), str(two[k % len(two)])] for k in range(COMBINATIONS)]
    for p in listed:
        if Teacher.HARMFUL.isdisjoint(Teacher.senses(p)):
            continue
        q = teacher.probability(p) if teacher.aimed(p) else 0.0
        if not SURE_NOT < q < SURE:
            more.append((tuple(p), float(q >= SURE), 1.0))
    cache: dict[str, tuple[int, list[int]]] = {}

    def machine(epochs: int) -> FactorizationMachine:
        samples = [expand(p, cache) for p in parts] + [expand(list(p), cache) for p, *_ in more]
        return FactorizationMachine.train(samples, np.concatenate([y, [q for _, q, _ in more]]), np.concatenate([weight, [w for *_, w in more]]), DIM, epochs=epochs)

    if rest:
        # harmless windows that were not taken and that a first machine is unsure of are taken too
        score = Scorer(machine(DOUBT_EPOCHS)).windows([list(p) for p in rest])
        more += [(p, 0.0, 1.0) for p, s in zip(rest, score) if DOUBT[0] < s < DOUBT[1]]
    return machine(EPOCHS)


class Scorer:
    """Scores of texts in whole batches; what a word adds to the sums is kept from batch to batch."""

    def __init__(self, model: FactorizationMachine | None):
        self.model, self.number, self.rows, self.hashes = model, {}, [], []
        if model is not None:
            self.table = np.concatenate([model.weights[:, None], model.factors, (model.factors**2).sum(1, keepdims=True)], axis=1).astype(np.float64)

    def _word(self, word: str) -> int:
        h, grams = word_cells(word)
        x = GRAM_VALUE / max(1, len(grams))
        own = self.table[h % DIM].copy()
        if grams:
            g = self.table[grams]
            own[:-1] += x * g[:, :-1].sum(axis=0)
            own[-1] += x * x * g[:, -1].sum()
        self.rows.append(own)
        self.hashes.append(h)
        self.number[word] = n = len(self.rows)
        return n

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text, in [0, 1]."""
        out = np.zeros(len(texts))
        if self.model is None:
            return out
        if len(self.rows) > CACHE_ENTRIES:
            self.number, self.rows, self.hashes = {}, [], []
        ids: list[int] = []
        spans: list[tuple[int, int]] = []
        rows: list[int] = []
        get = self.number.get
        for i, text in enumerate(texts):
            if not text or text.isspace():
                continue
            tokens = tokens_of(text)
            at = len(ids)
            own = windows(tokens)
            spans += [(a + at, b + at) for a, b in own]
            rows += [i] * len(own)
            ids += [0 if t in _ENDS else get(t) or self._word(t) for t in tokens]
        if not spans:
            return out
        np.maximum.at(out, np.array(rows), self._scores(ids, spans))
        return out

    def _scores(self, ids: list[int], spans: list[tuple[int, int]]) -> np.ndarray:
        """The score of each window, given by its places among the numbers of words; 0 is the end of a sentence."""
        number = np.array(ids)
        single = np.concatenate([np.zeros((1, RANK + 2)), np.array(self.rows)])[number]
        hashes = np.concatenate([[0], np.array(self.hashes, np.uint64)]).astype(np.uint64)[number]
        pairs = self.table[pair_cells(hashes)] * PAIR_VALUE
        pairs[:, -1] *= PAIR_VALUE
        sums = np.zeros((len(ids) + 1, RANK + 2))
        sums[1:] = np.cumsum(single, axis=0)
        pair_sums = np.zeros((len(ids), RANK + 2))
        pair_sums[1:] = np.cumsum(pairs, axis=0)
        a, b = np.array(spans).T
        total = sums[b] - sums[a] + pair_sums[b - 1] - pair_sums[a]
        s = total[:, 1:-1]
        z = self.model.bias + total[:, 0] + 0.5 * ((s * s).sum(1) - total[:, -1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def windows(self, parts: list[list[str]]) -> np.ndarray:
        """The score of each window, given by its words; few enough for one batch."""
        ids: list[int] = []
        spans: list[tuple[int, int]] = []
        get = self.number.get
        for p in parts:
            spans.append((len(ids), len(ids) + len(p)))
            ids += [get(w) or self._word(w) for w in p]
            ids.append(0)
        return self._scores(ids, spans)

    def text(self, text: str | None) -> float:
        return float(self.texts([text])[0])


def fit(events: DataFrame, labels: DataFrame) -> FactorizationMachine | None:
    """The machine of the judged sample and of the weakly labelled sample of the events."""
    rows = labels.where("flagged is not null and text is not null").orderBy("label_id").limit(MAX_LABELS)
    judged = [(r["text"], r["flagged"]) for r in rows.select("text", "flagged").toLocalIterator()]
    # of all rows only about four times the sample pass, wherever they lie: the order is over these
    share = min(1.0, 4 * WEAK_ROWS / max(1, events.count()))
    key = F.xxhash64("session_id", "event_id")
    few = events.where(F.col("content").isNotNull() & (F.length("content") <= WEAK_CHARS) & (key <= min(2**63 - 1, int(-(2**63) + share * 2**64))))
    weak = few.groupBy(key.alias("k")).agg(F.min("content").alias("content")).orderBy("k").limit(WEAK_ROWS)
    return train(judged, [r["content"] for r in weak.select("content").toLocalIterator()])


def score_events(events: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``session_id, event_id, score, offending`` for each distinct event; the score is in [0, 1]."""
    shared = events.sparkSession.sparkContext.broadcast(fit(events, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer.texts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(scores, pa.float64())], names=["session_id", "event_id", "score"]
            )

    scored = events.select("session_id", "event_id", "content").mapInArrow(
        run, "session_id string, event_id string, score double"
    )
    return (
        scored.groupBy("session_id", "event_id")
        .agg(F.max("score").alias("score"))
        .withColumn("offending", F.col("score") >= threshold)
    )


def rates(scored: DataFrame, sessions: DataFrame, catalog: DataFrame) -> DataFrame:
    """``source, n_events, n_offending, rate, mean_score`` by proper name; null for unknown sessions.

    Counts are combined by session before they move, so that a hot session costs no more than another.
    """
    per_session = scored.groupBy("session_id").agg(
        F.count("*").alias("n_events"), F.sum(F.col("offending").cast("bigint")).alias("n_offending"), F.sum("score").alias("score")
    )
    facts = session_facts(sessions, catalog).select("session_id", "source")
    return (
        per_session.join(facts, "session_id", "left")
        .groupBy("source")
        .agg(F.sum("n_events").alias("n_events"), F.sum("n_offending").alias("n_offending"), F.sum("score").alias("s"))
        .select("source", "n_events", "n_offending", (F.col("n_offending") / F.col("n_events")).alias("rate"), (F.col("s") / F.col("n_events")).alias("mean_score"))
    )
