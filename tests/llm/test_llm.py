"""Training-data operators: against brute force, exact round trips, and held-out labels."""

import os
import random
import re
import unicodedata

import pytest

from sessionloom.llm import abuse, bpe, encoding, leaks, neardup, pairs, pii, tokens, unigram

VOCABULARY = os.path.join(bpe.TOKENIZER_DIR, bpe.BYTE_BPE)
EVENT = "session_id string, event_id string, event_index int, content string, extra string"


def events(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], EVENT)


# ---- p6 and p4 ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_bpe_equals_the_public_tokenizer(reference):
    rng = random.Random(3)
    pool = [chr(c) for c in rng.sample(range(0x110000), 4000) if not 0xD800 <= c <= 0xDFFF] + list(" \n\t'abcSL1٣Ⅷ½\x1c\x85") * 300
    texts = ["".join(rng.choice(pool) for _ in range(50)) for _ in range(400)]
    texts += ["<|endoftext|> it's 's  x", "a" * 5000, " " * 700 + "b", "\n \n x", "é́", "'ll'LL", "ab" * 3000]
    enc = bpe.load(VOCABULARY)
    for t in texts:
        assert enc.encode(t) == reference(t), t
        assert enc.count(t) == len(reference(t))


def test_encode_corpus_defined_results(spark, reference):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hi there", "x"), (3, "hi there", "x"), (None, " ", None)], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in tokens.encode_corpus(df).collect()]
    assert sorted(got, key=str) == sorted([(1, []), (2, []), (3, reference("hi there")), (3, reference("hi there")), (None, reference(" "))], key=str)
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_unigram_counts_equal_a_full_search():
    pieces = [("▁", -3.0), ("▁a", -2.0), ("b", -2.5), ("ab", -3.0), ("▁ab", -3.9), ("c", -4.0), ("bc", -4.2), ("é", -5.0)]
    counter, scores = unigram.UnigramCounter(pieces), dict(pieces)

    def best(s):
        worst = min(scores.values()) - unigram.UNKNOWN_PENALTY
        table = [(0.0, 0, False)] + [(float("-inf"), 0, False)] * len(s)
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                if s[i:j] in scores and (v := table[i][0] + scores[s[i:j]]) > table[j][0]:
                    table[j] = (v, table[i][1] + 1, False)
            if s[i] not in scores and (v := table[i][0] + worst) > table[i + 1][0]:
                table[i + 1] = (v, table[i][1] + (not table[i][2]), True)
        return table[-1][1]

    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abcé xz ") for _ in range(12))
        want = sum(best("▁" + w) for w in re.split(" +", text.strip(" "))) if text.strip(" ") else 0
        assert counter.count(text) == want, text
    assert counter.count(None) == counter.count("") == counter.count("  ") == 0


def test_token_budget(spark, reference):
    ev = events(spark, [("s", "e0", 0, "hello world"), ("s", "e0", 0, "hello world"), ("s", "e1", 1, None), ("gone", "e0", 0, "x")])
    se = spark.createDataFrame([("s", " Harbor-Chat", None, '{"language": "English"}')] * 2, "session_id string, source string, domain string, metadata_json string")
    cat = spark.createDataFrame([("harbor_chat", "conversation")], "source string, domain string")
    got = {(r.source, r.domain, r.language): (r.n_sessions, r.n_events, r.n_tokens) for r in tokens.token_budget(ev, se, cat).collect()}
    assert got == {("harbor_chat", "conversation", "en"): (1, 2, len(reference("hello world"))), (None, None, "und"): (1, 1, 1)}


# ---- p5 -------------------------------------------------------------------------------------------


def brute_pairs(rows, threshold=0.7):
    texts = {}
    for s, e, i, c in sorted({r for r in rows if r[0] is not None and r[3]}, key=lambda r: (r[0], -1 if r[2] is None else r[2], r[1])):
        texts.setdefault(s, {}).setdefault(e, c)
    sets = {}
    for s, own in texts.items():
        w = re.findall(r"\w+", unicodedata.normalize("NFKC", "\n".join(own.values())).casefold())
        if len(w) > 2:
            sets[s] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    names = sorted(sets)
    return {(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("block", [3, 1024])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_EVENTS", block)
    rng = random.Random(block)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(6):
        body = [[rng.choice(words) for _ in range(14)] for _ in range(8)]
        for copy in range(5):
            for i, line in enumerate(body):
                own = [rng.choice(words) if rng.random() < 0.008 * copy else w for w in line]
                rows.append((f"s{base}-{copy}", f"e{i}", i, " ".join(own)))
    rows += [rows[0], ("short", "e0", 0, "two words"), ("empty", "e0", 0, ""), (None, "e0", 0, "a b c"), ("n", "e0", None, "ﬁne Straße x"), ("m", "e0", 1, "fine strasse X"), ("m", "e1", 0, None)]
    got = neardup.similar_sessions(events(spark, rows))
    found = {(r.session_id_a, r.session_id_b) for r in got.collect()}
    assert found == brute_pairs(rows) and ("m", "n") in found
    grouped = {r.session_id: r.group_id for r in neardup.groups(got).collect()}
    assert all(grouped[a] == grouped[b] for a, b in found) and set(grouped) == {x for p in found for x in p}


def test_groups_of_copies_count_links_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_EVENTS", 4)
    body = [f"k{i} l{i} m{i} n{i} o{i}" for i in range(9)]
    rows = [(f"c{k}", f"e{i:02d}", i if k % 2 else None, line) for k in range(5) for i, line in enumerate(body)]
    rows += [("d", f"e{i:02d}", i, line if i else line + " more") for i, line in enumerate(body)] + [("z", "e", 0, "quite another text here")]
    got = {r.session_id: (r.group_id, r.links) for r in neardup.similar_groups(events(spark, rows)).collect()}
    assert got == {s: ("c0", 5) for s in ("c0", "c1", "c2", "c3", "c4", "d")}
    pairs = {(r.session_id_a, r.session_id_b) for r in neardup.similar_sessions(events(spark, rows)).collect()}
    assert pairs == brute_pairs(rows)


def test_near_duplicates_of_nothing(spark):
    assert neardup.similar_groups(events(spark, []).limit(0)).count() == 0
    assert neardup.similar_sessions(events(spark, []).limit(0)).count() == 0


# ---- p7 -------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(f"i{k}", text(rng.choice([3, 12, 30, 90])), text(14)) for k in range(12)] + [("none", None, ""), (None, text(20), None)]
    docs = []
    for d in range(60):
        body = text(40)
        if d % 3 == 0:
            w = (items[d % 12][1 + d % 2] or "").split()
            at = rng.randrange(max(1, len(w)))
            body += " " + ", ".join(w[at : at + rng.choice([11, 12, 20])]).upper() + "! " + text(5)
        docs.append((d, body))
    docs += [(100, None), (101, ""), docs[0]]
    expected = set()
    for d, body in docs:
        b = leaks.words(body or "")
        windows = {tuple(b[k : k + 12]) for k in range(len(b) - 11)}
        for i, *own in items:
            for t in own:
                w = leaks.words(t or "")
                if i is not None and any(tuple(w[k : k + 12]) in windows for k in range(len(w) - 11)):
                    expected.add((d, i))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, passage string, user_query string")
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, it).collect()} == expected and expected
    assert leaks.find_leaks(df, it.limit(0)).count() == 0


def test_leak_samples_miss_nothing():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(9)]  # so few that shingles repeat within windows
    items = [(f"i{k}", [" ".join(rng.choice(words[: rng.choice([1, 2, 9])]) for _ in range(rng.choice([12, 13, 20, 60, 200]))), None]) for k in range(60)]
    index = leaks.ContainmentIndex(items)
    for name, (text, _) in items:
        own = text.split()
        for at in range(len(own) - 11):
            body = "zz " + " ".join(own[at : at + 12]) + " zz"
            assert (0, name, 1) in index.search([body])
    short = leaks.ContainmentIndex([("a", [" ".join(f"u{i}" for i in range(12)), None])])
    assert short.shingles == 8 and len(short.any) == 1


# ---- p8 -------------------------------------------------------------------------------------------

PROPER = [
    "Der Schlüssel für die Tür liegt schön über dem Gemüse, sagt Frau Jäger später.",
    "El pequeño índice de términos está en la estación, según el niño, después de mañana.",
    "L'équipe a vérifié le relevé abîmé à l'atelier, près de l'écluse, où était le clé.",
    "Судя по записи, сторож вернул новый список грузов на склад и проверил старый ключ.",
    "根据记录，值班工程师开门之前在港口移动了备用的合同，因为旧的已经裂开。",
    "We’ll see, said the guide — “later” … and a naïve café.",
]
WAYS = [("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp850"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("gbk", "latin-1")]


def test_garbled_characters_beside_proper_ones_are_cut_out(spark):
    mixed = {
        "über—Ã¼ber": "über—über", "Ã©té": "été", "naÃ¯ve": "naïve", "le relevÃ© abîmÃ©": "le relevé abîmé",
    }
    clean = ["le relevé abîmé", "«É» près de l'été", "Привет «мир»", "naïve", "été"]
    rows = [(i, t) for i, t in enumerate([*PROPER * 40, *clean, *mixed, "根据记录Ã©值班工程师", "l'été Ã© \ufffd x"])]
    got = {r.doc_id: r.restored for r in encoding.find_garbled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = len(PROPER) * 40 + len(clean)
    assert {k for k in got if k < first} == set()
    assert [got.get(first + i) for i in range(len(mixed))] == list(mixed.values())
    assert first + len(mixed) in got and got[first + len(mixed) + 1] is None


def test_garbled_text_is_found_and_restored(spark):
    clean = [(i, PROPER[i % 6] + f" {i}") for i in range(600)]
    bad, truth = [], {}
    for k, (right, wrong) in enumerate(WAYS):
        for j, p in enumerate(PROPER):
            try:
                made = p.encode(right).decode(wrong)
            except UnicodeError:
                continue
            if made != p and sum(not c.isascii() for c in p) > 3:
                bad.append((1000 + 10 * k + j, made))
                truth[1000 + 10 * k + j] = p
    odd = [(2000, None), (2001, ""), (2002, "a\x07\x85b"), (2003, "é café"), (2004, "\U0001f642 ≤ √"), (2005, "lost � sign")]
    got = {r.doc_id: r.restored for r in encoding.find_garbled(spark.createDataFrame(clean + bad + odd, "doc_id long, text string")).collect()}
    assert set(got) == set(truth) | {2005}
    assert got[2005] is None and sum(got[i] == truth[i] for i in truth) >= 0.9 * len(truth)


def test_garbled_text_of_nothing(spark):
    assert encoding.find_garbled(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- p1 -------------------------------------------------------------------------------------------


def test_defects(spark):
    people, places, verbs = ["clerk", "courier", "tenant", "guide"], ["harbour", "library", "depot", "clinic"], ["moved", "checked", "packed", "sold"]
    good = []
    for k in range(160):
        a, b, v = people[k % 4], places[k // 4 % 4], verbs[k // 16 % 4]
        good.append((f"What did the {a} do at the {b}?", f"The {a} {v} the box at the {b}, because the {people[(k + 1) % 4]} needed the room."))
        good.append((f"Was hat der {a.title()} am {b.title()} gemacht?", f"Der {a.title()} hat die Kiste am {b.title()} geprüft, weil der Raum für die Übung nicht frei war."))
    q = "What did the clerk do at the harbour?"
    cases = [
        (q, None, "empty"), (q, "​ ", "empty"), (q, "N/A", "empty"), (q, "...", "empty"),
        (q, "Question: what did the clerk do at the harbour", "copy"), (q, "I'm sorry, but I can't help with that.", "refusal"),
        ("Was hat der Clerk am Depot gemacht?", "Diese Frage kann ich leider nicht beantworten.", "refusal"),
        (q, "The clerk moved the box at the", "truncated"), (q, "The clerk moved the box (at the harbour", "truncated"), (q, "The clerk moved the b", "truncated"),
        (q, "Der Clerk hat die Kiste am Depot geprüft, weil der Raum für die Übung nicht frei war.", "language"), (q, "Сторож вернул новый список.", "language"),
        (q, "No.", None), (q, "The clerk refused to sign.", None), (q, "The session does not mention it.", None), (q, "The clerk moved the box at the harbour", None), (None, "The clerk.", None),
    ]
    rows = [(i, *g) for i, g in enumerate(good)] + [(1000 + i, c[0], c[1]) for i, c in enumerate(cases)] + [(1000, q, None)]
    got = {r.probe_index: r.defect for r in pairs.find_defects(spark.createDataFrame(rows, "probe_index long, prompt string, reference string")).collect()}
    assert got == {1000 + i: c[2] for i, c in enumerate(cases) if c[2]}


# ---- p2 -------------------------------------------------------------------------------------------


def test_abuse_scores_held_out_labels(spark):
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/moderation_labels.parquet"
    if not os.path.exists(path):
        pytest.skip("the judged sample is not here")
    rows = [(r["text"], r["flagged"]) for r in pq.read_table(path).to_pylist() if r["flagged"] is not None]
    random.Random(5).shuffle(rows)
    half = len(rows) // 2
    scorer = abuse.Scorer(abuse.train(rows[:half]))
    wrong = sum((scorer.text(t) >= abuse.THRESHOLD) != y for t, y in rows[half:])
    assert wrong <= 0.05 * (len(rows) - half)


def _judged():
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/moderation_labels.parquet"
    if not os.path.exists(path):
        pytest.skip("the judged sample is not here")
    return [(r["text"], r["flagged"]) for r in pq.read_table(path).to_pylist() if r["flagged"] is not None]


def test_abuse_rests_on_the_judged_sample():
    rows = _judged()
    unseen = ["You are a complete numpty", "what a plonker you are, you muppet", "Du bist ein Vollhorst", "I will cut you open tonight", "I will hunt you down and hurt you", "Lock them all up and send them back.", "those plumbers should all be shot at dawn", "tu es un bouffon, ta gueule"]
    harmless = ["The clerk moved a box to the station", "the printer is slow again", "She planted ferns by the window", "Die Post kommt am Montag", "kill the process and restart the server", "Le train part demain", "The doctor examined the breast tissue", "That shop sells nails and paint"]
    scorer = abuse.Scorer(abuse.train(rows))
    bad, good = scorer.texts(unseen), scorer.texts(harmless)
    assert sum(b > g for b in bad for g in good) >= 0.9 * len(bad) * len(good)
    flags = [y for _, y in rows]
    random.Random(3).shuffle(flags)
    shuffled = abuse.Scorer(abuse.train([(t, y) for (t, _), y in zip(rows, flags)]))
    assert (shuffled.texts(unseen) < abuse.THRESHOLD).all()


def test_abuse_batches_agree_with_single_texts():
    scorer = abuse.Scorer(abuse.train(_judged()))
    texts = ["You idiot. The box is here!\nOk", None, "", " ", "a", "滚，混蛋 他们", "word " * 5000 + "you stupid idiot", "!!!", "…", "x y"]
    both = scorer.texts(texts)
    assert both.tolist() == pytest.approx([scorer.text(t) for t in texts])
    assert both[6] > 0.5 > both[4]


def test_abuse_disguises_and_defined_results(spark):
    labels = spark.createDataFrame(
        [(i, *x) for i, x in enumerate([("You are a stupid idiot", True), ("Nomads are vermin", True), ("send nudes", True), ("the printer is dumb", False), ("kill the process", False), ("The clerk moved a box", False), ("x", None)])],
        "label_id int, text string, flagged boolean",
    )
    rows = [("s", "a", 0, "you i​d​i​o​t"), ("s", "b", 1, "shut up you m o r o n"), ("s", "c", 2, None), ("s", "d", 3, " "), ("s", "e", 4, "the dumb printer process"), ("s", "a", 0, "you i​d​i​o​t")]
    got = {r.event_id: r.offending for r in abuse.score_events(events(spark, rows), labels).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False, "e": False}
    none = abuse.score_events(events(spark, rows), labels.where("flagged"))
    assert {r.score for r in none.collect()} == {0.0}


# ---- p3 -------------------------------------------------------------------------------------------


def test_mentions_and_placeholders(spark):
    rng = random.Random(4)
    rows, truth, clean = [], set(), {}
    given, family = ["Yusuf", "Greta", "Owen", "Chiara"], ["Kellrand", "Basthene", "Zanlova"]
    for k in range(240):
        name = f"{rng.choice(given)} {rng.choice(family)}"
        parts = [
            ("My name is ", name, "name"), (", mail ", f"g.k{k}@nordfleet.example", "email"), (", call ", f"+44 20 7946 0{k:03d}", "phone"),
            (". For the form: passport ", f"XQ{1000000 + k}", "id_number"), (". Ship it to ", f"{k + 1} Lodholm Road, Stavagate", "address"), (f". Order 8830-{1000 + k} of lot {60000 + k} is paid; Grey Heron 7.", "", None),
        ]
        text, masked = "🙂 ", "🙂 "
        for lead, value, kind in parts:
            text, masked = text + lead, masked + lead
            if kind:
                truth.add((f"s{k}", kind, len(text)))
                masked += f"[{kind.upper()}]"
            text += value
        rows.append((f"s{k}", "e0", 0, text))
        clean[f"s{k}"] = masked
    rows += [("z", "e0", 0, None), ("z", "e1", 1, ""), rows[0]]
    ev = events(spark, rows)
    mentions = pii.find_mentions(ev)
    assert {(r.session_id, r.kind, r.start_pos) for r in mentions.collect()} == truth
    out = {(r.session_id, r.event_id): r.content for r in pii.replace_mentions(ev, mentions).collect()}
    assert all(out[s, "e0"] == m for s, m in clean.items()) and out["z", "e0"] is None and out["z", "e1"] == ""


def test_queries_run_on_tables_without_rows(spark, tmp_path):
    """Every pN_ query on empty tables of the right columns gives no rows and does not fail."""
    from sessionloom.llm import queries

    source = "/root/testdata/sf0.001"
    if not os.path.exists(source):
        pytest.skip("the tables are not here")
    for name in ("documents", "sessions", "session_events", "probes", "eval_items", "moderation_labels", "source_catalog"):
        spark.read.parquet(f"{source}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, q in queries.QUERIES.items():
        assert q(spark, str(tmp_path)).count() == 0, name
