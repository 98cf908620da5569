"""The training-data operators do the whole job: shortcuts and early ends lose nothing."""

import numpy as np
import pytest

from sessionloom.llm import abuse, pairs, pii


def spans(text, kind):
    return {text[a:b] for k, a, b, _ in pii.candidates(text) if k == kind}


# ---- p1 -------------------------------------------------------------------------------------------


def test_every_triggered_defect_comes_out(spark):
    people, places, verbs = ["clerk", "courier", "tenant", "guide"], ["harbour", "library", "depot", "clinic"], ["moved", "checked", "packed", "sold"]
    good = []
    for k in range(160):
        a, b, v = people[k % 4], places[k // 4 % 4], verbs[k // 16 % 4]
        good.append((f"What did the {a} do at the {b}?", f"The {a} {v} the box at the {b}, because the {people[(k + 1) % 4]} needed the room."))
        good.append((f"Was hat der {a.title()} am {b.title()} gemacht?", f"Der {a.title()} hat die Kiste am {b.title()} geprüft, weil der Raum für die Übung nicht frei war."))
    q = "What did the clerk do at the harbour?"
    cases = [
        (q, "Diese Frage kann ich leider nicht beantworten, weil der Raum für die Übung nicht frei war.", ["refusal", "language"]),
        (q, "I'm sorry, but I can't help with the box at the", ["refusal", "truncated"]),
        (q, "Der Clerk hat die Kiste am Depot geprüft, weil der Raum für die", ["truncated", "language"]),
        (q, "Der Clerk hat die Kiste am Depot geprüft (weil der Raum für die Übung nicht frei war.", ["truncated", "language"]),
        (q, "What did the clerk do at the harbour?", ["copy"]), (q, " ", ["empty"]), (q, "The clerk moved the box.", None),
    ]
    rows = [(i, *g) for i, g in enumerate(good)] + [(1000 + i, *c[:2]) for i, c in enumerate(cases)]
    got = {r.probe_index: (r.defects, r.defect) for r in pairs.find_defects(spark.createDataFrame(rows, "probe_index long, prompt string, reference string")).collect()}
    assert got == {1000 + i: (d, d[0]) for i, (*_, d) in enumerate(cases) if d}


def test_every_form_of_a_refusal_passes_the_gate():
    for text in (
        "As an artificial intelligence, answering this is not possible.", "As an AI, helping is not possible.", "As a language model, nothing is outside.", "As an assistant, no.", "I'm sorry, no.", "I can't help.",
        "I am unable.", "I must decline.", "I refuse to.", "I'd rather not.", "I don't feel able.", "That violates my rules.", "It is beyond what I can share.", "My rules forbid it.", "An answer cannot be given by me.",
        "No comment.", "Let's talk about something else.", "Lets discuss a different topic.", "Redacted by the bot.", "Requests like this are filtered.", "Das kann ich nicht.", "Ich will keine.", "Ich muss ablehnen.",
        "Es tut mir leid.", "Kein Kommentar.", "Meine Regeln.", "Je ne peux pas.", "Mes consignes interdisent.", "Ma politique interdit.", "Pas de commentaire.", "Il m'est interdit.", "Lo siento, no.", "Me temo que no.",
        "No puedo.", "No debo.", "No me está permitido.", "No me es posible.", "No estoy autorizada.", "No quiero.", "Tengo que declinar.", "He de negarme.", "Debo rechazar.", "Prefiero no.", "Sin comentarios.", "Mis normas.",
        "Я не буду.", "Не могу помочь.", "Вынужден отказать.", "Вынуждена отказать.", "Вынуждены отказать.", "Должен отказаться.", "Должна отказать.", "Приходится отказать.", "Отказываюсь.", "Без комментариев.", "Мои правила.",
        "Мне нельзя.", "我不能", "抱歉，不能", "对不起，无法", "很遗憾，拒绝", "无可奉告", "恕难", "不予回答", "不被允许", "我的规则",
    ):
        assert pairs.REFUSALS.search(text), text
        assert pairs.is_refusal(text, pairs.flat(text)), text


def test_one_row_of_a_key_counts_and_texts_are_read_whole(spark):
    q = "What did the clerk do at the harbour?"
    rows = [
        (1, q, "A fine long answer about the clerk."), (1, q, "N/A"), (2, q, "n/a"), (2, q, "n/a"), (None, q, None), (3, None, "Something."),
        (4, q, "You asked me a moment ago about something that matters to you a great deal, namely this one here: " + q),
        (5, q, "The clerk moved the box to the depot and then went home for the night. It rained. " + q),
    ]
    got = {r.probe_index: r.defect for r in pairs.find_defects(spark.createDataFrame(rows, "probe_index long, prompt string, reference string")).collect()}
    assert got == {2: "empty", None: "empty", 4: "copy"}
    assert pairs.last_word("The end is " + "a" * 5000) == "a" * 5000
    assert pairs.last_word("order x-" + "a" * 500 + "4") is None
    assert pairs.find_defects(spark.createDataFrame([], "probe_index long, prompt string, reference string")).count() == 0


# ---- p2 -------------------------------------------------------------------------------------------


def every():
    """A machine that scores whatever reaches it."""
    return abuse.FactorizationMachine(5.0, np.zeros(abuse.DIM, np.float32), np.zeros((abuse.DIM, abuse.RANK), np.float32))


@pytest.mark.parametrize(
    "text",
    [
        "I will find you and break your legs.", "I will hunt you down and make you pay.", "You are a waste of space.", "Nobody would miss you.",
        "Lock them all up and send them back.", "Never hire gay people", "Some idiot's printer", "raus mit euch", "Stück Scheiße", "люди как мусор", "выпей яду", "没人会想你",
        "The clerk moved the box.",
    ],
)
def test_every_text_reaches_the_machine(text):
    assert abuse.Scorer(every()).text(text) > 0.9


def test_everyday_words_offend_together():
    # the machine knows of threats only what judged texts say of them
    labels = [("You are a stupid idiot", True), ("Nomads are vermin", True), ("I will beat you bloody", True), ("the printer is dumb", False), ("kill the process", False), ("The clerk moved a box", False)]
    scorer = abuse.Scorer(abuse.train(labels))
    for text in ("I will find you and break your legs.", "I will hunt you down and make you pay.", "You are a waste of space.", "Nobody would miss you."):
        assert scorer.text(text) >= abuse.THRESHOLD, text
    assert scorer.text("Never send the file to the printer.") < abuse.THRESHOLD


# ---- p3 -------------------------------------------------------------------------------------------


def test_spelled_addresses_may_have_plain_dots():
    for own in ("greta.rovstodez+orders66 (at) papermoth.invalid", "j.doe [at] mail.tarnbeck.example", "j.doe at example.org", "j.doe (at) example dot org", "j.doe@example punkt org"):
        assert spans(f"Contact: {own}, please.", "email") == {own}
    assert not spans("We met at noon. Then they left.", "email")


def test_every_form_of_an_address_passes_the_gate():
    ats = ["@", " @ ", " at ", "\tAT\n", "(at)", " [at] ", "{at}", " { at } ", " arroba ", " chez ", " собака ", "\nchez "]
    dots = [".", " dot ", " DOT ", "(dot)", " [dot] ", "{dot}", " punkt ", " punto ", " point ", " точка "]
    for at in ats:
        for dot in dots:
            own = f"jean.dupont{at}exemple{dot}fr"
            assert spans(f"Write: {own}", "email") == {own}, own


def test_resident_numbers_of_eighteen_signs_are_proposed():
    for own in ("110101199003074578", "11010119900307457X", "110101 19900307 457x", "110101-19900307-4578"):
        for text in (f"身份证号码：{own}。", f"Her national id {own}, please."):
            assert own in spans(text, "id_number")
            votes = [p for k, a, b, p in pii.candidates(text) if k == "id_number" and text[a:b] == own]
            assert any(p & 1 for p in votes)  # the labeler of formats fires
    assert not spans("1101011990030745789 and 4110101199003074578X", "id_number")


def test_every_form_of_a_street_and_a_title_passes_its_gate():
    for street in "Street Road Lane Avenue Close Drive Court Way Square Terrace Boulevard Place Crescent Row St St. Rd Rd. Ave Ave. Ln Ln. Dr Dr. Blvd Blvd.".split():
        for end in (", London", "", "\n"):
            assert spans(f"12 Baker {street}{end}", "address"), street
        assert spans(f"12 Baker\n{street}", "address"), street
    for own in (
        "3 rue\nPasteur", "3 bis, avenue de la Paix", "3 boulevard du Nord", "3 place d'Armes", "3 chemin Vert", "3 allée Verte", "3 impasse Noire", "3 quai Sud",
        "Uferstraße 3", "Nordstrasse 3", "Nordstr. 3", "Feldweg\n3", "Lindenallee 3", "Marktplatz 3", "Seegasse 3", "Nordufer 3", "Hafendamm\t3",
        "Calle\nMayor 3", "Avenida Sur 3", "Avda. Sur 3", "Plaza Mayor, 3", "Paseo del Prado 3", "Camino Real 3", "C/ Mayor 3",
        "P. O. Box 31", "P.O. Box 31", "PO Box 31", "Postfach 31", "Apartado 31", "BP\t31", "ул. Ленина, д. 3", "улица Ленина 3", "пр. Мира 3", "проспект Мира 3", "пер. Садовый 3", "中山路12号", "长安街12号", "人民大道12号", "城南巷12号",
    ):
        assert spans(own, "address"), own


def announced(text):
    return any(k == "name" and p & 1 for k, _, _, p in pii.candidates(text))


def test_every_form_of_a_title_and_a_phrase_passes_its_gate():
    for title in "Dr Dr. Mr Mrs Ms Miss Prof Prof. Herr Herrn Frau Mme Mlle Sr Sr. Sra Srta Don Doña señor Señora madame Monsieur г-н г-жа господин госпожа".split():
        for space in (" ", "\n"):
            assert announced(f"{title}{space}Quell Vashby"), title
    for phrase in (
        "My name is ", "Je m'appelle ", "Mon nom est ", "Ich heiße ", "Mein Name ist ", "Me llamo ", "Mi nombre es ", "Меня зовут ", "Моё имя ", "我叫", "我的名字是", "姓名：",
        "for user ", "User: ", "Spoke with ", "spoke to ", "Author: ", "Signed off by: ", "booking is under ", "Reach ", "demandez M. ", "appelez M. ", "contactez M. ", "contacter M. ",
        "Regards, ", "Sincerely, ", "Attn: ", *(f'"{k}": "' for k in ("contact", "name", "customer", "author", "user", "patient", "person")),
    ):
        assert announced(f"{phrase}Quell Vashby"), phrase
