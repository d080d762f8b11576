import random

import pytest

from leafmill.llm import answers


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(20))
def test_lcs(seed):
    rng = random.Random(seed)
    for _ in range(50):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(90))] for _ in range(2))
        assert answers.lcs(a, b) == slow_lcs(a, b)


REFUSALS = [
    "I'm sorry, but I can't help with this page.", "Unfortunately, I am really not able to comply with that.", "Thank you for the page, however I do not have the ability to carry it out.",
    "Es tut mir leid, aber ich kann diese Anfrage leider nicht bearbeiten.", "Je ne peux vraiment pas traiter cette demande.", "Lo siento, pero no puedo ayudar.", "Não posso ajudar.", "Nie mogę tego zrobić.", "Я не могу помочь.",
    "I cannot process this request. " + "The reason is that the material may be confidential and has to be kept. " * 30,
    "I apologise to you and to everyone who may have waited for this for a long time already and had hopes; I have to refuse what you asked for. Let me know whether there is anything else that could be of use to you or to your colleagues.",
]
ANSWERS = [
    "The valve is not able to close while the pump runs.", "It is not possible to read the second line.", "", "{\"title\": \"I cannot process\"}",
    "The table lists every part of the pump and its place in the store. " * 5 + "I cannot process the rest.",
]


@pytest.mark.parametrize("text", REFUSALS)
def test_refusals(text):
    assert answers.is_refusal(text)


@pytest.mark.parametrize("text", ANSWERS)
def test_no_refusals(text):
    assert not answers.is_refusal(text)


@pytest.mark.parametrize("own, want", [("a x b", True), ("a x y b", True), ("a x y z b", False), ("b a", False), ("a a x y b", True), ("", False)])
def test_alignment_with_gaps(own, want):
    assert answers.aligned(["a", "b"], own.split()) is want


@pytest.mark.parametrize("text, want", [("", True), (None, True), (" \n​", True), ("```json\n```", True), ('""', True), ("«»", True), ("x", False), ("```x```y", False)])
def test_empty(text, want):
    assert answers.is_empty(text) is want


@pytest.mark.parametrize("text, want", [
    ('{"a": 1}', False), ('{"a": [1, 2', True), ("no json", None), ('```json\n{"a": "b', True), ('{"a": "}"', True), ("{'a': 'it''s'}", False), ('{"a": "\\""}', False), ("[1] see there", None), ("{'title': 'say \"no\" here', 'x': 1}", False),
])
def test_open_json(text, want):
    assert answers.open_json(text) is want


@pytest.mark.parametrize("text, want", [("All is well.", False), ("All is we", True), ("“Done.”", False), ("Ende!", False), ("終わり。", False), ('{"a": 1', True), ("", False), ("See (Fig. 3).*", False)])
def test_unfinished(text, want):
    assert answers.unfinished(text) is want


def test_copies():
    prompt = "Describe the drawing on this page in two sentences for the archive."
    assert answers.is_copy(prompt, prompt) and answers.is_copy(f'"{prompt}" Answer:', prompt)
    assert not answers.is_copy("The drawing shows a pump on this page.", prompt) and not answers.is_copy(prompt, None)
    page = "The pump is worn.\nReplace the seal."
    asked = "Correct the text of the page below and keep its lines.\n\n{page}"
    assert answers.is_copy(asked.replace("{page}", page), asked, page)
    assert not answers.is_copy(page, asked, page)


def test_very_long_answers_end_in_time():
    text = "word " * 200_000
    assert answers.unfinished(text) and not answers.is_refusal(text) and not answers.is_copy(text, "Describe the drawing on this page in two sentences.")
    assert answers.open_json('{"a": "' + "x" * 500_000) is True


@pytest.mark.parametrize("prompt, lang, want", [("Answer in German, please.", "en", "de"), ("Antworte.", "DE-at", "de"), (None, None, None), ("in Polish or so", "fr", "pl")])
def test_asked_language(prompt, lang, want):
    assert answers.asked_language(prompt, lang) == want
