"""Texts of a million characters that once took quadratic time or overflowed: they end, with the results of short ones."""

import random
import time

import pytest

from tidemark.llm import pii
from tidemark.llm.html_extract import Tree
from tidemark.llm.packing import TokenCounter
from tidemark.llm.queries import SPLIT, VOCABULARY

N = 1_000_000


@pytest.fixture(autouse=True)
def in_time():
    begin = time.monotonic()
    yield
    assert time.monotonic() - begin < 60


def test_long_blanks_have_the_tokens_of_short_ones():
    count = TokenCounter(VOCABULARY, SPLIT)
    assert count("") == 0 and count("a") == 1
    r = random.Random(1)
    for _ in range(200):  # the tokenizer itself bears runs of some thousands
        text = "".join(r.choice(["a", "b ", "1", "!?", " ", "\n", "\t", "　", "'s"]) * r.choice([1, 1, 3, 1200, 2500]) for _ in range(12))
        assert count(text) == len(count.own.encode_ordinary(text))
    for blank in " \n\t":
        one = count(blank * 5_000_000)
        assert one > 0 and abs(count("a" + blank * 5_000_000 + "b") - one - 2) <= 2
    for sign in "a1!":
        assert count(sign * N) > 0


@pytest.mark.parametrize("text", ["password: " + "." * N, "password: x" + ".;" * (N // 2) + " y", "Mr " + "Juan Carlos " * (N // 12), "Mr " * (N // 3), "password: " * (N // 10), "token=a" + "&b" * (N // 2), "secret:a" + ",b" * (N // 2), "1" * N, "a@" * (N // 2), "password" + " " * N, "".join(f"Mr Name{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} " for k in range(10_000))])
def test_personal_data_in_long_texts(text):
    found = pii.detect(text)
    assert all(0 <= a < b <= len(text) for a, b, _, _ in found)


def test_names_and_secrets_without_a_limit():
    of = lambda text: [(text[a:b], kind) for a, b, kind, _ in pii.detect(text)]
    assert [x for x, _ in of("Mr Juan Carlos Maria Antonia de Lopez said")] == ["Juan", "Carlos", "Maria", "Antonia"]
    assert [x for x, _ in of("Mr Juan Carlos Maria Lopez said")] == ["Juan", "Carlos", "Maria", "Lopez"]
    assert of("Mrs\nAnna Schmidt went. SCHMIDT, Anna-Maria") == [("Anna", "given-female"), ("Schmidt", "family"), ("SCHMIDT", "family"), ("Anna", "given-female")]
    assert of("Mr Smith met Mrs Jones.") == [("Smith", "family"), ("Jones", "family")]
    assert of("password: abc") == [("abc", "secret")] and of("pwd=a&user=b") == [("a", "secret")] and of('{"password": "ab", "x": 1}') == [("ab", "secret")]
    assert of("(password: hunter2). Next") == [("hunter2", "secret")] and of("api_key: abcd") == [("abcd", "secret")] and of("token: yes, the secret: love") == []
    assert of("password: ... and") == []


@pytest.mark.parametrize(("html", "elements"), [
    ("<a " * (N // 3), 1), ("<div>" * (N // 10), N // 10 + 1), ("<b>" * (N // 10) + "</x>" * (N // 10), N // 10 + 1), ("<i><table><td>" + "<b>" * (N // 10) + "</i>" * (N // 10), N // 10 + 4), ("<![CDATA[" * (N // 9), 1),
    ("<!--" * (N // 4), 1), ("<" * N + ">", 1), ('<a "' * (N // 4) + ">", 2), ("<!" * (N // 2), 1), ("<a " + "b " * (N // 2) + ">", 2), ("<p>" * (N // 10), N // 10 + 1), ("<ul>" * (N // 20) + "<li>" * (N // 20), N // 10 + 1),
])
def test_long_pages(html, elements):
    tree = Tree(html)
    assert len(tree.tags) == elements
    tree.subtrees(b"host", True)
    assert isinstance(tree.text(set(), True), str)
