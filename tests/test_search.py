"""The query language."""

import pytest

from mailsieve.operators.search import parse, words

WORDS = {
    "a b": ["a", "b"],
    "  a   b ": ["a", "b"],
    'subject:"x y" z': ["subject:x y", "z"],
    "don't stop now": ["dont stop now"],
    "'a \"b' c": ['a "b', "c"],
    '"open to the end': ["open to the end"],
    '"" x': ["x"],
    "": [],
}


@pytest.mark.parametrize("query", WORDS)
def test_words(query):
    assert words(query) == WORDS[query]


def test_terms():
    t = parse("FROM:Ann to:bob subject:x free text after:2026/1/5 before:nope is:unread is:flagged in:Spam k:v")
    assert t.values == {"from": "Ann", "to": "bob", "subject": "x free text k:v", "after": "2026-01-05"}
    assert t.seen is False and t.flagged and t.folder == "junk"


def test_last_use_wins_and_odd_values_are_ignored():
    t = parse("from:a from:b is:read is:unread is:odd in:sent label:Work/Now")
    assert t.values == {"from": "b"} and t.seen is False and t.folder == "Work/Now" and not t.flagged


def test_wide_terms_are_words_otherwise():
    assert parse("has:attachment larger:5M").values == {"subject": "has:attachment larger:5M"}
    wide = parse("has:attachment larger:5M filename:pdf", wide=True)
    assert wide.attachment and wide.values == {"larger": "5M", "filename": "pdf"}
