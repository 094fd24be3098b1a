"""Residue that an earlier chance word or run must not hide."""

import numpy as np
import pytest

from hunkweave.llm import residue as R


MADE_UP = "ipsumdol sitlor ipamcon dolsit conlor amet metdol lorem dolor asdf qwer zxcv jkl uiop hjkl"


@pytest.fixture(scope="module")
def index():
    words = {w for _, _, t in R.EXEMPLARS for w in R.exemplar_tokens(t)}
    rare = dict.fromkeys(["insert", "add", "view"], 6.0)
    everywhere = np.full(R.TRIPLES, 50)
    retrieved = np.bincount(R.triples(MADE_UP), minlength=R.TRIPLES)
    profile = R.Profile(everywhere, retrieved, np.zeros(R.TRIPLES, np.int64))
    return R.Index(R.EXEMPLARS, {**dict.fromkeys(words, 5.0), **rare}, 8.0, profile, 0.8)


@pytest.mark.parametrize("text", ["Insert one line per slice [insert summary]", "Add tests, then [add owner here]"])
def test_a_chance_word_near_the_start_hides_no_mark(index, text):
    at = text.index("[")
    assert ("mark", at, len(text), 1.0) in index.find(text)


def test_a_chance_word_near_the_start_hides_no_notice(index):
    assert [h for h in index.find("View failed. Please turn on scripts in your browser to view it") if h[0] == "notice"]


def test_each_of_two_near_marks_is_a_passage(index):
    text = "by [insert owner] and [insert date] now"
    assert {text[a:b] for label, a, b, _ in index.find(text) if label == "mark"} == {"[insert owner]", "[insert date]"}


@pytest.mark.parametrize("lead", ["1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 lines. ", "3 " * 40 + "rows. ", "# " * 40 + "end. "])
def test_a_run_of_numbers_or_signs_hides_no_later_filler(index, lead):
    text = lead + "xx " * 14
    assert [text[a:b] for label, a, b, _ in index.find(text) if label == "filler"] == [("xx " * 14).strip()]


def test_every_filler_passage_comes_out_whole(index):
    parts = ["xx " * 20, "ab cd " * 20, "asdf qwer zxcv jkl uiop asdf qwer zxcv hjkl asdf ", "ipsumdol sitlor ipamcon dolsit conlor amet metdol lorem dolor ", "X" * 15 + " "]
    gap = "The unit is read before the slice and nothing here moves at all. "
    text = gap + gap.join(parts + parts) + gap
    spans = [text[a:b] for label, a, b, _ in index.find(text) if label == "filler"]
    assert all(sum(p.strip() in s for s in spans) == 2 for p in parts)
