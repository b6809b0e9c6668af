"""Words, the word cache and byte-pair ids against plain Python and the public libraries."""

import re

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwork.llm.bpe import WordBpe
from maskwork.llm.token_counts import Counter, vocabulary
from maskwork.llm.wordcache import WordCache
from maskwork.llm.words import Powers, Words, chunks, plain_table, space_table

TEXTS = ["a b  a", "", None, "x", "one two three two three", "é ß 𝒳y", "\t\n", "a" * 5000 + " b"]


@pytest.mark.parametrize("table, pattern, lower", [(space_table, r"[^\x20\x09-\x0D]+", False), (plain_table, r"[^\W_]+", True)])
def test_words_are_those_of_the_pattern(table, pattern, lower):
    words = Words(TEXTS, table(), Powers())
    for d, text in enumerate(TEXTS):
        want = re.findall(pattern, text or "") if table is space_table else None
        a, b = words.bounds[d], words.bounds[d + 1]
        got = [words.joined[words.starts[i] : words.ends[i]] for i in range(a, b)]
        if want is not None:
            assert got == want
    same = Words(["The CAT.", "the cat"], plain_table(), Powers())
    assert same.hashes[0] == same.hashes[2] and same.hashes[1] == same.hashes[3] and same.hashes[0] != same.hashes[1]


def test_hash_of_a_word_does_not_depend_on_its_place():
    table, powers = space_table(), Powers()
    alone = Words(["word"], table, powers).hashes[0]
    assert all(h == alone for h in Words(["word " * 300, "x word"], table, powers).hashes[:300])


def test_shingles_stay_inside_a_text():
    words = Words(["a b c", "d e", "a b c d"], space_table(), Powers())
    hashes, bounds = words.shingles(3)
    assert np.diff(bounds).tolist() == [1, 0, 2] and hashes[0] == hashes[1]


def test_chunks_cover_everything_in_order():
    texts = ["x" * n for n in (3, 10, 1, 50, 2)]
    assert [i for a, b in chunks(texts, 12) for i in range(a, b)] == list(range(5)) and list(chunks([])) == []


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(public.path("word_bpe_49k.json"))


def _check(bpe, texts):
    ids, bounds = WordCache(bpe.encode).ids_of(texts)
    want = bpe.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [w.ids for w in want]


def test_bpe_ids_are_the_librarys(bpe):
    _check(bpe, [*TEXTS, "Don't we'll 'tis I'D 123abc $$$ á ΟΔΟΣ İstanbul 日本 <|endoftext|> naïve— “x” dogs' e.g., (a).", " x\u0085y"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=("Cs", "Cn", "Co")), max_size=40), max_size=4))
def test_bpe_ids_of_any_text(bpe, texts):
    _check(bpe, texts)


def test_cache_that_overflows_gives_the_same(bpe):
    texts = ["alpha beta gamma", "delta beta", "alpha epsilon zeta eta"]
    small, large = WordCache(bpe.encode, limit=3), WordCache(bpe.encode)
    for t in texts:
        assert small.ids_of([t])[0].tolist() == large.ids_of([t])[0].tolist()


@pytest.fixture(scope="module")
def pieces():
    return vocabulary(public.path("piece_bpe_32k.model"))


def _reference(pieces):
    """The public library's unigram encoder over the same pieces, with bytes for unknown characters."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = [("<unk>", 0.0), *[(f"<0x{b:02X}>", 0.0) for b in range(256)], *pieces]
    tokenizer = Tokenizer(models.Unigram(vocab, 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return tokenizer


def test_viterbi_counts_are_the_librarys(pieces):
    tokenizer, counter = _reference(pieces), Counter(pieces)
    words = "the theory thanedble Überraschung naïve 執執 \U0001d4b3x éèê internationalisation aaaaaaaa zzz %%% 'tis 123456 ☃".split()
    assert [counter.count(w) for w in words] == [len(tokenizer.encode(w, add_special_tokens=False).ids) for w in words]


@settings(max_examples=150, deadline=None)
@given(st.text("abcdetñ執☃1.", min_size=1, max_size=14))
def test_viterbi_counts_of_any_word(pieces, word):
    test = _SHARED.setdefault("t", _reference(pieces)), _SHARED.setdefault("c", Counter(pieces))
    assert test[1].count(word) == len(test[0].encode(word, add_special_tokens=False).ids)


_SHARED: dict = {}


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12))
def test_viterbi_ties(word):
    """Equal scores: the piece that begins first wins, as in the library."""
    tied = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("abc", -3.0), ("bc", -2.0), ("▁a", -2.0), ("aab", -3.0)]
    counter, tokenizer = Counter(tied), _reference(tied)
    assert counter.count(word) == len(tokenizer.encode(word, add_special_tokens=False).ids)
