"""Word hashes over pieces of a text, long words, and the operators that build on them."""

import random
import re

import pyarrow as pa
import pytest

from plinth.llm import hashing, ngram_join, textfeatures
from tests.llm.fixtures import frame


def hashes(texts, breaks=hashing.WHITE):
    out = [[] for _ in texts]
    for _, _, h, rows in hashing.words(pa.array(texts, pa.string()), breaks):
        for x, k in zip(h.tolist(), rows.tolist(), strict=True):
            out[k].append(x)
    return out


def test_words_of_any_length_have_one_hash(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abAB") for _ in range(rng.choice([1, 3, 63, 64, 65, 200]))) for _ in range(rng.randrange(0, 30))) for _ in range(200)] + [None, "", " "]
    whole, seen = hashes(texts), {}
    for text, found in zip(texts, whole, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        assert len(words) == len(found)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, found, strict=True))
    assert len(set(seen.values())) == len(seen)
    for piece in (hashing.LONG + 1, 100, 333):
        monkeypatch.setattr(hashing, "PIECE", piece)
        assert hashes(texts) == whole


def test_thue_morse_words_differ():
    word = "a"
    while len(word) < 4096:
        word += word.translate({97: 98, 98: 97})
    for n in (32, 64, 512, 1024, 4096):
        a, b = hashes([word[:n], word[:n].translate({97: 98, 98: 97})])
        assert a != b


@pytest.mark.parametrize("size", [1_200_000, 3_000_000])
def test_a_very_long_word_is_one_word(spark, size):
    rows = [(1, "a b c d " + "x" * size, "s"), (2, "A b c d " + "X" * size + " ", "s"), (3, "a b c d " + "x" * (size - 1) + "y", "s"), (4, "w " * 3 + "x" * size + " b c d e", "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (4, 4)}


def test_features_of_a_very_long_word():
    """Op 4 and op 8 see five words, so four pairs and three skip-pairs, as with a short word in its place."""
    count = lambda text: sum(len(values) for _, _, values, _ in textfeatures.gram_features(pa.array([text])))
    assert count("a b c d " + "x" * 1_200_000) == count("a b c d xx") == 12
