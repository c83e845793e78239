"""Byte-level BPE against the tokenizers library, and the transducer against a dictionary."""

import hashlib
import random
import sys

import numpy as np
import pytest

from plinth.llm import bpe, transducer
from tests.llm.fixtures import corpus, frame

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def lexicon(tmp_path_factory):
    """A lexicon of few words, so that most are merged."""
    with open(PATH, "rb") as f:
        vocabulary = bpe.Vocabulary(f.read())
    path = tmp_path_factory.mktemp("bpe") / "lexicon"
    path.write_bytes(bpe.compiled([b" the", b"the", b" them", b"hello", b" a", b"\n", "é".encode()], vocabulary, bpe.unknown_letters()))
    return bpe.Lexicon(str(path))


def read(arrays, tmp_path):
    data = bpe.packed(arrays, {})
    (tmp_path / "t").write_bytes(data)
    size = int.from_bytes(data[:4], "little")
    head = __import__("json").loads(data[4 : 4 + size])["places"]
    import mmap

    with open(tmp_path / "t", "rb") as f:
        return transducer.Reader(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), {k: (4 + size + at, n) for k, (at, n) in head.items()})


def test_transducer_maps_all_words_and_no_other(tmp_path):
    rng = random.Random(5)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 7))) for _ in range(300)})
    given = {w: tuple(rng.randrange(4) for _ in range(rng.randrange(0, 4))) for w in words}
    reader = read(transducer.built(sorted(given.items())), tmp_path)
    for w in words + [w + b"a" for w in words] + [b"zz", b"\x00"]:
        want = given.get(w)
        got = reader.get(w)
        assert (None if got is None else tuple(np.frombuffer(got, "<i4"))) == want
    with pytest.raises(ValueError, match="rise"):
        transducer.built([(b"b", ()), (b"a", ())])
    assert read(transducer.built([]), tmp_path).get(b"") is None


def test_transducer_is_minimal():
    """As many states as there are different continuations (what is accepted, and what is given beyond the common start)."""
    rng = random.Random(6)
    words = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 6))) for _ in range(40)})
    given = {w: tuple(rng.randrange(2) for _ in range(rng.randrange(0, 3))) for w in words}

    def common(outs):
        first = min(outs)
        n = 0
        while len(first) > n and all(o[: n + 1] == first[: n + 1] for o in outs):
            n += 1
        return n

    rest = set()
    for prefix in {w[:k] for w in words for k in range(len(w) + 1)}:
        below = {w[len(prefix) :]: o for w, o in given.items() if w.startswith(prefix)}
        cut = common(list(below.values())) if prefix else 0  # the start state keeps all
        rest.add(tuple(sorted((w, o[cut:]) for w, o in below.items())))
    assert len(transducer.built(sorted(given.items()))["ends"]) == len(rest)


def test_merges_by_rank_then_from_the_left():
    merges, made = {1 << 32 | 1: 2, 2 << 32 | 1: 1, 2 << 32 | 2: 0}, [4, 3, 2]
    singles = {97: 1, 98: 9}

    def plain(ids):
        while True:
            found = [(merges[ids[k] << 32 | ids[k + 1]], k) for k in range(len(ids) - 1) if ids[k] << 32 | ids[k + 1] in merges]
            if not found:
                return ids
            best, k = min(found)
            ids = ids[:k] + [made[best]] + ids[k + 2 :]

    rng = random.Random(7)
    for n in [*range(12), 47, 48, 49, 50, 200]:
        for share in (0, 0.1, 0.4):
            word = bytes(98 if rng.random() < share else 97 for _ in range(n))
            assert bpe.merged(word, singles, merges, made) == plain([singles[b] for b in word])


def test_many_words_merge_as_one_does(lexicon):
    rng = random.Random(11)
    words = [bytes(rng.choice(b"abcdeth in") for _ in range(rng.randrange(0, 30))) for _ in range(500)] + [b"", b"a", b"q" * 48, "ёжик文".encode()]
    lexicon.word("zq")  # reads the merges
    many = bpe.Merges(lexicon.array("pairs").reshape(-1, 3), lexicon.array("singles"))
    for at_once in (4096, 7):
        bpe.AT_ONCE, kept = at_once, bpe.AT_ONCE
        try:
            found = many.words(words)
        finally:
            bpe.AT_ONCE = kept
        assert [np.frombuffer(f, "<i4").tolist() for f in found] == [bpe.merged(w, lexicon._singles, lexicon._ranks, lexicon._made) for w in words]


def test_every_code_point_is_cut_as_the_library_does(lexicon, library):
    for c in [*range(0xD800), *range(0xE000, sys.maxunicode + 1, 3)]:
        if c % 7 == 0 or c < 0x3000:
            text = f"a{chr(c)}1{chr(c)}!{chr(c)} b {chr(c)}"
            want = [text[s:e] for _, (s, e) in library.pre_tokenizer.pre_tokenize_str(text)]
            assert [w for _, ws in lexicon.cutter.words(text) for w in ws] == want, hex(c)


def test_odd_texts_equal_the_library(lexicon, library, monkeypatch):
    rng = random.Random(8)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    pool = [chr(c) for c in range(32, 0x250)] + list(" \n\t\x1c\x1f\x85　  '") * 10 + [chr(rng.choice(points)) for _ in range(2000)] + ["<|endoftext|>", "'ll", "'re", "<|endof", " the", " them"] * 20
    for k in range(3000):
        if k == 2000:
            monkeypatch.setattr(bpe, "WHOLE", 5)  # the piecewise way
            monkeypatch.setattr(bpe, "HELD", 3)
            monkeypatch.setattr(bpe, "SEEN", 9)
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(lexicon.encode(text), "<u4")
        assert b"".join(lexicon.encode_all(iter([text, "", text]))) == 2 * got.tobytes()
        assert got.tolist() == want and lexicon.decode(got) == library.decode(want, skip_special_tokens=False) == text


def test_very_long_words(lexicon, library):
    text = "ab" * 30_000 + "x" * 60_000 + "ё" * 3_000 + " " * 5_000
    assert np.frombuffer(lexicon.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert lexicon.decode(np.array([5, 50256, 99_999], "<u4")) == library.decode([5, 50256], skip_special_tokens=False)


def test_round_trip_of_a_table(spark, library):
    rows = corpus() + [(300, "say <|endoftext|> twice<|endoftext|>", "s"), (301, "naïve 文字 ё 12\r\n\r\n  end ", "s")]
    docs = frame(spark, rows)
    for words in (0, 40):
        got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH, words=words).collect())
        want = []
        for i, text, _ in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == sorted(want)
    assert bpe.round_trip(frame(spark, []), PATH).count() == 0


def test_counts_cover_all_documents(spark):
    docs = frame(spark, [(k, "one two two" if k % 2 else "two", "s") for k in range(100)] + [(None, None, "s"), (1, "x" * 100, "s")])
    with open(PATH, "rb") as f:
        got = {r.word: r.n for r in bpe.word_counts(docs.repartition(7), bpe.Vocabulary(f.read()), []).collect()}
    assert got == {b"one": 50, b" two": 100, b"two": 50}


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"), open(P.path("word_bpe_49k.json"), "rb") as f:
        bpe.Vocabulary(f.read())
