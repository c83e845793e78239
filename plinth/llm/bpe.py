"""Byte-level BPE encoding and decoding with a compiled lexicon of frequent words.

Words are counted over all documents. The ``LEXICON_WORDS`` most frequent are
merged once and compiled, in one task on this bounded list, into a minimal
acyclic transducer that gives their ids; the file also holds the vocabulary's
merges and bytes. It lies in the shared folder, Spark hands it to every
executor, and each Python worker maps it into memory, so workers share its
pages. Words that the lexicon lacks are merged exactly, by rank and then from
the left, in n log n steps, so the size of the lexicon changes speed alone.

Words are cut as the vocabulary's pattern says. Letters and numbers that the
installed ``tokenizers`` does not know yet, but the ``regex`` module does (they
are of different Unicode versions), count as the former has them. Added tokens
are found in a text before it is cut.

Defined cases: null and empty texts have no ids and decode to the empty text;
null and repeated ids are kept, one row for each; texts of any length are
encoded whole, in pieces of bounded memory; bytes that are no UTF-8 count as
U+FFFD; words as frequent as the last of the lexicon enter by their bytes; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import sys
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import transducer
from plinth.session import scratch_path

#: Most frequent words that are compiled.
LEXICON_WORDS = 50_000
#: Bytes of a word of the lexicon at most; longer ones are merged where they occur.
WORD_BYTES = 64
#: Words that a task counts, and remembers with their ids, at once, and characters of a text that it cuts at once.
HELD = 1 << 18
SEEN = 300_000
WHOLE = 1 << 20
#: Bytes of ids or texts that are handed on together.
OUTPUT = 16 << 20
#: Symbols up to which the least pair is looked for anew after each merge; beyond it a heap is kept.
SHORT = 48
#: Words that are merged together.
AT_ONCE = 4096


# ---- vocabulary -------------------------------------------------------------------------------------


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable Latin-1, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE vocabulary file."""

    def __init__(self, source: bytes):
        made = json.loads(source)
        model = made["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        added = made["added_tokens"]
        cutter = made["pre_tokenizer"]
        if model["type"] != "BPE" or odd or made["normalizer"] or cutter["type"] != "ByteLevel" or cutter["add_prefix_space"] or not cutter["use_regex"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {odd or model['type']}")
        ids, letters = model["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.added: dict[str, int] = {t["content"]: t["id"] for t in added}
        self.tokens = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for token, k in ids.items():
            self.tokens[k] = bytes(back[c] for c in token)
        for token, k in self.added.items():
            self.tokens[k] = token.encode()
        self.singles = [ids[c] for c in letters]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        triples = [(ids[a] << 32 | ids[b], ids[a + b]) for a, b in pairs]
        self.ranks = {pair: rank for rank, (pair, _) in enumerate(triples)}
        self.made = [new for _, new in triples]


#: Stands after the ranks of all merges.
_NONE = 1 << 29


def merged(word: bytes, singles: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The ids of one word by the rank of each pair (a << 32 | b) and the id ``made`` of each rank: the pair of least rank is merged, the first from the left, until none is left."""
    ids = [singles[b] for b in word]
    if len(ids) <= SHORT:
        found = [ranks.get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) < _NONE:
            k = found.index(best)
            ids[k] = new = made[best]
            del ids[k + 1], found[k]
            if k:
                found[k - 1] = ranks.get(ids[k - 1] << 32 | new, _NONE)
            if k < len(found):
                found[k] = ranks.get(new << 32 | ids[k + 1], _NONE)
        return ids
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(k: int) -> None:
        if k >= 0 and after[k] < n and (m := ranks.get(pair := ids[k] << 32 | ids[after[k]])) is not None:
            heapq.heappush(heap, (m, k, pair))

    for k in range(n - 1):
        offer(k)
    while heap:
        best, k, pair = heapq.heappop(heap)
        if ids[k] < 0 or after[k] >= n or ids[k] << 32 | ids[after[k]] != pair:
            continue
        gone = after[k]
        ids[k], ids[gone], after[k] = made[best], -1, after[gone]
        if after[k] < n:
            before[after[k]] = k
        offer(before[k])
        offer(k)
    return [x for x in ids if x >= 0]


class Merges:
    """The merges of a vocabulary as sorted arrays, for many words at once."""

    def __init__(self, pairs: np.ndarray, singles: np.ndarray):
        """``pairs``: (left id, right id, id of the merged pair) in rows by rank."""
        keys = pairs[:, 0].astype(np.int64) << 32 | pairs[:, 1]
        self._rank = np.argsort(keys, kind="stable")
        self._keys, self._made, self._singles = keys[self._rank], pairs[:, 2], singles

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._rank[at], _NONE)

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers: in each step every word makes its next merge."""
        out = [b""] * len(words)
        order = sorted((k for k in range(len(words)) if words[k]), key=lambda k: len(words[k]))
        for s in range(0, len(order), AT_ONCE):
            some = order[s : s + AT_ONCE]
            for k, ids in zip(some, self._merged([words[k] for k in some]), strict=True):
                out[k] = ids
        return out

    def _merged(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        columns = np.arange(width + 1)
        ids = np.full((len(words), width + 1), -1, np.int64)
        ids[columns < lengths[:, None]] = self._singles[np.frombuffer(b"".join(words), np.uint8)]
        found = self._ranks(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(words))
        while len(rows):
            k = found[rows].argmin(1)
            best = found[rows, k]
            live = best < _NONE
            rows, k, best = rows[live], k[live], best[live]
            each = np.arange(len(rows))
            shift = np.minimum(columns + (columns > k[:, None]), width)
            mine = np.take_along_axis(ids[rows], shift, 1)
            mine[each, k] = self._made[best]
            near = np.take_along_axis(found[rows], np.minimum(shift[:, :-1], width - 1), 1)
            near[each, k] = self._ranks(mine[each, k], mine[each, k + 1])
            left = np.maximum(k - 1, 0)
            near[each, left] = np.where(k > 0, self._ranks(mine[each, left], mine[each, k]), near[each, left])
            ids[rows], found[rows] = mine, near
        lengths = (ids >= 0).sum(1).tolist()
        data, step = ids.astype("<i4").tobytes(), 4 * (width + 1)
        return [data[s * step : s * step + 4 * n] for s, n in enumerate(lengths)]


# ---- cutting ----------------------------------------------------------------------------------------

# fixed values: the contractions of the vocabulary's pattern
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"

# Letters and marks of texts that the standard library's faster patterns can cut: Latin, Cyrillic, and some punctuation.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯ"
_MARKS = "–—‘’“”„…«»¿¡·°€"


def unknown_letters() -> list[tuple[int, int]]:
    """Ranges of letters and numbers of ``regex`` that the installed ``tokenizers`` takes for neither."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=True)
    newer = "".join(chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn")
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", newer) if len(cut.pre_tokenize_str(f"!{c}")) == 1]
    ends = [k for k, (a, b) in enumerate(zip(found, found[1:], strict=False)) if b != a + 1]
    return [(found[a], found[b]) for a, b in zip([0, *(k + 1 for k in ends)], [*ends, len(found) - 1], strict=True)] if found else []


class Cutter:
    """Cuts texts into added tokens and words."""

    def __init__(self, added: list[str], unknown: list[tuple[int, int]]):
        self._added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._plain = self._pattern("")
        self._simple = re.compile(rf"{_CONTRACTED}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|[ \t\n\r\f\v]+(?!\S)|\s+", re.ASCII)
        self._beyond = re.compile(rf"[^\x00-\x7F{_LETTERS}{_MARKS}]")
        self._strange = frozenset(chr(c) for a, b in unknown for c in range(a, b + 1))
        self._careful = self._pattern("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in unknown)) if unknown else self._plain

    @staticmethod
    def _pattern(but: str):
        if not but:
            return regex.compile(rf"{_CONTRACTED}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+")
        letter, number, either = (f"[{x}--[{but}]]" for x in (r"\p{L}", r"\p{N}", r"\p{L}\p{N}"))
        return regex.compile(rf"(?V1){_CONTRACTED}| ?{letter}+| ?{number}+| ?[^\s{either}]+|\s+(?!\S)|\s+")

    def words(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """(added token?, words) in order; lists are of bounded length."""
        for k, part in enumerate(self._added.split(text) if self._added else [text]):
            if k % 2:
                yield True, [part]
            elif part:
                pattern = self._simple if part.isascii() or not self._beyond.search(part) else self._plain if self._strange.isdisjoint(part) else self._careful
                if len(part) <= WHOLE:
                    yield False, pattern.findall(part)
                    continue
                found = (m.group() for m in pattern.finditer(part))
                while some := list(islice(found, HELD)):
                    yield False, some


# ---- lexicon ----------------------------------------------------------------------------------------


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column.cast(pa.large_binary()):
        yield (x.as_py() or b"").decode("utf-8", "replace")


def word_counts(docs: DataFrame, vocabulary: Vocabulary, unknown: list) -> DataFrame:
    """(word, n) over all whole texts; words of more than WORD_BYTES bytes are left out."""
    added = list(vocabulary.added)

    def run(batches):
        cutter, counts = Cutter(added, unknown), Counter()

        def sent():
            words = pa.array(list(counts), pa.string()).cast(pa.binary())
            table = pa.RecordBatch.from_pydict({"word": words, "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return table.filter(pc.less_equal(pc.binary_length(words), WORD_BYTES))

        for batch in batches:
            for text in _texts(batch.column(0)):
                for special, words in cutter.words(text):
                    if not special:
                        counts.update(words)
                if len(counts) > HELD:
                    yield sent()
        yield sent()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def packed(arrays: dict[str, np.ndarray], head: dict) -> bytes:
    """One file: the length of its head, the head (JSON, with the place of each array), the arrays."""
    places, at = {}, 0
    for name, x in arrays.items():
        places[name] = (at, x.nbytes)
        at += -(-x.nbytes // 16) * 16
    text = json.dumps(head | {"places": places}).encode()
    text += b" " * (-(len(text) + 4) % 16)
    return len(text).to_bytes(4, "little") + text + b"".join(x.tobytes() + bytes(-x.nbytes % 16) for x in arrays.values())


def compiled(words: list[bytes], vocabulary: Vocabulary, unknown: list) -> bytes:
    """The file of a lexicon of ``words``."""
    arrays = transducer.built((w, tuple(merged(w, vocabulary.singles, vocabulary.ranks, vocabulary.made))) for w in sorted(set(words)))
    lengths = [len(t) for t in vocabulary.tokens]
    arrays |= {
        "singles": np.array(vocabulary.singles, np.int32),
        "pairs": np.array([(pair >> 32, pair & 0xFFFFFFFF, vocabulary.made[rank]) for pair, rank in vocabulary.ranks.items()], np.int32),
        "token_at": np.r_[0, np.cumsum(lengths)].astype(np.int32),
        "token_bytes": np.frombuffer(b"".join(vocabulary.tokens), np.uint8),
    }
    return packed(arrays, {"added": vocabulary.added, "unknown": unknown, "words": len(words)})


class _Seen(dict):
    """Words that a task has met, with their ids."""

    def __init__(self, look):
        super().__init__()
        self._look = look

    def __missing__(self, word: str) -> bytes:
        self[word] = found = self._look(word)
        return found


class Lexicon:
    """A mapped file of :func:`compiled`."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(self._data[:4], "little")
        self.head = json.loads(self._data[4 : 4 + size])
        self._places = {k: (4 + size + at, n) for k, (at, n) in self.head["places"].items()}
        self._reader = transducer.Reader(self._data, self._places)
        self._added = {t: k.to_bytes(4, "little") for t, k in self.head["added"].items()}
        self.cutter = Cutter(list(self._added), self.head["unknown"])
        self._ranks: dict[int, int] | None = None
        self._tokens: list[bytes] | None = None
        self._seen = _Seen(self.word)
        self._many: Merges | None = None

    def array(self, name: str) -> np.ndarray:
        at, n = self._places[name]
        return np.frombuffer(self._data, np.uint8 if name == "token_bytes" else np.int32, count=n if name == "token_bytes" else n // 4, offset=at)

    def word(self, word: str) -> bytes:
        """The ids of one word, as little-endian 32-bit numbers."""
        if (found := self._reader.get(data := word.encode())) is None:
            if self._ranks is None:
                pairs = self.array("pairs").reshape(-1, 3).tolist()
                self._singles, self._made = self.array("singles").tolist(), [new for _, _, new in pairs]
                self._ranks = {a << 32 | b: rank for rank, (a, b, _) in enumerate(pairs)}
            found = array("i", merged(data, self._singles, self._ranks, self._made)).tobytes()
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian 32-bit numbers."""
        return self._joined(self.cutter.words(text))

    def _joined(self, cut: Iterable[tuple[bool, list[str]]]) -> bytes:
        parts, seen = [], self._seen
        for special, words in cut:
            if special:
                parts.append(self._added[words[0]])
                continue
            parts += map(seen.__getitem__, words)
            if len(seen) > SEEN:
                seen.clear()
        return b"".join(parts)

    def encode_all(self, texts: Iterator[str]) -> Iterator[bytes]:
        """:meth:`encode` of each text; the new words of several texts are looked up and merged together."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > WHOLE:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        cut = [list(self.cutter.words(t)) if len(t) <= WHOLE else None for t in texts]
        new: set[str] = set()
        for parts in cut:
            for special, words in parts or ():
                if not special:
                    new.update(words)
        self._learn([w for w in new if w not in self._seen])
        for text, parts in zip(texts, cut, strict=True):
            yield self.encode(text) if parts is None else self._joined(parts)

    def _learn(self, words: list[str]) -> None:
        absent = []
        for w in words:
            data = w.encode()
            if (ids := self._reader.get(data)) is not None:
                self._seen[w] = ids
            elif len(data) <= SHORT:
                absent.append((w, data))
        if absent:
            if self._many is None:
                self._many = Merges(self.array("pairs").reshape(-1, 3), self.array("singles"))
            self._seen.update(zip((w for w, _ in absent), self._many.words([d for _, d in absent]), strict=True))

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; ids beyond the vocabulary give nothing."""
        if self._tokens is None:
            at, data = self.array("token_at").tolist(), self.array("token_bytes").tobytes()
            self._tokens = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        known = ids if not len(ids) or ids.max() < len(self._tokens) else ids[ids < len(self._tokens)]
        return b"".join(map(self._tokens.__getitem__, known.tolist())).decode("utf-8", "replace")


class Codec:
    """Encodes and decodes tables; made by :func:`fit`. Executors get the lexicon's file from Spark and map it."""

    def __init__(self, name: str):
        self._name = name

    def encode(self, docs: DataFrame) -> DataFrame:
        """(doc_id, ids): ids are little-endian 32-bit numbers in one binary value."""
        name = self._name

        def run(batches):
            lexicon = Lexicon(SparkFiles.get(name))
            for batch in batches:
                yield from _in_parts(batch.column(0), lexicon.encode_all(_texts(batch.column(1))), "ids", pa.binary())

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """(doc_id, ids, decoded) of a table of (doc_id, ids)."""
        name = self._name

        def run(batches):
            lexicon = Lexicon(SparkFiles.get(name))
            for batch in batches:
                at = 0
                texts = (lexicon.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(1))
                for part in _in_parts(batch.column(0), texts, "decoded", pa.string()):
                    yield pa.RecordBatch.from_arrays([part.column(0), batch.column(1).slice(at, part.num_rows), part.column(1)], names=["doc_id", "ids", "decoded"])
                    at += part.num_rows

        return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def _in_parts(ids: pa.Array, values: Iterator, name: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    held, size, start = [], 0, 0
    for value in values:
        held.append(value)
        size += len(value)
        if size > OUTPUT:
            yield pa.RecordBatch.from_arrays([ids.slice(start, len(held)), pa.array(held, kind)], names=["doc_id", name])
            start, held, size = start + len(held), [], 0
    if held:
        yield pa.RecordBatch.from_arrays([ids.slice(start, len(held)), pa.array(held, kind)], names=["doc_id", name])


def fit(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> Codec:
    """The codec of the vocabulary file at ``path``, its lexicon compiled from the most frequent words of all ``docs``."""
    spark = docs.sparkSession
    with open(path, "rb") as f:
        source = f.read()
    vocabulary, unknown = Vocabulary(source), unknown_letters()
    frequent = word_counts(docs, vocabulary, unknown).orderBy(F.desc("n"), "word").limit(words).select("word")

    def run(batches):
        listed = [w.as_py() for batch in batches for w in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([compiled(listed, Vocabulary(source), unknown)], pa.binary())], names=["file"])

    made = frequent.coalesce(1).mapInArrow(run, "file binary").first()
    place = scratch_path(spark, "lexicon")
    _write(spark, place, bytes(made.file) if made else compiled([], vocabulary, unknown))
    spark.sparkContext.addFile(place)
    return Codec(place.rpartition("/")[2])


def _write(spark, path: str, data: bytes) -> None:
    """One file of a few MB in the shared folder, through Spark's file systems."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def round_trip(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each whole text's ids and of what they decode to."""
    codec = fit(docs, path, words)
    done = codec.decode(codec.encode(docs))
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
