"""What the training-data operators share: working folders, Arrow helpers, cached tokenizing, word hashing."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.session import FEW, arrow_rows, discard, drop_path, light, stored, work_dir

__all__ = ["FEW", "arrow_rows", "discard", "drop_path", "light", "stored", "work_dir"]


def partitions(spark: SparkSession, size: int = 0, each: int = 64 << 20) -> int:
    """Shuffle partitions: as set, or more where `size` bytes would make parts of over `each`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def free(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def binary_array(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def with_several(rows: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """rows(key, text, ...) with `several`: does the key have different texts? And whether any key has."""
    found = rows.select(key, F.xxhash64("text").alias("t")).where(F.col(key).isNotNull()).groupBy(key).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    found = stored(found.where("lo != hi").select(key, F.lit(True).alias("several")), "several")
    n = found.count()
    if not n:
        discard(found)
        return rows.withColumn("several", F.lit(False)), False
    joined = rows.join(F.broadcast(found) if n <= FEW else found, key, "left")
    return joined.withColumn("several", F.coalesce("several", F.lit(False))), True


# --- tokenizing ---------------------------------------------------------------------------------------------

#: White space as the tokenizers' regular expressions see it. Fixed values.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters that are single characters in every normal form. A run of them before white space, or before one mark
#: and white space, is a piece without the mark.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECE = re.compile(f" ?[{_LETTERS}]+(?=[.,;:!?]?(?:[{_WS}]|\\Z))| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
_PLAIN = re.compile(f" ?[{_LETTERS}]+")
#: White space of several bytes, by code point; ASCII letters and marks (but for the apostrophe of 's) by byte. Fixed values.
_WIDE = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_ASCII_LETTERS, _MARKS = (np.array([test(chr(b)) for b in range(128)] + [False] * 128) for test in (str.isalpha, lambda c: c.isprintable() and not c.isalnum() and c not in " '"))
#: Bytes of text whose pieces are found and joined at once; a longer text is taken alone.
_GROUP = 4 << 20


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class Pieces(dict):
    """A tokenizer whose results for pieces between white space are kept and joined.

    Both tokenizers split a text before a run of non-spaces and its one leading space, and between a letter and
    a mark, whatever stands around, so the ids of a text are the ids of its pieces in order. Pieces are cut on the
    bytes of some MB of texts at once, and each different one is looked up once there; texts with white space
    beyond ASCII or added tokens go one by one. Two generations of about `limit` pieces each are kept. A piece of
    letters goes to the tokenizer's model at once, without the splitting that would leave it whole; probes at the
    start see that this gives the same ids.

    With `added`, the tokenizer's added tokens (<|endoftext|>) in a text are their own ids, as in encode() of an
    untouched Tokenizer; otherwise they are text like any other.
    """

    def __init__(self, path: str, limit: int = 500_000, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        # None of the tokenizers' added tokens is normalized, strips white space or asks for a whole word.
        whole = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True) if added else []
        self.added = re.compile("(" + "|".join(map(re.escape, whole)) + ")") if whole else None
        self.added_bytes = re.compile(self.added.pattern.encode()) if whole else None
        self.model, self.limit = self.tokenizer.model, limit
        self.old: dict[str, bytes] = {}
        self.ready = False
        self.folded = self.tokenizer.normalizer is not None
        probes = [" the", "Then", " Öffnung", "élève", " Straße", " international", "antidisestablishment", "Ÿ", " ÿ"]
        self.ready = all(self._of_model(p) == self._of_text(p) for p in probes)

    def vocabulary(self) -> int:
        return max(self.tokenizer.get_vocab().values()) + 1

    def _of_text(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _of_model(self, piece: str) -> bytes:
        word = piece.strip(" ").lower() if self.folded else piece
        if word.isascii():
            letters = word.replace(" ", "\u0120")
        else:
            letters = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            plain = self.ready and (piece[1:].isalpha() and piece.isascii() and (piece[0] == " " or piece.isalpha()) or _PLAIN.fullmatch(piece))
            ids = self._of_model(piece) if plain else self._of_text(piece)
        if len(piece) < 200:
            self[piece] = ids
        return ids

    def _renew(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Per text its ids as unsigned 32-bit integers (little-endian, as all machines that Spark runs on)."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        if not len(column) or column.buffers()[2] is None:
            return [b""] * len(column)
        odd = self._odd(*_bytes_of(column))
        if not odd.any():
            return self._grouped(column)
        others = iter(self._grouped(column.filter(pa.array(~odd))))
        return [self._alone(text.as_py()) if apart else next(others) for text, apart in zip(column, odd.tolist())]

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold white space of several bytes or added tokens."""
        odd = np.zeros(len(offsets) - 1, bool)
        at = np.flatnonzero((data == 0xC2) | (data - np.uint8(0xE1) < 3))
        if len(at):
            lead, one, two = (data[np.minimum(at + k, len(data) - 1)].astype(np.int64) for k in range(3))
            point = np.where(lead == 0xC2, one, (lead & 15) << 12 | (one & 63) << 6 | two & 63)
            odd[np.searchsorted(offsets[1:], at[np.isin(point, _WIDE)], "right")] = True
        if self.added:
            raw, find = memoryview(data), self.added_bytes.search
            odd |= np.fromiter((find(raw, a, z) is not None for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())), bool, len(odd))
        return odd

    def _alone(self, text: str) -> bytes:
        self._renew()
        get, split = self.__getitem__, _PIECE.findall
        # Odd parts are added tokens; white space before one ends its own part.
        parts = self.added.split(text) if self.added else [text]
        return b"".join(self._of_text(p) if k % 2 else b"".join(map(get, split(p))) for k, p in enumerate(parts))

    def _grouped(self, column: pa.Array) -> list[bytes]:
        if not len(column):
            return []
        (data, offsets), out, at = _bytes_of(column), [], 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _GROUP, "right")) - 1)
            self._renew()
            out += self._joined(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end
        return out

    def _joined(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        starts = _cuts(data, offsets)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
        which = pieces.indices.to_numpy()
        found = list(map(self.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False).tolist()))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(sizes) - sizes
        several = sizes[which]
        ends = np.concatenate([[0], np.cumsum(several)])
        at = np.repeat(first[which] - ends[:-1], several)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(found), "<u4")[at].tobytes()
        bounds = (4 * ends[np.searchsorted(starts, offsets)]).tolist()
        return [ids[a:z] for a, z in zip(bounds, bounds[1:])]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string column, and where each text begins there, with the end of the last."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in UTF-8 texts side by side whose white space is ASCII."""
    if not len(data):
        return np.empty(0, np.int64)
    breaks = data - np.uint8(9) < 5
    white = breaks | (data == 32)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = white[1:] > white[:-1]
    # The last of several white characters before a word stands by itself or with the word.
    at = np.flatnonzero(white[1:] & white[:-1]) + 1
    if len(at):
        last = np.zeros(len(data), bool)
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        at = at[~last[at]]
        cut[at[~white[at + 1]]] = True
    # A word goes with a space before it, but with no other white character.
    at = np.flatnonzero(breaks) + 1
    cut[at[~white[np.minimum(at, len(data) - 1)]]] = True
    # Between a letter (one byte, or two from 0xC3 on) and a mark.
    at = np.flatnonzero(_MARKS[data[1:]]) + 1
    before = data[at - 1]
    wide = (before >= 0x80) & (data[at - 2] == 0xC3) & (before != 0x97) & (before != 0xB7)
    cut[at[_ASCII_LETTERS[before] | wide]] = True
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


_PIECES: dict[tuple[str, bool], Pieces] = {}


def pieces_of(path: str, added: bool = False) -> Pieces:
    """One per worker process, kept from task to task."""
    if (path, added) not in _PIECES:
        _PIECES[path, added] = Pieces(path, added=added)
    return _PIECES[path, added]


# --- words --------------------------------------------------------------------------------------------------


class WordHashes(dict):
    """64-bit hash of a word's bytes, computed once per worker and word while at most `limit` are kept."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


WORD_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (finalizer with fixed multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Mixed polynomial hash of each run of `width` consecutive hashes; runs are put together from halves."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    out, have = None, 0
    part, size = hashes, 1
    while True:
        if width & size:
            # `out` covers the first `have` places of a run; the next `size` follow.
            out = part[:n] if out is None else out[:n] * power(size) + part[have : have + n]
            have += size
        if have == width:
            return mix(out[:n])
        part = part[: len(part) - size] * power(size) + part[size:]
        size *= 2


BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
