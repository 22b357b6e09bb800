"""Operator 12: SentencePiece encoding and decoding of merge-type (BPE) models, exactly, by backtracking.

The library joins, again and again, the two neighbours whose concatenation is the best-scored piece,
the leftmost of equal ones, until no concatenation is a piece. Two facts make that checkable piece
by piece: a result's stretches are results of their own texts, as no join crossed their borders; and
a sequence is the result of its text if every two neighbours are the result of theirs, since the
first join across a border would also have been made in the text of those two. So encoding is:
  * an Aho-Corasick automaton of all pieces gives the longest piece that starts at each place, and
    each piece knows the next shorter piece that it starts with;
  * from the left, the longest piece goes on that is compatible with the one before it: joining the
    characters of both texts again gives just these two (kept in a bounded table);
  * where none goes on, the place is marked in a bitfield of failed places, the last piece is taken
    back and a shorter one tried. A place fails once, so the work is linear in the text for pieces of
    bounded length.
A text is cut where no piece can cross (before white space that follows something else, if no piece
has white space inside, and at line feeds, if no piece has one), so that words repeat and are kept.

Characters that no piece has become their UTF-8 bytes' pieces. Encoding puts the white-space mark
before a text that isn't empty, and the end id behind every text. Decoding drops control ids and the
mark at the start, joins byte pieces, and gives U+FFFD for each byte that isn't UTF-8.

Defined results: a null text counts as empty, and an empty text is the end id alone. U+2581 in a text
is white space to the library, and comes back as a blank. Repeated rows, null ids and extra columns
pass through. A model with settings that aren't implemented is an error.
"""

from __future__ import annotations

import functools
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import arrow_column, text_bytes

#: The mark that stands for white space, kinds of pieces, fields of a model file.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, SUFFIX_MARK, BYTE_FALLBACK, UNK_ID, EOS_ID = 3, 24, 35, 40, 42
CHARS_MAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
BPE = 2
#: Words that a worker keeps, twice: when the table is full it becomes the older one, and words that are met again move from there. Pairs of pieces that it keeps before it starts anew. Results stay the same.
CACHED_WORDS = 250_000
CACHED_PAIRS = 500_000
LONGEST_CACHED = 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def check_supported(trainer: dict, normalizer: dict, kinds: list[int]) -> None:
    """ValueError for a model with settings that would change results and aren't implemented here."""
    wrong = [] if trainer.get(MODEL_TYPE, 1) == BPE else ["model type"]
    wrong += [] if trainer.get(BYTE_FALLBACK) and kinds.count(BYTE) == 256 else ["no byte fallback"]
    wrong += ["white space as suffix"] if trainer.get(SUFFIX_MARK) else []
    wrong += ["normalization"] if normalizer.get(CHARS_MAP) else []
    wrong += [] if normalizer.get(DUMMY_PREFIX, 1) else ["no mark at the start"]
    wrong += ["removal of white space"] if normalizer.get(REMOVE_EXTRA, 1) else []
    wrong += [] if normalizer.get(ESCAPE, 1) else ["white space as it is"]
    wrong += ["user-defined or unused pieces"] if {USER_DEFINED, UNUSED} & set(kinds) else []
    if wrong:
        raise ValueError(f"not supported: {', '.join(wrong)}")


class Pieces:
    """A model file, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(fields(f.read()))
        entries = [dict(fields(v)) for n, v in message if n == PIECES]
        trainer, normalizer = (next((dict(fields(v)) for n, v in message if n == part), {}) for part in (TRAINER, NORMALIZER))
        self.kinds = [e.get(3, NORMAL) for e in entries]
        check_supported(trainer, normalizer, self.kinds)
        self.spelled = [e[1].decode() for e in entries]
        score = [struct.unpack("<f", e[2])[0] if 2 in e else 0.0 for e in entries]
        self.end_id = trainer.get(EOS_ID, 2)
        self.ids = {s: i for i, s in enumerate(self.spelled) if self.kinds[i] == NORMAL}
        self.of_byte = [self.ids_of_kind(BYTE)[f"<0x{b:02X}>"] for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.of_byte)}
        alphabet = {c for s in self.ids for c in s}
        if not alphabet <= self.ids.keys():
            raise ValueError("not supported: a character of a piece isn't a piece")
        self.score = {s: score[i] for s, i in self.ids.items()}
        self.length = [len(s) for s in self.spelled]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in self.ids.items():
            self.machine.add_word(s, i)
        self.shorter = [self._shorter(s) if self.kinds[i] == NORMAL else -1 for i, s in enumerate(self.spelled)]
        self.machine.make_automaton()
        crossing = any(re.search(f"[^{MARK}]{MARK}", s) for s in self.ids)
        cut = "" if "\n" in alphabet else "\n"
        self.cut = None if crossing else re.compile(f"{MARK}+[^{MARK}{cut}]*|[^{MARK}{cut}]+" + ("|\n" if cut else ""))
        self.size = len(self.spelled)
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes_of = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([self.byte_of[i]]) if k == BYTE else s.replace(MARK, " ").encode() for i, (k, s) in enumerate(zip(self.kinds, self.spelled, strict=True))]

    def ids_of_kind(self, kind: int) -> dict[str, int]:
        return {s: i for i, s in enumerate(self.spelled) if self.kinds[i] == kind}

    def _shorter(self, piece: str) -> int:
        return next((self.ids[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), -1)

    def join_again(self, text: str) -> list[str]:
        """The joins of a short text, one after the other."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def is_result(self, piece: int) -> bool:
        """Whether the piece's own text becomes that piece."""
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = self.join_again(self.spelled[piece]) == [self.spelled[piece]]
        return known

    def are_compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces' text becomes just these two. left is -1 at the start."""
        if left < 0:
            return self.is_result(right)
        key = left * self.size + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            a, b = self.spelled[left], self.spelled[right]
            known = self.pairs[key] = self.join_again(a + b) == [a, b]
        return known

    def encode_known(self, word: str, longest: list[int]) -> list[int]:
        """Pieces of a text whose every character is a piece; longest has the longest piece at each place."""
        n, length, shorter, pairs, size = len(word), self.length, self.shorter, self.pairs, self.size
        if length[longest[0]] == n and self.is_result(longest[0]):
            return [longest[0]]
        path: list[int] = []
        failed = bytearray((n >> 3) + 1)
        at, last, piece = 0, -1, longest[0]
        while True:
            while piece >= 0:
                end = at + length[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    known = pairs.get(last * size + piece) if last >= 0 else None
                    if known if known is not None else self.are_compatible(last, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                path.append(piece)
                if end == n:
                    return path
                at, last, piece = end, piece, longest[end]
                continue
            failed[at >> 3] |= 1 << (at & 7)
            gone = path.pop()
            at -= length[gone]
            last = path[-1] if path else -1
            piece = shorter[gone]

    def encode_word(self, word: str) -> list[int]:
        """Pieces of a stretch of text that starts and ends where no piece can cross."""
        n, length = len(word), self.length
        longest = [-1] * n
        for end, piece in self.machine.iter(word):
            longest[end - length[piece] + 1] = piece  # later ones that start at the same place are longer
        if -1 not in longest:
            return self.encode_known(word, longest)
        out, at = [], 0
        while at < n:  # stretches of known characters, and the bytes of others
            stop = at
            while stop < n and longest[stop] >= 0:
                stop += 1
            if stop > at:
                out += self.encode_known(word[at:stop], longest[at:stop])
            if stop < n:
                out += [self.of_byte[b] for b in word[stop].encode()]
            at = stop + 1
        return out

    def _encoded(self, word: str) -> bytes:
        ids = self.older.get(word) or array("i", self.encode_word(word)).tobytes()
        if len(word) <= LONGEST_CACHED:
            if len(self.words) >= CACHED_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text and the end id, as 32-bit integers."""
        marked = MARK + text.replace(" ", MARK) if text else ""
        words = self.cut.findall(marked) if self.cut else [marked] if marked else []
        out = [self.words.get(w) or self._encoded(w) for w in words]
        return b"".join(out) + array("i", [self.end_id]).tobytes()

    def decode(self, ids) -> str:
        """The text that ids stand for."""
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        if first is None:
            return ""
        try:  # bytes that are UTF-8 in all are so in each of their runs
            text = b"".join(map(self.bytes_of.__getitem__, ids)).decode()
            return text[1:] if self.spelled[first].startswith(MARK) else text
        except UnicodeDecodeError:
            return self._decode_odd(ids)

    def _decode_odd(self, ids) -> str:
        out: list[str] = []
        held = bytearray()
        at_start = True
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(decode_bytes(bytes(held)))
                held.clear()
                at_start = False
            kind, s = self.kinds[i], self.spelled[i]
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                s = " ⁇ "  # as the library shows it
            elif at_start and s.startswith(MARK):
                s = s[1:]
            at_start = False
            out.append(s.replace(MARK, " "))
        out.append(decode_bytes(bytes(held)))
        return "".join(out)


def decode_bytes(data: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that doesn't belong to a character."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [data[at : at + e.start].decode(), "�"]
            at += e.start + 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def model(path: str) -> Pieces:
    """Compiled once in each worker process."""
    return Pieces(path)


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _encoder(path: str, with_text: bool):
    def run(texts: pa.Array) -> pa.Array:
        m = model(path)
        ids, decoded = [], []
        for rows in text_bytes(texts):
            for t in rows:
                ids.append(m.encode(t.decode() if t else ""))
                if with_text:
                    decoded.append(m.decode(memoryview(ids[-1]).cast("i")))
        if not with_text:
            return _lists(ids)
        return pa.StructArray.from_arrays([_lists(ids), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return run


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(text: Column, path: str) -> Column:
    """Ids of a text, the end id last: array<int>. The file at `path` must be on every worker."""
    return arrow_column(_encoder(path, False), "array<int>")(text)


def decode(ids: Column, path: str) -> Column:
    """Text of ids. Null gives null; ids that the model lacks are an error."""

    def run(lists: pa.Array) -> pa.Array:
        m = model(path)
        return pa.array([None if x is None else m.decode(x) for x in lists.to_pylist()], pa.string())

    return arrow_column(run, "string")(ids)


def round_trip(text: Column, path: str) -> Column:
    """Struct of a text's ids and the text that they decode to, in one pass."""
    return arrow_column(_encoder(path, True), "ids array<int>, decoded string")(text)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): one row per row of docs."""
    rows = docs.select(docs[id_col], encode(docs[text_col], path).alias("ids"))
    return rows.select(id_col, F.size("ids").cast("bigint").alias("n_tokens"), "ids")
