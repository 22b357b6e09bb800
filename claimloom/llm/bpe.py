"""Operator 1: byte-pair encoding and decoding with a deterministic token automaton.

Start from the automaton with one state that accepts every byte string, an arc per byte.
Each merge (u, v) -> uv, in order of rank, is a gadget on it:
  * the state that u leads to is split: its copy, which u now leads to, loses the arc v;
  * every state with an arc u, whose target had the arc v, gains an arc uv; it leads to where v led.
A merge whose u is nowhere followed by v changes nothing, and its token is never used.
After the last gadget each accepted string of arcs is the encoding of the bytes it spells, and
each byte string has exactly one. The state reached by a token depends on that token alone, so
the automaton is kept as one state per token: its `right` link (the state it was copied from),
the arcs lost by each split with the rank at which they went, and the `left` link by which an
arc was gained. Whether a state has an arc follows from these, and is tabulated when first met.

Encoding walks a pre-split word through that table, longest label first; a state without an arc
that continues is left for the last one that has another. Both directions are linear in the
word. Decoding emits the labels of the arcs.

Defined results: a null text counts as empty, and an empty text has no ids. Text that spells an
added token becomes that token, as the library does. A vocabulary file with settings that aren't
implemented is an error. Rows pass through one by one: repeated rows, null ids and extra columns
need no care. Ids are little-endian, as workers' machines are.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import arrow_column, text_bytes

#: Fixed value: the pre-split pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(SPLIT)
#: The same for texts of ASCII and Latin letters only, whose classes the standard library has, too. Other texts have a character of _OTHER.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u024f]")
#: Words that a worker keeps encoded, and arcs; beyond it the table starts anew, and results stay the same.
CACHED_WORDS = 250_000
CACHED_ARCS = 250_000
LONGEST_CACHED = 64
NEVER = 1 << 60


def split(text: str) -> list[str]:
    """The words that are encoded each for itself."""
    return (_SPLIT if _OTHER.search(text) else _LATIN).findall(text)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files, and its byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def check_supported(spec: dict) -> None:
    """ValueError for a vocabulary file with settings that would change results and aren't implemented here."""
    model, split, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    wrong = [f"model {k}={model[k]!r}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [] if model.get("type", "BPE") == "BPE" else [f"model type {model['type']}"]
    wrong += [k for k in ("normalizer", "post_processor") if spec.get(k)]
    wrong += [] if split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) else ["pre_tokenizer"]
    wrong += [] if decoder.get("type") == "ByteLevel" else ["decoder"]
    wrong += [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if wrong:
        raise ValueError(f"not supported: {', '.join(wrong)}")


class Automaton:
    """The token automaton of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_supported(spec)
        alphabet = byte_alphabet()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.label: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        added = [(t["content"], t["id"]) for t in spec.get("added_tokens", [])]
        self.added = {c: array("I", [i]).tobytes() for c, i in added}
        self.added_pattern = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.label |= {i: c.encode() for c, i in added}
        self.size = max(self.label) + 1
        self.spelled = [self.label.get(i, b"") for i in range(self.size)]
        # One state per token. Bytes exist from the start.
        self.left, self.right, self.born = [-1] * self.size, [-1] * self.size, [NEVER] * self.size
        self.lost: dict[int, int] = {}  # state * size + arc -> rank of the gadget that took the arc away
        # Labels as a transition table on bytes: node * 256 + byte -> node; and each node's token, if any.
        self.step: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for t, b in ((t, alphabet[t]) for t in alphabet if t in vocab):
            self._spell(vocab[t], bytes([b]))
        self.live = [False] * self.size  # tokens that some state has an arc for
        for t in alphabet:
            if t in vocab:
                self.live[vocab[t]] = True
        for rank, pair in enumerate(merges):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v])
        # The longest shorter token that a token's label begins with: where to go if an arc isn't there.
        self.shorter = [self._shorter(x) for x in self.spelled]
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def _spell(self, token: int, label: bytes) -> None:
        node = 0
        for b in label:
            after = self.step.get(node * 256 + b)
            if after is None:
                after = self.step[node * 256 + b] = len(self.token_at)
                self.token_at.append(-1)
            node = after
        self.token_at[node] = token

    def _shorter(self, label: bytes) -> int:
        node, found = 0, -1
        for b in label[:-1]:
            node = self.step.get(node * 256 + b, -1)
            if node < 0:
                break
            if self.token_at[node] >= 0:
                found = self.token_at[node]
        return found

    def _gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        if not (self.live[u] and self.live[v] and self._has_arc(u, v)):
            return  # no state has both arcs one after the other, so the merge never happens
        if self.live[uv]:
            raise ValueError("not supported: two merges that make one token")
        self.lost[u * self.size + v] = rank
        self.left[uv], self.right[uv], self.born[uv], self.live[uv] = u, v, rank, True
        self._spell(uv, self.label[uv])

    def has_arc(self, state: int, arc: int) -> bool:
        """Whether the state that token `state` leads to has an arc `arc` after all gadgets."""
        key = state * self.size + arc
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= CACHED_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._has_arc(state, arc)
        return known

    def _has_arc(self, state: int, arc: int) -> bool:
        # The states of which `state` is a copy, each with the rank at which that copy was made.
        copies, x, until = [], state, NEVER
        while x >= 0:
            copies.append((x * self.size, until))
            x, until = self.right[x], self.born[x]
        # The arcs from which `arc` was gained, each with the rank at which that happened.
        lost, y, until = self.lost, arc, NEVER
        while y >= 0:
            for x, copied in copies:
                at = lost.get(x + y)
                if at is not None and at < copied and at <= until:
                    return False
            y, until = self.left[y], self.born[y]
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """The one path of the automaton that spells word."""
        n = len(word)
        step, token_at, shorter, spelled, arcs, size = self.step, self.token_at, self.shorter, self.spelled, self.arcs, self.size
        path: list[int] = []
        at, last = 0, -1
        dead: set[int] = set()  # ends from which no path goes on
        arc = -2
        while at < n:
            if arc == -2:  # the longest label here
                node, arc = 0, -1
                for k in range(at, n):
                    node = step.get(node * 256 + word[k])
                    if node is None:
                        break
                    if token_at[node] >= 0:
                        arc = token_at[node]
            # The longest one that is an arc of this state and leads on.
            while arc >= 0:
                end = at + len(spelled[arc])
                if end not in dead:
                    if last < 0:
                        break
                    known = arcs.get(last * size + arc)
                    if known if known is not None else self.has_arc(last, arc):
                        break
                arc = shorter[arc]
            if arc >= 0:
                path.append(arc)
                at, last, arc = end, arc, -2
                continue
            if not path:
                raise ValueError("the vocabulary does not spell this word")
            dead.add(at)
            gone = path.pop()
            at -= len(spelled[gone])
            last = path[-1] if path else -1
            arc = shorter[gone]
        return path

    def _encoded(self, word: str) -> bytes:
        ids = array("I", self.encode_word(word.encode())).tobytes()
        if len(word) <= LONGEST_CACHED:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.added_pattern is None or not self.added_pattern.search(text):
            return self._encode_plain(text)
        out, at = [], 0
        for m in self.added_pattern.finditer(text):
            out += [self._encode_plain(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self._encode_plain(text[at:])])

    def _encode_plain(self, text: str) -> bytes:
        known, encoded = self.words.get, self._encoded
        return b"".join([known(w) or encoded(w) for w in split(text)])

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, as text."""
        return b"".join(map(self.spelled.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Compiled once in each worker process."""
    return Automaton(path)


def _encoder(path: str, with_text: bool):
    def run(texts: pa.Array) -> pa.Array:
        a = automaton(path)
        ids, decoded = [], []
        for rows in text_bytes(texts):
            for t in rows:
                ids.append(a.encode(t.decode()) if t else b"")
                if with_text:
                    decoded.append(a.decode(ids[-1]))
        if not with_text:
            return pa.array(ids, pa.binary())
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return run


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(text: Column, path: str) -> Column:
    """Ids of a text: binary, little-endian unsigned 32-bit. The file at `path` must be on every worker."""
    return arrow_column(_encoder(path, False), "binary")(text)


def decode(ids: Column, path: str) -> Column:
    """Text of packed ids; bytes that aren't UTF-8 become U+FFFD. Null gives null."""

    def run(packed: pa.Array) -> pa.Array:
        a = automaton(path)
        return pa.array([None if x is None else a.decode(x) for x in packed.to_pylist()], pa.string())

    return arrow_column(run, "string")(ids)


def round_trip(text: Column, path: str) -> Column:
    """Struct of the packed ids of a text and the text that they decode to, in one pass."""
    return arrow_column(_encoder(path, True), "ids binary, decoded string")(text)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): one row per row of docs."""
    packed = docs.select(docs[id_col], encode(docs[text_col], path).alias("ids"))
    return packed.select(id_col, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")
