"""Byte-pair encoding and decoding by forced-boundary splitting.

The vocabulary file says how text is normalised and cut into words, which byte-level symbols exist and which pairs merge. A merge
can only join bytes that stand next to each other inside some token. So a pair of bytes that occurs inside no token is a certain cut:
no merge ever crosses it, and what lies on either side can be encoded alone. With the word end as one more byte, a single
256 x 256 table holds all such pairs, ends of words included. A text is cut by one lookup over its bytes; the fragments are merged
independently (each distinct one once for a while) and their ids are concatenated.

Row-local columns: no shuffle, no skew. A fragment that no pair cuts is merged with a heap, in n log n steps however long it is.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_END = b"\n"  # ends a word; white space is never inside one
_BLOCK = 1 << 20
_HELD = 1 << 18
_HELD_BYTES = 32
_FIRST_YOUNG = 0x0530  # no character below is younger than Unicode 15
# How the vocabulary cuts normalised text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
# Bytes that stand for themselves in byte-level symbols; the others are numbered from 256 on.
PLAIN_BYTES = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary's tokens."""
    plain = [b for a, z in PLAIN_BYTES for b in range(a, z + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


@lru_cache(1)
def _newer() -> re.Pattern:
    """Characters that are younger than the Unicode tables of this Python, so whose class and case only the library knows."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    young = np.array([ord(c) for run in regex.findall(r"\P{Cn}+", every) for c in run if unicodedata.category(c) == "Cn"], np.int64)
    runs = np.split(young, np.flatnonzero(np.diff(young) > 1) + 1) if len(young) else []
    return re.compile("[" + "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs) + "]" if runs else "(?!)")


def _has_newer(text: str) -> bool:
    # Most scripts lie below the first young character, which the greatest UTF-16 unit tells at once.
    return int(np.frombuffer(text.encode("utf-16-le"), "<u2").max()) >= _FIRST_YOUNG and _newer().search(text) is not None


class Codec:
    """One vocabulary file: words, forced boundaries and merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        model, added = spec["model"], spec.get("added_tokens") or []
        if model["type"] != "BPE" or spec.get("decoder") is not None:
            raise ValueError("a byte-level BPE file with word ends and without a decoder is asked for")  # its words are cut as WORDS says
        ids: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.path = path
        self.inner = [ids.get(s) for s in symbols]
        self.last = [ids.get(s + suffix) for s in symbols]
        self.special = {a["content"]: np.array([a["id"]], "<u4").tobytes() for a in added}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pair[ids[a], ids[b]] = rank, ids[a + b]
        of_symbol = {s: b for b, s in enumerate(symbols)}
        #: ``inside[x, y]``: byte y follows byte x inside some token. Everything else is a certain cut.
        self.inside = np.zeros((256, 256), bool)
        for t in ids:
            whole = bool(suffix) and t.endswith(suffix)
            raw = np.array([of_symbol[c] for c in (t[: -len(suffix)] if whole else t)] + [_END[0]] * whole, np.uint8)
            self.inside[raw[:-1], raw[1:]] = True
        self.inside[_END[0]] = False  # a line break as a byte of its own cannot occur: white space is dropped
        self._words, self._ascii = regex.compile(WORDS), re.compile(ASCII_WORDS, re.ASCII)
        self._library = None
        self._held: dict[bytes, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Normalised words: NFC, lower case character by character, white space dropped."""
        if text.isascii():
            return self._ascii.findall(text.lower())
        if _has_newer(text):
            return self._library_words(text)
        text = unicodedata.normalize("NFC", text)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # a last sigma has no form of its own here
        return self._words.findall(text)

    def _library_words(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        text = self._library.normalizer.normalize_str(text)
        back = {s: b for b, s in enumerate(byte_symbols())}
        return [bytes(map(back.get, w)).decode() for w, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def fragments(self, words: list[str]) -> list[bytes]:
        """The words' bytes, each word ended, cut wherever two neighbours stand inside no token."""
        if not words:
            return []
        raw = ("\n".join(words) + "\n").encode()
        b = np.frombuffer(raw, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1).tolist(), len(raw)]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def merged(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the pair of least rank, leftmost first, is merged until none is left."""
        body, ended = (fragment[:-1], True) if fragment.endswith(_END) else (fragment, False)
        ids = [i for i in [self.inner[b] for b in body[: len(body) - ended]] + [self.last[b] for b in body[len(body) - ended :]] if i is not None]
        n, pair = len(ids), self.pair
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(pair[p][0], i, pair[p][1], *p) for i, p in enumerate(zip(ids, ids[1:])) if p in pair]
        heapq.heapify(heap)
        while heap:
            _, i, new, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue  # one of the two is merged already
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (p := (ids[left], ids[right])) in pair:
                    rank, made = pair[p]
                    heapq.heappush(heap, (rank, left, made, *p))
        return [i for i in ids if i >= 0]

    def _of(self, fragment: bytes) -> bytes:
        got = self._held.get(fragment)
        if got is None:
            got = np.array(self.merged(fragment), "<u4").tobytes()
            if len(fragment) <= _HELD_BYTES:
                if len(self._held) >= _HELD:
                    self._held.clear()
                self._held[fragment] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for block in _blocks(part):
                out.extend(map(self._of, self.fragments(self.words(block))))
        return b"".join(out)


class Decoder:
    """The tokens of one vocabulary file by id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("decoder") is not None:
            raise ValueError("a file without a decoder is asked for")
        self.token = {i: t for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec.get("added_tokens") or []}

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids with one space between them; ids that name no token give nothing."""
        return " ".join([t for t in map(self.token.get, np.frombuffer(ids, "<u4").tolist()) if t is not None])


def _blocks(text: str) -> Iterator[str]:
    """A long text in parts that begin with white space, where neither words nor composed characters are cut."""
    at = 0
    while len(text) - at > _BLOCK and (m := re.compile("[ \t\r\n]").search(text, at + _BLOCK)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(text: Column, path: str) -> Column:
    """The token ids of each text, packed as little-endian unsigned 32-bit integers; no ids for NULL or an empty text.

    Strings of the vocabulary's special tokens in a text are those tokens. ``path`` is a file that every executor can open. Rows do not
    influence each other: repeated rows give equal results, and other columns are not looked at.
    """

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = codec(path)
        for texts in batches:
            yield pa.array((of.encode(t.as_py() or "") for t in texts), pa.binary())

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """The text of packed ids: their tokens with one space between them; empty for NULL or no ids."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = decoder(path)
        for packed in batches:
            yield pa.array((of.decode(p.as_py() or b"") for p in packed), pa.string())

    return run(ids)


def encode_and_decode(text: Column, path: str) -> Column:
    """``ids`` as of ``encode`` and ``decoded`` as of ``decode``, in one pass of one Python worker."""

    @F.arrow_udf("ids binary, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        there, back = codec(path), decoder(path)
        for texts in batches:
            ids = pa.array((there.encode(t.as_py() or "") for t in texts), pa.binary())
            yield pa.StructArray.from_arrays([ids, pa.array((back.decode(p.as_py()) for p in ids), pa.string())], ["ids", "decoded"])

    return run(text)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
