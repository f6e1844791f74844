"""Byte-pair encoding in linear time, and decoding by an offset table.

Encoding walks a word from left to right. An Aho-Corasick automaton over the
vocabulary gives the longest token at each position; a token is accepted if it
may stand behind the one before it, which the pair table answers; if no token
fits, the walk steps back and shortens the token before. Two tokens may stand
side by side exactly if merging their joint text by rank leaves that border
alone, so the result is that of the merges themselves. A position that proved
to be a dead end is never entered again, which keeps the walk linear.

Normalising and splitting into words are left to the tokenizer file's own
definitions, so Unicode tables agree with the library's.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haplolake.llm.common import _OTHER_SPACES, _SIX, Remember

END = "</w>"
# The last symbol of a word is moved to a plane of its own, so each symbol is one character.
_LAST = 0x10000
MEMO_CHUNK, MEMO_ENTRIES = 64, 250_000

# Below U+0180 letters, numbers and lower case are the same in every Unicode version, and texts are composed
# already, so such texts are split by the same pattern with its classes written out. U+001C to U+001F count
# as white space in Python alone; texts that hold them take the library's own way.
_BEYOND_LATIN = re.compile("[^\x00-\x1b\x20-\u017f]")


def _kind(initial: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == initial)


_LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_kind('L')}]+|[{_kind('N')}]|[^\\s{_kind('L')}{_kind('N')}]+")


class Codec:
    """Tables for one tokenizer file; built once per worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
            raise ValueError("a BPE file with word ends is needed")
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.presplit = library.pre_tokenizer.pre_tokenize_str
        vocab: dict[str, int] = model["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}
        longest_first = sorted(map(re.escape, special), key=len, reverse=True)
        self.special_re = re.compile("|".join(longest_first)) if special else None

        self.symbol = {self._symbols(t): i for t, i in vocab.items()}
        self.rank, self.parts = {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), (r, whole))
            self.parts.setdefault(whole, (r, left, right))
        self.fits = Remember(self._fits, 500_000)

        self.length = {i: len(s) for s, i in self.symbol.items()}
        automaton = ahocorasick.Automaton()
        for s, i in self.symbol.items():
            # A token that its own merges don't give never shows in a result.
            if len(s) == 1 or self._own(i):
                automaton.add_word(s, i)
        self.tokens = automaton
        self.shorter: dict[int, int] = {}
        for s, i in self.symbol.items():
            for n in range(len(s) - 1, 0, -1):
                j = self.symbol.get(s[:n])
                if j is not None and automaton.exists(s[:n]):
                    self.shorter[i] = j
                    break
        automaton.make_automaton()
        self.chunk = Remember(self._chunk, MEMO_ENTRIES)
        self.known = Remember(self._known, MEMO_ENTRIES)

        texts = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in {**vocab, **special}.items():
            texts[i] = " " + t
        encoded = [t.encode() for t in texts]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in encoded])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(encoded), np.uint8)

    @staticmethod
    def _symbols(token: str) -> str:
        body = token.removesuffix(END) if token != END else token
        return body[:-1] + chr(ord(body[-1]) + _LAST) if body != token else token

    def _own(self, token: int) -> bool:
        """Whether the two halves of a token's last merge may stand side by side up to that merge."""
        made = self.parts.get(token)
        return made is None or self._border(made[1], made[2], made[0])

    def _border(self, left: int, right: int, before: int) -> bool:
        """Whether no merge of a rank under ``before`` crosses the border of the two tokens.

        The latest merge inside either token is undone step by step. At each step
        the two symbols that face each other stood there until that merge, so a
        crossing merge of a lower rank would have come first. On the left of the
        border a merge of the same rank comes first, as merging goes left to right.
        """
        limit = before
        while True:
            crossing = self.rank.get((left, right))
            if crossing is not None and crossing[0] < limit:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[2]
            elif a is None or b[0] > a[0]:
                # an equal-ranked crossing merge starts left of this one, so it wins
                limit, right = b[0] + 1, b[1]
            else:
                # the same merge on both sides: the left one was made first
                limit, right = b[0] + 1, b[1]

    def _fits(self, pair: tuple[int, int]) -> bool:
        return self._border(pair[0], pair[1], 1 << 60)

    def word(self, text: str) -> list[int]:
        """Ids of one pre-split word (byte-level characters)."""
        s = text[:-1] + chr(ord(text[-1]) + _LAST)
        whole = self.symbol.get(s)
        if whole is not None and (len(s) == 1 or s in self.tokens):
            return [whole]
        n = len(s)
        longest: list[int] = [0] * n
        length, shorter, fits = self.length, self.shorter, self.fits
        for end, i in self.tokens.iter(s):
            start = end + 1 - length[i]
            if not longest[start] or length[i] > length[longest[start] - 1]:
                longest[start] = i + 1
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0] - 1
        while True:
            end = at + length[token]
            if not dead[end] and (not out or fits[(out[-1], token)]):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end] - 1
                continue
            nxt = shorter.get(token)
            if nxt is not None:
                token = nxt
                continue
            dead[at] = 1
            if not out:
                raise ValueError("the vocabulary has no encoding for a symbol")
            token = out.pop()
            at -= length[token]

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece, _ in self.presplit(self.normalise(chunk)):
            ids += self.word(piece)
        return np.array(ids, "<u4").tobytes()

    def _known(self, word: str) -> bytes:
        return np.array(self.word(word.encode().decode("latin-1").translate(_BYTE_SYMBOL)), "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if not _BEYOND_LATIN.search(text):
            words, memo = _LATIN_WORDS.findall(text.lower()), self.known
            return b"".join([memo[w] if len(w) <= MEMO_CHUNK else self._known(w) for w in words])
        pieces = [p for p in _SIX.split(text) if p] if _OTHER_SPACES.search(text) else text.split()
        memo = self.chunk
        return b"".join([memo[p] if len(p) <= MEMO_CHUNK else self._chunk(p) for p in pieces])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; NULL counts as empty."""
        if not text:
            return b""
        if self.special_re is None or not self.special_re.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of the ids, tokens joined by one space; ids outside the vocabulary give nothing."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        i = i[i < len(self.offsets) - 1]
        start, size = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
        before = np.cumsum(size) - size
        where = np.repeat(start - before, size) + np.arange(int(size.sum()))
        return self.bytes[where].tobytes()[1:]


def _byte_symbols() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


_BYTE_SYMBOL = _byte_symbols()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_ids(text: Column, path: str) -> Column:
    """Token ids packed as little-endian unsigned 32-bit integers (binary)."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for texts in batches:
            yield pd.Series([own.encode(t) for t in texts], dtype=object)

    return run(text)


def decode_ids(ids: Column, path: str) -> Column:
    """Text of packed ids; NULL counts as no ids."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for packed in batches:
            yield pd.Series([own.decode(b or b"").decode() for b in packed], dtype=object)

    return run(ids)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", n: str = "n_tokens") -> DataFrame:
    """Add the packed ids and their number.

    NULL and empty texts give no ids. Repeated rows are encoded alike; no row is
    dropped. Existing columns named like the new ones are replaced.
    """
    out = df.withColumn(ids, encode_ids(F.col(text), path))
    return out.withColumn(n, (F.octet_length(ids) / 4).cast("long"))


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add the text of packed ids."""
    return df.withColumn(text, decode_ids(F.col(ids), path))


def encode_and_decode(df: DataFrame, path: str, keep: list[str], text: str = "text", rows: int = 500) -> DataFrame:
    """The ``keep`` columns with n_tokens, token_ids and decoded, in one pass.

    A worker holds one set of tables and ``rows`` results at a time, whatever the
    size of the batches that reach it. NULL and empty texts give no ids and an
    empty text. ``keep`` must not hold the new names.
    """
    import pyarrow as pa

    source = df.select(*keep, F.col(text).alias("_text"))
    ddl = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                ids = [own.encode(t) for t in part.column("_text").to_pylist()]
                made = {
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "token_ids": pa.array(ids, pa.binary()),
                    "decoded": pa.array([own.decode(x).decode() for x in ids], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made.values()], names=[*keep, *made])

    return source.mapInArrow(run, ddl + ", n_tokens long, token_ids binary, decoded string")


def round_trip(text: Column, path: str) -> Column:
    """Struct of the packed ids' and the decoded text's SHA-256, for texts that need not leave the worker."""
    import hashlib

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for texts in batches:
            rows = []
            for t in texts:
                ids = own.encode(t)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)
