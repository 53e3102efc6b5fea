"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece exactly one token can be the last token of the
prefix's encoding: the one that ends there and forms a stable pair with the last
token of the prefix before it. Storing that token per prefix gives the encoding
by walking back, makes an append a matter of the new positions only, and makes an
edit a matter of the positions up to where the stored tokens agree again.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from observatory.llm.arrow import filled, held

#: Entries after which a worker's cache of encoded chunks is dropped and begun anew.
CACHE_ENTRIES = 500_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


_NONE: dict = {}


class Vocabulary:
    """Ranks, the pair each token is merged from, and which neighbours are stable."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes = {i: t for t, i in ranks.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.known: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.parts[rank] = (rank, rank)
            for at in range(len(token) - 1, 0, -1):
                left, right = ranks.get(token[:at], rank), ranks.get(token[at:], rank)
                if left < rank and right < rank and self._stable(left, right):
                    self.merged[left, right] = rank
                    self.parts[rank] = (left, right)
                    break
        #: Tokens read from their ends: a byte leads to (the bytes before it, the token that the bytes so far are, or -1).
        self.back: dict[int, tuple[dict, int]] = {}
        nodes: dict[bytes, dict] = {b"": self.back}
        made = {t: r for t, r in ranks.items() if len(t) == 1 or self.parts[r][0] != r}  # merging cannot make the others
        inner = {t[i:] for t in made for i in range(1, len(t))}
        for suffix in sorted(inner | made.keys(), key=len):
            node = nodes[suffix] = {} if suffix in inner else _NONE
            nodes[suffix[1:]][suffix[0]] = node, made.get(suffix, -1)
        self.packed = {r: r.to_bytes(4, "little") for r in self.bytes}

    def _stable(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two tokens standing.

        Undoes the merges on both sides of the border, latest first. A merge across
        the border that ranks before the merge undone last would have come first.
        """
        bound = 1 << 62
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            inner, outer = self.parts[left][1], self.parts[right][0]
            left_done, right_done = inner == left, outer == right
            if left_done and right_done:
                return True
            if right_done or (not left_done and left > right):
                bound, left = left, inner
            else:
                # of equal merges the left one is made first
                bound, right = right + 1, outer

    def stable(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        got = self.known.get(pair)
        if got is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            got = self.known[pair] = self._stable(left, right)
        return got

    def extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Adds the last tokens of the prefixes of ``data`` up to ``stop`` bytes; last[i] is of i + 1 bytes.

        From each end it reads backwards until no token has the suffix read, and
        takes the token that is stable behind the prefix before it; there is one.
        """
        root, known, stable = self.back, self.known.get, self.stable
        for end in range(len(last), stop):
            children, at = root, end
            while True:
                step = children.get(data[at])
                if step is None:
                    raise ValueError(f"byte {data[end]} is not in the vocabulary")
                children, token = step
                if token >= 0 and (not at or known(last[at - 1] << 32 | token) or stable(last[at - 1], token)):
                    last.append(token)
                    break
                at -= 1
                if at < 0:
                    raise ValueError(f"byte {data[end]} is not in the vocabulary")

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        """The ids, from the last token backwards."""
        out, end, length = [], len(data), self.bytes
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(length[token])
        return out[::-1]

    def whole(self, piece: bytes) -> list[int]:
        """The ids of one piece; a piece that is itself a token is that token."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        last: list[int] = []
        self.extend(piece, last, len(piece))
        return self.walk(piece, last)


class Prefixes:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Costs the new bytes only."""
        self.data += more
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` in the place of data[start:end]; returns how many prefixes it encoded again.

        Behind the edit the old tokens hold again once as many positions in a row as
        the longest token has bytes carry the same tokens as before.
        """
        data = self.data[:start] + new + self.data[end:]
        last, shift, same, done = self.last[:start], len(new) - (end - start), 0, 0
        for stop in range(start + 1, len(data) + 1):
            self.vocabulary.extend(data, last, stop)
            token = last[-1]
            done += 1
            was = stop - 1 - shift
            same = same + 1 if stop > start + len(new) and self.last[was] == token else 0
            if same >= self.vocabulary.longest:
                last += self.last[was + 1 :]
                break
        self.data, self.last = data, last
        return done

    def ids(self) -> list[int]:
        return self.vocabulary.walk(self.data, self.last)


_MARKS = {".", ",", "!", "?", ";", ":"}


class _Chunks(dict):
    """Text chunk to packed ids; ``before`` stands before each chunk."""

    def __init__(self, tokenizer: Tokenizer, before: str) -> None:
        self.tokenizer, self.before = tokenizer, before

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        # a run of letters, or one with a mark behind it, needs no pattern
        if chunk.isalpha():
            ids = self.tokenizer.piece(self.before + chunk)
        elif chunk[-1:] in _MARKS and chunk[:-1].isalpha():
            ids = self.tokenizer.piece(self.before + chunk[:-1]) + self.tokenizer.piece(chunk[-1])
        else:
            ids = self.tokenizer.pieces(self.before + chunk)
        if len(chunk) > 64:
            return ids
        self[chunk] = ids
        return ids


class Tokenizer:
    """Encodes and decodes texts; one per worker and rank file."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        self.vocabulary = Vocabulary(read_ranks(raw))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.first, self.later = _Chunks(self, ""), _Chunks(self, " ")
        #: A lone space between two other characters begins a match of the pattern, so texts can be cut there.
        self.cuts = regex.compile(r"(?<=\S) (?=\S)").split
        self.runs = regex.compile(r"\s\s").search

    def piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            ids = b"".join([self.vocabulary.packed[i] for i in self.vocabulary.whole(piece.encode())])
            if len(piece) <= 64:
                self.known[piece] = ids
        return ids

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        head, *rest = self.cuts(text) if text[0] == " " or text[-1] == " " or self.runs(text) else text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tokenizer(raw: bytes, pattern: str) -> Tokenizer:
    def make() -> Tokenizer:
        made = Tokenizer(raw, pattern)
        gc.freeze()  # the vocabulary stays; no later collection need walk it
        return made

    return held(("bpe", hashlib.sha256(raw).digest(), pattern), make)


def bpe_encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, ids binary): each text's ids, packed little-endian unsigned 32-bit.

    ``rank_file`` is read by the driver and broadcast; a vocabulary has a fixed
    size. Special tokens' strings are ordinary text. A null text is empty and has
    no ids; other columns of ``df`` are ignored; rows keep their number, repeated
    and null ids included.
    """
    with open(rank_file, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(raw.value, pattern)
        for b in batches:
            ids = [t.encode(x) for x in filled(b.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def bpe_decode(df: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id_col, data binary): the bytes of each row's packed ids; null ids give empty bytes."""
    with open(rank_file, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(raw.value, "")
        for b in batches:
            data = [t.decode(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=[id_col, "data"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, data binary")


def bpe_digest(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes the ids, and digests both.

    The same encoding as ``bpe_encode`` in one pass, without moving ids out of the
    workers. Nulls and repeated rows as there.
    """
    with open(rank_file, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(raw.value, pattern)
        for b in batches:
            n, ids_sha, decoded_sha = [], [], []
            for text in b.column(1):
                ids = t.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(t.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
