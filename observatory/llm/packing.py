"""Harmonic packing of tokenised documents into fixed-capacity sequences.

Whole sequences are taken off a document that is longer than one. What is left, nearly
always a whole document, is of class k if it fits k times, and no k + 1 times, into a
sequence. Each class fills its sequences with k documents each, so which sequence a
document goes to follows from its number within its class, and numbers come from counts
per partition and class: no worker waits for another's bins. Such a sequence is not
full. A share of the documents, as large as what is left open, is therefore kept out,
and flows into the open rests: laid end to end they are cut where a rest ends. Both
are laid out by prefix sums, and meet in short stretches of that line.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from observatory.llm.arrow import held
from observatory.shared import cut

CAPACITY = 4096
#: Share of the documents, by hash, that may be kept to fill rests; no class leaves open more than half of its sequences.
MOST_FILLERS = 0.6
#: Fillers taken, as a multiple of what has to be filled; those beyond it make sequences of their own.
MARGIN = 1.1
#: Hash values that shares are counted in.
STEPS = 1000
#: Tokens of the line on which fillers and rests meet; a stretch holds few of either.
STRETCH = 8192
#: Entries after which a worker's cache of encoded words begins anew; words of the one before are taken over as they come up.
CACHE_ENTRIES = 360_000

#: The tokenizer's own pieces, for printable ASCII in lower case.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

_MARKS = frozenset(".,;:!?")
_LATIN = re.compile("[\0-\u024f]+").fullmatch

def _plain(text: str) -> str:
    """The text in lower case, with fewer different words and the same ids.

    The tokenizer lowers each character of the composed text. Lowering a whole text
    differs for sigmas, which depend on what stands around them, and a dotted capital I
    becomes two characters, of which the second may change places with others.
    """
    if "\u03a3" not in text and "\u0130" not in text and unicodedata.is_normalized("NFC", text):
        return text.lower()
    return text


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself if it is printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(other)}


_CHARACTERS = _byte_characters()


class Encoder(dict):
    """Ids of a text by a tokenizer that drops white space, so that words can be encoded apart.

    Maps a word, anything between spaces and line feeds, to its packed ids. A word's
    pieces go straight to the tokenizer's BPE where it is plain what they are: in
    printable ASCII and in words of Latin letters. All other words go through the
    whole tokenizer, and so do whole texts that hold one of its added tokens.
    """

    def __init__(self, raw: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.before: dict[str, bytes] = {}

    def piece(self, p: str) -> bytes:
        """Of one piece of the text, in lower case."""
        known = self.get(p)
        if known is None:
            plain = p if p.isascii() else p.encode().decode("latin-1").translate(_CHARACTERS)
            known = self[p] = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
        return known

    def learn(self, words: set[str]) -> None:
        piece, rest = self.piece, []
        for w in words:
            stem = w[:-1] if w[-1:] in _MARKS else w  # most words are letters, or letters and a mark
            if stem.isalpha() and stem.islower() and (stem.isascii() or _LATIN(stem)):
                if stem is w:
                    piece(w)
                else:
                    self[w] = piece(stem) + piece(w[-1])
            elif w.isascii() and w.isprintable() and w == w.lower():
                self[w] = b"".join(map(piece, _PIECE.findall(w)))
            else:
                rest.append(w)
        # a word that holds an added token only now that it is lowered holds plain text
        self.tokenizer.encode_special_tokens = True
        for low in range(0, len(rest), 5_000):
            part = rest[low : low + 5_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self[w] = array("I", e.ids).tobytes()

    def whole(self, text: str) -> bytes:
        self.tokenizer.encode_special_tokens = False
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > CACHE_ENTRIES:
            self.before = self.copy()
            self.clear()
        out: list[bytes | list[bytes | None]] = []
        gaps: list[tuple[list[bytes | None], list[int], list[str]]] = []
        for t in texts:
            if any(a in t for a in self.added):
                out.append(self.whole(t))
                continue
            words = _plain(t).replace("\n", " ").split(" ")
            found = list(map(self.get, words))  # each word is looked up once
            out.append(found)
            if None in found:
                at = [i for i, ids in enumerate(found) if ids is None]
                gaps.append((found, at, [words[i] for i in at]))
        new = set().union(*(words for _, _, words in gaps))
        again = self.before.keys() & new
        self.update((w, self.before[w]) for w in again)
        self.learn(new - again)
        for found, at, words in gaps:
            for i, w in zip(at, words):
                found[i] = self[w]
        return [x if isinstance(x, bytes) else b"".join(x) for x in out]


def encoder(raw: bytes) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return held(("packing", hashlib.sha256(raw).digest()), lambda: Encoder(raw))


def pieces(df: DataFrame, tokenizer_file: str, end_id: int, id_col: str, text_col: str, capacity: int, fillers: int) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, draw, seq, ids, part): whole sequences of a document, then what is left of it.

    ``draw`` is a row's hash modulo STEPS; rests whose draw is below ``fillers``
    carry their ids. ``seq`` counts a partition's rows.
    """
    with open(tokenizer_file, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    final = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seq, here = encoder(raw.value).encode, 0, TaskContext.get().partitionId()
        for b in batches:
            for low in range(0, b.num_rows, 250):
                part = b.slice(low, 250)
                rows = []
                for i, ids in zip(part.column(0).to_pylist(), encode([x or "" for x in part.column(1).to_pylist()])):
                    ids += final
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        own = ids[4 * start : 4 * (start + capacity)]
                        n = len(own) // 4
                        # by place, so that copies of one document are dealt like any others
                        draw = zlib.crc32(f"{here} {seq}".encode()) % STEPS
                        rows.append((i, start, n, zlib.crc32(own), total, draw, seq, own if n < capacity and draw < fillers else None))
                        seq += 1
                columns = list(zip(*rows)) or [()] * 8
                kinds = [part.schema.field(0).type, *[pa.int64()] * 6, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "draw", "seq", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, text_col).mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, draw long, seq long, ids binary")
    return rows.withColumn("part", F.spark_partition_id())


def filler_share(lengths: dict[int, int], capacity: int = CAPACITY) -> float:
    """The share of rests that has to be kept out to fill what the others leave open, from how many rests have each length."""
    tokens = sum(n * c for n, c in lengths.items())
    classes: dict[int, int] = {}
    for n, c in lengths.items():
        classes[capacity // n] = classes.get(capacity // n, 0) + c
    room = sum(capacity * c / k for k, c in classes.items())
    return 1 - tokens / room if room else 0.0


def _ahead(counts: DataFrame, by: str | None, order: str, n: str) -> DataFrame:
    """``counts`` with before: the sum of ``n`` of the rows ahead, a row for each partition or block."""
    w = Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0))).drop(n)


def _line(rows: DataFrame, block: str, order: list[str], length: str) -> DataFrame:
    """``rows`` with at: where each one begins if all are laid end to end, by ``block``, then ``order``."""
    own = Window.partitionBy(block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = _ahead(rows.groupBy(block).agg(F.sum(length).alias("n")), None, block, "n")
    laid = rows.withColumn("at", F.coalesce(F.sum(length).over(own), F.lit(0))).join(F.broadcast(sums), block)
    return laid.withColumn("at", F.col("at") + F.col("before")).drop("before")


#: Sequences that are one row of a sum.
BLOCK = 1 << 14


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length, largest first into the first bin with room."""
    place = [0] * len(lengths)
    room: list[int] = []
    begin: dict[int, int] = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = begin.get(n, 0)  # bins before it had no room for this length
        while at < len(room) and room[at] < n:
            at += 1
        begin[n] = at
        if at == len(room):
            room.append(capacity)
        place[i] = at
        room[at] -= n
    return place


def _placed(rests: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Rests with sequence_id and offset, classes one after the other, and the number of sequences.

    What a class has left over for its last sequence, fewer than k, is put together
    first-fit with the others': at most capacity / length of each class, so a bounded
    number at any input.
    """
    spark = rests.sparkSession
    rests = rests.withColumn("k", F.floor(F.lit(capacity) / F.col("length")).cast("int"))
    per_part = rests.groupBy("k", "part").agg(F.count("*").alias("n"))
    # at most one row for each class
    totals = sorted((r["k"], r["n"]) for r in per_part.groupBy("k").agg(F.sum("n").alias("n")).collect())
    base, classes = 0, []
    for k, n in totals:
        classes.append((k, base, n // k * k))
        base += n // k
    table = spark.createDataFrame(classes, "k int, base long, full long")
    number = F.row_number().over(Window.partitionBy("k", "part").orderBy("seq")) - 1
    rows = rests.withColumn("number", number).join(_ahead(per_part, "k", "part", "n"), ["k", "part"]).join(F.broadcast(table), "k")
    rows = cut(rows.withColumn("number", F.col("number") + F.col("before")), "classes")
    left = sorted(map(tuple, rows.where(F.col("number") >= F.col("full")).select("part", "seq", "length").collect()))
    bins = first_fit([n for _, _, n in left], capacity)
    spots = spark.createDataFrame([(p, q, base + b) for (p, q, _), b in zip(left, bins)], "part int, seq long, spot long")
    rows = rows.join(F.broadcast(spots), ["part", "seq"], "left")
    rows = rows.withColumn("sequence_id", F.coalesce("spot", F.col("base") + F.floor(F.col("number") / F.col("k")).cast("long")))
    slot = Window.partitionBy("sequence_id").orderBy("number", "part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(slot), F.lit(0)))
    return rows.drop("k", "number", "before", "base", "full", "spot"), base + max(bins, default=-1) + 1


def _poured(fillers: DataFrame, open_: DataFrame) -> DataFrame:
    """Pieces of ``fillers`` (their columns, at) in the rests of ``open_`` (sequence_id, offset, room, at), both laid on one line."""
    stretches = lambda n: F.explode(F.sequence(F.floor(F.col("at") / STRETCH), F.floor((F.col("at") + F.col(n) - 1) / STRETCH)))
    left = fillers.withColumn("stretch", stretches("length"))
    right = open_.where("room > 0").select("sequence_id", F.col("offset").alias("begin"), F.col("at"), "room").withColumn("stretch", stretches("room")).withColumnRenamed("at", "spot")
    low, high = F.greatest("at", "spot"), F.least(F.col("at") + F.col("length"), F.col("spot") + F.col("room"))
    met = left.join(right, "stretch").withColumn("low", low).withColumn("n", high - low)
    # a pair that meets in two stretches counts in that in which its piece begins
    met = met.where((F.col("n") > 0) & (F.floor(F.col("low") / STRETCH) == F.col("stretch")))
    return met.select("id", (F.col("start") + F.col("low") - F.col("at")).alias("start"), F.col("n").alias("length"), "doc_tokens", "sequence_id", (F.col("begin") + F.col("low") - F.col("spot")).alias("offset"), (F.col("low") - F.col("at")).alias("from"), "ids")


def _checked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Poured pieces with the checksum of their ids in place of these."""
    for b in batches:
        crc = [zlib.crc32(ids[4 * low : 4 * (low + n)]) for ids, low, n in zip(b.column(7).to_pylist(), b.column(6).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64()), *b.columns[3:6]], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def harmonic_pack(df: DataFrame, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its text's ids, by the tokenizer as its file has it but for special
    tokens around the text, and ``end_id`` behind them; a null or empty text is that id
    alone. Every id is in one piece, and the pieces of a sequence stand gapless from
    offset 0. Documents are cut at the capacity; besides, only those are that fill what
    classes leave open, about as many as there are tokens to fill, by hash. Repeated
    rows and null ids are documents of their own; an empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    rows = cut(pieces(df, tokenizer_file, end_id, id_col, text_col, capacity, int(MOST_FILLERS * STEPS)), "pieces")
    # at most one row for each length
    lengths = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = lengths.pop(capacity, 0)
    share = min(MOST_FILLERS, MARGIN * filler_share(lengths, capacity))
    kept_out = F.col("draw") < int(np.ceil(share * STEPS))
    out = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    solid, sequences = _placed(rows.where((F.col("length") < capacity) & ~kept_out).drop("ids"), capacity)
    solid = cut(solid.select(*out), "solid")
    # whole sequences come after the classes, numbered by partition
    per_part = _ahead(rows.where(F.col("length") == capacity).groupBy("part").agg(F.count("*").alias("n")), None, "part", "n")
    whole = rows.where(F.col("length") == capacity).withColumn("number", F.row_number().over(Window.partitionBy("part").orderBy("seq")) - 1)
    whole = whole.join(F.broadcast(per_part), "part").withColumn("sequence_id", F.col("number") + F.col("before") + sequences).withColumn("offset", F.lit(0).cast("long"))

    open_ = solid.groupBy("sequence_id").agg(F.sum("length").alias("offset")).withColumn("room", capacity - F.col("offset"))
    sums = rows.where((F.col("length") < capacity) & kept_out).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] - (open_.agg(F.coalesce(F.sum("room"), F.lit(0))).first()[0])
    more = max(0, -(-sums // capacity))
    # fillers beyond all rests begin sequences of their own
    extra = spark.range(more).select((F.col("id") + sequences + full).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(capacity).cast("long").alias("room"))
    open_ = open_.unionByName(extra).withColumn("block", F.floor(F.col("sequence_id") / BLOCK))
    fillers = _line(rows.where((F.col("length") < capacity) & kept_out), "part", ["seq"], "length")
    kinds = f"id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    poured = _poured(fillers, _line(open_, "block", ["sequence_id"], "room")).mapInArrow(_checked, kinds)
    done = solid.unionByName(whole.select(*out)).unionByName(poured.select(*out))
    return done.select(F.col("id").cast(kind).alias(id_col), *out[1:5], F.col("sequence_id").cast("long"), F.col("offset").cast("long"))
