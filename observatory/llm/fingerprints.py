"""Document fingerprints by one-permutation MinHash.

Each shingle hash falls into one bin by its high bits, and a bin keeps its
smallest hash. An empty bin borrows from a full one, found by a sequence of bins
that depends on the empty bin alone (optimal densification). Of each bin only the
low-order bits are stored; two fingerprints' share of equal bins is corrected for
the bits that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from observatory.llm.arrow import PASS_BYTES, passes, utf8
from observatory.llm.shingles import mix, shingles

BINS = 256
BITS = 8


def minima(found: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` values for each text; rows of texts without shingles are 0."""
    texts = len(bounds) - 1
    out = np.zeros((texts, bins), dtype=np.uint64)
    full = np.zeros((texts, bins), dtype=bool)
    bin_of = (found >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    first = np.ones(len(found), dtype=bool)  # a text's hashes ascend, and so do their bins
    first[1:] = (bin_of[1:] != bin_of[:-1]) | (owner[1:] != owner[:-1])
    out[owner[first], bin_of[first]] = found[first]
    full[owner[first], bin_of[first]] = True
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    step = np.uint64(0)
    while len(rows):
        step += np.uint64(1)
        source = (mix(cols.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + step) % np.uint64(bins)).astype(np.int64)
        got = full[rows, source]
        out[rows[got], cols[got]] = out[rows[got], source[got]]
        rows, cols = rows[~got], cols[~got]
    return out


def packed(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low ``bits`` of each value (1, 2, 4 or 8), packed into bytes."""
    low = (mix(values) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    if bits == 8:
        return low
    return np.packbits(np.unpackbits(low[..., None], axis=-1)[..., 8 - bits :].reshape(*low.shape[:-1], -1), axis=-1)


def unpacked(fingerprint: np.ndarray, bits: int = BITS) -> np.ndarray:
    if bits == 8:
        return fingerprint
    parts = np.unpackbits(fingerprint, axis=-1).reshape(*fingerprint.shape[:-1], -1, bits)
    return np.packbits(np.concatenate([np.zeros((*parts.shape[:-1], 8 - bits), np.uint8), parts], axis=-1), axis=-1)[..., 0]


def likeness(a: np.ndarray, a_filled: np.ndarray, b: np.ndarray, b_filled: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity, 0 to 1; two texts without words are alike, one of them alone is unlike all."""
    same = (unpacked(a, bits) == unpacked(b, bits)).mean(axis=-1)
    chance = 0.5**bits
    found = np.clip((same - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_filled & b_filled, found, (a_filled == b_filled).astype(float))


def fingerprints(texts: list[str], bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(packed fingerprints, whether each text has words)."""
    array = pa.array(texts, pa.large_string())
    out, filled = [], []
    for low, high in passes(array):
        found, bounds = shingles(*utf8(array.slice(low, high - low)))
        out.append(packed(minima(found, bounds, bins), bits))
        filled.append(np.diff(bounds) > 0)
    return np.concatenate(out), np.concatenate(filled)


def text_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Rows (id_col, fingerprint hex): of each whole text; '' where a text is null or has no words.

    Equal texts have equal fingerprints. Other columns are ignored, rows keep their number.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                prints, filled = fingerprints([x or "" for x in b.column(1).to_pylist()], bins, bits)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.tobytes().hex() if f else "" for p, f in zip(prints, filled)], pa.string())], names=[id_col, "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


#: Rows sampled for each bucket's bound.
SAMPLED = 20
#: Bytes of a text that tell rows of one id apart in the order of buckets.
PREFIX = 8


def _places(keys: np.ndarray, prefixes: list[bytes]) -> np.ndarray:
    """Order of (id, first bytes of the text) as fixed-size bytes."""
    own = np.zeros((len(keys), 8 + PREFIX), dtype=np.uint8)
    own[:, :8] = (keys.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    own[:, 8:] = np.array(prefixes, dtype=f"S{PREFIX}").view(np.uint8).reshape(-1, PREFIX)
    return own.view(f"S{8 + PREFIX}").ravel()


def in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text, bucket, ahead), dealt out and sorted by bucket, ahead, id, text.

    A bucket holds a range of ids and first bytes of texts, so rows of one id, or of
    none, are in many, and as its ``ahead`` rows a copy of those at the lower bound
    behind it (behind the last bucket: at the smallest), so each row's successor
    stands in its own bucket. Bounds are rows of the table, from a bounded sample of
    their hashes for each partition; they are broadcast, a few bytes each.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = df.select(key.alias("k"), F.substring(F.encode(F.substring(text, 1, PREFIX), "UTF-8"), 1, PREFIX).alias("p"))
    least = first.agg(F.min(F.struct("k", "p")).alias("m")).first()["m"]
    taken = first.orderBy(F.xxhash64("k", "p"), "k", "p").limit(SAMPLED * n).collect()
    some = np.unique(_places(np.array([r["k"] for r in taken], dtype=np.int64), [bytes(r["p"]) for r in taken])) if taken else np.zeros(0, f"S{8 + PREFIX}")
    picked = some[np.linspace(0, len(some), n, endpoint=False).astype(int)] if len(some) else some
    smallest = _places(np.array([least["k"]], dtype=np.int64), [bytes(least["p"])]) if least else some
    bounds = np.unique(np.concatenate([smallest, picked]))
    shared = spark.sparkContext.broadcast(bounds)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for b in batches:
            at = _places(b.column(2).to_numpy(), [x or b"" for x in b.column(3).to_pylist()])
            own = np.searchsorted(bounds, at, side="right") - 1
            again = np.flatnonzero(bounds[own] == at)
            rows = np.concatenate([np.arange(len(at)), again])
            bucket = np.concatenate([own, (own[again] - 1) % len(bounds)]).astype(np.int32)
            ahead = np.repeat(np.array([0, 1], dtype=np.int32), [len(at), len(again)])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), pa.array(bucket), pa.array(ahead)], names=["id", "text", "key", "bucket", "ahead"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("key"), F.substring(F.encode(F.substring(text, 1, PREFIX), "UTF-8"), 1, PREFIX).alias("p"))
    rows = rows.mapInArrow(deal, f"id {kind}, text string, key long, bucket int, ahead int")
    return rows.repartitionById(max(1, len(bounds)), "bucket").sortWithinPartitions("bucket", "ahead", "key", F.coalesce("text", F.lit(""))).drop("key")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last floor(n/2) of its n code points replaced by the
    first as many (all, if fewer) of the next row's text, ascending by id, then
    text; after the last row comes the first. A null text is empty; a null id comes
    first. Repeated rows are rows of their own. An empty table gives no rows.
    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def finish(rows: list) -> pa.RecordBatch:
            own = [r[1] for r in rows]
            following = [r[2] for r in rows]
            edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(own, following)]
            # a row's successor is nearly always the next row here
            extra = [i for i in range(len(rows)) if i + 1 == len(rows) or following[i] is not own[i + 1]]
            prints, filled = fingerprints(own + edited + [following[i] for i in extra], bins, bits)
            n = len(rows)
            after = np.arange(1, n + 1)
            after[extra] = 2 * n + np.arange(len(extra))
            hexed = [p.tobytes().hex() if f else "" for p, f in zip(prints[: 2 * n], filled[: 2 * n])]
            near = [likeness(prints[:n], filled[:n], prints[k], filled[k], bits) for k in (slice(n, 2 * n), after)]
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array([len(x) for x in own], pa.int64()), *(pa.array(x, pa.string()) for x in (sha, hexed[:n], hexed[n:])), *(pa.array(x, pa.float64()) for x in near)], names=names)

        rows, size, last, id_type = [], 0, None, pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            for i, text, bucket, ahead in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                text = text or ""
                if last is not None and last[2] == bucket:
                    rows.append((last[0], last[1], text))
                    size += len(last[1])
                    if size > PASS_BYTES // 2:
                        yield finish(rows)
                        rows, size = [], 0
                    last = None
                if not ahead:
                    last = i, text, bucket
        if rows:
            yield finish(rows)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(df, id_col, text_col).mapInArrow(run, schema)
