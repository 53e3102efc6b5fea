"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes ratios.

The features of a text are the character n-grams of its distinct words, each word
between two boundary marks, A-Z and beyond lower-cased, hashed into a table of
fixed size. Log-count ratios of the classes scale the features, and a logistic
regression is fitted on the scaled ones. A text's logit is a sum over its distinct
words, so each word is hashed once and remembered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from observatory.llm.arrow import filled, held, let_go
from observatory.llm.shingles import mix

#: Table of features.
FEATURES = 1 << 20
LENGTHS = (2, 3, 4, 5, 6)
#: Labelled rows of each class that the model is fitted on, at most: those of the smallest hash of their id.
MAX_ROWS = 2000
#: Words whose n-grams are held at a time.
CHUNK = 5_000
#: Words after which a worker's cache of word weights begins anew; words of the one before are taken over as they come up.
CACHE_ENTRIES = 120_000

_CHAR = np.random.default_rng(31337).integers(1, 2**63, 1 << 16, dtype=np.uint64)
_SLOT = np.random.default_rng(31338).integers(1, 2**63, max(LENGTHS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of the words' n-grams, word after word; the word each belongs to)."""
    joined = "\x02" + "\x03\x02".join(words) + "\x03"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.cumsum(codes == 2) - 1
    values = _CHAR[codes & 0xFFFF] + (codes >> 16).astype(np.uint64)
    found, whose = [], []
    for n in LENGTHS:
        if len(codes) < n:
            break
        total = np.zeros(len(codes) - n + 1, dtype=np.uint64)
        for k in range(n):
            total += values[k : len(codes) - n + 1 + k] * _SLOT[k]
        inside = owner[: len(total)] == owner[n - 1 :]
        found.append((mix(total[inside] + np.uint64(n)) >> np.uint64(44)).astype(np.int64))
        whose.append(owner[: len(total)][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    feature, who = np.concatenate(found), np.concatenate(whose)
    pair = np.unique(who * FEATURES + feature)
    return pair % FEATURES, pair // FEATURES


def distinct_words(text: str) -> list[str]:
    """In no given order; marks that no word may hold are taken as space."""
    return list(set(text.lower().replace("\x02", " ").replace("\x03", " ").split()))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        feature, who = ngrams(words)
        return np.bincount(who, self.weights[feature], minlength=len(words))


def fit(rows: Iterable[tuple[list[str], int]], rounds: int = 100, smoothing: float = 1.0, penalty: float = 1e-3, weight: float = 0.5) -> Model:
    """Rows of (distinct words, label 0 or 1). Without rows of both classes every score is the share of label 1 (0.5 without rows)."""
    index: dict[str, int] = {}
    own, known = [], []
    for words, y in rows:  # a row's words are kept as numbers only
        own.append(np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int32))
        known.append(y)
    labels = np.array(known, dtype=float)
    weights = np.zeros(FEATURES, dtype=np.float32)
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(weights, float(np.log(share / (1 - share))))
    word, row = np.concatenate(own), np.repeat(np.arange(len(own), dtype=np.int32), [len(w) for w in own])
    names = list(index)
    del own, index
    positive, negative = (np.bincount(word, labels[row] == y, minlength=len(names)) for y in (1, 0))
    p, q = np.zeros(FEATURES), np.zeros(FEATURES)
    chunks = [(low, names[low : low + CHUNK]) for low in range(0, len(names), CHUNK)]
    for low, part in chunks:
        feature, who = ngrams(part)
        p += np.bincount(feature, positive[low + who], minlength=FEATURES)
        q += np.bincount(feature, negative[low + who], minlength=FEATURES)
    seen = p + q
    ratio = np.log((p + smoothing) / (p + smoothing).sum()) - np.log((q + smoothing) / (q + smoothing).sum())
    # a ratio from a handful of words is noise
    ratio = np.where((seen >= 3) & (np.abs(ratio) * np.sqrt(seen) > 3), ratio, 0)
    # features in use by their number among these, of each part's words; held as 32-bit numbers and widened a part at a time
    kept = np.flatnonzero(ratio).astype(np.int32)
    number = np.full(FEATURES, -1, dtype=np.int32)
    number[kept] = np.arange(len(kept), dtype=np.int32)
    scale = ratio[kept]
    del p, q, seen, ratio, positive, negative
    found = []
    for low, part in chunks:
        feature, who = ngrams(part)
        feature = number[feature]
        found.append((low, len(part), feature[feature >= 0], who[feature >= 0].astype(np.int32)))
    total = len(names)
    del names, chunks, number
    by_class = np.where(labels == 1, weight / labels.sum(), (1 - weight) / (len(labels) - labels.sum()))

    def logits(w: np.ndarray, b: float) -> np.ndarray:
        value, of_word = w * scale, np.zeros(total)
        for low, n, feature, who in found:
            of_word[low : low + n] = np.bincount(who, value[feature], minlength=n)
        return np.bincount(row, of_word[word], minlength=len(labels)) + b

    def gradient(error: np.ndarray) -> np.ndarray:
        of_word, g = np.bincount(word, error[row], minlength=total), np.zeros(len(kept))
        for low, n, feature, who in found:
            g += np.bincount(feature, of_word[low : low + n][who], minlength=len(kept))
        return g * scale

    # AdaGrad over all rows, both classes with the same weight; a weight below 0 would turn its ratio's sign
    # without any sign a text is no likelier of label 1 than the labels have it, and not predicted
    most = min(-1.0, float(np.log(labels.mean() / (1 - labels.mean()))))
    w, b = np.zeros(len(kept)), most
    past_w, past_b = np.full(len(kept), 1e-8), 1e-8
    for _ in range(rounds):
        error = by_class * (1 / (1 + np.exp(-np.clip(logits(w, b), -30, 30))) - labels)
        g = gradient(error) + penalty
        past_w += g * g
        past_b += error.sum() ** 2
        w = np.maximum(0, w - 0.1 * g / np.sqrt(past_w))
        b = min(most, b - 0.3 * error.sum() / np.sqrt(past_b))
    weights[kept] = w * scale
    return Model(weights, float(b))


def held_out(id_col: str, folds: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, max_rows: int = MAX_ROWS) -> Model:
    """Fits the model on labelled rows whose id is not held out.

    Of each class at most ``max_rows`` rows, those whose id has the smallest hash,
    come to the driver, with the distinct words of their whole texts. Null ids and
    labels other than 0 and 1 are not used; an id labelled twice counts by its
    largest label; rows that repeat an id count each. Null and empty texts have no
    words. Without documents or labels the model scores 0.5. Other columns are ignored.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col, folds))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = None
    for y in (0, 1):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows)
        chosen = part if chosen is None else chosen.union(part)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            out = ["\n".join(sorted(distinct_words(t or ""))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["y", "words"])

    # 2 * max_rows ids at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("y", "text")
    got = texts.mapInArrow(run, "y int, words string").toArrow()
    order = sorted(zip(got.column(1).to_pylist(), got.column(0).to_pylist()), reverse=True)
    del got

    def rows() -> Iterator[tuple[list[str], int]]:
        while order:  # a text goes once it is read
            words, y = order.pop()
            yield words.split("\n") if words else [], y

    return fit(rows())


class _Words(dict):
    def __init__(self, model: Model) -> None:
        self.model = model
        self.before: dict[str, float] = {}

    def take(self, words: set[str]) -> None:
        """Sees to it that all ``words`` are in."""
        if len(self) > CACHE_ENTRIES:
            self.before = self.copy()
            self.clear()
        new = words.difference(self)
        known = new.intersection(self.before)
        self.update((w, self.before[w]) for w in known)
        self.learn(sorted(new - known))

    def learn(self, words: list[str]) -> None:
        for low in range(0, len(words), CHUNK):
            part = words[low : low + CHUNK]
            self.update(zip(part, self.model.word_logits(part).tolist()))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, *keep, score): the probability of label 1 by the whole text.

    A null or empty text has no features and gets the model's bias. Rows keep their
    number. ``keep`` names further columns to carry along.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.tobytes(), model.bias))
    name = hashlib.md5(model.weights.tobytes() + repr(model.bias).encode()).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(("toxicity", name), lambda: _Words(Model(np.frombuffer(shared.value[0], np.float32), shared.value[1])))
        bias = shared.value[1]
        for b in batches:
            for low in range(0, b.num_rows, 200):  # a part at a time: a batch may be large
                part = b.slice(low, 200)
                split = [distinct_words(t) for t in filled(part.column(at)).to_pylist()]
                words.take(set().union(*split))
                logits = np.clip(np.array([sum(map(words.__getitem__, s)) + bias for s in split], dtype=float), -500, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(1 / (1 + np.exp(-logits)))], names=[*columns, "score"])

    columns = [id_col, *keep]
    sent = columns if text_col in columns else [*columns, text_col]
    at = sent.index(text_col)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*(F.col(f"`{c}`") for c in sent)).mapInArrow(run, f"{schema}, score double")
