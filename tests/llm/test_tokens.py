"""BPE and packing against the tokenizer libraries."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from observatory.llm import bpe, packing  # noqa: E402

SIGNS = "aB éß's \n\t  　漢🙂09 .,!?;:thEİΣςσǅ_-é\x1c\x85"


@pytest.fixture(scope="module")
def byte_bpe():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        t = bpe.Tokenizer(f.read(), P.PATTERN)
    return t, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=t.vocabulary.ranks, special_tokens={})


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_encoding_equals_the_library(byte_bpe):
    t, want = byte_bpe
    for x in [*texts(3000, 1), "<|endoftext|>", "a" * 3000, "ab " * 2000]:
        ids = t.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(x)
        assert t.decode(ids) == x.encode()


def test_appends_and_edits_equal_encoding_anew(byte_bpe):
    v = byte_bpe[0].vocabulary
    rnd = random.Random(2)
    word = lambda n: bytes(rnd.choice(b"thein and on the er") for _ in range(n))
    for _ in range(100):
        p = bpe.Prefixes(v, word(rnd.randrange(300)))
        p.append(word(rnd.randrange(20)))
        at = sorted(rnd.randrange(len(p.data) + 1) for _ in range(2))
        new = word(rnd.randrange(9))
        whole = p.data[: at[0]] + new + p.data[at[1] :]
        p.replace(*at, new)
        assert p.data == whole and p.last == bpe.Prefixes(v, whole).last


def test_digest_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2)], "doc_id long, text string, n_tokens int")
    empty = hashlib.sha256(b"").hexdigest()
    rows = bpe.bpe_digest(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(None, 0, empty, empty), (1, 0, empty, empty), (1, 0, empty, empty)], key=str)
    assert bpe.bpe_digest(df.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_round_trip_through_frames(spark):
    df = spark.createDataFrame(list(enumerate(texts(50, 4))), "doc_id long, text string")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.bpe_decode(bpe.bpe_encode(df, path, P.PATTERN), path)
    assert {r.doc_id: bytes(r.data).decode() for r in back.collect()} == {r.doc_id: r.text for r in df.collect()}


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert t.encode("<|endoftext|> hi", add_special_tokens=False).ids[0] == 49407
    docs = [(None, None), (1, ""), (1, ""), (2, "<|endoftext|> hi"), (3, "<|ENDOFTEXT|> hi \u00e9<|STARTOFTEXT|>, it's"), (4, "a\u0130\u036d\u0323 b\n" * 3), *((10 + i, x) for i, x in enumerate(texts(400, 5))), (999, "word salad, and more. " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = packing.harmonic_pack(df, P.path("word_bpe_49k.json")).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for i, x in docs:
        own[i].append([*t.encode(x or "", add_special_tokens=False).ids, 2])
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(got) == set(own)
    for i, parts in got.items():
        # copies of a document are cut wherever they are; together they have each id as often as there are copies
        ids = own[i][0]
        assert all(x == ids for x in own[i]) and all(n > 0 and total == len(ids) and crc == zlib.crc32(struct.pack(f"<{n}I", *ids[start : start + n])) for start, n, crc, total in parts)
        assert Counter(at for start, n, _, _ in parts for at in range(start, start + n)) == {at: len(own[i]) for at in range(len(ids))}
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 4096
    assert len(rows) < 1.5 * len(docs) + sum(len(x[0]) for x in own.values()) / 4096
    assert sum(n for spans in sequences.values() for _, n in spans) > 0.98 * 4096 * (len(sequences) - 1)
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.harmonic_pack(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("lengths", [[9] * 300, [15] * 300, [1] * 40, [5, 6, 7, 8, 9, 10, 11, 3] * 40, [16] * 10, [40, 33, 17] * 30, [1]])
def test_packing_of_any_lengths(spark, lengths):
    """Classes that leave half of their sequences open, and ones that leave nothing; columns of clashing names."""
    docs = [(i, " ".join(["the"] * (n - 1))) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("sequence_id", F.lit(1)).withColumn("id", F.lit("x")).repartition(3)
    rows = packing.harmonic_pack(df, P.path("word_bpe_49k.json"), capacity=16).collect()
    places = Counter((r.sequence_id, at) for r in rows for at in range(r.offset, r.offset + r.length))
    ids = Counter((r.doc_id, at) for r in rows for at in range(r.start, r.start + r.length))
    assert set(places.values()) == set(ids.values()) == {1} and len(ids) == sum(lengths) and {r.doc_id for r in rows} == set(range(len(lengths)))
    used = Counter(s for s, _ in places)
    assert all((s, n - 1) in places and n <= 16 for s, n in used.items())
    if len(lengths) > 100:
        assert len(used) <= 1.12 * sum(lengths) / 16 + 2


def test_words_are_encoded_once():
    """Many more words than a cache held before come again; none goes to the BPE a second time."""
    with open(P.path("word_bpe_49k.json"), "rb") as f:
        e = packing.Encoder(f.read())
    learned = []

    def learn(words):
        learned.extend(words)
        e.update((w, w.encode()) for w in words)

    e.learn = learn
    docs = [" ".join(f"w{i}" for i in range(low, low + 1000)) for low in range(0, 300_000, 1000)]
    for _ in range(2):
        for low in range(0, len(docs), 50):
            assert e.encode(docs[low : low + 50]) == [d.replace(" ", "").encode() for d in docs[low : low + 50]]
    assert len(learned) == len(set(learned)) == 300_000
