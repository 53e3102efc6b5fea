"""Personal data, hard negatives and whitening against brute force."""

import hashlib
import random
import re
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from observatory.llm import negatives, pii, queries, whitening

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(v - 9 * (v > 9) for i, c in enumerate(reversed(digits)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in hit.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def test_base_spans_equal_the_rules(spark):
    rnd = random.Random(4)
    parts = ["a@b.c", "x.y+z@mail.example.com", "@", ".", " ", "-", "+", "1.2.3.4", "300.1.2.3.4.5", "0001.2.3.004", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "9" * 18, "+1 (212) 555-0100", "+49 30 1234 5678 ", "+1(", "(", "7", "é", "\U0001d11e", "\n", "_", "%", "word"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(800)] + [None, "", "a@b.c_d@e.f", "a@b.cc@d.e", "1.2.3.4.5.6.7.8", "x@a..b.c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("own"))
    for r in pii.digest(df).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]
        found = [x for x in r.spans.split(",") if x]
        assert set(want) <= set(found) and r.n_added == len(found) - len(want)
        order = [(list(BASE).index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in found)]
        assert order == sorted(order)


def test_spans_that_the_rules_swallow_are_added(spark):
    """A phone and a card that one run of digits joins; numbers without a check digit stay out."""
    rnd = random.Random(1)
    card = lambda: next(x for x in ("4" + "".join(rnd.choice("0123456789") for _ in range(15)) for _ in iter(int, 1)) if luhn(x))
    phone = lambda: f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
    rows, hidden = [], {}
    for i in range(400):
        if i % 20 == 0:
            a, b = phone(), card()
            hidden[i] = {f"phone:5:{5 + len(a)}", f"card:{6 + len(a)}:{22 + len(a)}"}
            rows.append((i, f"call {a} {b} now"))
        else:
            rows.append((i, rnd.choice(["plain words only", f"mail me at joe{i}@mail.example.com please", f"from {rnd.randrange(256)}.2.3.4 today", f"ring {phone()} or", f"paid by {card()} then", f"order {rnd.randrange(10**15, 10**16)} done", "token = 0123456789abcdef0123456789abcdef"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, model = pii.find_personal_data(df)
    assert model.rates["rule"][0] > 0.9 and all(0 < f < 1 for t in model.rates.values() for f in t)
    text = dict(rows)
    for r in pii.digest(df).collect():
        extra = set(r.spans.split(",")) - set(base_spans(text[r.doc_id])) - {""}
        assert extra == hidden.get(r.doc_id, set())


def test_long_runs_and_empty_tables(spark):
    texts = ["1" * 200_000, "a" * 200_000, "a." * 100_000, "1 " * 100_000, "x@y.z " * 30_000, "+1" * 50_000, "@" * 100_000, "a@" + "b." * 60_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    assert got[4].n_email == 30_000 and got[7].n_email == 1
    # the plain rules take the square of a run's length, so what is plain to see is told here
    want = {i: [] for i in (0, 1, 2, 3, 5, 6)} | {4: base_spans(texts[4]), 7: [f"email:0:{len(texts[7]) - 1}"]}
    assert all(r.base_sha256 == hashlib.sha256(",".join(want[i]).encode()).hexdigest() for i, r in got.items())
    assert pii.digest(df.limit(0)).count() == 0
    plain = spark.createDataFrame([(None, "no spans"), (None, "no spans"), (1, None)], "doc_id long, text string")
    assert [tuple(r)[5:] for r in pii.digest(plain).collect()] == [(hashlib.sha256(b"").hexdigest(), "", 0)] * 3


def table(spark, x, labels=None):
    rows = [(i, [float(c) for c in v], None if labels is None else labels[i]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


ODD = [(9001, None, 1), (9002, [float("nan")] * 6, 1), (9003, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (9004, [float("inf")] * 6, 1), (9006, [1.0], 1)]


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "STEP", 70)
    monkeypatch.setattr(negatives, "RUN", 9)
    monkeypatch.setattr(negatives, "PAIRS", 100)
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(700, 6)) * (0.01 if seed == 2 else 1)).astype(np.float32)  # seed 2: many ties
    x[::3] = x[3]
    labels = [int(v) if v < 4 else None for v in rng.integers(0, 5, 700)]
    df = table(spark, x, labels)
    df = df.union(df.where("vec_id < 40")).union(spark.createDataFrame([*ODD, (None, [1.0] * 6, 1)], df.schema)).withColumn("rank", F.lit(1)).withColumn("id", F.lit(1))
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 20 == 0, anchors=11).collect()))
    v, want = np.floor(256 * x.astype(float)).astype(int), []
    for a in range(0, 700, 20):
        if labels[a] is None:
            continue
        score = sorted((-int(v[a] @ v[i]), i) for i in range(700) if labels[i] is not None and i != a)
        for s, p in [(s, p) for s, p in score if labels[p] == labels[a]][:5]:
            near = [(n, t) for t, n in score if labels[n] != labels[a] and 50 * -s <= 100 * -t <= 95 * -s][:3]
            want += [(a, p, i + 1, n, -s, -t) for i, (n, t) in enumerate(near)]
    assert got == sorted(want) and len(got) > 50


def test_negatives_of_little(spark):
    df = table(spark, np.ones((6, 4)), [1, 1, 2, None, None, 2])
    assert negatives.mine(df.limit(0), F.lit(True)).count() == 0 and negatives.mine(df, F.lit(False)).count() == 0
    assert negatives.mine(df.where("label is null"), F.lit(True)).count() == 0
    huge = table(spark, np.full((6, 4), 1e30), [1, 1, 2, 1, 1, 2])
    assert negatives.mine(huge, F.lit(True)).count() == 0


def test_negatives_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    rows = queries.QUERIES["op12_hard_negatives"](spark, sf_dir)
    want = con.sql(queries.ORACLE_SQL["op12_hard_negatives"])
    at = [want.columns.index(c) for c in rows.columns]
    assert sorted(map(tuple, rows.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e6])
def test_whitening_equals_numpy(spark, scale):
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(900, 6)) @ rng.normal(size=(6, 6)) * scale + 40 * scale).astype(np.float32)
    df = table(spark, x)
    df = df.union(df.where("vec_id < 30")).union(spark.createDataFrame(ODD, df.schema)).withColumn("component", F.lit(1)).repartition(5)
    got = whitening.whiten(df).collect()
    full = np.concatenate([x, x[:30]]).astype(float)
    v = np.floor(1024 * full).astype(np.int64) + 100_000
    n, s = len(v), [int(c) for c in v.sum(axis=0)]
    y = v - v.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * 6 and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 7))
    want = y @ vectors / np.sqrt(values)
    sign = {}
    for r in got:
        c, w = r.component - 1, want[r.vec_id, r.component - 1]
        sign.setdefault(c, np.sign(r.whitened * w) if abs(w) > 0.1 else None) or sign.pop(c)
        assert abs(abs(r.whitened) - abs(w)) < 1e-5 and abs(r.explained / (values[c] / values.sum()) - 1) < 1e-6 and 0 <= r.identity_error < 1e-6
        assert r.deviation == Decimal(sum((n * int(a) - t) ** 2 for a, t in zip(v[r.vec_id], s)))
        assert c not in sign or abs(w) < 1e-3 or np.sign(r.whitened * w) == sign[c]


def test_whitening_of_little(spark):
    df = table(spark, np.ones((5, 3)))
    flat = whitening.whiten(df).collect()
    assert len(flat) == 15 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in flat} == {(None, 0.0, 0, None)}
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 9")).count() == 0
    line = whitening.whiten(table(spark, [[i, 2 * i, 0] for i in range(10)])).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and len(line) == 30
