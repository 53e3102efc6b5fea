"""Fingerprints, near-duplicates and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from observatory.llm import fingerprints, lines, minhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def corpus(seed=3, groups=12):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(1, 6)))
    docs = [(None, "a b c d e f"), (None, None), (1, ""), (2, None), (3, "a b"), (4, "A  b"), (5, "a b c d e f"), (5, "q w e r t y u"), (9, "q w e r t y u"), (7, "a b c d e f"), (7, "a b c d e f")]
    n = 20
    for _ in range(groups):
        base = [word() for _ in range(rnd.randrange(30, 120))]
        for _ in range(rnd.randrange(1, 25)):
            own = list(base)
            for _ in range(rnd.randrange(0, 5)):
                own[rnd.randrange(len(own))] = word()
            docs.append((n, " ".join(own)))
            n += 1
    return docs


def test_near_duplicates_equal_brute_force(spark):
    docs = corpus()
    sets = [shingles(t) for _, t in docs]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is not None and docs[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = top(docs[i][0]), top(docs[j][0])
                up[max(a, b)] = min(a, b)
    want = Counter((d, len(x), top(d) if d is not None else None, d is None or top(d) == d) for (d, _), x in zip(docs, sets))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("key", F.lit(2))
    assert Counter(map(tuple, minhash.near_duplicates(df).collect())) == want
    assert Counter(map(tuple, minhash.near_duplicates(df, exhaustive=True).collect())) == want


def test_near_duplicates_whose_pivots_say_nothing(spark):
    """Members of one bucket that are unlike its pivot and alike in twos and threes; sets at the very bound."""
    rnd = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    docs, n = [], 0
    for _ in range(25):
        own = [f"o{rnd.random()}" for _ in range(40)]
        for k in range(rnd.randrange(1, 4)):
            docs.append((n, " ".join([*common, *own[: 40 - k]])))
            n += 1
    docs += [(n, " ".join(f"w{i}" for i in range(84))), (n + 1, " ".join(f"w{i}" for i in range(64))), (n + 2, " ".join(f"w{i}" for i in range(63)))]  # 80, 60, 59 shingles
    sets = {i: shingles(t) for i, t in docs}
    want = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert (n, n + 1) in want and (n, n + 2) not in want
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), exhaustive=True).collect()}
    up = {i: i for i in sets}
    for i, j in sorted(want):
        old, new = max(up[i], up[j]), min(up[i], up[j])
        up = {k: new if v == old else v for k, v in up.items()}
    assert got == up


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_estimate_jaccard(spark):
    docs = sorted(corpus(4), key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    got = defaultdict(list)
    for r in fingerprints.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect():
        got[r.doc_id, r.n_chars, r.edited_sha256].append(r)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    errors = []
    for k, (i, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[i, len(text), hashlib.sha256(edited.encode()).hexdigest()].pop()
        errors += [abs(r.near_edited - jaccard(shingles(text), shingles(edited))), abs(r.near_next - jaccard(shingles(text), shingles(after)))]
    assert not any(got.values()) and max(errors) < 0.2 and sum(errors) / len(errors) < 0.04


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(5)
    base = ["the quick brown fox jumps over it", "pack my box with five dozen jugs", "short", "ab", "exactly nineteen ch", "exactly twenty chars"]
    docs = [(None, None), (None, "short\nx"), (1, ""), (2, "\n\n"), (3, "short\r\nab"), (3, "short\nac\nab"), (3, "short\nac\nab")]
    for i in range(60):
        own = []
        for _ in range(rnd.randrange(1, 4)):
            x = rnd.choice(base)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                k, op = rnd.randrange(len(x) + 1), rnd.randrange(3)
                x = x[:k] + rnd.choice("abé🙂") + x[k + (op == 1) :] if op < 2 else x[:k] + x[k + 1 :]
            own.append(x)
        docs.append((10 + i, "\n".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lines_removed", F.lit(3)).withColumn("mark", F.lit(1))
    marks = {(r.doc_id, r.text): r.m for r in df.select("doc_id", "text", F.xxhash64("text").alias("m")).collect()}
    places = sorted(((i is not None, i or 0), marks[i, t], p, x.strip(), (i, t)) for i, t in set(docs) if t is not None for p, x in enumerate(t.split("\n")) if x.strip())
    first = {}
    for o in places:
        first.setdefault(o[3], o[:3])
    near = {a for a in first for b in first if first[b] < first[a] and max(len(a), len(b)) >= 20 and abs(len(a) - len(b)) < 2 and a != b and edit_distance(a, b) <= 1}
    removed = defaultdict(set)
    for o in places:
        if o[3] in near or o[:3] != first[o[3]]:
            removed[o[4]].add(o[2])
    want = Counter()
    for i, t in docs:
        gone = removed.get((i, t))
        kept = [x for p, x in enumerate((t or "").split("\n")) if p not in (gone or ())]
        want[i, t if gone is None else "\n".join(kept) if any(x.strip() for x in kept) else "", tuple(sorted(gone)) if gone else None] += 1
    got = Counter((r.doc_id, r.text, tuple(r.lines_removed) if r.lines_removed else None) for r in lines.dedup_lines(df).collect())
    assert near and got == want


def test_lines_of_nothing_and_of_blanks(spark):
    df = spark.createDataFrame([(1, "line of some length"), (2, "line of some length\n\t"), (3, "line of some length\r\n \x0b\r"), (4, "line of some length\n\u3000\x1c")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()} == {1: "line of some length", 2: "", 3: "", 4: ""}
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_a_text_of_very_many_lines_takes_linear_time(spark):
    import time

    body = [f"line number {i % 1000} of a log file" if i % 2 else f"{i:x}" * 3 for i in range(200_000)]
    df = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(body[:1000]))], "doc_id long, text string")
    lines.dedup_lines(df.where("doc_id = 2")).collect()
    began = time.time()
    got = {r.doc_id: r for r in lines.dedup_lines(df, edits=0).collect()}
    assert time.time() - began < 10
    seen, kept = set(), []
    for x in body:
        if x not in seen:
            seen.add(x)
            kept.append(x)
    assert got[1].text == "\n".join(kept) and len(got[1].lines_removed) == len(body) - len(kept) and got[2].text == ""
    began = time.time()
    near = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert time.time() - began < 25 and set(got[1].lines_removed) <= set(near[1].lines_removed)


def test_common_lines_are_dealt_to_all_tasks(spark, monkeypatch):
    rnd = random.Random(8)
    docs = [(rnd.randrange(30), "\n".join(rnd.choice(["the same line everywhere", "the same line everywherE", "x", f"line of its own {rnd.random()}"]) for _ in range(12))) for _ in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    run = lambda: Counter((r.doc_id, r.text, tuple(r.lines_removed or ())) for r in lines.dedup_lines(df).collect())
    want = run()
    monkeypatch.setattr(lines, "HEAVY", 3)
    assert run() == want


def test_edited_texts_of_rows_that_share_an_id(spark):
    """Null ids and equal ones lie in many buckets; each row is followed by the next by id, then text."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(5))
    docs = [(None, " ".join(word() for _ in range(12))) for _ in range(400)] + [(7, " ".join(word() for _ in range(12))) for _ in range(200)] + [(i, rnd.choice(["", None, "copy of a text"])) for i in range(60)] + [(None, "twice"), (None, "twice")]
    rnd.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bucket", F.lit(1)).repartition(3)
    order = sorted(((-(2**63) if i is None else i, t or "") for i, t in docs), key=lambda x: (x[0], x[1].encode()))
    want = Counter()
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        half = len(a) // 2
        want[i, len(a), hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()] += 1
    got = fingerprints.edited_fingerprints(df, "doc_id", "text").collect()
    assert Counter((-(2**63) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    dealt = fingerprints.in_order(df, "doc_id", "text").where("ahead = 0").groupBy("bucket").count().collect()
    assert len(dealt) > 1 and max(r["count"] for r in dealt) < 400
    assert fingerprints.edited_fingerprints(df.limit(0), "doc_id", "text").count() == 0
    one = fingerprints.edited_fingerprints(df.where("text = 'twice'").limit(1), "doc_id", "text").first()
    assert one.edited_sha256 == hashlib.sha256(b"twitw").hexdigest()


def test_fingerprints_of_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, " "), (None, "h i j k l m")], "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    got = {r.doc_id: r.fingerprint for r in fingerprints.text_fingerprints(df).collect()}
    assert got[1] == got[2] != got[None] and got[3] == got[4] == "" and len(got[1]) == 2 * fingerprints.BINS
    assert fingerprints.text_fingerprints(df.limit(0)).count() == 0
