"""Pages, chat, neighbours, toxicity, sharding."""

import random
import tracemalloc
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from observatory.llm import ann, chat, pages, queries, sharding, toxicity

PAGE = """<html><body class="no-sidebar"><header>Top</header><nav>menu</nav><div class=wrap><main><h1>T&amp;C&nbsp;x</h1><p>One <i>t</i>wo<p>three<ul><li>a<li>b &lt;x&gt;</ul>
<div class="cookie-notice">eat</div><table><tr><td>1<td>2<tr><td>3</table><form>f<p>g</form><script>if(a<b){"</p>"}</script></main><aside>side</aside></div><section id=comments><p>hi</section><footer>F</footer>"""


def test_main_text_and_templates(spark):
    rows = [(i, f"http://Site.org/{i}", f"<body><div class=x><p>Common header text</p></div><div class=y><p>unique {i} text that is longer than the rest of it</p></div></body>") for i in range(30)]
    df = spark.createDataFrame([*rows, (98, "u", PAGE), (99, None, None), (100, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r.text for r in pages.extract_main_text(df).collect()}
    assert got[3] == "unique 3 text that is longer than the rest of it" and got[98] == "T&C x One two three a b <x> 1 2 3" and got[99] == got[100] == ""
    assert got == {r.page_id: r.text for r in pages.extract_main_text(df, broadcast_hashes=0).collect()}
    assert pages.extract_main_text(df.limit(0)).count() == 0


def test_templates_decide_where_names_say_nothing(spark):
    """The counts per host in plain Python; the same boxes on a host that has them on few pages stay."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    boxes = {h: [f"<div><div>{' '.join(word() for _ in range(6))}</div></div>" for _ in range(4)] for h in "uv"}
    rows, want = [], {}
    for i in range(60):
        host = "u" if i < 50 else "v"
        own, extra = " ".join(word() for _ in range(40)), [b for b in boxes["u"] if rnd.random() < (0.5 if host == "u" else 0.3)]
        rows.append((i, f"http://{host}.net/{i}", f"<body><div>{own}</div>{''.join(extra)}</body>", extra, own))
    for i in range(60, 70):  # copies of one page are one
        rows.append((i, f"http://u.net/{i}", "<body><div>" + "same words " * 30 + "</div><div>last same words</div></body>", [], "same words " * 30 + "last same words"))
    count = defaultdict(int)
    for i, url, _, extra, _ in rows:
        for b in extra:
            count[url[7], b] += 1
    for i, url, _, extra, own in rows:
        left = [b for b in extra if count[url[7], b] < max(5, np.log2(51 if url[7] == "u" else 10))]
        want[i] = " ".join([own, *(b.replace("<div>", "").replace("</div>", "") for b in left)])
    assert any(count["u", b] >= 6 for b in boxes["u"]) and any(0 < count["v", b] < 5 for b in boxes["u"])
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.extract_main_text(df).collect()} == want


def test_counts_go_before_names(spark):
    """A menu that recurs is taken out by its count, whatever it is called; one that doesn't by its name."""
    rows = [(i, f"http://h.net/{i}", f"<body><nav><a>home</a><a>about us all</a></nav><article>{'text of its own ' * 9}{i}</article><footer>footer {i}</footer></body>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = pages.removal_shares(df).first()
    assert (got.counted, got.named, got.outside) == (20 * 16, sum(len(f"footer {i}") for i in range(20)), 0) and got.kept > 2000
    assert pages.removal_shares(df.limit(0)).first().kept is None


def test_hostile_pages_take_linear_time():
    import time

    for source in ("<a " * 100_000, "<b>" * 40_000 + "<div>x</div></i>" * 20_000, '<a href="x>hi ' * 40_000, "<p>" + "<b>" * 40_000 + "</p>" * 40_000, "<!-- " * 100_000, "<a " + "b" * 400_000 + ">t", "<table>" + "<tr><td>" * 40_000):
        began = time.time()
        pages._parsed(source).text(frozenset(), b"h")
        assert time.time() - began < 10


def test_tool_calls(spark):
    calls = [(1, 0, "a", "t", '{"y":1.50,"x":"s"}', None), (1, 1, "b", "t", '{"x":1}', ["c"]), (1, 2, "c", "t", '{"x":"1","x":"2"}', ["a"]), (1, 6, "e", "t", '{"y":2}', ["f"]), (1, 7, "f", "t", '{"x":"q"}', ["e"]), (1, 8, "g", "t", '{"x":"q"}', ["f"]), (None, 1, "x", "t", "{}", None)]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends array<string>").withColumn("place", F.lit(1))
    r = spark.createDataFrame([(1, 3, "a", "ra"), (1, 4, "a", "rb"), (2, 0, "a", "o")], "conv_id long, turn long, call_id string, content string")
    h = spark.createDataFrame([("t", "x", "string", True), ("t", "y", "number", False)], "name string, param string, type string, required boolean")
    got = {(x.conv_id, x.call_id): (x.place, x.status, x.errors) for x in chat.link_tool_calls(c, r, h).collect()}
    assert got == {(1, "a"): (0, "ok", []), (1, "c"): (1, "invalid", ["no_object"]), (1, "b"): (2, "invalid", ["type:x"]), (1, "e"): (3, "cycle", ["missing:x"]), (1, "f"): (4, "cycle", []), (1, "g"): (5, "cycle", []), (2, "a"): (None, "orphan", [])}
    assert got == {(x.conv_id, x.call_id): (x.place, x.status, x.errors) for x in chat.link_tool_calls(c.union(c), r.union(r), h, small=0).collect()}
    assert chat.link_tool_calls(c.limit(0), r.limit(0), h).count() == 0


def test_long_chains_and_cycles_of_calls_end(spark):
    """200 calls that each depend on the next one come reversed, 300 on a cycle come last."""
    chain = [(1, i, f"c{i}", "t", "{}", [f"c{i + 1}"]) for i in range(200)]
    ring = [(2, i, f"c{i}", "t", "{}", [f"c{(i + 1) % 300}"]) for i in range(300)] + [(2, 900, "d", "t", "{}", None), (2, 901, "e", "t", "{}", ["c5", "d"])]
    c = spark.createDataFrame(chain + ring, "conv_id long, turn long, call_id string, name string, arguments string, depends array<string>")
    r = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    h = spark.createDataFrame([("t", None, None, None)], "name string, param string, type string, required boolean")
    for small, conv in ((500, (1, 2)), (10, (2,))):
        got = {(x.conv_id, x.call_id): (x.place, x.status) for x in chat.link_tool_calls(c.where(F.col("conv_id").isin(*conv)), r, h, small=small).collect()}
        assert [got[2, f"c{i}"] for i in range(300)] == [(i + 1, "cycle") for i in range(300)] and got[2, "d"] == (0, "no_result") and got[2, "e"] == (301, "cycle")
        assert 1 not in conv or [got[1, f"c{i}"][0] for i in range(200)] == list(range(199, -1, -1))


def test_tool_calls_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    got = sorted(map(tuple, queries.QUERIES["op3_tool_calls"](spark, sf_dir).collect()), key=str)
    assert got == sorted(con.sql(queries.ORACLE_SQL["op3_tool_calls"]).fetchall(), key=str)
    assert {r[3] for r in got} == {"ok", "invalid", "cycle", "no_result", "orphan"}


def test_neighbours_recall(spark):
    x = np.random.default_rng(1).normal(size=(1500, 16)).astype(np.float32)
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, None]), (None, [1.0] * 16)]
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *odd], "vec_id long, embedding array<float>").withColumn("id", F.lit(1))
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=10, probe_rows=100).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    hit = 0
    for q in range(0, 1500, 50):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len({i for _, i in got[q]} & set(np.argsort(-s)[:10].tolist()))
        assert [r for r, _ in sorted(got[q])] == list(range(1, 11))
    assert hit / 300 >= 0.9
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("scale", [1e-38, 1e-30, 1e-20, 1.0, 1e20, 1e30])
def test_neighbours_at_any_scale(spark, scale):
    """All rows for every query, and the recall of scale 1; rows of every scale beside each other in the exact search."""
    x = (np.random.default_rng(3).normal(size=(3000, 16)) * scale).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(dict)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, probe_rows=500).collect():
        got[r.query_id][r["rank"]] = r.vec_id
    hit = 0
    for q in range(0, 3000, 100):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        assert sorted(got[q]) == list(range(1, 21))
        hit += len(set(got[q].values()) & set(np.argsort(-s)[:20].tolist()))
    assert hit / 600 >= 0.9


@pytest.mark.parametrize("kind", ["heavy tails", "few long", "unlike the sample", "tight groups", "one far off"])
def test_neighbours_of_other_rows(spark, kind):
    """Vectors that centroids don't fit: all neighbours are those of brute force."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 16))
    if kind == "heavy tails":
        x = x / np.abs(rng.normal(size=(6000, 1))) ** 2
    elif kind == "few long":
        x[rng.integers(0, 6000, 60)] *= 50
    elif kind == "unlike the sample":
        x[1::2] = x[1::2] * 0.01 + 5 * rng.normal(size=16)
    elif kind == "tight groups":
        x = rng.normal(size=(6, 16))[rng.integers(0, 6, 6000)] + x * 1e-4
    else:
        x[17] *= 1e12
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 100 == 0, sample=400, probe_rows=100).collect()}
    for q in range(0, 6000, 100):
        s = np.einsum("ij,j->i", x.astype(float), x[q].astype(float))
        s[q] = -np.inf
        want = np.lexsort((np.arange(6000), -s))[:20]
        assert [got[q, i + 1][0] for i in range(20)] == want.tolist() and np.allclose([got[q, i + 1][1] for i in range(20)], s[want], rtol=1e-12)


def test_exact_neighbours(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(900, 8)) * 10.0 ** rng.integers(-20, 20, size=(900, 1))).astype(np.float32)
    x[100:400] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest(df, F.col("vec_id") % 30 == 0, k=7, exact=True, queries=10).collect()}
    for q in range(0, 900, 30):
        s = np.array([float(np.einsum("i,i->", x[q].astype(float), v.astype(float))) for v in x])
        s[q] = -np.inf
        order = np.lexsort((np.arange(900), -s))[:7]
        assert [got[q, i + 1] for i in range(7)] == order.tolist()
    few = ann.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2, 3]


def test_neighbours_over_many_lists_and_groups(spark, monkeypatch):
    """Clustered vectors, some repeated and some equal, against brute force; a vector that a third of the rows have."""
    monkeypatch.setattr(ann, "STEP", 500)
    monkeypatch.setattr(ann, "RUN", 16)
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(60, 12))[rng.integers(0, 60, 12000)] * 2 + rng.normal(size=(12000, 12)) * 0.4).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, *rows[:50]], "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("rank", F.lit(2))
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 1, k=10, probe_rows=100, queries=40).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit, full = 0, x.astype(float)
    assert len(got) == 120
    for q in range(1, 12000, 100):
        s = full @ full[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(s)), -np.round(s, 9)))[:10]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(v - s[i]) < 1e-9 for _, i, v in found)
        assert [(-round(v, 9), i) for _, i, v in found] == sorted((-round(v, 9), i) for _, i, v in found)
        hit += len({i for _, i, _ in found} & set(want.tolist()))
    assert hit / 1200 >= 0.9


def test_toxicity_held_out(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice(["ta", "ri", "mo", "le", "su", "ni"]) for _ in range(rnd.randrange(1, 4)))
    docs, labels = [], []
    for i in range(600):
        own, bad = [word() for _ in range(rnd.randrange(5, 400))], i % 4 == 0
        for _ in range(3 * bad):
            own.insert(rnd.randrange(len(own)), "zog" + word())
        docs.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame([*docs, (None, None)], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(d, y)
    rows = {r.doc_id: r.score for r in toxicity.scores(d, model).collect()}
    assert len(rows) == 601 and all(0 <= s <= 1 for s in rows.values())
    out = [(rows[i] >= 0.5) == bool(t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out) / len(out) > 0.95
    assert toxicity.scores(d, toxicity.train(d, y.limit(0))).where("score = 0.5").count() == 601


def test_toxicity_fit_in_little_memory():
    """The n-grams of many words are held once, in 32 bits; what a round makes of them comes and goes part by part."""
    rnd = random.Random(2)
    word = lambda y: "".join(rnd.choice("abcdefgh" if y else "fghijklm") for _ in range(12))
    rows = [([word(i % 2) for _ in range(60)], i % 2) for i in range(2000)]
    tracemalloc.start()
    model = toxicity.fit(iter(rows), rounds=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.word_logits(["abcabc"])[0] > 0 > model.word_logits(["klmklm"])[0]
    assert most < 130e6


def test_sharding_is_level_and_cheapest(spark):
    docs = [(i, "x" * random.Random(i).randrange(200), i % 9 // 4) for i in range(3000)] + [(9000, "y" * 5000, 0), (None, None, 1), (None, None, 1)]
    plan = sharding.reshard(spark.createDataFrame(docs, "doc_id long, text string, old int"), F.col("old"), 3, shards=5).collect()
    by = defaultdict(list)
    for r in plan:
        by[r.shard].append(r)
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert len(plan) == len(docs) and len(by) == 5 and max(sizes) / min(sizes) < 1.02
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    flow = sharding.min_cost_flow([10, 0, 7], [6, 6, 5], [[int(i != j) for j in range(3)] for i in range(3)])
    assert sum(flow[i][j] for i in range(3) for j in range(3) if i != j) == 6
    assert sharding.reshard(spark.createDataFrame([], "doc_id long, text string, old int"), F.col("old"), 3).count() == 0


def test_flow_is_the_cheapest_of_all():
    """Against all ways to send small amounts."""
    from itertools import product

    def ways(n, m):
        return [w for w in product(range(n + 1), repeat=m) if sum(w) == n]

    rnd = random.Random(2)
    for _ in range(40):
        supply, cost = [rnd.randrange(4) for _ in range(3)], [[rnd.randrange(4) for _ in range(3)] for _ in range(3)]
        capacity = [rnd.randrange(1, 5) for _ in range(3)]
        if sum(capacity) < sum(supply):
            continue
        got = sharding.min_cost_flow(supply, capacity, cost)
        best = min(sum(w[i][j] * cost[i][j] for i in range(3) for j in range(3)) for w in product(*(ways(s, 3) for s in supply)) if all(sum(w[i][j] for i in range(3)) <= capacity[j] for j in range(3)))
        assert [sum(r) for r in got] == supply and sum(got[i][j] * cost[i][j] for i in range(3) for j in range(3)) == best


def test_rewrite_writes_touched_shards_with_every_row_once(spark, tmp_path):
    """Repeated ids, equal rows, null ids, clashing names; what moves is the least, but for a row at each end of a transfer."""
    docs = [(i % 90, "t" * (20 + i % 7), i % 2, i) for i in range(300)] + [(None, None, 0, 1)] * 3 + [(7, "x" * 900, 1, 2)] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string, old int, slot int").withColumn("row", F.lit(1))
    plan, touched = sharding.rewrite(df, F.col("old"), 2, str(tmp_path / "out"), shards=3)
    plan = plan.collect()
    assert touched == [0, 1, 2] and sorted(map(tuple, plan), key=str) == sorted(map(tuple, sharding.reshard(df, F.col("old"), 2, shards=3).collect()), key=str)
    files = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, files.select("row.doc_id", "row.text", "row.old", "row.slot").collect()), key=str) == sorted(docs, key=str)
    by = defaultdict(list)
    for r in plan:
        by[r.shard].append(r)
    sizes = {j: sum(r.size for r in v) for j, v in by.items()}
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values()) and max(sizes.values()) - min(sizes.values()) < 200
    total, moved = sum(sizes.values()), sum(r.size for r in plan if r.shard != r.old_shard)
    assert moved - total / 3 < 200  # all that the new shard holds has to come from the others, and no more
    three = spark.createDataFrame([(i, "t", i % 3) for i in range(30)], "doc_id long, text string, old int")
    plan, touched = sharding.rewrite(three, F.col("old"), 3, str(tmp_path / "same"), shards=3)
    assert touched == [] and plan.where("shard <> old_shard").count() == 0 and plan.count() == 30
    with pytest.raises(Exception, match="old shard"):
        sharding.reshard(three, F.col("old"), 2).collect()
