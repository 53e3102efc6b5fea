"""Landed pages: chains that end where they say, and pages that are refused."""

import json

import pytest
from pyspark.sql import functions as F

from observatory.sources import landing, pages

URL = "https://api.example.com/repos/o/r/contributors"
SCHEMA = "chain string, page int, url string, status int, link string, body string"


def link(page, url=URL):
    return f'<{url}?page={page}>; rel="next", <{url}?page=9>; rel="last"'


CHAINS = {
    "full": [([1, 2], link(2)), ([3, 4], link(3)), ([5], None)],
    "short": [([1], link(2)), ([2, 3], None)],
    "empty": [([1, 2], link(2)), ([], link(3)), ([9], None)],
    "unnamed": [([1, 2], None), ([3], None)],
    "long": [([1, 2], link(2)), ([3, 4], link(3)), ([5, 6], link(4)), ([7, 8], None)],
}
WANT = {"full": [1, 2, 3, 4, 5], "short": [1], "empty": [1, 2], "unnamed": [1, 2], "long": [1, 2, 3, 4, 5, 6, 7, 8]}


def land(folder, chains):
    for c, of in chains.items():
        (folder / c).mkdir(parents=True)
        for i, (body, following) in enumerate(of, 1):
            (folder / c / f"{i}.json").write_text(json.dumps({"url": URL, "status": 200, "link": following, "body": body}))


def frame(spark, chains):
    rows = [(c, i, URL, 200, following, json.dumps(body)) for c, of in chains.items() for i, (body, following) in enumerate(of, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.chain, r.position)):
        out.setdefault(r.chain, []).append(json.loads(r.item))
    return out


@pytest.mark.parametrize("most", [None, 3, 1, 0])
def test_source_and_frame_follow_alike(spark, tmp_path, most):
    pages.register(spark)
    land(tmp_path, CHAINS)
    reader = spark.read.format(pages.NAME).option("per_page", 2)
    source = (reader if most is None else reader.option("max_items", most)).load(str(tmp_path))
    want = {c: x[:most] for c, x in WANT.items() if most is None or x[:most]}
    assert got(source) == want and got(landing.follow(frame(spark, CHAINS), 2, most)) == want
    assert source.rdd.getNumPartitions() == len(CHAINS)


BAD = {
    "incomplete": {"c": [({"incomplete_results": True, "items": [1]}, None)]},
    "no list": {"c": [({"items": 3}, None)]},
    "another endpoint": {"c": [({"items": [1, 2]}, link(2, "https://api.example.com/users/x")), ({"items": [3]}, None)]},
    "isn't there": {"c": [({"items": [1, 2]}, link(2))]},
}


@pytest.mark.parametrize("problem", sorted(BAD))
def test_pages_are_refused(spark, tmp_path, problem):
    pages.register(spark)
    land(tmp_path, BAD[problem])
    with pytest.raises(Exception, match=problem):
        spark.read.format(pages.NAME).option("per_page", 2).option("items_key", "items").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match=problem):
        landing.follow(frame(spark, BAD[problem]), 2, None, "items").collect()
    # a limit that is reached before asks for nothing more
    if problem in ("another endpoint", "isn't there"):
        assert landing.follow(frame(spark, BAD[problem]), 2, 2, "items").count() == 2


def test_limits_are_checked(spark, tmp_path):
    pages.register(spark)
    for name, value in (("per_page", 0), ("per_page", 101), ("max_items", -1)):
        with pytest.raises(Exception, match="per_page is 1 to 100"):
            spark.read.format(pages.NAME).option(name, value).load(str(tmp_path)).collect()
    assert spark.read.format(pages.NAME).load(str(tmp_path / "none")).count() == 0


def test_stream_takes_each_chain_once(spark, tmp_path):
    pages.register(spark)
    folder = tmp_path / "in"

    def run():
        stream = spark.readStream.format(pages.NAME).option("per_page", 2).load(str(folder))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return got(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out"))

    land(folder, {"a": CHAINS["full"], "b": CHAINS["short"]})
    (folder / "a.done").touch()
    assert run() == {"a": WANT["full"]}
    (folder / "b.done").touch()
    land(folder, {"c": CHAINS["long"]})
    (folder / "c.done").touch()
    assert run() == {"a": WANT["full"], "b": WANT["short"], "c": WANT["long"]} == run()


def test_releases_as_text(spark):
    raw = spark.createDataFrame([(1, '[{"tag_name":"v2","published_at":"2024-01-02T00:00:00Z","body":"a \\r\\nb"},{"name":"old","body":null}]'), (2, "[]"), (3, None)], "repository_id long, body string")
    rows = {r.repository_id: (r.releases, r.text) for r in landing.releases(raw, 5).collect()}
    assert rows == {1: (2, "release v2 (published 2024-01-02T00:00:00Z):\na\nb\n\nrelease old (published unknown date):\n—"), 2: (0, ""), 3: (0, "")}
    assert raw.select(F.lit(1)).count() == 3
