"""The ecosystem graph: developers, repositories and topics, and what their edges say.

``assoc`` is ``developers.associated``; ``topics`` (repository_id, topic);
``links`` are ``developers.link_activity``'s rows; ``repositories`` has id,
owner_id, momentum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from observatory.functions.expr import bounded, damped, jaccard, level, log_share, mean_or_zero
from observatory.operators.components import connected_components
from observatory.operators.developers import MOMENTUM_FULL, SHARE_CAP
from observatory.shared import cut

# Fixed values of the scores.
CONFIDENCE = (0.20, 0.40, 0.25, 0.15)
CO_CONTRIBUTION = (0.40, 0.30, 0.20, 0.10)
STRENGTH = (0.6, 0.4)
BRIDGE = (0.30, 0.25, 0.20, 0.10, 0.10, 0.05)
CROSS = (0.45, 0.30, 0.25)
REPOSITORY_BRIDGE = (0.30, 0.20, 0.25, 0.15, 0.10)
SMALL_CAP, LEAST_LIFETIME = 0.35, 10


def graph_confidence(distinct: Column, history: Column, recent: Column, sample: Column) -> Column:
    """A struct (score, level); HIGH takes three repositories."""
    a, b, c, d = CONFIDENCE
    score = a * bounded(distinct / 5.0) + b * bounded(history) + c * bounded(recent) + d * bounded(sample / 5.0)
    return F.struct(score.alias("score"), F.when((level(score) == "HIGH") & (distinct < 3), "MEDIUM").otherwise(level(score)).alias("level"))


def edges(links: DataFrame, repositories: DataFrame, topics: DataFrame) -> DataFrame:
    """(edge_type, source, target) with nodes named ``D:``, ``R:`` and ``T:``; one row for each natural key."""
    dev, repo = F.concat(F.lit("D:"), F.col("developer_id").cast("string")), F.concat(F.lit("R:"), F.col("repository_id").cast("string"))
    owns = repositories.where("owner_id is not null").select(F.lit("OWNS").alias("edge_type"), F.concat(F.lit("D:"), F.col("owner_id").cast("string")).alias("source"), F.concat(F.lit("R:"), F.col("id").cast("string")).alias("target"))
    contributes = links.select(F.lit("CONTRIBUTES_TO").alias("edge_type"), dev.alias("source"), repo.alias("target"))
    tagged = topics.select(F.lit("TAGGED_WITH").alias("edge_type"), repo.alias("source"), F.concat(F.lit("T:"), "topic").alias("target"))
    return owns.union(contributes).union(tagged).distinct()


def evidence_edges(links: DataFrame, repositories: DataFrame, topics: DataFrame, developers: DataFrame) -> DataFrame:
    """(edge_type, source, target, contributions, share, observations): ``edges`` with what is known of contributions, of developers that are there.

    ``links`` has share and observations; owners and contributors without a row in
    ``developers`` (id) are no nodes and have no edges. Other edges have nulls.
    """
    here = developers.select(F.concat(F.lit("D:"), F.col("id").cast("string")).alias("source"))
    every = edges(links, repositories, topics)
    known = every.where("edge_type = 'TAGGED_WITH'").unionByName(every.where("edge_type <> 'TAGGED_WITH'").join(here, "source", "left_semi").select(*every.columns))
    of = links.select(F.lit("CONTRIBUTES_TO").alias("edge_type"), F.concat(F.lit("D:"), F.col("developer_id").cast("string")).alias("source"), F.concat(F.lit("R:"), F.col("repository_id").cast("string")).alias("target"), "contributions", "share", "observations")
    return known.join(of, ["edge_type", "source", "target"], "left")


def shared_between(assoc: DataFrame, topics: DataFrame, topic_a: str, topic_b: str) -> DataFrame:
    """(repository_id, developers): repositories in both topics, and how many associates they have; each of these bridges the two."""
    both = topics.where(F.col("topic").isin(topic_a, topic_b)).groupBy("repository_id").agg(F.count_distinct("topic").alias("n")).where("n = 2")
    return assoc.join(both.select("repository_id"), "repository_id", "left_semi").groupBy("repository_id").agg(F.count_distinct("developer_id").alias("developers"))


def nodes(developers: DataFrame, repositories: DataFrame, topics: DataFrame) -> DataFrame:
    d = developers.select(F.lit("DEVELOPER").alias("node_type"), F.concat(F.lit("D:"), F.col("id").cast("string")).alias("node"), F.col("login").alias("label"))
    r = repositories.select(F.lit("REPOSITORY").alias("node_type"), F.concat(F.lit("R:"), F.col("id").cast("string")).alias("node"), F.col("full_name").alias("label"))
    t = topics.select(F.lit("TOPIC").alias("node_type"), F.concat(F.lit("T:"), "topic").alias("node"), F.col("topic").alias("label"))
    return d.union(r).union(t).distinct()


def components(all_nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """(node, component, size) for every node and edge end; a node without edges is a component of its own."""
    found = connected_components(all_edges, "source", "target")
    every = all_nodes.select("node").union(all_edges.select("source")).union(all_edges.select("target")).distinct()
    out = every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    sizes = out.groupBy("component").agg(F.count("*").alias("size"))
    return out.join(sizes, "component").select("node", "component", "size")


#: A node whose groups have more members than this together has its neighbours counted in tiles, not by pairs ...
DENSE = 4096
#: ... to which a group of more than this many comes whole, not as pairs.
GROUP = 256
#: Powers of two: a tile is bits of 8,192 nodes by 32,768 others, 32 MB in a task.
ROWS, COLUMNS = 13, 15


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column places (lists) as binary: 16-bit places, or bits where those are shorter."""
    for batch in batches:
        at = batch.schema.names.index("places")
        out = []
        for x in batch.column(at):
            x = np.asarray(x.values, dtype=np.uint16)
            if 2 * len(x) >= 1 << COLUMNS - 3:
                bits = np.zeros(1 << COLUMNS, np.uint8)
                bits[x] = 1
                x = np.packbits(bits, bitorder="little")
            out.append(x.tobytes())
        yield batch.set_column(at, "places", pa.array(out, pa.binary()))


def _places(packed: bytes) -> np.ndarray:
    if len(packed) < 1 << COLUMNS - 3:
        return np.frombuffer(packed, np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little"))


def _bits(packed: bytes) -> np.ndarray:
    if len(packed) < 1 << COLUMNS - 3:
        bits = np.zeros(1 << COLUMNS, np.uint8)
        bits[np.frombuffer(packed, np.uint16)] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
    return np.frombuffer(packed, np.uint64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n) from rectangles (row, col, present, own, places), a tile's one after another, the widest first: how many of a tile's columns each node has.

    A node that has all nodes that are present in a tile's columns needs no more of them.
    """
    acc, touched, open_, tile = np.zeros((1 << ROWS, 1 << COLUMNS - 6), np.uint64), np.zeros(1 << ROWS, bool), np.ones(1 << ROWS, bool), None

    def done() -> pa.RecordBatch:
        at = np.flatnonzero(touched)
        n = np.bitwise_count(acc[at]).sum(axis=1, dtype=np.int64)
        acc[at] = 0
        touched[:], open_[:] = False, True
        return pa.record_batch({"node": pa.array((tile[0] << ROWS) + at, pa.int64()), "n": pa.array(n, pa.int64())})

    for batch in batches:
        for row, col, present, own, places in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (row, col) != tile:
                if tile is not None:
                    yield done()
                tile = (row, col)
            at = _places(own)
            at = at[open_[at]]
            if not len(at):
                continue
            acc[at] |= _bits(places)
            touched[at] = True
            if 16 * len(places) >= present:  # a look is worth it for large parts of what is there
                open_[at] = np.bitwise_count(acc[at]).sum(axis=1, dtype=np.int64) < present
    if tile is not None:
        yield done()


def neighbours(rows: DataFrame, by: str, node: str, dense: int = DENSE, group: int = GROUP) -> DataFrame:
    """(node, neighbours): how many other nodes (whole numbers) each node shares a ``by`` with; 0 where there are none.

    Pairs are made for nodes with few members in all their groups, at most ``dense``
    each. For the others equal small groups are one, whose distinct pairs are made, and
    large groups are rectangles, members by members, of tiles of nodes by nodes. What is
    shuffled of a large group is its members as bits or 16-bit numbers, once for each
    tile; a tile's nodes have its columns as bits in one task, so bytes of memory at a
    time are fixed and only bit operations grow with the square of a group.
    """
    rows = rows.select(F.col(by).alias("__by"), F.col(node).cast("bigint").alias("__node")).where("__by is not null and __node is not null").distinct()
    sized = rows.join(rows.groupBy("__by").agg(F.count("*").alias("__n")), "__by")
    total = sized.groupBy("__node").agg((F.sum("__n") > dense).alias("__dense"))
    sized = cut(sized.join(total, "__node"), "groups")
    other = sized.select("__by", F.col("__node").alias("__other"))
    few = sized.where("not __dense").join(other, "__by").groupBy("__node").agg((F.count_distinct("__other") - 1).alias("neighbours"))
    # small groups: each set of members once, its pairs once
    sets = sized.where(F.col("__n") <= group).groupBy("__by").agg(F.sort_array(F.collect_list("__node")).alias("__set"), F.max("__dense").alias("__any")).where("__any").select("__set").distinct()
    half = sets.select(F.posexplode("__set").alias("__i", "__node"), "__set").select("__node", F.explode(F.slice("__set", F.col("__i") + 1, F.size("__set"))).alias("__other")).distinct()
    pairs = half.union(half.where("__node <> __other").select(F.col("__other").alias("__node"), F.col("__node").alias("__other")))
    pairs = pairs.join(sized.where("__dense").select("__node").distinct(), "__node", "left_semi")
    place = lambda c, power: F.col(c).bitwiseAND((1 << power) - 1).cast("int").alias("place")
    block = lambda c, power: F.shiftright(c, power)
    pack = lambda x, keys, kinds: x.groupBy(*keys).agg(F.collect_list("place").alias("places")).mapInArrow(_packed, f"{kinds}, places binary")
    kind = sized.schema["__by"].dataType.simpleString()
    large = sized.where(F.col("__n") > group)
    own = pack(large.where("__dense").select("__by", block("__node", ROWS).alias("row"), place("__node", ROWS)), ["__by", "row"], f"__by {kind}, row long").withColumnRenamed("places", "own")
    every = pack(large.select("__by", block("__node", COLUMNS).alias("col"), place("__node", COLUMNS)), ["__by", "col"], f"__by {kind}, col long")
    alone = pack(pairs.select("__node", block("__other", COLUMNS).alias("col"), place("__other", COLUMNS)), ["__node", "col"], "__node long, col long")
    one = F.expr(f"unhex(concat(substr(hex(__node & {(1 << ROWS) - 1} | {1 << 16}), 4, 2), substr(hex(__node & {(1 << ROWS) - 1} | {1 << 16}), 2, 2)))")
    rectangles = own.join(every, "__by").select("row", "col", "own", "places").union(alone.select(block("__node", ROWS), "col", one, "places"))
    present = sized.select("__node").distinct().groupBy(block("__node", COLUMNS).alias("col")).agg(F.count("*").alias("present"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = rectangles.join(present, "col").select("row", "col", "present", "own", "places").repartition(parts, "row", "col").sortWithinPartitions("row", "col", F.desc(F.length("places")))
    many = tiles.mapInArrow(_counted, "node long, n long").groupBy("node").agg((F.sum("n") - 1).alias("neighbours"))
    return few.union(many).withColumnRenamed("__node", node)


def developer_reach(developers: DataFrame, assoc: DataFrame, topics: DataFrame) -> DataFrame:
    """Per developer: repositories contributed to and owned, and distinct others, repositories and topics reached; 0 where there are none."""
    own = assoc.groupBy("developer_id").agg(F.count_if("contributed").alias("contributed"), F.count_if("owned").alias("owned"), F.count("*").alias("reached_repositories"))
    near = neighbours(assoc, "repository_id", "developer_id").withColumnRenamed("neighbours", "reached_developers")
    tags = assoc.join(topics, "repository_id").groupBy("developer_id").agg(F.count_distinct("topic").alias("reached_topics"))
    out = developers.select(F.col("id").alias("developer_id")).join(own, "developer_id", "left").join(near, "developer_id", "left").join(tags, "developer_id", "left")
    return out.na.fill(0)


def repository_reach(repositories: DataFrame, links: DataFrame, assoc: DataFrame, topics: DataFrame) -> DataFrame:
    people = links.groupBy("repository_id").agg(F.count_distinct("developer_id").alias("contributors"))
    tags = topics.groupBy("repository_id").agg(F.count_distinct("topic").alias("topics"))
    near = neighbours(assoc, "developer_id", "repository_id").withColumnRenamed("neighbours", "siblings")
    out = repositories.select(F.col("id").alias("repository_id"), F.col("owner_id").isNotNull().cast("int").alias("owner"))
    return out.join(people, "repository_id", "left").join(tags, "repository_id", "left").join(near, "repository_id", "left").na.fill(0)


def topic_reach(topics: DataFrame, assoc: DataFrame) -> DataFrame:
    rows = topics.join(assoc, "repository_id", "left")
    return rows.groupBy("topic").agg(
        F.count_distinct("repository_id").alias("repositories"), F.count_distinct(F.when(F.col("contributed"), F.col("developer_id"))).alias("contributing"),
        F.count_distinct(F.when(F.col("owned"), F.col("developer_id"))).alias("owning"), F.count_distinct("developer_id").alias("associated"),
    )


def _centrality(pairs: DataFrame, every: DataFrame, node: str) -> DataFrame:
    """From (node, other, w) with other <> node: neighbours and weight of each of ``every``."""
    out = pairs.groupBy(node).agg(F.count("*").alias("degree"), F.sum("w").alias("weight"))
    return every.join(out, node, "left").na.fill(0)


def _pairs(rows: DataFrame, by: str, node: str) -> DataFrame:
    """(node, other, w): distinct ``by`` that two nodes share. Pairs are made once, a < b, and mirrored when counted."""
    rows = rows.select(by, node).distinct()
    half = rows.join(rows.select(by, F.col(node).alias("other")), by).where(F.col(node) < F.col("other")).groupBy(node, "other").agg(F.count("*").alias("w"))
    return half.union(half.select(F.col("other").alias(node), F.col(node).alias("other"), "w"))


def _central(rows: DataFrame, by: str, node: str) -> DataFrame:
    """(node, degree, weight) without pairs: neighbours, and the other members of all groups, each group counting."""
    sizes = rows.groupBy(by).agg((F.count("*") - 1).alias("others"))
    weight = rows.join(sizes, by).groupBy(node).agg(F.sum("others").alias("weight"))
    return neighbours(rows, by, node).withColumnRenamed("neighbours", "degree").join(weight, node)


def developer_centrality(developers: DataFrame, assoc: DataFrame) -> DataFrame:
    rows = assoc.select("repository_id", "developer_id").distinct()
    return developers.select(F.col("id").alias("developer_id")).join(_central(rows, "repository_id", "developer_id"), "developer_id", "left").na.fill(0)


def repository_centrality(repositories: DataFrame, assoc: DataFrame) -> DataFrame:
    """An owner that two repositories have in common counts once more, besides being an associate."""
    rows = assoc.select("repository_id", "developer_id").distinct()
    out = repositories.select(F.col("id").alias("repository_id"), "owner_id").join(_central(rows, "developer_id", "repository_id"), "repository_id", "left")
    owned = repositories.where("owner_id is not null").groupBy("owner_id").agg((F.count("*") - 1).alias("owned"))
    weight = F.coalesce("weight", F.lit(0)) + F.coalesce("owned", F.lit(0))
    return out.join(owned, "owner_id", "left").select("repository_id", F.coalesce("degree", F.lit(0)).alias("degree"), weight.alias("weight"))


def topic_centrality(topics: DataFrame) -> DataFrame:
    return _centrality(_pairs(topics, "repository_id", "topic"), topics.select("topic").distinct(), "topic")


#: A repository of more contributors than this has its pairs summed in tiles of 1,024 by 1,024 developers, so many repositories at a time.
PAIRED, SIDE, AT_ONCE = 64, 10, 128
_SUMS = ["shared_repositories", "share_sum", "momentum_sum", "momentum_n", "recent_sum", "recent_n", "seen_n", "both_n"]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, *_SUMS) from (row, col, momentum, a_place, a_share, a_flags, b_place, b_share, b_flags), a tile's repositories one after another.

    Flags are 1 for a delta, 2 for one above zero, 4 for observations. Counts and sums
    of products are products of matrices; the smaller share is taken one by one.
    """
    size = 1 << SIDE
    share, smaller = np.zeros((size, size)), np.zeros((size, size))
    sums = {n: np.zeros((size, size)) for n in _SUMS if n != "share_sum"} | {"share_sum": share}
    held, tile = [], None

    def flush() -> None:
        one, has, up, seen = (np.zeros((2, size, len(held)), np.float32) for _ in range(4))
        weights = np.array([m for m, *_ in held], dtype=np.float64)
        for i, (_, *sides) in enumerate(held):
            full = []
            for s, (place, part, flags) in enumerate(sides):
                one[s, place, i] = 1
                for x, bit in ((has, 1), (up, 2), (seen, 4)):
                    x[s, place, i] = (flags & bit) > 0
                full.append(np.zeros(size))
                full[s][place] = part
            (p, q, _), (r, t, _) = sides
            if 8 * len(p) * len(r) < size * size:
                share[np.ix_(p, r)] += np.minimum.outer(q, t)
            else:
                np.minimum(full[0][:, None], full[1][None, :], out=smaller)
                np.add(share, smaller, out=share)
        known = ~np.isnan(weights)
        sums["shared_repositories"] += one[0] @ one[1].T
        sums["momentum_n"] += (one[0] * known.astype(np.float32)) @ one[1].T
        sums["momentum_sum"] += (one[0] * np.where(known, weights, 0.0)) @ one[1].T.astype(np.float64)
        sums["recent_sum"] += 0.25 * (up[0] @ (one[1] + has[1]).T + (one[0] + has[0]) @ up[1].T)
        sums["recent_n"] += one[0] @ has[1].T + has[0] @ (one[1] - has[1]).T
        sums["seen_n"] += seen[0] @ seen[1].T
        sums["both_n"] += has[0] @ has[1].T
        held.clear()

    def done() -> Iterator[pa.RecordBatch]:
        flush()
        a, b = np.nonzero(np.triu(sums["shared_repositories"], 1) if tile[0] == tile[1] else sums["shared_repositories"])
        for i in range(0, len(a), 100_000):
            at = a[i : i + 100_000], b[i : i + 100_000]
            out = {"a": (tile[0] << SIDE) + at[0], "b": (tile[1] << SIDE) + at[1]} | {n: sums[n][at] for n in _SUMS}
            yield pa.record_batch({n: pa.array(x if x.dtype.kind == "f" else x.astype(np.int64)) for n, x in out.items()})
        for x in sums.values():
            x[:] = 0

    for batch in batches:
        row, col, momentum = (batch.column(i).to_pylist() for i in range(3))
        lists = [batch.column(i) for i in range(3, 9)]
        for i in range(batch.num_rows):
            if (row[i], col[i]) != tile:
                if tile is not None:
                    yield from done()
                tile = (row[i], col[i])
            # copies, as the batch goes before these do
            x = [np.array(c[i].values) for c in lists]
            held.append((np.nan if momentum[i] is None else momentum[i], tuple(x[:3]), tuple(x[3:])))
            if len(held) == AT_ONCE:
                flush()
    if tile is not None:
        yield from done()


def _pair_sums(rows: DataFrame, paired: int) -> DataFrame:
    """(a, b, *_SUMS) of contributors ``rows`` (repository_id, developer_id, momentum, share, flags)."""
    sized = rows.join(rows.groupBy("repository_id").agg(F.count("*").alias("__n")), "repository_id")
    side = lambda x, y: x.select("repository_id", *(F.col(c).alias(f"{y}_{c}") for c in x.columns if c not in ("repository_id", "momentum", "__n")))
    large = sized.where(F.col("__n") > paired).withColumn("block", F.shiftright("developer_id", SIDE)).withColumn("place", F.col("developer_id").bitwiseAND((1 << SIDE) - 1).cast("int"))
    lists = large.groupBy("repository_id", "momentum", "block").agg(F.collect_list(F.struct("place", "share", "flags")).alias("x")).select("repository_id", "momentum", "block", "x.place", "x.share", "x.flags")
    tiles = side(lists, "a").join(side(lists, "b"), "repository_id").where("a_block <= b_block").join(lists.select("repository_id", "momentum").distinct(), "repository_id")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles.select(F.col("a_block").alias("row"), F.col("b_block").alias("col"), "momentum", "a_place", "a_share", "a_flags", "b_place", "b_share", "b_flags").repartition(parts, "row", "col").sortWithinPartitions("row", "col")
    summed = tiles.mapInArrow(_shared, "a long, b long, " + ", ".join(f"{n} double" for n in _SUMS))
    small = sized.where(F.col("__n") <= paired)
    if small.isEmpty():
        return summed  # a pair has all its repositories in one tile
    pairs = side(small, "a").join(side(small, "b"), "repository_id").where("a_developer_id < b_developer_id").join(small.select("repository_id", "momentum").distinct(), "repository_id")
    bit = lambda x, n: (F.col(f"{x}_flags").bitwiseAND(n) > 0).cast("int")
    positive, has = bit("a", 2) + bit("b", 2), bit("a", 1) + bit("b", 1)
    each = pairs.select(
        F.col("a_developer_id").alias("a"), F.col("b_developer_id").alias("b"), F.lit(1.0).alias("shared_repositories"), F.least("a_share", "b_share").alias("share_sum"), F.coalesce("momentum", F.lit(0.0)).alias("momentum_sum"), F.col("momentum").isNotNull().cast("double").alias("momentum_n"),
        (positive * has * 0.25).alias("recent_sum"), (has > 0).cast("double").alias("recent_n"), (bit("a", 4) * bit("b", 4)).cast("double").alias("seen_n"), (has == 2).cast("double").alias("both_n"),
    )
    add = lambda x: x.groupBy("a", "b").agg(*(F.sum(n).alias(n) for n in _SUMS))
    return add(each.union(summed))


def co_contributors(links: DataFrame, repositories: DataFrame, paired: int = PAIRED) -> DataFrame:
    """One row per unordered pair (a < b) of developers (whole numbers) with a repository both contribute to; ownership doesn't count.

    ``links`` has one row for each repository and developer. Pairs of small repositories
    are joined; large ones, by which most pairs have many repositories in common, come
    as lists of contributors to tiles of developers by developers, where they are
    summed without a row for each pair and repository.
    """
    part = F.coalesce(bounded(F.least("share", F.lit(SHARE_CAP)) / SHARE_CAP), F.lit(1.0))
    flags = F.when(F.col("delta").isNotNull(), 1).otherwise(0) + F.when(F.col("delta") > 0, 2).otherwise(0) + F.when(F.col("observations") > 0, 4).otherwise(0)
    rows = links.select("repository_id", F.col("developer_id").cast("bigint").alias("developer_id"), part.alias("share"), flags.alias("flags")).where("developer_id is not null")
    rows = rows.join(repositories.select(F.col("id").alias("repository_id"), F.col("momentum").cast("double").alias("momentum")), "repository_id")
    n = F.col("shared_repositories")
    out = _pair_sums(rows, paired).select(
        "a", "b", n.cast("long").alias("shared_repositories"), (F.col("share_sum") / n).alias("share_term"), F.try_divide("momentum_sum", "momentum_n").alias("mean_momentum"),
        F.try_divide("recent_sum", "recent_n").alias("recent"), (F.col("seen_n") / n).alias("history"), (F.col("both_n") / n).alias("recent_share"),
    )
    w, x, y, z = CO_CONTRIBUTION
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    strength = w * log_share(F.col("shared_repositories"), 5) + x * F.col("share_term") + y * zero(bounded(F.col("mean_momentum") / MOMENTUM_FULL)) + z * zero(bounded(F.col("recent")))
    missing = F.array_compact(F.array(F.when(F.col("mean_momentum").isNull(), "momentum"), F.when(F.col("recent").isNull(), "recent_activity")))
    return out.withColumn("strength", bounded(strength)).withColumn("missing", missing).withColumn("confidence", graph_confidence(F.col("shared_repositories"), F.col("history"), F.col("recent_share"), F.lit(0)))


def _overlaps(rows: DataFrame, by: str, node: str, name: str) -> DataFrame:
    rows = rows.select(by, node).distinct()
    both = rows.select(by, F.col(node).alias("a")).join(rows.select(by, F.col(node).alias("b")), by).where("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias(name))


def _overlap(x: DataFrame, y: DataFrame, sizes: dict[str, DataFrame], node: str) -> DataFrame:
    out = x.join(y, ["a", "b"], "full").na.fill(0)
    for name, per in sizes.items():
        out = out.join(per.toDF("a", f"a_{name}"), "a", "left").join(per.toDF("b", f"b_{name}"), "b", "left")
    return out.na.fill(0)


def related_repositories(assoc: DataFrame, topics: DataFrame) -> DataFrame:
    """Per unordered pair with a developer or topic in common: mean of both Jaccard overlaps."""
    sizes = {"developers": assoc.groupBy("repository_id").agg(F.count_distinct("developer_id")), "topics": topics.groupBy("repository_id").agg(F.count_distinct("topic"))}
    out = _overlap(_overlaps(assoc, "developer_id", "repository_id", "developers"), _overlaps(topics, "topic", "repository_id", "topics"), sizes, "repository_id")
    score = 0.5 * jaccard(F.col("developers"), F.col("a_developers"), F.col("b_developers")) + 0.5 * jaccard(F.col("topics"), F.col("a_topics"), F.col("b_topics"))
    return out.withColumn("score", score)


def topics_related_to(assoc: DataFrame, topics: DataFrame, topic: str) -> DataFrame:
    """(topic, developers, repositories): what other topics share with one; only its own rows are paired."""
    people = assoc.join(topics, "repository_id").select("developer_id", "topic").distinct()

    def shared(rows: DataFrame, by: str, name: str) -> DataFrame:
        own = rows.where(F.col("topic") == topic).select(by).distinct()
        return rows.where(F.col("topic") != topic).join(own, by, "left_semi").groupBy("topic").agg(F.count_distinct(by).alias(name))

    return shared(people, "developer_id", "developers").join(shared(topics, "repository_id", "repositories"), "topic", "full").na.fill(0)


def related_topics(assoc: DataFrame, topics: DataFrame) -> DataFrame:
    people = assoc.join(topics, "repository_id").select("developer_id", "topic").distinct()
    sizes = {"developers": people.groupBy("topic").count(), "repositories": topics.groupBy("topic").agg(F.count_distinct("repository_id"))}
    out = _overlap(_overlaps(people, "developer_id", "topic", "developers"), _overlaps(topics, "repository_id", "topic", "repositories"), sizes, "topic")
    return out.withColumn("developer_overlap", jaccard(F.col("developers"), F.col("a_developers"), F.col("b_developers"))).withColumn("repository_overlap", jaccard(F.col("repositories"), F.col("a_repositories"), F.col("b_repositories")))


def topic_evidence(assoc: DataFrame, links: DataFrame, topics: DataFrame) -> DataFrame:
    """Per developer and topic of an associated repository: how strongly they stand in it."""
    rows = assoc.join(topics.select("repository_id", "topic").distinct(), "repository_id").join(links.select("repository_id", "developer_id", "contributions", "share", "delta", "observations"), ["repository_id", "developer_id"], "left")
    is_link = F.col("contributions").isNotNull()
    out = rows.groupBy("developer_id", "topic").agg(
        F.count("*").alias("repositories"), F.coalesce(F.sum("contributions"), F.lit(0)).alias("contributions"), mean_or_zero(F.when(is_link, F.least("share", F.lit(SHARE_CAP)))).alias("mean_share"),
        F.when(F.count("delta") > 0, F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("delta"))), F.lit(0))).alias("recent"), F.coalesce(F.try_divide(F.count_if(F.col("observations") > 0), F.count_if(is_link)), F.lit(0.0)).alias("history"),
    )
    return out.withColumn("strength", bounded(STRENGTH[0] * bounded(F.col("repositories") / 2.0) + STRENGTH[1] * bounded(F.col("mean_share") / SHARE_CAP)))


def developer_bridges(assoc: DataFrame, links: DataFrame, topics: DataFrame, repositories: DataFrame) -> DataFrame:
    """Per developer with a tagged repository: how well they join topics.

    Contributions and recent deltas are summed over memberships, so a repository
    with k topics counts k times.
    """
    evidence = topic_evidence(assoc, links, topics)
    w = Window.partitionBy("developer_id")
    p = F.col("repositories") / F.sum("repositories").over(w)
    m = evidence.withColumn("p", p).groupBy("developer_id").agg(
        F.count("*").alias("memberships"), F.avg("strength").alias("strength"), F.sum("contributions").alias("contributions"), F.sum("recent").alias("recent"), F.sum(-F.col("p") * F.log("p")).alias("entropy"),
    )
    tagged = assoc.join(topics.select("repository_id").distinct(), "repository_id").join(links.select("repository_id", "developer_id", "delta", "observations"), ["repository_id", "developer_id"], "left")
    r = tagged.join(repositories.select(F.col("id").alias("repository_id"), "momentum"), "repository_id").groupBy("developer_id").agg(
        F.count("*").alias("repositories"), F.avg("momentum").alias("mean_momentum"), (F.count_if(F.col("observations") > 0) / F.count("*")).alias("history"), (F.count("delta") / F.count("*")).alias("recent_share"),
    )
    out = m.join(r, "developer_id")
    evenness = F.when(F.col("memberships") < 2, 0.0).otherwise(bounded(F.col("entropy") / F.log(F.col("memberships").cast("double"))))
    a, b, c, d, e, f = BRIDGE
    raw = a * bounded(F.col("memberships") / 4.0) + b * F.col("strength") + c * bounded((F.col("repositories") - 1) / 2.0) + d * F.coalesce(evenness, F.lit(0.0)) + e * damped(F.coalesce("recent", F.lit(0))) + f * F.coalesce(bounded(F.col("mean_momentum") / MOMENTUM_FULL), F.lit(0.0))
    small = (F.col("repositories") < 2) | (F.col("contributions") < LEAST_LIFETIME)
    score = F.when(F.col("memberships") < 2, 0.0).otherwise(bounded(raw))
    out = out.withColumn("small_sample", small).withColumn("bridge", F.when(small, F.least(score, F.lit(SMALL_CAP))).otherwise(score))
    return out.withColumn("confidence", graph_confidence(F.col("repositories"), F.col("history"), F.col("recent_share"), F.col("memberships")))


def cross_topic_bridges(assoc: DataFrame, links: DataFrame, topics: DataFrame, topic_a: str, topic_b: str) -> DataFrame:
    """Developers in both topics."""
    evidence = topic_evidence(assoc, links, topics.where(F.col("topic").isin(topic_a, topic_b)))
    side = lambda t, x: evidence.where(F.col("topic") == t).select("developer_id", *(F.col(c).alias(f"{x}_{c}") for c in ("repositories", "contributions", "recent", "history", "strength")))
    both = assoc.join(topics.where(F.col("topic").isin(topic_a, topic_b)), "repository_id").groupBy("developer_id").agg(F.count_distinct("repository_id").alias("distinct_repositories"))
    out = side(topic_a, "a").join(side(topic_b, "b"), "developer_id").join(both, "developer_id")
    recent = F.coalesce(F.col("a_recent"), F.lit(0)) + F.coalesce(F.col("b_recent"), F.lit(0))
    a, b, c = CROSS
    raw = bounded(a * (F.col("a_strength") + F.col("b_strength")) / 2 + b * bounded(F.least("a_repositories", "b_repositories") / 2.0) + c * damped(recent))
    total = F.col("a_contributions") + F.col("b_contributions")
    sides = (F.col("a_recent").isNotNull().cast("int") + F.col("b_recent").isNotNull().cast("int")) / 2
    out = out.withColumn("contributions", total).withColumn("bridge", F.when(total < LEAST_LIFETIME, F.least(raw, F.lit(SMALL_CAP))).otherwise(raw))
    return out.withColumn("confidence", graph_confidence(F.col("distinct_repositories"), (F.col("a_history") + F.col("b_history")) / 2, sides, F.lit(2)))


def repository_bridges(assoc: DataFrame, links: DataFrame, topics: DataFrame, repositories: DataFrame) -> DataFrame:
    """Per repository: how far its people reach into others; an owner is one of them."""
    breadth = assoc.groupBy("developer_id").agg((F.count("*") > 1).alias("wide"))
    tags = assoc.join(topics, "repository_id").groupBy("developer_id").agg((F.count_distinct("topic") >= 2).alias("many"))
    people = assoc.join(breadth, "developer_id").join(tags, "developer_id", "left").join(links.select("repository_id", "developer_id", "delta", "observations"), ["repository_id", "developer_id"], "left")
    p = people.groupBy("repository_id").agg(
        F.count("*").alias("contributors"), F.count_if("wide").alias("cross_repository"), F.count_if(F.coalesce("many", F.lit(False))).alias("cross_topic"), F.count_if(F.col("observations") > 0).alias("observed"), F.count("delta").alias("recent"),
    )
    others = neighbours(assoc, "developer_id", "repository_id").withColumnRenamed("neighbours", "connected")
    n = topics.groupBy("repository_id").agg(F.count_distinct("topic").alias("topics"))
    out = repositories.select(F.col("id").alias("repository_id"), "momentum").join(p, "repository_id", "left").join(n, "repository_id", "left").join(others, "repository_id", "left").na.fill(0, ["contributors", "cross_repository", "cross_topic", "observed", "recent", "topics", "connected"])
    share = lambda c: F.coalesce(F.try_divide(c, "contributors"), F.lit(0.0))
    a, b, c, d, e = REPOSITORY_BRIDGE
    raw = bounded(a * log_share(F.col("contributors"), 20) + b * log_share(F.col("topics"), 10) + c * share("cross_repository") + d * share("cross_topic") + e * F.coalesce(bounded(F.col("momentum") / MOMENTUM_FULL), F.lit(0.0)))
    out = out.withColumn("bridge", F.when(F.col("contributors") < 2, F.least(raw, F.lit(SMALL_CAP))).otherwise(raw))
    return out.withColumn("confidence", graph_confidence(F.greatest("connected", F.lit(1)), share("observed"), share("recent"), F.col("topics")))


def subgraph(all_edges: DataFrame, developers: DataFrame | None = None, repositories: DataFrame | None = None, topics: DataFrame | None = None) -> DataFrame:
    """The edges whose ends are in the given sets of nodes (column node); none for all of a kind."""
    out = all_edges
    for prefix, wanted in (("D:", developers), ("R:", repositories), ("T:", topics)):
        if wanted is not None:
            for end in ("source", "target"):
                keep = wanted.select(F.col("node").alias(end), F.lit(True).alias("__in")).distinct()
                out = out.join(keep, end, "left").where(~F.startswith(end, F.lit(prefix)) | F.col("__in")).drop("__in").select(*all_edges.columns)
    return out


def kept_repositories(repositories: DataFrame, topics: DataFrame, any_topics: list[str] | None = None, names: list[str] | None = None, min_momentum: float | None = None) -> DataFrame:
    """(node) of the repositories in any of the topics, of the full names, and of so much momentum; a missing momentum is too little."""
    rows = repositories
    if any_topics is not None:
        rows = rows.join(topics.where(F.col("topic").isin(any_topics)).select(F.col("repository_id").alias("id")), "id", "left_semi")
    if names is not None:
        rows = rows.where(F.col("full_name").isin(names))
    if min_momentum is not None:
        rows = rows.where(F.col("momentum") >= min_momentum)
    return rows.select(F.concat(F.lit("R:"), F.col("id").cast("string")).alias("node"))


def owner_edges(writes: DataFrame, seq: str) -> DataFrame:
    """(source, target) of OWNS after all ``writes`` (repository_id, owner_id): a repository written again has its last owner, or none."""
    last = writes.groupBy("repository_id").agg(F.max_by(F.struct("owner_id"), seq).alias("w")).select("repository_id", "w.owner_id").where("owner_id is not null")
    return last.select(F.concat(F.lit("D:"), F.col("owner_id").cast("string")).alias("source"), F.concat(F.lit("R:"), F.col("repository_id").cast("string")).alias("target"))


def memberships(assoc: DataFrame, topics: DataFrame) -> DataFrame:
    """(developer_id, topics): the sorted topics of a developer's repositories."""
    return assoc.join(topics, "repository_id").groupBy("developer_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))


def projection(ranked: DataFrame, most: int = 18) -> DataFrame:
    """``ranked`` (node_type, node, label, weight, degree) with place: the ``most`` weightiest of each type, then by degree and label."""
    order = Window.partitionBy("node_type").orderBy(F.desc("weight"), F.desc("degree"), "label")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def focused(ranked: DataFrame, edges: DataFrame, focus: str, most: int = 18, near: int = 30) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that a view of one node shows: itself, its first ``near`` neighbours, then the weightiest of each type up to ``most``.

    ``ranked`` is (node_type, node, label, weight, degree), ``edges`` (edge_type,
    source, target); a neighbour's place is its edge's, by type, source and target. At
    most 3 * ``most`` nodes show in all, developers first, then repositories, topics;
    neighbours count towards their type's number. Of the edges those with both ends
    shown are kept. A node that isn't there leaves the weightiest alone. The
    neighbours are found among the node's own edges, and no set here is larger than
    what is shown.
    """
    own = edges.where(((F.col("source") == focus) | (F.col("target") == focus)) & (F.col("source") != F.col("target")))
    other = own.select(F.when(F.col("source") == focus, F.col("target")).otherwise(F.col("source")).alias("node"), "edge_type", "source", "target")
    there = other.join(ranked.select("node"), "node", "left_semi").join(ranked.where(F.col("node") == focus).select(F.lit(True).alias("__here")), how="left_semi")
    first = there.groupBy("node").agg(F.min(F.struct("edge_type", "source", "target")).alias("at")).orderBy("at").limit(near).select("node")
    wanted = first.union(ranked.where(F.col("node") == focus).select("node"))
    rank = [F.desc("weight"), F.desc("degree"), F.asc("label"), F.asc("node")]
    kinds = F.array_position(F.array(F.lit("DEVELOPER"), F.lit("REPOSITORY"), F.lit("TOPIC")), F.col("node_type"))
    chosen = ranked.join(F.broadcast(wanted), "node", "left_semi").withColumn("near", F.lit(True)).orderBy(kinds, *rank).limit(3 * most)
    # the weightiest of each type, of which each task keeps no more than that
    top = ranked.withColumn("place", F.row_number().over(Window.partitionBy("node_type").orderBy(*rank))).where(F.col("place") <= most)
    left = F.broadcast(chosen.agg((F.lit(3 * most) - F.count("*")).alias("left")))
    fill = top.join(F.broadcast(chosen.select("node")), "node", "left_anti").crossJoin(left)
    fill = fill.withColumn("n", F.row_number().over(Window.partitionBy("left").orderBy(kinds, "place"))).where(F.col("n") <= F.col("left")).withColumn("near", F.lit(False))
    columns = ["node_type", "node", "label", "near"]
    nodes_shown = chosen.select(*columns).union(fill.select(*columns))
    ends = F.broadcast(nodes_shown.select("node"))
    shown = edges.join(ends.withColumnRenamed("node", "source"), "source", "left_semi").join(ends.withColumnRenamed("node", "target"), "target", "left_semi")
    return nodes_shown, shown.select("edge_type", "source", "target")
