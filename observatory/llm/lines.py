"""Near-equal lines by the deletion neighbourhood.

Two lines within one edit either differ in one character, and are equal without
the character at that place, or one of them is the other without a character.
So each line emits hashed keys: itself, and itself without each of its characters,
with the place (replaced characters) or without it (inserted ones). Lines that
meet in a key are compared with the earliest line there only, because whatever
meets in a key with a place is within one edit of all others there, and whatever
meets in one without a place is within one edit of the line that is the key.

Equal lines are one, and a line emits only what another line may meet: one edit
leaves one half alone, so there must be another line of nearly its length with the
same first or second half, and the edit is in the other half.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from observatory.llm.arrow import let_go
from observatory.llm.filters import bitmap
from observatory.shared import cut

#: One edit makes lines near-equal if it leaves 95 % of the longer one; shorter lines have to be equal, or the items of
#: a numbered list would be one.
LEAST = 20
#: Occurrences up to which a line is never taken for a common one.
HEAVY = 10_000
#: White space as str.strip takes it.
_SOLID = r"[^\p{IsWhite_Space}\x1c-\x1f]"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _both(line: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(line)
    return _signed(x >> 64), _signed(x & (1 << 64) - 1)


def halves(line: str) -> list[int]:
    """Keys of the halves of a line, as the shorter or the longer one of a pair.

    With h = n // 2 of the shorter length n, a pair within one edit shares its first
    h characters or its last n - h.
    """
    out = []
    for n in (len(line), len(line) - 1):
        h = n // 2
        for kind, part in ((1, line[:h]), (2, line[len(line) - (n - h) :])):
            out.append(_signed(xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"), seed=4 * n + kind)))
    return out


def neighbourhood(line: str, shared: set[int]) -> dict[int, bool]:
    """Key to whether it is the line itself, of all variants within one deletion that another line may have.

    ``shared`` are those of the line's halves that other lines have too. A shared
    half, and the length it stands for, leave open only edits in the other half.
    """
    raw, n = line.encode("utf-32-le", "surrogatepass"), len(line)
    first, last, longer_first, longer_last = (k in shared for k in halves(line))
    h, g = n // 2, (n - 1) // 2
    key = lambda x, seed: _signed(xxhash.xxh3_64_intdigest(x, seed=seed))
    out = {}
    for i in [*(range(h) if last else ()), *(range(h, n) if first else ())]:
        out[key(raw[: 4 * i] + raw[4 * i + 4 :], 1 + i)] = False
    for i in range(0 if longer_last else g, n if longer_first else g + 1 if longer_last else 0):
        out[key(raw[: 4 * i] + raw[4 * i + 4 :], 0)] = False
    if first or last:
        out[key(raw, 0)] = True
    return out


def within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _lines(text: str) -> list[str]:
    return [x.strip() for x in text.split("\n")]


def _occurrences(docs: DataFrame) -> DataFrame:
    """Rows (id, mark, pos, h1, h2), one per line that isn't blank; mark tells texts of one id apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                out: list[list] = [[] for _ in range(4)]
                for row, text in enumerate(part.column(2).to_pylist()):
                    for pos, line in enumerate(_lines(text)):
                        if line:
                            h1, h2 = _both(line.encode("utf-8", "surrogatepass"))
                            for column, v in zip(out, (row, pos, h1, h2)):
                                column.append(v)
                at = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["id", "mark", "pos", "h1", "h2"])

    return docs.mapInArrow(run, "id long, mark long, pos int, h1 long, h2 long")


def _half_keys(docs: DataFrame, least: int) -> DataFrame:
    """Rows (key, h1) of the halves of all lines that may have a neighbour."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            for low in range(0, b.num_rows, 500):
                found = {x: 0 for text in b.column(0).slice(low, 500).to_pylist() for x in _lines(text) if len(x) >= least - 1}
                keys = [k for x in found for k in halves(x)]
                own = [h for x in found for h in (_both(x.encode("utf-8", "surrogatepass"))[0],) * 4]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(own, pa.int64())], names=["key", "h1"])

    return docs.select("text").mapInArrow(run, "key long, h1 long")


def _candidates(docs: DataFrame, shared: DataFrame, least: int) -> DataFrame:
    """Rows (h1, h2, line) of the distinct lines of which a half is in ``shared`` (key)."""
    may_be = bitmap(shared, "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            for low in range(0, b.num_rows, 500):
                lines = list({x: 0 for text in b.column(0).slice(low, 500).to_pylist() for x in _lines(text) if len(x) >= least - 1})
                keys = np.array([halves(x) for x in lines], dtype=np.int64).reshape(-1, 4)
                at = np.flatnonzero(may_be(keys).any(axis=1))
                own = [_both(lines[i].encode("utf-8", "surrogatepass")) for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in own], pa.int64()), pa.array([k[1] for k in own], pa.int64()), pa.array([lines[i] for i in at], pa.string()), pa.array(keys[at].tolist(), pa.list_(pa.int64()))], names=["h1", "h2", "line", "keys"]
                )

    rows = docs.select("text").mapInArrow(run, "h1 long, h2 long, line string, keys array<long>").groupBy("h1", "h2").agg(F.min("line").alias("line"), F.min("keys").alias("keys"))
    rows = cut(rows, "half-lines")
    sure = rows.select("h1", "h2", F.explode("keys").alias("key")).join(shared, "key", "left_semi").groupBy("h1", "h2").agg(F.collect_set("key").alias("shared"))
    return rows.join(sure, ["h1", "h2"]).select("h1", "h2", "line", "shared")


def _variant_keys(lines: DataFrame) -> DataFrame:
    """Rows (key, h1) of all neighbourhoods."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            for low in range(0, b.num_rows, 200):
                part = b.slice(low, 200)
                keys = [list(neighbourhood(x, set(k))) for x, k in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x for k in keys for x in k], pa.int64()), part.column(0).take(at)], names=["key", "h1"])

    return lines.select("h1", "line", "shared").mapInArrow(run, "key long, h1 long")


def _variants(lines: DataFrame, met: DataFrame) -> DataFrame:
    """Rows (key, self, h1, h2, first) of the neighbourhoods, only of keys in ``met`` (key)."""
    may_be = bitmap(met, "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            for low in range(0, b.num_rows, 200):
                part = b.slice(low, 200)
                found = [neighbourhood(x, set(k)) for x, k in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                at = np.repeat(np.arange(len(found)), [len(k) for k in found])
                keys = np.array([x for k in found for x in k], dtype=np.int64)
                own = np.array([y for k in found for y in k.values()], dtype=bool)
                keep = np.flatnonzero(may_be(keys)) if len(keys) else np.zeros(0, np.int64)
                rows = pa.array(at[keep], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(own[keep], pa.bool_()), *(part.column(c).take(rows) for c in (0, 1, 4, 5, 6))], names=["key", "self", "h1", "h2", "id", "mark", "pos"])

    out = lines.select("h1", "h2", "line", "shared", "first.id", "first.mark", "first.pos").mapInArrow(run, "key long, self boolean, h1 long, h2 long, id long, mark long, pos int")
    return out.join(met, "key", "left_semi").select("key", "self", "h1", "h2", F.struct("id", "mark", "pos").alias("first"))


def _near_earlier(docs: DataFrame, unique: DataFrame, least: int) -> DataFrame:
    """Rows (h1, h2) of the lines that have an earlier line within one edit."""
    shared = _half_keys(docs, least).groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("key")
    found = _candidates(docs, cut(shared, "halves"), least)
    lines = cut(found.join(unique, ["h1", "h2"]), "lines")
    several = _variant_keys(lines).groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("key")
    variants = cut(_variants(lines, cut(several, "met")), "variants")
    own = F.struct("first", "h1", "h2")
    met = variants.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("self"), own)).alias("base"), F.min(F.when(~F.col("self"), own)).alias("least")).where("n > 1").drop("n")
    # in a key with a place there is no base, and the earliest line there is near all others;
    # in one without, only the base is near them
    rival = F.when(F.col("self") | F.col("base").isNull(), F.col("least")).otherwise(F.col("base"))
    pairs = variants.join(met, "key").withColumn("rival", rival).where("rival.first < first")
    pairs = pairs.select("h1", "h2", F.col("rival.h1").alias("r1"), F.col("rival.h2").alias("r2")).distinct()
    text = lines.select("h1", "h2", "line")
    pairs = pairs.join(text, ["h1", "h2"]).join(text.toDF("r1", "r2", "other"), ["r1", "r2"]).select("h1", "h2", "line", "other")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            near = [within_one_edit(x, y) and min(len(x), len(y)) >= least - 1 and max(len(x), len(y)) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return pairs.mapInArrow(run, "h1 long, h2 long").distinct()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, least: int = LEAST) -> DataFrame:
    """``df`` with the lines taken out of its texts that stand, or nearly stand, in an earlier place.

    Lines are what line feeds separate, compared without white space around them.
    Of equal lines the earliest stays: the one of the smallest id (null first), then
    in the text of the smallest hash if texts share an id, then highest up. With
    ``edits`` 1 (0: equal lines only) a line also goes, in all its places, if an
    earlier line is within one inserted, deleted or replaced code point; of such a
    pair one has ``least`` code points or more. Blank lines stay unless a text loses
    lines and nothing else would be left, which leaves the empty text; null texts
    stay null. Rows that are equal in id and text are treated alike. Returns the
    columns of ``df``, the text shortened, and, last, ``lines_removed`` (int array of
    places from 0, ascending; null if none): a column of that name in ``df`` gives
    way; all other columns are carried along. Rows keep their number, repeated ones
    included; an empty table gives no rows.
    """
    docs = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    found = cut(_occurrences(docs), "occurrences")
    unique = cut(found.groupBy("h1", "h2").agg(F.min(F.struct("id", "mark", "pos")).alias("first"), F.count("*").alias("n")), "unique")
    own = F.struct("id", "mark", "pos")
    lines = unique.select("h1", "h2", "first", F.lit(False).alias("near"), "n")
    if edits:
        near = cut(_near_earlier(docs, unique.drop("n"), least), "near").withColumn("near", F.lit(True))
        lines = unique.join(near, ["h1", "h2"], "left").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"), "n")
    # lines that have more than a thousandth of all occurrences are a thousand at most, and go to all tasks
    total = unique.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") > max(HEAVY, total // 1000)
    common = F.broadcast(lines.where(heavy).drop("n"))
    rare = found.join(common.select("h1", "h2"), ["h1", "h2"], "left_anti").join(lines.where(~heavy).drop("n"), ["h1", "h2"])
    out = found.join(common, ["h1", "h2"]).unionByName(rare).where(F.col("near") | (own > F.col("first")))
    # a text's lines fit wherever the text does
    out = out.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.array_sort(F.collect_set("pos")).alias("__removed"))
    rows = df.drop("lines_removed")
    joined = rows.join(out, rows[id_col].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(rows[text_col]) == F.col("__mark")), "left")
    left = _without(F.col(text_col), F.col("__removed"))
    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(left)
    return joined.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in rows.columns), F.col("__removed").alias("lines_removed"))


def _without(text: Column, removed: Column) -> Column:
    """The text without the lines at ``removed``, in steps that grow with its lines; empty if only blank lines are left."""
    bound = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    joined = lambda kept: F.when(F.exists(kept, lambda x: F.rlike(x, F.lit(_SOLID))), F.array_join(kept, "\n")).otherwise("")
    places = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    return bound(F.split(text, "\n", -1), lambda lines: bound(F.transform(places(lines), lambda i: F.get(lines, i)), joined))
