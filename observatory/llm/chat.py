"""Tool-call linking, with DataFrame and SQL functions only.

Calls and results meet by a hash join on their identifier. Within a conversation
calls are ordered so that each stands behind the calls it depends on, arguments are
validated against the tools' schemas, and what comes out is canonical JSON: keys
ascending at all depths, no spaces, numbers in their shortest form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from observatory.shared import cut

#: Places of a conversation that one task orders.
SPAN = 1000
#: Calls of a conversation that are brought into order together; longer ones go through joins.
SMALL = 500

_KINDS = {"integer": "BIGINT", "number": "(BIGINT|DECIMAL.*|DOUBLE|FLOAT)", "string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID", "any": ".*"}


def canonical_json(column: str) -> Column:
    """The canonical form of a JSON text; null if it is no JSON or repeats a key."""
    return F.to_json(F.try_parse_json(F.col(column)))


def _checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with arguments made canonical and ``errors``, ascending texts such as ``missing:x``."""
    kind = F.lit(".*")
    for name, pattern in _KINDS.items():
        kind = F.when(F.lower("type") == name, pattern).otherwise(kind)
    entry = F.struct("param", kind.alias("kind"), F.coalesce(F.col("required"), F.lit(False)).alias("required"))
    tools = schemas.where("name is not null").groupBy("name").agg(F.array_sort(F.collect_set(F.when(F.col("param").isNotNull(), entry))).alias("params"))
    rows = calls.withColumn("canonical", canonical_json("arguments")).join(tools, "name", "left")
    is_object = F.coalesce(F.startswith("canonical", F.lit("{")), F.lit(False))
    rows = rows.withColumn("types", F.when(is_object, F.expr("transform_values(from_json(canonical, 'map<string,variant>'), (k, v) -> schema_of_variant(v))")))
    given = F.map_keys("types")
    missing = F.transform(F.filter("params", lambda p: p["required"] & ~F.array_contains(given, p["param"])), lambda p: F.concat(F.lit("missing:"), p["param"]))
    wrong = F.transform(
        F.filter("params", lambda p: F.array_contains(given, p["param"]) & ~F.regexp(F.element_at("types", p["param"]), F.concat(F.lit("^"), p["kind"], F.lit("$")))), lambda p: F.concat(F.lit("type:"), p["param"])
    )
    unknown = F.transform(F.array_except(given, F.transform("params", lambda p: p["param"])), lambda k: F.concat(F.lit("unknown:"), k))
    errors = F.when(F.col("params").isNull(), F.array(F.lit("no_tool"))).when(~is_object, F.array(F.lit("no_object"))).otherwise(F.array_sort(F.concat(missing, wrong, unknown)))
    return rows.withColumn("errors", errors).drop("params", "types")


def _settled(nodes: str) -> Column:
    """(late, hop) of each of a conversation's calls; ``nodes`` is an array of (turn, froms: places in it), in its order.

    Rounds within one expression; a round takes over the largest (late, hop) of the
    calls depended on. Whatever still moves after more rounds than a path can have
    hops is on a cycle or behind one.
    """
    kind = "array<struct<late:bigint,hop:bigint>>"
    return F.expr(f"""
      aggregate(sequence(1, 2 * size({nodes}) + 3),
        named_struct('now', cast(transform({nodes}, n -> named_struct('late', n.turn, 'hop', 0L)) as {kind}), 'moved', true),
        (s, round) -> if(NOT s.moved, s,
          named_struct(
            'now', cast(transform({nodes}, (n, i) -> aggregate(n.froms, named_struct('late', n.turn, 'hop', 0L),
              (best, f) -> greatest(best, if(s.now[f].hop > size({nodes}), named_struct('late', {2**63 - 1}L, 'hop', size({nodes}) + 1L), named_struct('late', s.now[f].late, 'hop', s.now[f].hop + 1L))))) as {kind}),
            'moved', s.now != cast(transform({nodes}, (n, i) -> aggregate(n.froms, named_struct('late', n.turn, 'hop', 0L),
              (best, f) -> greatest(best, if(s.now[f].hop > size({nodes}), named_struct('late', {2**63 - 1}L, 'hop', size({nodes}) + 1L), named_struct('late', s.now[f].late, 'hop', s.now[f].hop + 1L))))) as {kind}))),
        s -> s.now)""")


def _ordered(calls: DataFrame, small: int) -> DataFrame:
    """``calls`` with ``late`` and ``hop``: by (late, hop, turn) each call stands behind those it depends on; hop is null on and behind cycles.

    By their turns calls stand right unless one depends on a later one; such a call
    takes over the later one's place, ``hop`` behind it. Only conversations with such
    a dependency are ordered: up to ``small`` calls within one expression, longer ones
    by rounds of joins, one for each further step of a chain.
    """
    edges = calls.select("conv_id", F.col("call_id").alias("to"), F.explode("depends").alias("call_id")).distinct()
    turns = calls.select("conv_id", "call_id", "turn")
    edges = edges.join(turns, ["conv_id", "call_id"]).select("conv_id", F.col("call_id").alias("from"), F.col("turn").alias("from_turn"), F.col("to").alias("call_id")).join(turns, ["conv_id", "call_id"])
    edges = cut(edges.select("conv_id", "from", F.col("call_id").alias("to"), (F.col("from_turn") >= F.col("turn")).alias("back")), "depends")
    odd = edges.where("back").select("conv_id").distinct()
    size = cut(calls.groupBy("conv_id").agg(F.count("*").alias("size")).join(odd, "conv_id"), "odd")
    short = size.where(F.col("size") <= small).select("conv_id")
    # at most ``small`` rows a conversation from here on
    numbered = turns.join(short, "conv_id").withColumn("at", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "call_id")) - 1).cast("int"))
    at = numbered.select("conv_id", "call_id", "at")
    froms = edges.join(short, "conv_id").join(at.toDF("conv_id", "from", "f"), ["conv_id", "from"]).groupBy("conv_id", F.col("to").alias("call_id")).agg(F.array_sort(F.collect_list("f")).alias("froms"))
    node = F.struct("at", F.col("turn").cast("long").alias("turn"), F.coalesce("froms", F.array().cast("array<int>")).alias("froms"), "call_id")
    nodes = numbered.join(froms, ["conv_id", "call_id"], "left").groupBy("conv_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    done = nodes.withColumn("now", _settled("nodes")).select("conv_id", F.size("nodes").alias("size"), F.explode(F.arrays_zip("nodes", "now")).alias("x"))
    state = done.select("conv_id", F.col("x.nodes.call_id").alias("call_id"), "size", F.col("x.now.late").alias("late"), F.col("x.now.hop").alias("hop"))
    if size.where(F.col("size") > small).head(1):
        state = state.union(_by_rounds(turns, edges, size.where(F.col("size") > small)))
    state = state.select("conv_id", "call_id", F.col("late").alias("new_late"), F.when(F.col("hop") <= F.col("size"), F.col("hop")).alias("new_hop"), F.lit(True).alias("odd"))
    out = calls.join(state, ["conv_id", "call_id"], "left")
    return out.withColumn("late", F.coalesce("new_late", "turn")).withColumn("hop", F.when(F.col("odd"), F.col("new_hop")).otherwise(F.lit(0).cast("long"))).drop("new_late", "new_hop", "odd")


def _by_rounds(turns: DataFrame, edges: DataFrame, size: DataFrame) -> DataFrame:
    """Rows (conv_id, call_id, size, late, hop) of the conversations in ``size``, whose calls no task holds together."""
    state = cut(turns.join(size, "conv_id").select("conv_id", "call_id", "turn", "size", F.col("turn").cast("long").alias("late"), F.lit(0).cast("long").alias("hop")), "order")
    edges = cut(edges.join(size, "conv_id", "left_semi").select("conv_id", "from", "to"), "depends")
    # what stands on no cycle nor behind one goes, a layer each round; a cycle alone stops it at once
    left = edges
    while True:
        free = left.select(F.col("conv_id"), F.col("from").alias("call_id")).distinct().join(left.select("conv_id", F.col("to").alias("call_id")).distinct(), ["conv_id", "call_id"], "left_anti")
        fewer = cut(left.join(free.withColumnRenamed("call_id", "from"), ["conv_id", "from"], "left_anti"), "cyclic")
        if not left.join(free.withColumnRenamed("call_id", "from"), ["conv_id", "from"], "left_semi").head(1):
            break
        left = fewer
    endless = left.select("conv_id", F.col("to").alias("call_id")).distinct()
    last = state.join(endless, ["conv_id", "call_id"], "left_semi").select("conv_id", "call_id", "size", F.lit(2**63 - 1).alias("late"), (F.col("size") + 1).alias("hop"))
    state = cut(state.join(endless, ["conv_id", "call_id"], "left_anti"), "order")
    while True:
        ahead = state.select("conv_id", F.col("call_id").alias("from"), "late", (F.col("hop") + 1).alias("hop"))
        ahead = edges.join(ahead, ["conv_id", "from"]).groupBy("conv_id", F.col("to").alias("call_id")).agg(F.max(F.struct("late", "hop")).alias("a"))
        placed = F.when(F.col("a.late") >= F.col("turn"), F.col("a")).otherwise(F.struct(F.col("turn").cast("long").alias("late"), F.lit(0).cast("long").alias("hop")))
        new = state.join(ahead, ["conv_id", "call_id"], "left").withColumn("b", placed)
        new = cut(new.select("conv_id", "call_id", "turn", "size", F.col("b.late").alias("late"), F.col("b.hop").alias("hop"), ((F.col("b.late") != F.col("late")) | (F.col("b.hop") != F.col("hop"))).alias("changed")), "order")
        state = new.drop("changed")
        if not new.where("changed").head(1):
            return state.select("conv_id", "call_id", "size", "late", "hop").union(last)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, small: int = SMALL) -> DataFrame:
    """One row per call and per result without a call: (conv_id, call_id, place, status, errors, message).

    ``calls`` is (conv_id, turn, call_id, name, arguments JSON, depends array of
    call ids), ``results`` (conv_id, turn, call_id, content), ``schemas`` (name,
    param, type, required), a row with null param for a tool without parameters;
    other columns are ignored. place counts a conversation's calls from 0, each
    behind those it depends on, else by turn; calls on or behind a cycle come last.
    status is the first that holds: ``cycle``, ``invalid`` (errors says why: no_tool,
    no_object for arguments that are no JSON object or repeat a key, missing:,
    type:, unknown: with the parameter), ``no_result``, ``ok``; ``orphan`` for
    results without a call (place null). Dependencies on ids that are no calls of the
    conversation are void. Of calls that share an id the earliest stands, then the
    one of the smallest name and arguments; of its results the earliest, then the
    smallest. Calls and results with a null conv_id, turn or call_id are left out:
    nothing can be linked by them. message is canonical JSON of all this; its keys
    are arguments (null if no object), call_id, name, result, status. Empty tables
    give no rows.
    """
    keyed = "conv_id is not null and turn is not null and call_id is not null"
    body = F.struct("turn", "name", "arguments", F.array_sort("depends").alias("depends"))
    calls = calls.where(keyed).groupBy("conv_id", "call_id").agg(F.min(body).alias("b")).select("conv_id", "call_id", "b.*")
    results = results.where(keyed).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", F.col("content"))).alias("r")).select("conv_id", "call_id", F.col("r.content").alias("content"), F.lit(True).alias("answered"))
    placed = _ordered(_checked(calls, schemas), small)
    cyclic = F.col("hop").isNull()
    placed = cut(placed.withColumn("late", F.when(~cyclic, F.col("late"))).withColumn("span", F.when(~cyclic, F.floor(F.col("late") / SPAN))), "calls")
    # places within a span, and how many stand in the spans before
    span = Window.partitionBy("conv_id", "span").orderBy(F.asc_nulls_last("late"), "hop", "turn", "call_id")
    ahead = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("span")).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("conv_id", "span").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "before")
    placed = placed.withColumn("in_span", F.row_number().over(span) - 1)
    placed = placed.join(counts, (F.col("conv_id") == F.col("c")) & F.col("span").eqNullSafe(F.col("s"))).withColumn("place", (F.col("before") + F.col("in_span")).cast("long"))
    linked = placed.select("conv_id", "call_id", "place", "name", "canonical", "errors", cyclic.alias("cyclic")).join(results, ["conv_id", "call_id"], "full")
    status = (
        F.when(F.col("place").isNull(), "orphan").when(F.col("cyclic"), "cycle").when(F.size("errors") > 0, "invalid").when(F.col("answered").isNull(), "no_result").otherwise("ok")
    )
    linked = linked.withColumn("status", status)
    arguments = F.when(F.startswith("canonical", F.lit("{")), F.col("canonical"))

    def quoted(name: str) -> Column:
        one = F.to_json(F.struct(F.col(name).cast("string").alias("x")))
        return F.when(F.col(name).isNull(), "null").otherwise(F.substring(one, F.lit(6), F.length(one) - 6))

    parts = [F.lit('{"arguments":'), F.coalesce(arguments, F.lit("null"))]
    for key, name in (("call_id", "call_id"), ("name", "name"), ("result", "content"), ("status", "status")):
        parts += [F.lit(f',"{key}":'), quoted(name)]
    message = F.concat(*parts, F.lit("}"))
    return linked.select("conv_id", "call_id", "place", "status", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), message.alias("message"))


def as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations, as models that err make them.

    Each user turn is a call of the tool ``reply`` with turn, prompt and length; the
    assistant's turn behind it is its result. By (31 conv_id + turn) mod 12 some calls
    are no object (1), name an unknown tool (3), miss turn (5), have it as text (7) or
    carry an unknown parameter (9). By conv_id mod 3 a call depends on the one before
    (0), on the one behind (1), or, by pairs and in conversations of even number, each
    of a pair on the other (2). By (conv_id + turn) mod 9 = 0 a result names a call
    that nobody made. Roles are compared in lower case; turns of any other role, such
    as system, are neither calls nor results.
    """
    role, conv, turn = F.lower("role"), F.col("conv_id"), F.col("turn")
    call_id = F.concat_ws("-", F.lit("call"), conv, turn)
    prompt = F.coalesce("text", F.lit(""))
    length, prompt = F.length(prompt).alias("length"), prompt.alias("prompt")
    odd = F.pmod(conv * 31 + turn, F.lit(12))
    arguments = (
        F.when(odd == 1, F.to_json(F.array(turn))).when(odd == 5, F.to_json(F.struct(prompt, length))).when(odd == 7, F.to_json(F.struct(turn.cast("string").alias("turn"), prompt, length)))
        .when(odd == 9, F.to_json(F.struct(turn, prompt, length, F.lit("en").alias("lang")))).otherwise(F.to_json(F.struct(turn, prompt, length)))
    )
    kind = F.pmod(conv, F.lit(3))
    pair = F.when(F.pmod(conv, F.lit(2)) == 0, F.when(F.pmod(turn, F.lit(4)) < 2, turn + 2).otherwise(turn - 2))
    depends = F.array(F.concat(F.lit("call-"), conv, F.lit("-"), F.when(kind == 0, turn - 2).when(kind == 1, turn + 2).otherwise(pair)))
    name = F.when(odd == 3, "search").otherwise("reply")
    calls = conversations.where(role == "user").select("conv_id", "turn", call_id.alias("call_id"), name.alias("name"), arguments.alias("arguments"), depends.alias("depends"))
    answer = F.when(F.pmod(conv + turn, F.lit(9)) == 0, F.concat_ws("-", F.lit("nobody"), conv, turn)).otherwise(F.concat_ws("-", F.lit("call"), conv, turn - 1))
    results = conversations.where(role == "assistant").select("conv_id", "turn", answer.alias("call_id"), F.col("text").alias("content"))
    return calls, results
