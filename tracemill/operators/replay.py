"""Replaying action lists over state tables as sets of changes.

No state is copied. A trace becomes the few cells it changes: updates and
deletes of existing rows keyed by entity, added rows keyed by their position
among the rows the trace leaves added. Two traces end in the same state exactly
when these sets are equal.

What a tool does is read from the catalogue: ``op_kind``, ``target`` and
``key_arg``. The other arguments of an insert or update are attribute values.
An action fails, and is passed over, if its text could not be called, if its
entity does not exist at that step, or if an insert reuses an id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill import constants as C
from tracemill.functions import text as X

DELTA = "array<struct<target string, change string, row_key string, attr string, value string>>"


def explode_actions(df: DataFrame, keys: Sequence[str], actions: str) -> DataFrame:
    """One row per action with its step number from 1."""
    # The outer form: for the other one the optimiser adds a filter that makes the list twice.
    rows = df.select(*keys, F.posexplode_outer(actions).alias("_pos", "action")).where(F.col("_pos").isNotNull())
    return rows.select(*keys, (F.col("_pos") + 1).cast("long").alias("step"), "action")


def effective_writes(actions: DataFrame, keys: Sequence[str], tools: DataFrame) -> DataFrame:
    """Write actions with the entity they address; reads and unknown tools drop out here.

    ``args`` is null for an action that could not be called, which ``net_changes`` drops.
    """
    kinds = tools.where(F.col("op_kind").isin("insert", "update", "delete")).select(
        X.internal_tool_id(F.col("tool")).alias("_fn"), "op_kind", "target", "key_arg"
    )
    return (
        actions.withColumn("_fn", X.function_name(F.col("action")))
        .join(kinds, "_fn")
        .select(*keys, "step", "op_kind", "target", "key_arg", X.action_args(F.col("action")).alias("args"))
        .withColumn(
            "entity_id",
            F.try_element_at(
                F.filter("args", lambda a: a["name"] == F.col("key_arg")), F.lit(1)
            )["value"],
        )
    )


# The rules below are SQL text: one expression each, where columns would be hundreds of calls from Python.


def _folded(name: str, value: str) -> str:
    """An attribute value in lower case, unless the attribute keeps its case."""
    kept = ", ".join(f"'{a}'" for a in C.CASE_KEPT_ATTRIBUTES)
    return f"if({name} IN ({kept}), {value}, lower({value}))"


def _cells(writes: str, target: str, change: str, row_key: str) -> str:
    """Writes as changed cells, with values compared without regard to case."""
    cell = f"struct({target} AS target, '{change}' AS change, {row_key} AS row_key, w.name AS attr, {_folded('w.name', 'w.value')} AS value)"
    return f"CAST(transform({writes}, w -> {cell}) AS {DELTA})"


def _looked_up(writes: DataFrame, base_state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Write actions as ``op``, with the base value of each attribute they name and whether base state has the entity.

    Only what an action names leaves the lookup, not whole base rows. Actions without an id have nothing to look up: they
    get keys of their own that meet no base row, so that they do not gather in one task.
    """
    base = base_state.where("entity_id IS NOT NULL").selectExpr("target", "entity_id AS _key", "true AS _known", "attrs")
    spread = F.coalesce("entity_id", F.xxhash64(*keys, "step").cast("string"))
    met = writes.withColumns({"_key": spread, "_known": F.expr("entity_id IS NOT NULL")}).join(base, ["target", "_key", "_known"], "left")
    return met.selectExpr(
        *keys, "target", "entity_id", "key_arg", "attrs IS NOT NULL AS in_base",
        # An action without an id stands alone; its step tells it apart. Only an insert can then succeed.
        "if(entity_id IS NULL, step, NULL) AS _own",
        """if(args IS NOT NULL, struct(step, op_kind, transform(args, a -> struct(
            a.name AS name, a.value AS value, try_element_at(attrs, a.name) AS was)) AS args), NULL) AS op""",
    )


def _net_effects(traces: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Net effect of each trace on each entity it writes, from its write actions in ``ops``, as a list ``folded``.

    All of it happens inside the row of a trace: its actions are sorted by entity, and each run of the same entity is folded.
    """
    alike = "struct(o.target, o.entity_id, o.own) <=> struct(get(ops, i - 1).target, get(ops, i - 1).entity_id, get(ops, i - 1).own)"
    cut = traces.selectExpr(*keep, "sort_array(filter(ops, o -> o.args IS NOT NULL)) AS ops").selectExpr(
        *keep, "ops", f"filter(transform(ops, (o, i) -> if(i > 0 AND {alike}, NULL, i)), i -> i IS NOT NULL) AS starts"
    )
    let = lambda value, name, use: f"transform(array({value}), {name} -> {use})[0]"
    group = "slice(ops, s + 1, coalesce(get(starts, j + 1), size(ops)) - s)"
    born = "if(held, 0L, array_min(transform(filter(g, o -> o.op_kind = 'insert'), o -> o.step)))"
    died = "array_min(transform(filter(g, o -> o.op_kind = 'delete' AND o.step > born), o -> o.step))"
    # The id names the row to change; only an added row also carries it as a cell.
    written = """flatten(transform(filter(g, o -> o.op_kind = 'update' AND o.step > born OR o.op_kind = 'insert' AND o.step = born),
        o -> filter(o.args, a -> o.op_kind = 'insert' OR NOT (a.name <=> g[0].key_arg))))"""
    # One write per attribute: the last one.
    last = "transform(array_distinct(transform(ws, w -> w.name)), n -> element_at(filter(ws, w -> w.name = n), -1))"
    effect = f"""if(born IS NULL OR (NOT held AND died IS NOT NULL), NULL, struct(
        g[0].target AS target, g[0].entity_id AS entity_id, held AS in_base, born AS added_at, died IS NOT NULL AS deleted,
        {let(f"if(died IS NULL, {written}, NULL)", "ws", last)} AS cells))"""
    several = let("exists(g, o -> o.in_base)", "held", let(born, "born", let(died, "died", effect)))
    # The same for a single action, whose attributes are distinct: it changes a known row or adds one, or nothing.
    single = """if(NOT o.in_base AND o.op_kind <> 'insert', NULL, struct(
        o.target AS target, o.entity_id AS entity_id, o.in_base AS in_base, if(o.in_base, 0L, o.step) AS added_at, o.op_kind = 'delete' AS deleted,
        if(o.op_kind = 'delete', NULL, filter(o.args, a -> if(o.in_base, o.op_kind = 'update' AND NOT (a.name <=> o.key_arg), true))) AS cells))"""
    folded = let(group, "g", f"if(size(g) = 1, {let('g[0]', 'o', single)}, {several})")
    return cut.selectExpr(*keep, f"filter(transform(starts, (s, j) -> {folded}), g -> g IS NOT NULL) AS folded")


def net_changes(traces: DataFrame) -> DataFrame:
    """Traces with the final state change of their write actions ``ops``.

    ``delta`` is what a trace changes compared without regard to case (except for the
    attributes that keep theirs), ``changed`` whether it changes anything at all,
    case included, ``writes`` whether any of its actions took effect.
    """
    keep = [c for c in traces.columns if c != "ops"]
    moved = f"filter(g.cells, w -> NOT ({_folded('w.name', 'w.value')} <=> {_folded('w.name', 'w.was')}))"
    gone = f"CAST(array(struct(g.target, 'delete', g.entity_id, '', '')) AS {DELTA})"
    rows = _net_effects(traces, keep).selectExpr(
        *keep, "size(folded) > 0 AS writes",
        f"flatten(transform(filter(folded, g -> g.in_base), g -> if(g.deleted, {gone}, {_cells(moved, 'g.target', 'update', 'g.entity_id')}))) AS old_rows",
        "sort_array(transform(filter(folded, g -> NOT g.in_base), g -> struct(g.target AS target, g.added_at AS added_at, g.cells AS cells))) AS new_rows",
        "exists(folded, g -> NOT g.in_base OR g.deleted OR exists(g.cells, w -> NOT (w.value <=> w.was))) AS changed",
    )
    # Position of an added row among the rows added to the same target.
    place = "CAST(size(filter(slice(new_rows, 1, i + 1), q -> q.target = r.target)) AS string)"
    added = f"flatten(transform(new_rows, (r, i) -> {_cells('r.cells', 'r.target', 'insert', place)}))"
    return rows.selectExpr(*keep, f"sort_array(concat(old_rows, {added})) AS delta", "changed", "writes")


def replay(actions: DataFrame, tools: DataFrame, base_state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final state change of each trace, from a table of actions. Traces that write nothing have no row."""
    looked = _looked_up(effective_writes(actions, keys, tools), base_state, keys)
    op = "struct(target, entity_id, _own AS own, op.step AS step, op.op_kind AS op_kind, op.args AS args, in_base, key_arg)"
    # Nothing is filtered on a computed column: the optimiser would move the filter down and compute the column there once more,
    # the arguments of every action for ``op``, the whole folding, many times over, for ``writes``. Lists leave nulls out.
    traces = looked.groupBy(*keys).agg(F.expr(f"collect_list(if(op IS NOT NULL, {op}, NULL)) AS ops"))
    wrote = F.when(F.col("writes"), F.array(F.struct("writes", "delta", "changed")))
    return net_changes(traces).select(*keys, F.inline_outer(wrote)).where("writes").drop("writes")


# --- lists of actions inside rows ------------------------------------------------------------


def writing_tools(tools: DataFrame) -> Column:
    """What each writing tool does, by internal name, as one map computed once per query (scalar subquery)."""
    name = X.internal_tool_id(F.col("tool"))
    kind = F.struct(name.alias("fn"), "op_kind", "target", "key_arg")
    found = tools.where(F.col("op_kind").isin("insert", "update", "delete")).agg(F.collect_set(name).alias("names"), F.collect_set(kind).alias("kinds"))
    listed = F.transform("names", lambda n: F.struct(n, F.filter("kinds", lambda k: k["fn"] == n)))
    return found.select(F.map_from_entries(listed)).scalar()


def write_list(actions: Column, kinds: Column) -> Column:
    """The write actions of a list that could be called, with the entity they address; ``effective_writes`` inside a row."""
    def of(a: Column, i: Column, args: Column, k: Column) -> Column:
        key = F.try_element_at(F.filter(args, lambda x: x["name"] == k["key_arg"]), F.lit(1))["value"]
        return F.struct(
            k["target"].alias("target"), key.alias("entity_id"), (i + 1).cast("long").alias("step"), k["op_kind"].alias("op_kind"),
            args.alias("args"), k["key_arg"].alias("key_arg"),
        )

    def read(a: Column, i: Column) -> Column:
        # One lookup in the map: it compares names one by one.
        called = lambda found: X.let(X.action_args(a), lambda args: F.when(args.isNotNull(), F.transform(found, lambda k: of(a, i, args, k))))
        return X.let(F.try_element_at(kinds, X.function_name(a)), lambda found: F.when(found.isNotNull(), called(found)))

    return F.flatten(F.filter(F.transform(actions, read), lambda w: w.isNotNull()))


def distinct_actions(lists: DataFrame, near: Sequence[str], actions: str) -> DataFrame:
    """One row per ``near``: the actions of all its lists, each text once. Null lists and actions hold none."""
    return lists.groupBy(*near).agg(F.array_distinct(F.flatten(F.collect_list(actions))).alias(actions))


def lookups(writes: DataFrame, base_state: DataFrame, near: Sequence[str], whole: bool = False) -> DataFrame:
    """For all rows of ``writes`` (``near`` and a list ``writes``) that share ``near``: a list ``known`` of the base rows they address.

    An entity that several of them address is looked up once for each set of attributes they name. Actions without an id look nothing
    up, and only what an action names leaves the lookup, not whole base rows. ``whole`` says that no two rows share ``near``.
    """
    named = "transform(filter(writes, w -> w.entity_id IS NOT NULL), w -> struct(w.target AS target, w.entity_id AS _key, w.args.name AS names))"
    asked = writes.selectExpr(*near, f"array_distinct({named}) AS asked")
    if not whole:
        asked = asked.groupBy(*near).agg(F.expr("array_distinct(flatten(collect_list(asked))) AS asked"))
    asked = asked.selectExpr(*near, "inline(asked)")
    base = base_state.where("entity_id IS NOT NULL AND attrs IS NOT NULL").selectExpr("target", "entity_id AS _key", "attrs")
    met = base.join(asked, ["target", "_key"]).selectExpr(
        *near, "struct(target, _key AS entity_id, names, transform(names, n -> try_element_at(attrs, n)) AS was) AS known"
    )
    return met.groupBy(*near).agg(F.collect_list("known").alias("known"))


# A write with the base values of what it names, once for each base row of its entity; ``own`` tells actions without an id apart.
MET = """flatten(transform(writes, w -> transform(
    array(transform(filter(known, k -> k.target = w.target AND k.entity_id = w.entity_id AND k.names = w.args.name), k -> k.was)),
    found -> transform(if(size(found) > 0, found, array(CAST(NULL AS array<string>))), v -> struct(
        w.target AS target, w.entity_id AS entity_id, if(w.entity_id IS NULL, w.step, NULL) AS own, w.step AS step,
        w.op_kind AS op_kind, transform(w.args, (a, i) -> struct(a.name AS name, a.value AS value, get(v, i) AS was)) AS args,
        v IS NOT NULL AS in_base, w.key_arg AS key_arg)))[0]))"""


def with_writes(traces: DataFrame, actions: str, kinds: Column, keys: Sequence[str], near: Sequence[str]) -> DataFrame:
    """Rows with the list ``writes`` of their trace, read from the lists ``actions``; rows of the same ``keys`` are one trace.

    Rows are dealt by ``near`` alone, where they meet what is looked up for them: the rows of a trace are peers in its order. So one
    shuffle and one sort serve this and joins by ``near`` after it, and both move the texts, as writes are read after them.
    """
    same, rest = W.partitionBy(*near), [k for k in keys if k not in near]
    if rest:
        same = same.orderBy(*rest).rangeBetween(W.currentRow, W.currentRow)
    listed = F.transform("writes", lambda a: write_list(X.escape_newlines(a), F.col("_kinds")))
    return (
        traces.withColumn("writes", F.collect_list(actions).over(same)).withColumn("_kinds", kinds)
        .withColumn("writes", F.flatten(F.array_distinct(listed))).drop("_kinds")
    )


def replay_rows(merged: DataFrame, known: DataFrame, near: Sequence[str]) -> DataFrame:
    """Rows with a list ``writes`` and the state change of their trace. Rows stay where they are, and meet what was looked up for them."""
    if len(near) == 1:
        met = merged.join(known, list(near), "left")
    else:
        # Keys may be null, and rows without a key are a trace as well.
        renamed = known.withColumnsRenamed({c: f"_near_{c}" for c in near})
        on = [F.col(c).eqNullSafe(F.col(f"_near_{c}")) for c in near]
        met = merged.join(renamed, on, "left").drop(*[f"_near_{c}" for c in near])
    rest = [c for c in met.columns if c not in ("writes", "known")]
    return net_changes(met.selectExpr(*rest, f"{MET} AS ops")).drop("writes")


def deltas(replayed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The changed cells of each trace as rows."""
    return replayed.select(*keys, F.inline("delta"))


def state_difference(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changed cells found on one side only. ``pairs`` has ``delta`` and ``gold_delta``."""
    tagged = lambda c, side: F.transform(
        c, lambda d: F.struct(F.lit(side).alias("side"), d["target"], d["change"], d["row_key"], d["attr"], d["value"])
    )
    both = F.concat(
        tagged(F.array_except("delta", "gold_delta"), "predicted"),
        tagged(F.array_except("gold_delta", "delta"), "gold"),
    ).cast(
        "array<struct<side string, target string, change string, row_key string, attr string, value string>>"
    )
    return pairs.select(*keys, F.inline(both))
