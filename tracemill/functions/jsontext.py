"""Reading JSON out of free model text.

Texts in the usual clean shapes are read by JVM expressions. The others go
through Arrow functions; a clean row hands them a null, so Python sees only the
text it is needed for. A guard expression accepts a text only if both ways give
the same result for it.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, udtf

from tracemill import constants as C
from tracemill import schemas

_JSON = json.JSONDecoder()
_BLOCK = C.CALL_BLOCK

CALL = schemas._struct(name=T.StringType(), args=schemas.ARGS, args_json=T.StringType())
VERDICT = schemas._struct(success=T.BooleanType(), reason=T.StringType())


# --- small helpers that work on one text -------------------------------------------------


# What decoding may raise on odd texts: huge integers, deep nesting, unhashable keys.
UNREADABLE = (ValueError, TypeError, RecursionError, MemoryError)


_OPENING = re.compile(r'\{(?=[ \t\n\r]*+["}])')


def _decoded(text: str, at: int):
    """The JSON object that starts at ``at``, else None.

    It is decoded from a piece of the text that grows while the object may reach beyond it: a failure then costs no more than the
    piece, as errors count the lines before them.
    """
    size = 1_024
    while True:
        piece = text[at : at + size]
        try:
            return _JSON.raw_decode(piece)[0]
        except json.JSONDecodeError as e:
            # Literals and escapes that the cut has shortened fail up to ten characters before it.
            cut = e.pos >= len(piece) - 16 or e.msg.startswith("Unterminated string")
            if not cut or at + size >= len(text):
                return None
            size *= 4
        except UNREADABLE:
            return None


def objects_in(text: str) -> Iterator[dict]:
    """Every JSON object that starts at some ``{`` of the text, nested ones included."""
    for opening in _OPENING.finditer(text):
        value = _decoded(text, opening.start())
        if value is not None:
            yield value


def as_call(obj) -> tuple[str, dict] | None:
    """Tool name and arguments of a decoded object, or None if it is no call."""
    inner = obj.get("function")
    source = inner if isinstance(inner, dict) else obj
    args = source.get("parameters")
    args = source.get("arguments") if args is None else args
    if isinstance(args, str):
        try:
            args = json.loads(args)
        except UNREADABLE:
            return None
    name = source.get("name")
    return (name, args) if isinstance(name, str) and isinstance(args, dict) else None


def calls_in(text: str) -> list[tuple[str, dict]]:
    """One call per tagged block (or one for an untagged text); if that gives
    nothing, every call found anywhere in the text."""
    scopes = re.findall(_BLOCK, text) or [text]
    firsts = (next(filter(None, map(as_call, objects_in(s))), None) for s in scopes)
    return [c for c in firsts if c] or [c for c in map(as_call, objects_in(text)) if c]


def _call_row(call: tuple[str, dict]) -> dict:
    name, args = call
    return {
        "name": name,
        "args": [{"name": k, "value": str(v)} for k, v in args.items()],
        "args_json": json.dumps(args, sort_keys=True),
    }


def _thought_row(t) -> dict | None:
    if not isinstance(t, dict) or not isinstance(t.get("id"), str) or not t["id"].strip():
        return None
    why = t.get("reasoning")
    row = {
        "id": t["id"].strip(), "reasoning": why.strip() if isinstance(why, str) else "",
        "kind": None, "tool_name": None, "tool_args": None, "final_answer": None,
    }
    action = next((t[k] for k in ("action", "tool_call", "tool") if t.get(k) is not None), None)
    call = as_call(action) if isinstance(action, dict) else None
    answer = t.get("final_answer")
    if call:
        return row | {
            "kind": "tool_call", "tool_name": call[0], "tool_args": json.dumps(call[1], sort_keys=True)
        }
    if isinstance(answer, str) and answer.strip():
        return row | {"kind": "final_answer", "final_answer": answer.strip()}
    return None


def thoughts_in(text: str) -> list[dict]:
    for obj in objects_in(text):
        listed = obj.get("thoughts")
        rows = [r for r in map(_thought_row, listed) if r] if isinstance(listed, list) else []
        if rows:
            return rows
    empty = {"reasoning": "", "final_answer": None}
    return [
        empty | {
            "id": f"T{i}", "kind": "tool_call", "tool_name": name,
            "tool_args": json.dumps(args, sort_keys=True),
        }
        for i, (name, args) in enumerate(calls_in(text), 1)
    ]


def _names(value) -> list[str]:
    if isinstance(value, str):
        value = [p.strip() for p in value.split(",")]
    return [n for n in value if isinstance(n, str)] if isinstance(value, list) else []


def name_lists_in(text: str) -> list[list[str]]:
    """Tool name lists offered by the text's objects, in the order they are tried."""
    return [_names(o.get(k)) for o in objects_in(text) for k in ("selected_tools", "tools")]


def picked_ids_in(text: str) -> list[str]:
    out = []
    for o in objects_in(text):
        keys = ("best_thought_id", "selected_thought_id", "id")
        pick = next((o[k] for k in keys if o.get(k) is not None), None)
        if isinstance(pick, str):
            out.append(pick)
    return out


def verdict_in(text: str) -> dict | None:
    """Judge decision from the first object with a ``success`` member."""
    for o in objects_in(text):
        if "success" in o:
            s, why = o["success"], o.get("reason", "")
            won = s.strip().lower() in C.SUCCESS_WORDS if isinstance(s, str) else bool(s)
            return {"success": won, "reason": (why if isinstance(why, str) else json.dumps(why)).strip()}
    return None


def literal_list(text: str) -> list[str] | None:
    try:
        value = ast.literal_eval(text)
        return [str(v) for v in value] if isinstance(value, (list, tuple)) else None
    except (SyntaxError, *UNREADABLE):
        return None


def bracket_body(text: str) -> str | None:
    """Text up to the ``]`` that closes an already opened ``[``; None if it never closes."""
    depth = 1
    for m in re.finditer(r"[\[\]]", text):
        depth += 1 if m.group() == "[" else -1
        if depth == 0:
            return text[: m.start()]
    return None


def storable(value):
    """The value with lone surrogates, which UTF-8 cannot hold, replaced by question marks."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode("utf-8")
    if isinstance(value, dict):
        return {k: storable(v) for k, v in value.items()}
    return [storable(v) for v in value] if isinstance(value, (list, tuple)) else value


def _arrow(fn, spark_type: T.DataType, arrow_type: pa.DataType):
    @arrow_udf(spark_type)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else storable(fn(t)) for t in texts.to_pylist()], arrow_type)

    return run


_PA_ARGS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_PA_CALL = pa.struct([("name", pa.string()), ("args", _PA_ARGS), ("args_json", pa.string())])
_PA_CANDIDATE = pa.struct([(f.name, pa.string()) for f in schemas.CANDIDATE.fields])
_PA_VERDICT = pa.struct([("success", pa.bool_()), ("reason", pa.string())])
_STRINGS = T.ArrayType(T.StringType())

_py_calls = _arrow(lambda t: [_call_row(c) for c in calls_in(t)], T.ArrayType(CALL), pa.list_(_PA_CALL))
_py_thoughts = _arrow(thoughts_in, T.ArrayType(schemas.CANDIDATE), pa.list_(_PA_CANDIDATE))
_py_name_lists = _arrow(name_lists_in, T.ArrayType(_STRINGS), pa.list_(pa.list_(pa.string())))
_py_ids = _arrow(picked_ids_in, _STRINGS, pa.list_(pa.string()))
_py_verdict = _arrow(verdict_in, VERDICT, _PA_VERDICT)
_py_list = _arrow(literal_list, _STRINGS, pa.list_(pa.string()))
_py_body = _arrow(bracket_body, T.StringType(), pa.string())
_py_objects = _arrow(
    lambda t: [json.dumps(o, sort_keys=True) for o in objects_in(t)], _STRINGS, pa.list_(pa.string())
)


@udtf(returnType="ord bigint, object string", useArrow=True)
class JsonObjects:
    """Table function: one row per JSON object embedded in a text."""

    def eval(self, text: str):
        for i, o in enumerate(objects_in(text or ""), 1):
            yield i, json.dumps(o, sort_keys=True)


def register(spark) -> None:
    """Make ``json_objects(text)`` available to SQL, for use with LATERAL."""
    spark.udtf.register("json_objects", JsonObjects)


# --- column expressions ------------------------------------------------------------------

_WS = r"[ \t\n\r]*+"
_STR = r'"[ !#-\[\]-~]*+"'
_INT = r"(?:0|-?[1-9]\d*+)"
_MEMBER = rf"{_STR}{_WS}:{_WS}(?:{_STR}|{_INT})"
_CLEAN_CALL = (
    rf'^{_WS}\{{{_WS}"name"{_WS}:{_WS}{_STR}{_WS},{_WS}"arguments"{_WS}:{_WS}'
    rf"\{{{_WS}(?:{_MEMBER}(?:{_WS},{_WS}{_MEMBER})*+)?{_WS}\}}{_WS}\}}{_WS}\z"
)
_CLEAN_NAME = rf'^{_WS}\{{{_WS}"name"{_WS}:{_WS}"([^"]*)"'
_CLEAN_MEMBER = rf'"([^"]*)"{_WS}:{_WS}({_STR}|{_INT})'
_CLEAN_ROUTE = rf'^{_WS}\{{{_WS}"selected_tools"{_WS}:{_WS}\[(?:{_STR}(?:, ?{_STR})*+)?\]{_WS}\}}{_WS}\z'
_CLEAN_PICK = rf'^{_WS}\{{{_WS}"best_thought_id"{_WS}:{_WS}{_STR}(?:, ?"reason"{_WS}:{_WS}{_STR})?{_WS}\}}{_WS}\z'
# A text with one object that lists thoughts, each with its members in this order, an id and an answer that are not blank, and no escapes.
_SAID = r'"(?= *+[!#-\[\]-~])[ !#-\[\]-~]*+"'
_THOUGHT = (
    rf'\{{{_WS}"id"{_WS}:{_WS}{_SAID}{_WS},{_WS}"reasoning"{_WS}:{_WS}{_STR}{_WS},{_WS}'
    rf'(?:"action"{_WS}:{_WS}\{{{_WS}"name"{_WS}:{_WS}{_STR}{_WS},{_WS}"arguments"{_WS}:{_WS}'
    rf'\{{{_WS}(?:{_MEMBER}(?:{_WS},{_WS}{_MEMBER})*+)?{_WS}\}}{_WS}\}}|"final_answer"{_WS}:{_WS}{_SAID}){_WS}\}}'
)
_CLEAN_THOUGHTS = (
    rf'^[^{{]*+\{{{_WS}"thoughts"{_WS}:{_WS}\[{_WS}{_THOUGHT}(?:{_WS},{_WS}{_THOUGHT})*+{_WS}\]{_WS}\}}[^{{]*+\z'
)
_CLEAN_VERDICT = (
    rf'^{_WS}\{{{_WS}"success"{_WS}:{_WS}(?:true|false|{_STR})'
    rf'(?:, ?"reason"{_WS}:{_WS}{_STR})?{_WS}\}}{_WS}\z'
)
_CLEAN_LIST = r"""^\[(?:'[^'"\\\n]*+'(?:, '[^'"\\\n]*+')*+)?\]$"""


def _none(json_type: str) -> Column:
    return F.array().cast(json_type)


def _clean_call_parts(block: Column):
    inside = F.regexp_extract(block, rf'(?s)"arguments"{_WS}:(.*)', 1)
    names = F.regexp_extract_all(inside, F.lit(_CLEAN_MEMBER), 1)
    raw = F.regexp_extract_all(inside, F.lit(_CLEAN_MEMBER), 2)
    return names, raw


def _clean_call(block: Column) -> Column:
    names, raw = _clean_call_parts(block)
    pairs = F.arrays_zip(names.alias("name"), raw.alias("value"))
    args = F.transform(
        pairs, lambda p: F.struct(p["name"].alias("name"), F.regexp_replace(p["value"], '^"|"$', "").alias("value"))
    )
    shown = F.transform(F.sort_array(pairs), lambda p: F.concat(F.lit('"'), p["name"], F.lit('": '), p["value"]))
    return F.struct(
        F.regexp_extract(block, _CLEAN_NAME, 1).alias("name"),
        args.alias("args"),
        F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}")).alias("args_json"),
    ).cast(CALL)


def _is_clean_call(block: Column) -> Column:
    names, _ = _clean_call_parts(block)
    return block.rlike(_CLEAN_CALL) & (F.size(names) == F.size(F.array_distinct(names)))


def tool_calls(text: Column) -> Column:
    """Tool calls of one assistant turn as ``array<struct<name, args, args_json>>``."""
    blocks = F.regexp_extract_all(text, F.lit(_BLOCK), 1)
    clean = (F.size(blocks) > 0) & F.forall(blocks, _is_clean_call)
    bare = ~F.contains(text, F.lit("{"))
    hard = _py_calls(F.when(~clean & ~bare, text))
    return (
        F.when(clean, F.transform(blocks, _clean_call))
        .when(bare | text.isNull(), F.array().cast(T.ArrayType(CALL)))
        .otherwise(hard)
    )


def json_objects(text: Column) -> Column:
    """JSON texts (sorted keys) of all objects embedded in the text."""
    bare = ~F.contains(text, F.lit("{"))
    return F.when(bare | text.isNull(), _none("array<string>")).otherwise(_py_objects(F.when(~bare, text)))


def clean_thoughts(text: Column) -> Column:
    """Whether a text lists its thoughts in the plain form that needs no decoder."""
    listed = F.regexp_extract_all(text, F.lit(_THOUGHT), 0)

    def once(t: Column) -> Column:
        names, _ = _clean_call_parts(t)
        return F.size(names) == F.size(F.array_distinct(names))

    return F.coalesce(F.when(text.rlike(_CLEAN_THOUGHTS), F.forall(listed, once)), F.lit(False))


def _clean_thought(t: Column, strip) -> Column:
    said = lambda name: F.regexp_extract(t, rf'"{name}"{_WS}:{_WS}"([^"]*)"', 1)
    names, raw = _clean_call_parts(t)
    shown = F.transform(F.sort_array(F.arrays_zip(names.alias("name"), raw.alias("value"))), lambda p: F.concat(F.lit('"'), p["name"], F.lit('": '), p["value"]))
    call = t.rlike(rf'"action"{_WS}:{_WS}\{{')
    return F.struct(
        strip(said("id")).alias("id"), strip(said("reasoning")).alias("reasoning"), F.when(call, "tool_call").otherwise("final_answer").alias("kind"),
        F.when(call, said("name")).alias("tool_name"), F.when(call, F.concat(F.lit("{"), F.array_join(shown, ", "), F.lit("}"))).alias("tool_args"),
        F.when(~call, strip(said("final_answer"))).alias("final_answer"),
    ).cast(schemas.CANDIDATE)


def thoughts(text: Column, strip) -> Column:
    """Thought candidates; a text without any becomes one final answer, a blank text none."""
    bare, clean = ~F.contains(text, F.lit("{")), clean_thoughts(text)
    native = F.transform(F.regexp_extract_all(text, F.lit(_THOUGHT), 0), lambda t: _clean_thought(t, strip))
    hard = F.coalesce(_py_thoughts(F.when(~clean & ~bare, text)), F.array().cast(T.ArrayType(schemas.CANDIDATE)))
    rows = F.when(clean, native).otherwise(hard)
    whole = F.struct(
        F.lit("T1").alias("id"), F.lit("").alias("reasoning"), F.lit("final_answer").alias("kind"),
        F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_args"),
        strip(text).alias("final_answer"),
    ).cast(schemas.CANDIDATE)
    return F.when(F.size(rows) > 0, rows).when(strip(text) != "", F.array(whole)).otherwise(rows)


def selected_tools(text: Column, available: Column) -> Column:
    """Available tool names chosen by a routing text, each once, in the order named."""

    def usable(names: Column) -> Column:
        return F.array_distinct(F.filter(names, lambda n: F.array_contains(available, n)))

    clean = text.rlike(_CLEAN_ROUTE)
    bare = ~F.contains(text, F.lit("{"))
    listed = F.regexp_extract_all(F.regexp_extract(text, r"(?s)\[(.*)\]", 1), F.lit('"([^"]*)"'), 1)
    lists = F.when(clean, F.array(listed)).when(bare, F.array().cast("array<array<string>>")).otherwise(
        _py_name_lists(F.when(~clean & ~bare, text))
    )
    chosen = F.filter(F.transform(lists, usable), lambda n: F.size(n) > 0)
    mentioned = F.filter(available, lambda n: F.contains(text, n))
    return F.coalesce(F.try_element_at(chosen, F.lit(1)), F.array_distinct(mentioned), _none("array<string>"))


def picked_ids(text: Column) -> Column:
    """Candidate ids named by a judge's objects, in order."""
    clean = text.rlike(_CLEAN_PICK)
    bare = ~F.contains(text, F.lit("{"))
    one = F.array(F.regexp_extract(text, rf'"best_thought_id"{_WS}:{_WS}"([^"]*)"', 1))
    return F.when(clean, one).when(bare | text.isNull(), _none("array<string>")).otherwise(
        _py_ids(F.when(~clean & ~bare, text))
    )


def judge_verdict(text: Column, strip) -> Column:
    """``struct<success, reason>`` of an evaluator's text."""
    clean = text.rlike(_CLEAN_VERDICT)
    bare = ~F.contains(text, F.lit("{"))
    said = F.regexp_extract(text, rf'"success"{_WS}:{_WS}(true|false|{_STR})', 1)
    spoken = F.lower(F.trim(F.regexp_replace(said, '^"|"$', "")))
    yes = F.when(said.startswith('"'), spoken.isin(*C.SUCCESS_WORDS)).otherwise(said == "true")
    why = strip(F.regexp_extract(text, rf'"reason"{_WS}:{_WS}"([^"]*)"', 1))
    low = F.lower(text)
    prose = low.rlike(r"(?U)\bsuccess(?:ful|fully|ed)?\b") & ~low.rlike(r"(?U)\b(?:not|no|failed|failure)\b")
    native = F.struct(yes.alias("success"), why.alias("reason")).cast(VERDICT)
    fallback = F.struct(prose.alias("success"), strip(text).alias("reason")).cast(VERDICT)
    hard = _py_verdict(F.when(~clean & ~bare, text))
    return F.when(clean, native).when(hard.isNotNull(), hard).otherwise(fallback)


def string_list(text: Column) -> Column:
    """A Python list literal as an array of strings; null if it is none."""
    clean = text.rlike(_CLEAN_LIST)
    items = F.regexp_extract_all(text, F.lit("'([^']*)'"), 1)
    return F.when(clean, items).otherwise(_py_list(F.when(~clean, text)))


def closed_body(text: Column) -> Column:
    """Text up to the bracket that closes an already opened one, else null."""
    first = F.substring_index(text, "]", 1)
    flat = F.contains(text, F.lit("]")) & ~F.contains(first, F.lit("["))
    return F.when(flat, first).otherwise(_py_body(F.when(~flat, text)))
