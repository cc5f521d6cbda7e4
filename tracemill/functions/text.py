"""Column expressions on the text forms of queries, tools and actions. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import constants as C
from tracemill import schemas

# What Python counts as white space, for Java regular expressions in (?U) mode.
SPACE = r"[\s\x1c-\x1f]"

_STRINGS = "array<string>"
_LITERAL = r'[^"\\\n]*+(?:\\.[^"\\\n]*+)*+'
_WELL_FORMED = (
    r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\.func\("
    rf'(?:[A-Za-z_]\w*="{_LITERAL}"(?:, [A-Za-z_]\w*="{_LITERAL}")*+)?\)$'
)
_ARGUMENT = rf'([A-Za-z_]\w*+)="({_LITERAL})"'


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def stripped(c: Column) -> Column:
    """Text without white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def domain_name(c: Column) -> Column:
    """A domain under its full name."""
    out = c
    for short, full in C.DOMAIN_ALIASES.items():
        out = F.when(c == short, F.lit(full)).otherwise(out)
    return out


def domain_list(c: Column) -> Column:
    """``"['a', 'crm']"`` as an array of full domain names; null gives an empty array."""
    bare = F.regexp_replace(c, r"^[\[\]]+|[\[\]]+$", "")
    parts = F.split(F.replace(bare, F.lit("'"), F.lit("")), ", ")
    names = F.transform(F.filter(parts, lambda x: x != ""), domain_name)
    return F.coalesce(names, F.array().cast(_STRINGS))


def internal_tool_id(c: Column) -> Column:
    """``a__b__c`` as ``a.b__c``: only the first double underscore becomes a dot."""
    return F.regexp_replace(c, r"(?s)^(.*?)__", "$1.")


def scalar_text(json_text: Column) -> Column:
    """A JSON scalar's text as the agents' runtime prints it (True, False, None)."""
    return (
        F.when(json_text == "true", "True").when(json_text == "false", "False")
        .when(json_text.isNull() | (json_text == "null"), "None").otherwise(json_text)
    )


def render_action(name: Column, args: Column) -> Column:
    """``domain.tool.func(k="v", ..)`` from a tool name and its ordered arguments."""
    shown = F.transform(
        args, lambda a: F.concat(a["name"], F.lit('="'), F.coalesce(a["value"], F.lit("None")), F.lit('"'))
    )
    return F.concat(internal_tool_id(name), F.lit(".func("), F.array_join(shown, ", "), F.lit(")"))


def function_name(action: Column) -> Column:
    """First two dotted parts of what stands before the first bracket."""
    return F.substring_index(F.substring_index(action, "(", 1), ".", 2)


def escape_newlines(actions: Column) -> Column:
    return F.transform(actions, lambda a: F.replace(a, F.lit("\n"), F.lit("\\n")))


def actions_or_empty(actions: Column) -> Column:
    return F.coalesce(actions, F.array().cast(_STRINGS))


def action_args(action: Column) -> Column:
    """Ordered arguments of an action; null if its text could not be called: the quoting
    does not hold, or an argument repeats.

    Costly to evaluate, so callers project it once and do not filter on it.
    """
    # Behind the bracket, arguments follow each other: a match ends where the next separator stands.
    found = lambda group: F.regexp_extract_all(F.substr(action, F.instr(action, "(") + 1), F.lit(_ARGUMENT), group)

    def unless_repeated(names: Column) -> Column:
        paired = F.zip_with(names, found(2), lambda n, v: F.struct(n.alias("name"), v.alias("value")))
        return F.when(F.size(F.array_distinct(names)) == F.size(names), paired)

    return let(F.when(action.rlike(_WELL_FORMED), found(1)), unless_repeated).cast(schemas.ARGS)


def slug(c: Column) -> Column:
    """Lower case, every run of other characters as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def config_label(selection: Column, baseline: Column) -> Column:
    return F.when(baseline == "tool_calling", selection).otherwise(F.concat_ws("_", selection, baseline))


def fold_case(name: Column, value: Column) -> Column:
    """An attribute value in lower case, unless the attribute keeps its case."""
    return F.when(name.isin(*C.CASE_KEPT_ATTRIBUTES), value).otherwise(F.lower(value))


def fold_state(attrs: Column) -> Column:
    """``fold_case`` over a whole attribute map."""
    return F.transform_values(attrs, fold_case)


def key_of(names: Column) -> Column:
    """An order-free key of a set of names."""
    return F.array_join(F.sort_array(F.array_distinct(names)), "|")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
