"""Explicit schemas of every table; nothing is inferred from data."""

from pyspark.sql import types as T

S = T.StringType()
L = T.LongType()
B = T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


ARG = _struct(name=S, value=S)
ARGS = T.ArrayType(ARG)
CALL = _struct(name=S, args=ARGS)
CALLS = T.ArrayType(CALL)
PARAM = _struct(name=S, type=S, description=S)

QUERIES_CSV = _struct(query=S, answer=S, domains=S)
QUERIES = _struct(query_id=S, seq=L, query=S, answer=T.ArrayType(S), domains=T.ArrayType(S))
RESULTS_CSV = _struct(query=S, function_calls=S, full_response=S, error=S)
RESULTS = _struct(
    run_id=S, domain=S, config=S, query_id=L, query=S,
    function_calls=T.ArrayType(S), full_response=S, error=S,
)
GOLD = _struct(query_id=L, query=S, answer=T.ArrayType(S))
TOOLS = _struct(
    tool=S, domain=S, description=S, params=T.ArrayType(PARAM), side_effect=B,
    op_kind=S, target=S, key_arg=S, pos=L,
)
BASE_STATE = _struct(target=S, entity_id=S, attrs=T.MapType(S, S))
MEMORY_CALL = _struct(name=S, args=ARGS, observation=S)
EPISODES = _struct(
    run_id=S, seq=L, query=S, actions=T.ArrayType(MEMORY_CALL), final_answer=S, verified=B,
)
EXAMPLES = _struct(
    domains=T.ArrayType(S), pos=L, query=S, actions=T.ArrayType(MEMORY_CALL), final_answer=S,
)
TRIALS = _struct(
    query_id=S, trial=L, judge_text=S, reflection=S, calls=T.ArrayType(S), error=S,
)
CANDIDATE = _struct(
    id=S, reasoning=S, kind=S, tool_name=S, tool_args=S, final_answer=S,
)
