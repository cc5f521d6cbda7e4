"""The registered queries stated in SQL for DuckDB, over the same tables.

The SQL works on exploded rows and plain aggregates throughout, so it checks the
array and replay expressions of the library by another route.
"""

from __future__ import annotations

from tracemill.operators import datasets as D
from tracemill.plans.queries import HEAD

LIMIT = "Agent stopped due to iteration limit."

# --- shared parts -------------------------------------------------------------------------

DOM = (
    "CASE {q} % 5 WHEN 0 THEN 'calendar' WHEN 1 THEN 'email' WHEN 2 THEN 'analytics' "
    "WHEN 3 THEN 'project_management' ELSE 'customer_relationship_manager' END"
)
CFG = "CASE {c} WHEN 0 THEN 'all' WHEN 1 THEN 'domains' WHEN 2 THEN 'domains_react' ELSE 'domains_memory' END"
VERB = (
    "CASE {v} WHEN 0 THEN 'create_item' WHEN 1 THEN 'update_item' WHEN 2 THEN 'delete_item' "
    "WHEN 3 THEN 'search_items' ELSE 'get_item_by_id' END"
)

EV = f"""
ev AS MATERIALIZED (
  SELECT event_id, event_id // 8 AS query_id, event_id % 8 + 1 AS step,
         CASE event_type WHEN 'signup' THEN 'create_item' WHEN 'purchase' THEN 'update_item'
              WHEN 'error' THEN 'delete_item' WHEN 'click' THEN 'search_items' ELSE 'get_item_by_id' END AS verb,
         regexp_extract(props, '[0-9]+') AS k,
         event_type, props,
         {DOM.format(q='(event_id // 8)')} AS dom
  FROM events),
evw AS (SELECT *, verb IN ('create_item', 'update_item', 'delete_item') AS w, dom || '__' || verb AS tool FROM ev),
qs AS (SELECT DISTINCT query_id, dom FROM ev)"""

# Gold (c = -1) and predicted (c = 0..3) actions with their parts; step is the place in the trace.
ACTS = f"""{EV},
cs AS (SELECT unnest([-1, 0, 1, 2, 3])::BIGINT AS c),
parts AS (
  SELECT c, query_id, dom, verb, k, w, event_id,
         row_number() OVER (PARTITION BY c, query_id ORDER BY step) AS step,
         CASE WHEN query_id % 3 <> 0 THEN '2023-12-01'
              WHEN c >= 0 AND query_id % 7 = c THEN '2023-11-30' ELSE '2023-11-29' END AS d,
         CASE WHEN query_id % 6 <> 1 THEN NULL
              WHEN c >= 0 AND query_id % 5 = c THEN
                CASE query_id % 4 WHEN 0 THEN '09:00:00' WHEN 1 THEN '11:00:00' WHEN 2 THEN '15:30:00'
                     ELSE '10:00:00' END
              ELSE '13:00:00' END AS tm,
         CASE WHEN c >= 0 AND event_id % 29 = c THEN 'item ' || k || '@example.com'
              WHEN c >= 0 AND event_id % 31 = c THEN 'item ' || k || '@atlas.com'
              WHEN c >= 0 AND event_id % 4 = 0
                THEN 'ITEM ' || k || CASE WHEN event_id % 37 = 0 THEN '\\nX' ELSE '' END
              ELSE 'item ' || k || CASE WHEN event_id % 37 = 0 THEN '\\nx' ELSE '' END END AS title_up,
         CASE WHEN event_id % 2 = 0 AND NOT (c >= 0 AND event_id % 4 = 0) THEN 'active' ELSE 'ACTIVE' END AS status,
         CASE WHEN event_id % 5 = 0 THEN 'CUSTOMER#' || lpad(k, 9, '0') END AS name
  FROM evw CROSS JOIN cs
  WHERE CASE WHEN c = -1 THEN w AND event_id % 17 <> 0 AND query_id % 37 <> 0
             ELSE (c = 0 OR event_id % (11 + c) <> 0) AND NOT (c = 2 AND query_id % 41 = 0) END),
parts2 AS (
  SELECT *, title_up AS title,
         CASE WHEN tm IS NULL THEN '' ELSE ', time="' || tm || '"' END AS tail FROM parts),
acts AS MATERIALIZED (
  SELECT *, dom || '.' || verb || '.func(' ||
    CASE verb
      WHEN 'create_item' THEN 'title="' || title || '", date="' || d || '"' || tail
      WHEN 'update_item' THEN 'k="' || k || '", date="' || d || '", status="' || status || '"' ||
           CASE WHEN name IS NULL THEN '' ELSE ', name="' || name || '"' END || tail
      WHEN 'delete_item' THEN 'k="' || k || '", date="' || d || '"' || tail
      ELSE 'k="' || k || '"' END || ')' AS action
  FROM parts2),
runs AS (
  SELECT c, {CFG.format(c='c')} AS run_id, {CFG.format(c='c')} AS config, dom AS domain, query_id,
         CASE WHEN (query_id + c) % 23 = 0 THEN '{LIMIT}' WHEN (query_id + c) % 47 = 0 THEN 'out of memory'
              ELSE '' END AS error
  FROM qs CROSS JOIN cs WHERE c >= 0),
pred AS MATERIALIZED (SELECT run_id, config, domain, r.query_id, r.error, a.* EXCLUDE (query_id) FROM runs r
         JOIN acts a USING (c, query_id)),
gold AS MATERIALIZED (SELECT * FROM acts WHERE c = -1)"""

# Raw (unescaped) action text: the escape sequence stands for a line break there.
RAW = "replace(action, '\\n', chr(10))"

EXACT = """
diff AS (
  SELECT run_id, query_id, action, sum(n) AS d FROM (
    SELECT run_id, query_id, lower(action) AS action, 1 AS n FROM pred WHERE w
    UNION ALL
    SELECT run_id, query_id, lower(action), -1 FROM gold JOIN runs USING (query_id))
  GROUP BY ALL HAVING sum(n) <> 0),
differing AS (SELECT DISTINCT run_id, query_id, true AS differs FROM diff),
exact AS (
  SELECT r.*, differs IS NULL AS exact_match FROM runs r LEFT JOIN differing USING (run_id, query_id))"""

FLAGS = """
shift AS (
  SELECT r.run_id, r.query_id, count(g.step) AS n_gold,
    count(CASE WHEN contains(g.action, '2023-11-29') AND EXISTS (
      SELECT 1 FROM pred p WHERE p.run_id = r.run_id AND p.query_id = r.query_id
        AND p.action = replace(g.action, '2023-11-29', '2023-11-30')) THEN 1 END) AS n_date,
    count(CASE WHEN contains(g.action, '13:00:00') AND EXISTS (
      SELECT 1 FROM pred p WHERE p.run_id = r.run_id AND p.query_id = r.query_id
        AND p.action IN (replace(g.action, '13:00:00', '09:00:00'), replace(g.action, '13:00:00', '11:00:00'),
                         replace(g.action, '13:00:00', '15:00:00'), replace(g.action, '13:00:00', '15:30:00')))
      THEN 1 END) AS n_time
  FROM runs r LEFT JOIN gold g USING (query_id) GROUP BY ALL),
seen AS (
  SELECT r.run_id, r.query_id, count(p.step) = 0 AS no_actions, count(p.step) AS n_pred,
         coalesce(bool_or(contains(p.action, '@example')), false)
           AND NOT coalesce(bool_or(contains(p.action, '@atlas')), false) AS wrong_email
  FROM runs r LEFT JOIN pred p USING (run_id, query_id) GROUP BY ALL),
causes AS (
  SELECT run_id, query_id, no_actions, wrong_email, n_pred, n_gold,
         n_gold > 0 AND n_date = n_gold AS end_date_minor_error,
         n_gold > 0 AND n_time = n_gold AS meeting_start_time_error
  FROM seen JOIN shift USING (run_id, query_id))"""


def _replay(delete_in_email: bool = False) -> str:
    """Cells changed by each trace; optionally with searching in email made a deleting tool."""
    kill = "verb = 'delete_item'"
    if delete_in_email:
        kill = "(verb = 'delete_item' OR (verb = 'search_items' AND dom = 'email'))"
    return f"""
base AS (SELECT c_custkey::VARCHAR AS k, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0),
died AS (SELECT c, query_id, k, min(step) AS at FROM acts JOIN base USING (k) WHERE {kill} GROUP BY ALL),
upd AS (
  SELECT a.c, a.query_id, a.dom, a.k, a.step, x.attr, x.value FROM acts a JOIN base USING (k)
  LEFT JOIN died USING (c, query_id, k),
  LATERAL (SELECT unnest(['date', 'status', 'name', 'time']) AS attr,
                  unnest([a.d, a.status, a.name, a.tm]) AS value) x
  WHERE a.verb = 'update_item' AND died.at IS NULL AND x.value IS NOT NULL),
last AS (
  SELECT c, query_id, dom, k, attr, arg_max(value, step) AS value FROM upd GROUP BY ALL),
cell AS (
  SELECT l.c, l.query_id, l.dom, l.k, l.attr, l.value,
         CASE attr WHEN 'date' THEN '2023-12-01' WHEN 'status' THEN c_mktsegment WHEN 'name' THEN c_name END AS old
  FROM last l JOIN base USING (k)),
adds AS (
  SELECT a.c, a.query_id, a.dom, row_number() OVER (PARTITION BY a.c, a.query_id ORDER BY a.step) AS ord,
         a.title, a.d, a.tm
  FROM acts a WHERE a.verb = 'create_item'),
delta AS (
  SELECT c, query_id, dom AS target, 'update' AS change, k AS row_key, attr,
         CASE WHEN attr = 'status' THEN value ELSE lower(value) END AS value
  FROM cell WHERE CASE WHEN attr = 'status' THEN value ELSE lower(value) END
        IS DISTINCT FROM CASE WHEN attr = 'status' THEN old ELSE lower(old) END
  UNION ALL
  SELECT d.c, d.query_id, qs.dom, 'delete', k, '', '' FROM died d JOIN qs USING (query_id)
  UNION ALL
  SELECT c, query_id, dom, 'insert', ord::VARCHAR, x.attr, lower(x.value)
  FROM adds a, LATERAL (SELECT unnest(['title', 'date', 'time']) AS attr,
                               unnest([a.title, a.d, a.tm]) AS value) x
  WHERE x.value IS NOT NULL),
moved AS (
  SELECT DISTINCT c, query_id FROM cell WHERE value IS DISTINCT FROM old
  UNION SELECT c, query_id FROM died UNION SELECT c, query_id FROM adds),
outcome AS (
  SELECT c, query_id, count(*) AS n_cells,
         string_agg(target || '|' || change || '|' || row_key || '|' || attr || '|' || value, ';'
                    ORDER BY target, change, row_key, attr) AS text
  FROM delta GROUP BY ALL),
judged AS (
  SELECT r.*, coalesce(p.n_cells, 0) AS n_cells, coalesce(g.n_cells, 0) AS n_gold_cells,
         coalesce(p.text, '') = coalesce(g.text, '') AS same_outcome,
         EXISTS (SELECT 1 FROM moved m WHERE m.c = r.c AND m.query_id = r.query_id) AS changed
  FROM runs r LEFT JOIN outcome p ON p.c = r.c AND p.query_id = r.query_id
  LEFT JOIN outcome g ON g.c = -1 AND g.query_id = r.query_id)"""


SCORED = f"""{ACTS},{EXACT},{FLAGS},{_replay()},
scored AS (
  SELECT j.run_id, j.query_id, j.domain, j.config, j.error, e.exact_match,
         j.error = '' AND j.same_outcome AS correct,
         j.changed AND NOT j.same_outcome AS unwanted_side_effects,
         k.no_actions,
         k.wrong_email AND NOT (j.error = '' AND j.same_outcome) AS wrong_email,
         k.end_date_minor_error AND NOT (j.error = '' AND j.same_outcome) AS end_date_minor_error,
         k.meeting_start_time_error AND NOT (j.error = '' AND j.same_outcome) AS meeting_start_time_error,
         k.n_pred, k.n_gold, j.same_outcome
  FROM judged j JOIN exact e USING (run_id, query_id) JOIN causes k USING (run_id, query_id)),
classed AS (
  SELECT *, NOT correct AND NOT (no_actions OR wrong_email OR end_date_minor_error OR meeting_start_time_error)
    AS residual FROM scored)"""

MATCHED = f"""{ACTS},{EXACT},
acc AS (
  SELECT domain, config, count(*) AS n, count_if(exact_match)::BIGINT AS n_correct,
         avg(exact_match::INT) * 100 AS accuracy
  FROM exact GROUP BY ALL)"""

SCORED_COLUMNS = (
    "run_id, query_id, domain, config, exact_match, correct, unwanted_side_effects, no_actions, wrong_email, "
    "end_date_minor_error, meeting_start_time_error"
)

# Tools of the catalogue, and the tool set of each query.
TOOLS = """
verbs(verb, kind, vpos) AS (VALUES ('create_item', 'insert', 0), ('update_item', 'update', 1),
  ('delete_item', 'delete', 2), ('search_items', 'read', 3), ('get_item_by_id', 'read', 4)),
doms(dom, short, rank, dpos) AS (VALUES ('calendar', 'calendar', 1, 0), ('email', 'email', 0, 1),
  ('analytics', 'analytics', 2, 2), ('project_management', 'project_management', 3, 3),
  ('customer_relationship_manager', 'crm', 4, 4)),
tools AS (
  SELECT dom || '__' || verb AS tool, dom AS domain, kind <> 'read' AS side_effect, kind AS op_kind,
         rank * 10 + vpos AS ord,
         '- ' || dom || '__' || verb || ': ' || verb || ' in ' || dom || chr(10) ||
         '  Arguments: k (string): item number; date (any): day' AS line
  FROM doms, verbs
  UNION ALL SELECT 'company_directory__find_email', 'company_directory', false, 'read', 99,
    '- company_directory__find_email: find an address' || chr(10) || '  Arguments: No arguments.'),
qdom AS (
  SELECT query_id, CASE WHEN query_id % 31 = 0 THEN '' WHEN query_id % 43 = 0 THEN ''
    WHEN query_id % 7 = 0 THEN 'customer_relationship_manager,email' ELSE dom END AS domains FROM qs),
qtools AS (
  SELECT query_id, tool, ord, line FROM qdom JOIN tools
    ON domain = 'company_directory' OR list_contains(string_split(domains, ','), domain))"""

MEM = f"""
mem AS (
  SELECT conv_id % 3 AS run_id, conv_id * 1000000 + turn AS seq, text AS query,
         {VERB.format(v='((conv_id * 1000000 + turn) % 5)')} AS t1,
         {VERB.format(v='((conv_id * 1000000 + turn + 1) % 5)')} AS t2,
         (conv_id * 1000000 + turn) % 4 <> 0 AS stored
  FROM conversations WHERE role = 'user'),
eps AS (SELECT * FROM mem WHERE stored)"""


def _similar(k: int, mem: str = MEM) -> str:
    return f"""{mem},
tok AS (
  SELECT run_id, seq, stored, w AS term, count(*) AS tf FROM (
    SELECT run_id, seq, stored, unnest(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM mem)
  WHERE w <> '' GROUP BY ALL),
dfs AS (SELECT run_id, term, count(*) AS df FROM tok WHERE stored GROUP BY ALL),
size AS (SELECT run_id, count(*) AS n FROM eps GROUP BY ALL),
wts AS (
  SELECT t.*, tf * (ln((1 + coalesce(n, 0)) / (1 + coalesce(df, 0))) + 1) AS w FROM tok t
  LEFT JOIN dfs USING (run_id, term) LEFT JOIN size USING (run_id)),
unit AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY run_id, seq)) AS u FROM wts),
pairs AS (
  SELECT q.run_id, q.seq, e.seq AS e_seq, round(sum(q.u * e.u), 6) AS score
  FROM unit q JOIN unit e ON e.run_id = q.run_id AND e.term = q.term AND e.stored AND e.seq < q.seq
  GROUP BY ALL),
ranked AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.run_id, p.seq ORDER BY score DESC, e_seq) AS rank
  FROM pairs p JOIN mem q ON q.run_id = p.run_id AND q.seq = p.seq JOIN mem e ON e.run_id = p.run_id AND e.seq = e_seq
  WHERE score > 0 AND e.t1 <> q.t1 AND e.t2 <> q.t1),
alike AS (SELECT * FROM ranked WHERE rank <= {k})"""


# Three batches: in each, what earlier ones stored and the queries of its own.
BATCHED = f"""{MEM.replace("mem AS", "every AS", 1).split(",\neps AS")[0]},
mem AS (
  SELECT run_id * 3 + b AS run_id, seq, query, t1, t2, stored AND seq % 3 < b AS stored, seq % 3 = b AS asked
  FROM every, (VALUES (0), (1), (2)) v(b) WHERE seq % 3 <= b),
eps AS (SELECT * FROM mem WHERE stored)"""


TRIALS = f"""
tr AS (
  SELECT conv_id AS query_id, turn + 1 AS trial, turn, (conv_id + turn) % 7 AS j, (conv_id + turn) % 4 AS v,
         CASE WHEN turn % 5 = 0 THEN '' ELSE trim(text, ' ' || chr(9) || chr(10) || chr(13)) END
           AS reflection,
         turn % 3 <> 1 AS calls, {CFG.format(c='(conv_id % 4)')} AS config
  FROM conversations WHERE role = 'assistant'),
dec AS (
  SELECT *, j IN (0, 2, 6) AS success,
         CASE j WHEN 0 THEN 'ok' WHEN 1 THEN 'missing step' WHEN 2 THEN '3' WHEN 3 THEN 'It succeeded.'
              WHEN 4 THEN 'Not a success' WHEN 5 THEN '' ELSE 'It was successful.' END AS reason,
         CASE v WHEN 0 THEN true WHEN 2 THEN NULL ELSE false END AS verdict
  FROM tr)"""


def _buffer(size: int, sep: str, prefix: str = "") -> str:
    return f"""
notes AS (SELECT query_id, trial, reflection,
                 row_number() OVER (PARTITION BY query_id ORDER BY trial) AS no FROM tr WHERE reflection <> ''),
cnt AS (SELECT t.query_id, t.trial, count(n.no) AS seen FROM tr t
        LEFT JOIN notes n ON n.query_id = t.query_id AND n.trial < t.trial GROUP BY ALL),
buf AS (
  SELECT c.query_id, c.trial, string_agg('{prefix}' || n.reflection, {sep} ORDER BY n.no) AS buffer
  FROM cnt c LEFT JOIN notes n ON n.query_id = c.query_id AND n.no > c.seen - {size} AND n.no <= c.seen
  GROUP BY ALL)"""


def _quality(col: str) -> str:
    return f"""WITH {TRIALS},
    x AS (SELECT config, {col} AS v, coalesce({col}, false) AS y, quality = 1 AS t
          FROM dec JOIN labels ON doc_id = query_id),
    n AS (SELECT config, count_if(y AND t)::BIGINT AS tp, count_if(y AND NOT t)::BIGINT AS fp,
                 count_if(NOT y AND t)::BIGINT AS fn, count_if(NOT y AND NOT t)::BIGINT AS tn,
                 count_if(v IS NULL)::BIGINT AS n_unreadable FROM x GROUP BY ALL)
    SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision,
           round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall FROM n"""


CALLS = f"""{EV},
callrows AS (
  SELECT query_id, step, tool, event_id, k, query_id % 5 AS shape, event_id % 19 = 0 AS broken FROM evw),
good AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step) AS n FROM callrows
  WHERE CASE WHEN shape = 3 THEN true ELSE NOT broken END),
calls AS (
  SELECT query_id, n AS step, tool, dom_tool || CASE
      WHEN shape = 1 THEN 'urgent="True", until="None", k="1.0")'
      WHEN shape = 4 THEN 'k="' || k || '")'
      ELSE 'k="' || k || '", note="n' || event_id || '")' END AS action,
    CASE WHEN shape = 1 THEN '{{"k": 1.0, "until": null, "urgent": true}}'
         WHEN shape = 4 THEN '{{"k": ' || k || '}}'
         ELSE '{{"k": ' || k || ', "note": "n' || event_id || '"}}' END AS args_json
  FROM (SELECT *, replace(tool, '__', '.') || '.func(' AS dom_tool FROM good) WHERE shape <> 3 OR n = 1)"""

ROUTES = f"""{EV},{TOOLS},
named AS (
  SELECT query_id, tool, min(step) AS step FROM evw
  WHERE query_id % 4 IN (0, 1) OR (query_id % 4 = 2 AND step = 1) GROUP BY ALL),
usable AS (SELECT n.* FROM named n JOIN qtools t USING (query_id, tool)),
firsttool AS (SELECT query_id, tool FROM evw WHERE step = 1),
chosen AS (
  SELECT query_id, string_agg(tool, ',' ORDER BY step) AS selected, list(tool) AS tl FROM usable GROUP BY ALL),
everything AS (SELECT query_id, string_agg(tool, ',' ORDER BY ord) AS selected, list(tool) AS tl
               FROM qtools GROUP BY ALL),
routed AS (
  SELECT a.query_id, c.query_id IS NOT NULL AS routed, coalesce(c.selected, a.selected) AS selected,
         coalesce(c.tl, a.tl) AS tl
  FROM everything a LEFT JOIN chosen c USING (query_id)),
wanted AS (SELECT DISTINCT query_id, tool FROM evw WHERE w),
rec AS (SELECT query_id, count(*) AS n, count_if(list_contains(tl, tool)) AS met
        FROM wanted JOIN routed USING (query_id) GROUP BY ALL)"""

THOUGHTS = f"""{EV},
cand AS (
  SELECT query_id, step AS ord, 'T' || step AS id, 'because ' || k AS reasoning,
         CASE WHEN w THEN 'tool_call' ELSE 'final_answer' END AS kind,
         CASE WHEN w THEN verb END AS tool_name, CASE WHEN w THEN '{{"k": ' || k || '}}' END AS tool_args,
         CASE WHEN NOT w THEN 'done' END AS final_answer
  FROM evw WHERE query_id % 4 = 0
  UNION ALL
  SELECT query_id, 1, 'T1', '', 'tool_call', verb, '{{}}', NULL FROM evw WHERE query_id % 4 = 1 AND step = 1
  UNION ALL
  SELECT query_id, 1, 'T1', '', 'final_answer', NULL, NULL, 'All is done.' FROM qs WHERE query_id % 4 = 2)"""

PLANS = f"""{EV},
raw AS (
  SELECT query_id, step * 2 - 1 AS part, 'E' || (step * 2 - 1) AS var, verb AS tool_name,
         '{{"k": "' || k || '"}}' AS args_template, 'find ' || event_id AS thought, false AS open FROM ev
  UNION ALL
  SELECT query_id, step * 2, 'E' || (step * 2), CASE WHEN event_id % 6 = 0 THEN 'list_all' ELSE 'open_one' END,
         CASE WHEN event_id % 6 = 0 THEN '{{"ids": ["#E1", "#E10"], "n": #E1}}' ELSE '{{"id": "#E10 #E1"}}' END,
         'use it', event_id % 6 = 1 FROM ev),
steps AS (SELECT * EXCLUDE (open), row_number() OVER (PARTITION BY query_id ORDER BY part) AS step
          FROM raw WHERE NOT open)"""

SECTIONS = f"""{EV},
heads AS (
  SELECT query_id, unnest(['trial', 'buffer', 'trial', 'buffer', 'plan']) AS phase,
         unnest(['', '(none)' || chr(10) || 'calling' || chr(10) || 'it', '',
                 '(none)' || chr(10) || 'calling' || chr(10) || 'it', '- look up first']) AS text,
         unnest([1, 2, 3, 4, 5]) AS pos FROM qs WHERE query_id % 2 = 0
  UNION ALL
  SELECT query_id, unnest(['response', 'plan']), unnest(['thinking', '- look up first']), unnest([1, 2])
  FROM qs WHERE query_id % 4 = 1
  UNION ALL
  SELECT query_id, unnest(['routing', 'selected_tools', 'plan']), unnest(['use both', 'a, b' || chr(10) || 'thinking', '- look up first']),
         unnest([1, 2, 3]) FROM qs WHERE query_id % 4 = 3),
secs AS (
  SELECT * FROM heads
  UNION ALL SELECT query_id, CASE WHEN w THEN 'observation' ELSE 'reflection' END,
    CASE WHEN w THEN 'ok ' ELSE 'note ' END || event_id, 10 + step FROM evw
  UNION ALL SELECT query_id, 'final_answer', 'done', 100 FROM qs),
sections AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS ord, phase, text FROM secs)"""

TRACES = f"""{EV},
acted AS (SELECT * FROM ev WHERE query_id % 19 <> 0),
traj AS (
  SELECT query_id, (SELECT string_agg('Step ' || a.step || ': ' || a.verb || '({{"k": "' || a.k || '"}})' || chr(10) ||
           '  Observation: seen ' || a.k, chr(10) ORDER BY a.step) FROM acted a WHERE a.query_id = qs.query_id) AS steps,
         CASE WHEN query_id % 3 <> 0 THEN 'Final answer: done' END AS fin
  FROM qs),
traj2 AS (
  SELECT query_id, CASE WHEN steps IS NULL AND fin IS NULL THEN '(no actions taken; no final answer)'
    ELSE concat_ws(chr(10), steps, fin) END AS trajectory, 'request ' || query_id AS q FROM traj)"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt(phase: str) -> str:
    return _quote(HEAD + D.TEMPLATES[phase])


ORACLE: dict[str, str] = {
    # expressions
    "domain_lists": f"""WITH {EV},{TOOLS}
        SELECT query_id, domains, CASE WHEN domains = '' THEN 0 ELSE length(domains) - length(replace(domains, ',', '')) + 1
        END::BIGINT AS n FROM qdom""",
    "tool_ids": f"WITH {EV} SELECT query_id, step, dom || '.' || verb || '__v2' AS tool FROM ev",
    "rendered_actions": f"""WITH {EV} SELECT event_id, 'email.' || verb || '.func(z="' || k || '", a="' ||
        CASE event_id % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'None' ELSE k END || '")' AS action FROM ev""",
    "action_functions": f"WITH {ACTS} SELECT dom || '.' || verb AS function, count(*) AS n FROM pred GROUP BY ALL",
    "escaped_actions": f"WITH {ACTS} SELECT run_id, query_id, step, action FROM pred WHERE contains(action, '\\n')",
    "label_slugs": """SELECT c_custkey, 'customer-' || regexp_extract(c_name, '[0-9]+') || '-' || lower(c_mktsegment) AS label
        FROM customer""",
    "config_labels": f"""WITH {ACTS} SELECT CASE WHEN query_id % 2 = 0 THEN config ELSE config || '_react' END AS label,
        count(*) AS n FROM runs GROUP BY ALL""",
    "folded_state": f"""WITH {EV},{TOOLS} SELECT dom AS target, c_custkey::VARCHAR AS entity_id, lower(c_name) AS name,
        c_mktsegment AS status FROM customer, doms WHERE c_custkey % 3 <> 0""",
    "harmonised_pairs": f"""WITH {ACTS},
        traces AS (SELECT c, query_id, list(action ORDER BY step) AS steps FROM acts GROUP BY c, query_id)
        SELECT run_id, r.query_id, error, coalesce(len(p.steps), 0) AS n_prediction, coalesce(len(g.steps), 0) AS n_gold,
               coalesce(array_to_string(g.steps, ' | '), '') AS ground_truth
        FROM runs r LEFT JOIN traces p ON p.c = r.c AND p.query_id = r.query_id
        LEFT JOIN traces g ON g.c = -1 AND g.query_id = r.query_id""",
    "action_steps": f"WITH {ACTS} SELECT run_id, query_id, step, {RAW} AS action FROM pred",
    # predicates
    "side_effect_actions": f"""WITH {ACTS} SELECT run_id, query_id, coalesce(string_agg(CASE WHEN w THEN action END, ' | '
        ORDER BY step), '') AS writes FROM runs LEFT JOIN acts USING (c, query_id) GROUP BY ALL""",
    "exact_matches": f"""WITH {ACTS},
        writes AS (SELECT c, query_id, list_sort(list(lower(action))) AS names FROM acts WHERE w GROUP BY c, query_id)
        SELECT run_id, r.query_id, coalesce(p.names, []) = coalesce(g.names, []) AS exact_match
        FROM runs r LEFT JOIN writes p ON p.c = r.c AND p.query_id = r.query_id
        LEFT JOIN writes g ON g.c = -1 AND g.query_id = r.query_id""",
    "error_flags": f"""WITH {ACTS},{FLAGS} SELECT run_id, query_id, no_actions, wrong_email, end_date_minor_error,
        meeting_start_time_error FROM causes""",
    "iteration_limit_rows": f"WITH {ACTS} SELECT run_id, query_id, error FROM runs WHERE error = '{LIMIT}'",
    "cardinality_audit": f"""WITH {EV},
        g AS (SELECT {CFG.format(c='c')} AS run_id, query_id,
                     CASE WHEN query_id % 101 = 0 THEN 0 WHEN query_id % 107 = 1 THEN 2 ELSE 1 END AS n_gold,
                     CASE WHEN (query_id + c) % 103 = 0 THEN 0 ELSE 1 END AS n_predictions
              FROM qs, (SELECT unnest([0, 1, 2, 3])::BIGINT AS c))
        SELECT run_id, query_id, n_predictions::BIGINT AS n_predictions, n_gold::BIGINT AS n_gold,
               CASE WHEN n_gold = 0 THEN 'no gold' WHEN n_predictions = 0 THEN 'no prediction' ELSE 'duplicate' END AS problem
        FROM g WHERE (n_gold <> 1 OR n_predictions <> 1) AND n_gold + n_predictions > 0""",
    "joined_on_text": f"""WITH {ACTS}, g AS (SELECT query_id, count(*) AS n FROM gold GROUP BY ALL)
        SELECT domain, config, count(*) AS n, sum(coalesce(g.n, 0))::BIGINT AS n_gold_actions
        FROM runs LEFT JOIN g USING (query_id) GROUP BY ALL""",
    "action_differences": f"""WITH {ACTS}, d AS (
        SELECT run_id, query_id, action, sum(n) AS d FROM (
          SELECT run_id, query_id, lower(action) AS action, 1 AS n FROM pred
          UNION ALL SELECT run_id, query_id, lower(action), -1 FROM gold JOIN runs USING (query_id))
        GROUP BY ALL HAVING sum(n) <> 0)
        SELECT run_id, query_id, action, greatest(d, 0)::BIGINT AS extra, greatest(-d, 0)::BIGINT AS missing FROM d""",
    # replay and score
    "replayed_changes": f"""WITH {ACTS},{_replay()}
        SELECT run_id, query_id, target, change, row_key, attr, value FROM delta JOIN runs USING (c, query_id)""",
    "outcome_equality": f"""WITH {ACTS},{_replay()}
        SELECT run_id, query_id, same_outcome, changed, n_cells, n_gold_cells FROM judged""",
    "state_difference": f"""WITH {ACTS},{_replay()},
        p AS (SELECT run_id, query_id, target, change, row_key, attr, value FROM delta JOIN runs USING (c, query_id)),
        g AS (SELECT run_id, query_id, target, change, row_key, attr, value FROM delta d JOIN runs USING (query_id)
              WHERE d.c = -1)
        SELECT 'predicted' AS side, * FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM g)
        UNION ALL SELECT 'gold', * FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM p)""",
    "scored_runs": f"WITH {SCORED} SELECT {SCORED_COLUMNS} FROM scored",
    "residual_errors": f"""WITH {SCORED}, p AS (SELECT run_id, query_id, string_agg(action, ' | ' ORDER BY step) AS t
        FROM pred GROUP BY ALL)
        SELECT run_id, query_id, unwanted_side_effects, coalesce(t, '') AS prediction
        FROM classed LEFT JOIN p USING (run_id, query_id) WHERE residual""",
    "custom_error_class": f"""WITH {SCORED},
        u AS (SELECT run_id, query_id, bool_or(contains(action, 'ITEM')) AS up FROM pred GROUP BY ALL),
        x AS (SELECT s.domain, s.config, NOT correct AND coalesce(up, false) AS wrong_case,
                     residual AND NOT coalesce(up, false) AS rest
              FROM classed s LEFT JOIN u USING (run_id, query_id))
        SELECT domain, config, count(*) AS n, count_if(wrong_case)::BIGINT AS n_wrong_case,
               count_if(rest)::BIGINT AS n_residual FROM x GROUP BY ROLLUP (domain, config)""",
    "added_tool": f"""WITH {ACTS},{_replay(True)}
        SELECT domain, count(*) AS n, count_if(error = '' AND same_outcome)::BIGINT AS n_correct FROM judged GROUP BY ALL""",
    # reports
    "accuracy_by_config": f"""WITH {SCORED} SELECT domain, config, count(*) AS n, count_if(correct)::BIGINT AS n_correct,
        round(avg(correct::INT) * 100, 6) AS accuracy FROM scored GROUP BY ALL""",
    "error_rates": f"""WITH {SCORED}, x AS (SELECT domain, config, count(*) AS n,
        count_if(NOT correct AND NOT unwanted_side_effects)::BIGINT AS n_without_side_effects,
        count_if(NOT correct AND unwanted_side_effects)::BIGINT AS n_with_side_effects FROM scored GROUP BY ALL)
        SELECT *, round(n_without_side_effects / n * 100, 6) AS pct_without_side_effects,
               round(n_with_side_effects / n * 100, 6) AS pct_with_side_effects FROM x""",
    "error_classes": f"""WITH {SCORED} SELECT domain, config, count(*) AS n,
        count_if(no_actions)::BIGINT AS n_no_actions, count_if(wrong_email)::BIGINT AS n_wrong_email,
        count_if(end_date_minor_error)::BIGINT AS n_end_date_minor_error,
        count_if(meeting_start_time_error)::BIGINT AS n_meeting_start_time_error,
        count_if(residual)::BIGINT AS n_residual FROM classed GROUP BY ROLLUP (domain, config)""",
    "leaderboard": f"""WITH {MATCHED} SELECT domain,
        round(max(CASE WHEN config = 'all' THEN accuracy END), 6) AS "all",
        round(max(CASE WHEN config = 'domains' THEN accuracy END), 6) AS domains,
        round(max(CASE WHEN config = 'domains_react' THEN accuracy END), 6) AS domains_react,
        round(max(CASE WHEN config = 'domains_memory' THEN accuracy END), 6) AS domains_memory FROM acc GROUP BY ALL""",
    "best_per_domain": f"""WITH {MATCHED} SELECT domain, config, n, n_correct, round(accuracy, 6) AS accuracy FROM acc
        QUALIFY accuracy = max(accuracy) OVER (PARTITION BY domain)""",
    "deltas_to_baseline": f"""WITH {MATCHED} SELECT a.domain, a.config, a.n, a.n_correct, round(a.accuracy, 6) AS accuracy,
        round(b.accuracy, 6) AS baseline, round(a.accuracy - b.accuracy, 6) AS delta,
        CASE WHEN a.accuracy > b.accuracy THEN 'improved' WHEN a.accuracy < b.accuracy THEN 'regressed' ELSE 'equal' END AS trend
        FROM acc a JOIN acc b ON b.domain = a.domain AND b.config = 'domains' WHERE a.config <> 'domains'""",
    "cross_domain_totals": f"""WITH {MATCHED} SELECT config, count(*) AS n_domains, sum(n)::BIGINT AS n,
        sum(n_correct)::BIGINT AS n_correct, round(sum(n_correct) / sum(n) * 100, 6) AS weighted_accuracy,
        round(avg(accuracy), 6) AS mean_accuracy FROM acc GROUP BY ALL""",
    "iteration_limit_share": f"""WITH {ACTS} SELECT domain, config, count(*) AS n, count_if(error = '{LIMIT}')::BIGINT AS n_limit,
        round(avg((error = '{LIMIT}')::INT), 6) AS share FROM runs GROUP BY ALL""",
    "repeated_actions": f"""WITH {ACTS},
        x AS (SELECT run_id, query_id, step, dom || '.' || verb AS function, action,
                     CASE verb WHEN 'create_item' THEN title ELSE k END AS a1,
                     CASE WHEN w THEN d END AS a2, CASE WHEN verb = 'update_item' THEN status END AS a3,
                     CASE WHEN verb = 'update_item' THEN name END AS a4, CASE WHEN w THEN tm END AS a5,
                     -- a raw line break keeps an action from being called
                     contains(action, '\\n') AS bad FROM pred),
        near AS (
          SELECT a.run_id, a.query_id, a.function, count(DISTINCT a.step) AS n FROM x a JOIN x b
            ON b.run_id = a.run_id AND b.query_id = a.query_id AND b.function = a.function AND NOT a.bad AND NOT b.bad
           AND (a.a4 IS NULL) = (b.a4 IS NULL)
           AND (a.a1 <> b.a1)::INT + coalesce((a.a2 <> b.a2)::INT, 0) + coalesce((a.a3 <> b.a3)::INT, 0)
             + coalesce((a.a4 <> b.a4)::INT, 0) + coalesce((a.a5 <> b.a5)::INT, 0) = 1
          GROUP BY ALL)
        SELECT run_id, query_id, function, count(*) AS calls, count(DISTINCT action) AS distinct_calls,
               coalesce(max(n.n), 0)::BIGINT AS near_duplicates
        FROM x LEFT JOIN near n USING (run_id, query_id, function) GROUP BY run_id, query_id, function""",
    "tool_usage": f"""WITH {ACTS},{EXACT},
        c AS (SELECT domain, config, dom || '.' || verb AS tool, count(*) AS calls FROM pred GROUP BY ALL),
        t AS (SELECT DISTINCT domain, config, run_id, query_id, dom || '.' || verb AS tool FROM pred),
        s AS (SELECT t.domain, t.config, tool, count(*) AS traces, round(avg(exact_match::INT), 6) AS success_rate
              FROM t JOIN exact USING (run_id, query_id) GROUP BY ALL)
        SELECT * FROM c JOIN s USING (domain, config, tool)""",
    "appended_results": f"""WITH {ACTS}, u AS (SELECT domain, config,
          CASE WHEN error <> '' OR query_id % 3 <> 0 THEN error END AS error FROM runs
          UNION ALL SELECT domain, config, NULL FROM runs WHERE config = 'all')
        SELECT domain, config, count(*) AS n, count(error) AS n_error_known FROM u GROUP BY ALL""",
    # tool sets
    "tool_catalogue": f"""WITH {EV},{TOOLS}, n AS (SELECT tool, count(*) AS calls FROM evw GROUP BY ALL)
        SELECT replace(tool, '__', '.') AS tool, domain, side_effect, op_kind, coalesce(calls, 0) AS calls
        FROM tools LEFT JOIN n USING (tool)""",
    "query_tools": f"WITH {EV},{TOOLS} SELECT query_id, tool FROM qtools",
    "query_tools_all": f"WITH {EV},{TOOLS} SELECT query_id, (SELECT count(*) FROM tools) AS n FROM qs",
    "unknown_tools": f"""WITH {EV} SELECT query_id, tool, count(*) AS n FROM evw WHERE tool = 'analytics__delete_item'
        GROUP BY ALL""",
    "unavailable_tools": f"""WITH {EV},{TOOLS} SELECT query_id, tool, count(*) AS n FROM evw ANTI JOIN qtools
        USING (query_id, tool) GROUP BY ALL""",
    "first_queries": f"WITH {EV} SELECT query_id, 'request ' || query_id AS query FROM qs ORDER BY query_id LIMIT 100",
    "tool_texts": f"""WITH {EV},{TOOLS} SELECT query_id, string_agg(line, chr(10) ORDER BY ord) AS tools_text
        FROM qtools GROUP BY ALL""",
    # episodes
    "eligible_signatures": f"""WITH {MEM},
        s AS (SELECT DISTINCT least(t1, t2) || '|' || greatest(t1, t2) AS episode_tools, t1, t2 FROM eps),
        v(verb) AS (VALUES ('create_item'), ('update_item'), ('delete_item'), ('search_items'), ('get_item_by_id')),
        q AS (SELECT t1 AS missing, (SELECT string_agg(verb, '|' ORDER BY verb) FROM v WHERE verb <> t1) AS query_tools
              FROM (SELECT DISTINCT t1 FROM mem))
        SELECT episode_tools, query_tools FROM s JOIN q ON missing <> t1 AND missing <> t2""",
    "eligible_counts": f"""WITH {MEM} SELECT q.run_id, q.seq, count(e.seq) AS n_eligible FROM mem q LEFT JOIN eps e
        ON e.run_id = q.run_id AND e.seq < q.seq AND e.t1 <> q.t1 AND e.t2 <> q.t1 GROUP BY ALL""",
    "similar_episodes": f"WITH {_similar(3)} SELECT run_id, seq, e_seq, score, rank FROM alike",
    "similar_episodes_by_levels": f"WITH {_similar(3)} SELECT run_id, seq, e_seq, score, rank FROM alike",
    "cold_start": f"""WITH {MEM}, x AS (SELECT run_id, seq, coalesce(sum(stored::INT) OVER (PARTITION BY run_id ORDER BY seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS store_size FROM mem)
        SELECT *, store_size >= 5 AS may_retrieve FROM x""",
    "few_shot_picks": f"""WITH {EV},{TOOLS},{MEM},
        ex AS (SELECT {DOM.format(q='seq')} AS dom, seq, t1, t2 FROM mem),
        q AS (SELECT query_id, domains FROM qdom),
        r AS (SELECT dom, seq, row_number() OVER (PARTITION BY dom ORDER BY seq) AS rank FROM ex)
        SELECT query_id, rank, seq AS pos FROM q JOIN r ON domains = dom WHERE rank <= 3""",
    "gated_runs": f"""WITH {SCORED} SELECT run_id, query_id, CASE WHEN error <> '' THEN 'error' WHEN n_pred = 0 THEN 'no actions'
        WHEN NOT same_outcome THEN 'incorrect' WHEN n_gold = 0 THEN 'no-op correct' ELSE 'stored' END AS gate_status
        FROM scored""",
    "gate_counts": f"""WITH {SCORED}, x AS (SELECT config, CASE WHEN error <> '' THEN 'error' WHEN n_pred = 0 THEN 'no actions'
        WHEN NOT same_outcome THEN 'incorrect' WHEN n_gold = 0 THEN 'no-op correct' ELSE 'stored' END AS gate_status
        FROM scored) SELECT config, gate_status, count(*) AS n FROM x GROUP BY ALL""",
    "demonstration_messages": f"""WITH {_similar(2)},
        m AS (
          SELECT s.run_id, s.seq, s.rank, e.seq AS e_seq, e.query, x.pos, x.t FROM alike s
          JOIN mem e ON e.run_id = s.run_id AND e.seq = s.e_seq,
          LATERAL (SELECT unnest([1, 2, 3, 4, 5, 6]) AS pos, unnest(['', e.t1, e.t1, e.t2, e.t2, '']) AS t) x)
        SELECT run_id, seq, row_number() OVER (PARTITION BY run_id, seq ORDER BY rank, pos) AS ord,
          CASE WHEN pos = 1 THEN 'user' WHEN pos IN (3, 5) THEN 'tool' ELSE 'assistant' END AS role,
          CASE WHEN pos IN (3, 5) THEN t END AS name,
          CASE pos WHEN 1 THEN query WHEN 6 THEN 'done' WHEN 3 THEN 'ok' WHEN 5 THEN 'ok' END AS content,
          CASE WHEN pos IN (2, 4) THEN '[{{"name":"' || t || '","args_json":"{{\\"k\\": \\"' || e_seq || '\\"}}"}}]' END AS tool_calls
        FROM m""",
    # trials
    "judge_decisions": f"WITH {TRIALS} SELECT query_id, trial, success, reason FROM dec",
    "verifier_decisions": f"WITH {TRIALS} SELECT query_id, trial, verdict FROM dec",
    "chosen_trials": f"""WITH {TRIALS} SELECT query_id, coalesce(min(trial) FILTER (success), max(trial)) AS trial,
        bool_or(success) AS settled FROM dec GROUP BY ALL""",
    "chosen_attempts": f"""WITH {TRIALS} SELECT query_id, coalesce(min(trial) FILTER (calls), max(trial)) AS trial,
        bool_or(calls)::INT::BIGINT AS n_calls, bool_or(calls) AS settled FROM dec GROUP BY ALL""",
    "chosen_drafts": f"""WITH {TRIALS} SELECT query_id, coalesce(min(trial) FILTER (verdict), max(trial)) - 1 AS draft,
        coalesce(bool_or(verdict), false) AS verified FROM dec GROUP BY ALL""",
    "reflection_buffers": f"""WITH {TRIALS},{_buffer(2, "' || '")}
        SELECT query_id, trial, coalesce(buffer, '') AS buffer FROM buf""",
    "judge_quality": _quality("success"),
    "verifier_quality": _quality("verdict"),
    "reflected_queries": f"""WITH {TRIALS},{_buffer(3, "chr(10)", "- ")}
        SELECT query_id, trial, CASE WHEN buffer IS NULL THEN '' ELSE 'Notes on your failed attempts at this task:' || chr(10)
          || buffer || chr(10) || chr(10) || 'User request:' || chr(10) END || 'request ' || query_id AS user_query FROM buf""",
    # transcripts
    "json_objects": """SELECT event_id, x.ord::BIGINT AS ord, x.object FROM events e,
        LATERAL (SELECT unnest([1, 2, 3]) AS ord,
                        unnest([props, '{"outer": ' || props || ', "x": [true]}', props]) AS object) x""",
    "json_objects_lateral": "SELECT event_id, 1::BIGINT AS ord, props AS object FROM events",
    "tool_calls": f"WITH {CALLS} SELECT query_id, step, tool, action, args_json FROM calls",
    "malformed_rate": f"""WITH {CALLS}, x AS (SELECT {DOM.format(q='query_id')} AS domain,
          CASE WHEN shape = 3 THEN 0 ELSE 1 END AS b, CASE WHEN shape <> 3 AND broken THEN 1 ELSE 0 END AS m FROM callrows)
        SELECT domain, sum(b)::BIGINT AS n_blocks, sum(m)::BIGINT AS n_malformed,
               round(CASE WHEN sum(b) > 0 THEN sum(m) / sum(b) END, 6) AS rate FROM x GROUP BY ALL""",
    "routed_tools": f"""WITH {ROUTES} SELECT query_id, routed, selected, round(met / n, 6) AS recall
        FROM routed LEFT JOIN rec USING (query_id)""",
    "thought_candidates": f"""WITH {THOUGHTS} SELECT query_id, ord::BIGINT AS ord, id, reasoning, kind, tool_name, tool_args,
        final_answer FROM cand""",
    "chosen_candidates": f"""WITH {THOUGHTS}, n AS (SELECT query_id, count(*) AS n FROM cand GROUP BY ALL)
        SELECT query_id, CASE WHEN n IS NULL THEN NULL WHEN n = 1 THEN 'T1'
          WHEN query_id % 3 = 0 THEN 'T2' WHEN query_id % 3 = 1 AND n >= 3 THEN 'T3' ELSE 'T1' END AS chosen_id
        FROM qs LEFT JOIN n USING (query_id)""",
    "candidate_texts": f"""WITH {THOUGHTS} SELECT query_id, coalesce(string_agg(id || chr(10) || 'Reasoning: ' ||
          CASE WHEN reasoning = '' THEN 'No reasoning provided.' ELSE reasoning END || chr(10) ||
          CASE WHEN kind = 'tool_call' THEN 'Action: {{"arguments": ' || tool_args || ', "name": "' || tool_name || '"}}'
               ELSE 'Final answer: ' || final_answer END, chr(10) || chr(10) ORDER BY ord), '') AS text
        FROM qs LEFT JOIN cand USING (query_id) GROUP BY ALL""",
    "plan_steps": f"WITH {PLANS} SELECT query_id, part, var, tool_name, args_template, thought FROM steps",
    "capped_plans": f"""WITH {PLANS} SELECT query_id, string_agg(CASE WHEN step <= 6 THEN var END, ',' ORDER BY step) AS vars,
        count(*) > 6 AS too_long FROM steps GROUP BY ALL""",
    "resolved_steps": f"""WITH {PLANS},
        -- a step sees the evidence of the steps before it; #E10 is filled in before #E1
        x AS (SELECT s.*, EXISTS (SELECT 1 FROM steps b WHERE b.query_id = s.query_id AND b.var = 'E10' AND b.step < s.step) AS t10,
                     s.step > 1 AS t1 FROM steps s),
        y AS (SELECT *, CASE WHEN t10 THEN replace(args_template, '#E10', 'o10') ELSE args_template END AS a FROM x),
        z AS (SELECT *, CASE WHEN t1 THEN replace(a, '#E1', 'o1') ELSE a END AS resolved FROM y)
        SELECT query_id, step, var, resolved, tool_name = 'list_all' AS needs_repair FROM z""",
    "solver_prompts": f"""WITH {PLANS}, n AS (SELECT query_id, chr(10) AS l, string_agg(thought, '; ' ORDER BY step) AS plan,
          string_agg('#' || var || ' = saw ' || tool_name, chr(10) ORDER BY step) AS seen
          FROM steps GROUP BY ALL)
        SELECT query_id, 'Task:' || l || 'request ' || query_id || l || l || 'Plan:' || l || plan || l || l || 'Evidence:' || l
          || seen || l || l || 'Write the answer.' AS user_query FROM n""",
    "transcript_sections": f"WITH {SECTIONS} SELECT query_id, ord, phase, text FROM sections",
    "custom_markers": f"WITH {EV} SELECT CASE WHEN w THEN 'ok' ELSE 'note' END AS phase, count(*) AS n FROM evw GROUP BY ALL "
    "UNION ALL SELECT 'response', count(*) FROM qs",
    "generation_cost": f"""WITH {EV}, q AS (SELECT {CFG.format(c='(query_id % 4)')} AS config, query_id,
          -- a reply to each observation; else an attempt for each buffer, a plan and what follows, a routing and what follows
          CASE max(query_id % 4) WHEN 2 THEN count_if(verb IN ('create_item', 'update_item', 'delete_item')) ELSE 2 END AS turns,
          max(CASE query_id % 2 WHEN 0 THEN 2 ELSE 0 END) AS trials
          FROM ev GROUP BY ALL)
        SELECT config, count(*) AS n_queries, sum(turns)::BIGINT AS turns, sum(trials)::BIGINT AS trials, 0::BIGINT AS rounds,
               round(avg(turns), 6) AS turns_per_query FROM q GROUP BY ALL""",
    "turn_table": f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step) AS i FROM ev)
        SELECT query_id, CASE WHEN query_id % 2 = 0 AND query_id % 5 <> 3 THEN i ELSE 1 END AS ord,
          CASE WHEN query_id % 2 = 0 OR query_id % 5 = 3 THEN 1 ELSE i END::BIGINT AS turn,
          CASE WHEN query_id % 2 = 0 AND query_id % 5 <> 3 AND i > 1 THEN 'observation' ELSE 'response' END AS phase,
          CASE WHEN query_id % 5 = 3 OR event_id % 19 <> 0 THEN dom || '__' || verb END AS tool
        FROM n WHERE query_id % 5 <> 3 OR i = 1""",
    # datasets
    "system_prompts": f"""WITH {EV},{TOOLS},
        t AS (SELECT query_id, string_agg(line, chr(10) ORDER BY ord) AS tt FROM qtools GROUP BY ALL),
        p AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{p}', {_prompt(p)})" for i, p in enumerate(D.TEMPLATES))}) v(i, phase, template))
        SELECT query_id, phase, replace(template, '{{tools}}', 'Available tools:' || chr(10) || tt) AS system_prompt
        FROM t JOIN p ON query_id % {len(D.TEMPLATES)} = i""",
    "trajectory_texts": f"WITH {TRACES} SELECT query_id, trajectory FROM traj2",
    "follow_up_prompts": f"""WITH {TRACES}, n AS (SELECT *, chr(10) AS l FROM traj2) SELECT query_id,
        'User request:' || l || q || l || l || 'Draft plan:' || l || '- look up' || l || l ||
          'Follow the plan as far as tool results bear it out.' AS planned,
        q || l || l || 'Earlier attempt (state has been reset since):' || l || trajectory || l || l || 'What checking it found:'
          || l || 'VERDICT: INCORRECT' || l || l || 'Solve the request anew, mending what was wrong.' AS correction,
        'User task:' || l || q || l || l || 'Agent attempt transcript:' || l || trajectory || l || l ||
          'Was the task fulfilled? Answer with the JSON object.' AS evaluator FROM n""",
    "phase_prompts": f"""WITH {TRACES}, n AS (SELECT *, chr(10) AS l, chr(10) || chr(10) AS g FROM traj2),
        a AS (SELECT query_id, min_by(verb, step) AS verb, min_by(k, step) AS k,
                     string_agg('#E' || step || ' = seen ' || k, chr(10) ORDER BY step) AS ev FROM acted GROUP BY ALL)
        SELECT query_id, 'Request:' || l || q || g || 'Run to check:' || l || trajectory AS verification,
          'Comments so far:' || l || 'seen ' || q || g || 'Next:' || l || 'the following call, or the answer.' AS next_step,
          'Proposals:' || l || trajectory || g || 'Wanted:' || l || 'the id of one.' AS choice,
          'Request:' || l || q || g || 'Failed run:' || l || trajectory || g ||
            CASE WHEN query_id % 2 = 0 THEN 'Reason given:' || l || 'late' || g ELSE '' END || 'Wanted:' || l || 'a note.' AS reflection,
          'Tool:' || l || coalesce(verb, 'none') || g || 'Parameters:' || l || 'k (any): item number' || g || 'Arguments as planned:' || l ||
            CASE WHEN verb IS NULL THEN '{{}}' ELSE '{{"k": "' || k || '"}}' END || g || 'Evidence:' || l || coalesce(ev, '(none)') AS repair
        FROM n LEFT JOIN a USING (query_id)""",
    "few_shot_messages": f"""WITH {EV},{TOOLS},{MEM},
        ex AS (SELECT {DOM.format(q='seq')} AS dom, seq, query, t1, t2 FROM mem),
        r AS (SELECT *, row_number() OVER (PARTITION BY dom ORDER BY seq) AS rank FROM ex),
        m AS (SELECT query_id, rank, r.seq, query, x.pos, x.t FROM qdom JOIN r ON domains = dom AND rank <= 3,
              LATERAL (SELECT unnest([1, 2, 3, 4, 5, 6]) AS pos, unnest(['', t1, t1, t2, t2, '']) AS t) x)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS ord,
          CASE WHEN pos = 1 THEN 'user' WHEN pos IN (3, 5) THEN 'tool' ELSE 'assistant' END AS role,
          CASE WHEN pos IN (3, 5) THEN t END AS name,
          CASE pos WHEN 1 THEN query WHEN 6 THEN 'done' WHEN 3 THEN 'ok' WHEN 5 THEN 'ok' END AS content,
          CASE WHEN pos IN (2, 4) THEN '[{{"name":"' || t || '","args_json":"{{\\"k\\": \\"' || seq || '\\"}}"}}]' END AS tool_calls
        FROM m""",
    "chat_messages": f"""WITH {TRACES},
        m AS (
          SELECT query_id, 0 AS p, 'system' AS role, NULL AS name, 'system text' AS content, NULL AS tool_calls FROM qs
          UNION ALL SELECT query_id, 1, 'user', NULL, 'request ' || query_id, NULL FROM qs
          UNION ALL SELECT query_id, ((step + 1) // 2) * 10, 'assistant', NULL, NULL,
            '[' || string_agg('{{"name":"' || verb || '","args_json":"{{\\"k\\": \\"' || k || '\\"}}"}}', ',' ORDER BY step) || ']'
            FROM acted GROUP BY query_id, (step + 1) // 2
          UNION ALL SELECT query_id, ((step + 1) // 2) * 10 + 1 + step % 2 * -1 + 1, 'tool', verb, 'seen ' || k, NULL FROM acted
          UNION ALL SELECT query_id, 1000, 'assistant', NULL, 'done', NULL FROM qs WHERE query_id % 3 <> 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS ord, role, name, content, tool_calls FROM m""",
    # files and streams
    "queries_from_csv": f"""WITH {ACTS},{TOOLS} SELECT 'request ' || query_id AS query, count(g.step) AS n_answer,
        coalesce(string_agg({RAW}, ' | ' ORDER BY step), '') AS answer, domains
        FROM qdom LEFT JOIN gold g USING (query_id) GROUP BY query_id, domains""",
    "result_history": f"""WITH {ACTS} SELECT 'mixed' AS domain, 'model-7b' AS label, config || '_react' AS mode,
        '2024-01-31_10-20-30' AS time, 'request ' || query_id AS query,
        coalesce(string_agg({RAW}, ' | ' ORDER BY step), '') AS function_calls, error
        FROM runs LEFT JOIN acts USING (c, query_id) GROUP BY ALL""",
    "scored_from_files": f"""WITH {SCORED} SELECT 'mixed' AS domain, config, 'request ' || query_id AS query, exact_match, correct,
        unwanted_side_effects, no_actions, wrong_email, end_date_minor_error, meeting_start_time_error FROM scored""",
    "result_tables": f"""WITH {ACTS} SELECT r.domain, r.config, count(DISTINCT r.query_id) AS n, count(a.step) AS n_calls
        FROM runs r LEFT JOIN acts a USING (c, query_id) GROUP BY ALL""",
    "episode_store": f"""WITH {MEM} SELECT fmt, run_id::VARCHAR AS run_id, seq, query, t1 || ',' || t2 AS tools, seq::VARCHAR AS k
        FROM eps, (VALUES ('parquet'), ('json')) f(fmt)""",
    "example_file": f"""WITH {MEM} SELECT {DOM.format(q='seq')} AS domain_key, count(*) AS n, min(seq) AS first_pos
        FROM mem GROUP BY ALL""",
    "streamed_retrieval": f"""WITH {_similar(2, BATCHED)}
        SELECT (a.run_id % 3)::BIGINT AS batch, (a.run_id // 3)::VARCHAR AS run_id, seq, e_seq, rank, score
        FROM alike a JOIN mem USING (run_id, seq) WHERE asked""",
    "streamed_scores": f"WITH {SCORED} SELECT {SCORED_COLUMNS} FROM scored",
    "streamed_episodes": f"""WITH {MEM} SELECT run_id::VARCHAR AS run_id, seq, query FROM mem
        WHERE seq % 11 <> 0 AND seq % 4 <> 0 AND seq % 9 <> 0""",
}
