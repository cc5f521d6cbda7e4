"""Fixed values of the evaluated data: they must stay as they are for results to agree."""

# The five state-bearing domains, in the order tools are listed for a query.
TOOLSET_ORDER = (
    "email",
    "calendar",
    "analytics",
    "project_management",
    "customer_relationship_manager",
)

# Fixed value: the domain whose tools belong to every query.
DIRECTORY_DOMAIN = "company_directory"

# Short domain names and what they stand for.
DOMAIN_ALIASES = {"crm": "customer_relationship_manager"}

# Fixed value: error text of a run that used up its turns.
ITERATION_LIMIT = "Agent stopped due to iteration limit."

# State attributes that keep their case when outcomes are compared.
CASE_KEPT_ATTRIBUTES = ("status", "list_name", "board")

# Texts looked for by the wrong-address, end-date and start-time error classes.
OUTSIDE_ADDRESS = "@example"
OWN_ADDRESS = "@atlas"
GOLD_END_DATE = "2023-11-29"
NEAR_END_DATE = "2023-11-30"
GOLD_START_TIME = "13:00:00"
NEAR_START_TIMES = ("09:00:00", "11:00:00", "15:00:00", "15:30:00")

# Answers of a judge that count as success, compared trimmed and in lower case.
SUCCESS_WORDS = ("true", "yes", "success", "succeeded")

# Line starts that open a new phase in a full response, with the phase name.
PHASE_MARKERS = (
    ("routing", r"Routing response:\n"),
    ("selected_tools", r"Selected tools: "),
    ("plan", r"Plan:\n"),
    ("reflection", r"Reflection:\n"),
    ("candidates", r"Thought candidates:\n"),
    ("judge", r"Thought judge:\n"),
    ("selected", r"Selected thought:\n"),
    ("final_answer", r"Final answer:\n"),
    ("observation", r"Observation:\n"),
    ("worker_step", r"Step #E\d+\n"),
    ("trial", r"=== Trial \d+ of \d+ ==="),
    ("buffer", r"Reflections in buffer:\n"),
    ("evaluator", r"Evaluator \(raw\):\n"),
    ("decision", r"Evaluator decision: "),
    ("reflection_added", r"Reflection appended:\n"),
    ("draft", r"=== CRITIC initialization [^\n]*==="),
    ("verification", r"=== CRITIC verification pass \d+ of \d+ ==="),
    ("correction", r"=== CRITIC correction [^\n]*==="),
)

# Fixed value: how a block that holds a tool call is marked in a model's text.
CALL_BLOCK = r"(?s)<tool_call>(.*?)</tool_call>"

# How a plan marks a step's thought and the call whose result it names; {space} is white space.
PLAN_MARK = r"(?U)(?:^|\n){space}*Plan{space}*:{space}*"
PLAN_CALL = r"(?U)#E(\d+){space}*={space}*([A-Za-z_]\w*){space}*\["
