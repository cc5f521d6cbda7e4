
import pytest

from tracemill.operators import reports as P
from tracemill.sources import catalogue as K
from pyspark.sql import types as T

CONFIGS = (
    "base_7b", "base_8b", "domains", "domains_8bit", "chain_of_thought", "tree_of_thoughts", "route_then_act", "plan_then_act",
    "self_reflection", "react", "few_shot", "memory", "reflexion", "critic",
)
# Queries, then correct answers per configuration in the order above.
PUBLISHED = {
    "calendar": (110, (27, 41, 52, 55, 59, 67, 65, 69, 48, 78, 79, 71, 64, 58)),
    "email": (90, (8, 21, 24, 22, 24, 46, 29, 40, 43, 51, 60, 46, 50, 31)),
    "analytics": (120, (15, 20, 20, 22, 23, None, 27, 28, 26, 17, 34, 43, 33, 15)),
    "project_management": (80, (26, 33, 30, 31, 31, 38, 43, 39, 40, 35, 48, 48, 36, 32)),
    "customer_relationship_manager": (80, (10, 5, 8, 7, 7, 29, 8, 35, 33, 29, 35, 23, 29, 16)),
}


@pytest.fixture(scope="module")
def acc(spark):
    rows = [
        {"domain": d, "config": c, "n": n, "n_correct": k, "accuracy": k / n * 100}
        for d, (n, ks) in PUBLISHED.items() for c, k in zip(CONFIGS, ks) if k is not None
    ]
    kind = T.StructType().add("domain", "string").add("config", "string").add("n", T.LongType())
    return K.rows_as_table(spark, rows, kind.add("n_correct", T.LongType()).add("accuracy", T.DoubleType()))


def test_leaderboard(acc):
    rows = {r["domain"]: r for r in P.rounded(P.leaderboard(acc, CONFIGS)).collect()}
    assert rows["calendar"]["few_shot"] == 71.82 and rows["email"]["base_7b"] == 8.89
    assert rows["analytics"]["tree_of_thoughts"] is None and rows["analytics"]["chain_of_thought"] == 19.17
    assert rows["customer_relationship_manager"]["base_8b"] == 6.25


def test_best(acc):
    best = {(r["domain"], r["config"]) for r in P.best_per_domain(acc).collect()}
    assert best == {
        ("calendar", "few_shot"), ("email", "few_shot"), ("analytics", "memory"), ("project_management", "few_shot"),
        ("project_management", "memory"), ("customer_relationship_manager", "few_shot"),
        ("customer_relationship_manager", "plan_then_act"),
    }


def test_trends(acc):
    trend = {(r["domain"], r["config"]): r["trend"] for r in P.deltas_to_baseline(acc, "domains_8bit").collect()}
    assert all(trend[(d, "few_shot")] == trend[(d, "memory")] == "improved" for d in PUBLISHED)
    assert trend[("calendar", "self_reflection")] == trend[("analytics", "critic")] == "regressed"
    assert trend[("project_management", "chain_of_thought")] == "equal"
    assert ("analytics", "tree_of_thoughts") not in trend


def test_totals(acc):
    t = {r["config"]: r for r in P.totals(acc).collect()}
    assert t["few_shot"]["n"] == 480 and t["few_shot"]["n_correct"] == 256 and t["tree_of_thoughts"]["n_domains"] == 4
    assert t["memory"]["weighted_accuracy"] == pytest.approx(231 / 480 * 100)


def test_limit_share(spark):
    rows = [("analytics", "react", "Agent stopped due to iteration limit." if i < 16 else ("" if i % 2 else None)) for i in range(120)]
    r = P.iteration_limit_share(spark.createDataFrame(rows, "domain string, config string, error string")).first()
    assert (r["n"], r["n_limit"]) == (120, 16) and r["share"] == pytest.approx(16 / 120)
