"""The queries on the supplier graph's health find its edges once, and only measure what they report."""

import threading

import pytest

from codehealth.operators import graph, stats
from codehealth.plans import table_queries
from codehealth.session import kept

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def calls(monkeypatch):
    """How often each of the costly inputs is built."""
    n = {"hops": 0, "flagged": 0}
    for name in n:

        def counted(spark, d, name=name, plain=getattr(table_queries, name)):
            n[name] += 1
            return plain(spark, d)

        monkeypatch.setattr(table_queries, name, counted)
    return n


def test_ceilings_need_no_heights(spark, calls, monkeypatch):
    want = table_queries.ceilings(spark, FOLDER).collect()
    monkeypatch.setattr(graph, "heights", lambda *a: pytest.fail("heights"))
    assert table_queries.ceilings(spark, FOLDER).collect() == want and calls == {"hops": 2, "flagged": 0}


def test_health_report_finds_edges_once(spark, calls):
    assert table_queries.health_report(spark, FOLDER).count() == 1 and calls["hops"] == 1


@pytest.fixture
def stored(monkeypatch):
    """What is stored, by name."""
    found, plain = [], graph.kept

    def noted(df, what):
        found.append(what)
        return plain(df, what)

    monkeypatch.setattr(graph, "kept", noted)
    monkeypatch.setattr(table_queries, "kept", noted)
    return found


def test_health_report_deals_edges_once(spark, stored):
    assert table_queries.health_report(spark, FOLDER).count() == 1 and stored == ["hops", "links"]


def test_rules_check_finds_edges_once(spark, calls):
    assert table_queries.rules_check(spark, FOLDER).count() > 0 and calls["hops"] == 1


def test_score_floors_find_edges_once(spark, calls):
    assert table_queries.score_floors(spark, FOLDER).count() > 0 and calls["hops"] == 1


def test_gate_diff_finds_edges_and_flags_once(spark, calls):
    assert table_queries.gate_diff(spark, FOLDER).count() > 0 and calls == {"hops": 1, "flagged": 1}


def test_rules_check_deals_edges_once(spark, stored):
    assert table_queries.rules_check(spark, FOLDER).count() > 0 and stored == ["hops", "links"]


def test_edges_meet_numbers_of_nations(spark):
    plan = table_queries.nation_edges(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a#" in plan


def test_gate_diff_deals_edges_once(spark, stored):
    assert table_queries.gate_diff(spark, FOLDER).count() > 0 and stored == ["hops", "links"]


def test_score_floors_deal_edges_once(spark, stored):
    assert table_queries.score_floors(spark, FOLDER).count() > 0 and stored == ["hops", "links"]


def test_measures_run_at_once(spark, monkeypatch):
    both = threading.Barrier(2, timeout=60)
    for module, name in ((stats, "gini"), (graph, "modularity")):
        monkeypatch.setattr(module, name, lambda *a, plain=getattr(module, name): both.wait() >= 0 and plain(*a))
    assert table_queries.score_floors(spark, FOLDER).count() > 0


def test_an_error_of_one_measure_is_raised(spark, monkeypatch):
    def wrong(*a):
        raise KeyError("gini")

    monkeypatch.setattr(stats, "gini", wrong)
    with pytest.raises(KeyError, match="gini"):
        table_queries.score_floors(spark, FOLDER)


def test_stored_edges_are_made_distinct_only_beyond_one_task(spark, stored):
    path = kept(spark.range(300).selectExpr("id % 30 AS src", "(id % 30) + 1 AS dst"), "path")
    want = [(k, 30 - k) for k in range(31)]
    for limit, more in ((300, []), (40, ["edges"]), (7, ["edges", "blocks"])):
        stored.clear()
        assert sorted(map(tuple, graph.heights(path, limit, stored=True).collect())) == want and stored[:2] == more


def test_stored_upward_edges_do_not_move(spark, monkeypatch):
    plans, plain = {}, table_queries.kept

    def noted(df, what):
        plans[what] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, what)

    monkeypatch.setattr(table_queries, "kept", noted)
    table_queries.score_floors(spark, FOLDER)
    assert "Exchange" in plans["hops"] and "Exchange" not in plans["links"]
