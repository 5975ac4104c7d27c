import pytest

from chronoweave import Pattern, QueryError, Var, compile_statement, parse


@pytest.mark.parametrize(
    "text, kind, values",
    [
        ("match (A, ?p, ?o) as of '2026-01-01'", "MATCH", {"pattern": Pattern("A", Var("p"), Var("o")), "day": "2026-01-01", "known_by": None, "limit": None}),
        ("MATCH (a, B, C) AS OF 'd' KNOWN BY 't' WHERE Confidence >= 0.5 LIMIT 3 // end", "MATCH", {"known_by": "t", "where": (">=", 0.5), "limit": 3}),
        ("HISTORY (?s, P, O)", "HISTORY", {"start": None, "end": None}),
        ("HISTORY (?s, P, O) BETWEEN 'a' AND 'b' WHERE confidence != -1", "HISTORY", {"start": "a", "where": ("!=", -1.0)}),
        ("DIFF BETWEEN 'a' AND 'b'", "DIFF", {"pattern": None, "start": "a", "end": "b"}),
        ("DIFF BETWEEN 'a' AND 'b' FOR (A, ?x, ?y)", "DIFF", {"pattern": Pattern("A", Var("x"), Var("y"))}),
        ("RANGE (A, B, ?c)\nBETWEEN 'a' AND 'b'", "RANGE", {}),
        ("SERIES (A, B, ?c) BETWEEN 'a' AND 'b' RESOLUTION '7d'", "SERIES", {"step": 7}),
        ("ASSERT (A, B, C) VALID FROM 'd' CONFIDENCE 0.25", "ASSERT", {"valid_from": "d", "confidence": 0.25}),
        ("RETRACT (A, B, C) VALID TO 'd'", "RETRACT", {"valid_to": "d"}),
        ("TRACK DEGREE(A) BETWEEN 'a' AND 'b'", "TRACK", {"metric": "degree", "target": ("A",), "step": 1, "max_depth": 4}),
        ("TRACK edge_weight(A, B, C) BETWEEN 'a' AND 'b' RESOLUTION '2d' MAX_DEPTH 6", "TRACK", {"target": ("A", "B", "C"), "max_depth": 6}),
        ("CHANGEPOINTS PAGERANK(A) BETWEEN 'a' AND 'b'", "CHANGEPOINTS", {"metric": "pagerank"}),
        ("PATH (A, B) AS OF 'd' MAX_DEPTH 2", "PATH", {"a": "A", "b": "B", "max_depth": 2}),
        ("FIRST_CONNECTED (A, B)", "FIRST_CONNECTED", {"start": None}),
        ("FIRST_CONNECTED (A, B) BETWEEN 'a' AND 'b' MAX_DEPTH 3", "FIRST_CONNECTED", {"end": "b", "max_depth": 3}),
        ("PATH_HISTORY (A, B) BETWEEN 'a' AND 'b'", "PATH_HISTORY", {"start": "a"}),
        ("WHY_CHANGED (A, B, C) BETWEEN 'a' AND 'b'", "WHY_CHANGED", {"end": "b"}),
    ],
)
def test_every_statement(text, kind, values):
    s = parse(text)
    assert s.kind == kind
    assert {k: s.values[k] for k in values} == values


@pytest.mark.parametrize(
    "text",
    [
        "", "SELECT 1", "MATCH (A, B) AS OF 'd'", "MATCH (A, B, C)", "MATCH (A, B, C) AS OF d", "MATCH (A, B, C) AS OF 'd' LIMIT -1", "MATCH (A, B, C) AS OF 'd' LIMIT 2.5",
        "MATCH (A, B, C) AS OF 'd' LIMIT 1 WHERE confidence > 1", "MATCH (A, 'B', C) AS OF 'd'", "MATCH (A, B, C) AS OF 'd' extra", "TRACK SIZE(A) BETWEEN 'a' AND 'b'",
        "TRACK DEGREE(A, B, C) BETWEEN 'a' AND 'b'", "TRACK EDGE_WEIGHT(A) BETWEEN 'a' AND 'b'", "SERIES (A, B, C) BETWEEN 'a' AND 'b' RESOLUTION '0d'",
        "SERIES (A, B, C) BETWEEN 'a' AND 'b' RESOLUTION '1w'", "MATCH (A, B, C) AS OF 'unclosed", "MATCH (A, B, C) AS OF 'd' WHERE weight > 1", "PATH (?a, B) AS OF 'd'", "MATCH (A; B, C)", None,
    ],
)
def test_what_cannot_be_read(text):
    with pytest.raises(QueryError):
        parse(text)


def test_plans_are_lazy_and_limit_is_a_top_k(versions):
    v = versions(("A", "L", "B", "2026-01-01", None, 0.5), ("A", "K", "C", "2026-01-01", None, 0.7))
    found = compile_statement("MATCH (A, ?p, ?o) AS OF '2026-01-01' WHERE confidence > 0.1 LIMIT 1", v)
    assert "TakeOrderedAndProject" in found._jdf.queryExecution().executedPlan().toString()
    assert [r["bindings"] for r in found.collect()] == [{"p": "K", "o": "C"}]
    with pytest.raises(QueryError):
        compile_statement("ASSERT (A, B, C) VALID FROM '2026-01-01'", v)
