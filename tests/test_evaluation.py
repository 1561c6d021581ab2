"""Metrics of retrieval, citations and cases, and their summaries."""

from __future__ import annotations

import pytest

from corpuskiln.operators import evaluation as E

LABELS = {"p17": "IRS Pub. 17"}


def test_retrieval_metrics(spark):
    rows = [(1, ["26 USC §63", "26 USC §151(d)", "x"], ["26 usc §151", "IRS Pub. 17"], ["usc26"]), (2, [], ["a"], []), (3, ["a"], None, None), (4, ["b", "a", "a"], ["a"], ["p17"])]
    df = spark.createDataFrame(rows, "id int, retrieved_ids array<string>, relevant_ids array<string>, retrieved_sources array<string>")
    got = {r["id"]: r for r in E.retrieval_metrics(df, LABELS).collect()}
    assert (got[1]["recall_at_k"], got[1]["mrr"], got[1]["recall_at_k_exact"], got[1]["mrr_exact"]) == (0.375, 0.375, 0.0, 0.0)
    assert got[1]["source_hits"] == {"p17": 0.0, "usc26": 1.0} and got[1]["source_recall"] == 0.5
    assert got[2]["recall_at_k"] is None and got[3]["mrr"] is None
    assert got[4]["mrr"] == 0.5 and got[4]["recall_at_k_exact"] == 2.0  # a repeated hit counts again


def test_citation_metrics(spark):
    df = spark.createDataFrame([(1, "By §61. Not §62 or Pub. 17! Fine.", ["26 USC §61"]), (2, "none", ["x"]), (3, None, None)], "id int, response string, retrieved_ids array<string>")
    got = {r["id"]: r for r in E.citation_metrics(df, ["IRS Pub. 17"]).collect()}
    assert (got[1]["n_citations"], got[1]["n_supported"], got[1]["citation_precision"], got[1]["citation_sentences"], got[1]["grounding_rate"]) == (3, 1, 0.3333, 2, 0.5)
    assert got[2]["citation_precision"] is None and got[3]["n_citations"] == 0


def test_fact_citations(spark):
    rows = [(1, "§151(d), §151(d)(1) and §99", ["26 USC §151(d)", "26 USC §2"]), (2, "§1", []), (3, "", []), (4, "", ["26 USC §1"])]
    got = {r["id"]: r for r in E.fact_citations(spark.createDataFrame(rows, "id int, response string, relevant_ids array<string>")).collect()}
    one = got[1]
    assert (one["citation_fact_precision"], one["citation_fact_recall"], one["citation_fact_precision_raw"], one["citation_fact_recall_raw"], one["n_cited_refs_normalized"]) == (0.5, 0.5, 0.3333, 0.5, 2)
    assert (got[2]["citation_fact_precision"], got[2]["citation_fact_recall"]) == (0.0, None) and got[3]["citation_fact_precision"] == 1.0 and got[4]["citation_fact_precision"] == 0.0


def test_scored_cases(spark):
    rows = [
        (1, "label", "Entailment", "By §1. Final Answer: yes", ["26 USC §1"], 1.0),
        (2, "label", "Entailment", "By §9. Final Answer: no", ["26 USC §1"], 0.0),
        (3, "numeric", "$1,200", "Step 1: 1000 + 200 = 1200.\nFinal Answer: $1,200", [], 1.0),
        (4, "numeric", "1200", "Final Answer: 1200", ["26 USC §1"], 0.6),
        (5, "string", "married", "They are MARRIED.", ["26 USC §1"], 0.75),
        (6, "freeform", "", "anything", [], None),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "id int, expected_type string, expected string, response string, relevant_ids array<string>")
    got = {r["id"]: r["earned"] for r in E.scored_cases(df).collect()}
    for i, *_, earned in rows:
        assert got[i] == (pytest.approx(earned) if earned is not None else None)


def test_summaries(spark):
    rows = [("d", "m", "none", "1", 0.5, 1.0, 1.0, "unknown"), ("d", "m", "none", "2", None, 1.0, 0.0, None), ("d", "m", "hybrid", "1", 0.5, 1.0, None, "entailment"), ("d", "m", "hybrid", "2", 1.0, 1.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "dataset string, model string, mode string, case_id string, earned double, total double, answer_correct double, predicted_label string")
    summary = E.mode_summary(df, ("answer_correct",))
    by = {r["mode"]: r for r in summary.collect()}
    assert (by["none"]["score_pct"], by["none"]["n_scored"], by["none"]["answer_correct"], by["none"]["unknown_rate"]) == (50.0, 1, 0.5, 1.0)
    delta = E.mode_deltas(summary).first()
    assert (delta["score_pct"], delta["answer_correct"], delta["unknown_rate"]) == (25.0, 0.5, -1.0)
    assert {(r["case_id"], r["mode"]) for r in E.case_winners(df).collect()} == {("1", "none"), ("2", "hybrid")}
    hits = spark.createDataFrame([({"a": 1.0},), ({"a": 0.0, "b": 1.0},), (None,)], "source_hits map<string,double>")
    assert {tuple(r) for r in E.source_hit_means(hits).collect()} == {("a", 0.5), ("b", 1.0)}
