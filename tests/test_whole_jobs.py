"""Queries that take all rows of their tables, on small tables of their own."""

from __future__ import annotations

import pytest

from corpuskiln.operators import audit
from corpuskiln.operators.components import connected_components
from corpuskiln.plans import queries as core


def test_hybrid_merge_takes_every_row_of_the_label(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 1)] + [(i, [0.0, 1.0], 2) for i in range(1, 40)] + [(i, [-1.0, 0.0], 1) for i in (44, 49, 54, 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = core.queries()["hybrid_merge"](spark, str(tmp_path)).collect()
    assert {"v44", "v54", "v64"} <= {r["section_id"] for r in found}  # none of them in seven steps
    assert [r["section_id"] for r in sorted(found, key=lambda r: r["rank"])][:5] == ["v0", "v44", "v49", "v54", "v64"]


def test_page_chunks_keeps_every_section(spark, tmp_path):
    rows = [("p17", 3, f"p17/page/3/section/{i:02d}", f"Line {i}\n" + f"Word{i} fills the section. " * 8) for i in range(1, 26)]
    spark.createDataFrame(rows, "source string, page_start int, hierarchy string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("p17", "IRS Pub. 17")], "source string, label string").write.parquet(f"{tmp_path}/source_labels.parquet")
    found = " ".join(r["text"] for r in core.queries()["page_chunks"](spark, str(tmp_path)).collect())
    assert [i for i in range(1, 26) if f"Word{i} " not in found] == []


def test_prompt_assembly_takes_every_source(spark, tmp_path):
    rows = [("usc26", "h", "1", "26 USC §1", "Tax."), ("p8417", "h", "2", "IRS Pub. 8417: a", "Two."), ("p8417", "h", "1", "IRS Pub. 8417: a", "One."), (None, "h", "3", "b", "None.")]
    spark.createDataFrame(rows, "source string, hierarchy string, id string, section_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    found = {r["section_id"]: r["prompt"] for r in core.queries()["prompt_assembly"](spark, str(tmp_path)).collect()}
    assert set(found) == {"26 USC §1", "IRS Pub. 8417: a", "b"}
    assert found["IRS Pub. 8417: a"].index("One.") < found["IRS Pub. 8417: a"].index("Two.")


def test_unsettled_loops_say_so(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", "x") for i in range(20)], "src string, dst string, type string")
    with pytest.raises(RuntimeError, match="not settled after 1 rounds"):
        connected_components(edges.select("src", "dst"), max_rounds=1)
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(21)], "section_id string")
    with pytest.warns(RuntimeWarning, match="not settled after 1 rounds"):
        audit.communities(nodes, edges, rounds=1)
