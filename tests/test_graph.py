"""The hand-made corpus of eight chunks: nodes, edges, linking, traversal, entry nodes, ranking and audit."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskiln.operators import audit, graph, linking, retrieval, vectors

CHUNKS = [
    (0, "c0", "26 USC §32(a)", "usc26", "Earned income", "Allowance of credit. More.", "26 USC §32", []),
    (1, "c1", "26 USC §61", "usc26", "Gross income defined", "All income.", None, []),
    (2, "c2", "26 USC §25A", "usc26", "American opportunity", "Education.", None, []),
    (3, "c3", "26 USC §213", "usc26", "Medical expenses", "Care.", None, []),
    (4, "c4", "IRS Pub. 596: Intro", "p596", "Intro", "See §32(a) and Publication 17.", None, ["26 USC §32(a)", "IRS Pub. 17", "nothing"]),
    (5, "c5", "IRS Pub. 596: Rules", "p596", "Rules", "sections 61", "IRS Pub. 596: Intro", ["26 USC §32(a)"]),
    (6, "c6", "IRS Pub. 17: Overview", "p17", "Overview", "part one", None, []),
    (7, "c6b", "IRS Pub. 17: Overview", "p17", "Overview again", "part two", None, []),
    (8, "c7", "Sch. C Instructions: Misc", "i1040sc", "Misc", "Gross income of a business.", None, []),
]
SCHEMA = "chunk_ord long, id string, section_id string, source string, title string, text string, parent_id string, cross_refs array<string>"


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = spark.createDataFrame(CHUNKS, SCHEMA)
    nodes = graph.graph_nodes(chunks).cache()
    return nodes, graph.graph_edges(chunks, nodes).cache()


def found(df):
    return {tuple(r) for r in df.collect()}


def test_nodes_and_edges(corpus):
    nodes, edges = corpus
    last = nodes.where("section_id = 'IRS Pub. 17: Overview'").first()
    assert (last["id"], last["title"], last["node_ord"], nodes.count()) == ("c6b", "Overview again", 6, 8)
    assert found(edges) == {
        ("IRS Pub. 596: Intro", "26 USC §32(a)", "xref"),
        ("IRS Pub. 596: Intro", "IRS Pub. 17: Overview", "xref"),
        ("IRS Pub. 596: Rules", "26 USC §32(a)", "xref"),
        ("IRS Pub. 596: Intro", "IRS Pub. 596: Rules", "hierarchy"),
    }


def test_inferred_links_and_fallback(corpus):
    nodes, edges = corpus
    assert found(linking.inferred_sections(nodes, edges)) == {("p596", "26 USC §32", 2)}
    assert linking.inferred_pairs(nodes, edges).count() == 0
    cover = found(linking.inferred_coverage(nodes, edges))
    assert ("26 USC §32(a)", "IRS Pub. 596: Rules") in cover and len(cover) == 4
    counts = {r["source"]: r["n_links"] for r in linking.incident_counts(nodes, edges).collect()}
    assert counts["p596"] == 3 and counts["i1040sc"] == 0
    # "gross" and "income" of the schedule's snippet meet the title of §61.
    assert found(linking.fallback_coverage(nodes, edges)) == {("26 USC §61", "Sch. C Instructions: Misc"), ("Sch. C Instructions: Misc", "26 USC §61")}
    whole = linking.with_coverage(edges, linking.fallback_coverage(nodes, edges), linking.inferred_coverage(nodes, edges))
    assert whole.where("src = 'IRS Pub. 596: Rules' and dst = '26 USC §32(a)'").first()["type"] == "xref"


def test_curated_links(spark, corpus):
    nodes, _ = corpus
    curated = spark.createDataFrame([("26 USC §32", "p596"), ("26 USC §2", "p596"), ("26 USC §61", "none")], "section string, source string")
    assert found(linking.curated_coverage(nodes, curated).where("src like '26%'")) == {("26 USC §32(a)", "IRS Pub. 596: Intro"), ("26 USC §32(a)", "IRS Pub. 596: Rules")}
    pairs = spark.createDataFrame([("p17", "p596")], "source_a string, source_b string")
    assert linking.curated_cross_source(nodes, pairs).count() == 2


def test_hops_match_a_breadth_first_search(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 40, (50, 2))]
    edges = spark.createDataFrame(pairs, "src int, dst int").withColumn("type", F.lit("x"))
    near = {i: set() for i in range(40)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for start in (0, 7):
        level, seen = {start}, {start: 0}
        for hop in (1, 2, 3):
            level = {n for x in level for n in near[x]} - set(seen)
            seen |= {n: hop for n in level}
        got = graph.hops(edges, spark.createDataFrame([(1, start)], "query_id int, node int"), 3)
        assert {r["node"]: r["hop"] for r in got.collect()} == seen
    assert graph.neighbourhood(edges, spark.createDataFrame([(99,)], "node int"), 2).count() == 0


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_entry_nodes(spark, corpus):
    nodes, _ = corpus
    hits = retrieval.entry_nodes(queries(spark, "§32(a) eligibility", "earned income credit", "", "section 151-153"), nodes)
    by = {}
    for r in hits.collect():
        by.setdefault(r["query_id"], {})[r["node"]] = (round(r["raw"], 4), round(r["score"], 4))
    assert by[0] == {"26 USC §32(a)": (7.1, 1.0)}  # the reference, "32" as a word, the statute
    # §213 gets the hint of §21 by prefix; §32(a) has the hint and two words.
    assert by[1]["26 USC §32(a)"] == (6.1, 1.0) and by[1]["26 USC §213"] == (4.1, round(0.6 + 0.4 * 4.1 / 6.1, 4))
    assert len(by[2]) == 8 and 3 not in by


def test_graph_hits_and_hop_scores(spark, corpus):
    nodes, edges = corpus
    hits = {r["section_id"]: (r["hop"], r["graph_score"]) for r in retrieval.graph_hits(queries(spark, "§32(a)"), nodes, edges, 2).collect()}
    assert hits == {"26 USC §32(a)": (0, 1.0), "IRS Pub. 596: Intro": (1, 0.78), "IRS Pub. 596: Rules": (1, 0.78), "IRS Pub. 17: Overview": (2, 0.66)}
    scored = [r[0] for r in spark.createDataFrame([(i,) for i in range(9)], "h int").select(retrieval.hop_score(F.col("h"))).collect()]
    assert np.allclose(scored, [0.90, 0.78, 0.66, 0.56, 0.48, 0.40, 0.32, 0.30, 0.30])


def test_merge_modes_and_alpha(spark):
    asked = queries(spark, "§32 now", "plain words")
    v = spark.createDataFrame([(0, "a", 0.9), (0, "a", 0.5), (1, "a", 0.4), (1, "b", 0.4)], "query_id int, section_id string, vector_score double")
    g = spark.createDataFrame([(0, "g", 1.0), (1, "b", 0.5)], "query_id int, section_id string, graph_score double")
    both = [(r["query_id"], r["section_id"], round(r["score"], 4)) for r in retrieval.retrieve("hybrid", asked, v, g).orderBy("query_id", "rank").collect()]
    assert both == [(0, "g", 0.65), (0, "a", 0.175), (1, "b", 0.44), (1, "a", 0.24)]
    assert retrieval.merged_hits(asked, v, g, keep_worst=False).where("section_id = 'a' and query_id = 0").first()["vector_score"] == 0.9
    assert retrieval.retrieve("none", asked, v, g).count() == 0 and retrieval.retrieve("vector", asked, v, g).count() == 3
    with pytest.raises(ValueError):
        retrieval.retrieve("other", asked, v, g)


def test_communities_and_audit(spark, corpus):
    nodes, edges = corpus
    members = audit.communities(nodes, edges)
    groups = {r["section_id"]: r["community_id"] for r in members.collect()}
    assert len(groups) == 8 and groups["IRS Pub. 596: Intro"] == groups["IRS Pub. 596: Rules"]
    told = audit.community_summaries(nodes, members)
    first = told.orderBy("community_id").first()
    assert first["summary"].startswith("[26 USC §32(a)] Earned income") and "earned" in first["keywords"]
    hits = retrieval.community_hits(queries(spark, "earned income"), told).collect()
    assert hits and hits[0]["graph_score"] == 0.9 and hits[0]["section_id"].startswith("community:")
    sources = audit.audit_sources(nodes, edges)
    by = {r["source"]: r for r in sources.collect()}
    assert by["i1040sc"]["is_disconnected"] and not by["p596"]["is_disconnected"] and by["p596"]["external_sources"] == ["p17", "usc26"]
    with pytest.raises(audit.CoverageError):
        audit.require_coverage(audit.audit_report(nodes, edges, sources))


def test_planted_communities(spark):
    links = [(f"{g}{i}", f"{g}{j}", "x") for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0", "x")]
    edges = spark.createDataFrame(links, "src string, dst string, type string")
    nodes = edges.select(F.col("src").alias("section_id")).union(edges.select("dst")).distinct()
    groups = {r["section_id"]: r["community_id"] for r in audit.communities(nodes, edges).collect()}
    assert len({groups[f"a{i}"] for i in range(6)}) == 1 and len({groups[f"b{i}"] for i in range(6)}) == 1 and groups["a1"] != groups["b1"]


def test_vector_search_matches_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[10] = m[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "vec_id long, embedding array<float>").repartition(5)
    asked = df.where("vec_id in (3, 10)").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    got = {}
    for r in vectors.top_k(df, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item"])
    for q in (3, 10):
        s = m.astype(float) @ m[q].astype(float)
        assert got[q] == sorted(range(60), key=lambda i: (-s[i], i))[:5]
    assert got[10][:2] == [10, 20] and vectors.top_k(df, asked, 500).count() == 120
    dual = vectors.dual_top_k(df.selectExpr("vec_id", "embedding AS content_vec", "transform(embedding, x -> -x) AS name_vec"), asked, 3)
    assert dual.where("score < 0").count() == 0 and dual.count() <= 12
    made = vectors.embedded(spark.createDataFrame([("x y",), (None,)], "t string"), "t", "v", vectors.hashing_embedder(16)).collect()
    assert abs(sum(x * x for x in made[0]["v"]) - 1) < 1e-5 and len(made[1]["v"]) == 16


def test_degrees(spark, corpus):
    _, edges = corpus
    assert {r["node"]: r["degree"] for r in graph.degrees(edges).collect()}["IRS Pub. 596: Intro"] == 3
    assert graph.top_degree_subgraph(edges, 2).count() == 1 and graph.top_degree_subgraph(edges, 0).count() == 4


def test_priorities_explain_only(spark, corpus):
    nodes, edges = corpus
    pairs = spark.createDataFrame([(0, "IRS Pub. 596: Intro")], "query_id int, node string")
    ranked = {r["neighbour"]: round(r["priority"], 2) for r in retrieval.neighbour_priorities(queries(spark, "earned income"), nodes, edges, pairs).collect()}
    assert ranked == {"26 USC §32(a)": 3.55, "IRS Pub. 17: Overview": 3.0, "IRS Pub. 596: Rules": 1.8}
