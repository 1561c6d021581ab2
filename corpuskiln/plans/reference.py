"""Queries of the retrieval engine's own operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskiln.functions import refs, text
from corpuskiln.operators import audit, evaluation, graph, linking, retrieval, vectors
from corpuskiln.operators.components import connected_components
from corpuskiln.session import durable, table
from corpuskiln.sources import documents

#: Source labels are taken to the driver up to this many.
MOST_LABELS = 10_000


def source_labels(spark: SparkSession, folder: str) -> dict[str, str]:
    """source -> label, a table of bounded size."""
    rows = table(spark, folder, "source_labels").where("source is not null and label is not null").select("source", "label").orderBy("source").limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} source labels")
    return {r["source"]: r["label"] for r in rows}


def usc_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Citations in the texts and references of chunks."""
    told = F.concat_ws(" and section ", "text", F.array_join(F.transform("cross_refs", lambda r: F.replace(r, F.lit("26 USC §"), F.lit(""))), " and section "))
    return table(spark, folder, "chunks").select("id", F.explode(refs.usc_refs(told)).alias("ref")).distinct()


def irs_refs(spark: SparkSession, folder: str) -> DataFrame:
    labels = list(source_labels(spark, folder).values())
    return table(spark, folder, "chunks").select("id", F.explode(refs.irs_refs("text", labels)).alias("ref")).distinct()


def query_refs(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "edges").where("dst is not null").select("edge_id", F.concat(F.lit("what about section "), F.replace("dst", F.lit("26 USC §"), F.lit(""))).alias("q")).distinct()
    return asked.select("edge_id", F.explode(refs.query_section_refs("q")).alias("ref"))


def canonical_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Statute paths built from citations, and the citations read back."""
    path = F.concat(F.lit("/us/usc/t26/stA/s"), F.regexp_replace(F.regexp_replace(F.replace("dst", F.lit("26 USC §"), F.lit("")), r"\)", ""), r"\(", "/"))
    rows = table(spark, folder, "edges").where(F.col("dst").startswith("26 USC §")).select("edge_id", path.alias("path")).distinct()
    return rows.select("edge_id", "path", refs.canonical_id("path").alias("ref"))


def ref_match_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "edges").where("src is not null and dst is not null").select("edge_id", "src", "dst").distinct()
    return rows.select("edge_id", "src", "dst", refs.match_score("src", "dst").alias("score"))


def source_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").where("source is not null and source <> ''").groupBy("source").agg(F.count("*").alias("n_chunks"), F.countDistinct("section_id").alias("n_sections"))


def format_counts(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "source_labels").select("source", "format")
    return table(spark, folder, "chunks").join(labels, "source", "left").groupBy(F.coalesce("format", F.lit("statute")).alias("format")).agg(F.count("*").alias("n_chunks"))


def source_precedence(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "source_labels").where("source is not null")
    built = [F.concat(F.lit("/k/"), "source", F.lit("/"), "source", F.lit(".xml")), F.concat(F.lit("/k/"), "source", F.lit(".xml")), F.concat(F.lit("/k/"), "source", F.lit("--2024.pdf"))]
    kept = F.when(F.col("format") == "xml", F.array(*built[:2])).otherwise(F.array(*built[1:]))
    return documents.discover(labels.select(F.explode(kept).alias("path")), excluded=("p8417",))


def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("doc_id is not null").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "sentence"))


def chunk_greedy(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(text.packed_sentences("text")).alias("part", "text"))


def slide_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(text.slide_windows("text", 1400, 180)).alias("pos", "w")).select("doc_id", "pos", F.md5("w").alias("digest"))


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").where("page_start is not null and text is not null").select("id", "text").distinct()
    lines = rows.select("id", F.posexplode(text.page_lines("text")).alias("pos", "line"))
    return lines.select("id", "pos", "line", text.is_heading("line").alias("is_heading"))


def page_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each PDF chunk, as a page of its own, parsed into sections, windows and chunks."""
    rows = table(spark, folder, "chunks").where("page_start is not null and text is not null").select("source", F.col("page_start").alias("page"), "hierarchy", "text").distinct()
    pages = rows.withColumn("file", F.concat_ws(":", "hierarchy", F.md5("text")))
    return documents.chunks_of_pages(pages, source_labels(spark, folder)).select("id", "section_id", "title", "text", "page_start")


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("doc_id is not null").select("doc_id", F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(":"), F.col("doc_id").cast("string"))), 1, 12).alias("id")).distinct()


def node_last_write(spark: SparkSession, folder: str) -> DataFrame:
    return graph.graph_nodes(table(spark, folder, "chunks")).select("section_id", "node_ord", "title", "source", "snippet")


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, folder, "chunks")
    nodes = durable(graph.graph_nodes(chunks))
    return nodes, durable(graph.graph_edges(chunks, nodes))


def prefix_index(spark: SparkSession, folder: str) -> DataFrame:
    return graph.prefix_index(graph.graph_nodes(table(spark, folder, "chunks")))


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks")
    return graph.graph_edges(chunks, graph.graph_nodes(chunks))


def representatives(spark: SparkSession, folder: str) -> DataFrame:
    return linking.representatives(graph.graph_nodes(table(spark, folder, "chunks")), 3).select("source", "section_id", F.col("_rank").alias("place"))


def inferred_sections(spark: SparkSession, folder: str) -> DataFrame:
    return linking.inferred_sections(*_graph(spark, folder))


def inferred_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return linking.inferred_pairs(*_graph(spark, folder))


def _linked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _graph(spark, folder)
    whole = durable(linking.with_coverage(edges, linking.inferred_coverage(nodes, edges), linking.inferred_cross_source(nodes, edges)))
    return nodes, durable(linking.with_coverage(whole, linking.fallback_coverage(nodes, whole)))


def linked_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The graph with inferred coverage and the fallback."""
    return _linked(spark, folder)[1]


def curated_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage from a curated table, here the coverage edges' sections and sources."""
    nodes, _ = _graph(spark, folder)
    edges = table(spark, folder, "edges").where("type = 'coverage'")
    of = nodes.select(F.col("section_id").alias("src"), "source")
    curated = edges.join(of, "src").select(refs.usc_root("dst").alias("section"), "source").where("section is not null and source <> 'usc26'").distinct()
    return linking.curated_coverage(nodes, curated).distinct()


def curated_cross_source(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-publication links from curated pairs of sources, here those that coverage edges join."""
    nodes, _ = _graph(spark, folder)
    of = nodes.where("source <> 'usc26'").select("section_id", "source")
    a, b = of.select(F.col("section_id").alias("src"), F.col("source").alias("source_a")), of.select(F.col("section_id").alias("dst"), F.col("source").alias("source_b"))
    pairs = table(spark, folder, "edges").where("type = 'coverage'").join(a, "src").join(b, "dst").where("source_a <> source_b").select("source_a", "source_b").distinct()
    return linking.curated_cross_source(nodes, pairs).distinct()


def bfs_hops(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes within two links of each statute root."""
    edges = table(spark, folder, "edges").where("src is not null and dst is not null")
    starts = edges.where(F.col("dst").rlike(r"^26 USC §[0-9]+[A-Z]?$")).select(F.col("dst").alias("node")).distinct()
    return graph.neighbourhood(edges, starts, 2)


def components(spark: SparkSession, folder: str) -> DataFrame:
    found = connected_components(table(spark, folder, "edges").select("src", "dst"))
    return found.groupBy("component").agg(F.count("*").alias("size"))


def audit_sources(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_sources(*_linked(spark, folder)).withColumn("external_sources", F.array_join("external_sources", ","))


def audit_report(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _linked(spark, folder)
    return audit.audit_report(nodes, edges, audit.audit_sources(nodes, edges))


def communities(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _linked(spark, folder)
    found = audit.community_summaries(nodes, durable(audit.communities(nodes, edges)))
    return found.withColumn("keywords", F.array_join("keywords", " "))


def degree_top_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    edges = table(spark, folder, "edges").where("src is not null and dst is not null").select("src", "dst", F.coalesce("type", F.lit("")).alias("type")).distinct()
    return graph.top_degree_subgraph(edges, 100)


def topic_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """The section titles with most words in common with each held-out question, three each."""
    words = table(spark, folder, "eval_cases").select("item_id", F.explode(text.topic_words("question")).alias("word"))
    titles = table(spark, folder, "chunks").select("section_id", F.explode(text.topic_words("title")).alias("word")).where("section_id is not null").distinct()
    order = Window.partitionBy("item_id").orderBy(F.desc("n"), "section_id")
    counted = words.join(titles, "word").groupBy("item_id", "section_id").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(order)).where("place <= 3")


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "embeddings")
    return rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows, asked = _vectors(spark, folder)
    return vectors.top_k(rows, asked, 10).withColumn("score", F.round("score", 4))


def dual_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows, asked = _vectors(spark, folder)
    both = rows.select("vec_id", F.col("embedding").alias("content_vec"), F.reverse("embedding").alias("name_vec"))
    return vectors.dual_top_k(both, asked, 10).withColumn("score", F.round("score", 4))


def _blended(asked: DataFrame, v: DataFrame, g: DataFrame) -> DataFrame:
    queries = asked.select("query_id", F.when(F.col("query_id") % 200 == 0, F.lit("see section 32")).otherwise(F.lit("no citation here")).alias("text"))
    merged = retrieval.merged_hits(queries, v, g, 10)
    return merged.withColumn("score", F.round("score", 4)).select("query_id", "section_id", "rank", "score")


def hybrid_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Vector hits blended with scores of all rows of the query's own label group.

    Queries of a label share its graph hits, so a label's best rows are ranked once. Of them
    10 + 20 are enough: 20 at most are vector hits too, and no row after 10 others can come in
    by its graph score alone. Vector hits of the query's label get their scores by a join.
    """
    rows, asked = _vectors(spark, folder)
    v = durable(vectors.top_k(rows, asked, 20).select("query_id", F.concat(F.lit("v"), F.col("item").cast("string")).alias("section_id"), F.round("score", 4).alias("vector_score")))
    labels = rows.where("vec_id % 100 = 0 and label is not null").select(F.col("vec_id").alias("query_id"), "label")
    scored = rows.where("label is not null").select("label", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("section_id"), (0.3 + (F.col("vec_id") % 5) * 0.1).alias("graph_score")).distinct()
    order = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("graph_score"), "section_id"))
    best = scored.withColumn("_n", order).where("_n <= 30").drop("_n")
    alone = best.join(labels, "label").select("query_id", "section_id", "graph_score")
    both = scored.join(v.join(labels, "query_id").select("query_id", "section_id", "label"), ["label", "section_id"]).select("query_id", "section_id", "graph_score")
    return _blended(asked, v, alone.unionByName(both))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_cases").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "question", "rubric").alias("text"))


def entry_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.entry_nodes(_questions(spark, folder), graph.graph_nodes(table(spark, folder, "chunks")))


def graph_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Entry nodes of held-out questions and all within two links of them, ranked."""
    return retrieval.graph_hits(_questions(spark, folder), *_linked(spark, folder), 2).drop("snippet")


def neighbour_priorities(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _linked(spark, folder)
    asked = _questions(spark, folder)
    pairs = retrieval.entry_nodes(asked, nodes).select("query_id", "node")
    return retrieval.neighbour_priorities(asked, nodes, edges, pairs).withColumn("priority", F.round("priority", 6))


def community_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The communities that answer broad questions best; a community here is a source."""
    nodes = durable(graph.graph_nodes(table(spark, folder, "chunks")))
    groups = nodes.where("source <> ''").select("source").distinct().withColumn("community_id", F.row_number().over(Window.orderBy("source")) - 1)  # a few sources
    found = audit.community_summaries(nodes, nodes.join(groups, "source").select("section_id", "community_id"))
    cases = table(spark, folder, "eval_cases").where("item_id % 100 = 0")
    short = cases.select(F.col("item_id").alias("query_id"), F.regexp_replace("question", r"\?.*$", "").alias("text"))
    words = F.array_join(F.slice(F.regexp_extract_all("rubric", F.lit("([a-zA-Z]{5,})"), 1), 1, 8), " ")
    asked = short.unionByName(cases.select((F.col("item_id") + 1000).alias("query_id"), F.concat(F.lit("the "), words).alias("text")))
    return retrieval.community_hits(asked, found).drop("snippet")


def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out questions answered by vector search over chunk texts blended with graph retrieval."""
    chunks = table(spark, folder, "chunks").where("section_id is not null and text is not null")
    nodes, edges = _linked(spark, folder)
    embed = vectors.hashing_embedder(128)
    rows = vectors.embedded(chunks.select("chunk_ord", "section_id", "text"), "text", "v", embed)
    asked = _questions(spark, folder)
    queries = vectors.embedded(asked, "text", "query_vector", embed)
    v = vectors.top_k(rows, queries, 10, item="chunk_ord", vector="v").select("query_id", F.col("item").alias("chunk_ord"), F.col("score").alias("vector_score"))
    v = v.join(chunks.select("chunk_ord", "section_id"), "chunk_ord").select("query_id", "section_id", "vector_score")
    return retrieval.merged_hits(asked, v, retrieval.graph_hits(asked, nodes, edges, 2), 10)


def _retrieved(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "source_labels").select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("n"))  # 44 rows
    cases = table(spark, folder, "eval_cases").select("item_id", "relevant_ids", "rubric")
    placed = cases.select("item_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: (F.col("item_id") * 7 + j * 5) % 44)).alias("rank", "n"))
    lists = placed.join(labels, "n").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda s: s["label"]).alias("retrieved_ids"))
    return cases.join(lists, "item_id", "left")


def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.retrieval_metrics(_retrieved(spark, folder)).select("item_id", "recall_at_k", "mrr", "recall_at_k_exact", "mrr_exact")


def citation_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluation.citation_metrics(_retrieved(spark, folder).withColumnRenamed("rubric", "response"), list(source_labels(spark, folder).values()))
    return rows.select("item_id", "n_citations", "n_supported", "citation_precision", "citation_sentences", "grounded_sentences", "grounding_rate")


def rubric_totals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_cases").select("item_id", text.rubric_total("rubric").alias("total"), text.rubric_reference("rubric").alias("reference"))


#: Metrics of made-up results, from the event's number modulo these.
_MADE_METRICS = {
    "calculation_steps_present": 2, "citation_fact_precision": 17, "citation_fact_recall": 19, "recall_at_k": 23, "recall_at_k_exact": 29, "mrr_exact": 31, "rouge1": 37, "rouge2": 41, "rougeL": 43, "citation_precision": 47, "grounding_rate": 53,
}


def _results(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    kinds = Window.orderBy("event_type")
    modes = rows.select("event_type").distinct().withColumn("_n", F.row_number().over(kinds) - 1)  # a handful of types
    mode = F.element_at(F.array(*[F.lit(m) for m in retrieval.MODES]), (F.col("_n") % 4 + 1).cast("int"))
    return rows.join(F.broadcast(modes), "event_type").select(
        F.lit("events").alias("dataset"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        mode.alias("mode"),
        F.col("user_id").alias("case_id"),
        F.when(F.col("event_id") % 11 != 0, F.round(F.col("value") % 1, 4)).alias("earned"),
        F.lit(1.0).alias("total"),
        (F.col("event_id") % 2).cast("double").alias("answer_correct"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.round((F.col("event_id") % 10) / 10, 4)).alias("mrr"),
        F.when(F.col("event_id") % 3 == 0, F.lit("unknown")).when(F.col("event_id") % 3 == 1, F.lit("entailment")).alias("predicted_label"),
        (F.col("event_id") % 13 == 0).alias("judge_failed"),
        *[F.when(F.col("event_id") % p != 0, F.round((F.col("event_id") % p) / p, 4)).alias(m) for m, p in _MADE_METRICS.items()],
        "event_id",
    )


def mode_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.mode_summary(_results(spark, folder))


def mode_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.mode_deltas(mode_summary(spark, folder))


def case_winners(spark: SparkSession, folder: str) -> DataFrame:
    best = _results(spark, folder).groupBy("dataset", "model", "case_id", "mode").agg(F.max("earned").alias("earned"))
    return evaluation.case_winners(best)


def _prompts(chunks: DataFrame) -> DataFrame:
    rows = chunks.where("text is not null and section_id is not null").select("hierarchy", "id", "section_id", "text").distinct()
    hits = rows.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("id", "section_id", "text"))).alias("hits"))
    return hits.select("section_id", text.prompt(F.col("hits")).alias("prompt"))


def prompt_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """The prompt block of each section's chunks, of any source."""
    return _prompts(table(spark, folder, "chunks"))


QUERIES = {
    f.__name__: f
    for f in (
        usc_refs, irs_refs, query_refs, canonical_ids, ref_match_scores, source_counts, format_counts, source_precedence, sentence_split, chunk_greedy, slide_windows, page_lines, page_chunks, chunk_ids,
        node_last_write, prefix_index, graph_edges, representatives, inferred_sections, inferred_pairs, linked_edges, curated_coverage, curated_cross_source, bfs_hops, components, audit_sources, audit_report, communities,
        degree_top_subgraph, topic_overlap, vector_topk, dual_topk, hybrid_merge, entry_nodes, graph_hits, neighbour_priorities, community_hits, hybrid_topk, retrieval_metrics, citation_metrics, rubric_totals, mode_summary, mode_deltas, case_winners,
        prompt_assembly,
    )
}

_SECTION = r"(?i)(?:section\s+|§\s*)([0-9]{1,4}[A-Z]?)((?:\([a-z0-9]+\)){1,4})?"
_RANGE = r"(?i)(?:section\s+|§\s*)([0-9]{1,4})\s*[-–]\s*([0-9]{1,4})"


def _cited(source: str, key: str, t: str, prefix: str, lower: bool, bases: bool) -> str:
    low = "lower" if lower else ""
    base = f"UNION SELECT {key}, lower('{prefix}' || n) FROM single" if bases else ""
    return f"""WITH told AS ({source}),
single AS (SELECT {key}, unnest(regexp_extract_all({t}, '{_SECTION}', 1)) AS n, unnest(regexp_extract_all({t}, '{_SECTION}', 2)) AS s FROM told),
ranges AS (SELECT {key}, CAST(unnest(regexp_extract_all({t}, '{_RANGE}', 1)) AS INTEGER) AS a, CAST(unnest(regexp_extract_all({t}, '{_RANGE}', 2)) AS INTEGER) AS b FROM told)
SELECT {key}, {low}('{prefix}' || n || coalesce(s, '')) AS ref FROM single {base}
UNION SELECT {key}, '{prefix}' || i FROM ranges, LATERAL (SELECT unnest(range(a, b + 1)) AS i) WHERE a <= b AND b - a <= 60"""


_NODES = "nodes AS (SELECT section_id, min(chunk_ord) AS node_ord, arg_max(coalesce(title, ''), chunk_ord) AS title, arg_max(coalesce(source, ''), chunk_ord) AS source, arg_max(substr(coalesce(text, ''), 1, 300), chunk_ord) AS snippet FROM chunks WHERE section_id IS NOT NULL GROUP BY section_id)"
_PREFIX = "pre AS (SELECT prefix, section_id FROM (SELECT trim(split_part(section_id, ':', 1)) AS prefix, section_id, row_number() OVER (PARTITION BY trim(split_part(section_id, ':', 1)) ORDER BY length(section_id), node_ord, section_id) AS rn FROM nodes WHERE contains(section_id, ':')) WHERE rn <= 2)"
_EDGES = f"""{_NODES}, {_PREFIX},
refs AS (SELECT section_id, chunk_ord, i - 1 AS place, cross_refs[i] AS ref FROM chunks, LATERAL (SELECT unnest(range(1, len(cross_refs) + 1)) AS i) WHERE section_id IS NOT NULL AND cross_refs[i] IS NOT NULL),
every AS (SELECT parent_id AS src, section_id AS dst, 'hierarchy' AS type, chunk_ord, -1 AS place FROM chunks WHERE section_id IS NOT NULL AND parent_id IN (SELECT section_id FROM nodes)
 UNION ALL SELECT section_id, ref, 'xref', chunk_ord, place FROM refs WHERE ref IN (SELECT section_id FROM nodes)
 UNION ALL SELECT r.section_id, p.section_id, 'xref', chunk_ord, place FROM refs r JOIN pre p ON r.ref = p.prefix WHERE r.ref NOT IN (SELECT section_id FROM nodes)),
edges_of AS (SELECT src, dst, arg_max(type, chunk_ord * 100000 + place) AS type FROM every GROUP BY src, dst),
between AS (SELECT e.src, e.dst, a.source AS src_source, b.source AS dst_source FROM edges_of e JOIN nodes a ON e.src = a.section_id JOIN nodes b ON e.dst = b.section_id WHERE e.type = 'xref')"""
_TOP = "top AS (SELECT q.vec_id AS query_id, i.vec_id AS item, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS s, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(list_reverse(i.embedding) AS DOUBLE[])) AS r FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0)"
_MADE = ", ".join(f"CASE WHEN event_id % {p} <> 0 THEN round((event_id % {p}) / {p}, 4) END AS {m}" for m, p in _MADE_METRICS.items())
_MEANS = ", ".join(f"round(avg({m}), 4) AS {m}" for m in _MADE_METRICS)
_RESULTS = f"""modes AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS n FROM (SELECT DISTINCT event_type FROM events)),
results AS (SELECT 'events' AS dataset, 'm' || (user_id % 3) AS model, (['none', 'vector', 'graph', 'hybrid'])[CAST(n % 4 + 1 AS INTEGER)] AS mode, user_id AS case_id,
 CASE WHEN event_id % 11 <> 0 THEN round(value % 1, 4) END AS earned, CAST(event_id % 2 AS DOUBLE) AS answer_correct, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round((event_id % 10) / 10, 4) END AS mrr,
 CASE event_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'entailment' END AS predicted_label, event_id % 13 = 0 AS judge_failed, {_MADE} FROM events JOIN modes USING (event_type)),
summary AS (SELECT dataset, model, mode, count(*) AS n_cases, count(earned) AS n_scored, count_if(judge_failed) AS n_parse_errors, round(sum(earned) / nullif(count(earned), 0) * 100, 4) AS score_pct, round(avg(answer_correct), 4) AS answer_correct, round(avg(mrr), 4) AS mrr, {_MEANS},
 round(avg(CASE WHEN predicted_label IS NOT NULL THEN CASE WHEN predicted_label = 'unknown' THEN 1.0 ELSE 0.0 END END), 4) AS unknown_rate FROM results GROUP BY ALL)"""
_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0b]"


def _stripped(value: str) -> str:
    return f"regexp_replace(regexp_replace({value}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


SQL = {
    "usc_refs": _cited("SELECT id, concat_ws(' and section ', text, array_to_string(list_transform(cross_refs, lambda r: replace(r, '26 USC §', '')), ' and section ')) AS t FROM chunks", "id", "t", "26 USC §", False, False),
    "query_refs": _cited("SELECT DISTINCT edge_id, 'what about section ' || replace(dst, '26 USC §', '') AS t FROM edges WHERE dst IS NOT NULL", "edge_id", "t", "26 usc §", True, True),
    "irs_refs": r"""WITH pubs AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '(?i)(?:publication|pub\.?)\s+([0-9]{1,4}[a-z]?)', 1)) AS x FROM chunks),
forms AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '(?i)form\s+([0-9]{3,5}(?:-[a-z0-9]{1,4})?)', 1)) AS x FROM chunks),
scheds AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '(?i)(?:schedule|sch\.?)\s+([a-z]{1,4}|[0-9]{1,4})', 1)) AS x FROM chunks)
SELECT id, label AS ref FROM pubs JOIN source_labels ON lower(label) = 'irs pub. ' || lower(x)
UNION SELECT id, label FROM forms JOIN source_labels ON lower(label) = 'form ' || lower(x) || ' instructions' OR replace(lower(label), '-', '') = 'form ' || replace(lower(x), '-', '') || ' instructions'
UNION SELECT id, label FROM scheds JOIN source_labels ON lower(label) = 'sch. ' || lower(x) || ' instructions'""",
    "canonical_ids": "SELECT DISTINCT edge_id, '/us/usc/t26/stA/s' || replace(replace(replace(dst, '26 USC §', ''), ')', ''), '(', '/') AS path, dst AS ref FROM edges WHERE starts_with(dst, '26 USC §')",
    "ref_match_scores": r"""WITH p AS (SELECT DISTINCT edge_id, src, dst, lower(src) AS a, lower(dst) AS b FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
q AS (SELECT *, regexp_extract(a, '^26 usc ?§ ?([0-9]{1,4}[a-z]?)', 1) AS sa, regexp_extract(b, '^26 usc ?§ ?([0-9]{1,4}[a-z]?)', 1) AS sb, regexp_extract_all(a, '\(([a-z0-9]+)\)', 1) AS pa, regexp_extract_all(b, '\(([a-z0-9]+)\)', 1) AS pb FROM p)
SELECT edge_id, src, dst, CASE WHEN a = b THEN 1.0 WHEN sa = '' OR sb = '' OR sa <> sb THEN 0.0
 WHEN pa[1:least(len(pa), len(pb))] = pb[1:least(len(pa), len(pb))] THEN CASE WHEN abs(len(pa) - len(pb)) = 1 THEN 0.75 ELSE 0.5 END WHEN pa[1] = pb[1] THEN 0.25 ELSE 0.0 END AS score FROM q""",
    "source_counts": "SELECT source, count(*) AS n_chunks, count(DISTINCT section_id) AS n_sections FROM chunks WHERE source IS NOT NULL AND source <> '' GROUP BY source",
    "format_counts": "SELECT coalesce(format, 'statute') AS format, count(*) AS n_chunks FROM chunks LEFT JOIN source_labels USING (source) GROUP BY 1",
    "source_precedence": "SELECT source, CASE WHEN format = 'xml' THEN '/k/' || source || '/' || source || '.xml' ELSE '/k/' || source || '.xml' END AS path, 'xml' AS format FROM source_labels WHERE regexp_matches(source, '^[pif][0-9]+[a-z0-9]*$') AND source <> 'p8417'",
    "sentence_split": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, s AS sentence FROM (SELECT doc_id, i, {_stripped('parts[i]')} AS s FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){_SPACE}+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)) WHERE s <> ''",
    "slide_windows": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, md5(w) AS digest FROM (SELECT doc_id, i, {_stripped('substr(text, i, 1400)')} AS w FROM documents, LATERAL (SELECT unnest(range(1, greatest(length(text), 1) + 1, 1220)) AS i) WHERE text IS NOT NULL) WHERE w <> ''",
    "chunk_ids": "SELECT DISTINCT doc_id, substr(md5(coalesce(source, '') || ':' || doc_id), 1, 12) AS id FROM documents WHERE doc_id IS NOT NULL",
    "node_last_write": f"WITH {_NODES} SELECT section_id, node_ord, title, source, snippet FROM nodes",
    "prefix_index": f"WITH {_NODES}, {_PREFIX} SELECT * FROM pre",
    "graph_edges": f"WITH {_EDGES} SELECT * FROM edges_of",
    "representatives": f"WITH {_NODES} SELECT source, section_id, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(title), length(section_id), section_id) AS place FROM nodes WHERE source <> '') WHERE place <= 3",
    "inferred_sections": rf"""WITH {_EDGES},
counted AS (SELECT src_source AS source, regexp_extract(dst, '^(26 USC §[0-9]+[A-Z]?)', 1) AS section, count(*) AS support FROM between WHERE src_source NOT IN ('', 'usc26') AND dst_source = 'usc26' GROUP BY ALL),
ranked AS (SELECT *, max(support) OVER (PARTITION BY source) AS most, row_number() OVER (PARTITION BY source ORDER BY support DESC, section) AS rn FROM counted WHERE section <> '')
SELECT source, section, support FROM ranked WHERE (support >= 2 AND rn <= 8) OR (most < 2 AND rn <= 2)""",
    "inferred_pairs": f"WITH {_EDGES} SELECT src_source AS source_a, dst_source AS source_b, count(*) AS support FROM between WHERE src_source NOT IN ('', 'usc26') AND dst_source NOT IN ('', 'usc26') AND src_source <> dst_source GROUP BY ALL HAVING count(*) >= 2",
    "bfs_hops": """WITH links AS (SELECT src AS a, dst AS b FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst UNION SELECT dst, src FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
starts AS (SELECT DISTINCT dst AS start FROM edges WHERE src IS NOT NULL AND regexp_matches(dst, '^26 USC §[0-9]+[A-Z]?$')),
one AS (SELECT DISTINCT start, b AS node, 1 AS hop FROM starts JOIN links ON start = a WHERE b <> start),
two AS (SELECT DISTINCT start, b AS node, 2 AS hop FROM one JOIN links ON node = a WHERE b <> start)
SELECT start, node, min(hop) AS hop FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY start, node""",
    "components": """WITH RECURSIVE links AS (SELECT src AS a, dst AS b FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT dst, src FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
reach AS (SELECT DISTINCT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
found AS (SELECT node, min(other) AS component FROM reach GROUP BY node) SELECT component, count(*) AS size FROM found GROUP BY component""",
    "degree_top_subgraph": """WITH e AS (SELECT DISTINCT src, dst, coalesce(type, '') AS type FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
d AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node), t AS (SELECT node FROM d ORDER BY n DESC, node LIMIT 100)
SELECT * FROM e WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)""",
    "topic_overlap": """WITH w AS (SELECT DISTINCT item_id, lower(unnest(regexp_extract_all(question, '[a-zA-Z]{4,}'))) AS word FROM eval_cases),
t AS (SELECT DISTINCT section_id, lower(unnest(regexp_extract_all(title, '[a-zA-Z]{4,}'))) AS word FROM chunks WHERE section_id IS NOT NULL),
c AS (SELECT item_id, section_id, count(*) AS n FROM w JOIN t USING (word) GROUP BY ALL)
SELECT item_id, section_id, n, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, section_id) AS place FROM c) WHERE place <= 3""",
    "vector_topk": f"WITH {_TOP} SELECT query_id, item, round(s, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item) AS rank FROM top) WHERE rank <= 10",
    "dual_topk": f"WITH {_TOP}, a AS (SELECT query_id, item, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item) AS n FROM top) WHERE n <= 10), b AS (SELECT query_id, item, greatest(r, 0.0) AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, item) AS n FROM top) WHERE n <= 10) SELECT query_id, item, round(max(s), 4) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL",
    "hybrid_merge": f"""WITH {_TOP}, v AS (SELECT query_id, 'v' || item AS section_id, round(s, 4) AS vs FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item) AS n FROM top) WHERE n <= 20),
g AS (SELECT q.vec_id AS query_id, 'v' || i.vec_id AS section_id, 0.3 + (i.vec_id % 5) * 0.1 AS gs FROM embeddings q JOIN embeddings i ON q.label = i.label WHERE q.vec_id % 100 = 0),
m AS (SELECT query_id, section_id, vs IS NULL AS only_g, CASE WHEN query_id % 200 = 0 THEN 0.35::DOUBLE ELSE 0.6::DOUBLE END AS al, coalesce(vs, 0.0)::DOUBLE AS vs, coalesce(gs, 0.0)::DOUBLE AS gs FROM v FULL JOIN g USING (query_id, section_id)),
s AS (SELECT query_id, section_id, only_g, al * vs + (1 - al) * gs AS score FROM m)
SELECT query_id, section_id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, only_g, section_id) AS rank FROM s) WHERE rank <= 10""",
    "retrieval_metrics": """WITH l AS (SELECT lower(label) AS label, row_number() OVER (ORDER BY label) - 1 AS n FROM source_labels),
got AS (SELECT item_id, j + 1 AS rank, label FROM eval_cases, LATERAL (SELECT unnest(range(0, 10)) AS j) JOIN l ON (item_id * 7 + j * 5) % 44 = n),
want AS (SELECT DISTINCT item_id, lower(unnest(relevant_ids)) AS label FROM eval_cases), size AS (SELECT item_id, count(*) AS n FROM want GROUP BY item_id),
hit AS (SELECT item_id, count(*) AS h, min(rank) AS r FROM got JOIN want USING (item_id, label) GROUP BY item_id)
SELECT item_id, round(coalesce(h, 0) / n, 4) AS recall_at_k, round(coalesce(1.0 / r, 0.0), 4) AS mrr, round(coalesce(h, 0) / n, 4) AS recall_at_k_exact, round(coalesce(1.0 / r, 0.0), 4) AS mrr_exact FROM eval_cases LEFT JOIN size USING (item_id) LEFT JOIN hit USING (item_id)""",
    "rubric_totals": r"SELECT item_id, round(coalesce(list_sum(list_transform(regexp_extract_all(coalesce(rubric, ''), '\[\+([0-9]+(?:\.[0-9]+)?)\]', 1), lambda x: CAST(x AS DOUBLE))), 0.0), 4) AS total, trim(regexp_replace(coalesce(rubric, ''), '\[\+[0-9]+(?:\.[0-9]+)?\]\s*', '', 'g')) AS reference FROM eval_cases",
    "mode_summary": f"WITH {_RESULTS} SELECT * FROM summary",
    "mode_deltas": f"WITH {_RESULTS} SELECT a.dataset, a.model, round(a.score_pct - b.score_pct, 4) AS score_pct, round(a.answer_correct - b.answer_correct, 4) AS answer_correct, round(a.mrr - b.mrr, 4) AS mrr, {', '.join(f'round(a.{m} - b.{m}, 4) AS {m}' for m in _MADE_METRICS)}, round(a.unknown_rate - b.unknown_rate, 4) AS unknown_rate FROM summary a JOIN summary b ON a.dataset = b.dataset AND a.model = b.model WHERE a.mode = 'hybrid' AND b.mode = 'none'",
    "case_winners": f"WITH {_RESULTS}, best AS (SELECT dataset, model, case_id, mode, max(earned) AS earned FROM results GROUP BY ALL) SELECT dataset, model, case_id, mode, earned FROM (SELECT *, row_number() OVER (PARTITION BY dataset, model, case_id ORDER BY earned DESC NULLS LAST, list_position(['none', 'vector', 'graph', 'hybrid'], mode)) AS rn FROM best) WHERE rn = 1",
    "prompt_assembly": "SELECT section_id, string_agg('[' || section_id || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY id, text) AS prompt FROM (SELECT DISTINCT hierarchy, id, section_id, text FROM chunks WHERE text IS NOT NULL AND section_id IS NOT NULL) GROUP BY section_id",
}
