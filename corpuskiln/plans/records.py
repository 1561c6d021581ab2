"""Queries of the record operators: nested records (p2), hierarchies (p4) and orphan references (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.operators import hierarchy, nested, orphans
from corpuskiln.session import durable, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    labelled = nested.nodes(table(spark, folder, "chunks"), "id", "metadata.blocks", "ingested_at", attributes=False)
    return nested.linked(labelled, 3).select("id", "path", "parent_path")


def p2_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes with their interval labels and fields."""
    labelled = nested.nodes(table(spark, folder, "chunks"), "id", "metadata.blocks", "ingested_at")
    rows = nested.linked(labelled, 3)
    return rows.select(
        "id", "type", "path", "depth", "pre", "post", "last", "parent_pre", "parent_path",
        F.col("blocks.block_id").alias("block_id"), F.col("blocks.kind").alias("kind"),
        F.col("blocks_items.item_no").alias("item_no"), F.col("blocks_items.label").alias("label"), F.col("blocks_items.note").alias("note"),
        F.col("blocks_items_marks.code").alias("code"), F.col("blocks_items_marks.value").alias("value"),
    )


def _typed(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    labelled = nested.linked(nested.nodes(table(spark, folder, "chunks"), "id", "metadata.blocks", "ingested_at"), 3)
    return nested.node_table(labelled, kind)


def p2_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The node table of blocks."""
    return _typed(spark, folder, "blocks")


def p2_items(spark: SparkSession, folder: str) -> DataFrame:
    """The node table of items, each with its block's label and path."""
    return _typed(spark, folder, "blocks.items")


def p2_marks(spark: SparkSession, folder: str) -> DataFrame:
    """The node table of marks, each with its item's label and path."""
    return _typed(spark, folder, "blocks.items.marks")


def p2_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table of the nested records, with the page and section that hierarchy spells out."""
    chunks = table(spark, folder, "chunks").where("metadata is not null")
    rows = nested.newest(chunks.select("id", "source", "hierarchy", "ingested_at", "metadata"), "id", "ingested_at")
    part = lambda name: F.expr(f"try_cast(nullif(regexp_extract(hierarchy, '/{name}/([0-9]+)', 1), '') AS int)")
    return rows.select(
        "id", "source", "hierarchy", part("page").alias("hierarchy_page"), part("section").alias("hierarchy_section"),
        "metadata.parser", "metadata.source_file", "metadata.page", "metadata.section_index", "metadata.window_index", "metadata.section_heading",
    )


def _sections(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    links = durable(hierarchy.parent_links(table(spark, folder, "chunks")))
    return links, hierarchy.roots(links)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    _, resolved = _sections(spark, folder)
    return resolved.select(F.col("node").alias("section_id"), F.coalesce("root", F.lit("")).alias("root_id"), F.col("depth").cast("int").alias("depth"))


def p4_paths(spark: SparkSession, folder: str) -> DataFrame:
    links, resolved = _sections(spark, folder)
    chains = hierarchy.ancestor_chains(links, durable(resolved))
    return chains.select(F.col("node").alias("section_id"), F.array_join("chain", " > ").alias("path"), (F.size("chain") - 1).alias("depth"))


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    links, resolved = _sections(spark, folder)
    below = hierarchy.descendants(hierarchy.ancestor_chains(links, durable(resolved)))
    return below.select(F.col("node").alias("section_id"), F.col("descendant").alias("descendant_id"), "distance")


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks, edges = table(spark, folder, "chunks"), table(spark, folder, "edges")
    first = chunks.where("id is not null").groupBy("id").agg(F.min("ingested_at").alias("at"))
    named = chunks.where("id is not null").select("id", F.explode("cross_refs").alias("ref")).where("ref is not null").distinct()
    of_chunks = named.join(first, "id").select(F.lit("chunks").alias("table_name"), F.col("id").alias("record_id"), "ref", "at")
    of_edges = (
        edges.where("edge_id is not null and dst is not null")
        .groupBy("edge_id", F.col("dst").alias("ref"))
        .agg(F.min("seen_at").alias("at"))
        .select(F.lit("edges").alias("table_name"), F.col("edge_id").cast("string").alias("record_id"), "ref", "at")
    )
    references = orphans.without_labels(of_chunks.unionByName(of_edges), table(spark, folder, "source_labels"))
    existing = chunks.select(F.col("section_id").alias("key"), F.col("ingested_at").alias("at"))
    retired = table(spark, folder, "retired_sections").select(F.col("section_id").alias("key"))
    return references, existing, retired


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_references(*_references(spark, folder))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_report(p6_found(spark, folder))


QUERIES = {f.__name__: f for f in (p2_found, p2_nodes, p2_blocks, p2_items, p2_marks, p2_chunks, p4_found, p4_paths, p4_descendants, p6_found, p6_report)}

_NEWEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM chunks WHERE id IS NOT NULL) WHERE rn = 1"
_NODES = f"""WITH newest AS ({_NEWEST}),
b AS (SELECT id, metadata.blocks[i] AS b, CAST(i - 1 AS VARCHAR) AS path FROM newest, LATERAL (SELECT unnest(range(1, len(metadata.blocks) + 1)) AS i)),
it AS (SELECT id, b.items[i] AS it, path || '.' || (i - 1) AS path, path AS parent_path FROM b, LATERAL (SELECT unnest(range(1, len(b.items) + 1)) AS i) WHERE b IS NOT NULL),
mk AS (SELECT id, it.marks[i] AS mk, path || '.' || (i - 1) AS path, path AS parent_path FROM it, LATERAL (SELECT unnest(range(1, len(it.marks) + 1)) AS i) WHERE it IS NOT NULL)
"""
_LABELLED = _NODES + """, every AS (
 SELECT id, 'blocks' AS type, path, '' AS parent_path, 0 AS depth, b.block_id AS block_id, b.kind AS kind, NULL::INTEGER AS item_no, NULL::VARCHAR AS label, NULL::VARCHAR AS note, NULL::VARCHAR AS code, NULL::VARCHAR AS value FROM b WHERE b IS NOT NULL
 UNION ALL SELECT id, 'blocks.items', path, parent_path, 1, NULL, NULL, it.item_no, it.label, it.note, NULL, NULL FROM it WHERE it IS NOT NULL
 UNION ALL SELECT id, 'blocks.items.marks', path, parent_path, 2, NULL, NULL, NULL, NULL, NULL, mk.code, mk.value FROM mk WHERE mk IS NOT NULL),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY list_transform(string_split(path, '.'), lambda x: CAST(x AS INTEGER))) - 1 AS INTEGER) AS pre FROM every),
below AS (SELECT a.id, a.path, CAST(count(d.path) AS INTEGER) AS n FROM every a LEFT JOIN every d ON a.id = d.id AND starts_with(d.path, a.path || '.') GROUP BY 1, 2),
nodes AS (SELECT x.*, x.pre + n - depth AS post, x.pre + n AS last, coalesce(p.pre, -1) AS parent_pre FROM numbered x JOIN below USING (id, path) LEFT JOIN (SELECT id, path, pre FROM numbered) p ON x.id = p.id AND x.parent_path = p.path)
"""
_LINKS = """links AS (SELECT section_id AS child, min(parent_id) AS parent FROM chunks
 WHERE section_id IS NOT NULL AND parent_id IN (SELECT section_id FROM chunks) GROUP BY section_id),
walk AS (SELECT child AS node, parent AS top, 1 AS depth, [parent] AS above FROM links
 UNION ALL SELECT w.node, l.parent, w.depth + 1, list_prepend(l.parent, w.above) FROM walk w JOIN links l ON w.top = l.child WHERE NOT list_contains(w.above, l.parent) AND l.parent <> w.node),
good AS (SELECT * FROM walk WHERE top NOT IN (SELECT child FROM links))
"""
_REFS = """first AS (SELECT id, min(ingested_at) AS at FROM chunks WHERE id IS NOT NULL GROUP BY id),
named AS (SELECT DISTINCT id, unnest(cross_refs) AS ref FROM chunks WHERE id IS NOT NULL),
refs AS (SELECT 'chunks' AS table_name, n.id AS record_id, n.ref, f.at FROM named n JOIN first f ON n.id = f.id WHERE n.ref IS NOT NULL
 UNION ALL SELECT 'edges', CAST(edge_id AS VARCHAR), dst, min(seen_at) FROM edges WHERE edge_id IS NOT NULL AND dst IS NOT NULL GROUP BY edge_id, dst),
sections AS (SELECT section_id, min(ingested_at) AS first_at FROM chunks WHERE section_id IS NOT NULL GROUP BY section_id),
found AS (SELECT r.table_name, r.record_id, r.ref,
  CASE WHEN s.section_id IS NOT NULL THEN CASE WHEN s.first_at > r.at THEN 'late' END
       WHEN r.ref IN (SELECT section_id FROM retired_sections WHERE section_id IS NOT NULL) THEN 'deleted' ELSE 'missing' END AS reason,
  strftime(r.at, '%Y-%m') AS period
 FROM refs r LEFT JOIN sections s ON r.ref = s.section_id WHERE r.ref NOT IN (SELECT label FROM source_labels WHERE label IS NOT NULL))
"""

SQL = {
    "p2_found": _NODES + "SELECT id, path, '' AS parent_path FROM b WHERE b IS NOT NULL UNION ALL SELECT id, path, parent_path FROM it WHERE it IS NOT NULL UNION ALL SELECT id, path, parent_path FROM mk WHERE mk IS NOT NULL",
    "p2_nodes": _LABELLED + "SELECT id, type, path, depth, pre, post, last, parent_pre, parent_path, block_id, kind, item_no, label, note, code, value FROM nodes",
    "p2_blocks": _LABELLED + "SELECT id, path, depth, pre, post, last, parent_pre, parent_path, block_id, kind FROM nodes WHERE type = 'blocks'",
    "p2_items": _LABELLED + "SELECT id, path, depth, pre, post, last, parent_pre, parent_path, item_no, label, note FROM nodes WHERE type = 'blocks.items'",
    "p2_marks": _LABELLED + "SELECT id, path, depth, pre, post, last, parent_pre, parent_path, code, value FROM nodes WHERE type = 'blocks.items.marks'",
    "p2_chunks": f"WITH newest AS ({_NEWEST.replace('WHERE id IS NOT NULL)', 'WHERE id IS NOT NULL AND metadata IS NOT NULL)')}) SELECT id, source, hierarchy, TRY_CAST(nullif(regexp_extract(hierarchy, '/page/([0-9]+)', 1), '') AS INTEGER) AS hierarchy_page, TRY_CAST(nullif(regexp_extract(hierarchy, '/section/([0-9]+)', 1), '') AS INTEGER) AS hierarchy_section, metadata.parser AS parser, metadata.source_file AS source_file, metadata.page AS page, metadata.section_index AS section_index, metadata.window_index AS window_index, metadata.section_heading AS section_heading FROM newest",
    "p4_found": f"WITH RECURSIVE {_LINKS} SELECT l.child AS section_id, coalesce(g.top, '') AS root_id, CAST(coalesce(g.depth, -1) AS INTEGER) AS depth FROM links l LEFT JOIN good g ON l.child = g.node",
    "p4_paths": f"WITH RECURSIVE {_LINKS} SELECT node AS section_id, array_to_string(list_append(above, node), ' > ') AS path, CAST(depth AS INTEGER) AS depth FROM good",
    "p4_descendants": f"WITH RECURSIVE {_LINKS} SELECT above[i] AS section_id, node AS descendant_id, CAST(depth - i + 1 AS INTEGER) AS distance FROM good, LATERAL (SELECT unnest(range(1, depth + 1)) AS i)",
    "p6_found": f"WITH {_REFS} SELECT * FROM found WHERE reason IS NOT NULL",
    "p6_report": f"WITH {_REFS} SELECT table_name, period, reason, count(*) AS n_references, count(DISTINCT ref) AS n_keys FROM found WHERE reason IS NOT NULL GROUP BY table_name, period, reason",
}
