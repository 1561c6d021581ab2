"""The build: chunks, references, parts, vectors, graph, coverage, audit and communities, written stage by stage.

A stage is skipped if its fingerprint, a hash of its inputs' files and settings,
is that of the last build and its table is there.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln import storage
from corpuskiln.functions import refs, text
from corpuskiln.operators import audit, graph, linking, order, vectors

VERSION = 1


def fingerprint(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def file_states(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    return [storage.state(spark, p) for p in sorted(paths)]


class Stages:
    """Tables in a folder with a manifest of fingerprints."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.path = spark, folder, f"{folder}/build_cache.json"
        self.hits: dict[str, bool] = {}
        try:
            known = json.loads(storage.read_text(spark, self.path) or "{}")
            self.known = known["stages"] if known.get("version") == VERSION else {}
        except (ValueError, KeyError, Py4JJavaError):  # no readable manifest: all stages are built
            self.known = {}

    def table(self, name: str, mark: str, build: Callable[[], DataFrame]) -> DataFrame:
        target = f"{self.folder}/{name}.parquet"
        self.hits[name] = self.known.get(name) == mark and storage.exists(self.spark, f"{target}/_SUCCESS")
        if not self.hits[name]:
            build().write.mode("overwrite").parquet(target)
            self.known[name] = mark
            storage.write_text(self.spark, self.path, json.dumps({"version": VERSION, "stages": self.known}, indent=1))
        return self.spark.read.parquet(target)


def annotated(chunks: DataFrame, labels: list[str]) -> DataFrame:
    """Chunks with the references found in their texts added to cross_refs, sorted; statute chunks as they are."""
    found = F.array_sort(F.array_union(F.array_union(F.coalesce("cross_refs", F.array().cast("array<string>")), refs.usc_refs("text")), refs.irs_refs("text", labels)))
    return chunks.withColumn("cross_refs", F.when(F.col("source") == linking.STATUTE, F.col("cross_refs")).otherwise(found))


def split(chunks: DataFrame, limit: int = 2_000) -> DataFrame:
    """Chunks longer than `limit` in parts of whole sentences: ids end in _0, _1, …; chunk_ord is numbered anew, all else is the chunk's own."""
    parts = chunks.withColumn("_parts", text.packed_sentences("text", limit))
    rows = parts.select(*[c for c in chunks.columns if c != "text"], F.size("_parts").alias("_n"), F.posexplode_outer("_parts").alias("_i", "text"))
    rows_of = rows.withColumn("id", F.when(F.col("_n") > 1, F.concat("id", F.lit("_"), F.col("_i").cast("string"))).otherwise(F.col("id")))
    return order.numbered(rows_of, "chunk_ord", "_i", "id").select(*chunks.columns)


def build(spark: SparkSession, chunks: DataFrame, labels: dict[str, str], folder: str, inputs: object, embed: Callable | None = None, strict: bool = True, curated: DataFrame | None = None, curated_pairs: DataFrame | None = None) -> dict:
    """Run all stages over parsed chunks and return the manifest. `inputs` is what the chunks' fingerprint is taken of (file states, settings)."""
    stages, mark = Stages(spark, folder), fingerprint([VERSION, inputs, labels])
    whole = stages.table("chunks", mark, lambda: split(annotated(chunks, list(labels.values()))))
    embed = embed or vectors.hashing_embedder()
    stages.table(
        "vectors",
        fingerprint([mark, "vectors"]),
        lambda: vectors.embedded(vectors.embedded(whole.select("chunk_ord", "id", "section_id", "text"), "text", "content_vec", embed), "section_id", "name_vec", embed),
    )
    graph_mark = fingerprint([mark, "graph"])
    nodes = stages.table("nodes", graph_mark, lambda: graph.graph_nodes(whole))
    direct = stages.table("direct_edges", graph_mark, lambda: graph.graph_edges(whole, nodes))

    def covered() -> DataFrame:
        added = [linking.inferred_coverage(nodes, direct), linking.inferred_cross_source(nodes, direct)]
        if curated is not None:
            added.append(linking.curated_coverage(nodes, curated))
        if curated_pairs is not None:
            added.append(linking.curated_cross_source(nodes, curated_pairs))
        return linking.with_coverage(direct, *added)

    linked = stages.table("linked_edges", graph_mark, covered)
    edges = stages.table("edges", graph_mark, lambda: linking.with_coverage(linked, linking.fallback_coverage(nodes, linked)))
    sources = stages.table("audit", graph_mark, lambda: audit.audit_sources(nodes, edges))
    report = audit.audit_report(nodes, edges, sources)
    if strict:
        audit.require_coverage(report)
    members = stages.table("members", graph_mark, lambda: audit.communities(nodes, edges))
    stages.table("communities", graph_mark, lambda: audit.community_summaries(nodes, members))
    manifest = {"version": VERSION, "built_at": datetime.now(UTC).isoformat(), "fingerprint": mark, "cache_hits": stages.hits, "n_chunks": whole.count(), "audit": report.first().asDict()}
    manifest["per_source"] = {r["source"]: r["count"] for r in whole.groupBy("source").count().orderBy("source").collect()}
    storage.write_text(spark, f"{folder}/build_manifest.json", json.dumps(manifest, indent=1))
    return manifest


#: Colours of sources in a graph view, used over again (fixed values).
COLOURS = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf", "#aec7e8", "#ffbb78")


def graph_html(nodes: DataFrame, edges: DataFrame, n: int = 200) -> str:
    """A page that draws the subgraph of the n nodes of highest degree, n at most 5,000: sources side by side on a circle, names and links on pointing."""
    from html import escape

    small = graph.top_degree_subgraph(edges, min(max(1, n), 5_000))
    ends = small.select(F.col("src").alias("section_id")).union(small.select("dst")).distinct()
    shown = nodes.join(ends, "section_id", "left_semi").select("section_id", "source", text.shortened("title", 60).alias("title")).orderBy("source", "section_id").collect()
    colour = {s: COLOURS[i % len(COLOURS)] for i, s in enumerate(sorted({r["source"] for r in shown}))}
    radius = max(200, 6 * len(shown))
    at = {r["section_id"]: (radius * math.cos(2 * math.pi * i / max(1, len(shown))), radius * math.sin(2 * math.pi * i / max(1, len(shown)))) for i, r in enumerate(shown)}
    lines = [
        f'<path class="{escape(r["type"] or "")}" d="M{at[r["src"]][0]:.1f} {at[r["src"]][1]:.1f}Q0 0 {at[r["dst"]][0]:.1f} {at[r["dst"]][1]:.1f}"><title>{escape(r["src"])} → {escape(r["dst"])}</title></path>'
        for r in small.collect()
        if r["src"] in at and r["dst"] in at
    ]
    dots = [f'<circle cx="{at[r["section_id"]][0]:.1f}" cy="{at[r["section_id"]][1]:.1f}" r="5" fill="{colour[r["source"]]}"><title>{escape(r["section_id"])}: {escape(r["title"] or "")}</title></circle>' for r in shown]
    legend = "".join(f'<li style="color:{c}">{escape(s)}</li>' for s, c in colour.items())
    side = radius + 20
    style = "path{fill:none;stroke:#999;stroke-opacity:.4}path.coverage{stroke-dasharray:4}path:hover{stroke:#000;stroke-opacity:1}svg{width:80vw;height:95vh;float:left}"
    return f"<!doctype html><meta charset='utf-8'><title>Graph</title><style>{style}</style><svg viewBox='{-side} {-side} {2 * side} {2 * side}'>{''.join(lines)}{''.join(dots)}</svg><ul>{legend}</ul>"


def report(summary: DataFrame) -> str:
    """A summary (see evaluation.mode_summary) as lines of text, a line a dataset, model and mode; at most 10,000."""
    columns = [c for c in summary.columns if c not in ("dataset", "model", "mode")]
    rows = summary.orderBy("dataset", "model", "mode").limit(10_000).collect()
    said = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["\t".join(["dataset", "model", "mode", *columns]), *("\t".join([r["dataset"], r["model"], r["mode"], *(said(r[c]) for c in columns)]) for r in rows)])


def graphml(nodes: DataFrame, edges: DataFrame, path: str, most: int = 1_000_000) -> None:
    """Write a graph of at most `most` nodes as GraphML, row by row."""
    from xml.sax.saxutils import escape, quoteattr

    if nodes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} nodes")
    with open(path, "w", encoding="utf-8") as f:  # a small export on the driver
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="t" for="edge" attr.name="type" attr.type="string"/><key id="s" for="node" attr.name="source" attr.type="string"/><graph edgedefault="directed">\n')
        for r in nodes.select("section_id", "source").toLocalIterator():
            f.write(f"<node id={quoteattr(r['section_id'])}><data key=\"s\">{escape(r['source'])}</data></node>\n")
        for r in edges.select("src", "dst", "type").toLocalIterator():
            f.write(f"<edge source={quoteattr(r['src'])} target={quoteattr(r['dst'])}><data key=\"t\">{escape(r['type'])}</data></edge>\n")
        f.write("</graph></graphml>\n")
