"""Nested records, hierarchies, orphan references and components on small tables."""

from __future__ import annotations

import random
from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpuskiln.operators import hierarchy, nested, orphans
from corpuskiln.operators.components import connected_components

BLOCKS = "id string, v int, other string, deep struct<blocks:array<struct<block_id:string,kind:string,items:array<struct<item_no:int,label:string,marks:array<struct<code:string,value:string>>>>>>>"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_nested_paths_intervals_and_links(spark):
    mark = ("c", "v")
    data = [
        ("a", 1, "x", ([("b", "k", [(1, "l", [mark, None, mark]), None]), None, ("b", "k", None), (None, None, [])],)),
        ("a", 0, "old", ([("z", "k", [])],)),
        ("n", 1, None, None),
        ("e", 1, None, ([],)),
        ("o", 1, None, (None,)),
        (None, 1, None, ([("b", "k", [])],)),
    ]
    df = spark.createDataFrame(data, BLOCKS)
    labelled = nested.linked(nested.nodes(df, "id", "deep.blocks", "v"), 3)
    assert rows(labelled.select("id", "path", "parent_path")) == [("a", "0", ""), ("a", "0.0", "0"), ("a", "0.0.0", "0.0"), ("a", "0.0.2", "0.0"), ("a", "2", ""), ("a", "3", "")]
    by_path = {r["path"]: r for r in labelled.collect()}
    assert [by_path[p]["pre"] for p in ("0", "0.0", "0.0.0", "0.0.2", "2", "3")] == [0, 1, 2, 3, 4, 5]
    assert [by_path[p]["post"] for p in ("0.0.0", "0.0.2", "0.0", "0", "2", "3")] == [0, 1, 2, 3, 4, 5]
    assert by_path["0"]["last"] == 3 and by_path["0.0.2"]["blocks_items_marks"]["code"] == "c"
    marks = nested.node_table(labelled, "blocks.items.marks")
    assert set(marks.columns) >= {"id", "path", "parent_path", "code", "value"} and marks.count() == 2
    inside = nested.contained(labelled, labelled)
    assert ("a", "0", "0.0.2") in rows(inside) and inside.count() == 5


def test_nested_of_an_empty_table(spark):
    df = spark.createDataFrame([], BLOCKS)
    assert nested.linked(nested.nodes(df, "id", "deep.blocks", "v"), 3).count() == 0


def brute_roots(links):
    out = {}
    for n in links:
        seen, at = set(), n
        while at in links and at not in seen:
            seen.add(at)
            at = links[at]
        out[n] = (None, -1) if at in seen else (at, len(seen))
    return out


def solve(spark, pairs, partitions=3):
    df = spark.createDataFrame(pairs, "section_id string, parent_id string")
    links = hierarchy.parent_links(df)
    return links, hierarchy.roots(links, partitions)


def test_hierarchy_roots_depths_and_loops(spark):
    chain = [(f"n{i:03d}", f"n{i - 1:03d}" if i else None) for i in range(60)]
    odd = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("self", "self"), ("under", "self"), ("lost", "nowhere"), (None, "a"), ("n001", None), ("n001", "n000"), ("leaf", "n059")]
    links, resolved = solve(spark, chain + odd, 7)
    found = {r["node"]: (r["root"], r["depth"]) for r in resolved.collect()}
    assert found == brute_roots({r["child"]: r["parent"] for r in links.collect()})
    assert found["n059"] == ("n000", 59) and found["leaf"] == ("n000", 60)
    assert all(found[x] == (None, -1) for x in ("a", "b", "c", "d", "self", "under")) and "lost" not in found
    chains = {r["node"]: r["chain"] for r in hierarchy.ancestor_chains(links, resolved).collect()}
    assert chains["n003"] == ["n000", "n001", "n002", "n003"] and "a" not in chains
    below = hierarchy.descendants(hierarchy.ancestor_chains(links, resolved))
    assert below.where("node = 'n000'").count() == 60 and below.where("node = 'n058'").count() == 2


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_hierarchy_on_random_forests(spark, seed):
    r = random.Random(seed)
    pairs = [(f"x{i}", f"x{r.randrange(40)}" if r.random() < 0.9 else None) for i in range(40)]
    links, resolved = solve(spark, pairs, r.randrange(1, 6))
    assert {x["node"]: (x["root"], x["depth"]) for x in resolved.collect()} == brute_roots({x["child"]: x["parent"] for x in links.collect()})


def test_a_giant_tree_has_no_hot_root(spark):
    """One tree of all nodes: its ends are salted where they are too many to broadcast."""
    star = [(f"s{i:03d}", "top") for i in range(300)] + [("top", None)] + [(f"t{i:03d}", f"s{i:03d}") for i in range(0, 300, 3)]
    df = spark.createDataFrame(star, "section_id string, parent_id string")
    links = hierarchy.parent_links(df)
    found = {r["node"]: (r["root"], r["depth"]) for r in hierarchy.roots(links, 5, broadcast_roots=0).collect()}
    assert found == brute_roots({r["child"]: r["parent"] for r in links.collect()})


def test_hierarchy_of_an_empty_table(spark):
    links, resolved = solve(spark, [])
    assert resolved.count() == 0 and hierarchy.ancestor_chains(links, resolved).count() == 0


def day(n):
    return datetime(2024, 1, n)


def test_orphans_by_reason_and_in_any_order(spark):
    refs = spark.createDataFrame(
        [("t", "1", "there", day(5)), ("t", "2", "later", day(5)), ("t", "3", "gone", day(5)), ("t", "4", "never", day(5)), ("t", "5", "gone", None), ("t", "6", None, day(5)), ("t", "7", "later", day(9)), ("t", "8", "Label", day(1)), ("t", "9", "same", day(8))],
        "table_name string, record_id string, ref string, at timestamp_ntz",
    )
    existing = spark.createDataFrame([("there", day(1)), ("there", day(9)), ("later", day(7)), ("same", day(8)), (None, day(1))], "key string, at timestamp_ntz")
    retired = spark.createDataFrame([("gone",), ("there",), (None,)], "key string")
    labels = spark.createDataFrame([("Label",), (None,)], "label string")
    known = orphans.without_labels(refs, labels)
    assert rows(orphans.orphan_references(known, existing, retired).select("record_id", "reason")) == [("2", "late"), ("3", "deleted"), ("4", "missing"), ("5", "deleted")]
    periods = {r["record_id"]: r["period"] for r in orphans.orphan_references(known, existing, retired).collect()}
    assert periods["2"] == "2024-01" and periods["5"] is None
    whole = orphans.merged(orphans.deltas(known, existing, retired))
    a = orphans.merged(orphans.deltas(known, existing.where("false"), retired.where("false")))
    b = orphans.merged(orphans.deltas(known.where("false"), existing, retired))
    assert rows(orphans.merged(b, a)) == rows(whole) or sorted(map(str, orphans.merged(b, a).collect())) == sorted(map(str, whole.collect()))
    minus = existing.selectExpr("key", "at", "-1 AS sign")
    undone = orphans.merged(orphans.deltas(known, existing, retired), orphans.deltas(known.where("false"), minus, retired.where("false")))
    assert {r["key"] for r in orphans.orphan_keys(undone).collect()} == {"there", "later", "gone", "never", "same"}
    assert orphans.orphan_references(known.where("false"), existing, retired).count() == 0


def test_components_match_brute_force_under_renaming(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(7, 7), (None, 3), (61, 61)] + [(100 + i, 101 + i) for i in range(40)]
    known = [(a, b) for a, b in edges if a is not None]
    parent = {x: x for e in known for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in known:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == {x: find(x) for x in parent}
    assert connected_components(df.where("false")).count() == 0
