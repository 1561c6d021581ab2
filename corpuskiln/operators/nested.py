"""Deeply nested records as flat node tables linked by interval labels.

Every element of an array of structs, at any depth of the schema, is a node.
A depth-first traversal numbers the nodes of a record: `pre` on entry, `post`
on exit, and `last`, the greatest pre-order number below the node. A node
contains another if its interval [pre, last] contains the other's pre; its
parent is the containing node one level up. Positions count null elements,
which are no nodes themselves.

The numbering is one expression over the record's own arrays, so a record is
exploded once, without a join, and the links come from a window over the
record's nodes in pre-order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _levels(kind: T.DataType) -> tuple[list[str], list[str]]:
    """Of the struct inside an array type: its plain fields, and its fields that are arrays of structs."""
    plain, nested = [], []
    for field in kind.elementType.fields:
        inner = field.dataType
        (nested if isinstance(inner, T.ArrayType) and isinstance(inner.elementType, T.StructType) else plain).append(field.name)
    return plain, nested


def node_types(kind: T.DataType, name: str) -> dict[str, T.ArrayType]:
    """Dotted type names of all nodes in an array-of-structs type, outermost first."""
    found = {name: kind}
    for inner in _levels(kind)[1]:
        found |= node_types(kind.elementType[inner].dataType, f"{name}.{inner}")
    return found


def _attributes(kind: T.ArrayType) -> str:
    plain = _levels(kind)[0]
    return "struct<" + ",".join(f"`{p}`:{kind.elementType[p].dataType.simpleString()}" for p in plain) + ">"


def _walk(array: Column, kind: T.ArrayType, name: str, above: Column, depth: int, types: dict[str, T.ArrayType], attributes: bool) -> Column:
    plain, nested = _levels(kind)

    def node(element: Column, position: Column) -> Column:
        path = F.concat(above, position.cast("string"))
        below = [_walk(element[n], kind.elementType[n].dataType, f"{name}.{n}", F.concat(path, F.lit(".")), depth + 1, types, attributes) for n in nested]
        inner = F.concat(*below) if len(below) > 1 else below[0] if below else None
        size = F.size(inner) if inner is not None else F.lit(0)
        fields = [F.lit(name).alias("type"), path.alias("path"), F.lit(depth).alias("depth"), size.alias("size")]
        if attributes:
            for other, other_kind in types.items():
                own = F.struct(*[element[p].alias(p) for p in plain]) if other == name and plain else F.lit(None)
                if _levels(other_kind)[0]:
                    fields.append(own.cast(_attributes(other_kind)).alias(other))
        here = F.array(F.struct(*fields))
        return F.when(element.isNotNull(), F.concat(here, inner) if inner is not None else here).otherwise(F.slice(here, 1, 0))

    whole = F.flatten(F.transform(array, node))
    return F.coalesce(whole, F.slice(F.array(_blank(name, types, attributes)), 1, 0))


def _blank(name: str, types: dict[str, T.ArrayType], attributes: bool) -> Column:
    fields = [F.lit(name).alias("type"), F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit(0).alias("size")]
    if attributes:
        fields += [F.lit(None).cast(_attributes(k)).alias(n) for n, k in types.items() if _levels(k)[0]]
    return F.struct(*fields)


def newest(df: DataFrame, key: str, version: str | None) -> DataFrame:
    """One row per non-null key: that with the greatest version."""
    order = F.col(version).desc_nulls_last() if version else F.lit(0)
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.where(F.col(key).isNotNull()).withColumn("_rank", first).where("_rank = 1").drop("_rank")


def nodes(df: DataFrame, id_col: str, array_col: str, version_col: str | None = None, attributes: bool = True) -> DataFrame:
    """All nodes of the newest row of each id.

    Columns: id, type (dotted name from the array's own), path (zero-based
    positions from the outside in), depth, pre, post, last, and with
    `attributes` one struct of plain fields per type. Null arrays and null
    elements give no rows; keys inside the records are not relied upon.
    """
    name = array_col.split(".")[-1]
    picked = df.select(F.col(id_col).alias("id"), F.col(array_col).alias("_array"), *([F.col(version_col).alias("_version")] if version_col else []))
    kind = picked.schema["_array"].dataType
    types = node_types(kind, name)
    rows = newest(picked, "id", "_version" if version_col else None).where(F.size("_array") > 0)
    walked = rows.select("id", F.posexplode(_walk(F.col("_array"), kind, name, F.lit(""), 0, types, attributes)).alias("pre", "_node"))
    node = F.col("_node")
    extra = [node[t].alias(t.replace(".", "_")) for t, k in types.items() if attributes and _levels(k)[0]]
    return walked.select(
        "id",
        node["type"].alias("type"),
        node["path"].alias("path"),
        node["depth"].alias("depth"),
        "pre",
        (F.col("pre") + node["size"] - node["depth"]).alias("post"),
        (F.col("pre") + node["size"]).alias("last"),
        *extra,
    )


def linked(labelled: DataFrame, depths: int) -> DataFrame:
    """Add parent_pre and parent_path (-1 and '' at the top): the node one level up whose interval contains the row's pre."""
    before = Window.partitionBy("id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("struct<pre:int,last:int,path:string>")
    for depth in range(depths - 1):
        at = F.when(F.col("depth") == depth, F.struct("pre", "last", "path"))
        parent = F.when(F.col("depth") == depth + 1, F.last(at, ignorenulls=True).over(before)).otherwise(parent)
    held = F.col("_parent").isNotNull() & (F.col("pre") <= F.col("_parent.last"))
    return (
        labelled.withColumn("_parent", parent)
        .withColumn("parent_pre", F.when(held, F.col("_parent.pre")).otherwise(F.lit(-1)))
        .withColumn("parent_path", F.when(held, F.col("_parent.path")).otherwise(F.lit("")))
        .drop("_parent")
    )


def node_table(labelled: DataFrame, node_type: str) -> DataFrame:
    """The flat table of one node type, its plain fields spread into columns."""
    own = node_type.replace(".", "_")
    rows = labelled.where(F.col("type") == node_type)
    fixed = [c for c in ("id", "path", "depth", "pre", "post", "last", "parent_pre", "parent_path") if c in labelled.columns]
    fields = [F.col(f"{own}.{f}").alias(f if f not in fixed else f"{own}_{f}") for f in labelled.schema[own].dataType.names] if own in labelled.columns else []
    return rows.select(*fixed, *fields)


def contained(ancestors: DataFrame, descendants: DataFrame) -> DataFrame:
    """Pairs (id, ancestor_path, descendant_path) by interval containment within a record."""
    a = ancestors.select("id", F.col("pre").alias("_from"), F.col("last").alias("_to"), F.col("path").alias("ancestor_path"))
    d = descendants.select("id", F.col("pre").alias("_at"), F.col("path").alias("descendant_path"))
    return a.join(d, "id").where("_at > _from and _at <= _to").select("id", "ancestor_path", "descendant_path")
