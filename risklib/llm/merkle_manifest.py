"""Operator 11: Merkle manifest of a dataset by slot pivots.

Every row is a leaf, the sha256 of its fields, each written as ``-`` (null) or
as UTF-8 byte count, ``:``, value. Within a group (per language in the query)
the leaves stand in the order of their key; while several nodes are left, every
``fanout`` consecutive ones become the hash of their concatenation (the last
run may be shorter, down to one). What is left is the group's subroot; the
subroots, ordered by group, give the root in the same way.

One pivot covers ``STEP_SLOTS`` children: a grouped conditional aggregate (one
``max(when(slot = j, hash))`` per slot) spreads them into slot columns. Concatenating
``fanout`` columns and hashing them gives the level above, and so on inside the
row until one column is left. With 16 slots the next shuffle has a
sixteenth of the rows. On the way down a node's siblings are the columns of its
run without its own slot; a leaf's path is the siblings of its own levels
followed by the path of its parent, so a leaf meets one parent row per shuffle
and no row is joined once a level.

Places come from a range partitioning by (group, key), numbered within each
partition and moved on by the counts of the partitions before it. So a group
that holds most rows is spread like any other, and so is a key that
repeats: ties go by the leaf's hash and then by the place in the scan.

Cases: nulls in any field are ``-``; a null group is one of its own and comes
first; null keys come first and are never tampered with; an empty text is
``0:``; rows repeated as a whole get places of their own, next to each other; a
lone leaf is its group's subroot; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklib.llm.common import stored

STEP_SLOTS = 16
BROADCAST_ROWS = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*fields: Column) -> Column:
    """Lowercase hex sha256 of the concatenated fields."""
    return _hash(F.concat(*[field(c) for c in fields]))


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _steps(fanout: int) -> tuple[int, int]:
    """Slots of a pivot (a power of ``fanout``) and the levels it covers."""
    levels, width = 1, fanout
    while width * fanout <= STEP_SLOTS:
        levels, width = levels + 1, width * fanout
    return width, levels


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (g, ...) with ``id``, the place within g from 0, and ``n``, the rows of g."""
    # the scan's row number is written, so a task that runs again sees the same ties
    rows = stored(nodes.withColumn("tie", F.monotonically_increasing_id()), "merkle-nodes")
    by = ["g", *order, "tie"]
    ranged = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn(
        "at", F.monotonically_increasing_id()), "merkle-ordered").withColumn("part", F.shiftright("at", 33))
    runs = stored(ranged.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c")), "merkle-runs")
    w = Window.partitionBy("g")
    starts = runs.select("g", "part", "first", F.sum("c").over(w).alias("n"), F.coalesce(
        F.sum("c").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    small = runs.count() <= BROADCAST_ROWS  # one row per partition and group that meet
    return ranged.join(F.broadcast(starts) if small else starts, ["g", "part"]).withColumn(
        "id", F.col("at") - F.col("first") + F.col("before")).drop("at", "first", "before", "part")


def _nodes_at(fanout: int, level: int) -> str:
    """Nodes of a group of ``n`` leaves at a level, as SQL."""
    return f"ceil(n / {fanout ** level}D)" if level else "n"


def step_up(nodes: DataFrame, level: int, fanout: int) -> DataFrame:
    """One pivot: (g, n, id, layers, hash) of the parents of ``nodes`` (g, n, id, hash), which stand at ``level``."""
    width, levels = _steps(fanout)
    rows = nodes.selectExpr("g", "n", f"id div {width} as id", f"id % {width} as slot", "hash").groupBy("g", "n", "id").agg(
        *[F.expr(f"max(case when slot = {j} then hash end) as s0_{j}") for j in range(width)])
    for t in range(levels):
        several = f"{_nodes_at(fanout, level + t)} > 1"
        runs = [[f"s{t}_{k * fanout + j}" for j in range(fanout)] for k in range(width // fanout ** (t + 1))]
        rows = rows.selectExpr("*", *[
            f"case when {run[0]} is null then null when {several} then sha2(cast(concat_ws('', {', '.join(run)}) as binary), 256) "
            f"else {run[0]} end as s{t + 1}_{k}" for k, run in enumerate(runs)])
    layers = ", ".join(f"array({', '.join(f's{t}_{j}' for j in range(width // fanout ** t))})" for t in range(levels))
    return rows.selectExpr("g", "n", "id", f"array({layers}) as layers", f"s{levels}_0 as hash")


def _own_path(fanout: int, level: int) -> Column:
    """Siblings of the node in ``id`` at the levels of one pivot: the columns of its run without its own."""
    width, levels = _steps(fanout)
    out = []
    for t in range(levels):
        own = f"cast(id % {width} div {fanout ** t} as int)"
        place = f"({own} % {fanout})"
        left = f"concat_ws('', slice(layers[{t}], {own} - {place} + 1, {place}))"
        right = f"concat_ws('', slice(layers[{t}], {own} + 2, {fanout - 1} - {place}))"
        out.append(f"case when {_nodes_at(fanout, level + t)} > 1 then struct({left} as left, {right} as right) end")
    return F.expr(f"filter(array({', '.join(out)}), e -> e is not null)")


def paths(nodes: DataFrame, fanout: int = 2, groups: bool = True) -> DataFrame:
    """``nodes`` (g, id, n, hash, ...) with path, subroot and root.

    With ``groups`` the subroots, ordered by g, are hashed on in the same way
    to one root; without, a group's subroot is its root.
    """
    width, levels = _steps(fanout)
    largest = nodes.agg(F.max("n")).first()[0]
    if largest is None:
        return nodes.select("*", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.lit("").alias("root"))
    tables, level = [], 0
    while not tables or width ** len(tables) < largest:
        tables.append(stored(step_up(tables[-1] if tables else nodes, level, fanout), "merkle-step"))
        level += levels
    tops = tables[-1].select("g", F.col("hash").alias("subroot"))
    if groups:
        above = paths(placed(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("subroot").alias("hash")), ["name"]),
                      fanout, groups=False).select(F.col("name").alias("g"), F.col("hash").alias("subroot"), "path", "root")
    else:
        above = tops.select("g", "subroot", F.array().cast(PATH).alias("path"), F.col("subroot").alias("root"))
    above = above.withColumn("id", F.lit(0).cast("long"))
    for i in range(len(tables) - 1, -1, -1):
        known = tables[i].select("g", "id", "layers").join(above, ["g", "id"]).withColumnsRenamed({"id": "parent", "path": "rest"})
        below = (tables[i - 1] if i else nodes).withColumn("parent", F.expr(f"id div {width}"))
        path = F.concat(_own_path(fanout, levels * i), F.col("rest"))
        met = below.drop("layers").join(known, ["g", "parent"])
        if i:
            above = met.select("g", "id", path.alias("path"), "subroot", "root")
        else:
            return met.select(*nodes.columns, path.alias("path"), "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, e: _hash(F.concat(e["left"], h, e["right"])))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda e: F.concat(e["left"], e["right"])))


def manifest(docs: DataFrame, fields=FIELDS, group: str = "lang", key: str = "doc_id", changed: Column | None = None,
             fanout: int = 2) -> DataFrame:
    """key, leaf, other_leaf, path, subroot and root of every row; ``other_leaf`` is ``changed`` or the leaf again."""
    leaf = leaf_hash(*[F.col(f) for f in fields])
    name = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = docs.select(name.alias("g"), F.col(key).alias("key"), leaf.alias("hash"),
                       (F.lit(None).cast("string") if changed is None else changed).alias("other"))
    return paths(placed(rows, ["key", "hash"]), fanout).select(
        F.col("key").alias(key), F.col("hash").alias("leaf"), F.coalesce("other", "hash").alias("other_leaf"),
        "path", "subroot", "root")


def tampered_leaf(docs_key: str = "doc_id") -> Column:
    """The leaf with n_chars one higher, where 7 divides the crc32 of the decimal key; null elsewhere."""
    hit = F.crc32(F.col(docs_key).cast("string").cast("binary")) % 7 == 0
    return F.when(hit, leaf_hash(*[F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``."""
    rows = manifest(docs, changed=tampered_leaf())
    return rows.select("doc_id", "leaf", "subroot", "root", _hash(proof_text(F.col("path"))).alias("proof_sha256"),
                       folded(F.col("other_leaf"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
