"""Merkle manifest of a dataset by checkpoint and recompute.

Rows are leaves of a tree per source, whose roots are the leaves of one tree on
top. Runs of three consecutive nodes have their hash as parent. Only every
``STRIDE``-th level is persisted. For proofs each aligned subtree between two
persisted levels, 27 nodes at most, is built again from its stored nodes; it
emits the siblings on the way up from each of them, and its interior nodes are
dropped. Subtrees are groups of bounded size, so a source of any share of the
rows is spread out, and a path is handed down once per subtree.

Order is a range partitioning of the whole table: a row's number is its place in
its partition plus the source's rows in the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplolake.llm.common import partitions_for
from haplolake.session import stage

ARITY, STRIDE = 3, 3
PER_TASK = 250_000
STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """`-` for NULL, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _folded(nodes: Column) -> Column:
    """Parents of a list of sibling runs."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``idx``, the row's number inside its group by ``order``, and ``n``, the group's number of rows.

    ``group`` isn't NULL. ``order`` tells all rows apart, so that a lost task gives the same numbers again. ``df`` is read twice; stage it first.
    """
    spark = df.sparkSession
    tasks = partitions_for(spark, df.count(), PER_TASK)
    placed = df.repartitionByRange(tasks, group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = stage(placed).withColumn("_part", F.shiftright("_at", 33))
    # sorted, so there are no more of these than partitions and groups together
    parts = placed.groupBy(group, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn("n", F.sum("_rows").over(Window.partitionBy(group)))
    joined = placed.join(parts, [group, "_part"])
    return joined.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("idx"), "n")


def height(n: Column) -> Column:
    """Levels above the leaves: how often three fold into one until one node is left."""
    fold = lambda s, _: F.struct((F.floor((s["n"] + (ARITY - 1)) / ARITY)).cast("long").alias("n"), (s["h"] + (s["n"] > 1).cast("int")).alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(n.cast("long").alias("n"), F.lit(0).alias("h")), fold)["h"]


def _subtrees(nodes: DataFrame, level: int) -> DataFrame:
    """One row per aligned subtree over the nodes of a persisted level: ``up`` levels ``a0`` to ``a3`` (each the one below's parents) and the nodes."""
    width = ARITY**STRIDE
    open_ = nodes.where(F.col("h") > level)
    met = open_.groupBy("g", "h", F.floor(F.col("idx") / width).cast("long").alias("sub")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "row"))).alias("nodes"))
    met = met.withColumn("up", F.least(F.lit(STRIDE), F.col("h") - level)).withColumn("a0", F.col("nodes.digest"))
    for i in range(1, STRIDE + 1):
        met = met.withColumn(f"a{i}", F.when(F.col("up") >= i, _folded(F.col(f"a{i - 1}"))))
    return met


def persisted(leaves: DataFrame) -> list[tuple[int, DataFrame]]:
    """The persisted levels, from the leaves up: (level, nodes).

    ``leaves`` are ``g`` (group, not NULL), ``idx``, ``n``, ``digest`` and ``row``,
    a struct that goes with the node; they are staged here. Nodes have the group's
    height ``h`` in place of ``n``.
    """
    nodes = stage(leaves.select("g", height(F.col("n")).alias("h"), "idx", "digest", "row"))
    tallest = nodes.agg(F.max("h")).first()[0] or 0
    levels = [(0, nodes)]
    for level in range(0, tallest, STRIDE):
        top = F.coalesce(*[F.col(f"a{i}") for i in range(STRIDE, 0, -1)])[0]
        nodes = stage(_subtrees(nodes, level).select("g", "h", F.col("sub").alias("idx"), top.alias("digest"), F.lit(None).cast("struct<x:int>").alias("row")))
        levels.append((level + STRIDE, nodes))
    return levels


def roots(levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """``g`` and ``digest`` of each group's root."""
    found = None
    for level, nodes in levels:
        # a group ends at the first persisted level that reaches its height
        ended = (F.col("h") <= level) if level == 0 else (F.col("h") <= level) & (F.col("h") > level - STRIDE)
        part = nodes.where(ended).select("g", "digest")
        found = part if found is None else found.unionByName(part)
    return found


def _step(nodes: Column, place: Column) -> Column:
    """The siblings to the left and to the right of the node at ``place``."""
    first, own = F.floor(place / ARITY).cast("int") * ARITY, (place % ARITY).cast("int")
    left = F.array_join(F.slice(nodes, first + 1, own), "")
    return F.struct(left.alias("left"), F.array_join(F.slice(nodes, first + own + 2, F.lit(ARITY - 1) - own), "").alias("right"))


def proofs(levels: list[tuple[int, DataFrame]], above: DataFrame) -> DataFrame:
    """``row``, ``digest``, ``proof`` and what ``above`` carries of every leaf.

    ``above`` has one row per group: ``g``, ``path`` (the steps above the group's
    root) and ``carry``. A proof lists, level by level from the leaf up, the
    siblings to the left and to the right, each as joined digests.
    """
    path = None
    for level, nodes in reversed(levels):
        ended = (F.col("h") <= level) if level == 0 else (F.col("h") <= level) & (F.col("h") > level - STRIDE)
        own = nodes.where(ended).join(above, "g").select("g", "h", "idx", "digest", "row", "path", "carry")
        if path is not None:
            met = _subtrees(nodes, level).join(path.withColumnRenamed("idx", "sub").select("g", "sub", "path", "carry"), ["g", "sub"])
            each = met.select("g", "h", "up", "a0", "a1", "a2", "path", "carry", F.posexplode("nodes").alias("_place", "_node"))
            steps = [F.when(F.col("up") > i, _step(F.col(f"a{i}"), F.floor(F.col("_place") / ARITY**i).cast("int"))) for i in range(STRIDE)]
            steps = F.filter(F.array(*steps), lambda s: s.isNotNull())
            below = each.select("g", "h", F.col("_node.idx").alias("idx"), F.col("_node.digest").alias("digest"), F.col("_node.row").alias("row"), F.concat(steps, "path").alias("path"), "carry")
            own = own.unionByName(below)
        path = own
    return path.select("row", "digest", F.col("path").alias("proof"), "carry")


def proof_digest(proof: Column) -> Column:
    """Hash of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def root_from(digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, digest, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, also: dict[str, Column] | None = None) -> DataFrame:
    """``row`` (``order``, ``group`` and the columns of ``also``), ``leaf``, ``subroot``, ``root`` and ``proof`` of every row.

    A leaf is the hash of ``columns``. Leaves of one group ascend by ``order``
    (NULL first), equal ones by their digest; equal digests are interchangeable.
    Groups ascend bytewise as text, NULL first, and are the leaves of the tree on
    top; a single group's root is the root. An empty table gives an empty result.
    Repeated rows are leaves of their own. Columns that aren't named are not read.
    """
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("s"), F.col(group).cast("string")))
    carried = {order: F.col(order), group: F.col(group), **(also or {})}
    leaves = docs.select(key.alias("g"), leaf(*[F.col(c) for c in columns]).alias("digest"), F.struct(*[c.alias(n) for n, c in carried.items()]).alias("row"))
    # the number written with each row tells repeated rows apart
    leaves = stage(leaves.withColumn("_order", F.col("row")[order]).withColumn("_copy", F.monotonically_increasing_id()))
    levels = persisted(numbered(leaves, "g", ["_order", "digest", "_copy"]))
    tops = stage(roots(levels).select("g", "digest"))
    over = persisted(numbered(tops.withColumnRenamed("g", "name").withColumn("g", F.lit("")), "g", ["name"]).withColumn("row", F.struct("name")))
    root = roots(over).select("digest").first()
    one = docs.sparkSession.range(1).select(F.lit("").alias("g"), F.expr(f"CAST(array() AS {STEPS})").alias("path"), F.lit(root.digest if root else "").alias("carry"))
    above = proofs(over, one).select(F.col("row.name").alias("g"), F.col("proof").alias("path"), F.struct(F.col("digest").alias("subroot"), F.col("carry").alias("root")).alias("carry"))
    return proofs(levels, stage(above)).select("row", F.col("digest").alias("leaf"), "carry.subroot", "carry.root", "proof")


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against a copy of the table in which some texts have lost their line ends.

    ``doc_id``, ``leaf``, ``subroot``, ``root`` and ``proof_sha256`` are those of the
    table as it is. Where crc32 of doc_id is even, the text of the copy has no
    line ends; ``folded_root`` follows from the copy's leaf and the proof, and
    ``verified`` says whether it is the root. A NULL doc_id is never tampered
    with; a NULL text stays NULL.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = manifest(docs, columns, "source", "doc_id", {"copy": leaf(*[F.col(c) for c in columns[:-1]], text)})
    folded = found.withColumn("folded_root", root_from(F.col("row.copy"), F.col("proof")))
    return folded.select("row.doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
