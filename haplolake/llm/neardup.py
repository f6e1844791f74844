"""Near-duplicates by a chosen-path set similarity join.

Each document is a set of word shingles and carries minwise tokens, the smallest
images of its set under independent hashes. A tree branches all documents by one
such token after the other: documents that share the path so far are one node.
Nodes of up to ``SMALL`` documents are compared exhaustively and end there;
larger ones branch on by the next token, and every member is also compared with
one of them. Two sets of similarity s share a token with chance s, so ``TREES``
independent trees find a pair of similarity 0.8 that parts at the first token
with chance 1 - 0.2**TREES. The first tree joins most groups; the others leave
out nodes of one component and compare across components alone, so a large group
of near copies gives few pairs.

Pairs that part inside a node of more than ``SMALL`` documents may be missed by
that. So the members of each tree's first nodes that are large and still hold
several components are compared with each other on their full sets, in tiles:
a node is cut by set size (sets of similarity 0.8 are in the same size class or
in neighbouring ones) and into blocks of bounded bytes, and each pair of blocks
is one task's matrix product. A tile returns only links that join components.

Equal sets are one class, represented once. Every candidate link is confirmed on
the full sets; components come from confirmed links alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from haplolake.llm.common import WORD_PATTERN
from haplolake.llm.components import components
from haplolake.llm.shingles import mix, shingle_set
from haplolake.session import scratch, stage

TREES, LEVELS, TOKENS = 8, 6, 64
# Trees that run together; components are known between them.
ROUNDS = (range(0, 1), range(1, TREES))
SMALL = 24
# Candidates whose tokens agree less than this are not confirmed: at 19 or fewer of 64, a pair of similarity 0.8 does so with chance 4.9e-18.
LEAST_AGREEMENT = 0.3
# Bytes of sets and number of sets in a block; a tile has two blocks. Shingles of more sets are counted by matrix products.
BLOCK_BYTES, BLOCK_SETS, RARE = 4_000_000, 1024, 64
# Classes whose ids are broadcast to the texts, at about 80 bytes each; for more of them the texts are shuffled.
MOST_IDS = 500_000

_seeds = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def minwise(shingles: np.ndarray) -> bytes:
    """The set's minwise tokens: 32 bits of its smallest image under each hash, and 32 more of the first one of each tree.

    A smallest image is near zero, so its bits are spread before they are cut.
    """
    least = np.empty(TOKENS, np.uint64)
    for i, seed in enumerate(_seeds):
        least[i] = ((shingles ^ seed) * np.uint64(0x9E3779B97F4A7C15)).min()
    spread = mix(least + np.uint64(0x9E3779B97F4A7C15))
    first = spread[: TREES * LEVELS : LEVELS] >> np.uint64(32)
    return spread.astype(np.uint32).tobytes() + first.astype(np.uint32).tobytes()


def _described(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            n, cls, tokens = [], [], []
            for t in texts:
                s = shingle_set(t, size)
                n.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                tokens.append(minwise(s) if len(s) else None)
            hashes = batch.column("text_hash").to_pylist()
            columns = (pa.array(c, f.type) for c, f in zip((ids, hashes, n, cls, tokens), schema, strict=True))
            yield pa.RecordBatch.from_arrays(list(columns), schema=schema)

    return run


def describe(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, the text's hash, set size, class (a digest of the set) and minwise tokens of every document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return d.mapInArrow(_described(size), "doc_id long, text_hash long, n_shingles long, cls binary, tokens binary")


def _token(column: str, i: int) -> Column:
    return F.substring(column, 4 * i + 1, 4)


def _first(t: int) -> Column:
    """The first node of a class in tree ``t``, by 64 bits of its token."""
    return F.xxhash64(F.lit(t), _token("tokens", LEVELS * t), _token("tokens", TOKENS + t))


def candidates(classes: DataFrame, trees: range = range(TREES), small: int = SMALL) -> DataFrame:
    """Pairs (a, b) of classes of different components (comp_a, comp_b) that meet in a small node or with a node's chosen member."""
    paths = [F.struct(F.lit(t).alias("tree"), F.substring("tokens", 4 * LEVELS * t + 1, 4 * LEVELS).alias("path"), _first(t).alias("node")) for t in trees]
    rows = classes.select("cls", "comp", F.explode(F.array(*paths)).alias("p")).select("cls", "comp", "p.*")
    pairs = []
    for level in range(1, LEVELS + 1):
        drawn = F.struct(F.xxhash64("cls", F.lit(level)).alias("h"), F.col("cls").alias("c"), F.col("comp").alias("comp"))
        nodes = rows.groupBy("tree", "node").agg(F.count("*").alias("n"), F.min(drawn).alias("one"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        nodes = nodes.where("n > 1 AND lo <> hi").select("tree", "node", "n", "one")
        rows = stage(rows.join(nodes, ["tree", "node"]))
        large = rows.where(F.col("n") > small)
        pairs.append(_within(rows.where(F.col("n") <= small)))
        pairs.append(large.where("comp <> one.comp").select(F.struct("cls", "comp").alias("x"), F.struct(F.col("one.c").alias("cls"), F.col("one.comp").alias("comp")).alias("y")))
        if large.isEmpty():
            break
        if level == LEVELS:
            # what is still large is cut into parts of the size that is compared exhaustively
            part = F.pmod(F.xxhash64("cls", "tree"), F.ceil(F.col("n") * 2 / small).cast("long"))
            pairs.append(_within(large.withColumn("node", F.xxhash64("node", part))))
        else:
            rows = large.select("cls", "comp", "tree", "path", F.xxhash64("node", _token("path", level)).alias("node"))
    found = pairs[0]
    for p in pairs[1:]:
        found = found.union(p)
    found = found.select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).distinct()
    return found.select(F.col("p.cls").alias("a"), F.col("q.cls").alias("b"), F.col("p.comp").alias("comp_a"), F.col("q.comp").alias("comp_b"))


def _tiles(classes: DataFrame, small: int, percent: int) -> DataFrame:
    """``cls`` and ``tile`` of the members of large first nodes that hold several components, once for each tile."""
    width = 1.001 * max(math.log(100 / max(percent, 1)), 1e-9)
    firsts = [_first(t) for t in range(TREES)]
    rows = classes.select("cls", "comp", "n", F.explode(F.array(*firsts)).alias("node")).withColumn("c", F.floor(F.log("n") / width))
    spread = [F.min("comp").alias("lo"), F.max("comp").alias("hi")]
    sizes = rows.groupBy("node", "c").agg(F.count("*").alias("k"), F.sum("n").alias("all"), *spread)
    blocks = F.greatest(F.ceil(F.col("all") * 8 / BLOCK_BYTES), F.ceil(F.col("k") / BLOCK_SETS))
    sizes = sizes.withColumn("m", blocks.cast("long"))
    nodes = sizes.groupBy("node").agg(F.sum("k").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("m"))
    rows = rows.join(nodes.where((F.col("k") > small) & (F.col("lo") != F.col("hi"))).select("node", "m"), "node")
    c, own = F.col("c"), F.pmod(F.xxhash64("cls", F.lit(-1)), F.col("m")[F.col("c")])

    def facing(other: Column, tile) -> Column:
        return F.when(F.col("m")[other].isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), F.col("m")[other] - 1), tile)).otherwise(F.array().cast("array<long>"))

    met = F.concat(
        facing(c, lambda x: F.xxhash64("node", c, F.least("own", x), c, F.greatest("own", x))),
        facing(c + 1, lambda x: F.xxhash64("node", c, "own", c + 1, x)),
        facing(c - 1, lambda x: F.xxhash64("node", c - 1, x, c, "own")),
    )
    return rows.withColumn("own", own).select("cls", F.explode(met).alias("tile"))


def _mixed(tiles: DataFrame, comps: DataFrame) -> DataFrame:
    """``cls``, ``comp`` and ``tile`` of the tiles that still hold several components."""
    rows = stage(tiles.join(comps, "cls"))
    open_ = rows.groupBy("tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tile")
    return rows.join(open_, "tile")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted distinct sets, above the diagonal."""
    k = len(sets)
    _, name = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    by_name = np.argsort(name, kind="stable")
    owner = owner[by_name]
    count = np.bincount(name)
    start = np.cumsum(count) - count
    same = np.zeros((k, k), np.float32)
    hot = np.flatnonzero(count > RARE)
    for a in range(0, len(hot), 1024):
        part = hot[a : a + 1024]
        has = np.zeros((k, len(part)), np.float32)
        for column, i in enumerate(part):
            has[owner[start[i] : start[i] + count[i]], column] = 1
        same += has @ has.T
    flat = same.reshape(-1)
    for size in range(2, RARE + 1):
        which = np.flatnonzero(count == size)
        x, y = np.triu_indices(size, 1)
        step = max(1, 1_000_000 // len(x))
        for a in range(0, len(which), step):
            own = owner[start[which[a : a + step], None] + np.arange(size)]
            at, times = np.unique(own[:, x] * k + own[:, y], return_counts=True)
            flat[at] += times
    return same


def _joins(percent: int):
    """Of one tile, confirmed links between components, no more than join them."""

    def run(table: pa.Table) -> pa.Table:
        cls = table.column("cls").to_pylist()
        label = {c: i for i, c in enumerate(sorted(set(table.column("comp").to_pylist())))}
        comp = np.array([label[c] for c in table.column("comp").to_pylist()])
        sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
        n = np.array([len(s) for s in sets])
        same = _overlaps(sets)
        a, b = [], []
        for i in range(len(sets) - 1):
            both = same[i, i + 1 :].astype(np.int64)
            like = (100 * both >= percent * (n[i] + n[i + 1 :] - both)) & (comp[i + 1 :] != comp[i])
            for j in (np.flatnonzero(like) + i + 1).tolist():
                if comp[i] != comp[j]:
                    comp[comp == comp[j]] = comp[i]
                    a.append(min(cls[i], cls[j]))
                    b.append(max(cls[i], cls[j]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def crowd_links(tiles: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components inside large nodes, every two members of different components compared."""
    return _mixed(tiles, comps).join(sets, "cls").groupBy("tile").applyInArrow(_joins(percent), "a binary, b binary").distinct()


def _within(rows: DataFrame) -> DataFrame:
    """All pairs (x, y) of each node that lie in different components; the nodes are small."""
    met = rows.groupBy("tree", "node").agg(F.collect_list(F.struct("cls", "comp")).alias("all"))
    other = lambda x: F.filter("all", lambda y: (y["cls"] > x["cls"]) & (y["comp"] != x["comp"]))
    pairs = F.transform("all", lambda x: F.transform(other(x), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    return met.select(F.explode(F.flatten(pairs)).alias("p")).select("p.x", "p.y")


@F.pandas_udf(DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    left, right = (np.frombuffer(b"".join(x), np.uint32).reshape(-1, TOKENS + TREES)[:, :TOKENS] for x in (a, b))
    return pd.Series((left == right).mean(1))


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The full sets of the wanted (cls, rep) classes, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size).tobytes() for t in batch.column("text").to_pylist()]
            cls = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            keep = [i for i, (a, b) in enumerate(zip(cls, batch.column("cls").to_pylist(), strict=True)) if a == b]
            yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i in keep], pa.binary()), pa.array([sets[i] for i in keep], pa.binary())], names=["cls", "set"])

    small = F.broadcast(wanted) if wanted.count() <= MOST_IDS else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(small, "rep")
    found = texts.select("cls", "text").mapInArrow(run, "cls binary, set binary")
    return found.groupBy("cls").agg(F.first("set").alias("set"))


def _confirmed(percent: int):
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            same = len(x) + len(y) - len(np.union1d(x, y))
            out.append(100 * same >= percent * (len(x) + len(y) - same))
        return pd.Series(out, dtype=bool)

    return run


def survivors(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay when each group of near-duplicates keeps the one of its smallest doc_id.

    Of rows that repeat this id in the group, the text of the smallest hash
    stays, once. Documents without words or without a doc_id are in no group and
    stay. All columns are kept as they are.
    """
    resolved = near_duplicates(docs, size, percent, with_hash=True).where("n_shingles > 0 AND doc_id IS NOT NULL")
    best = resolved.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("w")).select(F.col("w.doc_id").alias("_id"), F.col("w.text_hash").alias("_h"))
    blank = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    marked = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_h", F.xxhash64("text"))
    kept = marked.where(~blank).join(best, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"])
    return kept.select(*docs.columns).unionByName(docs.where(blank))


def _alike(known: DataFrame, trees: range, percent: int, small: int) -> DataFrame:
    """Candidates of these trees that their sizes and tokens do not rule out."""
    pairs = candidates(known, trees, small)
    for side in ("a", "b"):
        own = known.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("tokens").alias(f"t_{side}"))
        pairs = pairs.join(own, side)
    like = pairs.where("100 * least(n_a, n_b) >= %d * greatest(n_a, n_b)" % percent).where(_agreement("t_a", "t_b") >= LEAST_AGREEMENT)
    return like.select("a", "b", "comp_a", "comp_b")


def _links(like: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components, confirmed on full sets."""
    full = like.join(sets.withColumnsRenamed({"cls": "a", "set": "s_a"}), "a").join(sets.withColumnsRenamed({"cls": "b", "set": "s_b"}), "b")
    return full.where(_confirmed(percent)("s_a", "s_b")).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with the components that links between components make."""
    roots = components(links).withColumnsRenamed({"node": "comp", "root": "_root"})
    return known.join(roots, "comp", "left").withColumn("comp", F.coalesce("_root", "comp")).drop("_root")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, small: int = SMALL, with_hash: bool = False) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document.

    Documents are linked if their ``size``-word shingle sets have
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest
    doc_id reachable by links. Texts without words are linked with nothing.
    Documents of fewer words have one shingle. A NULL doc_id has no component and
    is kept. Rows that repeat a doc_id are separate documents of that id. An empty
    table gives an empty result. Other columns are not kept.
    """
    described = stage(describe(docs, size))
    classes = described.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))
    classes = stage(classes.where("rep IS NOT NULL"))
    comps = classes.select("cls", F.col("cls").alias("comp"))
    for trees in ROUNDS:
        with scratch(docs.sparkSession):
            known = classes.join(comps, "cls")
            like = stage(_alike(known, trees, percent, small))
            met = like.select(F.explode(F.array("a", "b")).alias("cls"))
            if trees is ROUNDS[-1]:  # the sets for the crowds come with the others
                tiles = stage(_tiles(known, small, percent))
                met = met.union(tiles.select("cls"))
            sets = stage(_sets(docs, stage(classes.select("cls", "rep").join(met.distinct(), "cls")), size))
            comps = stage(_joined(comps, _links(like, sets, percent)), keep=True)
            if trees is ROUNDS[-1]:
                more = stage(crowd_links(tiles, comps, sets, percent))
                for side in ("a", "b"):
                    more = more.join(comps.select(F.col("cls").alias(side), F.col("comp").alias(f"c_{side}")), side)
                comps = stage(_joined(comps, more.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))), keep=True)
    of_class = classes.select("cls", "rep").join(comps, "cls")
    lowest = of_class.groupBy("comp").agg(F.min("rep").alias("component"))
    out = described.select("doc_id", "text_hash", "n_shingles", "cls").join(of_class.join(lowest, "comp").select("cls", "component"), "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        *(["text_hash"] if with_hash else []),
    )
