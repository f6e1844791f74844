"""Mixing overlapping sources to target weights as a min-cost flow.

Documents that belong to the same sources form one pattern. Each pattern may
send its words once for nothing, a second time at cost 1, a third time at cost
2, and so on; each source takes words up to its quota from the patterns that
belong to it. The cheapest largest flow says how often each pattern is used;
whole documents are then chosen in a seeded order until the flow is reached.

The flow runs on the driver over one row per pattern and one per source. The
documents themselves meet only sums and one boundary row per pattern.
"""

from __future__ import annotations

import heapq
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.llm.common import sums_before, word_count
from haplolake.session import stage

WEIGHTS = (5, 2, 1)


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words wanted of each source.

    Sources by code point, NULL last, weigh ``weights`` in turn and share
    ``share`` of all words; a target stops at ``most`` times its source's size
    and what is over is shared out anew by weight until none is above.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def cheapest_flow(supply: dict[str, int], member: dict[str, list], quota: dict, passes: int) -> dict[str, dict]:
    """Words that each pattern sends to each of its sources, by successive cheapest paths.

    Costs never fall along the way, so each path is found by Dijkstra's method
    with potentials over the residual graph.
    """
    ids, number = {}, count()
    node = lambda key: ids.setdefault(key, next(number)) if key not in ids else ids[key]
    start, end = node(("start",)), node(("end",))
    to, capacity, cost, arcs = [], [], [], {}

    def arc(a: int, b: int, c: float, w: int) -> int:
        for x, y, z, k in ((a, b, c, w), (b, a, 0.0, -w)):
            arcs.setdefault(x, []).append(len(to))
            to.append(y)
            capacity.append(float(z))
            cost.append(k)
        return len(to) - 2

    sends = {}
    for p, size in supply.items():
        for k in range(passes):
            arc(start, node(("pattern", p)), size, k)
        for s in member[p]:
            sends[p, s] = arc(node(("pattern", p)), node(("source", s)), passes * size, 0)
    for s, q in quota.items():
        arc(node(("source", s)), end, q, 0)
    least = 1e-9 * (1 + sum(quota.values()))
    height = [0.0] * len(ids)
    while True:
        far, via, heap = {start: 0.0}, {}, [(0.0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in arcs.get(a, []):
                if capacity[e] > least and (n := d + cost[e] + height[a] - height[to[e]]) < far.get(to[e], float("inf")) - 1e-12:
                    far[to[e]], via[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if end not in far:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = to[via[at] ^ 1]
        amount = min(capacity[e] for e in path)
        for e in path:
            capacity[e] -= amount
            capacity[e ^ 1] += amount
        height = [h + far.get(i, far[end]) for i, h in enumerate(height)]
    out: dict[str, dict] = {p: {} for p in supply}
    for (p, s), e in sends.items():
        out[p][s] = capacity[e ^ 1]
    return out


def mix(docs: DataFrame, sources: Column, size: Column, quotas=targets, passes: int = 2, seed: int = 23) -> tuple[DataFrame, dict]:
    """Documents with ``size``, ``copies`` (0 to ``passes``), ``taken``, ``source_size`` and ``target``; and the flow.

    ``sources`` is the array of a document's sources, ``size`` its words, and
    ``quotas`` maps source sizes to targets. ``source_size`` and ``target``
    belong to the first source. Documents without a source form one of their
    own named NULL; NULL sizes count as 0. Rows that agree in doc_id and size are taken
    alike. A document of size 0 is kept once, as it takes nothing. The result
    does not depend on row order. An empty table gives an empty result. Columns
    of the new names are replaced.
    """
    own = F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))
    own = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(None).cast("string")))
    # kept under 2**63, so that the order of LONGs is that of its leading bits
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 1)
    d = docs.withColumn("size", F.coalesce(size.cast("long"), F.lit(0).cast("long"))).withColumn("_sources", own)
    d = d.withColumn("_pattern", F.to_json("_sources")).withColumn("_hash", drawn).withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = stage(d.groupBy("_pattern", "_hash", "_id", "size").agg(F.first("_sources").alias("_sources"), F.count("*").alias("_n")).withColumn("_v", F.col("size") * F.col("_n")))
    per_pattern = keyed.groupBy("_pattern").agg(F.first("_sources").alias("s"), F.sum("_v").alias("v"), F.count("*").alias("n")).collect()
    supply, member = {r["_pattern"]: r["v"] for r in per_pattern}, {r["_pattern"]: list(r["s"]) for r in per_pattern}
    sizes: dict = {}
    for p, v in supply.items():
        for s in member[p]:
            sizes[s] = sizes.get(s, 0) + v
    wanted = quotas(sizes)
    flow = cheapest_flow(supply, member, wanted, passes)
    plan = []
    for p, v in supply.items():
        words = sum(flow[p].values())
        whole = min(passes, int(words / v + 1e-9)) if v else 1
        plan.append((p, whole, float(max(0.0, words - whole * v)) if v else 0.0, sizes[member[p][0]], float(wanted[member[p][0]])))
    spark = docs.sparkSession
    rest = spark.createDataFrame(plan, "_pattern string, _whole int, _rest double, source_size long, target double")
    summed = sums_before(keyed.drop("_sources"), ["_pattern"], ["_hash", "_id", "size"], "_v", "_before", sum(r["n"] for r in per_pattern))
    key = F.struct(F.col("_hash").alias("h"), F.col("_id").alias("i"), F.col("size").alias("z"))
    fits = summed.join(F.broadcast(rest.select("_pattern", "_rest")), "_pattern").where("_v > 0 AND _before + _v / 2 <= _rest")
    edge = rest.join(fits.groupBy("_pattern").agg(F.max(key).alias("_edge")), "_pattern", "left")
    # as many rows as the plan, which the driver holds already
    marked = d.drop("source_size", "target", "copies", "taken").join(F.broadcast(stage(edge)), "_pattern")
    more = F.coalesce((F.col("size") > 0) & (key <= F.col("_edge")), F.lit(False))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("_whole") + more.cast("int")).cast("int")
    out = marked.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    return out.drop("_pattern", "_sources", "_hash", "_id", "_whole", "_rest", "_edge"), flow


def mix_documents(docs: DataFrame, seed: int = 23) -> DataFrame:
    """Documents mixed by their ``source`` to the weights 5, 2, 1 and 150 % of all words."""
    return mix(docs, F.array("source"), word_count(F.col("text")), seed=seed)[0]
