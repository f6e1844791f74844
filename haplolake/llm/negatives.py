"""Hard negatives by Fagin's threshold algorithm.

Anchors are broadcast in blocks of bounded size; candidates stay where they are
and are read in blocks of ``ROWS``. A candidate block keeps one list of its rows
per dimension, sorted by that component. An anchor reads the lists in step, from
the top where its own component is positive and from the bottom where it is
negative, and scores each row that it meets for the first time as a whole. No row
that it has not met can score more than the sum of the components read last,
weighted by its own: the threshold. It stops once the threshold is strictly below
the k-th best score so far in each of its score windows, or below the windows.
The blocks' best are merged, so each anchor gets the exact result over all rows.

Positives are one such search over the lists of the anchor's own label; the
scores of the positives are the windows of a second search over the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplolake.session import stage

POSITIVES, NEGATIVES = 5, 10
# Bounds of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
# Candidates in a block, components in a broadcast block of anchors, rows that a list gives at first.
ROWS, COMPONENTS, FIRST = 16_384, 2_000_000, 32
_LONG = 1 << 63


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """The number type in which sums of products of the two are exact: double, LONG or any size."""
    most = max(1, a.shape[1]) * _largest(a) * _largest(b)
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def _largest(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def padded(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Lists:
    """Rows of one block and, for each dimension, their order by that component."""

    def __init__(self, ints: np.ndarray, kind: type):
        self.values = ints.astype(kind)
        self.order = np.argsort(ints, axis=0, kind="stable").astype(np.int32)

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows met and their scores, of allowed rows alone, and the depth read.

        ``windows`` are (lowest, highest, k): the k best allowed rows of each are
        among the rows met, with all that tie with the last of them.
        """
        n = len(self.values)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        used = np.concatenate([up, down])
        met = ~allowed
        rows, scores = [np.empty(0, np.int64)], [np.empty(0, self.values.dtype)]
        depth, size = 0, FIRST
        if not len(used):  # all scores are zero and there is no order to read by
            rest = np.flatnonzero(allowed)
            return rest, self.values[rest] @ anchor, n
        while depth < n:
            end = min(n, depth + size)
            seen = np.concatenate([self.order[n - end : n - depth, up].ravel(), self.order[depth:end, down].ravel()])
            new = np.unique(seen[~met[seen]])
            met[new] = True
            rows.append(new)
            scores.append(self.values[new] @ anchor)
            last = np.concatenate([self.order[n - end, up], self.order[end - 1, down]])
            threshold = (anchor[used] * self.values[last, used]).sum()
            depth, size = end, depth + size
            known = np.concatenate(scores)
            if all(threshold < _kth(known, *w) for w in windows):
                break
        return np.concatenate(rows), np.concatenate(scores), depth


def _kth(scores: np.ndarray, lowest: int, highest: int, k: int):
    """The k-th best score inside the window, or its lower bound if there are fewer."""
    inside = scores[(scores >= lowest) & (scores <= highest)]
    return np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else lowest


@dataclass
class Anchors:
    """A block of anchors: row number, id, label and vector; ``windows`` by anchor are (place, lowest, highest)."""

    number: list[int]
    vec_id: np.ndarray
    label: np.ndarray
    ints: np.ndarray
    windows: list[list[tuple[int, int, int]]]


def _block(batch: dict[str, list]) -> dict[str, list]:
    """The block without rows that repeat another one's id, label and vector."""
    seen, keep = set(), []
    for i, key in enumerate(zip(batch["vec_id"], batch["label"], (v.tobytes() for v in batch["ints"]), strict=True)):
        if key not in seen:
            seen.add(key)
            keep.append(i)
    return {k: [v[i] for i in keep] for k, v in batch.items()}


def _found(batch: dict[str, list], anchors: Anchors, same_label: bool, k: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor, window, vec_id, score, hash) of the block's best in each window of each anchor."""
    batch = _block(batch)
    if not batch["vec_id"] or not anchors.number:
        return
    width = max(anchors.ints.shape[1], max(len(v) for v in batch["ints"]))
    ints, asked = padded(batch["ints"], width), padded(list(anchors.ints), width)
    kind = _exact(ints, asked)
    asked = asked.astype(kind)
    ids, labels, hashes = (np.array(batch[c], np.int64) for c in ("vec_id", "label", "hash"))
    parts = [np.flatnonzero(labels == x) for x in np.unique(labels)] if same_label else [np.arange(len(ids))]
    for part in parts:
        own = np.flatnonzero(anchors.label == labels[part[0]]) if same_label else np.arange(len(anchors.number))
        if not len(own):
            continue
        lists = Lists(ints[part], kind)
        for a in own.tolist():
            windows = [w for w in anchors.windows[a] if w[1] <= w[2]]
            if not windows:
                continue
            allowed = ids[part] != anchors.vec_id[a]
            if not same_label:
                allowed &= labels[part] != anchors.label[a]
            rows, scores, _ = lists.search(asked[a], allowed, [(lo, hi, k) for _, lo, hi in windows])
            rows = part[rows]
            for place, lo, hi in windows:
                inside = np.flatnonzero((scores >= lo) & (scores <= hi))
                if len(inside) > k:
                    inside = inside[scores[inside] >= _kth(scores, lo, hi, k)]
                order = np.lexsort((hashes[rows[inside]], labels[rows[inside]], ids[rows[inside]], -scores[inside]))[:k]
                for i in inside[order].tolist():
                    r = rows[i]
                    yield anchors.number[a], place, int(ids[r]), max(-_LONG, min(_LONG - 1, int(scores[i]))), int(labels[r]), int(hashes[r])


_HIT = pa.schema([(c, pa.int64()) for c in ("number", "place", "found_id", "score", "found_label", "hash")])


def _searched(rows: DataFrame, anchors: Anchors, same_label: bool, k: int, block: int) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks_of(batches, block):
            hits = list(zip(*_found(part, held.value, same_label, k), strict=True))
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in hits], schema=_HIT)

    return rows.mapInArrow(run, ", ".join(f"{f.name} long" for f in _HIT))


def _blocks_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[str, list]]:
    """Blocks of up to ``size`` rows, whatever the batches."""
    names = ("vec_id", "label", "hash", "ints")
    held: dict[str, list] = {c: [] for c in names}
    for batch in batches:
        flat, offset = batch.column("ints").flatten().to_numpy(zero_copy_only=False), batch.column("ints").value_lengths().to_numpy(zero_copy_only=False)
        columns = {c: batch.column(c).to_pylist() for c in names[:3]}
        columns["ints"] = np.split(flat, np.cumsum(offset)[:-1]) if len(offset) else []
        for a in range(0, batch.num_rows, size):
            for c in names:
                held[c] += columns[c][a : a + size]
            while len(held["vec_id"]) >= size:
                yield {c: held[c][:size] for c in names}
                held = {c: held[c][size:] for c in names}
    if held["vec_id"]:
        yield held


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor and window over all blocks, with their ``rank``."""
    order = Window.partitionBy("number", "place").orderBy(F.desc("score"), "found_id", "found_label", "hash")
    return found.repartition("number", "place").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _anchor_block(anchors: DataFrame, b: int) -> Anchors:
    rows = sorted(anchors.where(F.col("block") == b).collect(), key=lambda r: r.number)
    width = max((len(r.ints) for r in rows), default=0)
    windows = [[(w.place, -(-LOW * w.score // 100), HIGH * w.score // 100) for w in r.windows] if "windows" in r else [(0, -_LONG, _LONG)] for r in rows]
    return Anchors([r.number for r in rows], np.array([r.vec_id for r in rows], np.int64), np.array([r.label for r in rows], np.int64), padded([np.array(r.ints, np.int64) for r in rows], width), windows)


def _each_block(rows: DataFrame, anchors: DataFrame, number: int, same_label: bool, k: int, block: int) -> DataFrame:
    """The best of all blocks of anchors; one pass over the rows for each."""
    found = None
    for b in range(number):
        part = _best(_searched(rows, _anchor_block(anchors, b), same_label, k, block), k)
        part = stage(part)
        found = part if found is None else found.unionByName(part)
    return found


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = ROWS, components: int = COMPONENTS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``rows`` and ``anchors`` are (vec_id, label, ints). The score is the inner
    product; an anchor's positives are its first ``positives`` other rows of the
    same label, and for each of them the first ``negatives`` rows of other labels
    of 30 to 90 hundredths of the positive's score are returned. Higher scores
    come first, ties by smaller vec_id, then by label and by a hash of the vector.

    Rows with a NULL take no part. Equal rows count once. Different rows under one
    vec_id are candidates and anchors of their own; rows of the anchor's own id
    are no candidates. Shorter vectors end in zeros. A negative
    positive score leaves no window. Scores beyond LONG are cut to its bounds, and
    windows follow the cut score; those that are cut alike come in no defined order. Empty tables give an empty result. Columns
    other than the three are not read.

    A block of anchors has about ``components`` components, and so has its
    broadcast; each block is one pass over all rows for positives and one for
    negatives. Nothing but the results is shuffled.
    """
    fine = "vec_id IS NOT NULL AND label IS NOT NULL AND ints IS NOT NULL"
    r = rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "ints", F.xxhash64("ints").alias("hash"))
    a = anchors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "ints").distinct()
    a = stage(a.withColumn("number", F.monotonically_increasing_id()))
    size = a.agg(F.sum(F.size("ints") + 1)).first()[0] or 0
    number = max(1, -(-size // components))
    a = a.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(number)))
    first = _each_block(r, a, number, True, positives, block)
    wanted = first.where("score >= 0").groupBy("number").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("place"), "score"))).alias("windows"))
    asked = stage(a.join(wanted, "number"))
    second = _each_block(r, asked, number, False, negatives, block)
    pairs = first.select("number", F.col("rank").alias("place"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = asked.select("number", F.col("vec_id").alias("anchor_id")).join(pairs, "number")
    out = second.select("number", "place", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["number", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
