"""Removal of repeated 100-byte strings by a distributed difference-cover suffix sort.

Only equal strings need to meet, so the suffixes are dealt out by content. Each
100-byte window has an anchor, the 24-byte string of smallest hash in it (the
leftmost of equals); neighbouring windows with one anchor form a context. Equal
windows have the same anchor at the same offset.

1. Contexts are grouped by anchor. Contexts of equal bytes are copies: all but
   the earliest are removed. An anchor with one context left holds no repeat.
2. The other contexts go, with their bytes, to tasks by anchor. Each task sorts
   the suffixes of its contexts by difference cover: the triples at positions 1
   and 2 modulo 3 are sorted and named, the names are sorted by recursion, the
   remaining suffixes are merged in, and neighbours in the order are compared
   over 100 bytes. Of equal windows all but the earliest are removed.
3. Anchors of very many contexts would make one task too large. Their windows
   are dealt out one by one under a 64-bit hash of their own bytes instead, and
   the earliest of each is found by a partial minimum. Repeats inside a batch
   are settled before that.

Every window takes exactly one of these ways together with all windows equal to
it, so no repeat is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.llm.common import partitions_for
from haplolake.llm.shingles import mix
from haplolake.session import stage

LENGTH, ANCHOR = 100, 24
SPAN = LENGTH - ANCHOR + 1  # anchor positions in a window
IN_BATCH, IN_GROUP = 64, 1024  # contexts of one anchor beyond which its windows are dealt out one by one
SORTED_BYTES = 1_000_000  # bytes that are suffix-sorted at once, and up to a batch more
_OFFSET_BITS = 31  # of a position, as a text has fewer bytes than that; the 32 bits above tell texts of one doc_id apart
_TAG = 0xFFFFFFFF
COPY, CONTEXT, HOT, WINDOW, CROWDED = range(5)

_ROW = pa.schema([(n, pa.int64()) for n in ("kind", "anchor", "content", "doc", "at", "n")])
_ROW_DDL = "kind long, anchor long, content long, doc long, at long, n long"


# --- difference cover -------------------------------------------------------


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and their dense ranks from 1."""
    order = np.argsort(keys)
    by_order = keys[order]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(np.concatenate([[1], by_order[1:] != by_order[:-1]]))
    return order, names


def _triples(t: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """The three symbols from each position, packed; exact as long as three symbols fit into 63 bits."""
    return (t[at] << (2 * bits)) | (t[at + 1] << bits) | t[at + 2]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions in the order of their suffixes, for symbols from 1 on."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    bits = int(text.max()).bit_length()
    if bits > 21:
        raise ValueError("too many different symbols for one sort")
    t = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    order, names = _ranks(_triples(t, sample, bits))
    if names.max() < len(sample):
        order = suffix_order(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    first = sample[order]
    first = first[first < n]  # without the empty suffix that evens out the sample
    high = int(len(sample)).bit_length()
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort((t[zeros] << high) | rank[zeros + 1])]
    in_one, in_two = first[first % 3 == 1], first[first % 3 == 2]
    before = np.searchsorted((t[in_one] << high) | rank[in_one + 1], (t[zeros] << high) | rank[zeros + 1])

    pair = (t[: n + 2] << bits) | t[1 : n + 3]
    if 2 * bits + high > 63:  # two symbols and a rank don't fit: name the pairs first
        _, pair = _ranks(pair)

    def two(i: np.ndarray) -> np.ndarray:
        return (pair[i] << high) | rank[i + 2]

    before += np.searchsorted(two(in_two), two(zeros))
    out = np.empty(n, np.int64)
    place = np.arange(len(zeros)) + before
    out[place] = zeros
    free = np.ones(n, bool)
    free[place] = False
    out[free] = first
    return out


def repeated(texts: list[bytes], doc: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Which windows repeat an earlier one: (text number, offset) of each.

    Windows are ordered by (doc, at + offset) of their text.
    """
    sizes = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    start = np.cumsum(sizes + 1) - sizes - 1
    symbols = joined.astype(np.int64) + 2
    symbols[start + sizes] = 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(len(joined)) - start[owner]
    order = suffix_order(symbols)
    order = order[offset[order] <= sizes[owner[order]] - length]
    if len(order) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    windows = sliding_window_view(joined, length)
    same = np.zeros(len(order), bool)
    for a in range(0, len(order) - 1, 65_536):
        b = min(a + 65_536, len(order) - 1)
        same[a + 1 : b + 1] = (windows[order[a:b]] == windows[order[a + 1 : b + 1]]).all(1)
    group = np.cumsum(~same)
    together = same | np.append(same[1:], False)
    order, group = order[together], group[together]
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    own, off = owner[order], offset[order]
    ranked = np.lexsort((at[own] + off, doc[own], group))
    first = np.concatenate([[True], group[ranked][1:] != group[ranked][:-1]])
    later = _later(first, doc[own[ranked]], (at[own] + off)[ranked])
    return own[ranked][later], off[ranked][later]


# --- anchors and contexts ---------------------------------------------------


def _string_hashes(a: np.ndarray) -> np.ndarray:
    """64-bit hash of the 24 bytes from each position."""
    words = np.lib.stride_tricks.as_strided(a, (len(a) - 7, 8), (1, 1)).copy().view("<u8").ravel()
    n = len(a) - ANCHOR + 1
    return mix(mix(mix(words[:n] + np.uint64(77)) + words[8 : 8 + n]) + words[16 : 16 + n])


def contexts(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each context of a text."""
    if len(raw) < LENGTH:
        none = np.empty(0, np.int64)
        return none, none, none
    hashes = _string_hashes(np.frombuffer(raw, np.uint8))
    least = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    anchor = hashes[(least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    return anchor.view(np.int64), first, np.diff(np.append(first, len(raw) - LENGTH + 1))


def _tag(raw: bytes) -> int:
    """Leading bits of a position, which tell different texts under one doc_id apart."""
    return (xxhash.xxh64_intdigest(raw, 42) & _TAG) << _OFFSET_BITS


def _with_tag(docs: DataFrame) -> DataFrame:
    """Add ``tag``, the bits of ``_tag``: Spark's xxhash64 is that hash."""
    return docs.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(_TAG)))


def _with_doc(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with ``doc``, which stands for the id.

    Rows without an id get one of the last 2**32 numbers by the bits of the
    text's hash that are not in its tag, so all 64 tell them apart.
    """
    own = F.lit((1 << 63) - (1 << 32)) + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 32)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc", F.coalesce("doc_id", own))


def _tag_of(at: str) -> Column:
    return F.shiftrightunsigned(at, _OFFSET_BITS)


def _digests(raw: bytes, first: np.ndarray, n: np.ndarray) -> list[int]:
    view = memoryview(raw)
    return [xxhash.xxh3_64_intdigest(view[a : a + k + LENGTH - 1]) for a, k in zip(first.tolist(), n.tolist(), strict=True)]


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    made = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def _rows(kind, anchor, content, doc, at, n) -> pa.RecordBatch:
    kind = np.full(len(doc), kind, np.int64) if np.isscalar(kind) else kind
    return _batch([kind, anchor, content, doc, at, n], _ROW)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of each text. Copies and crowds inside a batch are settled before anything is dealt out."""
    for batch in batches:
        parts, texts = [], []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            anchor, first, n = contexts(raw)
            if len(first):
                content = np.array(_digests(raw, first, n), np.uint64).view(np.int64)
                texts.append(raw)
                parts.append(np.stack([anchor, content, np.full(len(first), doc), _tag(raw) + first, n, np.full(len(first), len(texts) - 1)]))
        if not parts:
            continue
        anchor, content, doc, at, n, own = np.concatenate(parts, 1)
        order = np.lexsort((at, doc, content, anchor))
        anchor, content, doc, at, n, own = (x[order] for x in (anchor, content, doc, at, n, own))
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        first = new_anchor | np.concatenate([[True], content[1:] != content[:-1]])
        later = _later(first, doc, at)
        yield _rows(COPY, anchor[later], content[later], doc[later], at[later], n[later])
        group = np.cumsum(new_anchor) - 1
        hot = np.bincount(group[first], minlength=group[-1] + 1)[group] > IN_BATCH
        plain = first & ~hot
        yield _rows(CONTEXT, anchor[plain], content[plain], doc[plain], at[plain], n[plain])
        if hot.any():
            marks = anchor[hot & new_anchor]
            zero = np.zeros(len(marks), np.int64)
            yield _rows(HOT, marks, zero, zero, zero, zero)
            crowd = []
            for i in np.flatnonzero(first & hot):
                start = int(at[i]) & ((1 << _OFFSET_BITS) - 1)
                starts = np.arange(start, start + n[i])
                crowd.append(_windows(texts[own[i]], starts, anchor[i], doc[i], at[i] + starts - start))
            earliest, later = _earliest(np.concatenate(crowd, 1))
            for kind, (anchor_, window, doc_, at_) in ((WINDOW, earliest), (COPY, later)):
                yield _rows(kind, anchor_, window, doc_, at_, np.ones(len(doc_), np.int64))


def _windows(raw: bytes, starts: np.ndarray, anchor: int, doc: int, at: np.ndarray) -> np.ndarray:
    """Rows anchor, hash, doc and place of single windows."""
    hashes = np.array(_digests(raw, starts, np.ones(len(starts), np.int64)), np.uint64).view(np.int64)
    return np.stack([np.full(len(starts), anchor), hashes, np.full(len(starts), doc), at])


def _earliest(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of each window in a batch, and the later ones, which are repeats whatever other batches hold."""
    anchor, content, doc, at = windows
    windows = windows[:, np.lexsort((at, doc, content, anchor))]
    first = np.concatenate([[True], (windows[:2, 1:] != windows[:2, :-1]).any(0)])
    return windows[:, first], windows[:, _later(first, windows[2], windows[3])]


def _later(first: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which sorted rows have another place than the first of their group; rows that repeat id and text are one place."""
    earliest = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return (doc != doc[earliest]) | (at != at[earliest])


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int, size=None) -> Iterator[pa.Table]:
    """Sorted batches joined and cut so that rows of one key stay together; about ``most`` units of ``size`` each."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        amount = held.num_rows if size is None else size(held)
        if amount < most:
            continue
        keys = held.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, content and position: later copies, and the contexts whose bytes are needed."""
    for table in _whole_groups(batches, "anchor", 1):
        kind, anchor, content, doc, at, n = (table.column(c).to_numpy() for c in _ROW.names)
        done = (kind == COPY) | (kind == WINDOW)
        yield _rows(kind[done], *(x[done] for x in (anchor, content, doc, at, n)))
        marked = np.unique(anchor[kind == HOT])
        kept = kind == CONTEXT
        anchor, content, doc, at, n = (x[kept] for x in (anchor, content, doc, at, n))
        if not len(anchor):
            continue
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        first = new_anchor | np.concatenate([[True], content[1:] != content[:-1]])
        later = _later(first, doc, at)
        yield _rows(COPY, anchor[later], content[later], doc[later], at[later], n[later])
        group = np.cumsum(new_anchor) - 1
        different = np.bincount(group[first], minlength=group[-1] + 1)[group]
        crowded = first & ((different > IN_GROUP) | np.isin(anchor, marked))
        shared = first & ~crowded & (different > 1)
        for k, which in ((CONTEXT, shared), (CROWDED, crowded)):
            yield _rows(k, anchor[which], content[which], doc[which], at[which], n[which])


_BYTES = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])
_BYTES_DDL = "anchor long, content long, doc long, at long, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted context; of a crowded one the hash of each window.

    Windows that repeat inside a batch come without an anchor: they are settled.
    """
    for batch in batches:
        out: list[tuple] = []
        crowd: list[np.ndarray] = []
        for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "wanted")), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            tag = _tag(raw)
            for w in wanted:
                start = w["at"] - tag
                if not 0 <= start < len(raw):
                    continue  # of another text under the same id
                if w["kind"] == CONTEXT:
                    out.append((w["anchor"], 0, doc, w["at"], raw[start : start + w["n"] + LENGTH - 1]))
                else:
                    starts = np.arange(start, start + w["n"])
                    crowd.append(_windows(raw, starts, w["anchor"], doc, w["at"] + starts - start))
        if out:
            yield _batch(list(zip(*out, strict=True)), _BYTES)
        if crowd:
            earliest, later = _earliest(np.concatenate(crowd, 1))
            yield _batch([*earliest, pa.nulls(earliest.shape[1], pa.binary())], _BYTES)
            yield _batch([pa.nulls(later.shape[1], pa.int64()), *later[1:], pa.nulls(later.shape[1], pa.binary())], _BYTES)


_RUN = pa.schema([("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])
_RUN_DDL = "doc long, at long, n long"


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of contexts sorted by anchor, as runs."""
    for table in _whole_groups(batches, "anchor", SORTED_BYTES, lambda t: t.column("bytes").nbytes):
        doc, at = table.column("doc").to_numpy(), table.column("at").to_numpy()
        own, off = repeated(table.column("bytes").to_pylist(), doc, at)
        if not len(own):
            continue
        order = np.lexsort((off, own))
        own, off = own[order], off[order]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (off[1:] != off[:-1] + 1)]))
        yield _batch([doc[own[first]], at[own[first]] + off[first], np.diff(np.append(first, len(own)))], _RUN)


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
])
_RESULT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def spans(raw: bytes, runs: list) -> np.ndarray:
    """Maximal removed (start, end) byte spans of a text, from its runs of repeated windows."""
    tag = _tag(raw)
    own = np.array([(r["at"] - tag, r["at"] - tag + r["n"] - 1 + LENGTH) for r in runs or [] if 0 <= r["at"] - tag < len(raw)], np.int64).reshape(-1, 2)
    if not len(own):
        return own
    own = own[np.argsort(own[:, 0], kind="stable")]
    reach = np.maximum.accumulate(own[:, 1])
    first = np.flatnonzero(np.concatenate([[True], own[1:, 0] > reach[:-1]]))
    return np.stack([own[first, 0], reach[np.append(first[1:], len(own)) - 1]], 1)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            cut = spans(raw, runs)
            digest, at = hashlib.sha256(), 0
            for a, b in cut.tolist():
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            out.append((doc, len(raw), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), digest.hexdigest()))
        if out:
            yield _batch(list(zip(*out, strict=True)), _RESULT)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Runs (doc, at, n) of windows that repeat an earlier one; ``at`` carries the text's tag and byte offset."""
    spark = docs.sparkSession
    d = _with_doc(docs).select("doc", "text")
    found = d.mapInArrow(_find, _ROW_DDL)
    # copies and windows need no company; they are spread by their place
    meets = F.when(F.col("kind").isin(CONTEXT, HOT), F.col("anchor")).otherwise(F.xxhash64("doc", "at"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(n, meets).sortWithinPartitions("anchor", "content", "doc", "at")
    settled = stage(dealt.mapInArrow(_settle, _ROW_DDL))
    open_ = settled.where(F.col("kind").isin(CONTEXT, CROWDED))
    # by text, not by doc_id alone, so that a list is bounded by one text
    wanted = open_.groupBy("doc", _tag_of("at").alias("tag")).agg(F.collect_list(F.struct("kind", "anchor", "at", "n")).alias("wanted"))
    cut = stage(_with_tag(d).join(wanted, ["doc", "tag"]).select("doc", "text", "wanted").mapInArrow(_cut, _BYTES_DDL))
    tasks = partitions_for(spark, open_.count(), 20_000)
    shared = cut.where("bytes IS NOT NULL").repartition(tasks, "anchor").sortWithinPartitions("anchor")
    sorted_runs = shared.mapInArrow(_sort, _RUN_DDL)
    windows = cut.where("bytes IS NULL AND anchor IS NOT NULL").select("anchor", "content", "doc", "at")
    windows = windows.unionByName(settled.where(F.col("kind") == WINDOW).select("anchor", "content", "doc", "at"))
    place = F.struct("doc", "at")
    earliest = windows.groupBy("anchor", "content").agg(F.min(place).alias("e"), F.count("*").alias("k")).where("k > 1")
    crowd = windows.join(earliest, ["anchor", "content"]).where(place != F.col("e")).select("doc", "at", F.lit(1).cast("long").alias("n"))
    copies = settled.where(F.col("kind") == COPY).select("doc", "at", "n")
    copies = copies.unionByName(cut.where("anchor IS NULL").select("doc", "at", F.lit(1).cast("long").alias("n")))
    return copies.unionByName(sorted_runs).unionByName(crowd)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    A byte goes if a 100-byte string that covers it also starts earlier: in a
    smaller doc_id, or earlier in the same document. Texts count as UTF-8 bytes,
    NULL as empty; strings are judged on the input. NULL ids come last, among ids
    of 2**63 - 2**32 and more. Rows without an id, and those that repeat one, are
    ordered by a hash of their text and told apart by it: by 64 bits without an id,
    by 32 under a repeated one. Rows that repeat id and text are one document and
    get equal results. An empty table gives an empty
    result. Other columns are not kept.
    """
    runs = repeated_runs(docs).groupBy("doc", _tag_of("at").alias("tag")).agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    return _with_tag(_with_doc(docs)).join(runs, ["doc", "tag"], "left").select("doc_id", "text", "runs").mapInArrow(_remove, _RESULT_DDL)
