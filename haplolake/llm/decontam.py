"""Benchmark passages in documents by Wu-Manber multi-pattern search.

Texts are folded to their words, with one space before, between and after them,
so that a window of words occurs where its bytes do. The windows of all items
are the patterns. A table over hashed blocks of bytes tells how far the search
may jump behind a position; where it may not jump, the block at the end of the
shortest pattern's length selects a bucket of patterns, a prefix sorts most of
them out, and the bytes are compared. Patterns fall into classes by length, each
with tables of its own, so that a short item doesn't shorten every jump. Many
cursors run over a chunk of texts at once, each in a lane of its own.

Patterns are dealt into blocks of bounded bytes. Each block is one pass over the
documents; usually there is one, and then nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.session import stage

SIZE = 10
# Bytes of patterns in a block, as broadcast; of texts in a chunk; of a lane.
BLOCK_BYTES, CHUNK_BYTES, LANE = 32_000_000, 8_000_000, 2048
# Patterns of this many bytes or more, and the bytes of the blocks that are hashed for them. The shortest pattern is one byte between spaces.
CLASSES = ((24, 8), (10, 5), (3, 3))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FRONT = 8
# A to Z become a to z, the rest of ASCII but 0-9 and a-z becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SPANS = "array<struct<start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def folded_words(text: str | None) -> list[bytes]:
    """The words of a text: runs of 0-9, a-z and anything beyond ASCII, with A-Z folded."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


@dataclass
class Table:
    """Shift table and buckets of the patterns of one class; all arrays by pattern are sorted by suffix block."""

    least: int
    block: int
    bits: int
    shift: np.ndarray
    suffix: np.ndarray
    prefix: np.ndarray
    index: np.ndarray


def _ahead(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data.data, strides=(1,))


def _slot(block: np.ndarray, bits: int) -> np.ndarray:
    return (block * _FACTOR) >> np.uint64(64 - bits)


def _table(patterns: list[bytes], index: list[int], block: int) -> Table:
    least = min(len(patterns[i]) for i in index)
    bits = min(24, max(12, (8 * least * len(index)).bit_length()))
    heads = np.frombuffer(b"".join(b"\0" * _FRONT + patterns[i][:least] for i in index), np.uint8)
    ahead, start = _ahead(heads), np.arange(len(index)) * (least + _FRONT) + _FRONT
    unused = np.uint64(64 - 8 * block)
    shift = np.full(1 << bits, min(least - block + 1, 65_535), np.uint16)
    # later blocks allow shorter jumps and are written last
    for end in range(block, least + 1):
        shift[_slot(ahead[start + end - 8] >> unused, bits)] = min(least - end, 65_535)
    suffix = ahead[start + least - 8] >> unused
    prefix = ahead[start + min(8, least) - 8] >> np.uint64(64 - 8 * min(8, least))
    order = np.argsort(suffix, kind="stable")
    return Table(least, block, bits, shift, suffix[order], prefix[order], np.array(index, np.int64)[order])


def tables(patterns: list[bytes]) -> list[Table]:
    """Search tables of the patterns, by class of length."""
    out, upper = [], None
    for lower, block in CLASSES:
        index = [i for i, p in enumerate(patterns) if len(p) >= lower and (upper is None or len(p) < upper)]
        if index:
            out.append(_table(patterns, index, block))
        upper = lower
    return out


def search(data: bytes, patterns: list[bytes], found: list[Table]) -> tuple[np.ndarray, np.ndarray]:
    """Start and pattern of all occurrences in ``data``, which has ``_FRONT`` more bytes in front; starts count without them."""
    raw = np.frombuffer(data, np.uint8)
    ahead = _ahead(raw)
    starts, which = [], []
    for t in found:
        unused = np.uint64(64 - 8 * t.block)
        at = np.arange(_FRONT + t.least - 1, len(raw), LANE)
        end = np.minimum(at + LANE, len(raw))
        while len(at):
            block = ahead[at - 7] >> unused
            jump = t.shift[_slot(block, t.bits)].astype(np.int64)
            stop = jump == 0
            if stop.any():
                where, key = at[stop] - t.least + 1, block[stop]
                low, high = np.searchsorted(t.suffix, key, "left"), np.searchsorted(t.suffix, key, "right")
                for s, p in _met(t, ahead, where, low, high):
                    for i, j in zip(s.tolist(), p.tolist(), strict=True):
                        if data.startswith(patterns[j], i):
                            starts.append(i - _FRONT)
                            which.append(j)
                jump[stop] = 1
            at = at + jump
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
    return np.array(starts, np.int64), np.array(which, np.int64)


def _met(t: Table, ahead: np.ndarray, where: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and patterns of their buckets whose first bytes agree, a bounded number at a time."""
    width = min(8, t.least)
    # at the data's end fewer than eight bytes follow, so the prefix is read as the end of the eight bytes that reach its last
    prefix = ahead[where + width - 8] >> np.uint64(64 - 8 * width)
    each = high - low
    total = np.cumsum(each)
    for a in range(0, int(total[-1]) if len(total) else 0, most):
        pair = np.arange(a, min(a + most, int(total[-1])))
        row = np.searchsorted(total, pair, "right")
        member = low[row] + pair - (total[row] - each[row])
        same = t.prefix[member] == prefix[row]
        yield where[row[same]], t.index[member[same]]


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]])) if len(starts) else np.empty(0, np.int64)
    return starts[new], reach[np.concatenate([new[1:] - 1, [len(starts) - 1]])] if len(new) else new


@dataclass
class Block:
    """Patterns with their number of words and the items that have them."""

    patterns: list[bytes]
    words: np.ndarray
    items: list[list[str]]
    tables: list[Table]


def _chunk(texts: list[str | None], block: Block) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    words = [folded_words(t) for t in texts]
    number = np.array([len(w) for w in words], np.int64)
    parts = [b" " + b" ".join(w) + b" " if w else b"" for w in words]
    offset = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    data = b"\0" * _FRONT + b"".join(parts)
    del words, parts
    spans: list[list[dict]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    start, pattern = search(data, block.patterns, block.tables)
    if len(start):
        doc = np.searchsorted(offset, start, "right") - 1
        space = np.flatnonzero(np.frombuffer(data, np.uint8)[_FRONT:] == 32)
        base = np.concatenate([[0], np.cumsum(number)])
        word = np.searchsorted(space, start) - np.searchsorted(space, offset[doc]) + base[doc]
        for a, b in zip(*(x.tolist() for x in united(word, word + block.words[pattern])), strict=True):
            # runs of neighbouring documents may touch, so each is cut at the documents' bounds
            d = int(np.searchsorted(base, a, "right")) - 1
            while a < b:
                stop = min(b, int(base[d + 1]))
                if a < stop:
                    spans[d].append({"start": a - int(base[d]), "end": stop - int(base[d])})
                a, d = max(a, stop), d + 1
        seen: dict[int, set[str]] = {}
        for key in np.unique(doc * len(block.patterns) + pattern).tolist():
            d, p = divmod(key, len(block.patterns))
            seen.setdefault(d, set()).update(block.items[p])
        for d, all_of in seen.items():
            items[d] = sorted(all_of)
    return number.tolist(), spans, items


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK_BYTES:
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def _searched(df: DataFrame, held: Broadcast) -> DataFrame:
    """``n_words``, ``spans`` and ``items`` of each row by one block of patterns; ``text`` is left behind."""
    kept = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _chunks(texts):
                n, spans, items = _chunk(texts[a:b], held.value)
                columns = [batch.column(c).slice(a, b - a) for c in kept]
                columns += [pa.array(n, pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_words", "spans", "items"])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in kept)
    return df.mapInArrow(run, f"{own}, n_words long, spans {SPANS}, items array<string>")


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct (pattern, words, item): the windows of ``size`` words of all item texts, as folded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = folded_words(text)
                k = min(size, len(words))
                found = {b" " + b" ".join(words[i : i + k]) + b" " for i in range(len(words) - k + 1)} if words else set()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([k] * len(found), pa.int64()), pa.array([item] * len(found), pa.string())], names=["pattern", "words", "item"])

    return items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "pattern binary, words long, item string").distinct()


def _number_of_blocks(found: DataFrame, block_bytes: int) -> int:
    size = found.agg(F.sum(F.octet_length("pattern") + F.octet_length(F.coalesce("item", F.lit("")))).alias("s")).first().s or 0
    return max(1, -(-size // block_bytes))


def _block(found: DataFrame, number: int, b: int) -> Block:
    """The patterns of block ``b`` of ``number``; a pattern of many items may have some of them in each block."""
    of: dict[bytes, tuple[int, list[str]]] = {}
    for r in found.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(number)) == b).toLocalIterator():
        items = of.setdefault(bytes(r.pattern), (r.words, []))[1]
        if r.item is not None:
            items.append(r.item)
    patterns = list(of)
    return Block(patterns, np.array([w for w, _ in of.values()], np.int64), [i for _, i in of.values()], tables(patterns))


def _united_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for row in batch.column("spans").to_pylist():
            a, b = (np.array([s[k] for s in row], np.int64) for k in ("start", "end"))
            spans.append([{"start": x, "end": y} for x, y in zip(*(v.tolist() for v in united(a, b)), strict=True)])
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, "spans", pa.array(spans, _SPAN_TYPE))


def occurrences(docs: DataFrame, items: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_words``, ``spans`` and ``items`` of every document.

    ``spans`` are the maximal runs of words, as [start, end) from 0, inside
    occurrences of windows; ``items`` are the ids, as strings, of the items whose
    windows occur; ``text_key`` is the text's MD5. A window is ``size``
    consecutive words of an item's text; an item of fewer words is one window.

    NULL, empty and wordless texts have no words and no hits, and such items no
    windows. Items that share a window all count. Rows that repeat an item_id
    are one item; an item without an id marks words but is not listed. Rows that
    repeat a document are found alike, one row each, also under a NULL doc_id.
    An empty table of documents gives an empty result, one of items no hits.
    Columns other than doc_id, item_id and text are not read.

    A block of patterns takes ``block_bytes``; one window longer than that is a
    block of its own, as large as its item's text.
    """
    found = stage(windows(items, size))
    keyed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    send = docs.sparkSession.sparkContext.broadcast
    number = _number_of_blocks(found, block_bytes)
    first = _searched(keyed, send(_block(found, number, 0)))
    if number == 1:
        return first
    first, rest = stage(first), None
    for b in range(1, number):
        held = send(_block(found, number, b))
        more = stage(_searched(keyed, held).where(F.size("spans") > 0))
        held.destroy()
        rest = more if rest is None else rest.unionByName(more)
    # copies of a document give equal lists, so sets are no longer than the number of blocks
    rest = rest.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.flatten(F.collect_set("spans")).alias("_s"), F.flatten(F.collect_set("items")).alias("_i"))
    joined = first.join(rest, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left")
    none = F.expr(f"CAST(array() AS {SPANS})")
    merged = joined.select(
        "doc_id", "text_key", "n_words", F.concat("spans", F.coalesce("_s", none)).alias("spans"),
        F.array_sort(F.array_union("items", F.coalesce("_i", F.expr("CAST(array() AS array<string>)")))).alias("items"),
    )
    return merged.mapInArrow(_united_rows, merged.schema)


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def without_hits(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents in which no window of an item occurs, all columns as they are."""
    hit = occurrences(docs, items, size).where(F.size("spans") > 0).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).distinct()
    key = F.md5(F.coalesce(docs["text"], F.lit("")))
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_d"]) & (key == hit["_k"]), "left_anti")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` of every document; see :func:`occurrences`."""
    found = occurrences(docs, items, size)
    hit = hit_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
