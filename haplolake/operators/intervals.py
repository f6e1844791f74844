"""Interval algebra on 0-based half-open (contig, start, end) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplolake.operators.scan import BIN, Run, running
from haplolake.session import stage

# The narrowest cells of the overlap join hold 4^4 = 256 positions, the widest 4^9 = 262144.
LEAST_LEVEL = 4
TOP_LEVEL = 9

# Blocks of a semi or anti join are looked up in bins of 2^10 positions.
STAB_BITS = 10

# The lowest cells of the stabbing tree hold 2^8 positions, those of each further level 2^4 times as many; 7 levels span 2^32.
TREE_BASE = 8
TREE_SHIFT = 4
TREE_LEVELS = 7


def _keys(by: str | list[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def merge_intervals(df: DataFrame, by: str | list[str] = "contig", bin_size: int = BIN) -> DataFrame:
    """Union of overlapping and book-ended intervals; empty ones are dropped.

    Rows with one start are folded first, so a bin holds at most ``bin_size``
    rows. Each bin is merged alone, then a table of one row per bin tells which
    pieces continue an interval opened in an earlier bin.
    """
    keys = _keys(by)
    cell = [*keys, "_bin"]
    starts = (
        df.filter(F.col("end") > F.col("start"))
        .withColumn("_bin", F.floor(F.col("start") / F.lit(bin_size)).cast("long"))
        .groupBy(*cell, "start")
        .agg(F.max("end").alias("end"))
    )
    before = Window.partitionBy(*cell).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*cell).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    pieces = (
        starts.withColumn("_reach", F.max("end").over(before))
        .withColumn("_new", (F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))).cast("int"))
        .withColumn("_piece", F.sum("_new").over(upto))
        .groupBy(*cell, "_piece")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    pieces = stage(pieces)  # read twice: for the bins and for the rows
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        pieces.groupBy(*cell)
        .agg(F.max("start").alias("_start"), F.max("end").alias("_end"))
        .withColumn("_carry", F.max("_end").over(earlier))
        .withColumn("_opened", F.when(F.col("_carry").isNull() | (F.col("_start") > F.col("_carry")), F.col("_start")))
        .withColumn("_origin", F.last("_opened", ignorenulls=True).over(earlier))
        .select(*cell, "_carry", "_origin")
    )
    continues = F.col("start") <= F.col("_carry")
    return (
        pieces.join(bins, cell)
        .withColumn("start", F.when(continues, F.col("_origin")).otherwise(F.col("start")))
        .groupBy(*keys, "start")
        .agg(F.max("end").alias("end"))
    )


def complement(df: DataFrame, contigs: DataFrame, by: str | list[str] = "contig", merged: bool = False) -> DataFrame:
    """Gaps of ``df`` inside [0, length); a contig without intervals is one gap."""
    keys = _keys(by)
    base = df if merged else merge_intervals(df, by)
    inner = (
        running(base, keys, "start", [Run("_prev", "max", F.col("end"), inclusive=False)])
        .join(contigs.select(*keys, "length"), keys)
        .select(
            *keys,
            F.coalesce("_prev", F.lit(0)).cast("long").alias("start"),
            F.least("start", "length").cast("long").alias("end"),
        )
    )
    ends = base.groupBy(*keys).agg(F.max("end").alias("_last"))
    tail = contigs.join(ends, keys, "left").select(
        *keys, F.coalesce("_last", F.lit(0)).cast("long").alias("start"), F.col("length").cast("long").alias("end")
    )
    return inner.unionByName(tail).filter(F.col("end") > F.col("start"))


def sort_by_genome(df: DataFrame, contigs: DataFrame, start: str = "start", by: str = "contig") -> DataFrame:
    """Order by contig rank (``ord``), then position; unknown contigs last by name."""
    ranks = contigs.select(F.col(by), F.col("ord").alias("_ord"))
    return (
        df.join(ranks, by, "left")
        .orderBy(F.col("_ord").asc_nulls_last(), F.when(F.col("_ord").isNull(), F.col(by)), start)
        .drop("_ord")
    )


def _renamed(df: DataFrame, taken: set[str], suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c + suffix if c in taken else c) for c in df.columns])


def _cells(start: Column, end: Column, bits: Column) -> Column:
    """Cells of 2^bits positions that [start, end) touches; an empty interval touches that of its start."""
    first = F.call_function("shiftright", start.cast("long"), bits)
    final = F.call_function("shiftright", end.cast("long") - 1, bits)
    return F.sequence(first, F.greatest(first, final))


def _met_in_bins(a: DataFrame, b: DataFrame, keys: list[str], s: str, e: str, extra: int, bin_size: int) -> DataFrame:
    """Pairs of rows that touch a bin, each once, in that of the later start; a row is copied to the bins it touches alone."""

    def touched(df: DataFrame, low: Column, high: Column) -> DataFrame:
        first, final = F.floor(low / F.lit(bin_size)).cast("long"), F.floor((high - 1) / F.lit(bin_size)).cast("long")
        return df.withColumn("_cell", F.explode(F.sequence(first, F.greatest(first, final))))

    left, right = touched(a, F.col("start"), F.col("end") + extra), touched(b, F.col(s), F.col(e) + extra)
    here = F.floor(F.greatest("start", s) / F.lit(bin_size)).cast("long")
    return left.join(right, [*keys, "_cell"]).filter(F.col("_cell") == here).drop("_cell")


def _meetings(a: DataFrame, b: DataFrame, keys: list[str], s: str, e: str, extra: int, bin_size: int | None) -> DataFrame:
    """Pairs of rows that share a cell, each pair once; ``b`` has its interval in (s, e).

    The level of an interval is the power of 4 next below its width. Two rows
    meet on the higher of their levels, in the cell of the later start: a row is
    copied to the cells that it touches on its own level and on the higher ones
    found on the other side. ``_cell`` holds the cell, the level and the side
    that is on its own level there. With ``bin_size`` rows meet in bins instead,
    see :func:`_met_in_bins`.
    """
    if bin_size:
        return _met_in_bins(a, b, keys, s, e, extra, bin_size)
    ends = {"a": (F.col("start"), F.col("end") + extra), "b": (F.col(s), F.col(e) + extra)}
    codes = 2 * (TOP_LEVEL + 1)

    def level(side: str) -> Column:
        low, high = ends[side]
        width = F.floor(F.log2(F.greatest(high - low, F.lit(1))) / 2)
        return F.when(low.isNotNull() & high.isNotNull(), F.least(F.greatest(width, F.lit(LEAST_LEVEL)), F.lit(TOP_LEVEL)).cast("int"))

    # at most TOP_LEVEL + 1 levels
    found = {side: df.agg(F.collect_set(level(side))).scalar() for side, df in (("a", a), ("b", b))}

    def keyed(df: DataFrame, side: str) -> DataFrame:
        low, high = ends[side]
        own, theirs = level(side), found["b" if side == "a" else "a"]

        # role 0: ``a`` is on its own level, ``b`` on that or a lower one; role 1: ``b`` is, ``a`` on a lower one
        mine, lowest = (0, F.array_min(theirs)) if side == "a" else (1, F.array_min(theirs) + 1)
        roles = [F.when(lowest <= own, own * 2 + mine)]
        for at in range(LEAST_LEVEL, TOP_LEVEL + 1):
            above = own < at if side == "a" else own <= at
            roles.append(F.when(above & F.array_contains(theirs, at), at * 2 + 1 - mine))
        each = df.withColumn("_role", F.explode(F.array(*roles))).filter(F.col("_role").isNotNull())
        cells = _cells(low, high, F.col("_role") - F.col("_role") % 2)
        return each.withColumn("_at", F.explode(cells)).select(*df.columns, (F.col("_at") * codes + F.col("_role")).alias("_cell"))

    met = keyed(a, "a").join(keyed(b, "b"), [*keys, "_cell"])
    code = F.pmod("_cell", F.lit(codes)).cast("int")
    later = F.call_function("shiftright", F.greatest("start", s).cast("long"), code - code % 2)
    return met.filter(F.col("_cell") == later * codes + code).drop("_cell")


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    by: str | list[str] = "contig",
    how: str = "inner",
    closed: bool = False,
    bin_size: int | None = None,
    suffix: str = "_b",
) -> DataFrame:
    """Rows of ``a`` and ``b`` whose intervals overlap.

    inner / left: pairs, found through one equi-join on (contig, level, cell),
    see :func:`_meetings`; widths may differ by any factor and no pair is formed
    twice. Rows up to 4^(``LEAST_LEVEL`` + 1) positions wide share the lowest level, so rows
    of like widths are copied to the cells they touch only. Cells end at 4^``TOP_LEVEL`` positions, so a long interval is spread
    over many and no cell is as wide as a contig. A deep cell is an ordinary
    skewed equi-join key, which adaptive execution splits. ``bin_size`` replaces
    the levels by bins of one width, see :func:`_met_in_bins`: for intervals whose
    widths are known to be alike this spares the pass that looks for levels.
    left_semi / left_anti: no pairs are formed at all, see :func:`overlaps_any`.
    Columns of ``b`` that clash with ``a`` get ``suffix``. Rows without a start or an end overlap nothing.
    """
    keys = _keys(by)
    if how in ("left_semi", "left_anti"):
        flagged = overlaps_any(a, b, by, closed)
        wanted = F.col("_hit") if how == "left_semi" else ~F.col("_hit")
        return flagged.filter(wanted).drop("_hit")
    if how == "left":
        pairs = overlap_join(a, b, by, "inner", closed, bin_size, suffix)
        rest = overlap_join(a, b, by, "left_anti", closed)
        return pairs.unionByName(rest, allowMissingColumns=True)
    extra = 1 if closed else 0
    other = _renamed(b, set(a.columns) - set(keys), suffix)
    s = "start" + suffix if "start" in a.columns else "start"
    e = "end" + suffix if "end" in a.columns else "end"
    overlap = (F.col("start") < F.col(e) + extra) & (F.col(s) < F.col("end") + extra)
    return _meetings(a, other, keys, s, e, extra, bin_size).filter(overlap)


def overlaps_any(a: DataFrame, b: DataFrame, by: str | list[str] = "contig", closed: bool = False) -> DataFrame:
    """Add ``_hit``: does a row of ``a`` overlap any row of ``b``?

    ``b`` is merged into disjoint intervals, so the only candidate is the last
    one starting before the end of the row. Those that start in a bin of
    2^``STAB_BITS`` positions are one row, at most half as many as positions;
    with it goes the furthest end of all earlier bins. A row looks up the bin of
    its end, so neither hot positions nor different ends are grouped.
    """
    keys = _keys(by)
    extra = 1 if closed else 0
    blocks = merge_intervals(b.select(*keys, "start", (F.col("end") + extra).alias("end")), by)
    held = blocks.select(
        *keys, F.shiftright(F.col("start").cast("long"), STAB_BITS).alias("_cell"), F.struct(F.col("start").cast("long").alias("from"), F.col("end").cast("long").alias("to")).alias("_block")
    )
    stops = a.withColumn("_at", (F.col("end") + extra - 1).cast("long")).withColumn("_cell", F.shiftright("_at", STAB_BITS))
    # bins in which no block starts are asked as well
    bins = (
        held.unionByName(stops.select(*keys, "_cell").distinct(), allowMissingColumns=True)
        .groupBy(*keys, "_cell")
        .agg(F.collect_list("_block").alias("_blocks"), F.max("_block.to").alias("_last"))
    )
    seen = running(bins, keys, "_cell", [Run("_reach", "max", F.col("_last"), inclusive=False)]).drop("_last")
    here = F.exists("_blocks", lambda block: (block["from"] <= F.col("_at")) & (block["to"] > F.col("start")))
    return (
        stops.join(seen, [*keys, "_cell"], "left")
        .withColumn("_hit", F.coalesce(F.col("_reach") > F.col("start"), F.lit(False)) | F.coalesce(here, F.lit(False)))
        .drop("_at", "_cell", "_blocks", "_reach")
    )


def intersect_intervals(a: DataFrame, b: DataFrame, by: str | list[str] = "contig") -> DataFrame:
    """Clipped intersection of every overlapping pair."""
    return (
        overlap_join(a, b, by)
        .withColumn("start", F.greatest("start", "start_b"))
        .withColumn("end", F.least("end", "end_b"))
        .drop("start_b", "end_b")
    )


def sweep(
    df: DataFrame, by: str | list[str] = "contig", bin_size: int = BIN, frame: DataFrame | None = None
) -> DataFrame:
    """Run-length depth segments (start, end, depth).

    With ``frame`` (keys, length) every key is tiled from 0 to its length, empty
    stretches included, and neighbouring segments always differ in depth.
    """
    keys = _keys(by)

    def event(at: Column, step: int) -> Column:
        return F.struct(at.cast("long").alias("start"), F.lit(step).cast("long").alias("step"))

    def events(rows: DataFrame, *found: Column) -> DataFrame:
        return rows.select(*keys, F.explode(F.array(*found)).alias("e")).select(*keys, "e.*")

    all_events = events(df.filter(F.col("end") > F.col("start")), event(F.col("start"), 1), event(F.col("end"), -1))
    if frame is not None:
        edges = events(frame, event(F.lit(0), 0), event(F.col("length"), 0))
        all_events = all_events.withColumn("edge", F.lit(False)).unionByName(edges.withColumn("edge", F.lit(True)))
    else:
        all_events = all_events.withColumn("edge", F.lit(True))
    points = (
        all_events.groupBy(*keys, "start")
        .agg(F.sum("step").alias("step"), F.max("edge").alias("edge"))
        .filter((F.col("step") != 0) | F.col("edge"))
    )
    return (
        running(
            points,
            keys,
            "start",
            [
                Run("depth", "sum", F.col("step")),
                Run("end", "min", F.col("start"), inclusive=False, backwards=True),
            ],
            bin_size,
        )
        .filter(F.col("end").isNotNull())
        .select(*keys, "start", "end", "depth")
    )


def coverage_gt(df: DataFrame, k: int = 1, by: str | list[str] = "contig") -> DataFrame:
    """Segments covered by more than ``k`` intervals."""
    return sweep(df, by).filter(F.col("depth") > k)


def variant_windows(v: DataFrame, window: int) -> DataFrame:
    """Interval of ``window`` bases around each variant, clipped at 0."""
    reach = F.greatest(F.length("ref"), F.lit(1))
    return v.withColumn("start", F.greatest(F.lit(0), F.col("pos") - window - 1)).withColumn(
        "end", F.col("pos") + reach + window
    )


def parse_region(text: str) -> tuple[str | None, int, int]:
    """``CONTIG:START-END`` or ``START,END``, 1-based and closed."""
    contig, sep, rest = text.strip().rpartition(":")
    parts = rest.split("-" if sep else ",")
    if len(parts) != 2 or not all(p.isdigit() for p in parts) or (sep and (not contig or ":" in contig)):
        raise ValueError(f"region must be START,END or CONTIG:START-END, not {text!r}")
    start, end = int(parts[0]), int(parts[1])
    if start < 1 or end < start:
        raise ValueError(f"invalid region {text!r}")
    return (contig or None), start, end


def _tagged(cells: Column, level: int, shift: int, start: Column, end: Column) -> Column:
    """Cells of 2^shift positions with the part of each that lies in [start, end)."""
    width = 2**shift

    def part(i: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), i.alias("cell"), F.greatest(start, i * width).alias("low"), F.least(end, (i + 1) * width).alias("high"))

    return F.transform(cells, part)


def block_cells(start: Column, end: Column) -> Column:
    """Disjoint (level, cell, low, high) that make up [start, end); on level 0 those at its ends may be covered in part."""
    cells = []
    for level in range(TREE_LEVELS):
        shift = TREE_BASE + TREE_SHIFT * level
        up = shift + TREE_SHIFT
        if level:
            low, high = F.shiftright(start + (2**shift - 1), shift), F.shiftright(end, shift)
        else:
            low, high = F.shiftright(start, shift), F.shiftright(end - 1, shift) + 1
        up_low = F.shiftright(start + (2**up - 1), up) * 2**TREE_SHIFT
        up_high = F.shiftright(end, up) * 2**TREE_SHIFT
        covered = (up_low < up_high) if level + 1 < TREE_LEVELS else F.lit(False)
        none = F.array().cast("array<bigint>")

        def between(lo: Column, hi: Column) -> Column:
            return F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(none)

        ids = F.when(covered, F.concat(between(low, up_low), between(up_high, high))).otherwise(between(low, high))
        cells.append(_tagged(ids, level, shift, start, end))
    return F.concat(*cells)


def best_block(
    points: DataFrame, blocks: DataFrame, rank: Column, keep: list[str], by: str | list[str] = "contig", at: str = "pos0"
) -> DataFrame:
    """Left join of each point to the covering block [start, end) of highest ``rank``.

    The blocks are sorted once and numbered, so that only one LONG each goes on:
    they are cut into aligned cells of 2^``TREE_BASE`` positions and powers of 16
    of that, and every different part of a cell keeps its highest number. Only
    the lowest cells, those at the ends of a block, may be covered in part. A
    point asks the one cell per level that contains it, up to the level of the
    longest block, and looks its winner up. A cell has bounded numbers of parts
    and of points, so neither deep coverage nor a hot position multiplies rows.
    ``rank`` is a struct whose last fields make ties explicit. Blocks that hold
    no position win nothing.
    """
    keys = _keys(by)
    places = blocks.select(*keys, F.col("start").cast("long").alias("_from"), F.col("end").cast("long").alias("_to"), rank.alias("_rank"), F.struct(*keep).alias("_row"))
    # numbers rise through the partitions of a sorted table; written, they stay what they are
    numbered = stage(places.filter("_from < _to").orderBy("_rank").withColumn("_no", F.monotonically_increasing_id()).drop("_rank"))
    longest = F.coalesce(numbered.agg(F.max(F.col("_to") - F.col("_from"))).scalar(), F.lit(1).cast("long"))
    # a block shorter than the cells of a level holds none of them
    fits = F.floor((F.length(F.bin(longest)) - 1 - TREE_BASE) / TREE_SHIFT)
    top = F.greatest(F.least(fits, F.lit(TREE_LEVELS - 1)), F.lit(0)).cast("int")
    tree = (
        numbered.select(*keys, "_no", F.explode(block_cells(F.col("_from"), F.col("_to"))).alias("_cell"))
        .groupBy(*keys, F.col("_cell.level").alias("_level"), F.col("_cell.cell").alias("_at"), F.col("_cell.low").alias("_low"), F.col("_cell.high").alias("_high"))
        .agg(F.max("_no").alias("_no"))
    )
    asks = points.select(*keys, at).distinct().withColumn("_level", F.explode(F.sequence(F.lit(0), top)))
    winners = (
        asks.withColumn("_at", F.call_function("shiftright", F.col(at).cast("long"), F.col("_level") * TREE_SHIFT + TREE_BASE))
        .join(tree, [*keys, "_level", "_at"])
        .filter((F.col("_low") <= F.col(at)) & (F.col(at) < F.col("_high")))
        .groupBy(*keys, at)
        .agg(F.max("_no").alias("_no"))
    )
    found = winners.join(numbered.select("_no", "_row"), "_no").select(*keys, at, "_row.*")
    return points.join(found, [*keys, at], "left")


def nearest_distance(
    points: DataFrame, targets: DataFrame, by: str | list[str], on: str = "pos", name: str = "distance"
) -> DataFrame:
    """Distance of each point to the nearest target on its key; NULL if there is none."""
    keys = _keys(by)
    marks = (
        points.select(*keys, on, F.lit(None).cast("long").alias("_hit"))
        .unionByName(targets.select(*keys, on, F.col(on).cast("long").alias("_hit")))
        .groupBy(*keys, on)
        .agg(F.max("_hit").alias("_hit"))
    )
    seen = running(
        marks,
        keys,
        on,
        [Run("_before", "near", F.col("_hit")), Run("_after", "near", F.col("_hit"), backwards=True)],
    ).select(
        *keys, on, F.least(F.col(on) - F.col("_before"), F.col("_after") - F.col(on)).cast("long").alias(name)
    )
    return points.join(seen, [*keys, on], "left")
