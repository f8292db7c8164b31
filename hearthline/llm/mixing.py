"""Mixing sources to target weights by Pfair scheduling.

A source of weight w gets block number i (from 1) released at slot floor((i - 1) / w) and due by slot
ceil(i / w). Earliest deadline first over the released blocks gives one block a slot and keeps each
source within less than one block of its weight at every slot. When a source runs out, the others go on
with their weights scaled up: releases and deadlines follow the slots T(v), the sum over sources of
min(weight * v, blocks), at v = i / weight. Weights are taken as exact fractions; every source has its own.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.llm.files import NewFile, free_name, open_store, saved, scratch

#: Slots of a period of ``slots_of``.
PERIOD = 1_000
#: Rows of a block.
BLOCK = 16
#: Stream of the sources without a weight of their own.
REST = "(rest)"
#: Blocks, as a power of two, whose slots stand in one file.
CHUNK = 20


def slots_of(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots of a period for each source, by largest remainder; at least one each. ``mix`` takes weights as they are."""
    total = sum(weights.values())
    if not weights or total <= 0 or min(weights.values()) <= 0 or len(weights) > period:
        raise ValueError("weights must be positive, and fewer than the slots of a period")
    left = period - len(weights)
    exact = {s: w / total * left for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in order[: period - sum(out.values())]:
        out[s] += 1
    return out


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    if not all(math.isfinite(w) and w > 0 for w in weights):
        raise ValueError("weights must be positive and finite")
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(x.denominator for x in exact))
    return [int(x * scale) for x in exact]


def slots(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int]]:
    """(source, number of its block from 0) of each slot, for sources with the given blocks and whole weights.

    Among equal deadlines the earlier source goes first. Memory is in proportion to the sources.
    """
    shift = 2 * max(weights, default=1).bit_length() + 1  # tells any two different i / weight apart
    ends, gone, live = [], [0], [sum(weights)]
    for end, s in sorted(((n << shift) // weights[s], s) for s, n in enumerate(blocks)):
        ends.append(end)
        gone.append(gone[-1] + blocks[s])
        live.append(live[-1] - weights[s])
    waiting = [(0, s, 0) for s in range(len(blocks))]
    ready: list[tuple[int, int, int, int]] = []
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            k = bisect_left(ends, ((i + 1) << shift) // weights[s])
            full, part = divmod(live[k] * (i + 1), weights[s])
            heapq.heappush(ready, (gone[k] + full + (part > 0), s, i, gone[k] + full))
        deadline, s, i, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        yield s, i
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, (release, s, i + 1))


def schedule(counts: dict[str, int]) -> list[tuple[str, int]]:
    """(source, number of its block from 0) of each slot of a period with the given blocks per source.

    Among equal deadlines the source that sorts first goes first.
    """
    names = sorted(counts)
    sizes = [counts[s] for s in names]
    return [(names[s], i) for s, i in slots(sizes, sizes)]


def numbered(rows: DataFrame, by: str, order: list[Column], into: str) -> DataFrame:
    """Number the rows of each ``by`` from 0 in ``order`` without gathering a group in one task.

    Rows are range-partitioned by (by, order) and written; a row's number is its place in its slice plus
    the rows of its group in earlier slices. The broadcast table has a row for each slice and group that
    meet, which is less than slices plus groups.
    """
    place, by2, slice_, least, before = (free_name(rows, n) for n in ("place", "by2", "slice", "least", "before"))
    laid = saved(
        rows.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order)
        .withColumn(place, F.monotonically_increasing_id()), "slices",
    )
    at = F.shiftright(place, 33)
    counts = laid.groupBy(F.col(by).alias(by2), at.alias(slice_)).agg(F.min(place).alias(least), F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(by2).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(by2, slice_, least, F.coalesce(earlier, F.lit(0)).alias(before))
    return laid.join(F.broadcast(starts), (F.col(by) == F.col(by2)) & (at == F.col(slice_))).withColumn(
        into, F.col(place) - F.col(least) + F.col(before)
    ).drop(place, by2, slice_, least, before)


def tempered(counts: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Weights in proportion to a power of the sizes; below one it lifts small sources."""
    return {s: n ** power for s, n in counts.items()}


def stream_weights(sizes: dict[str, int], weights: dict[str, float] | None) -> dict[str, float]:
    """Weight of each stream; REST has its share of the rows unless given."""
    if weights is None:
        return tempered(sizes)
    out = {s: weights[s] for s in sizes if s in weights}
    if REST in sizes and REST not in weights:
        named = sum(sizes[s] for s in out)
        out[REST] = sizes[REST] * sum(out.values()) / named if named else 1.0
    return out


def placed_blocks(sizes: DataFrame, weights: dict[str, float] | None, block: int) -> tuple[DataFrame, list[str]]:
    """(mix_stream, base) per stream of ``sizes`` (mix_stream, n), and the files with the slots of base + block number.

    One task schedules all blocks in order of their slots, and passes them on as they come; the slots are then
    brought into the order of the blocks and written in files of 2 ** CHUNK.
    """
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            known.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        if not known:
            return
        share = stream_weights(known, weights)
        blocks = [-(-n // block) for n in known.values()]
        yield pa.RecordBatch.from_arrays([
            pa.array(list(known)), pa.array(np.cumsum([0, *blocks[:-1]])), pa.array(blocks, pa.int64()),
            pa.array([share[s] for s in known], pa.float64()),
        ], ["mix_stream", "base", "blocks", "weight"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, blocks, share = ([x for part in column for x in part] for column in zip(
            *([c.to_pylist() for c in batch.columns] for batch in batches))) if (batches := list(batches)) else ([], [], [])
        at, start = [], 0
        for s, i in slots(blocks, whole(share)) if blocks else ():
            at.append(base[s] + i)
            if len(at) == 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.arange(start, start + len(at)))], ["at", "slot"])
                at, start = [], start + len(at)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.arange(start, start + len(at)))], ["at", "slot"])

    folder = scratch(sizes.sparkSession, "slots")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, chunk = None, None
        for batch in batches:
            at, slot = (c.to_numpy() for c in batch.columns)
            for own in np.unique(at >> CHUNK).tolist():
                if own != chunk:
                    if file:
                        file.close()
                        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([file.uri])], ["chunk", "uri"])
                    file, chunk = NewFile(folder, ".slots"), own
                file.write(slot[at >> CHUNK == own].astype("<i8").tobytes())
        if file:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([file.uri])], ["chunk", "uri"])

    plans = saved(sizes.select("mix_stream", "n").repartition(1).sortWithinPartitions("mix_stream").mapInArrow(
        plan, "mix_stream string, base long, blocks long, weight double"), "streams")
    placed = plans.select("base", "blocks", "weight").repartition(1).sortWithinPartitions("base").mapInArrow(place, "at long, slot long")
    files = placed.repartition(F.shiftright("at", CHUNK)).sortWithinPartitions("at").mapInArrow(write, "chunk long, uri string")
    # grouped: a table without file metadata of its own, which would make that of the rows ambiguous
    return plans.groupBy("mix_stream").agg(F.min("base").alias("base")), [r.uri for r in sorted(files.collect())]


@lru_cache(maxsize=4)
def slots_in(uri: str) -> np.ndarray:
    store, path = open_store(uri)
    with store.open_input_stream(path, compression=None) as stream:
        return np.frombuffer(stream.read(), "<i8")


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", id_col: str = "doc_id",
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` with mix_stream, mix_slot, mix_position (replacing columns of those names).

    Every row gets a position; ascending positions are the mix. Without ``weights`` every source, however
    small, is a stream weighted by the square root of its size; null sources form the stream "(rest)". With
    ``weights`` the rows of sources without one, null sources included, form "(rest)", weighted by its share
    of the rows unless given. In a source, rows are taken in order of a hash of their id, null ids too;
    repeated rows are rows of their own. Positions are unique but not gapless: the last block of a source
    may not be full. An empty table gives an empty result; rows are never dropped or repeated.
    """
    plain = docs.drop(*[c for c in docs.columns if c.lower() in ("mix_stream", "mix_slot", "mix_position")])
    name = F.col(source).cast("string")
    if weights is None:
        stream = F.coalesce(name, F.lit(REST))
    else:
        whole(list(weights.values()))  # raises on weights that cannot be followed
        known = [s for s in sorted(weights) if s != REST]
        stream = F.when(name.isin(known), name).otherwise(REST) if known else F.lit(REST)
    number, base = free_name(plain, "number"), free_name(plain, "base")
    order = [F.xxhash64(id_col), F.col(id_col)]
    rows = numbered(plain.withColumn("mix_stream", stream), "mix_stream", order, number)
    streams, files = placed_blocks(rows.groupBy("mix_stream").agg(F.count(F.lit(1)).alias("n")), weights, block)

    @F.pandas_udf("long")
    def slot_at(at: pd.Series) -> pd.Series:
        places = at.to_numpy()
        out = np.empty(len(places), np.int64)
        for chunk in np.unique(places >> CHUNK).tolist():
            own = places >> CHUNK == chunk
            out[own] = slots_in(files[chunk])[places[own] & ((1 << CHUNK) - 1)]
        return pd.Series(out)

    starts = streams.select(F.col("mix_stream").alias(free_name(rows, "stream2")), F.col("base").alias(base))
    slotted = rows.join(F.broadcast(starts), F.col("mix_stream") == F.col(starts.columns[0])).withColumn(
        "mix_slot", slot_at(F.col(base) + F.floor(F.col(number) / block)))
    return slotted.select(
        *[F.col(c) for c in plain.columns], "mix_stream", "mix_slot",
        (F.col("mix_slot") * block + F.col(number) % block).alias("mix_position"),
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows laid out by position: written to Parquet, the files by name and their rows are the mix."""
    return mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").drop(
        "mix_stream", "mix_slot", "mix_position"
    )


def ordered_rows(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` in the order of their mix, with all their columns, whatever their names."""
    clash = [c for c in docs.columns if c.lower() in ("mix_stream", "mix_slot", "mix_position")]
    if not clash:
        return in_order(mix(docs))
    packed = free_name(docs, "row")
    return in_order(mix(docs.select("doc_id", "source", F.struct(*docs.columns).alias(packed)))).select(f"{packed}.*")
