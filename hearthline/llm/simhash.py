"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within three bits agree in two of five bit ranges, so equal pairs of ranges bring the
candidates together (ten tables, exact). Inside a candidate block the fingerprints stand as 64 bit
planes. One step compares every lane with the lane d places on: the planes and their shifted
copies are xored, carry-save adders count the differing bits of 64 pairs per word, and words whose
pairs all exceed the radius are abandoned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.llm.components import roots
from hearthline.llm.files import free_name, saved

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Bit ranges (first bit, width); two equal ones of five are certain within three differing bits.
RANGES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Distinct fingerprints of one candidate block; larger buckets become pairs of blocks.
BLOCK = 1024
#: Text is cut at white space into pieces of about this many bytes, which bounds a task's memory.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Compared lane pairs held at once.
PAIRS = 1 << 22


def pieces(data: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(data):
        cut = SPACE.search(data, min(start + PIECE, len(data)))
        end = cut.start() if cut else len(data)
        yield data[start:end]
        start = end


def fingerprint(data: bytes | None) -> int:
    """Fingerprint of a UTF-8 text as an unsigned 64-bit number; without words it is zero."""
    digest = xxhash.xxh64_intdigest
    ones, total, rest = np.zeros(64, np.int64), 0, []
    for piece in pieces((data or b"").lower()):
        rest += piece.split()
        if len(rest) < SHINGLE:
            continue
        line = b" ".join(rest)
        sizes = np.fromiter(map(len, rest), np.int64, len(rest))
        ends = np.cumsum(sizes + 1) - 1
        first, last = (ends - sizes)[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1:].tolist()
        h = np.array([digest(line[a:b], SEED) for a, b in zip(first, last)], np.uint64)
        ones += bit_counts(h)
        total += len(h)
        rest = rest[1 - SHINGLE:]
    if not total and rest:
        ones, total = bit_counts(np.array([digest(b" ".join(rest), SEED)], np.uint64)), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def bit_counts(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])


def _marked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = next(_fingerprint_batches(iter([batch])))
        yield pa.RecordBatch.from_arrays([*prints.columns, batch.column(2)], ["id", "fp", "mark"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marked: bool = False) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint's bits as a signed long. With ``marked`` also mark, a hash of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"),
                       *([F.xxhash64(text_col).alias("mark")] if marked else []))
    return rows.mapInArrow(*((_marked_batches, "id long, fp long, mark long") if marked else (_fingerprint_batches, "id long, fp long")))


def planes_of(values: np.ndarray) -> np.ndarray:
    """(64, words): word w of plane b holds bit b of values 64w to 64w+63; one spare word follows."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    words = -(-len(values) // 64) + 1
    out = np.zeros((64, words * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def lanes_of(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(-(-len(mask) // 64) * 64, np.uint8)
    out[: len(mask)] = mask
    return np.packbits(out, bitorder="little").view("<u8")


def close_lanes(planes: np.ndarray, step: int, together: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lanes i set in ``together`` whose value differs from that of lane i + step in radius bits at most.

    ``radius`` is 3: a pair exceeds it as soon as a carry leaves its two-bit counter.
    """
    if radius != 3:
        raise ValueError("the two-bit counters are made for a radius of 3")
    alive = lanes_of(together)
    at = np.flatnonzero(alive)
    alive = alive[at]
    skip, turn = divmod(step, 64)
    low, high = np.uint64(turn), np.uint64((64 - turn) % 64)
    last = planes.shape[1] - 1
    one = np.zeros(len(at), np.uint64)
    two = np.zeros(len(at), np.uint64)
    for b in range(0, 64, 2):
        near, far = np.minimum(at + skip, last), np.minimum(at + skip + 1, last)

        def differ(plane: np.ndarray) -> np.ndarray:
            moved = plane[near] >> low
            if turn:
                moved |= plane[far] << high
            return plane[at] ^ moved

        x, y = differ(planes[b]), differ(planes[b + 1])
        half = one ^ x
        carry = (one & x) | (half & y)
        one = half ^ y
        alive &= ~(two & carry)
        two ^= carry
        if b % 8 == 6:
            keep = np.flatnonzero(alive)
            if len(keep) < len(at):
                at, alive, one, two = at[keep], alive[keep], one[keep], two[keep]
            if not len(at):
                return at
    bits = np.unpackbits(alive.view(np.uint8), bitorder="little").reshape(-1, 64)
    word, lane = np.nonzero(bits)
    return at[word] * 64 + lane


def local_links(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (smallest row, row) of the components that close values of equal groups form.

    Rows of a group stand together. All pairs of a group are compared, only the stars are returned.
    """
    n = len(values)
    planes = planes_of(values)
    left, right = [], []
    step = 1
    while step < n:
        together = group[:-step] == group[step:]
        if not together.any():
            break
        found = close_lanes(planes, step, together)
        left.append(found)
        right.append(found + step)
        step += 1
    label = np.arange(n)
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while len(a):
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            new = new[new]
            if (new == label).all():
                break
            label = new
    rows = np.flatnonzero(label != np.arange(n))
    return label[rows], rows


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def edges(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """rows: key, block, value, sorted by key and block; whole groups only."""
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(rows)])
        order = np.argsort(sizes, kind="stable")  # groups of like size share their steps
        begin = 0
        while begin < len(order):
            load = np.cumsum(sizes[order[begin:]].astype(np.int64) ** 2)
            end = begin + max(1, int(np.searchsorted(load, PAIRS, side="right")))
            chosen = order[begin:end]
            take = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in chosen])
            values = rows[take, 2]
            a, b = local_links(np.repeat(np.arange(len(chosen)), sizes[chosen]), values.view(np.uint64))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(values[a]), pa.array(values[b])], ["u", "v"])
            begin = end

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        held.append(rows)
        if (rows[0, :2] == rows[-1, :2]).all():
            continue
        rows = np.concatenate(held)
        cut = int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))[-1]) + 1
        yield from edges(rows[:cut])
        held = [rows[cut:]]
    if held:
        yield from edges(np.concatenate(held))


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints ``fp`` within the radius of each other.

    Not every close pair is a row: each block of candidates gives the stars of its components, so rows
    stay in proportion to fingerprints and no connection is lost. A bucket above the block size is
    dealt into blocks by hash and every pair of its blocks is compared.
    """
    ranges = [
        F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1)) for first, width in RANGES
    ]
    width = RANGES[0][1]
    pairs = [(i, j) for i in range(len(ranges)) for j in range(i + 1, len(ranges))]
    keys = prints.select("fp", F.explode(F.array(*[
        F.lit(k << 2 * width).bitwiseOR(F.shiftleft(ranges[i], width)).bitwiseOR(ranges[j])
        for k, (i, j) in enumerate(pairs)
    ])).alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = keys.join(sizes, "key").select("key", "fp", blocks.alias("blocks")).select(
        "key", "fp", "blocks", own.alias("own")
    ).select("key", "fp", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: (
            F.least(other, F.col("own")).cast("long") * F.col("blocks") + F.greatest(other, F.col("own"))
        ))
    )).alias("block"))
    return met.repartition("key", "block").sortWithinPartitions("key", "block").select("key", "block", "fp").mapInArrow(
        _link_batches, "u long, v long"
    )


def _rooted(rows: DataFrame, least: Column) -> DataFrame:
    """(fp, the aggregate ``least`` of its rows, root): each distinct fingerprint and that of its component."""
    prints = saved(rows.groupBy("fp").agg(least), "prints")
    tied = saved(roots(links(prints)), "roots").select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return prints.join(tied, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    The component is the smallest id reachable over links of at most three differing bits, the row's own
    id included. Null and empty texts and texts of white space have fingerprint zero and link like any
    other. Repeated rows give repeated result rows. A null id is kept; it never becomes a component id
    unless a component has no other. Other columns of ``docs`` are not read. An empty table gives none.
    """
    rows = saved(fingerprints(docs, id_col, text_col), "fingerprints")
    of = _rooted(rows, F.min("id").alias("least_id"))
    least = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """Documents without near copies: of each component one row stays, that with the smallest doc_id.

    A row with a null id stays where its component has no id; different texts that share an id, null ids among them, are
    rows of their own. Of rows of one component and id that with the smallest hash of its text stays, and of repeated rows
    the first by source and lang. An empty table gives none.
    """
    mark, nth = free_name(docs, "mark"), free_name(docs, "nth")
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark")
    first = _rooted(saved(fingerprints(docs, marked=True), "fingerprints"), F.min(order).alias("first")).groupBy("root").agg(
        F.min("first").alias("first"))
    kept = first.select(F.col("first.id").alias(free_name(docs, "kept_id")), F.col("first.mark").alias(free_name(docs, "kept_mark")))
    left = docs.withColumn(mark, F.xxhash64("text"))
    left = left.join(kept, F.col("doc_id").eqNullSafe(F.col(kept.columns[0])) & (F.col(mark) == F.col(kept.columns[1])), "left_semi")
    ties = [c for c in ("source", "lang") if c in docs.columns]
    number = F.row_number().over(Window.partitionBy("doc_id", mark).orderBy(*(ties or [mark])))
    return left.withColumn(nth, number).filter(F.col(nth) == 1).drop(nth, mark)
