"""Benchmark decontamination by Wu-Manber search over words.

Test strings are windows of ten consecutive words of a benchmark item, or a whole item of fewer words.
Strings of one length share a table. The search looks at the last two words of the current place (a
block): the shift table tells how far the place may move on, a shift of zero leads to the bucket of the
strings that end in the block, sorted by their first block, and a direct comparison confirms.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthline.llm.files import free_name, open_store, saved, scratch
from hearthline.llm.words import covered, words_of

WINDOW = 10
#: Words of a block (fewer in shorter strings).
BLOCK = 2
#: Bytes of test strings that one search table is built from; a larger benchmark is searched in parts.
PART_BYTES = 64 << 20

#: Names of the result's own columns.
RESULT_ORDER = ("n_words", "n_hit", "n_items", "items_sha256")
RESULTS = {*RESULT_ORDER, "contaminated"}

Strings = list[tuple[tuple[bytes, ...], str]]


class SearchTable:
    """Shift table and suffix buckets of the strings of each length."""

    def __init__(self, strings: Strings):
        by_length: dict[int, dict[tuple, set[str]]] = defaultdict(lambda: defaultdict(set))
        for words, item in strings:
            by_length[len(words)][words].add(item)
        self.tables = []
        for m, found in sorted(by_length.items()):
            block = min(BLOCK, m)
            shift: dict = {}
            buckets: dict = defaultdict(lambda: defaultdict(list))
            for words, items in found.items():
                for end in range(block, m + 1):
                    key = words[end - block:end]
                    shift[key] = min(shift.get(key, m - block + 1), m - end)
                buckets[words[-block:]][words[:block]].append((words, frozenset(items)))
            self.tables.append((m, block, shift, {k: dict(v) for k, v in buckets.items()}))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of all occurrences, and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for m, block, shift, buckets in self.tables:
            far, end, n = m - block + 1, m, len(words)
            while end <= n:
                key = tuple(words[end - block:end])
                move = shift.get(key, far)
                if move:
                    end += move
                    continue
                start = end - m
                for string, owners in buckets[key].get(tuple(words[start:start + block]), ()):
                    if tuple(words[start:end]) == string:
                        spans.append((start, end))
                        items |= owners
                end += 1
        return spans, items


def windows(text: bytes | None, window: int = WINDOW) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if not words:
        return set()
    return {tuple(words[i:i + window]) for i in range(max(1, len(words) - window + 1))}


def _windows_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = [b" ".join(w) for w in windows(text.as_py(), window)]
            yield pa.RecordBatch.from_arrays([
                pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary()),
                pa.array([int.from_bytes(hashlib.blake2b(w, digest_size=4).digest(), "big") for w in found], pa.int64()),
            ], ["item", "string", "h"])


def _search_batches(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [words_of(x.as_py()) for x in batch.column(0)]
        found = [table.value.search(w) for w in words]
        yield _results(batch.columns[1:], batch.schema.names[1:], map(len, words), found)


def _results(kept: list, names: list[str], n_words, found: list) -> pa.RecordBatch:
    """Result columns from the spans and items of each document."""
    items = [",".join(sorted(x)) for _, x in found]
    return pa.RecordBatch.from_arrays([
        *kept,
        pa.array(n_words, pa.int64()),
        pa.array([covered(s) for s, _ in found], pa.int64()),
        pa.array([len(x) for _, x in found], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in items], pa.string()),
    ], [*names, "n_words", "n_hit", "n_items", "items_sha256"])


def _part_hits(batches: Iterator[pa.RecordBatch], folder: str, part: int) -> Iterator[pa.RecordBatch]:
    """(row, n_words, starts, ends, items) of the documents with hits in one part; the first part reports all documents.

    The table is built once, for all batches of the task.
    """
    table = SearchTable(_read_part(folder, part))
    for batch in batches:
        out: list[tuple] = []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = words_of(text.as_py())
            spans, items = table.search(words)
            if spans or part == 0:
                out.append((row, len(words), [a for a, _ in spans], [b for _, b in spans], sorted(items)))
        columns = zip(*out) if out else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types)], ["row", "n_words", "starts", "ends", "items"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results from each document's spans and items of all parts."""
    for batch in batches:
        row, n_words, *lists = (batch.column(n) for n in ("row", "n_words", "starts", "ends", "items"))
        found = [(list(zip(a, b)), set(x)) for a, b, x in zip(*(c.to_pylist() for c in lists))]
        yield _results([row], ["row"], n_words.to_pylist(), found)


def _read_part(folder: str, part: int) -> Strings:
    import pyarrow.dataset as ds

    store, path = open_store(folder)
    found = ds.dataset(path, filesystem=store, format="parquet", partitioning="hive").to_table(filter=ds.field("part") == part)
    return [(tuple(s.split(b" ")), i) for s, i in zip(found["string"].to_pylist(), found["item"].to_pylist())]


def contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` with n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts document words inside any occurrence of a test string. Null and empty texts have no
    words and no hits; items without words and items with a null id find nothing; item ids may be of any
    type and sort as text. A benchmark up to ``part_bytes`` of strings is one search table; beyond that its
    strings are dealt into parts by hash. Documents are then written with a row number, each part makes a
    pass over them with a table built once a task, and only rows with hits leave a pass, to be added up by
    row; the result is the same. Repeated document rows each give a row; an id that repeats in the
    benchmark counts as one item.
    """
    spark: SparkSession = docs.sparkSession
    folder = scratch(spark, "strings")
    strings = saved(
        benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
        .filter("item is not null").mapInArrow(lambda b: _windows_of(b, window), "item string, string binary, h long"),
        "windows",
    )
    size = strings.agg(F.sum(F.length("string") + 64)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    kept = docs.select(keep)
    data = F.col("text").cast("binary")
    results = "n_words long, n_hit long, n_items long, items_sha256 string"
    if parts == 1:
        table = spark.sparkContext.broadcast(SearchTable([
            (tuple(bytes(r.string).split(b" ")), r.item) for r in strings.select("item", "string").toLocalIterator()
        ]))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
        found = docs.select(data.alias(free_name(kept, "data")), *keep).mapInArrow(
            lambda b: _search_batches(b, table), f"{schema}, {results}")
        return found.withColumn("contaminated", F.col("n_hit") > 0)

    strings.withColumn("part", F.col("h") % parts).repartition(int(parts), "part").write.partitionBy("part").parquet(folder)
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), data.alias("data"), F.struct(*keep).alias("kept")), "rows")
    hits = None
    for part in range(parts):
        one = rows.select("row", "data").mapInArrow(
            lambda b, part=part: _part_hits(b, folder, part),
            "row long, n_words long, starts array<int>, ends array<int>, items array<string>")
        hits = one if hits is None else hits.unionByName(one)
    whole = hits.groupBy("row").agg(
        F.max("n_words").alias("n_words"), *[F.flatten(F.collect_list(n)).alias(n) for n in ("starts", "ends", "items")])
    found = whole.mapInArrow(_added, f"row long, {results}")
    return rows.select("row", "kept").join(found, "row").select("kept.*", *RESULT_ORDER, (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no test string occurs, with all their columns.

    Documents without words stay. A passage planted in a long document removes the document.
    """
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    if len(kept) < len(docs.columns):  # names that clash with the result's own
        packed = free_name(docs, "row")
        boxed = docs.select("text", F.struct(*docs.columns).alias(packed))
        return contamination(boxed, benchmark, [packed]).filter(~F.col("contaminated")).select(f"{packed}.*")
    return contamination(docs, benchmark, docs.columns).filter(~F.col("contaminated")).select(docs.columns)
