"""Token-id files with a minimal perfect hash index.

Format: a shard is a file of raw little-endian ids, documents one after another. The index is dealt by key
hash into buckets. A bucket is a file with the displacements of a minimal perfect hash over its keys and,
by slot, the key's fingerprint, shard number, offset in ids and row count; a keyed read is one hash, one slot
and one range of a shard. The document table keeps each row's shard, place and length for scans.
"""

from __future__ import annotations

import io
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthline.llm.files import NewFile, open_store, save, scratch
from hearthline.llm.perfect_hash import PerfectHash

#: Keys of an index bucket, on average: bounds the memory of the task that builds or reads it.
KEYS_PER_BUCKET = 100_000
#: Pieces whose ids a Python worker remembers, over all tasks that it runs.
REMEMBERED = 1 << 19
#: Ids of a document that are read at once.
READ_IDS = 1 << 20
END_ID = 1
#: Split of the supported tokenizers, a fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of a text by a tokenizer file of the tokenizers library, remembered by piece.

    For tokenizers that lower-case, drop white space and split words by ``WORD_PATTERN``. Texts of ASCII and Latin-1
    letters are split by that pattern here (normal forms leave them as they are); other texts, and texts that may hold
    a special token, go to the library as whole chunks between blanks, which no piece crosses. The library encodes
    every piece or chunk that isn't remembered.
    """

    SIMPLE = re.compile(r"[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\x09-\x0d\x20a-z0-9\xdf-\xf6\xf8-\xff]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        state = json.loads(self.tokenizer.to_str())
        splits = [x["pattern"].get("Regex") for x in (state["pre_tokenizer"] or {}).get("pretokenizers", []) if "pattern" in x]
        lowers = any(x["type"] == "Lowercase" for x in (state["normalizer"] or {}).get("normalizers", []))
        if splits != [WORD_PATTERN] or not lowers:
            raise ValueError("this encoder knows lower-casing word tokenizers only")
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned integers of ``dtype``, without an end id."""
        if self.SIMPLE.fullmatch(text) and "<|" not in text:
            return self._joined(self.PIECES.findall(text.lower()), self.pieces, self._encode_pieces)
        blanks = text.replace("\t", " ").replace("\n", " ").replace("\r", " ")
        return self._joined(blanks.split(" "), self.chunks, self._encode_chunks)

    def _joined(self, parts: list[str], known: dict[str, bytes], encode: Callable[[list[str]], None]) -> bytes:
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            encode([p for p in dict.fromkeys(parts) if p not in known])
            return b"".join([known[p] for p in parts])

    def _encode_pieces(self, new: list[str]) -> None:
        """Pieces side by side between blanks are words of their own to the tokenizer."""
        for at in range(0, len(new), 256):
            some = new[at:at + 256]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            words, ids = np.array(found.word_ids, np.int64), np.array(found.ids, self.dtype)
            cuts = np.searchsorted(words, np.arange(len(some) + 1))
            if len(words) and words[-1] + 1 == len(some) and (np.diff(cuts) > 0).all():
                for k, p in enumerate(some):
                    self.pieces[p] = ids[cuts[k]:cuts[k + 1]].tobytes()
            else:
                for p in some:
                    self.pieces[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, self.dtype).tobytes()

    def _encode_chunks(self, new: list[str]) -> None:
        for p, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False)):
            self.chunks[p] = np.array(e.ids, self.dtype).tobytes()


@cache
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


@dataclass
class TokenFiles:
    """A written token data set: ``rows`` (key, shard, ordinal, at, n), ``shards`` (shard, path, first, ids), ``index``
    (bucket, path). ``at`` counts ids in the shard, ``first`` the ids of earlier shards."""

    spark: SparkSession
    folder: str
    dtype: str
    rows: DataFrame
    shards: DataFrame
    index: DataFrame
    buckets: int


def _write_shards(folder: str, tokenizer: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, at, ordinal = encoder_of(tokenizer), None, 0, 0
        end = np.array([end_id], encoder.dtype).tobytes()
        width = len(end)
        for batch in batches:
            file = file or NewFile(f"{folder}/shards", ".ids")
            ats, sizes = [], []
            for text in batch.column(1):
                data = encoder.encode(text.as_py() or "") + end
                file.write(data)
                ats.append(at)
                sizes.append(len(data) // width)
                at += sizes[-1]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([file.uri] * n), pa.array(np.arange(ordinal, ordinal + n)),
                pa.array(ats, pa.int64()), pa.array(sizes, pa.int64()),
            ], ["key", "part", "path", "ordinal", "at", "n"])
            ordinal += n
        if file:
            file.close()
    return run


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_index(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def write(table: pa.Table) -> pa.RecordBatch:
            keys = table["key"].to_numpy().view(np.uint64)
            hash_ = PerfectHash.build(keys)
            at = hash_.slots(keys)

            def by_slot(values: np.ndarray) -> np.ndarray:
                out = np.empty_like(values)
                out[at] = values
                return out

            data = io.BytesIO()
            np.savez(data, seed=hash_.seed, shifts=hash_.shifts, prints=by_slot(hash_.fingerprints(keys)), **{
                c: by_slot(table[c].to_numpy()) for c in ("shard", "ordinal", "at", "rows", "n")
            })
            file = NewFile(f"{folder}/index", ".npz")
            file.write(data.getvalue())
            file.close()
            return pa.RecordBatch.from_pydict({"bucket": table["bucket"][:1].to_pylist(), "path": [file.uri]},
                                              pa.schema([("bucket", pa.int32()), ("path", pa.string())]))

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            while table.num_rows:
                first = table["bucket"][0].as_py()
                n = int(np.searchsorted(table["bucket"].to_numpy(), first, side="right"))
                if held and held[0]["bucket"][0].as_py() != first:
                    yield write(pa.concat_tables(held))
                    held = []
                held.append(table.slice(0, n))
                table = table.slice(n)
        if held:
            yield write(pa.concat_tables(held))
    return run


def write_tokens(
    docs: DataFrame, tokenizer: str, order: list[str], key: str = "doc_id", text: str = "text", end_id: int = END_ID,
    folder: str | None = None,
) -> TokenFiles:
    """Encode ``text`` of every row, append ``end_id`` and write ids in ascending ``order``, with an index over ``key``.

    Null and empty texts have the end id alone. Null keys sort first, are written, and have no index entry. Rows
    that repeat a key stand together if ``order`` begins with the key, and the index entry covers them all;
    in another order it names the first of them. An empty table gives no shard and an empty index. Each task writes
    its range of the order as one shard under a new name; tables name only the files of tasks that succeeded.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    dtype = Encoder(tokenizer).dtype
    laid = docs.select(
        F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    )
    by = [f"o{i}" for i in range(len(order))]
    raw = save(
        laid.repartitionByRange(*by).sortWithinPartitions(*by).select("key", "text", F.spark_partition_id().alias("part"))
        .mapInArrow(_write_shards(folder, tokenizer, end_id), "key long, part int, path string, ordinal long, at long, n long"),
        f"{folder}/raw",
    )
    sizes = raw.groupBy("part", "path").agg(F.sum("n").alias("ids"), F.count(F.lit(1)).alias("rows"))
    # one row a shard: as many as the write had tasks
    listed = sorted((r.part, r.path, r.ids) for r in sizes.collect())
    first, table = 0, []
    for shard, (_, path, ids) in enumerate(listed):
        table.append((shard, path, first, ids))
        first += ids
    shards = save(spark.createDataFrame(table, "shard int, path string, first long, ids long").coalesce(1), f"{folder}/shard-table")
    rows = raw.join(F.broadcast(shards.select("shard", "path")), "path").select("key", "shard", "ordinal", "at", "n")
    entry = rows.filter("key is not null").groupBy("key").agg(
        F.min(F.struct("shard", "ordinal", "at", "n")).alias("first"), F.count(F.lit(1)).alias("rows"))
    keys = raw.count()
    buckets = max(1, -(-keys // KEYS_PER_BUCKET))
    bucketed = entry.select(
        bucket_of(F.col("key"), buckets).alias("bucket"), "key", "first.shard", "first.ordinal", "first.at", "rows", "first.n")
    index = save(
        bucketed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_write_index(folder), "bucket int, path string"),
        f"{folder}/index-table",
    )
    return TokenFiles(spark, folder, dtype, rows, shards, index, buckets)


def _lookup_batches(paths: dict[int, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hash_, arrays = None, None, None
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            buckets = batch.column("bucket").to_numpy()
            for b in np.unique(buckets):
                own = keys[buckets == b]
                if b not in paths:
                    continue
                if b != current:
                    store, path = open_store(paths[b])
                    with store.open_input_stream(path, compression=None) as f:
                        arrays = dict(np.load(io.BytesIO(f.read())))
                    hash_, current = PerfectHash(len(arrays["prints"]), int(arrays["seed"]), arrays["shifts"]), b
                at = hash_.slots(own)
                hit = arrays["prints"][at] == hash_.fingerprints(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[hit].view(np.int64)), *[pa.array(arrays[c][at[hit]]) for c in ("shard", "ordinal", "at", "rows", "n")]],
                    ["key", "shard", "ordinal", "at", "rows", "n"])
    return run


def lookup(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """(key, shard, ordinal, at, rows, n) of distinct non-null long keys, through the index files.

    Keys that aren't in the data set give no row, but for one in 2**32 by chance. The map of bucket files has one entry
    per hundred thousand keys.
    """
    paths = {r.bucket: r.path for r in files.index.collect()}
    return keys.select("key", bucket_of(F.col("key"), files.buckets).alias("bucket")).repartition("bucket").sortWithinPartitions(
        "bucket").mapInArrow(_lookup_batches(paths), "key long, shard int, ordinal long, at long, rows long, n long")


def _read_batches(dtype: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, stream, width = None, None, np.dtype(dtype).itemsize
        for batch in batches:
            out = []
            for path, at, n in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "n"))):
                if path != uri:
                    store, where = open_store(path)
                    uri, stream = path, store.open_input_file(where)
                crc = 0
                for begin in range(at, at + n, READ_IDS):
                    data = stream.read_at(min(READ_IDS, at + n - begin) * width, begin * width)
                    ids = np.frombuffer(data, dtype)
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                out.append(crc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("start"), batch.column("n"), pa.array(out, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_rows(files: TokenFiles, places: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the shard files for rows (key, shard, at, n).

    start counts the ids of all rows before it. Documents are read a bounded piece at a time, in file order.
    """
    return places.join(F.broadcast(files.shards.select("shard", "path", "first")), "shard").select(
        "key", "path", "at", "n", (F.col("first") + F.col("at")).alias("start")
    ).sortWithinPartitions("path", "at").mapInArrow(
        _read_batches(files.dtype), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_back(files: TokenFiles) -> DataFrame:
    """Every written row, from the document table and the shards."""
    return read_rows(files, files.rows)


def read_by_key(files: TokenFiles) -> DataFrame:
    """Every written row, found through the index by its key.

    Entries of unrepeated keys name their place and length; rows of repeated and null keys, which the index only
    points at, take theirs from the document table.
    """
    entries = lookup(files, files.rows.filter("key is not null").select("key").distinct())
    once = entries.filter("rows = 1").select("key", "shard", "at", "n")
    again = entries.filter("rows > 1").select(F.col("key").alias("k"))
    more = files.rows.join(again, F.col("key") == F.col("k"), "left_semi").unionByName(files.rows.filter("key is null"))
    return read_rows(files, once.unionByName(more.select("key", "shard", "at", "n")))
