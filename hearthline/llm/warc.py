"""WARC archives of captured pages, read back, and a globally ordered capture index.

Each writing task makes one archive of gzip members and the sorted index run of its captures. Runs are
merged externally: a run is a list of sorted blocks in files; a merge task opens its key range of at most
a fixed number of runs and plays their heads off in a loser tree, one comparison a level for each capture. Passes repeat until
one run is left: the capture history of all archives, ordered by URL key, time and page.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hearthline.llm.files import NewFile, open_store, save, scratch

#: Payloads from this size on are stored once; later equal ones become revisits.
REVISIT_BYTES = 100
#: Index lines of a block: what a merge holds of each run.
BLOCK_LINES = 256
#: Runs merged at once.
FAN_IN = 64
#: Index lines of a merge task, about.
RANGE_LINES = 500_000
#: Bytes read from an archive at once.
READ_BYTES = 1 << 20

HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\d*\.)?([^/?#:]*)(?::\d+)?([^#]*)", re.I)


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query, lower-cased; white space is escaped. Null: "-"."""
    if not url:
        return "-"
    found = HOST.match(url.strip())
    host, rest = (found[1], found[2]) if found else ("", url)
    key = ",".join(reversed(host.lower().split("."))) + ")" + (rest.lower() or "/")
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02x}", key)


def header_value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page: int | None, url: str | None, date: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit keeps the HTTP head and names the page whose record has the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {header_value(url or '')}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def head_of(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        out[name] = value
    return out


def page_of(uri: str) -> int | None:
    number = uri[len("<urn:page:"):-1]
    return int(number) if number else None


def decisions(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, date, payload) with digest and refers_to.

    Only (page, digest) pairs are grouped and joined by digest; payloads move once, by page.
    """
    marked = pages.withColumn("digest", F.sha2("payload", 256))
    small = marked.filter((F.length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter(
        "last > refers_to").drop("last")
    again = small.join(first, "digest").filter("page_id <> refers_to").distinct().select(
        F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
    return marked.join(again, (F.col("page_id") == F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left").drop(
        "r_page", "r_digest")


def capture_line(page: int | None, url: str | None, date: str, kind: str, digest: str, at: int, size: int, path: str) -> str:
    stamp = re.sub(r"[^0-9]", "", date)[:14]
    name = path.rpartition("/")[2]
    return f"{url_key(url)} {stamp} {-1 if page is None else page:020d} {kind} {digest} {size} {at} {name}"


def _blocks(lines: Iterator[str], file: NewFile, run: int) -> Iterator[tuple]:
    """Write sorted lines as compressed blocks; (run, first line, last line, path, offset, size, lines) of each."""
    held: list[str] = []

    def flush() -> tuple:
        data = zlib.compress("\n".join(held).encode(), 1)
        return run, held[0], held[-1], file.uri, file.write(data), len(data), len(held)

    for line in lines:
        held.append(line)
        if len(held) == BLOCK_LINES:
            yield flush()
            held = []
    if held:
        yield flush()


BLOCK_SCHEMA = "run long, first string, last string, path string, offset long, size long, lines long"


def _write_archives(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, lines = None, []
        for batch in batches:
            for page, url, date, payload, digest, refers_to in zip(*(c for c in (
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3),
                batch.column(4).to_pylist(), batch.column(5).to_pylist(),
            ))):
                archive = archive or NewFile(f"{folder}/archives", ".warc.gz")
                data = gzip.compress(record(page, url, date, payload.as_py(), digest, refers_to), 6, mtime=0)
                at = archive.write(data)
                kind = "response" if refers_to is None else "revisit"
                lines.append(capture_line(page, url, date, kind, digest, at, len(data), archive.uri))
        if archive:
            archive.close()
            index = NewFile(f"{folder}/runs", ".idx")
            rows = list(_blocks(iter(sorted(lines)), index, 0))
            index.close()
            table = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array([archive.uri] * len(rows)), *[pa.array(c) for c in table]],
                ["archive", "run", "first", "last", "path", "offset", "size", "lines"])
    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives and index runs; rows (archive, run, first, last, path, offset, size, lines), one a block.

    ``pages``: page_id, url, date (ISO, text), payload (binary, not null). Each task writes files under new
    names, and only files that a successful task reports are ever read.
    """
    rows = decisions(pages).select("page_id", "url", "date", "payload", "digest", "refers_to").mapInArrow(
        _write_archives(folder), f"archive string, {BLOCK_SCHEMA}")
    raw = save(rows, f"{folder}/raw-runs")
    names = raw.select("path").distinct()
    numbers = names.select(F.col("path").alias("p"), (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("k"))
    return raw.drop("run").join(F.broadcast(numbers), F.col("path") == F.col("p")).select(
        "archive", F.col("k").alias("run"), "first", "last", "path", "offset", "size", "lines")


class LoserTree:
    """Smallest head of k sorted iterators; a pop replays one leaf's path with a comparison a level."""

    def __init__(self, runs: list[Iterator[str]]):
        self.runs = runs
        self.k = len(runs)
        self.heads: list[str | None] = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if y is None:
            return x is not None or a < b
        return x is not None and (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to come waits for its opponent
                self.losers[node] = winner
                return
            if self._less(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[str]:
        while self.k and (head := self.heads[self.losers[0]]) is not None:
            yield head
            leaf = self.losers[0]
            self.heads[leaf] = next(self.runs[leaf], None)
            self._play(leaf)


def _lines(blocks: list[tuple[str, int, int]], low: str | None, high: str | None) -> Iterator[str]:
    """Lines from ``low`` to below ``high`` of one run's blocks, one block at a time."""
    for path, offset, size in blocks:
        store, where = open_store(path)
        with store.open_input_file(where) as f:
            lines = zlib.decompress(f.read_at(size, offset)).decode().split("\n")
        begin = 0 if low is None else bisect.bisect_left(lines, low)
        end = len(lines) if high is None else bisect.bisect_left(lines, high)
        yield from lines[begin:end]


def splitters(blocks: DataFrame, lines: int) -> list[str]:
    """First lines of blocks, about every ``lines`` index lines: a bounded share of the captures."""
    every = max(1, lines // BLOCK_LINES)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            firsts = batch.column(0).to_pylist()
            chosen = [x for i, x in enumerate(firsts, seen + 1) if i % every == 0]
            seen += len(firsts)
            yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.string())], ["first"])

    found = blocks.select("first").repartitionByRange("first").sortWithinPartitions("first").mapInArrow(thin, "first string")
    return sorted({r[0] for r in found.collect()})


def _spread(cuts: list[str], fan_in: int) -> Callable:
    """Rows (range, group, run, first, path, offset, size) of the ranges that a block meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                low, high = bisect.bisect_right(cuts, r["first"]), bisect.bisect_right(cuts, r["last"])
                rows += [(k, r["run"] // fan_in, r["run"], r["first"], r["path"], r["offset"], r["size"]) for k in range(low, high + 1)]
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["range", "group", "run", "first", "path", "offset", "size"])
    return run


def _merge(folder: str, cuts: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(key: tuple[int, int], runs: dict[int, list]) -> Iterator[pa.RecordBatch]:
            low = cuts[key[0] - 1] if key[0] else None
            high = cuts[key[0]] if key[0] < len(cuts) else None
            file = NewFile(f"{folder}/runs", ".idx")
            tree = LoserTree([_lines(runs[r], low, high) for r in sorted(runs)])
            rows = list(_blocks(iter(tree), file, key[1]))
            file.close()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)],
                                                 ["run", "first", "last", "path", "offset", "size", "lines"])

        key, runs = None, {}
        for batch in batches:
            for k, g, r, path, offset, size in zip(*(batch.column(c).to_pylist() for c in ("range", "group", "run", "path", "offset", "size"))):
                if key != (k, g):
                    if key:
                        yield from merged(key, runs)
                    key, runs = (k, g), {}
                runs.setdefault(r, []).append((path, offset, size))
        if key:
            yield from merged(key, runs)
    return run


def merge_runs(blocks: DataFrame, folder: str, range_lines: int = RANGE_LINES, fan_in: int = FAN_IN) -> DataFrame:
    """One run from all: blocks (run, first, last, path, offset, size, lines) of the ordered capture index."""
    blocks = blocks.select("run", "first", "last", "path", "offset", "size", "lines")
    level = 0
    while True:
        runs = (blocks.agg(F.max("run")).first()[0] or 0) + 1
        cuts = splitters(blocks, range_lines)
        spread = blocks.select("run", "first", "last", "path", "offset", "size").mapInArrow(
            _spread(cuts, fan_in), "range long, group long, run long, first string, path string, offset long, size long")
        done = spread.repartition("range", "group").sortWithinPartitions("range", "group", "run", "first", "offset").mapInArrow(
            _merge(f"{folder}/merge-{level}", cuts), BLOCK_SCHEMA)
        blocks = save(done, f"{folder}/merge-{level}/blocks")
        level += 1
        if runs <= fan_in:
            return blocks


def read_index(blocks: DataFrame) -> DataFrame:
    """(url_key, stamp, page_id, type, digest, size, offset, archive) of the captures of a run, block by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, size in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "size"))):
                yield pa.RecordBatch.from_arrays([pa.array(list(_lines([(path, offset, size)], None, None)))], ["line"])

    part = F.split("line", " ")
    return blocks.mapInArrow(run, "line string").select(
        part[0].alias("url_key"), part[1].alias("stamp"), part[2].cast("long").alias("page_id"), part[3].alias("type"),
        part[4].alias("digest"), part[5].cast("long").alias("size"), part[6].cast("long").alias("offset"), part[7].alias("archive"),
    )


def records_of(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, head, block) of each gzip member of an archive."""
    data, at = b"", 0
    while True:
        inflate, plain, taken = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not data:
                data = stream.read(READ_BYTES)
                if not data:
                    if taken:
                        raise ValueError("an archive ends inside a record")
                    return
            taken += len(data)
            plain.append(inflate.decompress(data))
            data = inflate.unused_data
            taken -= len(data)
        whole = b"".join(plain)
        head, _, rest = whole.partition(b"\r\n\r\n")
        fields = head_of(head)
        yield at, fields, rest[:int(fields["Content-Length"])]
        at += taken


RECORD_SCHEMA = (
    "page_id long, url string, date string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, archive string, offset long"
)


def parsed(fields: dict[str, str], block: bytes, archive: str, at: int) -> tuple:
    """Result row of a record; a response's payload is hashed again and must agree with its heads.

    A revisit's size and digest are those of the payload that it refers to, from its own heads.
    """
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(head_of(http)["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record at {at} of {archive}")
    refers = fields.get("WARC-Refers-To")
    return (page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Date"], fields["WARC-Type"], size, digest,
            page_of(refers) if refers else None, archive, at)


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _scan_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = open_store(uri)
            rows = []
            with store.open_input_stream(path, compression=None) as stream:
                for at, fields, block in records_of(stream):
                    rows.append(parsed(fields, block, uri.rpartition("/")[2], at))
                    if len(rows) == 4096:
                        yield record_batch(rows)
                        rows = []
            if rows:
                yield record_batch(rows)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row a record, from front to back of the archives in column ``archive``, an archive a task."""
    return archives.select("archive").distinct().mapInArrow(_scan_archives, RECORD_SCHEMA)


def read_captures(index: DataFrame, folder: str) -> DataFrame:
    """One row a capture of ``index``: its record is read from its archive at the place that the index gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != name:
                    store, path = open_store(f"{folder}/archives/{archive}")
                    name, file = archive, store.open_input_file(path)
                head, _, rest = gzip.decompress(file.read_at(size, at)).partition(b"\r\n\r\n")
                fields = head_of(head)
                rows.append(parsed(fields, rest[:int(fields["Content-Length"])], archive, at))
            if rows:
                yield record_batch(rows)

    return index.select("archive", "offset", "size").repartition("archive").sortWithinPartitions("archive", "offset").mapInArrow(
        run, RECORD_SCHEMA)


def archive_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(records read back through the index, ordered capture index) of archives written from ``pages``.

    Null html is an empty payload, null or empty urls have the key "-", null dates and no date column give
    the epoch plus the page number in seconds. Of equal payloads of at least 100 bytes the row of the smallest id is
    the response and the others revisit it; rows that repeat the smallest id with the same payload are responses too.
    Rows with a null id are responses and are never referred to. An empty table gives empty results.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    page = F.col(id_col).cast("long")
    made_up = F.timestamp_seconds(F.coalesce(F.pmod(page, F.lit(1 << 31)), F.lit(0)))
    date = made_up if date_col is None else F.coalesce(F.col(date_col).cast("timestamp"), made_up)
    captured = pages.select(
        page.alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    written = save(write_archives(captured, folder), f"{folder}/run-table")
    index = read_index(merge_runs(written, folder))
    return read_captures(index, folder), index
