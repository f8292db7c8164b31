"""Encoding with sentencepiece models that keeps the place of every piece in the original bytes.

A text is normalised here: at each place the longest rule of the model's compiled character map that fits is
applied, and each byte that comes out remembers where in the source it came from. The model's own merges, with
its normaliser off, then cut the normalised text, and the ends of the pieces are projected back through that
record. A text is cut chunk by chunk where no piece can reach across, and chunks are remembered.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthline.llm.files import free_name

#: Stands for a space in pieces, a fixed value of the model format.
MARK = "▁"
#: Comes out for a byte that isn't UTF-8.
UNREADABLE = "�".encode()
#: Chunks that a Python worker remembers, and the longest of them in characters.
REMEMBERED = 1 << 19
LONGEST = 64
#: Pieces of a batch of rows that leaves a task, about.
PIECES = 1 << 19

RESULTS = "ids array<int>, starts array<int>, ends array<int>, decoded string"


#: Marks of pieces whose bytes depend on the text.
BYTE, UNKNOWN = -1, -2


class CharacterMap:
    """Rules (source bytes to replacement) of a compiled character map: a double-array trie and its texts.

    Layout, fixed by the format: the trie's size in bytes, its 32-bit units, then NUL-ended replacements. A unit
    holds a label (low 8 bits), whether a rule ends here (bit 8), and the offset to its children; a leaf unit holds the
    place of the replacement.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.texts = blob[4 + size:]
        starts = [b for b in range(256) if self.child(0, b) is not None] if self.units else []
        #: Places where a rule may begin; none in a map without rules.
        self.stops = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in starts) + b"]") if starts else None

    def below(self, at: int) -> int:
        unit = self.units[at]
        return at ^ (unit >> 10 << (unit >> 6 & 8))

    def child(self, at: int, byte: int) -> int | None:
        to = self.below(at) ^ byte
        return to if to < len(self.units) and self.units[to] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest rule that fits at a place."""
        node, found = 0, None
        for size, byte in enumerate(data[at:at + 256], 1):
            node = self.child(node, byte)
            if node is None:
                break
            if self.units[node] >> 8 & 1:
                found = size, self.units[self.below(node)] & 0x7FFFFFFF
        if found is None:
            return None
        size, text = found
        return size, self.texts[text:self.texts.index(b"\0", text)]


class Normaliser:
    """A model's normalisation with the record of where each byte came from."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.stops = self.map.stops if self.map else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def runs(self, data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
        """(start, end, replacement) over the source; None leaves the bytes as they are."""
        at, unchanged = 0, 0
        while at < len(data):
            hit = self.stops.search(data, at) if self.stops else None
            at = hit.start() if hit else len(data)
            if not hit:
                break
            rule = self.map.longest(data, at)
            if rule is None:
                at += 1
                while at < len(data) and data[at] & 0xC0 == 0x80:  # rules begin at whole characters only
                    at += 1
                continue
            if at > unchanged:
                yield unchanged, at, None
            yield at, at + rule[0], rule[1]
            at = unchanged = at + rule[0]
        if at > unchanged:
            yield unchanged, at, None

    def mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Replaced text, and for each of its bytes and its end the place in the source."""
        out, places = [], []
        for start, end, new in self.runs(data):
            out.append(data[start:end] if new is None else new)
            places.append(np.arange(start, end) if new is None else np.full(len(new), start))
        return b"".join(out), np.concatenate([*places, [len(data)]]).astype(np.int64)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised text and places; an empty text, or one of spaces that are dropped, is empty."""
        places = None
        try:
            data.decode()
        except UnicodeDecodeError:
            data, places = readable(data)
        if self.stops:
            data, more = self.mapped(data)
            places = more if places is None else places[more]
        elif places is None:
            places = np.arange(len(data) + 1)
        if self.squeeze:
            text = np.frombuffer(data, np.uint8)
            keep = (text != 32) | np.concatenate([[False], text != 32])[:-1]
            places = np.append(places[:-1][keep], places[-1:])
            data = text[keep].tobytes()
            if not data.strip(b" "):
                return b"", places[:1]
        if not data:
            return data, places
        if self.prefix:
            data, places = b" " + data, np.concatenate([places[:1], places])
        if self.escape:
            wide = np.ones(len(places), np.int64)
            wide[:-1][np.frombuffer(data, np.uint8) == 32] = len(MARK.encode())
            data, places = data.replace(b" ", MARK.encode()), np.repeat(places, wide)
        if self.squeeze:  # a mark in the source is dropped at the end like a space
            data = data.decode().rstrip(MARK if self.escape else " ").encode()
            places = places[:len(data) + 1]
        return data, places


def readable(data: bytes) -> tuple[bytes, np.ndarray]:
    """UTF-8 with a replacement character for each byte that isn't, and the place of each byte."""
    out, places, at = [], [], 0
    for part in re.findall("[\ud800-\udfff]|[^\ud800-\udfff]+", data.decode("utf-8", "surrogateescape")):
        if "\ud800" <= part <= "\udfff":
            out.append(UNREADABLE)
            places.append(np.full(len(UNREADABLE), at))
            at += 1
        else:
            out.append(part.encode())
            places.append(np.arange(at, at + len(out[-1])))
            at += len(out[-1])
    return b"".join(out), np.concatenate([*places, [len(data)]]).astype(np.int64)


class PieceEncoder:
    """Ids, spans and decoded text by a model file of the sentencepiece library, without its special ids in texts."""

    CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as format_

        with open(path, "rb") as f:
            model = format_.ModelProto.FromString(f.read())
        if model.trainer_spec.treat_whitespace_as_suffix or any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("models with user-defined pieces or spaces at the ends of words are not supported")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.end_id = self.whole.eos_id()
        if self.end_id < 0:
            raise ValueError("the model has no end id")
        self.normalise = Normaliser(model.normalizer_spec)
        #: No piece goes on with a space after another sign, so texts can be cut there.
        self.cuts = not any(MARK in p.piece.lstrip(MARK) for p in model.pieces if p.type in (p.NORMAL, p.UNUSED))
        spec = model.normalizer_spec
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        #: Bytes that a piece covers by its id; byte pieces and unknown ones depend on their text.
        self.covers = [BYTE if p.type == p.BYTE else UNKNOWN if p.type == p.UNKNOWN else len(p.piece.encode()) for p in model.pieces]
        self.bytes = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == p.BYTE}
        #: Pairs of id and bytes covered of each chunk: 32-bit numbers one after another.
        self.known: dict[str, bytes] = {}

    def sizes(self, text: str, ids: list[int]) -> list[int]:
        """Bytes of a normalised text that each id covers; of a character in byte pieces the last covers all."""
        out = [self.covers[i] for i in ids]
        if min(out, default=0) >= 0:
            return out
        if UNKNOWN in out:
            return [p.end - p.begin for p in self.bare.encode_as_proto(text).pieces]
        at = 0
        while at < len(out):
            size = 1
            if out[at] == BYTE:
                lead = self.bytes[ids[at]]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out[at:at + size] = [0] * (size - 1) + [size]
            at += size
        return out

    def learn(self, new: list[str]) -> None:
        """Encode chunks in one call."""
        for part, ids in zip(new, self.bare.encode(new, num_threads=1)):
            pairs = array("i", bytes(8 * len(ids)))
            pairs[::2], pairs[1::2] = array("i", ids), array("i", self.sizes(part, ids))
            self.known[part] = pairs.tobytes()

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text without the end id, and the places in its bytes where pieces meet (one more than ids)."""
        text, places = self.normalise(data)
        normal = text.decode()
        parts = self.CHUNK.findall(normal) if self.cuts else [normal] if normal else []
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        known = self.known
        new = list(set(parts).difference(known))
        if new:
            self.learn(new)
        pairs = np.frombuffer(b"".join([known[p] for p in parts]), np.int32)
        for part in new:
            if len(part) > LONGEST:  # long chunks are seldom met again
                del known[part]
        return pairs[::2], places[np.concatenate([[0], np.cumsum(pairs[1::2], dtype=np.int64)])]


@cache
def encoder_of(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _encode(model: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        numbers = pa.list_(pa.int32())
        for batch in batches:
            held: list[tuple] = []
            first, size = 0, 0
            for row, text in enumerate(batch.column(0), 1):
                data = text.as_py() or b""
                ids, meet = encoder.encode(data)
                ids = np.append(ids, np.int32(encoder.end_id))
                held.append((
                    ids, np.append(meet[:-1], len(data)).astype(np.int32),
                    np.append(meet[1:], len(data)).astype(np.int32), encoder.whole.decode(ids.tolist())))
                size += len(ids)
                if size >= PIECES or row == batch.num_rows:
                    found = [pa.array(c, t) for c, t in zip(zip(*held), (numbers, numbers, numbers, pa.string()))]
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(first, row - first).columns[1:], *found], [*batch.schema.names[1:], "ids", "starts", "ends", "decoded"])
                    held, first, size = [], row, 0
    return run


def encode(docs: DataFrame, model: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ids, starts, ends, decoded (``keep`` must not have these names).

    ids are the library's for the whole text, with the end id; starts and ends bound each piece in the UTF-8 bytes of the
    text (end exclusive). The space put before a text covers no bytes, nor does the end id; of the byte pieces of one
    character the last covers it. Null texts count as empty and have the end id alone. Rows are taken one by one:
    ids, nulls and repeats among other columns play no part. decoded is the library's text of ids.
    """
    kept = docs.select(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(F.col(text).cast("binary").alias(free_name(kept, "data")), *keep).mapInArrow(_encode(model), f"{schema}, {RESULTS}")


def decode(rows: DataFrame, model: str, keep: list[str], ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Columns ``keep`` with the text of the list of ids; null lists give null, unknown ids raise."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder_of(model).whole
        for batch in batches:
            texts = [None if x is None else library.decode(x) if x else "" for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], into])

    kept = rows.select(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return rows.select(F.col(ids).alias(free_name(kept, "data")), *keep).mapInArrow(run, f"{schema}, `{into}` string")
