"""Language identification by interpolated Kneser-Ney character models.

Texts are folded to lower-case letters and single blanks. A context and its next character pack into 64
bits, 16 a character. Each language has a model of order four, made by joins from all its n-grams: sorted
arrays of mixed hash keys in files by range of the hash, of which a task holds a bounded part at a time. A
text gets the language of the lowest cross-entropy per character. Cross-entropies of labelled texts that the
models have not seen calibrate, by language and length, from which value on a text is rejected.
"""

from __future__ import annotations

import io
import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hearthline.llm.files import NewFile, free_name, open_store, saved, scratch

ORDER = 4
#: Folds of the training rows whose entropies calibrate the rejection; the others give the counts.
FOLDS, CALIBRATION_FOLD = 4, 3
#: Absolute discount.
DISCOUNT = 0.75
#: N-grams of one order and language in a range of hashes, about; a range is read at once.
PART = 1 << 17
#: Bytes of ranges that a task's process keeps.
KEPT = 192 << 20
#: A text is rejected above the mean entropy of its language and length by more standard deviations.
DEVIATIONS = 8.0
#: Least standard deviation, bits a character: of documents of any length, and of one character, which falls
#: with the root of the length.
LEAST_SPREAD, CHARACTER_SPREAD = 0.2, 2.0
#: Calibration rows from which a language at a length, or a language, has a limit of its own.
LEAST_ROWS = 30
#: Characters folded and looked up at once; longer texts go through in pieces.
PIECE = 1 << 20
#: Distinct n-grams a task counts before it passes them on.
HELD = 1 << 20
UNKNOWN = "und"
BLANK = 32


@cache
def folding() -> np.ndarray:
    """16-bit code of each code point below 65536: lower-case letters stay, all else is a blank.

    Letters beyond the first plane are folded into the private area by their low bits.
    """
    out = np.full(1 << 16, BLANK, np.uint16)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low[0]) if ord(low[0]) < 1 << 16 else c
    return out


def fold(text: str) -> np.ndarray:
    """Codes of a text; runs of other characters are one blank. No letter: empty."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    codes = folding()[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        letters = np.array([chr(p).isalpha() for p in points[high]], bool)
        codes[high] = np.where(letters, 0xE000 + (points[high] & 0xFFF), BLANK).astype(np.uint16)
    keep = codes != BLANK
    keep[1:] |= codes[:-1] != BLANK
    keep[:1] = codes[:1] != BLANK
    codes = codes[keep]
    return codes[:-1] if len(codes) and codes[-1] == BLANK else codes


def grams(text: str) -> Iterator[np.ndarray]:
    """Packed n-grams of a text between blanks, in pieces; one for each character and the closing blank."""
    tail = np.full(ORDER - 1, BLANK, np.uint16)
    some = False
    for at in range(0, len(text), PIECE):
        codes = fold(text[at:at + PIECE])
        if not len(codes):
            continue
        if some and not (text[at].isalpha() and text[at - 1].isalpha()):
            codes = np.r_[np.uint16(BLANK), codes]
        whole = np.r_[tail, codes].astype(np.uint64)
        yield pack(whole)
        tail, some = np.r_[tail, codes][1 - ORDER:].astype(np.uint16), True
    if some:
        yield pack(np.r_[tail, np.uint16(BLANK)].astype(np.uint64))


def pack(codes: np.ndarray) -> np.ndarray:
    n = len(codes) - ORDER + 1
    out = codes[:n].copy()
    for k in range(1, ORDER):
        out = (out << np.uint64(16)) | codes[k:n + k]
    return out


def mixed(keys: np.ndarray) -> np.ndarray:
    """Invertible hash of packed n-grams."""
    with np.errstate(over="ignore"):
        k = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        k ^= k >> np.uint64(32)
        return k * np.uint64(0xD6E8FEB86659FD93)


class Model:
    """Sorted hash keys of each order with their interpolated probabilities, and back-off weights of contexts.

    Order n: ``keys[n]`` -> ``probs[n]`` of its last character after the n - 1 before; ``contexts[n]`` ->
    ``gammas[n]``, the weight of the next lower order after that context.
    """

    def __init__(self, packed: np.ndarray, counts: np.ndarray):
        """packed: distinct n-grams of the highest order with their counts."""
        one = np.uint64(16)
        self.keys, self.probs, self.contexts, self.gammas = {}, {}, {}, {}
        levels = {ORDER: (packed.astype(np.uint64), counts.astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):
            mask = np.uint64((1 << 16 * n) - 1)
            # continuation counts: how many characters come before
            levels[n] = np.unique(levels[n + 1][0] & mask, return_counts=True)
        self.floor = 1.0 / (1 << 16)
        for n in range(1, ORDER + 1):
            grams_, c = levels[n]
            c = c.astype(np.float64)
            context, of = np.unique(grams_ >> one if n > 1 else np.zeros(len(grams_), np.uint64), return_inverse=True)
            total = np.bincount(of, weights=c)
            discount = np.minimum(DISCOUNT, c * DISCOUNT)
            kept = (c - discount) / total[of]
            gamma = 1 - np.bincount(of, weights=kept)
            lower = self.floor if n == 1 else self._below(grams_, n)
            prob = kept + gamma[of] * lower
            at = np.argsort(mixed(grams_))
            self.keys[n], self.probs[n] = mixed(grams_)[at], prob[at]
            at = np.argsort(mixed(context))
            self.contexts[n], self.gammas[n] = mixed(context)[at], gamma[at]

    def _below(self, grams_: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of the next lower order, where every suffix is stored."""
        found, at = find(self.keys[n - 1], mixed(grams_ & np.uint64((1 << 16 * (n - 1)) - 1)))
        return np.where(found, self.probs[n - 1][at], self.floor)

    def lookup(self, name: str, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hash keys of order n are stored under ``name``, and their values."""
        found, at = find(getattr(self, name)[n], keys)
        return found, (self.probs if name == "keys" else self.gammas)[n][at]

    def log_probs(self, packed: np.ndarray) -> np.ndarray:
        """log2 of the interpolated probability of each n-gram's last character."""
        out = np.ones(len(packed))
        rest = np.arange(len(packed))
        for n in range(ORDER, 0, -1):
            own = packed[rest] & np.uint64((1 << 16 * n) - 1) if n < ORDER else packed[rest]
            found, prob = self.lookup("keys", n, mixed(own))
            out[rest[found]] *= prob[found]
            rest, own = rest[~found], own[~found]
            if not len(rest):
                break
            known, gamma = self.lookup("contexts", n, mixed(own >> np.uint64(16)))
            out[rest] *= np.where(known, gamma, 1.0)
        out[rest] *= self.floor
        return np.log2(out)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f"{name}{n}": getattr(self, name)[n] for name in ("keys", "probs", "contexts", "gammas") for n in self.keys})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        self, arrays = cls.__new__(cls), np.load(io.BytesIO(data))
        self.floor = 1.0 / (1 << 16)
        for name in ("keys", "probs", "contexts", "gammas"):
            setattr(self, name, {n: arrays[f"{name}{n}"] for n in range(1, ORDER + 1)})
        return self


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


class StoredModel(Model):
    """A model in files: ``places[name, n, part]`` is (uri, offset, entries) of a range of the top ``bits`` of the hash."""

    def __init__(self, places: dict[tuple[str, int, int], tuple[str, int, int]], bits: int):
        self.places, self.bits, self.floor = places, bits, 1.0 / (1 << 16)

    def lookup(self, name: str, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, values = np.zeros(len(keys), bool), np.zeros(len(keys))
        part = part_of(keys, self.bits)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for own in np.split(order, cuts) if len(keys) else ():
            place = self.places.get((name, n, int(part[own[0]])))
            if place:
                table, stored = entries(*place)
                found[own], at = find(table, keys[own])
                values[own] = stored[at]
        return found, values


def part_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


_kept: OrderedDict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()


def entries(uri: str, offset: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hash keys and values at a place of a file; the last ones read are kept up to KEPT bytes."""
    if (uri, offset) in _kept:
        _kept.move_to_end((uri, offset))
        return _kept[uri, offset]
    store, path = open_store(uri)
    with store.open_input_file(path) as file:
        data = file.read_at(16 * n, offset)
    _kept[uri, offset] = out = np.frombuffer(data, "<u8", n), np.frombuffer(data, "<f8", n, 8 * n)
    while len(_kept) > 1 and sum(16 * len(k) for k, _ in _kept.values()) > KEPT:
        _kept.popitem(last=False)
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        parts = held[lang]
        keys, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(of, weights=np.concatenate([c for _, c in parts])).astype(np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang in held:
            keys, n = merged(lang)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    waiting: dict[str, list] = {}
    n_waiting = 0

    def count() -> Iterator[pa.RecordBatch]:
        nonlocal held, size, waiting, n_waiting
        for lang, parts in waiting.items():
            codes, keys = pd.factorize(np.concatenate(parts))
            held.setdefault(lang, []).append((keys, np.bincount(codes, minlength=len(keys))))
            size += len(keys)
        waiting, n_waiting = {}, 0
        if size > HELD:
            held = {lang: [merged(lang)] for lang in held}
            size = sum(len(p[0][0]) for p in held.values())
            if size > HELD // 2:
                yield from rows()
                held, size = {}, 0

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for packed in grams(text.as_py()):
                waiting.setdefault(lang, []).append(packed)
                n_waiting += len(packed)
                if n_waiting >= PIECE:
                    yield from count()
    yield from count()
    yield from rows()


def fold_of(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def tables(counted: DataFrame) -> DataFrame:
    """(lang, name, n, key, value) of the models of all languages from (lang, gram, n) of the highest order.

    Every n-gram counts in every order: each lower order has as counts how many characters come before.
    """
    level = counted.select("lang", "gram", F.col("n").alias("c"))
    levels = {ORDER: level}
    for n in range(ORDER - 1, 0, -1):
        level = saved(level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "level")
        levels[n] = level
    out, lower = [], None
    for n in range(1, ORDER + 1):
        of = levels[n].withColumn("context", F.shiftrightunsigned("gram", 16) if n > 1 else F.lit(0).cast("long"))
        contexts = saved(of.groupBy("lang", "context").agg(F.sum("c").alias("total"), (DISCOUNT * F.count(F.lit(1)) / F.sum("c")).alias("gamma")), "contexts")
        rows = of.join(contexts, ["lang", "context"])
        if n == 1:
            below = F.lit(1.0 / (1 << 16))
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1))).join(
                lower.select("lang", F.col("gram").alias("suffix"), F.col("prob").alias("below")), ["lang", "suffix"])
            below = F.col("below")
        lower = saved(rows.select("lang", "gram", ((F.col("c") - DISCOUNT) / F.col("total") + F.col("gamma") * below).alias("prob")), "probs")
        out += [lower.select("lang", F.lit("keys").alias("name"), F.lit(n).alias("n"), F.col("gram").alias("key"), F.col("prob").alias("value")),
                contexts.select("lang", F.lit("contexts").alias("name"), F.lit(n).alias("n"), F.col("context").alias("key"), F.col("gamma").alias("value"))]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionAll(more)
    return whole


def train(rows: DataFrame) -> tuple[list[tuple[str, dict]], int]:
    """Places of the models by language, and bits of their hash ranges, from rows (lang, text): counts of all n-grams of all rows."""
    counted = saved(
        rows.select("lang", "text").mapInArrow(_count_batches, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams",
    )
    most = counted.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    bits = max(0, math.ceil(math.log2(most / PART)))
    folder = scratch(rows.sparkSession, "language-models")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, name, n, key, value = batch.columns
            keys = mixed(key.to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [lang, name, n, pa.array(part_of(keys, bits)), pa.array(keys.view(np.int64)), value], ["lang", "name", "n", "part", "key", "value"])

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "name", "n", "part"]
        file, held, of = None, [], None

        def put() -> pa.RecordBatch:
            nonlocal file
            file = file or NewFile(folder, ".model")
            keys = np.concatenate([k for k, _ in held]).view(np.uint64)
            order = np.argsort(keys)
            at = file.write(keys[order].astype("<u8").tobytes())
            file.write(np.concatenate([v for _, v in held])[order].astype("<f8").tobytes())
            return pa.RecordBatch.from_pylist([dict(zip(names, of), uri=file.uri, offset=at, entries=len(keys))], schema=pa.schema([
                ("lang", pa.string()), ("name", pa.string()), ("n", pa.int32()), ("part", pa.int64()), ("uri", pa.string()),
                ("offset", pa.int64()), ("entries", pa.int64())]))

        done = []
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(names).to_pandas()
            starts = np.flatnonzero((table != table.shift()).any(axis=1)).tolist()
            for start, end in zip(starts, [*starts[1:], len(table)]):
                own = tuple(table.iloc[start])
                if held and own != of:
                    done.append(put())
                    held = []
                of = own
                held.append((batch.column(4).to_numpy()[start:end], batch.column(5).to_numpy()[start:end]))
        if held:
            done.append(put())
        if file:
            file.close()
        yield from done

    parts = tables(counted).mapInArrow(hashed, "lang string, name string, n int, part long, key long, value double").repartition(
        "lang", "name", "n", "part").sortWithinPartitions("lang", "name", "n", "part").mapInArrow(
        stored, "lang string, name string, n int, part long, uri string, offset long, entries long")
    places: dict[str, dict] = {}
    for r in parts.collect():
        places.setdefault(r.lang, {})[r.name, r.n, r.part] = r.uri, r.offset, r.entries
    return sorted(places.items()), bits


def _score_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    places, bits_ = shared.value
    models = [(lang, StoredModel(own, bits_)) for lang, own in places]
    for batch in batches:
        n = batch.num_rows
        bits = np.zeros((n, len(models)))
        sizes = np.zeros(n, np.int64)
        parts, owners, held = [], [], 0

        def flush() -> None:
            nonlocal parts, owners, held
            if not parts:
                return
            codes, keys = pd.factorize(np.concatenate(parts))
            starts = np.cumsum([0, *map(len, parts[:-1])])
            for k, (_, model) in enumerate(models):
                np.add.at(bits[:, k], owners, np.add.reduceat(model.log_probs(keys)[codes], starts))
            parts, owners, held = [], [], 0

        for i, text in enumerate(batch.column(0)):
            for packed in grams(text.as_py() or ""):
                parts.append(packed)
                owners.append(i)
                sizes[i] += len(packed)
                held += len(packed)
                if held >= PIECE:
                    flush()
        flush()
        entropy = -bits / np.maximum(sizes, 1)[:, None]
        best = entropy.argmin(axis=1) if models else np.zeros(n, np.int64)
        some = (sizes > 0) & bool(models)
        names = np.array([lang for lang, _ in models] or [UNKNOWN], object)[best]
        if models:
            least = entropy.min(axis=1)
            score = 1 / np.exp2(np.minimum((least[:, None] - entropy) * -1, 60) * -8).sum(axis=1)
        else:
            least = score = np.zeros(n)
        yield pa.RecordBatch.from_arrays([
            *batch.columns[1:], pa.array(np.where(some, names, UNKNOWN), pa.string()),
            pa.array(np.where(some, score, 0.0)), pa.array(np.where(some, least, 0.0)), pa.array(sizes),
        ], [*batch.schema.names[1:], "lang_pred", "score", "entropy", "n_grams"])


def length_class(n_grams: Column) -> Column:
    return F.length(F.bin(n_grams))


def identify(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Columns ``keep`` with held_out, lang_pred, score, entropy, n_grams, rejected.

    One pass counts, one scores the calibration rows, one scores all rows; nothing wide is written. Models learn from text and non-null lang of the rows whose id's crc32 modulo 4 is 0 or 1, their
    rejection from those where it is 3; rows where it is 2 are held out, rows with a null id neither teach
    nor are held out. Texts that are null or without a letter are "und" with score 0 and are rejected; so is
    every text if nothing can be learned. Limits are a language's at a length, its own, or with few rows to calibrate
    on the greater of its own and that of all languages; without any such row only texts without a letter are
    rejected. All others get a learned language. The score falls from 1 as the
    best language's lead in bits a character shrinks. Whole texts are scored, whatever their length;
    repeated rows are scored alike. Equal entropies go to the language that sorts first.
    """
    spark = docs.sparkSession
    fold_ = fold_of(id_col)
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), fold_.alias("fold")
    )
    shared = spark.sparkContext.broadcast(train(labelled.filter(F.col("fold").isin(0, 1))))

    def scored(rows: DataFrame, text_: str, others: list[str]) -> DataFrame:
        kept = rows.select(*others)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
        return rows.select(F.col(text_).alias(free_name(kept, "data")), *others).mapInArrow(
            lambda b: _score_batches(b, shared), f"{schema}, lang_pred string, score double, entropy double, n_grams long")

    known = saved(scored(labelled.filter(F.col("fold") == CALIBRATION_FOLD), "text", ["lang"]).filter("lang = lang_pred").select(
        F.col("lang").alias("c_lang"), length_class(F.col("n_grams")).alias("c_class"), "entropy"
    ), "calibration")
    def spread(prefix: str) -> list[Column]:
        return [F.avg("entropy").alias(f"{prefix}_mean"), F.stddev_pop("entropy").alias(f"{prefix}_sd"), F.count(F.lit(1)).alias(f"{prefix}_n")]

    of_class = known.groupBy("c_lang", "c_class").agg(*spread("c")).filter(F.col("c_n") >= LEAST_ROWS)
    of_lang = known.groupBy(F.col("c_lang").alias("l_lang")).agg(*spread("l"))
    of_all = known.agg(*spread("a"))
    is_fold = free_name(docs.select(*keep), "fold")
    out = scored(docs.withColumn(is_fold, fold_.cast("int")), text, [*keep, is_fold]).join(
        F.broadcast(of_class),
        (F.col("lang_pred") == F.col("c_lang")) & (length_class(F.col("n_grams")) == F.col("c_class")), "left",
    ).join(F.broadcast(of_lang), F.col("lang_pred") == F.col("l_lang"), "left").crossJoin(F.broadcast(of_all))
    least = F.greatest(F.lit(LEAST_SPREAD), CHARACTER_SPREAD / F.sqrt(F.greatest("n_grams", F.lit(1))))

    def limit(prefix: str) -> Column:
        return F.col(f"{prefix}_mean") + DEVIATIONS * F.greatest(F.col(f"{prefix}_sd"), least)

    above = F.coalesce(F.col("entropy") > F.when(F.col("c_n").isNotNull(), limit("c")).when(
        F.col("l_n") >= LEAST_ROWS, limit("l")).otherwise(F.greatest(limit("l"), limit("a"))), F.lit(False))
    return out.select(
        *keep, F.coalesce(F.col(is_fold) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy",
        "n_grams", ((F.col("n_grams") == 0) | above).alias("rejected"),
    )


def keep_known(docs: DataFrame) -> DataFrame:
    """Documents that are not rejected, with all their columns as they were."""
    boxed = docs.select("doc_id", "text", "lang", F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return identify(boxed, ["row"]).filter(~F.col("rejected")).select("row.*")
