"""Spelling variants by a relational trie frontier.

The words of one length form a trie, kept as an edge table: (node, free, label, child). A node is the hash of
a length, a direction and a prefix. An edge reads a label of a power of two code points, the largest that the
rest of its word holds, so a walk takes steps in the logarithm of a word's length; an edge with a free code point
reads that one first. Every word starts at (word, position, node, no edits) on its own path, and spends its edit
at level 0: it leaves out a code point and goes on in the trie of the words one shorter, or takes an edge with
another free code point. From then on states (word, position, node, one edit) are joined with the edge table level
by level; a state that has read its whole word stands on the end of a word one edit away. Position and edits show
in the labels that a state has still to read.

Only the second half of a word may hold the edit; a trie of the words from their ends finds the edits of first
halves. So prefixes are long where walks branch, and each pair is found once: the longer word leaves out the
first of equal neighbours, and the smaller code point is replaced by the larger. Nodes are hashes, thus pairs are
confirmed by the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthline.llm.files import saved

RUN = re.compile("[a-z\u00c0-\u00ff]+")
#: Code points of a word, and occurrences, at least.
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A variant's form occurs so many times as often, at least.
RATIO = 2
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: Rows of a batch of states or edges.
ROWS = 1 << 16

PRIME = (1 << 61) - 1
BASE = 1_318_712_069_438_221_587
SALT = 907_193_517_006_142_741


def _count(least: int, every: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py()
                if not data:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in Counter(RUN.findall(data.lower().decode("utf-8", "replace"))).items():
                    if every:
                        h = zlib.crc32(w.encode(), start)
                        if h % every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                    if len(w) >= least:
                        held[w] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()
    return run


def vocabulary(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(word, n): runs ``[A-Za-z\\u00C0-\\u00FF]+`` of all texts, A-Z lower-cased, that are long and frequent enough.

    With ``every``, a run of a document is first spelt wrong where ``every`` divides crc32("<doc_id>:<run>"): it loses
    its code point at that number modulo its length. Null texts have no runs; a null id counts as the empty text;
    repeated rows count each time. Tasks pass on partial counts, so a frequent word is no hot key.
    """
    counted = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("binary")).mapInArrow(
        _count(least_length, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


#: Powers of the base by the power of two that a label's length is.
POWERS = [BASE]
while len(POWERS) < 40:
    POWERS.append(POWERS[-1] * POWERS[-1] % PRIME)


class Path:
    """Nodes and labels along the second half of a word, in one direction."""

    def __init__(self, letters: str, backward: bool):
        self.letters, self.size, self.side = letters, len(letters), int(backward)
        self.points = [ord(c) for c in letters]
        self.prefix = prefix = [0]
        now = 0
        for c in self.points:
            now = (now * BASE + c + 1) % PRIME
            prefix.append(now)
        size = self.size
        #: From each position of the half: the labels that read the rest, and where the first of them ends.
        self.labels: list[tuple[int, ...]] = [()] * (size + 1)
        self.stops = [size] * (size + 1)
        for at in range(size - 1, size // 2 - 1, -1):
            power = (size - at).bit_length() - 1
            stop = at + (1 << power)
            self.labels[at] = ((prefix[stop] - prefix[at] * POWERS[power]) % PRIME, *self.labels[stop])
            self.stops[at] = stop
        #: Least position of an edit that this direction looks for: the halves meet, but share no position.
        self.first = size - size // 2 if backward else size // 2

    def salt(self, size: int) -> int:
        """What tells the trie of words of one length and direction from others."""
        return (2 * size + self.side) * SALT % PRIME


def plain_edges(word: int, path: Path) -> list[tuple]:
    """Edges past the first half of a word: (node, label, child)."""
    prefix, salt = path.prefix, path.salt(path.size)
    return [((prefix[at] + salt) % PRIME, path.labels[at][0], (prefix[path.stops[at]] + salt) % PRIME)
            for at in range(path.size // 2, path.size)]


def free_edges(word: int, path: Path) -> list[tuple]:
    """Edges that read any code point and then a label: (node, label, code point, child). Label 0 reads nothing."""
    prefix, salt = path.prefix, path.salt(path.size)
    return [((prefix[at] + salt) % PRIME, path.labels[at + 1][0] if at + 1 < path.size else 0, path.points[at],
             (prefix[path.stops[at + 1]] + salt) % PRIME) for at in range(path.first, path.size)]


def replaced_states(word: int, path: Path) -> list[tuple]:
    """States whose code point a larger one is to replace: (id, node, label, code point, rest), label 0 if nothing follows."""
    prefix, salt, out = path.prefix, path.salt(path.size), []
    for at in range(path.first, path.size):
        labels = path.labels[at + 1]
        out.append((word, (prefix[at] + salt) % PRIME, labels[0] if labels else 0, path.points[at], labels[1:] or None))
    return out


def left_out_states(word: int, path: Path) -> list[tuple]:
    """States that have left out a code point, the first of equal ones in a row: (id, node, label, rest)."""
    prefix, salt, points, out = path.prefix, path.salt(path.size - 1), path.points, []
    for at in range(path.first, path.size):
        before = at + 1 if path.side else at - 1  # the code point before it in the word
        if not 0 <= before < path.size or points[before] != points[at]:
            labels = path.labels[at + 1]
            out.append((word, (prefix[at] + salt) % PRIME, labels[0] if labels else 0, labels[1:] or None))
    return out


def word_end(word: int, path: Path) -> list[tuple]:
    return [((path.prefix[path.size] + path.salt(path.size)) % PRIME, word)]


ARROW = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}


def _rows(make: Callable, schema: list[str]) -> Callable:
    """Rows of every word, forward and backward, in batches of bounded size."""
    names, types = zip(*(field.split() for field in schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, t in zip(columns, types)], list(names))

        for batch in batches:
            for word, letters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for backward in (False, True):
                    rows += make(word, Path(letters[::-1] if backward else letters, backward))
                if len(rows) >= ROWS:
                    yield out()
                    rows = []
        yield out()
    return run


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Sort-merge join, whatever the sizes look like: Spark takes what Python makes of a word for about as large as the word, and
    compressed files for as large as their rows, so it would collect and broadcast tables that the driver cannot hold."""
    return left.join(right.hint("merge"), on, how)


def neighbours(words: DataFrame) -> DataFrame:
    """(a, b): ids of every pair of distinct ``word`` that one inserted, deleted or replaced code point tells apart, once each.

    ``words`` has (id long, word string) with distinct ids and words and should be a written table, as it is read
    several times. Null and empty words have no neighbours. No pair is made but of states with equal node and label; a
    state meets at most the other code points that its edge may read. The edge table is written once; there is
    one join a level, and levels are the logarithm of half the longest word.
    """
    held = words.select("id", "word").filter("word <> ''")
    longest = held.agg(F.max(F.length("word"))).first()[0] or 0
    if not longest:
        return words.sparkSession.createDataFrame([], "a long, b long")
    walk = lambda make, schema: held.mapInArrow(_rows(make, schema), ", ".join(schema))
    # dealt by the join key before the doubles go, so that one exchange serves both
    free = walk(free_edges, ["node long", "label long", "larger int", "child long"]).repartition("node", "label").distinct()
    plain = saved(walk(plain_edges, ["node long", "label long", "child long"]).repartition("node", "label").distinct(), "trie")
    ends = walk(word_end, ["node long", "target long"])

    replaced = joined(
        walk(replaced_states, ["id long", "node long", "label long", "point int", "rest array<long>"]), free, ["node", "label"]).filter("larger > point").select("id", "child", "rest")
    left_out = walk(left_out_states, ["id long", "node long", "label long", "rest array<long>"])
    # the end of a word is reached without a further edge
    over = left_out.filter("label = 0").select("id", F.col("node").alias("child"), "rest")
    moved = joined(left_out.filter("label <> 0"), plain, ["node", "label"]).select("id", "child", "rest")
    frontier = saved(replaced.unionByName(over).unionByName(moved), "frontier")
    done = frontier.filter("rest is null")
    for _ in range((longest // 2).bit_length()):
        alive = frontier.filter("rest is not null").select(
            "id", F.col("child").alias("node"), F.col("rest")[0].alias("label"),
            F.when(F.size("rest") > 1, F.slice("rest", 2, F.size("rest"))).alias("rest"),
        )
        frontier = saved(joined(alive, plain, ["node", "label"]).select("id", "child", "rest"), "frontier")
        done = done.unionByName(frontier.filter("rest is null"))
    found = joined(done, ends, F.col("child") == F.col("node")).select(F.col("id").alias("a"), F.col("target").alias("b"))
    a, b = (words.select(F.col("id").alias(x), F.col("word").alias(f"{x}_word")) for x in "ab")
    return joined(joined(found, a, "a"), b, "b").filter(F.levenshtein("a_word", "b_word", 1) == 1).select("a", "b")


def last_forms(forms: DataFrame) -> DataFrame:
    """(id, root): where following ``form`` (id, form; form null at the end) leads, by pointer jumping over written tables.

    Chains must have no cycle; here forms are ever more frequent, so a chain is as long as the logarithm of the largest count.
    """
    now = saved(forms.filter("form is not null").select("id", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("id").alias("mid"), F.col("root").alias("far"))
        ahead = joined(now, step, F.col("root") == F.col("mid"), "left")
        if ahead.filter("mid is not null").isEmpty():
            return joined(forms.select("id"), now, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
        now = saved(ahead.select("id", F.coalesce("far", "root").alias("root")), "roots")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n).

    n_near counts the words one edit away. A word's form is the most frequent of them (ties: the smallest in code
    point order), if it occurs at least ``ratio`` times as often (``ratio`` above 1); root follows forms to the last, and is the
    word itself without one. An empty table gives an empty result.
    """
    kept = saved(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = saved(neighbours(kept), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = kept.select(F.col("id").alias("b"), F.col("n").alias("other_n"), F.col("word").alias("other"))
    best = joined(both, known, "b").groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("least"), "other", "b")).alias("best"),
    )
    linked = saved(joined(kept, best, F.col("id") == F.col("a"), "left").withColumn(
        "is_form", -F.col("best.least") >= ratio * F.col("n")).select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *[F.when(F.col("is_form"), x).alias(name) for name, x in (
            ("form", F.col("best.other")), ("form_id", F.col("best.b")), ("form_n", -F.col("best.least")))],
    ), "linked")
    roots = last_forms(linked.select("id", F.col("form_id").alias("form")))
    moved = joined(roots.filter("root <> id"), kept.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    return joined(linked, moved.select("id", "root_word"), "id", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
