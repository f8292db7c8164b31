"""Quality rules as a short-circuit cascade, in DataFrame expressions alone.

Each rule's cost and rejection rate are estimated on a sample; the rules then stand in one CASE by
rejections per second, so that a row stops at its first failure and dear rules see few rows. The order
changes the time only, never a verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.llm.files import free_name, remove, save, scratch

#: White space between words.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of the sample that costs and rates are estimated on.
SAMPLE_ROWS = 2_000
#: Timed runs of a rule over the sample; the fastest counts.
RUNS = 2


@dataclass(frozen=True)
class Rule:
    """A named test; ``rejects`` is a Boolean column over the text statistics and the text itself."""

    name: str
    rejects: Column


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null and blank texts have none."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(inner) > 0, F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    n_lines counts the lines that have a word. Repeated windows are found per row: 64-bit hashes of the
    windows carry their position in the low bits and are sorted as longs; neighbours with equal high bits
    are compared word by word, and a text in which two different windows share those bits is sorted by
    its words instead. So the counts are exact at any length, and no window leaves its row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words, lines, bits, packed, near = (free_name(docs, n) for n in ("w", "lines", "bits", "packed", "near"))
    out = docs.withColumns({
        words: word_array(F.col(text)),
        lines: F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
    }).withColumns({
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    })
    out = out.withColumn("n_words", F.size(words).cast("long"))
    out = out.withColumn(bits, F.length(F.bin("n_words"))).withColumn(packed, F.expr(f"""
        CASE WHEN size({words}) > 3 THEN sort_array(transform(sequence(0, size({words}) - 3),
            i -> shiftleft(xxhash64({words}[i], {words}[i + 1], {words}[i + 2]), {bits}) | i))
        ELSE cast(array() AS array<bigint>) END"""))
    out = out.withColumn(near, F.expr(f"""
        CASE WHEN size({packed}) > 1 THEN transform(
            filter(sequence(1, size({packed}) - 1),
                   k -> shiftrightunsigned({packed}[k] ^ {packed}[k - 1], {bits}) = 0),
            k -> struct(cast({packed}[k - 1] & (shiftleft(1L, {bits}) - 1) AS int) AS a,
                        cast({packed}[k] & (shiftleft(1L, {bits}) - 1) AS int) AS b))
        ELSE cast(array() AS array<struct<a: int, b: int>>) END"""))
    same = " AND ".join(f"{words}[p.a + {j}] = {words}[p.b + {j}]" for j in range(3))
    by_words = f"""
        transform(array(sort_array(transform(sequence(0, size({words}) - 3),
            i -> struct({words}[i] AS x, {words}[i + 1] AS y, {words}[i + 2] AS z, i AS i)))), s ->
            transform(filter(sequence(1, size(s) - 1),
                k -> s[k].x = s[k - 1].x AND s[k].y = s[k - 1].y AND s[k].z = s[k - 1].z),
                k -> struct(s[k - 1].i AS a, s[k].i AS b)))[0]"""
    covered = "size(array_distinct(flatten(transform({pairs}, p -> array(p.a, p.a + 1, p.a + 2, p.b, p.b + 1, p.b + 2)))))"
    return out.withColumn("n_repeat_words", F.expr(f"""
        cast(CASE WHEN size({near}) = 0 THEN 0
             WHEN forall({near}, p -> {same}) THEN {covered.format(pairs=near)}
             ELSE {covered.format(pairs=f'({by_words})')} END AS bigint)""")).drop(words, lines, bits, packed, near)


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of the words inside repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def standard_rules(text: str = "text") -> list[Rule]:
    t, c = F.coalesce(F.col(text), F.lit("")), F.col
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    return [
        Rule("symbols", 10 * c("n_symbols") > c("n_words")),
        Rule("dup_lines", 2 * c("n_dup_lines") > c("n_lines")),
        Rule("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 12 * c("n_words"))),
        Rule("capitals", 2 * capitals > letters),
        Rule("letters", 5 * letters < 2 * c("word_chars")),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on a sample of about ``rows`` rows of ``docs``.

    The sample is drawn by row (uniform, seeded) and written once. A rule is timed with the statistics
    that it reads, which only it makes Spark compute; the time of a run without rules is taken off.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "sample")
    sample = statistics(save(docs.sample(min(1.0, rows / max(docs.count(), 1)), seed=7), folder), text)

    def run(test: Column) -> tuple[float, int, int]:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            n, hits = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum(test.cast("int")), F.lit(0))).first()
            times.append(time.perf_counter() - start)
        return min(times), n, hits

    floor, *_ = run(F.length(text) < 0)
    gain = {}
    for rule in rules:
        took, n, hits = run(rule.rejects)
        gain[rule.name] = (hits + 0.5) / (n + 1) / max(took - floor, 1e-3)
    remove(spark, folder)
    return sorted(rules, key=lambda r: -gain[r.name])


def first_failure(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects a row, null if none does; later rules aren't evaluated."""
    chain = None
    for rule in rules:
        chain = F.when(rule.rejects, rule.name) if chain is None else chain.when(rule.rejects, rule.name)
    return chain.otherwise(F.lit(None)) if rules else F.lit(None).cast("string")


def verdicts(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the statistics, base_failed and kept.

    kept is true when neither the base test nor any rule rejects the row. Null, empty and blank texts
    have zero counts and fail the base test. Repeated rows and rows with null ids are judged alike.
    Columns of ``docs`` named like a result are replaced by it. An empty table gives an empty result.
    """
    clash = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    plain = docs.drop(*[c for c in docs.columns if c.lower() in clash])
    rules = standard_rules(text) if rules is None else rules
    ordered = order_rules(plain.select(text), rules, text)
    judged = statistics(plain, text).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(first_failure(ordered).isNull()))
