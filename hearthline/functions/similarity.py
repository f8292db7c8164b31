"""Normalised indel similarity of short texts, computed inside Catalyst.

similarity(a, b) = 2 * LCS(a, b) / (len(a) + len(b)). Texts are bit vectors in as many BIGINT words of 60
bits as they need; a step per character of the other text passes a carry from word to word.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearthline.functions.text import let

#: Characters of a text in one BIGINT; the bits above hold the carry.
BITS = 60


def chars(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)(.)"), 1)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def char_masks(c: Column) -> Column:
    """MAP(character -> words with the bits of its positions).

    The words of a character are binary numbers: the text backwards, with 1 for the character and 0 for all others.
    """
    last = F.floor((F.char_length(c) - 1) / BITS).cast("int")

    def masks(letters: Column) -> Column:
        def words(k: Column) -> Column:
            digits = F.concat(F.repeat(F.lit("0"), k), F.lit("1"), F.repeat(F.lit("0"), F.size(letters) - k - 1))
            part = lambda w: F.call_function("translate", F.reverse(F.substring(c, w * BITS + 1, F.lit(BITS))), F.array_join(letters, ""), digits)
            return F.transform(F.sequence(F.lit(0), last), lambda w: F.conv(part(w), 2, 10).cast("bigint"))
        return F.map_from_arrays(letters, F.transform(letters, lambda ch, k: words(k)))

    return let(F.array_distinct(chars(c)), masks)


def _lcs_word(masks: Column, length: Column, other: Column) -> Column:
    """LCS with a text of at most BITS characters."""
    def run(full: Column) -> Column:
        def step(v: Column, ch: Column) -> Column:
            hit = v.bitwiseAND(F.coalesce(F.get(F.try_element_at(masks, ch), F.lit(0)), F.lit(0).cast("bigint")))
            return (v + hit).bitwiseOR(v - hit).bitwiseAND(full)
        return F.bit_count(F.aggregate(chars(other), full, step))

    return length - let(_bit(length) - 1, run)


def _lcs_words(masks: Column, length: Column, other: Column) -> Column:
    """LCS with a text of any length."""
    none = F.lit(0).cast("bigint")

    def run(full: Column) -> Column:
        def step(v: Column, ch: Column) -> Column:
            def added(own: Column) -> Column:
                def word(done: Column, w: Column) -> Column:
                    hit = F.get(v, w).bitwiseAND(F.coalesce(F.get(own, w), none))
                    total = F.get(v, w) + hit + done["carry"]
                    new = total.bitwiseOR(F.get(v, w) - hit).bitwiseAND(F.get(full, w))
                    return F.struct(F.shiftright(total, BITS).alias("carry"), F.array_append(done["out"], new).alias("out"))
                start = F.struct(none.alias("carry"), F.array().cast("array<bigint>").alias("out"))
                return F.aggregate(F.sequence(F.lit(0), F.size(v) - 1), start, word, lambda done: done["out"])
            return let(F.try_element_at(masks, ch), added)
        return F.aggregate(F.aggregate(chars(other), full, step), F.lit(0), lambda n, v: n + F.bit_count(v).cast("int"))

    words = F.sequence(F.lit(0), F.floor((length - 1) / BITS).cast("int"))
    return length - let(F.transform(words, lambda w: _bit(F.least(F.lit(BITS), length - w * BITS)) - 1), run)


def lcs_length(a: Column, b: Column, masks: Column | None = None) -> Column:
    """Length of the longest common subsequence; ``masks`` may be a column with ``char_masks(a)``."""
    if masks is None:
        return let(char_masks(a), lambda made: lcs_length(a, b, made))
    la, lb = F.char_length(a), F.char_length(b)
    return (
        F.when((la == 0) | (lb == 0), 0)
        .when(la <= BITS, _lcs_word(masks, la, b))
        .otherwise(_lcs_words(masks, la, b))
    )


def at_least(lcs: Column, a: Column, b: Column, percent: int) -> Column:
    """similarity >= percent/100 without floating point."""
    return lcs * 200 >= (F.char_length(a) + F.char_length(b)) * percent


def length_gate(a: Column, b: Column, percent: int) -> Column:
    la, lb = F.char_length(a), F.char_length(b)
    return F.least(la, lb) * 200 >= (la + lb) * percent


def levenshtein_gate(a: Column, b: Column, percent: int) -> Column:
    """Necessary condition: the indel distance is never below the Levenshtein distance."""
    budget = F.floor((F.char_length(a) + F.char_length(b)) * (100 - percent) / 100).cast("int")
    return F.call_function("levenshtein", a, b, budget) >= 0
