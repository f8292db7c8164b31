"""Personal data by weak supervision, in DataFrame expressions alone.

Patterns propose spans. Labelers (shape, gazetteer, context, composition) vote on each span: for, against
or abstaining. Expectation-maximisation over the counted vote patterns of all spans estimates how reliable
each labeler is and how likely each pattern is right; those soft labels train a logistic span classifier,
which decides about the spans beyond the base kinds. The counted table is bounded by the number of
vote and feature combinations, whatever the input; only it reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions.text import let
from hearthline.llm.files import free_name, saved

#: Patterns of the base kinds, written so that they never backtrack over a run: a match can only begin
#: where the pattern's first run begins or where the previous match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # proposed by the method, decided by the classifier
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|named?|signed|contact)\b[.:]?\x20"
            r"\p{Lu}\p{Ll}\p{L}*+(?:\x20\p{Lu}\p{Ll}\p{L}*+){0,2}+",
    "secret": r"(?<![0-9A-Za-z_])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}+|gh[pousr]_[0-9A-Za-z]{36,}+"
              r"|github_pat_[0-9A-Za-z_]{22,}+|(?<!-)sk-(?:(?=[A-Za-z_-]*+[0-9])[0-9A-Za-z_-]{20,}+|[0-9A-Za-z]{20,}+))"
              r"(?![0-9A-Za-z_])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Characters before a span in which a context labeler looks for its cue.
CONTEXT = 40
#: Code points of a piece of text; a context is cut from two neighbouring pieces, not from the whole text.
PIECE = 1024
CUES = {
    "email": r"(?i)e-?mail|contact|write|courriel|correo|kontakt",
    "ip": r"(?i)\bip\b|host|server|address|adresse|addr",
    "card": r"(?i)card|visa|master|credit|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel\b|tel\.|mobile|fax|telefon|llame",
    "name": r"(?i)dear|signed|author|by\b|contact|regards",
    "secret": r"(?i)token|secret|key|passw|auth|credential",
}
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|22[4-9]|2[3-5])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
    "name": r"\b(?:Anna|Maria|Peter|John|James|Mary|Robert|Michael|David|Thomas|Paul|Laura|Julia|Jean|Pierre|Marie"
            r"|Claire|Hans|Klaus|Karl|Carlos|Juan|Luis|Ana|Carmen|Jose|José|Smith|Müller|Garcia|García|Martin)\b",
    "secret": r"^(?:AKIA|gh[pousr]_|github_pat_|sk-)",
}
ROUNDS = 40


def luhn(digits: Column) -> Column:
    """Luhn test of a string of digits."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), "(?!$)"), lambda x, i: F.when(
        i % 2 == 1, doubled(x.cast("int"))).otherwise(x.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base kind counts."""
    digits = F.regexp_replace(m, "[^0-9]+", "")
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def running(numbers: Column) -> Column:
    """Running sums of an array by doubling: each of log2(n) rounds adds to every element the one 2^k places before it."""
    bits = F.length(F.bin(F.size(numbers).cast("long")))
    steps = F.transform(F.sequence(F.lit(0), bits - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, numbers, lambda sums, step: F.transform(
        sums, lambda x, i: x + F.coalesce(F.get(sums, i - step), F.lit(0))))


def matches(text: Column, pattern: str, needs: Column | None = None) -> Column:
    """Array of (m, s): every match of ``pattern`` and its start in code points.

    Ends are running sums of the lengths of the matches and of the gaps before them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<m:string,s:int>>")

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        steps = F.zip_with(hits, gaps, lambda m, g: F.length(m) + F.length(g))
        return let(running(steps), lambda ends: F.zip_with(
            hits, ends, lambda m, e: F.struct(m.alias("m"), (e - F.length(m)).alias("s"))))

    some = let(found, lambda h: F.when(F.size(h) > 0, placed(h)).otherwise(empty))
    return some if needs is None else F.when(needs, some).otherwise(empty)


def features(kind: str, m: Column, before: Column) -> list[Column]:
    """Small integers of a span: four votes (0 abstains, 1 for, 2 against), then length and digit classes."""
    size = F.length(m)
    digits = F.length(F.regexp_replace(m, "[^0-9]+", ""))
    vote = lambda yes, no: F.when(yes, 1).when(no, 2).otherwise(0)
    shape = {
        "email": vote(m.rlike(r"^[A-Za-z0-9][^@]*@[^.]+\.[A-Za-z]"), m.rlike(r"[0-9-]$")),
        "ip": vote(m.rlike(r"^[1-9][0-9]*\.(?:0|[1-9][0-9]*)\.(?:0|[1-9][0-9]*)\.(?:0|[1-9][0-9]*)$"), m.rlike(r"^0|\.0[0-9]")),
        "card": vote(m.rlike(r"^[0-9]{16}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), m.rlike(r"[ -][0-9][ -]")),
        "phone": vote(m.rlike(r"^\+[0-9]{1,3}[ -]?\(?[0-9]"), m.rlike(r"[.()-]{3}")),
        "name": vote(m.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Mme|Monsieur|Señora?|Sra?)\b"), m.rlike(r"^(?:name|contact)\b")),
        "secret": vote(m.rlike(r"[0-9]") & m.rlike(r"[A-Za-z]"), m.rlike(r"^(.)\1+$")),
    }[kind]
    listed = vote(m.rlike(GAZETTEER[kind]), F.lit(False))
    cue = vote(before.rlike(CUES[kind]), F.lit(False))
    mixed = vote(digits * 5 >= size, digits * 50 < size) if kind in ("secret", "phone", "ip", "card") else vote(
        digits * 5 < size, digits * 2 > size)
    return [shape, listed, cue, mixed, F.least(F.floor(size / 8), F.lit(7)), F.least(F.floor(digits * 4 / size), F.lit(3))]


#: Values of each small integer, in the order of ``features``; kind comes first.
SIZES = (len(KINDS), 3, 3, 3, 3, 8, 4)


def code(kind: str, parts: list[Column]) -> Column:
    out = F.lit(KINDS.index(kind))
    for part, size in zip(parts, SIZES[1:]):
        out = out * size + part
    return out.cast("int")


def decode(value: int) -> tuple[int, ...]:
    out = []
    for size in reversed(SIZES):
        value, part = divmod(value, size)
        out.append(part)
    return tuple(reversed(out))


def candidates(text: Column, kind: str) -> Column:
    """Array of (kind number, start, end, feature code) of the proposed spans of a kind, by start."""
    if kind == "email":
        needs = F.instr(text, "@") > 0
    elif kind == "phone":
        needs = F.instr(text, "+") > 0
    else:
        needs = None
    hits = matches(text, PATTERNS[kind], needs)
    if kind in BASE:
        hits = F.filter(hits, lambda h: valid(kind, h["m"]))

    def span(h: Column, pieces: Column) -> Column:
        at = F.greatest(h["s"] - CONTEXT, F.lit(0))
        piece = F.floor(at / PIECE).cast("int")
        near = F.concat(F.get(pieces, piece), F.coalesce(F.get(pieces, piece + 1), F.lit("")))
        before = F.substring(near, at - piece * PIECE + 1, h["s"] - at)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("k"), h["s"].alias("s"), (h["s"] + F.length(h["m"])).alias("e"),
            code(kind, features(kind, h["m"], before)).alias("f"),
        )

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    none = F.array().cast("array<struct<k:int,s:int,e:int,f:int>>")
    return let(hits, lambda found: F.when(F.size(found) > 0, let(
        pieces, lambda cut: F.transform(found, lambda h: span(h, cut)))).otherwise(none))


@dataclass
class Model:
    """Reliability of each labeler by kind, and weights of the span classifier by feature value."""

    right: list[list[list[float]]]
    wrong: list[list[list[float]]]
    weights: dict[tuple[int, int], float]

    def score(self, value: int) -> float:
        parts = decode(value)
        return 1 / (1 + math.exp(-sum(self.weights.get((i, p), 0.0) for i, p in enumerate(parts))))


def fit(counts: dict[int, int], rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over counted feature codes, then the classifier trained on its posteriors.

    ``right[k][j][v]`` is the chance that labeler j votes v on a true span of kind k, ``wrong`` on a false one.
    Pseudo-counts say that labelers are better than chance, so a kind whose spans all look alike stays likely.
    The work is over at most as many rows as there are feature codes.
    """
    rows = [(decode(f), n) for f, n in sorted(counts.items())]
    labelers = range(4)
    prior = [0.5] * len(KINDS)
    right = [[[0.3, 0.6, 0.1] for _ in labelers] for _ in KINDS]
    wrong = [[[0.5, 0.1, 0.4] for _ in labelers] for _ in KINDS]
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for parts, _n in rows:
            a, b = math.log(prior[parts[0]]), math.log(1 - prior[parts[0]])
            for j in labelers:
                a += math.log(right[parts[0]][j][parts[1 + j]])
                b += math.log(wrong[parts[0]][j][parts[1 + j]])
            post.append(1 / (1 + math.exp(min(b - a, 500))))
        yes = [[[2.0, 4.0, 1.0] for _ in labelers] for _ in KINDS]
        no = [[[4.0, 1.0, 3.0] for _ in labelers] for _ in KINDS]
        of_kind = [[1.0, 2.0] for _ in KINDS]
        for (parts, n), p in zip(rows, post):
            of_kind[parts[0]][0] += n * p
            of_kind[parts[0]][1] += n
            for j in labelers:
                yes[parts[0]][j][parts[1 + j]] += n * p
                no[parts[0]][j][parts[1 + j]] += n * (1 - p)
        prior = [min(max(a / b, 0.01), 0.99) for a, b in of_kind]
        right = [[[v / sum(x) for v in x] for x in k] for k in yes]
        wrong = [[[v / sum(x) for v in x] for x in k] for k in no]
    total = sum(n for _, n in rows) or 1
    weights = {(i, p): 0.0 for parts, _ in rows for i, p in enumerate(parts)}
    for _ in range(300):
        slope = dict.fromkeys(weights, 0.0)
        for (parts, n), p in zip(rows, post):
            z = sum(weights[i, v] for i, v in enumerate(parts))
            error = (p - 1 / (1 + math.exp(-z))) * n / total
            for i, v in enumerate(parts):
                slope[i, v] += error
        for k in weights:
            weights[k] += 2.0 * (slope[k] - 1e-4 * weights[k])
    return Model(right, wrong, weights)


def accepted(span: Column, model: Model) -> Column:
    """Base spans stay; others pass if the classifier's score is one half or more."""
    rest, z = span["f"], F.lit(0.0)
    for i in range(len(SIZES) - 1, -1, -1):
        part = rest % SIZES[i]
        rest = F.floor(rest / SIZES[i])
        known = [F.when(part == v, w) for (j, v), w in sorted(model.weights.items()) if j == i and w]
        z = z + F.coalesce(*known, F.lit(0.0))
    return (span["k"] < len(BASE)) | (z >= 0)


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, ...).

    Offsets are code points, ends exclusive. The base kinds follow fixed patterns and tests; kinds that
    the method proposes (name, secret) appear in ``spans`` if the trained classifier accepts them. Null and
    empty texts have no spans. Repeated rows are judged alike and count in the estimates as often as they
    occur. Texts are read once; the proposed spans are written as a table and everything else follows from
    it. An empty table gives an empty result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = docs.select(*keep)
    found = free_name(kept, "found")
    rows = saved(docs.select(*keep, F.concat(*[candidates(t, k) for k in KINDS]).alias(found)), "spans")
    counts = rows.select(F.explode(F.col(found)["f"]).alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()
    model = fit({r.f: r.n for r in counts})
    base = F.filter(found, lambda x: x["k"] < len(BASE))
    count = lambda kind: F.size(F.filter(found, lambda x: x["k"] == KINDS.index(kind))).cast("long")
    return rows.select(
        *keep, *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.filter(found, lambda x: accepted(x, model))).alias("spans"),
    )
