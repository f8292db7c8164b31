"""Training-data operators against plain versions, on small fixtures with nulls, ties, repeats and long texts."""

import hashlib
import os
import random
import re
import sys
import time
import unicodedata
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from check import TABLES, rows_of  # noqa: E402

import corpus_pipeline  # noqa: E402
from hearthline.llm import (  # noqa: E402
    components, decontaminate, langid, licenses, mixing, perfect_hash, pii, quality, queries, sharding, simhash, token_files, warc,
)

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, fp string, row string, n_words int"
LONG = "the of and thing erre onst " * 30_000
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empties, repeats, ties, a very long text, columns whose names operators use inside."""
    texts = [None, "", " \n\t ", "one two", "a b c d e f", "a b c d e f", "A b C d E f", LONG, LONG + " x", "x" * 200_000,
             "a a a a a a", "naïve Ünïcode ß İ 你好 😀 done", "l1\nl1\n\nl2 \nl1"]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s", None][i % 2], None, i, "f", "r", 0) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "a b c d e f", None, None, None, 0, "f", "r", 0), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def union_find(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(x) for x in range(n)]


def check_components(rows):
    prints = sorted({int(r.fingerprint, 16) for r in rows})
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    group = dict(zip(prints, union_find(len(prints), pairs)))
    least = defaultdict(list)
    for r in rows:
        if r.doc_id is not None:
            least[group[int(r.fingerprint, 16)]].append(r.doc_id)
    for r in rows:
        assert r.component_id == min(least[group[int(r.fingerprint, 16)]], default=None)


@pytest.mark.parametrize("which", ["hard", "docs"])
def test_simhash(which, request):
    frame = request.getfixturevalue(which)
    texts = {r.doc_id: r.text for r in frame.collect()}
    rows = simhash.near_duplicates(frame).collect()
    assert len(rows) == frame.count()
    for r in rows:
        if r.doc_id is not None and len(texts[r.doc_id] or "") < 50_000:
            assert r.fingerprint == f"{plain_fingerprint(texts[r.doc_id]):016x}"
    check_components(rows)


def test_simhash_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    text = "The quick  brown\tfox jumps over thelazylongworddog and runs\n away " * 3
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_links_of_a_hot_bucket_keep_every_component(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 4).astype(np.uint64)
    near = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)) ^ (
        np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)) for b in base] + [base]))
    monkeypatch.setattr(simhash, "BLOCK", 16)  # read on the driver, where buckets are dealt into blocks
    frame = spark.createDataFrame([(int(x),) for x in near.view(np.int64)], "fp long")
    edges = simhash.links(frame).collect()
    at = {int(x): i for i, x in enumerate(near.view(np.int64))}
    want = union_find(len(near), [(i, j) for i in range(len(near)) for j in range(i) if int(near[i] ^ near[j]).bit_count() <= 3])
    assert union_find(len(near), [(at[e.u], at[e.v]) for e in edges]) == want


def test_components_of_chain_star_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(5, 5)]
    got = {r.u: r.v for r in components.roots(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 40)}}
    assert components.roots(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_first_leaves_one_of_each_group(hard, empty):
    kept = simhash.keep_first(hard)
    assert kept.columns == hard.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    named = {r.component_id for r in simhash.near_duplicates(hard).collect()}
    assert ids == sorted(named)
    assert simhash.keep_first(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_warc_round_trip(spark, tmp_path):
    body = "<p>" + "again " * 40
    rows = [(1, "http://Www.Ex.org:80/A b?q#f", body), (2, None, body), (3, "", ""), (4, "x", None), (4, "x", None), (None, "y", body),
            (5, "http://ex.org/\r\nX: y", "é" * 60), (6, "z", "é" * 60), (7, "long", LONG), (1, "http://ex.org/2", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    records, index = warc.archive_pages(pages, folder=folder)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in records.collect())
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        of = {body: 1, "é" * 60: 5}.get(html)
        again = page is not None and of is not None and of != page
        want.append((page or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", of if again else 0))
    assert got == sorted(want)
    lines = [(r.url_key, r.stamp, r.page_id) for r in index.collect()]
    assert len(lines) == len(rows) and "org,ex)/a%20b?q" in {x[0] for x in lines}
    archives = index.select(F.concat(F.lit(f"{folder}/archives/"), "archive").alias("archive"))
    assert sorted(map(str, warc.read_archives(archives).collect())) == sorted(map(str, records.collect()))
    none = warc.archive_pages(pages.limit(0))
    assert none[0].count() == 0 and none[1].count() == 0


def test_merge_orders_many_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    rng, blocks, every = random.Random(1), [], []
    for run in range(11):
        lines = sorted(f"k{rng.randrange(60):03d} {run} {i}" for i in range(rng.randrange(0, 60)))
        every += lines
        file = warc.NewFile(f"file://{tmp_path}/runs", ".idx")
        blocks += list(warc._blocks(iter(lines), file, run))
        file.close()
    frame = spark.createDataFrame(blocks, warc.BLOCK_SCHEMA)
    done = warc.merge_runs(frame, f"file://{tmp_path}/merged", range_lines=40, fan_in=3).orderBy("first").collect()
    got = [line for b in done for line in warc._lines([(b.path, b.offset, b.size)], None, None)]
    assert got == sorted(every)


def test_schedule_never_deviates_by_a_block():
    for weights in ({"a": 10, "b": 5, "c": 1}, {"a": 1}, {c: i + 1 for i, c in enumerate("abcdefgh")}):
        counts = mixing.slots_of(weights)
        given = dict.fromkeys(counts, 0)
        for t, (s, i) in enumerate(mixing.schedule(counts), 1):
            assert given[s] == i
            given[s] += 1
            assert all(abs(given[x] - counts[x] * t / mixing.PERIOD) < 1 for x in counts)
        assert given == counts


def test_mix_keeps_every_row_and_the_weights(docs, hard, empty):
    weights = {"src1": 3.0, "src2": 1.0}
    rows = sorted(mixing.mix(docs, weights, block=1).collect(), key=lambda r: r.mix_position)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert len({r.mix_position for r in rows}) == len(rows)
    left = defaultdict(int)
    for r in rows:
        left[r.mix_stream] += 1
    assert set(left) == {"src1", "src2", mixing.REST}
    got = defaultdict(int)
    for r in rows:
        got[r.mix_stream] += 1
        if any(got[s] == left[s] for s in left):
            break
        if r.mix_slot < mixing.PERIOD:
            assert abs(got["src1"] - 3 * got["src2"]) <= 4
    assert mixing.mix(hard).count() == hard.count() and mixing.mix(empty).count() == 0
    ordered = mixing.in_order(mixing.mix(docs, weights))
    assert ordered.columns == docs.columns and ordered.count() == docs.count()


def fluid(blocks, weights, slot):
    """Blocks each source is due by its weight after ``slot`` slots, weights scaled up when sources run out."""
    due, left = dict.fromkeys(blocks, Fraction(0)), Fraction(slot)
    while left and (live := [s for s in blocks if due[s] < blocks[s]]):
        total = sum(Fraction(weights[s]) for s in live)
        step = min(left, *((blocks[s] - due[s]) * total / Fraction(weights[s]) for s in live))
        for s in live:
            due[s] += step * Fraction(weights[s]) / total
        left -= step
    return due


def test_slots_follow_the_target_weights():
    rng = random.Random(5)
    cases = [({0: 1_200, **dict.fromkeys(range(1, 20), 130)}, {0: 1 / 3, **dict.fromkeys(range(1, 20), 2 / 57)})]
    cases += [(b := {s: rng.randrange(1, 60) for s in range(12)}, {s: n ** 0.5 for s, n in b.items()}) for _ in range(3)]
    cases += [({s: rng.randrange(1, 9) for s in range(9)}, {s: rng.random() for s in range(9)}) for _ in range(3)]
    for blocks, weights in cases:
        given = dict.fromkeys(blocks, 0)
        for t, (s, i) in enumerate(mixing.slots(list(blocks.values()), mixing.whole(list(weights.values()))), 1):
            assert given[s] == i
            given[s] += 1
            if t % 7 == 0 or t < 300:
                due = fluid(blocks, weights, t)
                assert all(abs(given[x] - due[x]) < 1 for x in blocks)
        assert given == blocks


def test_every_source_has_its_own_weight(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 6)  # the driver's; more than one file of slots
    sizes = {f"s{k:04d}": 1 + k % 5 for k in range(1_200)} | {"big": 900, None: 40}
    rows = [(s, k * 10_000 + i) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    frame = spark.createDataFrame(rows, "source string, doc_id long")
    for weights in (None, {s: 1.0 + (s == "big") for s in sizes if s}):
        mixed = sorted(mixing.mix(frame, weights, block=1).collect(), key=lambda r: r.mix_position)
        assert sorted((r.source or "", r.doc_id) for r in mixed) == sorted((s or "", d) for s, d in rows)
        assert [r.mix_position for r in mixed] == list(range(len(rows)))
        assert all(r.mix_stream == (r.source or mixing.REST) for r in mixed)
        blocks = {s or mixing.REST: n for s, n in sizes.items()}
        share = mixing.stream_weights(blocks, weights)
        for t in (1, 50, 333, 1_500, 3_000, len(rows)):
            due, given = fluid(blocks, share, t), Counter(r.mix_stream for r in mixed[:t])
            assert all(abs(given[s] - due[s]) < 1 for s in blocks)


def test_templates():
    scanner = licenses.Scanner({
        "t": "must <<opt>>may <<opt>>even<</opt>><</opt>> hold <<var:2>> end", "u": "a a b",
    }, {"x y": "xy", "y x": "yx"})
    accepted = ["must hold end", "must may hold end", "must may even hold one two end", "Must, hold: one END"]
    for text in accepted:
        assert [x[2] for x in scanner.scan(text.encode())[2]] == ["t"], text
    for text in ["must even hold end", "must hold one two three end", "must hold", "hold end", "must not hold end"]:
        assert not scanner.scan(text.encode())[2], text
    assert scanner.scan(b"a a a b a a b")[2] == [(1, 4, "u"), (4, 7, "u")]
    assert [x[:2] for x in sorted(scanner.scan(b"x y x y")[1])] == [(0, 2), (1, 3), (2, 4)]


def filled(template, names):
    """A text of a template: optional regions left out, replaceable ones of several words take a name, of one word a list mark."""
    text = re.sub("<<opt>>.*?<</opt>>", "", template, flags=re.S)
    return re.sub(r"<<var:(\d+)>>", lambda m: names if int(m[1]) > 1 else "-", text)


def test_whole_license_texts():
    scanner = licenses.Scanner()
    whole = lambda text: {x[2] for x in scanner.scan(text.encode())[2] if x[2].endswith("-whole")}
    for label, template in licenses.BODIES.items():
        for names in ("the copyright holders and contributors", "ACME, Inc."):
            text = filled(template, names)
            assert whole("Copyright 2020\n" + text.upper() + "\nint main") == {label}
            assert whole(text.replace(" as is ", " “AS IS” ")) == {label}
        words = filled(template, "the authors").split()
        for at in range(0, len(words), 7):  # a changed, lost or added word
            if words[at] not in ("the", "authors", "-"):
                assert label not in whole(" ".join(words[:at] + ["otherwise9"] + words[at + 1:])), (label, at)
                assert label not in whole(" ".join(words[:at] + words[at + 1:])), (label, at)
        assert label not in whole(" ".join(words[:len(words) // 2]))
    numbered = filled(licenses.BODIES["bsd-3-clause-whole"], "X").replace("- redistributions of", "1. redistributions of").replace("- neither", "3. Neither")
    assert whole(numbered) == {"bsd-3-clause-whole"}
    tuesday = filled(licenses.BODIES["mit-whole"], "the authors").split(" including without")[0] + " but only on Tuesdays and never for sale"
    assert whole(tuesday) == set()
    assert whole(filled(licenses.BSD_OPENING, "X").split("<<")[0].split("met")[0] + "met: you pay us") == set()


def test_license_scan_of_all_rows(docs, hard, empty):
    def plain(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        hits = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        starts = [i for i, _ in hits]
        return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))

    for frame in (docs, hard):
        rows = licenses.scan_licenses(frame, ["doc_id", "text"]).collect()
        assert len(rows) == frame.count()
        for r in rows:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(r.text)
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licenses.scan_licenses(empty, ["doc_id"]).count() == 0


def test_perfect_hash():
    for n in (0, 1, 2, 3, 50, 5_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 62, n).astype(np.uint64))
        made = perfect_hash.PerfectHash.build(keys)
        assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))


def test_encoder_equals_the_library():
    encoder, tokenizer = token_files.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rng, signs = random.Random(2), list("ab'sStTΣςİıßéÉÿÖ́　 \x0b\x1c\x85\x00 \t\n0189²_-!.,你😀ﬁ") + ["<|endoftext|>", "'ll", "the"]
    texts = ["", LONG, unicodedata.normalize("NFD", "é à la"), *("".join(rng.choices(signs, k=rng.randrange(25))) for _ in range(3_000))]
    for text in texts:
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def test_token_files_round_trip(spark, docs, hard, empty):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for frame in (docs, hard):
        files = token_files.write_tokens(frame, VOCABULARY, ["doc_id"])
        want, start = [], 0
        for r in sorted(frame.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
            ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
            want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        for back in (token_files.read_by_key(files), token_files.read_back(files)):
            got = sorted(back.collect(), key=lambda r: r.start)
            assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
            assert [r.doc_id for r in got] == [x[0] for x in want]
            assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:])) and got[0].start == 0
    assert token_files.lookup(files, spark.createDataFrame([(10**9 + k,) for k in range(500)], "key long")).count() == 0
    assert token_files.read_by_key(token_files.write_tokens(empty, VOCABULARY, ["doc_id"])).count() == 0


def test_decontamination_in_parts_and_short_items(spark, hard, empty, monkeypatch):
    items = [(1, "a b c d"), (2, "of and thing erre onst the of and thing erre onst the of"), (3, None), (4, ""), (None, "a b"), (5, "E f"), (5, "E f")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def plain(text):
        words = decontaminate.words_of((text or "").encode())
        hit, found = set(), set()
        for item, t in items:
            for w in decontaminate.windows((t or "").encode()) if item is not None else ():
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i:i + len(w)]) == w:
                        hit.update(range(i, i + len(w)))
                        found.add(item)
        return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)

    frame = hard.filter("length(text) < 250000 or text is null")
    whole, parts = (sorted(map(str, decontaminate.contamination(frame, bench, ["doc_id", "text"], part_bytes=b).collect())) for b in (1 << 20, 100))
    assert whole == parts
    named = bench.select(F.concat(F.lit("item "), "item_id").alias("item_id"), "text")
    by_name = {b: sorted(map(str, decontaminate.contamination(frame, named, ["doc_id"], part_bytes=b).collect())) for b in (1 << 20, 100)}
    assert by_name[100] == by_name[1 << 20]
    reads = []
    table = decontaminate.SearchTable([((b"a", b"b"), "1")])
    monkeypatch.setattr(decontaminate, "_read_part", lambda folder, part: reads.append(part) or [((b"a", b"b"), "1")])
    batch = decontaminate.pa.RecordBatch.from_arrays([decontaminate.pa.array([1, 2]), decontaminate.pa.array([b"a b c", b"b a"])], ["row", "data"])
    out = [r for b in decontaminate._part_hits(iter([batch] * 5), "", 1) for r in b.to_pylist()]
    assert reads == [1] and [r["row"] for r in out] == [1] * 5 and table.search([b"a", b"b", b"c"]) == ([(0, 2)], {"1"})
    monkeypatch.undo()
    known = {}
    for r in decontaminate.contamination(frame, bench, ["doc_id", "text"]).collect():
        key = r.text
        known.setdefault(key, plain(key))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == known[key]
    clean = decontaminate.keep_clean(frame, bench)
    assert clean.columns == frame.columns
    assert decontaminate.keep_clean(empty, bench).count() == 0 and decontaminate.keep_clean(frame, bench.limit(0)).count() == frame.count()


def test_quality_counts(spark, hard, empty):
    def plain(text):
        text = text or ""
        words, places, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text), defaultdict(list), set(), 0
        for i in range(len(words) - 2):
            places[tuple(words[i:i + 3])].append(i)
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        again = {p for v in places.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)

    rows = quality.verdicts(hard).collect()
    assert len(rows) == hard.count()
    for r in rows:
        want = plain(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert quality.verdicts(empty).count() == 0


def test_rules_are_ordered_by_rejections_per_cost(spark):
    frame = spark.createDataFrame([(f"w {i}",) for i in range(300)], "text string")
    rules = [quality.Rule("never", F.col("text").isNull()), quality.Rule("always", F.col("text").isNotNull())]
    ordered = quality.order_rules(frame, rules)
    assert [r.name for r in ordered] == ["always", "never"]
    assert frame.select(quality.first_failure(ordered).alias("f")).distinct().collect()[0].f == "always"


def test_lookup_table_is_even_and_moves_little(spark, hard):
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(names, 10_007)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    assert [names[i] for i in table] == [names[::-1][i] for i in sharding.lookup_table(names[::-1], 10_007)]
    fewer = sharding.lookup_table(names[:-1], 10_007)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 0.2 * len(table)
    placed = sharding.place(hard, ["doc_id"], names)
    assert placed.columns == [*hard.columns, "shard"] and placed.count() == hard.count()
    assert placed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).filter("n <> 1").count() == 0
    for bad in ([], ["a"] * 0):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)


def test_kneser_ney_sums_to_one():
    packed, counts = np.unique(np.concatenate(list(langid.grams("the cat and the hat and that"))), return_counts=True)
    model = langid.Model(packed, counts)
    for context in ("the", "xyz", "at "):
        start = [ord(c) for c in context]
        all_next = np.array([sum(c << 16 * (3 - i) for i, c in enumerate([*start, x])) for x in range(1 << 16)], np.uint64)
        assert abs(np.exp2(model.log_probs(all_next)).sum() - 1) < 1e-6
    again = langid.Model.load(model.dump())
    assert (again.log_probs(packed) == model.log_probs(packed)).all()


def test_stored_models_keep_every_gram(spark, monkeypatch):
    texts = {"en": "the cat and the hat " * 60_000 + "quiz q", "xx": "ab ba 𐐀x 你好 abba", "yy": "z"}
    monkeypatch.setattr(langid, "PART", 8)  # the driver's; many ranges of hashes
    monkeypatch.setattr(langid, "KEPT", 200)
    places, bits = langid.train(spark.createDataFrame([(k, v) for k, v in texts.items()], "lang string, text string"))
    assert [k for k, _ in places] == sorted(texts) and bits > 0
    for lang, own in places:
        grams = np.concatenate(list(langid.grams(texts[lang])))
        packed, counts = np.unique(grams, return_counts=True)
        model, stored = langid.Model(packed, counts), langid.StoredModel(own, bits)
        for n in range(1, 5):
            for name, keys in (("keys", model.keys), ("contexts", model.contexts)):
                assert sum(e for (a, b, _), (_, _, e) in own.items() if (a, b) == (name, n)) == len(keys[n])
        odd = np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64)
        probe = np.concatenate([packed, odd, packed ^ np.uint64(1), *langid.grams("quiz the zebra")])
        assert np.allclose(stored.log_probs(probe), model.log_probs(probe), rtol=1e-9)


def test_grams_do_not_depend_on_pieces(monkeypatch):
    texts = ["", "12 !", "Ab c", " a  b", "ab, cd? ÉÈ 😀 x𐐀y ", "a" * 9]
    whole = [np.concatenate([*langid.grams(t), np.zeros(0, np.uint64)]) for t in texts]
    for size in (1, 2, 3, 5):
        monkeypatch.setattr(langid, "PIECE", size)
        for t, w in zip(texts, whole):
            assert (np.concatenate([*langid.grams(t), np.zeros(0, np.uint64)]) == w).all()


def test_language_of_held_out_rows(spark, hard, empty):
    rows = langid.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ["doc_id", "lang"]).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in rows) <= 0.005 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = langid.identify(hard, ["doc_id", "text"]).collect()
    assert len(odd) == hard.count()
    for r in odd:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.rejected)
    assert langid.identify(empty, ["doc_id"]).count() == 0
    assert langid.keep_known(hard).columns == hard.columns


UNLEARNED = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on "
          "toimittava toisiaan kohtaan veljeyden hengessä. Kylmä tuuli puhalsi järven yli koko pitkän talven ajan.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya "
          "bergaul satu sama lain dalam semangat persaudaraan. Kami pergi ke pasar pagi untuk membeli sayur.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni "
          "postępować wobec innych w duchu braterstwa. Zimny wiatr wiał nad jeziorem przez całą zimę.",
    "random": "".join(random.Random(8).choices("abcdefghijklmnopqrstuvwxyz ", k=400)),
    "keys": "asdf jklö qwer uiop zxcv bnm, dfgh tzui wert xcvb yxcv hjkl poiu lkjh mnbv fdsa rewq vcxy gfds trew " * 3,
}


def test_unlearned_languages_are_rejected(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    planted = spark.createDataFrame([(-k - 1, t, None) for k, t in enumerate(UNLEARNED.values())], known.schema)
    both = langid.identify(known.unionByName(planted), ["doc_id", "text", "lang"]).collect()
    assert all(r.rejected for r in both if r.doc_id < 0), [(r.text[:20], r.entropy) for r in both if r.doc_id < 0 and not r.rejected]
    assert sum(r.rejected for r in both if r.doc_id >= 0) <= 0.002 * len(both)


def test_language_without_calibration_rows_has_a_limit(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter(
        (F.col("lang") != "es") | (langid.fold_of("doc_id") != 3))
    planted = spark.createDataFrame([(-1, UNLEARNED["fi"], None)], known.schema)
    rows = langid.identify(known.unionByName(planted), ["doc_id", "lang"]).collect()
    assert all(r.rejected for r in rows if r.doc_id < 0)
    assert sum(r.rejected for r in rows if r.lang == "es") <= 0.02 * sum(r.lang == "es" for r in rows)


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            twice = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and twice % 10 == 0) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, hard, empty, docs):
    rng, signs = random.Random(4), [*"a.b@-_ 1 2 + ( ) 9 😀é\n", "a@b.co", "10.0.0.1", "4111 1111 1111 1111", "+49 (30) 1234567", "256.1.1.1"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(1_500)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "a@" + "b." * 5_000 + "c", "1 " * 30_000, "Dear Dr. Anna Müller", 'token = "' + "0af3" * 10 + '"']
    frame = spark.createDataFrame([(t,) for t in texts], "text string").unionByName(hard.select("text")).unionByName(docs.select("text"))
    rows = pii.personal_data(frame, ["text"]).collect()
    assert len(rows) == frame.count()
    for r in rows:
        base = plain_spans(r.text) if len(r.text or "") < 150_000 else []
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in base) for k in PII]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.spans.startswith(",".join(base))
    spans = {r.text: r.spans for r in rows}
    assert spans[texts[-1]].startswith("secret:9:") and spans[texts[-2]] == "name:5:20"
    assert pii.personal_data(empty, ["doc_id"]).count() == 0


def test_secrets_and_names_of_any_length(spark):
    long_name = "Maximilianalexandrovitschkaya" * 4
    found = {
        "token " + "0af3" * 60: "secret:6:246", "key " + "9B" * 80: "secret:4:164", "auth ghp_" + "aB3" * 40: "secret:5:129",
        "secret sk-proj-" + "a1_B-c" * 20 + "z9": "secret:7:137", "token github_pat_" + "11AB_cd" * 11: "secret:6:94",
        "key sk-" + "Ab1" * 40: "secret:4:127", f"Dear Dr. Anna {long_name}, hello": f"name:5:{14 + len(long_name)}",
    }
    clean = ["we use sk-learn-like-estimators-for-model-selection", "a-sk-" + "sk-" * 5_000, "0af3" * 7 + "-x", "x" + "0af3" * 20, "gh_" + "a" * 50]
    frame = spark.createDataFrame([(t,) for t in [*found, *clean]], "text string")
    got = {r.text: r.spans for r in pii.personal_data(frame, ["text"]).collect()}
    assert got == found | dict.fromkeys(clean, "")


def test_personal_data_of_a_very_long_text(spark):
    """40,000 addresses and 10,000 secrets in one text; contexts and starts across pieces, with signs of two UTF-16 units."""
    text = "".join(f"😀 write user{i}@mail{i}.example.org é " + (f"token {i:032x} " if i % 4 == 0 else "") for i in range(40_000))
    started = time.perf_counter()
    row = pii.personal_data(spark.createDataFrame([(text,)], "text string"), ["text"]).first()
    took = time.perf_counter() - started
    spans = [tuple(x.split(":")) for x in row.spans.split(",")]
    emails = [(m.start(), m.end()) for m in re.finditer(PII["email"], text)]
    assert [(int(a), int(b)) for k, a, b in spans if k == "email"] == emails and row.n_email == len(emails) == 40_000
    assert all(re.fullmatch("[0-9a-f]{32}", text[int(a):int(b)]) for k, a, b in spans if k == "secret")
    assert took < 60, took


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, cursor.fetchall())


def test_pipeline_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    rejected = {r.doc_id for r in langid.identify(docs, ["doc_id"]).collect() if r.rejected}
    left = sorted(set(texts) - rejected)
    prints = [plain_fingerprint(texts[d]) for d in left]
    group = union_find(len(left), [(i, j) for i in range(len(left)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    left = [d for i, d in enumerate(left) if group[i] == i]
    strings = {w for b in bench for w in decontaminate.windows((b.text or "").encode())}
    sizes = {len(w) for w in strings}

    def dirty(text):
        words = decontaminate.words_of(text.encode())
        return any(tuple(words[i:i + n]) in strings for n in sizes for i in range(len(words) - n + 1))

    left = [d for d in left if not dirty(texts[d])]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = sorted(corpus_pipeline.run(spark, FOLDER).collect(), key=lambda r: r.start)
    assert sorted(r.doc_id for r in rows) == left
    for r in rows:
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    kept = docs.filter(F.col("doc_id").isin(left))
    order = [r.doc_id for r in sorted(mixing.mix(kept).collect(), key=lambda r: r.mix_position)]
    assert [r.doc_id for r in rows] == order


def test_stages_take_hard_rows_and_none(spark, hard, empty):
    for frame in (hard, empty):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == frame.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
        assert out.count() == docs.count()
