"""Spelling variants, pieces with places and resampling, held against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as format_

import corpus_pipeline
from hearthline.llm import pieces, queries, resampling, simhash, spelling

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, n int, ids string, word string, rank int, score int, tag int"
LONG = "the of and thing erre onst " * 30_000
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def hard(spark):
    texts = [None, "", " \n\t ", "one two", "words wordy sword word words wordy words", LONG, LONG + " x", "x" * 100_000 + " " + "y" * 3_000,
             "Élève élève ÉLÈVE naïve naive naïve naive 你好 😀 \x00 done", "l1\nl1\n\nl2 \nl1", "a▁b ▁▁ c   d  ", "aaaaa aaaaaa aaaaaaa " * 5]
    rows = [(i, t, ["en", None][i % 2], None, None, 1, 2, "i", "w", 3, 4, 5) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "words wordy", *rows[0][2:]), (None, None, *[None] * 10), rows[7], rows[7]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def plain_words(rows, every):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain_variants(n):
    gaps = defaultdict(set)
    for w in n:
        for i in range(len(w)) if len(w) < 1_000 else ():
            gaps[w[:i], w[i + 1:]].add(w)
    near = defaultdict(set)
    for (a, b), group in gaps.items():
        group = group | ({a + b} if a + b in n else set())
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("which", ["hard", "docs"])
@pytest.mark.parametrize("every", [97, 2, None])
def test_variants(which, every, request):
    frame = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    n = plain_words(rows, every)
    got = spelling.variants(spelling.vocabulary(frame, every=every)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_variants(n)))


def test_variants_of_the_query(spark, docs):
    n = plain_words([(r.doc_id, r.text) for r in docs.collect()], 97)
    got = queries.op11_spelling(spark, FOLDER)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_variants(n)))


def test_neighbours_of_dense_and_long_words(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(900)}
    words |= {"a" * k for k in range(1, 70)} | {"ab" * 40 + x + "ba" * 40 for x in ("", "a", "b", "c", "ab", "aab")}
    words |= {"x" * 20_000, "x" * 9_000 + "y" + "x" * 10_999, "x" * 19_999}
    listed = sorted(words)
    got = spelling.neighbours(spark.createDataFrame(list(enumerate(listed)), "id long, word string").repartition(3)).collect()
    pairs = [tuple(sorted((r.a, r.b))) for r in got]
    assert len(pairs) == len(set(pairs))
    known, want = {w: i for i, w in enumerate(listed)}, set()
    for w in listed:
        spots = range(len(w)) if len(w) < 1_000 else (0, 9_000)
        for i in spots:
            for v in [w[:i] + w[i + 1:]] + [w[:i] + c + w[i + 1:] for c in "abcéxy"]:
                if v in known and v != w:
                    want.add(tuple(sorted((known[w], known[v]))))
    assert set(pairs) == want


def test_variants_of_nothing(spark, empty):
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0
    chain = spark.createDataFrame([(i, i + 1 if i < 9 else None) for i in range(10)], "id long, form long")
    assert {r.root for r in spelling.last_forms(chain).collect()} == {9}


def checked(got, texts, library):
    """Rows of encode() against the library's own ids, spans and decoded texts."""
    for r in got:
        data = (texts[r.key] or "").encode()
        found = library.encode_as_proto(texts[r.key] or "").pieces
        assert r.ids == [p.id for p in found] + [library.eos_id()]
        assert r.decoded == library.decode(r.ids)
        assert (r.starts[:-1], r.ends[:-1]) == ([p.begin for p in found], [p.end for p in found])
        assert r.starts[-1] == r.ends[-1] == len(data)


@pytest.mark.parametrize("which", ["hard", "docs"])
def test_pieces_equal_the_library(which, request, spark):
    frame = request.getfixturevalue(which)
    rows = [(i, r.text) for i, r in enumerate(frame.select("text").collect())]
    texts = dict(rows)
    got = pieces.encode(spark.createDataFrame(rows, "key long, text string").repartition(3), MODEL, ["key"]).collect()
    assert len(got) == len(rows)
    checked(got, texts, sentencepiece.SentencePieceProcessor(model_file=MODEL))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_compiled_maps_equal_the_library(rule, tmp_path):
    model = format_.ModelProto.FromString(open(MODEL, "rb").read())
    source = format_.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.CopyFrom(source.normalizer_spec)
    rng = random.Random(2)
    signs = "aB é́é ﬁ①Ⅷ㌔ｶﾞ　\t\n  ​한각가½ǆ▁ßİ你\u0085­😀�𝔘ſ"
    texts = ["", " ", "   ", "  a  b  ", "é", "ｶﾞ"] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    for squeeze in (True, False):
        model.normalizer_spec.remove_extra_whitespaces = squeeze
        path = tmp_path / f"{rule}{squeeze}.model"
        path.write_bytes(model.SerializeToString())
        library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.PieceEncoder(str(path))
        for text in texts:
            found = library.encode_as_proto(text).pieces
            ids, meet = own.encode(text.encode())
            assert ids.tolist() == [p.id for p in found], text
            assert [(int(a), int(b)) for a, b in zip(meet, meet[1:])] == [(p.begin, p.end) for p in found], text


def test_unreadable_bytes_keep_their_places():
    data, places = pieces.readable(b"a\xff\xe2\x82b")
    assert data == "a���b".encode() and places.tolist() == [0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 5]


def test_pieces_without_rows_and_decoding_alone(spark, empty):
    assert pieces.encode(empty, MODEL, ["doc_id", "n"]).count() == 0
    rows = pieces.encode(spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string"), MODEL, ["doc_id"])
    back = pieces.decode(rows.drop("decoded"), MODEL, ["doc_id"])
    assert {r.doc_id: r.decoded for r in back.collect()} == {1: "two words", 2: ""}


def test_pieces_query(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text or "") + [library.eos_id()]
        ends = [p.end for p in library.encode_as_proto(r.text or "").pieces] + [len((r.text or "").encode())]
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(library.decode(ids).encode()).hexdigest(), zlib.crc32(" ".join(map(str, ends)).encode()))
    got = queries.op12_pieces(spark, FOLDER).collect()
    assert len(got) == len(want) and {r.doc_id: tuple(r)[1:] for r in got} == want


def plain_resample(rows, target, least=20, buckets=10_000, run=1):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
        return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % buckets for k in range(1, run + 1) for i in range(len(words) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out = []
    for doc, x in rows:
        n, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[:10 * len(able) // 100], 1):
        r[5] = place
    return out


@pytest.mark.parametrize("run", [1, 2])
@pytest.mark.parametrize("which", ["hard", "docs"])
def test_resample(which, run, request, spark):
    frame = request.getfixturevalue(which)
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    want = plain_resample(rows, [r.text for r in bench.collect()], least=2 if which == "hard" else 20, run=run)
    got = resampling.resample(frame, bench, least_words=2 if which == "hard" else 20, run=run).collect()
    assert sorted(map(repr, map(list, got))) == sorted(map(repr, want))


def test_resample_query(spark, docs):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    got = queries.op13_resampling(spark, FOLDER)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(repr, map(list, got.collect()))) == sorted(repr([r[0], *r[2:]]) for r in want)


def test_resample_nothing(spark, empty, docs):
    assert resampling.resample(empty, empty).count() == 0
    rows = resampling.resample(docs, docs.limit(0)).collect()
    assert len(rows) == docs.count() and max(r.rank or 0 for r in rows) == 10 * sum(r.n_words >= 20 for r in rows) // 100


@pytest.mark.parametrize("accuracy", [10_000, 4, 1])
def test_brackets_hold_the_place_whatever_the_sketch(spark, accuracy):
    rng = random.Random(1)
    values = [rng.choice([5, 5, 5, 9, rng.randint(-10**6, 10**6)]) for _ in range(3_000)]
    frame = spark.createDataFrame([(v, i % 700 or None, i) for i, v in enumerate(values)], "score long, key long, tag long").repartition(4).cache()
    for k in (1, 2, 299, 1_500, 2_999, 3_000):
        low, high, above = resampling.bracket(frame, k, len(values), accuracy)
        assert low <= sorted(values, reverse=True)[k - 1] <= high and above == sum(v > high for v in values)
    want = sorted(((v, i % 700 or None, i) for i, v in enumerate(values)), key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))[:900]
    got = sorted((r for r in resampling.draw(frame, 900, 3_000, "key", accuracy).collect() if r.rank), key=lambda r: r.rank)
    assert [tuple(r)[:3] for r in got] == want and [r.rank for r in got] == list(range(1, 901))


def test_near_copies_leave_unlike_rows_of_null_and_equal_ids(spark):
    same = "one two three four five six seven eight"
    rows = [(None, "alpha beta gamma delta epsilon zeta"), (None, "completely other words stand here now"), (None, "third unlike text of the table"),
            (None, same), (7, same), (7, "quite another text with this very id"), (7, "quite another text with this very id"), (9, same.upper())]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [*rows[:3], (7, same), (7, "quite another text with this very id")]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_mix_stage_keeps_columns_of_its_own_names(spark, tmp_path):
    rows = [(i, f"text {i}", "s" if i % 3 else None, i * 10, f"p{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_slot long, MIX_position string")
    out = corpus_pipeline.mixed(spark, docs, FOLDER)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows
    plain = corpus_pipeline.mixed(spark, docs.drop("mix_slot", "MIX_position"), FOLDER)
    assert [r.doc_id for r in out.collect()] == [r.doc_id for r in plain.collect()]


def test_files_are_taken_by_their_number(spark, tmp_path):
    for number, ids in ((99_999, [1, 2]), (100_000, [3, 4]), (2, [0])):
        made = tmp_path / f"one-{number}"
        spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").coalesce(1).write.parquet(str(made))
        target = tmp_path / "all"
        target.mkdir(exist_ok=True)
        (target / f"part-{number:05d}-x.parquet").write_bytes(next(made.glob("part-*.parquet")).read_bytes())
    rows = corpus_pipeline.token_output(spark, spark.read.parquet(str(tmp_path / "all")), FOLDER).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [0, 1, 2, 3, 4]


def test_joins_of_words_are_not_broadcast(spark, monkeypatch):
    """What Python makes of a word is larger than Spark takes it for: no join may collect a side because it looks small."""
    plans, saved = [], spelling.saved
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(spelling, "saved", lambda df, name: seen(df) or saved(df, name))
    words = spark.createDataFrame([("plate", 9), ("plated", 4), ("slated", 1), ("glass", 2)], "word string, n long")
    found = spelling.variants(words)
    seen(found)
    assert {r.word: r.root for r in found.collect()} == {"plate": "plate", "plated": "plate", "slated": "plate", "glass": "glass"}
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)
