"""Spelling variants, resampling and pieces against plain Python versions and the library."""

import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from episodium.llm import catalogue, pieces, radix_sort, resample, spelling
from tests.llm import brute_words as brute
from tests.oracle import compare, connect

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Names that the operators use inside, or return.
CLASHES = (
    "id n word near at prefix whole counts block place words numbers size sizes ids decoded doc weight score rank "
    "position digit by_score n_words n_features run form root"
).split()
PROSE = "the harbour wall was rebuilt after the winter storm and the boats came home before the first snow of the year"
TEXTS = [
    (1, PROSE), (2, PROSE.upper()), (3, None), (4, ""), (5, "  \n\t "), (6, (PROSE + " ") * 3000), (7, "a" * 300_000),
    (7, "a" * 300_000), (8, "a" * 300_001), (9, PROSE), (9, PROSE), (9, "harbour"), (None, PROSE), (None, None),
    (10, "İstanbul ÉTÉ × ÷ 漢字 😀 \x00 x"), (11, "harbou harbour harboor harbour"), (12, "$ harbour$ ▁▁ a▁b   c "),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return frame.withColumns({c: F.lit(f"extra {c}") for c in CLASHES}).repartition(3)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_target_resampling"])
def test_query_equals_sql(spark, folder, name):
    run, sql = catalogue.QUERIES[name], catalogue.ORACLES[name]
    problem, rows, _, _ = compare(spark, connect(folder), folder, run, sql)
    assert problem is None and rows > 0


def test_variants_equal_all_pairs(spark):
    draw, words = random.Random(1), {}
    for length in (2, 3, 5, 63, 64, 65, 66, 130):
        for _ in range(12):
            base = "".join(draw.choice("abé") for _ in range(length))
            words[base] = draw.choice([5, 6, 30, 200, 1000, 5000])
            for _ in range(4):
                i = draw.randrange(length)
                other = draw.choice([base[:i] + base[i + 1 :], base[:i] + "a" + base[i:], base[:i] + "c" + base[i + 1 :]])
                words[other] = draw.choice([5, 6, 30, 200, 1000, 5000])
    rows = spark.createDataFrame([*words.items(), (None, 3)], "word string, n long")
    got = {r["word"]: tuple(r)[1:] for r in spelling.group_variants(rows).collect()}
    assert got == brute.variants(words)


def test_spelling_edge_cases(spark, docs):
    frame = docs.unionByName(docs).unionByName(docs).unionByName(docs).unionByName(docs)
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(frame).collect()}
    counts = brute.word_counts([t for t in TEXTS for _ in range(5)])
    assert {w: v[2] for w, v in got.items()} == counts
    assert got["a" * 300_000][:2] == (None, "a" * 300_000) and got["a" * 300_001][3] == 1
    assert got["harbou"][:2] == ("harbour", "harbour") and got["harbou"][4] == counts["harbour"]
    short = {w: n for w, n in counts.items() if len(w) < 100}
    assert {w: v for w, v in got.items() if w in short} == brute.variants(short)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_damage_is_that_of_the_rule(spark):
    texts = [(i, f"wordnumber{'abcdefgh'[i % 8]} éàçwordÜ") for i in range(3000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    runs = spelling.letter_runs(frame).select(spelling.damaged(F.col("doc_id"), F.col("run")).alias("word"))
    got = {r["word"]: r["n"] for r in spelling.frequent_words(runs, 1, 1).collect()}
    want = {}
    for i, text in texts:
        for run in text.split():
            h = crc32(f"{i}:{run}".encode())
            run = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] = want.get(run, 0) + 1
    assert got == want and len(got) > 10


def test_feature_buckets():
    texts = [None, "", "One two, THREE-four é", "x" * 70_000 + " y", "a b"]
    rows = {}
    for first, _, counts, (at, buckets) in resample.feature_buckets(texts):
        for i, n in enumerate(counts):
            rows[first + i] = (n, sorted(buckets[at == i].tolist()))
    assert rows == {i: (n, sorted(b)) for i, (n, b) in enumerate(map(brute.feature_buckets, texts))}


def test_resampling_edge_cases(spark, docs):
    items = spark.createDataFrame([(1, PROSE), (2, None), (3, "")], "item_id long, text string")
    got = {}
    for r in resample.resample(docs, items, percent=40).select("doc_id", "n_features", "weight", "score", "rank").collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    want = brute.resampled(TEXTS, [PROSE, None, ""])
    assert sum(map(len, got.values())) == len(TEXTS)
    assert {k: v[0][:3] for k, v in got.items() if len(v) == 1} == {k: want[k][:3] for k, v in got.items() if len(v) == 1}
    ranks = sorted(r[3] for v in got.values() for r in v if r[3] is not None)
    assert ranks == [1, 2]  # 40 % of the 6 rows with 20 words
    none = resample.resample(docs, items.limit(0)).filter("rank IS NOT NULL")
    assert none.count() == 0 and resample.resample(docs.limit(0), items).count() == 0


def test_resampling_equals_plain_python(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    got = {r["doc_id"]: tuple(r)[1:] for r in resample.resample(docs, items).collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got == brute.resampled(texts, [r["text"] for r in items.collect()])


def test_radix_ranks(spark, monkeypatch):
    monkeypatch.setattr(radix_sort, "BLOCK_ROWS", 64)
    draw = random.Random(2)
    top = (1 << 63) - 1
    rows = [(draw.choice([draw.randrange(-9, 9), draw.randrange(-top, top), top, -top - 1]), k) for k in range(1000)]
    frame = spark.createDataFrame(rows, "a long, b long").repartition(7)
    keys = [("x", radix_sort.descending(F.col("a"))), ("y", radix_sort.ascending(F.col("b")))]
    got = sorted((r["rank"], r["a"], r["b"]) for r in radix_sort.radix_ranks(frame, keys).collect())
    assert got == [(i + 1, a, b) for i, (a, b) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))]
    same = spark.createDataFrame([(1, 1)] * 5, "a long, b long")
    assert sorted(r["rank"] for r in radix_sort.radix_ranks(same, keys).collect()) == [1, 2, 3, 4, 5]
    assert radix_sort.radix_ranks(frame.limit(0), keys).count() == 0


def test_pieces_equal_the_library(spark, docs):
    processor = pieces.model(PIECES).processor
    want = {}
    for doc, text in TEXTS:
        ids = processor.encode(text or "")
        want.setdefault(doc, []).append((ids, processor.decode(ids) if ids else ""))
    got = {}
    encoded = pieces.encode(docs, PIECES)
    for r in pieces.decode(encoded, PIECES).collect():
        got.setdefault(r["doc_id"], []).append((r["ids"], r["decoded"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert pieces.encode(docs.limit(0), PIECES).count() == 0
    extra = pieces.decode(encoded.withColumn("decoded", F.lit(1)), PIECES)
    assert extra.columns == ["doc_id", "ids", "decoded", "_decoded"]


def test_words_are_cut_where_no_piece_reaches():
    cut, draw = pieces.model(PIECES), random.Random(3)
    letters = "abeé ▁  \n\t.,01<>xÀß漢字😀\x00\x7fthe and ing"
    for size in (1, 5, 20, 300, 2000):
        for _ in range(200):
            text = "".join(draw.choice(letters) for _ in range(size))
            found, counts = cut.parts(cut.words(text))
            assert "".join(found).replace(pieces.MARK, " ") == " " + text.replace(pieces.MARK, " ")
            assert sum(counts) == len(found) and len(counts) == len(cut.words(text))
            assert [i for ids in cut.segment(found) for i in ids] == cut.processor.encode(text)
    long_word = "".join(draw.choice("0123456789abcdef") for _ in range(100_000))
    assert max(map(len, cut.parts(cut.words(long_word))[0])) < 1000


def test_pieces_in_many_blocks(spark):
    """Blocks of a few words, and words that many blocks share."""
    docs = [(i, f"the cat number {i % 7} sat  on the mat {i}") for i in range(500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["ids"] for r in pieces.encode(frame, PIECES, block_chars=100).collect()}
    processor = pieces.model(PIECES).processor
    assert found == {i: processor.encode(t) for i, t in docs}


def test_changed_order_is_noticed():
    words = ["▁a", "▁b"]
    assert pieces.checksum(words, np.arange(2)) != pieces.checksum(words[::-1], np.arange(2))
