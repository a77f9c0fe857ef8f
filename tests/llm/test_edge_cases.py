"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from episodium.llm import (
    decontaminate,
    exact_dedup,
    jaccard_join,
    licenses,
    line_dedup,
    packing,
    pii,
    quality,
    retrieval_packing,
    tokens,
    url_filter,
)
from tests.llm import brute

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Names that the operators use inside, or return.
CLASHES = (
    "key hit _hit _row _key point region label n id copy word bits shingle keep _keep kept n_lines "
    "_quality _toxic _e_quality _host _path canonical found rule line pos n_dropped kept_text _lost "
    "_rate_n_host _rate_n_path _rate_s_host__quality quality toxic"
).split()
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8000
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
TEXTS = [
    (1, BASE),
    (2, BASE.upper()),
    (3, BASE + " seventeen"),
    (4, None),
    (5, ""),
    (6, "  \n\t "),
    (7, LONG),
    (8, LONG + "omega"),
    (9, "short"),
    (9, "short"),
    (None, "short"),
    (10, "Short"),
    (None, None),
    (11, "İstanbul ÉTÉ\n" + BASE),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else None, "src0" if k % 3 else None, 0) for k, (i, t) in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_exact_dedup(docs, empty):
    rows = exact_dedup.duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text_sha256"], []).append(r)
    folded = {}
    for i, t in TEXTS:
        folded.setdefault((t or "").translate(brute.FOLD), []).append(i)
    assert sorted(len(v) for v in by_text.values()) == sorted(len(v) for v in folded.values())
    for group in by_text.values():
        best = max((r["doc_id"] for r in group if r["doc_id"] is not None), default=None)
        assert {(r["keep_id"], r["group_size"]) for r in group} == {(best, len(group))}
        assert sum(r["kept"] for r in group) == 1
        assert [r["doc_id"] for r in group if r["kept"]] == [best]
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(folded)
    assert exact_dedup.duplicates(empty).count() == 0
    assert exact_dedup.drop_duplicates(empty).columns == docs.columns


def test_line_dedup(docs, empty):
    whole = line_dedup.drop_lines(docs)
    assert whole.columns == [*docs.columns, "_n_lines", "_n_dropped", "_kept_text"]
    rows = whole.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                        F.col("_kept_text").alias("kept_text")).collect()
    assert len(rows) == len(TEXTS)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert (by_id[1]["n_dropped"], by_id[2]["n_dropped"], by_id[2]["kept_text"]) == (0, 1, "")
    assert (by_id[4]["n_lines"], by_id[4]["kept_text"]) == (1, "")
    assert (by_id[11]["n_lines"], by_id[11]["n_dropped"], by_id[11]["kept_text"]) == (2, 1, "İstanbul ÉTÉ")
    assert all(r["n_dropped"] == 0 for r in rows if r["text"] in ("short", "Short"))
    assert line_dedup.drop_lines(empty).count() == 0


def test_many_lines_and_a_hot_line(spark):
    """A line that most documents hold, and drops beyond the first 64 lines."""
    texts = {i: "\n".join([f"line {i} number {j} here" for j in range(150)] + ["the hot line of all"] * 3) for i in range(40)}
    texts[40] = "\n".join(["a"] * 200 + ["line 3 number 149 here", "tail"])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in line_dedup.drop_lines(frame).collect()}
    assert rows[0]["kept_text"] == texts[0]
    assert rows[7]["kept_text"] == "\n".join(texts[7].split("\n")[:150]) and rows[7]["n_dropped"] == 3
    assert rows[40]["kept_text"] == "\n".join(["a"] * 200 + ["tail"])


def test_jaccard_join(docs, empty):
    rows = jaccard_join.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    texts = {i: t for i, t in TEXTS if i is not None}
    want = brute.components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert got == want
    nameless = {(r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is None}
    assert nameless == {(1, 9), (0, None)}
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_join_of_shared_passages(spark):
    """Passages that more documents share than the bound on common shingles, against all pairs."""
    draw = random.Random(5)
    passages = [" ".join(f"p{draw.randrange(5000)}" for _ in range(60)) for _ in range(6)]
    texts = {}
    for i in range(200):
        tail = [f"z{draw.randrange(10**6)}" for _ in range(draw.choice([3, 10, 20, 60]))]
        texts[i] = " ".join([draw.choice(passages), draw.choice(passages), *tail])
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    found = {r[0]: (r[1], r[2]) for r in jaccard_join.near_duplicates(rows).collect()}
    assert found == brute.components(texts)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (3, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int"
    )
    for given in (labels, labels.limit(0)):
        rows = quality.judge(docs, given).collect()
        assert len(rows) == len(TEXTS)
        assert all(0 <= r["quality"] <= 1 and 0 <= r["toxic"] <= 1 for r in rows)
        assert all(r["keep"] == (r["quality"] >= 0.5 and r["toxic"] <= 0.5) for r in rows)
    assert all(r["keep"] for r in quality.judge(docs, labels.limit(0)).collect())
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.judge(empty, labels).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame(
        [(1, BASE), (2, None), (3, ""), (4, "short"), (None, BASE), (5, "kappa alpha beta gamma delta epsilon zeta")],
        "item_id long, text string",
    )
    rows = decontaminate.contaminated(docs, items).collect()
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in rows if r["doc_id"] is not None}
    texts = {i: t for i, t in TEXTS if i is not None and len(t or "") < 1000}
    wanted = brute.passages(texts, {1: BASE, 4: "short", 5: "kappa alpha beta gamma delta epsilon zeta"})
    assert {k: v for k, v in got.items() if k[0] in texts} == {k: (round(v, 6), s) for k, (v, s) in wanted.items()}
    assert got[7, 5] == (1.0, 9) and got[8, 5] == (1.0, 9)
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {4, 5, 6, None}
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(TEXTS)
    assert decontaminate.contaminated(empty, items).count() == 0


def test_packing(docs, empty):
    want = {}
    for i, t in TEXTS:
        want.setdefault(i, []).append(tokens.encode([t], TOKENIZER, 1)[0].tolist())
    rows = packing.pack(docs, TOKENIZER).collect()
    got = {}
    for r in rows:
        ids = np.frombuffer(r["token_ids"], "<u4")
        assert len(ids) == packing.WINDOW and not ids[r["n_tokens"] :].any()
        assert r["cu_seqlens"][:-1] == r["position_resets"] and r["cu_seqlens"][-1] == r["n_tokens"]
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["starts"])):
            piece = ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].tolist()
            got.setdefault(doc, []).append((start, piece))
    assert got.keys() == want.keys()
    for doc, pieces in got.items():
        joined = sum((p for _, p in sorted(pieces)), [])
        assert sorted(joined) == sorted(sum(want[doc], []))
        if len(want[doc]) == 1:
            assert joined == want[doc][0]
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_retrieval_packing(docs, empty):
    rows = retrieval_packing.pack_by_retrieval(docs, TOKENIZER).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in TEXTS:
        ids = tokens.encode([t], TOKENIZER, 1)[0]
        pieces = sorted((r for r in by_doc[i] if r["doc_tokens"] == len(ids)), key=lambda r: r["start"])
        spans = {(r["start"], r["length"], r["ids_crc32"]) for r in pieces}
        assert {(s, n, zlib.crc32(ids[s : s + n].astype("<u4").tobytes())) for s, n, _ in spans} >= spans
        repeats = sum(1 for j, u in TEXTS if j == i and len(tokens.encode([u], TOKENIZER, 1)[0]) == len(ids))
        assert sum(r["length"] for r in pieces) == repeats * len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= retrieval_packing.WINDOW
    assert retrieval_packing.pack_by_retrieval(empty, TOKENIZER).count() == 0


def test_best_fit_decreasing():
    bins = packing.best_fit_decreasing([5, 8, 3, 2, 10, 1, 7], 10)
    assert sorted(i for b in bins for i in b) == list(range(7))
    assert [4] in bins and sorted(map(sorted, bins)) == [[0, 5], [1, 3], [2, 6], [4]]


def test_licences(docs, empty, spark):
    text = "Notes.\nReleased under the MIT License.\nLICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.!!"
    rows = licenses.recognise(spark.createDataFrame([(1, text), (2, "the mit license is fine")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in rows.collect()}
    assert (got[1]["sentence_ids"], got[1]["licences"], got[1]["unmatched"]) == ("MIT_REF APACHE2_REF", "Apache-2.0 MIT", 0)
    assert got[2]["licences"] == ""
    full = "\n".join(s for s, i in licenses.SENTENCES.items() if i in ("MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS"))
    out = spark.createDataFrame([(3, "unknown words.\n" + full)], "doc_id long, text string")
    assert licenses.recognise(out).first()["licences"] == "MIT"
    rows = licenses.recognise(docs).collect()
    assert len(rows) == len(TEXTS) and all(r["licences"] == "" for r in rows)
    assert all(r["n_sentences"] == 0 for r in rows if r["doc_id"] in (4, 5, 6))
    assert licenses.recognise(docs, known={}, rules=[]).count() == len(TEXTS)
    assert licenses.recognise(empty).count() == 0


def test_url_filter(spark):
    urls = [
        (1, "http://WWW.Bad.com/x.html?q=1"), (2, "https://m.bad.com/x/"), (3, "bad.com/x"), (4, None), (5, ""),
        (6, "https://a.example.org/es/1"), (7, "https://example.org/en/12#t"), (8, "https://notexample.org/es/"),
        (9, "https://org/"), (None, "http://ok.com"), (1, "http://WWW.Bad.com/x.html?q=1"), (10, "x://h?://z/p"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit(1) for c in CLASHES})
    listed = spark.createDataFrame([("bad.com/x",), ("bad.com/x",), (None,)], "url string")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1")]
    rows = url_filter.judge(pages, listed, rules).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert len(rows) == len(urls)
    assert got[1] == ("www.bad.com", "/x.html", None, "block") and got[2][3] == "block"
    assert got[3] == got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[7] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[8] == ("notexample.org", "/es/", "org/", "allow") and got[9][2] == "org/"
    assert got[10] == ("h", "", None, "allow") and got[None][3] == "allow"
    assert url_filter.judge(pages, listed.limit(0), []).filter("verdict = 'block'").count() == 0
    assert url_filter.judge(pages.limit(0), listed, rules).count() == 0


def test_pseudonyms(spark, docs, empty):
    values = {
        "card": "4111111111111111", "card2": "4012-8888-8888-1881", "bad card": "4111111111111112", "ip": "10.20.30.40",
        "bad ip": "300.1.1.1", "date": "2024-02-29", "bad date": "2023-02-29", "dot": "31.12.1999", "slash": "12/31/1999",
        "phone": "+1 (555) 123-4567", "mail": "Jo.éve.7@mail.example.com", "token": "0123456789abcdef0123456789abcdef01234567",
    }
    text = " ; ".join(f"{v}" for v in values.values())
    frame = spark.createDataFrame([(1, text), (2, "x " + text + "\n"), (3, "nothing 12 here")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(frame, "key").collect()}
    new = dict(zip(values, got[1]["text"].split(" ; ")))
    assert got[2]["text"] == "x " + got[1]["text"] + "\n" and got[3]["text"] == "nothing 12 here"
    for name, value in values.items():
        assert (new[name] == value) == name.startswith("bad"), name
        assert len(new[name]) == len(value) or name == "ip"
        shape = [c if not c.isalnum() else "0" for c in value]
        assert name == "ip" or [c if not c.isalnum() else "0" for c in new[name]] == shape
    assert brute.card_is_valid(new["card"]) and brute.card_is_valid(new["card2"].replace("-", ""))
    assert new["mail"].endswith("@mail.example.com") and new["phone"].startswith("+1 (")
    assert all(int(x) <= 255 for x in new["ip"].split("."))
    assert got[1]["n_replaced"] == 9
    other = {r["doc_id"]: r for r in pii.pseudonymise(frame, "other key").collect()}
    assert other[1]["text"] != got[1]["text"]
    rows = pii.pseudonymise(docs, "key").collect()
    assert [r["text"] for r in rows if r["doc_id"] == 4] == [None] and not any(r["n_replaced"] for r in rows)
    assert pii.pseudonymise(empty, "key").count() == 0


def test_judgement_equals_plain_posteriors(spark):
    """The hierarchy over all documents, recomputed in plain Python from the same evidence."""
    draw = random.Random(6)
    texts = {i: " ".join(draw.choice(["good", "fine", "bad", "vile", "the", "of", f"w{i}"]) for _ in range(draw.choice([0, 3, 30]))) for i in range(400)}
    sites = {i: (draw.choice(["a", "a", "a", "b", "c", None, f"s{i % 50}"]), draw.choice(["x", "y", None])) for i in texts}
    docs = spark.createDataFrame([(i, t, *sites[i]) for i, t in texts.items()], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame(
        [(i, int("good" in t), int("vile" in t)) for i, t in texts.items() if i % 2], "doc_id long, quality int, toxic int"
    )
    evidence = quality.train(docs, labels).evidence(list(texts.values()))
    assert np.abs(evidence).max() > 1
    want = brute.posteriors([(*sites[i], *e) for i, e in zip(texts, evidence.tolist())])
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    for i, (good, bad) in zip(texts, want):
        assert (got[i]["quality"], got[i]["toxic"]) == pytest.approx((good, bad), abs=2e-6)
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r["keep"]} and 0 < len(kept) < len(texts)


def test_pseudonyms_of_endless_runs(spark):
    """Runs of a million characters or labels are walked once, and without recursion."""
    n = 1_000_000
    texts = [
        "x@" + "a." * (n // 2), "a" * n, "x@" + "b" * n, "1" * n, "a." * (n // 2) + "@x.org", "f" * n, "x@y." * (n // 4),
        "-" * n + "@", "+1 " * (n // 3), "joe@" + "label." * 3000 + "org, and ..joe@a.org.",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.monotonic()
    got = {r["doc_id"]: r for r in pii.pseudonymise(frame, "k").collect()}
    assert time.monotonic() - start < 60
    assert all(len(got[i]["text"]) == len(t) for i, t in enumerate(texts))
    assert [got[i]["text"] == t for i, t in enumerate(texts[:4])] == [True] * 4
    new = got[9]["text"]
    joe = brute.feistel_string("joe", "k", "email", [pii.DIGITS, pii.LOWER, pii.UPPER, pii.LATIN_LOWER, pii.LATIN_UPPER])
    assert new == f"{joe}@" + "label." * 3000 + f"org, and ..{joe}@a.org."


def test_permutations_equal_plain_ones(spark):
    draw = random.Random(8)
    letters = pii.DIGITS + pii.LOWER + pii.UPPER + "àé-._"
    values = ["".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 7, 20, 70]))) for _ in range(60)]
    classes = [pii.DIGITS, pii.LOWER, pii.UPPER, pii.LATIN_LOWER]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = frame.select("v", pii.feistel_string(F.col("v"), "k", "t", classes).alias("x")).collect()
    assert all(r["x"] == brute.feistel_string(r["v"], "k", "t", classes) for r in got)
    numbers = spark.range(300).select("id", pii.feistel_number(F.col("id"), "k", "t", 20, 15).alias("x")).collect()
    assert all(r["x"] == brute.feistel_number(r["id"], "k", "t", 20, 15) for r in numbers)


def test_permutations_are_bijections(spark):
    frame = spark.range(1000)
    digits = frame.select(pii.feistel_string(F.lpad("id", 3, "0"), "k", "t", [pii.DIGITS]).alias("x"))
    assert digits.distinct().count() == 1000
    numbers = frame.filter("id < 21 * 37").select(pii.feistel_number(F.col("id"), "k", "t", 21, 37).alias("x"))
    assert sorted(r["x"] for r in numbers.collect()) == list(range(21 * 37))


def test_sketches_differ_in_no_more_bits_than_sets():
    draw = np.random.default_rng(7)
    for size, other in [(1, 1), (4, 400), (90, 10), (700, 120), (3000, 2)]:
        one = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
        two = np.union1d(one[: len(one) * 9 // 10], draw.integers(0, 1 << 63, other).astype(np.uint64))
        bits = sum(int(x).bit_count() for x in (jaccard_join.sketch(one) ^ jaccard_join.sketch(two)).view(np.uint64))
        assert bits <= len(np.setxor1d(one, two))
        assert not (jaccard_join.sketch(one) ^ jaccard_join.sketch(one[::-1])).any()


def test_regions_with_the_same_points_are_one(spark):
    """The first of them in the global order stays, here by the least places."""
    rows = [(r, p, 9, i) for i, r in enumerate((3, 1, 2)) for p in (10, 20)] + [(4, p, 9, 5) for p in (10, 30)] + [(5, 10, 9, 6)]
    found = jaccard_join.merged(spark.createDataFrame(rows, "region long, point long, n long, pos long"))
    assert sorted(map(tuple, found.select("region", "point", "pos", "weight").collect())) == [
        (3, 10, 0, 3), (3, 20, 0, 3), (4, 10, 5, 1), (4, 30, 5, 1)
    ]
