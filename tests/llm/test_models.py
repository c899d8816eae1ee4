"""Filter audit, vector codes and quality classifier against brute force, and their edge cases."""

import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import audit, classifier, codes, scanning

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, mask int, digest string, x string, fold int, part string, n long"
ODD = [None, "", " \n\t ", "one", "x" * 300_000, "word " * 60_000, "A B C D " * 60, "é ü ☃ \U0001f600 " * 80, "a#b", "same text", "same text"]
LABELS = "doc_id long, quality int, toxic int"


def odd(spark):
    rows = [(k, t, ["en", None, ""][k % 3], None, None, 9, "x", "y", 3, "z", 5) for k, t in enumerate(ODD)]
    rows += [rows[3], rows[3], (None, "same text", "en", *[None] * 8), (None, "no id", None, *[None] * 8)]
    return spark.createDataFrame(rows, DOCS)


def texts(n: int, seed: int = 1) -> list:
    rng = random.Random(seed)
    alphabet = [*"aAbB #$%&*|\n\t\x0b é☃", "word", "\U0001f600", "x" * 300]
    return [None, "", " ", "x" * 1000 + " " + "x" * 1000 + " " + "x" * 999 + "y", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n))]


@pytest.mark.parametrize("slice_bytes,chunk", [(4 << 20, 1 << 18), (64, 7), (1, 3)])
def test_scans_count_words_classes_and_distinct_words(monkeypatch, slice_bytes, chunk):
    monkeypatch.setattr(scanning, "SLICE", slice_bytes)
    monkeypatch.setattr(scanning, "CHUNK", chunk)
    for column in (pa.array(texts(300)), pa.array(texts(300)).slice(3, 100)):
        got = []
        for s in scanning.scans(column, {"capitals": bytes(range(65, 91)), "symbols": b"#$%&*|"}):
            got += zip(s.n_words.tolist(), s.distinct().tolist(), *(s.counts[c].tolist() for c in ("chars", "capitals", "symbols")), strict=True)
        want = []
        for t in column.to_pylist():
            words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            want.append((len(words), len(set(words)), len(t or ""), sum("A" <= c <= "Z" for c in t or ""), sum(c in "#$%&*|" for c in t or "")))
        assert got == want


def test_words_of_one_hash_are_told_apart():
    column = pa.array(texts(200, 2))
    for s in scanning.scans(column, {}):
        same = np.full(len(s.start), 5 << 20, np.uint64)
        assert s.distinct(same).tolist() == [len(set(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for t in column.to_pylist()]


def failures(rows: list) -> list[set]:
    first: dict = {}
    for r in rows:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            first[t] = min(first.get(t, r["doc_id"]), r["doc_id"])
    out = []
    for r in rows:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = r["doc_id"] is not None and first[t] < r["doc_id"]
        out.append({k for k, v in fails.items() if v})
    return out


def test_audit_of_odd_rows_equals_brute_force(spark):
    docs = odd(spark)
    labels = [(1, 1, 0), (1, 0, None), (3, 1, 1), (10, 1, 1), (None, 1, 1), (99, 1, 1), (6, None, 1)]
    cells = audit.labelled_masks(docs, spark.createDataFrame(labels, LABELS))
    got = {(r["part"], r["filter_order"], r["step"]): r for r in audit.audited(cells).collect()}
    rows = docs.collect()
    fails, parts = failures(rows), sorted({r["lang"] or "" for r in rows})
    assert len(got) == 600 * len(parts)
    good, toxic = {1, 3, 10}, {3, 10, 6}
    shapley: dict = {}
    for part in parts:
        for order in map("".join, permutations("ABCDE")):
            left = [k for k, r in enumerate(rows) if (r["lang"] or "") == part]
            for step, own in enumerate(order, 1):
                gone = [k for k in left if own in fails[k]]
                left = [k for k in left if own not in fails[k]]
                shapley[part, own] = shapley.get((part, own), 0) + len(gone)
                mine = [k for k, r in enumerate(rows) if (r["lang"] or "") == part and own in fails[k]]
                r = got[part, order, step]
                want = (len(left), len(gone), len(mine) - len(gone), sum(fails[k] == {own} for k in mine), sum(rows[k]["doc_id"] in good for k in gone), sum(rows[k]["doc_id"] in toxic for k in gone))
                assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]) == want
    assert all(r["shapley"] == shapley[part, order[step - 1]] for (part, order, step), r in got.items())
    empty = audit.audited(audit.labelled_masks(docs.limit(0), spark.createDataFrame([], LABELS)))
    assert empty.count() == 0


@pytest.mark.parametrize("width,most,entries", [(16, 300, 256), (3, 4, 256), (16, 1 << 26, 60), (1, 5, 40), (2, 3, 1)])
def test_searches_find_the_nearest_entry_of_lowest_index(width, most, entries):
    rng = np.random.default_rng(1)
    book, q = rng.integers(-most, most + 1, (entries, width)), rng.integers(-most, most + 1, (2000, width))
    q[:50] = book[rng.integers(0, entries, 50)]
    at, error = codes.Search(book).nearest(q)
    d = ((q[:, None] - book[None]) ** 2).sum(axis=2)
    assert (at == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def plain_codes(rows: list, parts: int = 4, entries: int = 256, rounds: int = 4):
    """Codes by the definition, every distance counted."""
    width = -(-max(len(v) for _, v in rows) // parts)
    q = np.zeros((len(rows), parts * width), np.int64)
    for k, (_, v) in enumerate(rows):
        q[k, : len(v)] = np.clip(np.floor(np.array(v, float) * 1024), -(1 << 26), 1 << 26)
    q = q.reshape(len(rows), parts, width)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, q[k].ravel().tolist()))
    books = q[order[:entries]].transpose(1, 0, 2).copy()
    nearest = lambda p: ((q[:, p, None] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(parts):
            at = nearest(p).argmin(axis=1)
            for e in range(books.shape[1]):
                if (at == e).any():
                    books[p, e] = [int(x) // int((at == e).sum()) for x in q[at == e, p].sum(axis=0)]
    d = [nearest(p) for p in range(parts)]
    return ["".join(f"{x.argmin(axis=1)[k]:02x}" for x in d) for k in range(len(rows))], [int(sum(x.min(axis=1)[k] for x in d)) for k in range(len(rows))], codes.digest(books)


@pytest.mark.parametrize("dim", [10, 8])
def test_codes_equal_the_definition(spark, dim):
    rng = np.random.default_rng(dim)
    sound = [(int(k), rng.normal(0, 1, dim if k % 9 else dim - 3).tolist()) for k in rng.permutation(700)]
    sound += [sound[5], (3, [0.5] * dim), (None, [0.1] * dim), (700, []), (701, [1e9] * dim)]
    sound = [(k, np.array(v, np.float32).tolist()) for k, v in sound]
    bad = [(1, None), (2, [None, *[0.0] * (dim - 1)]), (3, [float("nan")] * dim), (4, [float("inf")] * dim)]
    rows = [(k, v, k % 3 if k is not None and k % 7 else None, "x") for k, v in [*sound, *bad]]
    out = codes.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string").repartition(5)).collect()
    want, errors, digest = plain_codes(sound)
    assert sorted((repr(r["vec_id"]), r["code"], r["error"]) for r in out) == sorted((repr(k), c, e) for (k, _), c, e in zip(sound, want, errors, strict=True))
    assert {r["codebooks_sha256"] for r in out} == {digest}
    label = {repr(k): k % 3 if k is not None and k % 7 else None for k, _ in sound}
    sums: dict = {}
    for (k, _), e in zip(sound, errors, strict=True):
        sums[label[repr(k)]] = sums.get(label[repr(k)], 0) + e
    assert all(r["label_error"] == sums[label[repr(r["vec_id"])]] for r in out)


def test_codes_of_few_and_no_rows(spark):
    shape = "vec_id long, embedding array<float>, label int"
    assert codes.compressed(spark.createDataFrame([], shape)).count() == 0
    out = codes.compressed(spark.createDataFrame([(1, [0.5, 0.25, 0.0, -0.1], None), (1, [0.5, 0.25, 0.0, -0.1], 2)], shape)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in out] == [("00000000", 0, 0)] * 2
    assert [r["code"] for r in codes.compressed(spark.createDataFrame([(1, [], None)], shape)).collect()] == ["00000000"]


def test_normal_equations_are_those_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4 * classifier.UNIT, (500, len(classifier.NAMES)))
    y, fold = rng.integers(0, 2, 500), rng.integers(1, 5, 500)
    features = classifier.Features([2.0] * len(classifier.NAMES), [1.0] * len(classifier.NAMES), number=12)
    rows = [(int(f), a.tolist(), int(b)) for f, a, b in zip(fold, x, y, strict=True)]
    got = classifier.normal_equations(spark.createDataFrame(rows, "fold int, x array<long>, y int").repartition(7), features)
    z = np.concatenate([features(x), y[:, None] * float(classifier.COSINE)], axis=1)
    for f in range(1, 5):
        assert np.array_equal(got[f], (z[fold == f].T @ z[fold == f]).astype(np.int64))
    # the cosines approximate the kernel
    many = classifier.Features([2.0] * len(classifier.NAMES), [1.0] * len(classifier.NAMES), number=20_000)
    z = many(x[:2])[:, :-1] / classifier.COSINE
    apart = ((x[0] - x[1]) / classifier.UNIT / classifier.WIDTH) ** 2
    assert abs(2 * (z[0] * z[1]).mean() - np.exp(-apart.sum() / 2)) < 0.03


def test_isotonic_pools_are_the_least_squares_fit():
    rng = random.Random(4)
    for _ in range(50):
        rows = [(at, n := rng.randrange(1, 6), rng.randrange(n + 1)) for at in sorted(rng.sample(range(40), rng.randrange(1, 9)))]
        centres, values = classifier.isotonic(rows)
        assert values == sorted(values) and centres == sorted(centres)
        # min-max form of the isotonic regression
        share = lambda i, j: sum(r[2] for r in rows[i : j + 1]) / sum(r[1] for r in rows[i : j + 1])
        best = [max(min(share(i, j) for j in range(k, len(rows))) for i in range(k + 1)) for k in range(len(rows))]
        assert np.allclose(sorted(set(np.round(best, 12))), sorted(set(np.round(values, 12))))


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.scored(docs, labels).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").select("score", "predicted", "quality").collect()
    good = [r for r in rows if r["quality"] == 1]
    assert len(rows) > 500 and sum(r["predicted"] for r in good) >= 0.99 * len(good)
    assert sum(r["predicted"] == r["quality"] for r in rows) > 0.98 * len(rows)


def test_scores_of_odd_rows(spark):
    docs = odd(spark)
    labels = [(k, k % 2, 0) for k in range(11)] + [(5, None, 0), (None, 1, 0), (5, 0, 0)]
    out = classifier.scored(docs, spark.createDataFrame(labels, LABELS)).collect()
    again = classifier.scored(docs.repartition(1), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == docs.count() and sorted(map(repr, out)) == sorted(map(repr, again))
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
    assert {r["score"] for r in classifier.scored(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    one = classifier.scored(docs, spark.createDataFrame([(k, 1, 0) for k in range(11)], LABELS)).collect()
    assert all(r["score"] > 0.9 for r in one)
    assert classifier.scored(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
