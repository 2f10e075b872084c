"""The phrase index, hard negatives and vector codes against brute-force versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelens.llm import hard_negatives, phrase_index, vector_codes, vectors

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(phrase_index.UPPER, phrase_index.LOWER)
VECTORS = "vec_id long, embedding array<float>, label int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contaminated(docs, items):
    """By item: every window of every document compared with every window of every item."""
    out = []
    for doc_id, text in docs:
        own, hit, names = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            width = min(10, len(w))
            wins = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if w else set()
            for i in range(len(own) - width + 1):
                if tuple(own[i : i + width]) in wins:
                    hit.update(range(i, i + width))
                    names.add("" if item_id is None else str(item_id))
        listed = ",".join(sorted(names))
        out.append((doc_id, len(own), len(hit), len(names), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def indexed(spark, docs, items, path):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("segment", "term", "kind", "row")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "words", "n")})
    return sorted((tuple(r) for r in phrase_index.contamination(d, i, path).collect()), key=str)


def test_split_words_equals_the_pattern():
    rng = random.Random(3)
    texts = ["", "a", "Ünï 中文x9 -- A_b", " ", "é", "end"] + ["".join(rng.choices("aB9 -éß\n中\x00", k=rng.randint(0, 30))) for _ in range(300)]
    for part in (pa.array(texts), pa.array(texts).slice(3, 200)):
        found, counts = phrase_index.split_words(part)
        want = [words(t) for t in part.to_pylist()]
        assert counts.tolist() == [len(w) for w in want]
        assert found.to_pylist() == [x for w in want for x in w]


@pytest.mark.parametrize("segment_bytes", [60, 8 << 20])
def test_contamination_against_all_windows(spark, tmp_path, monkeypatch, segment_bytes):
    monkeypatch.setattr(phrase_index, "SEGMENT_BYTES", segment_bytes)
    rng = random.Random(segment_bytes)
    text = lambda n: " ".join(rng.choices("aa bb cc dd ee Ff 中 g1".split(), weights=[30, 9, 5, 3, 2, 1, 1, 1], k=n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(12)]
    items += [(50, None), (51, " -- "), (7, items[7][1]), (None, text(12)), (10, items[3][1]), (9, text(14))]
    docs = [(i, text(rng.choice([0, 2, 8, 40]))) for i in range(30)]
    # Whole items, their ends only, and one of them many times over.
    docs += [(100 + i, f"{text(4)}, {t}! {text(3)}") for i, (_, t) in enumerate(items) if t]
    docs += [(200, " ".join((items[4][1] or "").split()[2:]) + " zz"), (201, f"{items[5][1]} " * 40), (None, items[2][1]), (3, None), (3, items[1][1])]
    assert indexed(spark, docs, items, str(tmp_path / "i")) == contaminated(docs, items)


def test_contamination_of_empty_tables(spark, tmp_path):
    assert indexed(spark, [], [(1, "a b")], str(tmp_path / "a")) == []
    docs = [(1, "a b c"), (2, None)]
    assert indexed(spark, docs, [], str(tmp_path / "b")) == contaminated(docs, [])


def test_whole_index_and_proximity(spark, tmp_path):
    path = str(tmp_path / "i")
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "one z z two three"), (3, "three two one"), (4, "one three")], "doc_id long, text string")
    phrase_index.write_index(docs.coalesce(1), path)
    index = phrase_index.postings(spark, path)
    assert {r.term for r in index.collect()} == {"x", "y", "z", "one", "two", "three"}
    items = phrase_index.numbered_items(spark.createDataFrame([(9, "One two THREE")], "item_id long, text string"))
    ids = {(r.segment, r.row): r.doc_id for r in phrase_index.documents(spark, path).collect()}
    near = lambda slop: sorted({ids[r.segment, r.row] for r in phrase_index.proximity_matches(items, index, slop).collect()})
    assert near(0) == [1]
    assert near(1) == [1]
    assert near(2) == [1, 2, 3]
    exact = phrase_index.phrase_matches(items, index).collect()
    assert [(ids[r.segment, r.row], r.place, r.length) for r in exact] == [(1, 1, 3)]


def test_hilbert_neighbours_differ_by_one_step():
    for dims, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hard_negatives.hilbert(grid, bits)
        assert len(set(keys)) == len(grid)
        way = grid[sorted(range(len(grid)), key=lambda i: keys[i])]
        assert (np.abs(np.diff(way, axis=0)).sum(1) == 1).all()


def test_exact_dot_beyond_the_float_range():
    rng = np.random.default_rng(1)
    for top in (3, 1 << 10, 1 << 26, 1 << 29):
        a, b = rng.integers(-top, top, (7, 5)), rng.integers(-top, top, (9, 5))
        a[0], b[0] = -top, top
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        for bits in (None, 5):
            assert vectors.exact_dot(a, b, bits).tolist() == want


def test_bounds_hold_every_product():
    rng = np.random.default_rng(2)
    a, x = rng.integers(-9, 9, (6, 4)), rng.integers(-9, 9, (50, 4))
    least, most = hard_negatives.bounds(a, x.min(0)[None], x.max(0)[None])
    assert (least <= a @ x.T).all() and (a @ x.T <= most).all()


def awkward(rng, n, dims):
    """Vectors with ties, copies, repeated and null ids, nulls of all kinds and odd lengths."""
    rows = [(i, rng.choice([-0.5, -0.25, 0.0, 0.125, 0.5], dims).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(n + i, rows[2][1], int(rng.integers(0, 4))) for i in range(20)]
    rows += [(None, rows[1][1], 1), (3, rows[5][1], 2), (100, None, 1), (101, [], 1), (102, [None] * dims, 2)]
    rows += [(103, [float("nan")] * dims, 2), (104, [float("inf")] * dims, 2), (105, [0.5], 1), (106, rows[0][1], None)]
    return rows


def usable(rows, dims):
    return [r for r in rows if r[1] and len(r[1]) == dims and all(x is not None and np.isfinite(x) for x in r[1])]


def negatives(rows, dims):
    last = float("inf")
    kept = [
        (i, np.floor(256 * np.array(v, float)).astype(int), (y + 1) % 10 if i is not None and i % 7 == 0 else y)
        for i, v, y in usable(rows, dims)
        if y is not None
    ]
    out = []
    for i, v, y in kept:
        if i is None or i % 100:
            continue
        scored = sorted(((-int(v @ w), last if j is None else j, z == y) for j, w, z in kept if j != i), key=lambda s: s[:2])
        for score, j, _ in [s for s in scored if s[2]][:5]:
            fit = [s for s in scored if not s[2] and 80 * -score <= 100 * -s[0] <= 100 * -score][:5]
            out += [(i, None if j == last else j, k + 1, None if m == last else m, -score, -s) for k, (s, m, _) in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("small_blocks", [True, False])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, small_blocks):
    if small_blocks:
        for name, value in (("FOLDER_ROWS", 64), ("RANGE_ROWS", 16), ("BLOCK_ROWS", 4), ("ANCHORS_PER_TILE", 1), ("ZONES_PER_PAGE", 16), ("PROBES", 1)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = awkward(np.random.default_rng(5), 210, 8)
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("range", "block", "score", "anchor")})
    got = sorted((tuple(r) for r in hard_negatives.hard_negatives(df).collect()), key=str)
    assert got and got == negatives(rows, 8)


def codes(rows, dims, parts=4):
    kept = usable(rows, dims)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(1024 * np.array([r[1] for r in kept], float)).astype(int).reshape(len(kept), parts, -1)
    books = [x[:256, p].copy() for p in range(parts)]
    near = lambda p: ((x[:, p, None] - books[p][None]) ** 2).sum(2)
    for _ in range(4):
        for p in range(parts):
            code = near(p).argmin(1)
            for e in set(code.tolist()):
                books[p][e] = x[code == e, p].sum(0) // (code == e).sum()
    d = [near(p) for p in range(parts)]
    error = [int(sum(m[i].min() for m in d)) for i in range(len(kept))]
    by_label = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{m[i].argmin():02x}" for m in d), error[i], by_label[r[2]], sha) for i, r in enumerate(kept)), key=str)


def test_vector_codes_against_plain_rounds(spark):
    rows = awkward(np.random.default_rng(6), 400, 8)
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("code", "error", "of", "part")})
    got = sorted((tuple(r) for r in vector_codes.vector_codes(df).collect()), key=str)
    assert got == codes(rows, 8)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1), (2, [], None)]):
        df = spark.createDataFrame(rows, VECTORS)
        assert vector_codes.vector_codes(df).collect() == []
        assert hard_negatives.hard_negatives(df).collect() == []
