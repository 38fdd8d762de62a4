"""Exact copies, periodic runs and whitening against brute force, and their odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from paperloom.llm import QUERIES, exact_copies, periodic_runs, repeats, whitening
from paperloom.llm.queries import periodic_tail
from tests.llm import cases


# --- exact copies -------------------------------------------------------------------------------

def copies_expected(rows):
    """``(doc_id, keep_id, group_size, sha256)`` of every row, and how many rows with each id and text stay."""
    squeezed = [(text or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)}) for _, text in rows]
    groups = {}
    for k, s in enumerate(squeezed):
        groups.setdefault(s, []).append(k)
    out, kept = [], []
    for s, own in groups.items():
        best = min(own, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0))
        kept.append((rows[best][0], hashlib.sha256(s.encode()).hexdigest()))
        out += [(rows[k][0], rows[best][0], len(own), kept[-1][1]) for k in own]
    return sorted(out, key=str), sorted(kept, key=str)


def copy_rows():
    rows = cases.texts()
    rows += [(20_000 + i, " ".join("the same text in many rows".split()) + " " * (i % 3)) for i in range(300)]
    rows += [(21_000, "ab c"), (21_001, "a bc"), (21_002, "a bc"), (21_003, "\x1cabc"), (None, "abc"), (None, None), (None, "only here"), (21_004, "y" * 200_000), (21_005, "y" * 200_000)]
    return rows


@pytest.mark.parametrize("bucket_bytes", [exact_copies.BUCKET_BYTES, 40_000])
def test_exact_copies(spark, bucket_bytes):
    rows = copy_rows()
    docs = cases.table(spark, rows).withColumnsRenamed({"a": "keep_id", "b": "kept", "key": "rep", "part": "digest"})
    found = exact_copies.group_copies(docs, bucket_bytes=bucket_bytes).collect()
    expected, kept = copies_expected(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == expected
    assert sorted(((r.doc_id, r.text_sha256) for r in found if r.kept), key=str) == kept


def test_full_buckets_are_divided(spark):
    """Buckets far below the size of the contents need several levels, and entries that moved on keep their followers."""
    rows = [(i, f"text {i % 150} " + "x" * 400) for i in range(900)]
    docs = cases.table(spark, rows)
    found = exact_copies.group_copies(docs, bucket_bytes=3000).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == [(i, i % 150, 6, i < 150) for i in range(900)]


def test_keep_one(spark):
    rows = copy_rows()
    docs = cases.table(spark, rows).withColumnsRenamed({"a": "keep_id", "b": "kept", "key": "carried"})
    kept = exact_copies.keep_one(docs)
    assert kept.columns == docs.columns
    texts = {(i, t) for i, t in rows}
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert set(found) <= texts and len(found) == len({(t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)}) for _, t in rows})
    assert exact_copies.keep_one(docs.limit(0)).count() == 0
    assert exact_copies.group_copies(cases.empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from([b"a", b"b", b"ab", b"", b"c" * 50])), max_size=200))
def test_table_compares_content(rows):
    """Digests that clash on purpose: only the content decides."""
    table, seen = exact_copies.ContentTable(), {}
    for row, (clash, content) in enumerate(rows):
        key = (bytes([clash]) * 32, content)
        first = key not in seen
        entry = table.add(*key, row, 1, (0, False, 0, row))
        assert (entry == len(seen)) if first else (entry == seen[key])
        seen.setdefault(key, entry)
    assert len(table) == len(seen) and sum(table.number) == len(rows)


# --- periodic runs ------------------------------------------------------------------------------

def runs_expected(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        start = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                length = i + q - start
                if i > start and length >= max(6, 4 * q):
                    part = words[start : start + length]
                    if all(any(part[k] != part[k + p] for k in range(length - p)) for p in range(1, q)):
                        out.append((start, length, q))
                start = i + 1
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def run_texts():
    rng = np.random.default_rng(8)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 300, list("ab" * 4), list("ab" * 4 + "a"), list("aab" * 4 + "aabaac" * 5), list("abcabcabca"), list("abcabcabcabc" + "x" + "abcabcabcabc")]
    for letters in (2, 3, 6):
        for _ in range(12):
            words = rng.integers(0, letters, size=int(rng.integers(0, 90))).astype(str).tolist()
            for _ in range(int(rng.integers(0, 4))):
                root = rng.integers(0, letters, size=int(rng.integers(1, 12))).astype(str).tolist()
                at = int(rng.integers(0, len(words) + 1))
                words[at:at] = (root * 9)[: int(rng.integers(3 * len(root), 9 * len(root) + 1))]
            out.append(words)
    return out


def test_runs_of_many_texts():
    texts = run_texts()
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for own in texts for w in own], np.int64)
    of = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = periodic_runs.runs_of(ids, of).tolist()
    assert found == [[k, *r] for k, own in enumerate(texts) for r in runs_expected(own)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=7), st.integers(1, 7)), max_size=6))
def test_runs(parts):
    words = list("".join(root * times for root, times in parts))
    ids = np.array([ord(w) for w in words], np.int64)
    assert [tuple(r[1:]) for r in periodic_runs.runs_of(ids, np.array([0, len(ids)])).tolist()] == runs_expected(words)


def digest_expected(doc, text):
    words = cases.WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    g = h // 10
    if doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_expected(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_of_documents(spark):
    rows = [(i, t) for i, t in cases.texts() if len(t or "") < 4000 or i >= 10_000][::2]
    rows = [(i, t) for i, t in rows if len((t or "").split()) < 900]
    rows += [(30_000 + i, " ".join(w)) for i, w in enumerate(run_texts())] + [(None, "a a a a a a"), (None, None), (5, "")]
    docs = cases.table(spark, rows).withColumnsRenamed({"a": "start", "b": "period"})
    found = sorted(map(tuple, periodic_runs.digest(docs, periodic_tail).collect()), key=str)
    assert found == sorted((digest_expected(i, t) for i, t in rows), key=str)
    assert periodic_runs.digest(docs.limit(0), periodic_tail).count() == 0
    listed = periodic_runs.find_runs(docs)
    assert listed.count() == sum(len(runs_expected(cases.WORD.findall(t or ""))) for _, t in rows)


def test_collapse(spark):
    rows = [(1, "x  y"), (2, "a b a b a b a b c"), (3, None), (4, ""), (2, "a b a b a b a b c"), (None, "z z z z z z")]
    docs = cases.table(spark, rows).withColumnRenamed("a", "row_")
    out = periodic_runs.collapse(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "x  y"), (2, "a b c"), (3, None), (4, ""), (2, "a b c"), (None, "z")], key=str)


def test_query_of_runs_reads_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    short = [r for r in docs.collect() if len(r.text or "") < 3000]
    assert len(found) == docs.count()
    for r in short:
        assert tuple(found[r.doc_id]) == digest_expected(r.doc_id, r.text)
    assert any(r.n_runs for r in found.values())


# --- whitening ----------------------------------------------------------------------------------

def whitened_expected(rows):
    """``vec_id, component -> (n, deviation, |whitened|, explained)`` by a dense eigenvalue problem."""
    good = [(i, v) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all()]
    whole = [(i, tuple(int(np.floor(256 * float(c))) for c in v)) for i, v in good]
    out = []
    for width in {len(x) for _, x in whole}:
        own = [(i, x) for i, x in whole if len(x) == width]
        fit = np.array(sorted({x for _, x in own}), float)
        n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
        if n < 2:
            continue
        cov = np.cov(fit.T, bias=True).reshape(width, width)
        values, axes = np.linalg.eigh(cov)
        values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
        for i, x in own:
            for c in range(int((values > 1e-10 * values[0]).sum())):
                white = abs((np.array(x) - fit.mean(axis=0)) @ axes[:, c] / np.sqrt(values[c]))
                out.append((i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), white, values[c] / np.trace(cov)))
    return out


def agree(found, expected):
    key = lambda r: (str(r[0]), r[1], r[2], r[3], round(r[4], 6))
    found, expected = sorted(found, key=key), sorted(expected, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    assert np.allclose([r[4] for r in found], [r[4] for r in expected], atol=1e-8)
    assert np.allclose([r[5] for r in found], [r[5] for r in expected], rtol=1e-10)


def test_whitening(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(50, 50)) * (0.9 ** np.arange(50))
    rows = [(i, (rng.normal(size=50) @ mix.T + 3).astype(np.float32).tolist()) for i in range(300)]
    rows += [(900 + i, rows[5][1]) for i in range(100)] + [(7, rows[7][1]), (None, rows[9][1])]
    rows += [(400, None), (401, []), (402, [None] + [1.0] * 49), (403, [float("nan")] * 50), (404, [float("inf")] * 50), (405, [0.0] * 50)]
    rows += [(500 + i, [float(i), -2.0 * i]) for i in range(6)] + [(600, [1.0, 2.0, 3.0])]  # a line, and a space of one vector
    table = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<float>, x long, n string").repartition(5)
    found = whitening.whiten(table).collect()
    agree([(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found], whitened_expected(rows))
    assert max(r.identity_error for r in found) < 1e-9
    signs = {}
    for r in found:  # one sign for all rows: equal vectors have equal coordinates
        signs.setdefault((r.n, r.component, r.deviation, round(abs(r.whitened), 9)), set()).add(round(r.whitened, 9))
    assert all(len(s) == 1 for k, s in signs.items() if k[3] > 1e-6 and k[0] > 100)
    assert whitening.whiten(table.limit(0)).count() == 0


def test_whitening_of_the_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    found = QUERIES["op12_whitening"](spark, "/root/testdata/sf0.01").collect()
    agree([(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found], whitened_expected(rows))


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from(["flat", "steep", "low rank", "equal", "one"]), st.sampled_from([3, 40, 120]))
def test_leading_eigenvectors(seed, kind, width):
    rng = np.random.default_rng(seed)
    values = {"flat": 1 + 0.3 * rng.random(width), "steep": 10.0 ** -np.linspace(0, 6, width), "low rank": np.r_[5.0, 3.0, np.zeros(width - 2)], "equal": np.r_[[2.0] * min(6, width), 0.5 * rng.random(max(width - 6, 0))], "one": np.r_[1.0, np.zeros(width - 1)]}[kind]
    axes = np.linalg.qr(rng.normal(size=(width, width)))[0]
    matrix = (axes * values) @ axes.T
    got, vectors = whitening.leading(lambda y: matrix @ y, width, min(4, width))
    expected = np.sort(values)[::-1][: min(4, width)]
    assert np.allclose(got, expected, rtol=1e-9, atol=1e-11 * expected[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-10)
    assert np.linalg.norm(matrix @ vectors - vectors * got, axis=0).max() <= 1e-11 * expected[0]


def test_sums_are_added_by_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    monkeypatch.setattr(whitening, "SLICE", 7)
    rng = np.random.default_rng(5)
    x = rng.integers(-1000, 1000, size=(400, 20))
    fit = spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>").repartition(20)
    n, sums, trace = whitening.moments(fit, 20)
    assert (n, sums) == (400, x.sum(axis=0).tolist()) and abs(float(trace) - np.trace(np.cov(x.T, bias=True))) < 1e-6
    block = rng.normal(size=(20, 5))
    assert np.allclose(whitening.covariance_times(fit, n, sums)(block), np.cov(x.T, bias=True) @ block)


def test_repeats_by_smaller_batches(spark):
    """What a task compares at a time changes no result; a passage is found across slices of one row each."""
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"own{i} {passage} end{i}" if i % 3 else f"x{i} y{i}") for i in range(60)] + [(60, None), (None, passage)], "doc_id long, text string")
    whole, small = (sorted(map(tuple, repeats.remove(docs, batch_bytes=most).collect()), key=str) for most in (8_000_000, 50))
    assert whole == small and [r for r in whole if r[0] == 2] == [(2, "own2 end2")]
