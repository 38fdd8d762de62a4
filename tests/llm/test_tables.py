"""Operators on vectors and pages, helpers, the pipeline, and the SQL of what SQL can express."""

import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import QUERIES, SQL, host_trust, near_vectors
from paperloom.llm.graph import components
from paperloom.llm.sketch import build_filter, passes, sliced
from paperloom.llm.words import mix, shingle_sets, split_words, text_slices, windows, word_hashes
from tests.compare import difference
from tests.llm import cases


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert difference(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.01") is None


def vectors():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(5, 16))
    rows = [(i, (centre[i % 5] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000 + i, [2.0 * x for x in rows[8][1]]) for i in range(5)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None] + [1.0] * 15), (3004, [float("nan")] + [1.0] * 15), (3005, [float("inf")] + [1.0] * 15), (3006, [1.0, 2.0]), (3007, [1.0, 2.0]), (None, rows[0][1])]
    return rows


def test_near_vectors(spark):
    rows = vectors()
    table = spark.createDataFrame([(i, v, i, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label long, tile string, size int, links int").repartition(4)
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    union, links = cases.Union(), {i: 0 for i, _ in rows}
    for x, (i, v) in enumerate(good):
        for j, w in good[:x]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    expected = sorted(((i, links[i] if i is not None else 0, union.find(i) if i is not None else None, i is None or union.find(i) == i) for i, _ in rows), key=str)
    for tile in (4096, 50):
        found = near_vectors.near_duplicates(table, tile=tile).select("vec_id", "n_links", "component_id", "kept").collect()
        assert sorted(map(tuple, found), key=str) == expected
    assert near_vectors.near_duplicates(table.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([3, 64, 1500]))
def test_no_pair_is_lost_by_quantisation(seed, size):
    rng = np.random.default_rng(seed)
    one = rng.normal(size=(30, size)) * rng.choice([1, 1e-6, 1e6], size=(30, 1))
    two = np.concatenate([one[:20] * 3 + rng.normal(size=(20, size)) * np.linalg.norm(one[:20], axis=1)[:, None] / np.sqrt(size), rng.normal(size=(5, size))])
    u, v = (x / np.linalg.norm(x, axis=1)[:, None] for x in (one, two))
    expected = set(zip(*(x.tolist() for x in np.nonzero(u @ v.T >= 0.95)), strict=True))
    found = {(int(a), int(b)) for i, j in near_vectors.near_pairs(one, two) for a, b in zip(i, j, strict=True)}
    assert found == expected


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=25))
def test_forest(pairs):
    union = cases.Union()
    for a, b in pairs:
        union.join(a, b)
    assert near_vectors.forest(np.array(pairs, np.int64).reshape(-1, 2), 16).tolist() == [union.find(i) for i in range(16)]


def test_components(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 200)]
    pairs = chain + star + [tuple(map(int, p)) for p in rng.integers(1000, 1300, size=(200, 2))] + [(5, 5), (None, 3), (7, 6), (6, 7)]
    union = cases.Union()
    for a, b in pairs:
        if a is not None and a != b:
            union.join(a, b)
    found = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(i, union.find(i)) for i in union.up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def pages():
    html = lambda *links: "".join(f'<a HREF = "{x}">x</a>' for x in links)
    return [
        (1, "http://A.example.org/es/1", html("http://good.net/", "//bad.info/x", "/local", "/r?u=http://no.net/")), (2, "http://a.example.org/es/2", None), (3, "https://good.org/x?y", html("http://liked.net/a", "http://liked.net/b")),
        (4, "http://bad.info/", html("http://x.com/de/1")), (5, "http://x.com/de/1", ""), (6, "http://liked.net/a", ""), (7, None, html("http://z.net")), (8, "nothing", ""), (9, "http://org", ""), (10, "http://org/", ""), (11, "ftp://B.ORG?x/", ""),
        (12, "http://example.org/en/12#f", ""), (13, "http://evilexample.org/en/12", ""), (14, "http://a.com/fr/", ""), (15, "x://http://y.org/", ""), (5, "http://x.com/de/1", ""), (None, "http://far.net/", html("http://bad.info")), (16, "", ""),
    ]


def test_host_trust(spark):
    table = spark.createDataFrame([(*p, "h", 1, "r") for p in pages()], "page_id long, url string, html string, host string, s int, rule string").repartition(3)
    host, path = {}, {}
    for i, url, _ in pages():
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host[i] = re.match("[^/?#]*", rest)[0].translate(cases.LOWER)
        path[i] = re.match("[^?#]*", rest[len(host[i]) :])[0]
    by_rule = {}
    for i in host:
        fit = [(len(h + p), h + p, verdict) for verdict, h, p in host_trust.RULES if (host[i] == h or host[i].endswith("." + h)) and path[i].startswith(p)]
        by_rule[i] = max(fit)[1:] if fit else (None, None)
    found = host_trust.judge(table).collect()
    assert len(found) == len(pages())
    for r in found:
        i = r["page_id"]
        assert (r["host"], r["path"], r["rule"]) == (host[i], path[i], by_rule[i][0])
        assert r["verdict"] == by_rule[i][1] or by_rule[i][1] is None
    verdict = {r["page_id"]: r["verdict"] for r in found}
    assert verdict[4] == "block" and verdict[None] == "block"  # they link to what is blocked
    assert verdict[6] == "allow" and verdict[7] == "allow" and verdict[8] == "allow"
    assert host_trust.judge(table.limit(0)).count() == 0


def test_trust_by_power_iteration(spark):
    rng = np.random.default_rng(2)
    n = 12
    link = rng.integers(0, 3, size=(n, n)) * (1 - np.eye(n, dtype=int))
    good, bad = rng.random(n), rng.random(n)
    hosts = spark.createDataFrame([(f"h{i}", float(good[i]), float(bad[i])) for i in range(n)], "host string, good double, bad double")
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(link[i, j])) for i in range(n) for j in range(n) if link[i, j]], "s string, t string, n long")
    t, d = good.copy(), bad.copy()
    forth, back = link / np.maximum(link.sum(1), 1)[:, None], link / np.maximum(link.sum(0), 1)[None, :]
    for _ in range(5):
        t, d = 0.15 * good + 0.85 * t @ forth, 0.15 * bad + 0.85 * back @ d
    found = {r["host"]: (r["trust"], r["distrust"]) for r in host_trust.spread(hosts, edges, rounds=5).collect()}
    assert all(found[f"h{i}"] == pytest.approx((t[i], d[i])) for i in range(n))
    settled = {r["host"]: (r["trust"], r["distrust"]) for r in host_trust.spread(hosts, edges, margin=1e-4).collect()}
    t, d = 0.15 * np.linalg.solve(np.eye(n) - 0.85 * forth.T, good), 0.15 * np.linalg.solve(np.eye(n) - 0.85 * back, bad)
    assert all(settled[f"h{i}"] == pytest.approx((t[i], d[i]), abs=1e-4) for i in range(n))


def test_distrust_reaches_the_far_end_of_a_chain(spark):
    """Verdicts that depend on links alone, 30 steps from the only blocked page; links without quotes count."""
    chain = [(i, f"http://h{i}.net/", f"<a href=http://h{i + 1}.net/x>x</a>") for i in range(30)] + [(30, "http://h30.net/", "<a HREF = 'http://end.com/de/1'>")]
    pages = [*chain, (31, "http://end.com/de/1", ""), (40, "http://apart.net/", "<a href=http://good.org/>"), (41, "http://good.org/", "<a href=//liked.net>")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    verdict = {r["page_id"]: r["verdict"] for r in host_trust.judge(table).collect()}
    assert all(verdict[i] == "block" for i in range(32)) and verdict[40] == verdict[41] == "allow"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("abAB \n\t\x1cé日"), max_size=60)), max_size=8), st.integers(1, 40))
def test_words_and_shingles(texts, most):
    import pyarrow as pa

    seen, content = {}, {}
    at = 0
    for first, last, data, offsets in text_slices(pa.array(texts, pa.string()), most):
        assert first == at
        at = last
        starts, ends, of = split_words(data, offsets)
        raw = data.tobytes()
        own = [[raw[a:b].decode() for a, b in zip(starts[x:y], ends[x:y], strict=True)] for x, y in zip(of[:-1], of[1:], strict=True)]
        assert own == [cases.WORD.findall(t or "") for t in texts[first:last]]
        hashes = word_hashes(data, starts, ends, lower=True)
        for word, h in zip((w.translate(cases.LOWER) for o in own for w in o), hashes.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
        tokens, bounds = shingle_sets(hashes, of, 5)
        for t, a, b in zip(texts[first:last], bounds[:-1], bounds[1:], strict=True):
            expected = frozenset(cases.shingles(t))
            assert len(expected) == b - a and content.setdefault(expected, tokens[a:b].tolist()) == tokens[a:b].tolist()
    assert at == len(texts) and len(set(seen.values())) == len(seen)


def test_hashes_keep_words_apart():
    import pyarrow as pa

    words = [f"ción{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz0123"]
    (_, _, data, offsets), = text_slices(pa.array([" ".join(words)]))
    starts, ends, _ = split_words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(words) == len(set(windows(hashes, 3).tolist())) + 2


def test_filter_passes_all_members(spark):
    import pyarrow as pa

    hashes = mix(np.arange(1, 5000, dtype=np.uint64))
    rows = [(i, bytearray(raw)) for part in np.array_split(hashes, 3) for i, raw in sliced(part, 1 << 12)]
    bits = build_filter(spark.createDataFrame(rows, "slice int, hashes binary").select("slice", F.col("hashes")), 1 << 12)
    assert passes(hashes, bits).all() and passes(mix(np.arange(10_000, 20_000, dtype=np.uint64)), bits).mean() < 0.2
    assert isinstance(pa.array(bits), pa.Array)


def test_pipeline_stages(spark):
    """Each stage on its own input, by brute force where one exists."""
    rows = cases.texts() + [(95_000, "12345 !!!"), (95_001, 'password = "abcdefghijkl" the thing and the others are here')]
    docs = cases.table(spark, rows).repartition(4).cache()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "redacted_secrets", "packed"]
    steps = dict(corpus_pipeline.STAGES)
    spoken = steps["language"](spark, docs, "")
    ids = {r["doc_id"] for r in spoken.collect()}
    assert spoken.columns == docs.columns and 95_000 not in ids and 95_001 in ids and ids >= {i for i, t in rows if t and len(t.split()) > 20}
    one = steps["near_duplicates"](spark, docs, "")
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {c for _, _, c in cases.near_components(rows)}
    less = steps["repeated_passages"](spark, docs, "")
    removed = {i: (n, gone) for i, n, gone, _ in cases.without_repeats(rows)}
    assert less.columns == docs.columns
    for r in less.collect():
        n, gone = removed[r["doc_id"]]
        assert len(cases.WORD.findall(r["text"] or "")) == n - gone and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    clean = {r["doc_id"]: r["text"] for r in steps["redacted_secrets"](spark, docs, "").collect()}
    assert clean[95_001] == "<SECRET>\" the thing and the others are here" and len(clean) == len({i for i, _ in rows})
    assert {r["doc_id"] for r in steps["packed"](spark, docs, "").collect()} == {i for i, _ in rows}


def test_pipeline(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    filled = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert found.count() > 100 and filled.where("n <> end or n > 4096").count() == 0
