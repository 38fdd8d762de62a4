"""Byte-pair tokens against the installed tokenizer library, n-gram suggestions by hand."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from paperloom.operators import aggregates, bpe, suggestions


def library(texts, size, min_frequency=3):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    tokenizer = Tokenizer(models.BPE())
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    trainer = trainers.BpeTrainer(
        min_frequency=min_frequency, special_tokens=["<|endoftext|>"], vocab_size=size, show_progress=False)
    tokenizer.train_from_iterator(texts, trainer=trainer)
    vocab = tokenizer.get_vocab()
    return tokenizer, sorted(vocab, key=vocab.get)


def test_bpe_equals_the_library(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).cache()
    tokenizer, vocab = library([r.text for r in docs.collect()], 240)
    model = bpe.bpe_train(docs, "text", 240)
    assert model.tokens == vocab
    model.save(spark, str(tmp_path))
    loaded = bpe.BpeModel.load(spark, str(tmp_path))
    encoded = bpe.bpe_encode(docs, "text", loaded)
    for r in encoded.withColumn("back", bpe.bpe_decode(F.col("token_ids"), loaded)).collect():
        assert list(r.token_ids) == tokenizer.encode(r.text).ids and r.back == r.text


def test_full_vocabulary_equals_the_library(spark):
    """The default size over whole documents: every merge that is frequent enough, and the ids of every text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").cache()
    texts = [r.text for r in docs.collect()]
    tokenizer, vocab = library(texts, 65_536)
    model = bpe.bpe_train(docs, "text")
    assert model.tokens == vocab and len(vocab) > 2000
    encoded = [list(r.token_ids) for r in bpe.bpe_encode(docs, "text", model).collect()]
    assert encoded == [tokenizer.encode(t).ids for t in texts]


@pytest.mark.parametrize("pairs,most_segments", [(1, 500), (2, 500), (7, 500), (64, 20), (64, 500)])
def test_rounds_of_any_size_learn_the_same(spark, pairs, most_segments):
    rng = random.Random(pairs)
    texts = [" ".join("".join(rng.choice("aab") for _ in range(rng.randrange(1, 9))) for _ in range(30)) for _ in range(40)] + ["aaaaaaaaaaaaaaaaaaaaa", "ababababab ababab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    _, vocab = library(texts, 60)
    assert bpe.bpe_train(df, "text", 60, pairs=pairs, most_segments=most_segments).tokens == vocab


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(0, 100))
def test_merges_by_queue(word, seed):
    rng = random.Random(seed)
    rules, known = [], 4
    for _ in range(8):
        rules.append((rng.randrange(known), rng.randrange(known), known))
        known += 1
    rules = sorted({(a, b): (a, b, new) for a, b, new in rules}.values(), key=lambda r: r[2])
    expected = list(word)
    for a, b, new in rules:
        expected = bpe._replaced(expected, (a, b), new)
    assert bpe._merged(word, {(a, b): (rank, new) for rank, (a, b, new) in enumerate(rules)}) == expected


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=2, max_size=40), min_size=1, max_size=12), st.integers(0, 100), st.sampled_from([1, 3, 64]))
def test_merges_of_many_words(words, seed, steps):
    """Words that share an array become what each becomes alone, those with more merges than steps as well."""
    rng = random.Random(seed)
    rules, known = {}, 4
    for _ in range(8):
        rules.setdefault((rng.randrange(known), rng.randrange(known)), known)
        known += 1
    merges = [(a, b, new) for (a, b), new in rules.items()]
    expected = []
    for word in words:
        for a, b, new in merges:
            word = bpe._replaced(word, (a, b), new)
        expected.append(word)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bpe, "_STEPS", steps)
        symbols, lengths, place = bpe._merged_together(np.array([s for w in words for s in w]), np.array([len(w) for w in words]), np.array(merges))
    got = dict(zip(place.tolist(), (part.tolist() for part in np.split(symbols, np.cumsum(lengths)[:-1]))))
    assert [got[i] for i in range(len(words))] == expected


def test_training_has_no_loop_over_words(spark, monkeypatch):
    """Short words never take the queue, and rounds with few segments look at more pairs soon."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(50)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rounds, ranked = [], bpe._ranked_pairs
    monkeypatch.setattr(bpe, "_ranked_pairs", lambda *a: rounds.append(a[1] - 1) or ranked(*a))
    monkeypatch.setattr(bpe, "_merged", None)
    _, vocab = library(texts, 300)
    assert bpe.bpe_train(df, "text", 300, pairs=4).tokens == vocab
    assert rounds[1] == 32


def test_bpe_of_no_text(spark):
    for texts in ([], [None], [""], ["a", None]):
        model = bpe.bpe_train(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
        assert model.merges == [] and len(model.tokens) == 1 + ("a" in texts)


def test_bpe_stops_at_rare_pairs(spark):
    texts = ["aaaa aaa", "abab abab ab", "été 42 été!", "aaaa"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    _, vocab = library(texts, 500, 2)
    model = bpe.bpe_train(df, "text", 500, min_frequency=2)
    assert model.tokens == vocab and len(model.tokens) < 500


def test_ngrams(spark):
    df = spark.createDataFrame([("the red fox the red dog the red fox",), ("one",)], "t string")
    grams = aggregates.ngram_counts(df, F.split("t", " "))
    got = {(r.context, r.next): (r.n, round(r.share, 4)) for r in grams.collect()}
    assert got == {("the", "red"): (3, 1.0), ("red", "fox"): (2, 0.6667), ("red", "dog"): (1, 0.3333),
                   ("fox", "the"): (1, 1.0), ("dog", "the"): (1, 1.0)}


def test_filter_distribution(spark):
    probs = spark.createDataFrame([("c", t, p, t == "b") for t, p in zip("abcd", (0.4, 0.3, 0.2, 0.1))],
                                  "context string, next string, share double, seen boolean")
    got = {r.next: r.p for r in suggestions.filter_distribution(probs, temperature=1.0, top_k=3, top_p=0.7).collect()}
    assert got.keys() == {"a", "b"} and math.isclose(got["a"], 4 / 7)
    sharp = {r.next: r.p for r in suggestions.filter_distribution(
        probs, temperature=0.5, top_k=2, top_p=1.0, repetition_penalty=2.0, seen="seen").collect()}
    assert sharp.keys() == {"a", "c"} and math.isclose(sharp["a"], 0.16 / 0.2)


def test_bigrams_by_hand(spark):
    df = spark.createDataFrame([("black hole here",)] * 10 + [("black cat",), ("a hole",)], "t string")
    rows = {(r.first, r.second): r for r in aggregates.bigram_collocations(df, F.split("t", " "), 5.0).collect()}
    r = rows["black", "hole"]
    assert (r.n_pair, r.n_first, r.n_second) == (10, 11, 11)

    def ll(k, n, p):
        return k * math.log(max(p, 1e-10)) + (n - k) * math.log(max(1 - p, 1e-10))

    total, c12, c1, c2 = 34, 10, 11, 11
    want = -2 * (ll(c12, c1, c2 / total) + ll(c2 - c12, total - c1, c2 / total)
                 - ll(c12, c1, c12 / c1) - ll(c2 - c12, total - c1, (c2 - c12) / (total - c1)))
    assert math.isclose(r.score, want)


@pytest.mark.parametrize("frequent", [0, 3, 200_000])
def test_bigrams_by_numbers(spark, monkeypatch, frequent):
    """Every pair by hand, whatever words travel with the tasks, and words whose numbers are the same at first."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "of", "red", "fox", "cat", "sun", f"w{rng.randrange(30)}", ""]) for _ in range(rng.randrange(12))) for _ in range(80)]
    texts += ["new york city"] * 9 + [None, "", " ", "one"]
    number, seeds = aggregates._word_number, set()

    def clash(word, seed):
        seeds.add(seed)
        return F.when(word == "york", number(F.lit("the"), 0)).otherwise(number(word, 0)) if seed == 0 else number(word, seed)

    monkeypatch.setattr(aggregates, "_word_number", clash)
    monkeypatch.setattr(aggregates, "_FREQUENT", frequent)
    lists = [[w for w in (t or "").split(" ") if w] for t in texts]
    single, double = Counter(w for ws in lists for w in ws), Counter(p for ws in lists for p in zip(ws, ws[1:]))
    n = sum(single.values())

    def ll(k, m, p):
        return k * math.log(max(p, 1e-10)) + (m - k) * math.log(max(1 - p, 1e-10))

    want = {}
    for (a, b), c12 in double.items():
        c1, c2 = single[a], single[b]
        score = -2 * (ll(c12, c1, c2 / n) + ll(c2 - c12, n - c1, c2 / n) - ll(c12, c1, c12 / c1) - ll(c2 - c12, n - c1, (c2 - c12) / (n - c1)))
        if score > 2.0:
            want[a, b] = (c12, c1, c2, round(score, 6))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = aggregates.bigram_collocations(df, F.split("t", " "), 2.0).collect()
    assert {(r.first, r.second): (r.n_pair, r.n_first, r.n_second, round(r.score, 6)) for r in found} == want
    assert len(found) == len(want) and seeds == {0, 1}


def test_year_histogram_edges(spark):
    def bins(years):
        df = spark.createDataFrame([(y,) for y in years], "year int")
        return [(r.bin, r.n) for r in aggregates.year_histogram(df).orderBy("bin").collect()]

    assert bins([2000, 2000, 2003, 2004, None]) == [(2000, 2), (2001, 0), (2002, 0), (2003, 2)]
    assert bins([2000, 2000]) == []


def test_sampling(spark):
    """The drawn tokens follow the filtered distribution, and a seed repeats them."""
    rows = [("a", "b", 60, 0.6), ("a", "c", 30, 0.3), ("a", "d", 10, 0.1), ("b", "a", 5, 1.0), ("c", "a", 5, 1.0), ("d", "x", 1, 1.0)]
    grams = spark.createDataFrame(rows, "context string, next string, n long, share double")
    prompts = spark.createDataFrame([(i, "z a") for i in range(300)] + [(999, "unknown")], "prompt_id long, p string")
    knobs = dict(sequences=2, extra_tokens=1, temperature=1.0, top_p=0.95, repetition_penalty=1.0)
    got = suggestions.sample_next(prompts, grams, F.split("p", " "), **knobs).collect()
    drawn = [r.suggestion for r in got if r.prompt_id < 999]
    assert len(got) == 602 and all(r.suggestion == "" for r in got if r.prompt_id == 999)
    assert abs(drawn.count("b") / 600 - 0.6) < 0.07 and abs(drawn.count("d") / 600 - 0.1) < 0.05
    again = suggestions.sample_next(prompts.repartition(7), grams, F.split("p", " "), **knobs).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    other = suggestions.sample_next(prompts, grams, F.split("p", " "), seed=1, **knobs).collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, got))
    longer = suggestions.sample_next(prompts.limit(5), grams, F.split("p", " "), extra_tokens=3, top_k=1, repetition_penalty=1e9).collect()
    assert {r.suggestion for r in longer} == {"b a c"}  # after "a b a" the seen "b" gives way


def test_a_slice_of_words_bounds_the_encoder(spark):
    """Lists are encoded in slices, each different word once in a slice, whatever the size of a batch."""
    import pyarrow as pa

    asked = []

    def encode(word):
        asked.append(word)
        return [ord(c) for c in word if c != "x"]

    rows = [["ab", "c"] * 50, None, [], ["x", "ab", ""], ["é"]]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["w"])
    for most, parts in ((1, 4), (3, 3), (1000, 1)):
        asked.clear()
        cut = list(bpe._slices(batch, "w", most))
        got = [r for part in cut for r in bpe._encoded(part.column("w"), encode).to_pylist()]
        assert got == [None if r is None else [ord(c) for w in r for c in w if c != "x"] for r in rows]
        assert len(cut) >= parts - 1 and len(asked) <= 2 + 3 + 1
    model = bpe.BpeModel(bpe.byte_characters(), [])
    df = spark.createDataFrame([(0, "été 42"), (1, None), (2, ""), (3, "a b")], "i int, t string")
    back = bpe.bpe_encode(df, "t", model).withColumn("back", bpe.bpe_decode(F.col("token_ids"), model)).orderBy("i").collect()
    assert [r.back for r in back] == ["été 42", None, "", "a b"] and back[1].token_ids is None


def test_totals_of_grams_need_no_join(spark):
    """Totals need no join; nulls and short lists are as ever."""
    df = spark.createDataFrame([("a b a b c",), ("x",), ("",), (None,)], "t string")
    counts = aggregates.ngram_counts(df, F.split("t", " "), 3)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    got = {(r.context, r.next): (r.n, round(r.share, 4)) for r in counts.collect()}
    assert got == {("a b", "a"): (1, 0.5), ("b a", "b"): (1, 1.0), ("a b", "c"): (1, 0.5)}
    assert {(r.context, r.next): r.n for r in aggregates.ngram_counts(df, F.split("t", " "), 1).collect()} == {
        ("", "a"): 2, ("", "b"): 2, ("", "c"): 1, ("", "x"): 1, ("", ""): 1}
