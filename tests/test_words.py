"""Learnt sentence boundaries on hand-split text, lemmas of words that no table holds."""

import random

from pyspark.sql import functions as F

from paperloom.operators import lemmas, sentences

NAMES = ["Smith", "Jones", "Miller", "Brown", "Davis", "Wilson"]
PLAIN = ["The star was seen in the north", "We measured the flux of the source", "It was bright", "The galaxy is far away", "Results are shown here",
         "We used a small telescope", "The data were reduced by hand", "It is a cold object", "The map was made in spring", "A second source was found"]


def golden(seed, n):
    """Texts and their sentences by hand: half of the sentences hold abbreviations with a period inside."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        own = []
        for _ in range(rng.randrange(3, 8)):
            plain = rng.choice(PLAIN)
            own.append(rng.choice([
                f"{plain}.", f"{plain}!", f"{plain}?", f"Dr. {rng.choice(NAMES)} said so.", f"See {rng.choice(NAMES)} et al. (1999) for more.",
                f"{plain}, cf. the notes of Prof. {rng.choice(NAMES)}.", f"The line in Fig. {rng.randrange(9)} is broad.", f"{plain}, e.g. in winter.", f"{plain}, i.e. not near.",
            ]))
        texts.append(own)
    return texts


def f1(found, expected):
    cut = lambda own: {len(" ".join(own[:i])) for i in range(1, len(own))}
    good = sum(len(cut(a) & cut(b)) for a, b in zip(found, expected))
    return 2 * good / (sum(len(cut(a)) for a in found) + sum(len(cut(b)) for b in expected))


def test_learnt_boundaries_beat_the_rule(spark):
    from paperloom.functions import text

    learn, held = golden(1, 400), golden(2, 150)
    df = spark.createDataFrame([(" ".join(own),) for own in learn], "t string")
    model = sentences.fit_sentences(df, "t")
    assert {"dr", "al", "prof", "fig", "e.g", "i.e", "cf"} <= set(model.abbreviations)
    assert not {"north", "source", "bright", "away", "here", "hand", "found"} & set(model.abbreviations)
    assert {"the", "we", "it"} <= set(model.starters)
    asked = spark.createDataFrame([(i, " ".join(own)) for i, own in enumerate(held)], "i int, t string")
    split = lambda c: [r.s for r in asked.select("i", c.alias("s")).orderBy("i").collect()]
    learnt, rule = f1(split(model.chunks(F.col("t"))), held), f1(split(text.chunk_sentences(F.col("t"))), held)
    assert learnt > 0.97 > rule


def test_without_abbreviations_the_rule_holds(spark, column):
    from paperloom.functions import text

    model = sentences.SentenceModel([], [], [])
    odd = ["One. Two?  Three", "", " ", "No end", "a.  ", "a.b c.", "...", "x!\n\ny", None]
    assert column(model.chunks, odd) == column(text.chunk_sentences, odd)
    model = sentences.SentenceModel(["dr", "a.b"], ["the"], ["dr the"])
    assert column(model.chunks, ["Dr. Who left. A.b. The end. (a.b. c) Dr. The x."]) == [["Dr. Who left.", "A.b.", "The end.", "(a.b. c) Dr. The x."]]


def test_lists_of_any_size(spark, tmp_path, monkeypatch):
    """The query needs no list on the driver; the sentences are those of the expression."""
    from paperloom.queries import QUERIES

    rows = [(i, " ".join(own)) for i, own in enumerate(golden(3, 300))] + [(7, "Dr. Smith left. "), (None, "a. b"), (900, None), (901, ""), (902, "e.g. The end.  We  know")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    model = sentences.fit_sentences(df, "text")
    expected = df.select("doc_id", F.posexplode(model.chunks(F.col("text"))).alias("chunk_ix", "chunk")).collect()
    monkeypatch.setattr(sentences, "MOST", 1)
    got = QUERIES["chunk_sentences_learnt"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_no_text_no_model(spark):
    model = sentences.fit_sentences(spark.createDataFrame([("",), (None,)], "t string"), "t")
    assert (model.abbreviations, model.starters, model.pairs) == ([], [], [])


def english():
    stems = [a + b + c for a in ("st", "tr", "pl", "gr", "m", "b", "cl") for b in ("o", "a", "ea") for c in ("mp", "nd", "rk", "lt", "st")]
    pairs = []
    for s in stems:
        pairs += [(s, s), (s + "s", s), (s + "ing", s), (s + "ed", s), (s + "ies", s + "y"), (s + "y", s + "y")]
    return pairs


def test_lemmas_of_unseen_words(spark):
    pairs = english()
    random.Random(3).shuffle(pairs)
    learn, held = pairs[:400], pairs[400:]
    table = spark.createDataFrame(learn, "token string, lemma string")
    endings = lemmas.fit_endings(table)
    guess = {r.token: r.guess for r in lemmas.lemmatise(spark.createDataFrame(held, "token string, lemma string"), endings).collect()}
    right = sum(guess[t] == lemma for t, lemma in held) / len(held)
    plain = sum(t == lemma for t, lemma in held) / len(held)
    assert right >= 0.95 > plain
    odd = spark.createDataFrame([("qqzx",), ("s",), ("ing",), ("",), (None,), ("日本ing",), ("logs",)], "token string")
    assert {r.token: r.guess for r in lemmas.lemmatise(odd, endings).collect()} == {"qqzx": "qqzx", "s": "s", "ing": "ing", "": "", "日本ing": "日本", "logs": "log"}
    tokens = spark.createDataFrame([(1, "went"), (2, "plandies"), (3, "logs"), (3, "logs"), (4, None)], "i int, token string")
    known = table.unionByName(spark.createDataFrame([("went", "go")], "token string, lemma string"))
    assert sorted((r.i, r.lemma) for r in lemmas.lemmatise_tokens(tokens, known, endings).collect() if r.token) == [(1, "go"), (2, "plandy"), (3, "log"), (3, "log")]
    assert lemmas.fit_endings(table.limit(0)).count() == 0


def test_a_small_lemma_table_moves_no_tokens(spark, monkeypatch):
    """Texts keep their place; repeated and null keys, and several lemmas of a token, are as with a join."""
    from paperloom.operators import relations

    table = spark.createDataFrame([("stars", "star"), ("data", "datum"), ("data", "Data "), ("x", None), (None, "y"), ("gone", "the")], "token string, lemma string")
    df = spark.createDataFrame([(1, "Stars, data x"), (2, "gone the"), (3, "b a"), (3, "stars c d"), (None, "stars"), (4, None), (5, "")], "k int, t string")

    def got(rows):
        return sorted((str(r.k), r.t or "", r.processed) for r in relations.normalize_with_lemmas(rows, "k", "t", table, ["the"]).collect())

    near = got(df)
    plain = relations.normalize_with_lemmas(df.where("k < 3"), "k", "t", table, ["the"])
    assert "Aggregate" not in plain._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(relations, "BROADCAST_BYTES", 0)
    assert near == got(df)
    assert ("1", "Stars, data x", "star data datum x") in near and ("None", "stars", "") in near
