"""Hand-worked results of the text operators."""

import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
import pytest

from paperloom.functions import fixed, predicates, text, vectors


def test_clean_text_is_one_pass(column):
    assert column(text.clean_text, ["a\nb", " a    b ", " x ", None]) == ["a b", "a  b", "x", None]


def test_whitespace_is_the_unicode_set():
    assert len(set(fixed.WHITESPACE)) == 29 and all(c.isspace() for c in fixed.WHITESPACE)


def test_derive_year(spark):
    kind = "j string, v array<struct<version:string,created:string>>"
    late = [("v1", "Mon, 2 Apr 2007 19:18:42 GMT"), ("v2", "Tue, 3 Jun 2008 01:00:00 GMT")]
    rows = [("X,2007", late), ("X, 2007 ", late), ("Nature, 12", late), ("X 2007", late), (None, late), (None, [])]
    df = spark.createDataFrame(rows, kind)
    years = [r[0] for r in df.select(text.derive_year(F.col("j"), F.col("v"))).collect()]
    assert years == [2007, 2007, 12, 2008, 2008, None]
    with pytest.raises(Exception, match="no year"):
        df.select(text.derive_year(F.col("j"), F.col("v"), strict=True)).collect()


def test_categories(column):
    names = lambda c: text.map_categories(c)
    assert column(names, ["cs.NA math.NA hep-th", "hep-th", "astro-ph.EP cs.LG"]) == [
        ["Numerical Analysis"] * 2, [], ["Earth and Planetary Astrophysics", "Machine Learning"]]
    assert column(lambda c: text.category_string(names(c)), ["cs.LG stat.ML"]) == ["Machine Learning,Machine Learning,"]
    assert len(fixed.CATEGORY_NAMES) == 72 and len(set(fixed.CATEGORY_NAMES.values())) == 68
    assert column(text.category_from_name, ["/d/cat1-01.md", "cat2.md"]) == ["cat1", "cat2.md"]


def test_markdown(column):
    cases = {
        "# Title\n\nSome *slanted* and **bold** text": "Title Some slanted and bold text",
        "a ![i](x.png) b ![j](y.png) c": "a c",
        "see [one](u) and [two](v) end": "see end",
        "[one](u)\nkept\n[two](v)": " kept ",
        "snake\\_case and __init__": "snake_case and init",
        "": "",
    }
    assert column(text.markdown_to_text, list(cases)) == list(cases.values())


def test_html(column):
    page = '<p>a &amp;lt; b</p><!-- <b>no</b> --><script>var t="</p>";</script><style>p{}</style>c&nbsp;d'
    assert column(text.html_to_text, [page]) == ["a &lt; bc\xa0d"]
    links = """<a href="/abs/arXiv:1">x</a><a class=k href='/ARXIV/2'>y</a><a data-href="/arxiv">n</a><a href=/doi>z</a>
    <!-- <a href="/arxiv/3"> -->"""
    assert column(lambda c: text.extract_links(c, "arxiv", "http://b"), [links]) == [["http://b/abs/arXiv:1", "http://b/ARXIV/2"]]


def test_sections_and_markup(column):
    assert column(text.slice_sections, ["x ABSTRACT y ABSTRACT z", "INTRODUCTION a Abstract b", "plain"]) == [" y ", " b", "plain"]
    assert column(text.strip_markup, ["~5 km<SUP>2</SUP> H<SUB>2</SUB>O {x}\t.<BR /> y <P /> <A />"]) == ["about 5 km^2 H_2O x .y"]


def _repaired(s: str) -> tuple[str, int]:
    raw = s.encode()
    for sequence, new in fixed.BYTE_RULES:
        raw = raw.replace(sequence, new.encode())
    return raw.decode("utf-8", "ignore").replace("�", ""), len(raw)


def test_repair_bytes(column):
    cases = ["eﬃcient ﬁt ﬂow oﬀ", "it’s 5 μm × 3 ⊙", "à Ü β ± 1", "a\tb     c", "α–β − §2", None]
    want = [None if c is None else _repaired(c) for c in cases]
    assert column(text.repair_bytes, cases) == [w and w[0] for w in want]
    assert column(text.repaired_length, cases) == [w and w[1] for w in want]
    assert column(text.repair_bytes, ["eﬃcient"]) == ["eficient"]
    assert column(lambda c: text.repair_bytes(c, safe=True), ["à Ü ﬁ"]) == ["à Ü fi"]


def test_repair_bytes_on_any_text(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=1, max_size=40))
    def check(values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, c string").coalesce(1)
        got = df.select("i", text.repair_bytes(F.col("c")).alias("o")).orderBy("i").collect()
        assert [r.o for r in got] == [_repaired(v)[0] for v in values]

    check()


def test_journal_bodies(spark):
    rows = [
        (fixed.SCIENCE, "head\n\n1\n\nbody [1, 2] more\n3\n\nend References [x]", "body  moreend "),
        (fixed.SCIENCE, "no marker [1] References z", "no marker [1] "),
        (fixed.APJ, "t ABSTRACT\nabs Introduction\nbody\n2. next", "body"),
        (fixed.APJ, "plain", "plain"),
        (fixed.MNRAS, "t ABSTRACT\nabs INTRODUCTION\nbody\n2 next", "body"),
        ("Nature", "anything", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, pub string, t string, want string").orderBy("i")
    got = df.select(text.journal_body(F.col("t"), F.col("pub")).alias("o"), "want").collect()
    assert [r.o for r in got] == [r.want for r in got]


def test_brackets_and_cleanup(column):
    assert column(text.remove_brackets, ["[1] a [2]b", "open [ stays", "a] b"]) == [" a b", "open [ stays", "a] b"]
    assert column(text.cleanup_pdf_text, ["hyphen- ated\nline\x0c    x"]) == ["hyphenated line  x"]


def test_tokens(column):
    got = column(lambda c: text.normalize_tokens(c, ["the", "of"]), ["The Surface of Mars, (a) x... don't () ./"])
    assert got == ["surface mars a x ... don't"]
    assert column(text.tfidf_tokens, ["A bc, d_e É12"]) == [["bc", "d_e", "é12"]]


def test_chunks(column):
    assert column(lambda c: text.chunk_words(c, 4), ["a b c d e", " ", "", "a"]) == [["a b c d", "c d e", "e"], [], [], ["a"]]
    assert column(lambda c: text.chunk_words(c, 3), ["a b c"]) == [["a b c", "b c", "c"]]
    with pytest.raises(ValueError):
        text.chunk_words(F.col("c"), 1)
    assert column(text.chunk_sentences, ["One. Two?  Three"]) == [["One.", "Two?", "Three"]]
    assert column(text.chunker("newline"), ["a\n\nb"]) == [["a", "", "b"]]
    assert column(text.chunker("unknown"), ["a b"]) == [["a b"]]


def test_chunks_cover_every_word(spark):
    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.text("ab \n", max_size=30), min_size=1, max_size=10), st.integers(2, 7))
    def check(values, size):
        df = spark.createDataFrame(list(enumerate(values)), "i int, c string").coalesce(1)
        for r in df.select("c", text.chunk_words(F.col("c"), size).alias("o")).collect():
            w, step = r.c.split(), size // 2
            assert list(r.o) == [" ".join(w[i:i + size]) for i in range(0, len(w), step)]

    check()


def test_prompt_helpers(column, spark):
    assert column(lambda c: text.trim_context_tokens(c, 2), [["a", "b", "c"], ["a"], []], "array<string>") == [["b", "c"], ["a"], []]
    assert column(lambda c: text.trim_context_chars(c, 3), ["abcdef", "a"]) == ["def", "a"]
    df = spark.createDataFrame([("ab x ab ", "ab"), ("abc", "")], "g string, p string")
    assert [r[0] for r in df.select(text.strip_prompt(F.col("g"), F.col("p"), True)).collect()] == ["x", "abc"]
    paper = spark.createDataFrame([("T", "2016A", "abs", None)], "title string, bibcode string, abstract string, year int")
    link = paper.select(text.paper_link(F.col("title"), F.col("bibcode"), F.col("abstract"))).first()[0]
    assert link == ('T<br><br>abs<br><br><a href="https://ui.adsabs.harvard.edu/abs/2016A/abstract" '
                    'target="_blank">2016A</a>')
    assert paper.select(text.paper_repr(["bibcode", "year"])).first()[0] == "bibcode:2016A, year:None"


def test_word_lists():
    assert len(fixed.OFF_TOPIC_WORDS) == 64 and len(fixed.PROFILE_OFF_TOPIC_WORDS) == 65
    kept = predicates.irreducible(fixed.PROFILE_OFF_TOPIC_WORDS)
    assert "Galaxy" not in kept and "Ga" in kept and "cluster" in kept and "open clusters" not in kept


def test_predicates(column):
    hit = lambda c: predicates.contains_any([c], ["galaxy", "Ga"])
    assert column(hit, ["a galaxy", "Gamma", "gamma", "", None]) == [True, True, False, False, False]
    assert column(lambda c: predicates.non_blank(c), ["x", "", None]) == [True, False, False]
    assert column(predicates.unprocessed, ["x", "", None]) == [False, True, True]
    assert column(lambda c: predicates.query_in_text(c, "ExoPlanet"), ["An EXOPLANET", "x", None]) == [True, False, False]
    assert column(lambda c: predicates.query_in_text(c, "q", loose=True), ["x"]) == [True]
    sized = ["a " + "b" * 98, "a " + "b" * 99, "b" * 101, None, "é " + "b" * 98]
    assert column(predicates.has_space_and_min_bytes, sized) == [False, True, False, False, True]


def test_vectors(column):
    got = column(lambda c: vectors.vector_to_csv(c), [[1.2e-5, -0.5, 3.0]], "array<float>")
    assert got == ["0.000012,-0.500000,3.000000"]
    back = column(vectors.csv_to_vector, ["0.000012,-0.5"])[0]
    assert abs(back[0] - 1.2e-5) < 5e-7 and back[1] == -0.5
    assert column(vectors.l2_normalize, [[3.0, 4.0], [0.0, 0.0]], "array<double>") == [[0.6, 0.8], None]


def test_rows_to_json(spark):
    from paperloom.sources.sinks import rows_to_json

    row = spark.createDataFrame([(None, "x")], "year int, title string").select(rows_to_json(["title", "year"])).first()[0]
    assert list(json.loads(row).items()) == [("title", "x"), ("year", None)]


def test_character_references(column):
    cases = [("a &amp; b", "a & b"), ("&#233;&#xE9;&eacute;&Eacute;", "éééÉ"), ("&amp;lt;", "&lt;"), ("&unknown; & &#; &#x;", "&unknown; & &#; &#x;"), ("&#128512;&#0;&#xD800;&#x110000;", "\U0001f600\ufffd\ufffd\ufffd"),
             ("&&&lt;", "&&<"), ("no reference", "no reference"), ("", ""), (None, None), ("&apos;&quot;&nbsp;", "'\"\xa0"), ("&copy", "&copy")]
    assert column(text.decode_entities, [c for c, _ in cases]) == [w for _, w in cases]


def test_callable_chunker(column):
    assert column(text.chunker(lambda c: F.split(c, "-")), ["a-b", None]) == [["a", "b"], None]
