"""Scalar text operators over documents, pages and orders."""

from pyspark.sql import functions as F

from paperloom.functions import fixed, text
from paperloom.operators import lemmas, sentences
from paperloom.operators.relations import format_search_result, normalize_with_lemmas
from paperloom.queries.base import between, lit, query, regexes, replaces, staged

STOP_WORDS = ["the", "of", "and", "le", "la", "der", "und", "el"]
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
WS = lit(fixed.WHITESPACE)
WS_RUN = lit(fixed.WHITESPACE_RUN)
TOKENS_SQL = f"regexp_extract_all(lower(text), {lit(fixed.WORD_RUN)})"
RAW_TOKENS_SQL = f"regexp_extract_all(lower(text), {lit(fixed.TOKEN_OR_SYMBOL)})"


def words_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, {WS_RUN}), lambda w: w <> '')"


def _text(t, expression, name="c"):
    return t.spread("documents").select("doc_id", expression.alias(name))


SPACED = [(". ", " \n  \n "), (", ", "   ")]


# The references that the test pages hold, and some more; the ampersand comes last.
ENTITIES = [
    ("&nbsp;", "\xa0"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&middot;", "·"),
    ("&copy;", "©"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&hellip;", "…"),
    ("&amp;", "&"),
]


@query("clean_text", f"""
    SELECT doc_id, trim({replaces('text', SPACED + [(chr(10), ' '), ('  ', ' ')])}, {WS}) AS c FROM documents""")
def clean_text(t):
    return _text(t, text.clean_text(text.replace_all(F.col("text"), SPACED)))


@query("derive_year", """
    WITH d AS (
      SELECT o_orderkey,
        CASE o_orderstatus WHEN 'F' THEN NULL
          WHEN 'P' THEN 'J. X ' || o_orderkey || ', ' || year(o_orderdate)
          ELSE 'J. X ' || o_orderkey END AS j,
        strftime(o_orderdate, '%a, %-d %b %Y %H:%M:%S GMT') AS created
      FROM orders),
    p AS (SELECT *, trim(string_split(j, ',')[-1]) AS last_part FROM d)
    SELECT o_orderkey, coalesce(
      CASE WHEN regexp_full_match(last_part, '[+-]?[0-9]+') THEN CAST(last_part AS INTEGER) END,
      CAST(string_split(created, ' ')[4] AS INTEGER)) AS year
    FROM p""")
def derive_year(t):
    journal = (
        F.when(F.col("o_orderstatus") == "F", F.lit(None).cast("string"))
        .when(F.col("o_orderstatus") == "P", F.concat(
            F.lit("J. X "), F.col("o_orderkey").cast("string"), F.lit(", "), F.year("o_orderdate").cast("string")))
        .otherwise(F.concat(F.lit("J. X "), F.col("o_orderkey").cast("string")))
    )
    created = F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss 'GMT'")
    versions = F.array(F.struct(F.lit("v1").alias("version"), created.alias("created")))
    return t.orders.select("o_orderkey", text.derive_year(journal, versions).alias("year"))


CATEGORIES = {"en": "English", "fr": "Romance", "es": "Romance", "src1": "First", "src3": "Third", "src5": "Third"}
CATEGORY_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in CATEGORIES.items())


@query("map_categories", f"""
    WITH m(code, name) AS (VALUES {CATEGORY_ROWS}),
    codes AS (SELECT doc_id, unnest([lang, source]) AS code, unnest([1, 2]) AS pos FROM documents)
    SELECT doc_id, string_agg(name, ',' ORDER BY pos) || ',' AS categories
    FROM codes JOIN m USING (code) GROUP BY doc_id""")
def map_categories(t):
    names = text.map_categories(F.concat("lang", F.lit(" "), "source"), CATEGORIES)
    named = t.documents.select("doc_id", names.alias("n")).filter(F.size("n") > 0)
    return named.select("doc_id", text.category_string(F.col("n")).alias("categories"))


@query("category_from_name", "SELECT doc_id, source AS category FROM documents")
def category_from_name(t):
    path = F.concat(F.lit("/data/md/"), "source", F.lit("-"), F.col("doc_id").cast("string"), F.lit("-a.md"))
    return _text(t, text.category_from_name(path), "category")


HIDDEN = [
    (r"(?s)<!--.*?-->", ""), (r"(?is)<script\b.*?</script\s*>", ""),
    (r"(?is)<style\b.*?</style\s*>", ""), (r"(?is)<template\b.*?</template\s*>", ""),
]
TAGS = [(r"</?[a-zA-Z!?][^>]*>", "")]


@query("html_to_text", f"""
    SELECT page_id, {replaces(regexes('html', HIDDEN + TAGS), ENTITIES)} AS c FROM pages""")
def html_to_text(t):
    return t.spread("pages").select("page_id", text.html_to_text(F.col("html")).alias("c"))


LINK_SQL = r"""(?is)<a(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


@query("extract_links", f"""
    WITH h AS (
      SELECT page_id, list_transform(
        regexp_extract_all({regexes('html', HIDDEN)}, {lit(LINK_SQL)}, 1),
        lambda x: {replaces("trim(x, chr(34) || chr(39))", ENTITIES)}) AS hrefs FROM pages),
    k AS (SELECT page_id, list_filter(hrefs, lambda x: contains(lower(x), 'th')) AS kept FROM h)
    SELECT page_id, '{fixed.SERVICE_URL}' || link AS link, count(*) AS n
    FROM (SELECT page_id, unnest(kept) AS link FROM k) GROUP BY ALL""")
def extract_links(t):
    links = t.spread("pages").select("page_id", F.explode(text.extract_links(F.col("html"), "th")).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


MARKDOWN = [(", ", " **bold** *slanted*, "), (". ", ". `code`__ \\\n> quoted "), ("\n", "\n![fig](a.png) x [a](b)\n## ")]
MARKDOWN_SQL = [
    (p.replace("(?dm)", "(?m)").replace("(?d)", ""), k.replace("$1", "\\1")) for p, k in text.MARKDOWN_RULES
]
MARKDOWN_STEPS = [
    replaces("c", MARKDOWN), regexes("c", MARKDOWN_SQL), replaces(regexes("c", HIDDEN + TAGS), ENTITIES),
    "replace(c, chr(10), ' ')", regexes("c", [(" +", " ")]), replaces("c", [("\\", ""), ("__", "")]),
]


@query("markdown_to_text", staged("SELECT doc_id, text AS c FROM documents", MARKDOWN_STEPS, "doc_id"))
def markdown_to_text(t):
    return _text(t, text.markdown_to_text(text.replace_all(F.col("text"), MARKDOWN)))


SECTIONED = [(", ", " ABSTRACT "), (".\n", " Abstract \n"), (". ", " INTRODUCTION ")]


@query("slice_sections", staged(
    f"SELECT doc_id, {replaces('text', SECTIONED)} AS c FROM documents",
    [between("c", m) for m in fixed.SECTION_MARKERS], "doc_id"))
def slice_sections(t):
    return _text(t, text.slice_sections(text.replace_all(F.col("text"), SECTIONED)))


MARKED = [(", ", "<SUP>2</SUP>~{x}\t"), (". ", "<BR /> <SUB>a</SUB> <P /> <A />\r")]


@query("strip_markup", f"SELECT doc_id, {replaces('text', MARKED + fixed.MARKUP_RULES)} AS c FROM documents")
def strip_markup(t):
    return _text(t, text.strip_markup(text.replace_all(F.col("text"), MARKED)))


def _hex(s: bytes) -> str:
    return "".join(f"{b:02X} " for b in s)


BROKEN = [(". ", " ﬁ ﬂ ± β "), (", ", "’ μm × ⊙ ")]
VALID_UTF8 = (
    "[0-7][0-9A-F] |(?:C[2-9A-F]|D[0-9A-F]) [89AB][0-9A-F] |E0 [AB][0-9A-F] [89AB][0-9A-F] |"
    "(?:E[1-9ABCEF]) (?:[89AB][0-9A-F] ){2}|ED [89][0-9A-F] [89AB][0-9A-F] |"
    "F0 [9AB][0-9A-F] (?:[89AB][0-9A-F] ){2}|F[1-3] (?:[89AB][0-9A-F] ){3}|F4 8[0-9A-F] (?:[89AB][0-9A-F] ){2}"
)
HEX_STEPS = [
    "regexp_replace(hex(encode(c)), '(..)', '\\1 ', 'g')",
    replaces("c", [(_hex(a), _hex(b.encode())) for a, b in fixed.BYTE_RULES]),
]
DECODE_STEP = f"decode(unhex(replace(array_to_string(regexp_extract_all(c, '{VALID_UTF8}'), ''), ' ', '')))"


@query("repair_bytes", f"""
    SELECT doc_id, {DECODE_STEP} AS c, CAST(length(c) / 3 AS INTEGER) AS n_bytes
    FROM ({staged(f"SELECT doc_id, {replaces('text', BROKEN)} AS c FROM documents", HEX_STEPS, "doc_id")})""")
def repair_bytes(t):
    raw = text.replace_all(F.col("text"), BROKEN)
    return t.spread("documents").select(
        "doc_id", text.repair_bytes(raw).alias("c"), text.repaired_length(raw).alias("n_bytes"))


BODY = [(". ", ". [3] \n7\n\n"), (",\n", "\n2.\n"), (", ", "\n2 "), (".\n", "\n\n1\n\n")]
BODY_SQL = f"'ABSTRACT' || chr(10) || {replaces('text', BODY)} || 'Introduction' || chr(10) || text || 'References'"
PUB_SQL = f"CASE lang WHEN 'en' THEN '{fixed.SCIENCE}' WHEN 'fr' THEN '{fixed.APJ}' WHEN 'de' THEN '{fixed.MNRAS}' ELSE 'Other' END"


def journal_sql(source: str, keys: str) -> str:
    """Section rules over a source with columns ``pub`` and ``c``."""
    numbered = replaces("h", [(f"\n{i}\n\n", "") for i in range(20)])
    return f"""
    SELECT {keys}, CASE pub
      WHEN '{fixed.SCIENCE}' THEN CASE WHEN contains(head, chr(10) || chr(10) || '1' || chr(10) || chr(10))
        THEN regexp_replace({numbered}, '\\[[^\\]]*\\]', '', 'g') ELSE head END
      WHEN '{fixed.APJ}' THEN split_part(apj, chr(10) || '2.', 1)
      WHEN '{fixed.MNRAS}' THEN split_part(mnras, chr(10) || '2 ', 1) END AS c
    FROM (SELECT *, {between('head', chr(10) * 2 + '1' + chr(10) * 2)} AS h,
            {between('a', 'Introduction' + chr(10))} AS apj, {between('a', 'INTRODUCTION' + chr(10))} AS mnras
          FROM (SELECT *, split_part(c, 'References', 1) AS head, {between('c', 'ABSTRACT' + chr(10))} AS a
                FROM ({source})))"""


def article(df):
    """Documents dressed as extracted article text, with a journal by language."""
    pub = (
        F.when(F.col("lang") == "en", fixed.SCIENCE).when(F.col("lang") == "fr", fixed.APJ)
        .when(F.col("lang") == "de", fixed.MNRAS).otherwise("Other")
    )
    body = F.concat(
        F.lit("ABSTRACT\n"), text.replace_all(F.col("text"), BODY), F.lit("Introduction\n"), "text", F.lit("References")
    )
    return df.withColumn("pub", pub).withColumn("body", body)


@query("journal_body", journal_sql(f"SELECT doc_id, {PUB_SQL} AS pub, {BODY_SQL} AS c FROM documents", "doc_id"))
def journal_body(t):
    return article(t.spread("documents")).select("doc_id", text.journal_body(F.col("body"), F.col("pub")).alias("c"))


BRACKETED = [(". ", ". [1, 2] "), (", ", " [3\n4] ]["), ("\n", " [x\n")]


@query("remove_brackets", f"""
    SELECT doc_id, {regexes(replaces('text', BRACKETED), [(r'\[[^\]]*\]', '')])} AS c FROM documents""")
def remove_brackets(t):
    return _text(t, text.remove_brackets(text.replace_all(F.col("text"), BRACKETED)))


PRINTED = [(", ", "- "), (". ", "\x0c   ")]
CLEANUP = [("\n", " "), ("- ", ""), ("\x0c", ""), ("  ", " ")]


@query("cleanup_pdf_text", f"SELECT doc_id, {replaces('text', PRINTED + CLEANUP)} AS c FROM documents")
def cleanup_pdf_text(t):
    return _text(t, text.cleanup_pdf_text(text.replace_all(F.col("text"), PRINTED)))


@query("normalize_tokens", f"""
    SELECT doc_id, array_to_string(list_filter({RAW_TOKENS_SQL},
      lambda w: NOT list_contains({STOP_SQL}, w) AND instr({lit(fixed.PUNCTUATION)}, w) = 0 AND w <> ''), ' ') AS c
    FROM documents""")
def normalize_tokens(t):
    return _text(t, text.normalize_tokens(F.col("text"), STOP_WORDS))


LEMMA_SQL = f"""
    SELECT DISTINCT token, left(token, length(token) - 1) AS lemma
    FROM (SELECT unnest({RAW_TOKENS_SQL}) AS token FROM conversations) WHERE token LIKE '%_s'"""


def lemma_table(t):
    """A lemma table derived from the conversations: a final s is dropped."""
    tokens = t.conversations.select(F.explode(text.raw_tokens(F.col("text"))).alias("token")).distinct()
    ends = tokens.filter((F.length("token") > 1) & F.endswith("token", F.lit("s")))
    return ends.select("token", F.expr("left(token, length(token) - 1)").alias("lemma"))


@query("normalize_with_lemmas", f"""
    WITH l AS ({LEMMA_SQL}),
    tok AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos
            FROM (SELECT doc_id, {RAW_TOKENS_SQL} AS t FROM documents)),
    lem AS (SELECT doc_id, pos, coalesce(lemma, token) AS lemma FROM tok LEFT JOIN l USING (token)),
    kept AS (SELECT * FROM lem WHERE NOT list_contains({STOP_SQL}, lemma)
             AND instr({lit(fixed.PUNCTUATION)}, lemma) = 0 AND lemma <> '')
    SELECT d.doc_id, coalesce(c, '') AS c FROM documents d
    LEFT JOIN (SELECT doc_id, string_agg(lemma, ' ' ORDER BY pos) AS c FROM kept GROUP BY doc_id) k USING (doc_id)""")
def normalized_with_lemmas(t):
    out = normalize_with_lemmas(t.spread("documents").select("doc_id", "text"), "doc_id", "text", lemma_table(t), STOP_WORDS)
    return out.select("doc_id", F.col("processed").alias("c"))


# Edits of the ends of words: what is kept is found letter by letter.
ENDINGS_SQL = f"""
    l AS ({LEMMA_SQL}),
    kept AS (SELECT token, lemma, list_max(list_filter(range(0, least(length(token), length(lemma)) + 1), lambda n: left(token, n) = left(lemma, n))) AS k FROM l),
    edits AS (SELECT token, length(token) - k AS cut, substr(lemma, k + 1) AS add FROM kept WHERE k >= 2),
    sizes AS (SELECT unnest(range(1, 7)) AS size),
    ending_counts AS (SELECT right(token, size) AS ending, cut, add, count(*) AS n FROM edits, sizes WHERE size <= length(token) AND size >= greatest(cut, 1) GROUP BY ALL),
    ending_totals AS (SELECT right(token, size) AS ending, count(*) AS total FROM l, sizes WHERE size <= length(token) GROUP BY ALL),
    endings AS (SELECT ending, cut, add, n FROM ending_counts JOIN ending_totals USING (ending)
      QUALIFY row_number() OVER (PARTITION BY ending ORDER BY n DESC, cut, add) = 1 AND n >= 2 AND n >= 0.3 * total)"""


@query("fit_endings", f"WITH {ENDINGS_SQL} SELECT ending, cut, add, n FROM endings")
def fit_endings(t):
    return lemmas.fit_endings(lemma_table(t))


@query("lemmatise_tokens", f"""
    WITH {ENDINGS_SQL},
    tok AS (SELECT unnest({RAW_TOKENS_SQL}) AS token FROM documents),
    unseen AS (SELECT DISTINCT token FROM tok ANTI JOIN l USING (token)),
    guessed AS (SELECT token, left(token, length(token) - cut) || add AS lemma FROM unseen, sizes JOIN endings ON ending = right(token, size)
      WHERE size <= length(token) AND length(token) - cut >= 2 QUALIFY row_number() OVER (PARTITION BY token ORDER BY size DESC) = 1)
    SELECT token, coalesce(l.lemma, g.lemma, token) AS lemma, count(*) AS n FROM tok LEFT JOIN l USING (token) LEFT JOIN guessed g USING (token) GROUP BY ALL""")
def lemmatise_tokens(t):
    table = lemma_table(t)
    tokens = t.spread("documents").select(F.explode(text.raw_tokens(F.col("text"))).alias("token"))
    return lemmas.lemmatise_tokens(tokens, table, lemmas.fit_endings(table)).groupBy("token", "lemma").agg(F.count("*").alias("n"))


@query("tfidf_tokens", f"SELECT doc_id, array_to_string({TOKENS_SQL}, ' ') AS c FROM documents")
def tfidf_tokens(t):
    return _text(t, F.array_join(text.tfidf_tokens(F.col("text")), " "))


def _chunks(t, chunks):
    return t.spread("documents").select("doc_id", F.posexplode(chunks).alias("chunk_ix", "chunk"))


def _chunks_sql(chunks: str) -> str:
    return f"""
    SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS chunk_ix, unnest(l) AS chunk
    FROM (SELECT doc_id, {chunks} AS l FROM documents)"""


@query("chunk_words", f"""
    WITH d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(0, len(w), 50)) AS b FROM d)
    SELECT doc_id, CAST(b // 50 AS INTEGER) AS chunk_ix, array_to_string(w[b + 1 : b + 100], ' ') AS chunk FROM s""")
def chunk_words(t):
    return _chunks(t, text.chunk_words(F.col("text"), 100))


@query("chunk_sentences", _chunks_sql(
    r"string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1))"))
def chunk_sentences(t):
    return _chunks(t, text.chunk_sentences(F.col("text")))


SPACES = r"[ \t\n\x0b\f\r]"
_OPEN_SQL, _CLOSE_SQL = (lit(x) for x in (sentences._OPEN, sentences._CLOSE))


def _bare_sql(word: str) -> str:
    return f"regexp_replace(regexp_replace(lower({word}), {_OPEN_SQL}, ''), {_CLOSE_SQL}, '')"


def _type_sql(word: str) -> str:
    return f"regexp_replace({_bare_sql(word)}, '\\.$', '')"


def _fit_sql(k: str, n: str, p: str) -> str:
    return f"({k} * ln(least(greatest({p}, 1e-12), 1 - 1e-12)) + ({n} - {k}) * ln(1 - least(greatest({p}, 1e-12), 1 - 1e-12)))"


def _ratio_sql(both: str, first: str, second: str, total: str) -> str:
    rest = f"greatest({total} - {first}, 1e-9)"
    p, p1, p2 = f"({second} / {total})", f"({both} / {first})", f"(greatest({second} - {both}, 0) / {rest})"
    return f"""CASE WHEN {both} / {first} > {p} THEN -2 * ({_fit_sql(both, first, p)} + {_fit_sql(f'({second} - {both})', rest, p)}
      - {_fit_sql(both, first, p1)} - {_fit_sql(f'({second} - {both})', rest, p2)}) ELSE 0 END"""


ABBREVIATIONS = f"""
    ww AS (SELECT list_filter(regexp_split_to_array(text, {lit(SPACES + "+")}), lambda w: w <> '') AS w FROM documents),
    bare AS (SELECT {_bare_sql("w")} AS w FROM (SELECT unnest(w) AS w FROM ww)),
    marked AS (SELECT w, w LIKE '%.' AND w NOT LIKE '%..' AND length(w) > 1 AS period FROM bare WHERE w <> ''),
    types AS (SELECT CASE WHEN period THEN left(w, length(w) - 1) ELSE w END AS type, count_if(period)::DOUBLE AS k, count(*)::DOUBLE AS n FROM marked GROUP BY ALL),
    overall AS (SELECT sum(k) / sum(n) AS share FROM types),
    parted AS (SELECT *, length(type) - length(replace(type, '.', '')) AS periods FROM types, overall
               WHERE k > 0 AND regexp_matches(type, '\\p{{L}}') AND NOT regexp_matches(type, '\\d')),
    abbreviation_scores AS (SELECT type, k, n, -2 * ({_fit_sql("k", "n", "share")} - {_fit_sql("k", "n", "0.99")}) * exp(-(length(type) - periods)) * (periods + 1)
      * pow(length(type) - periods, -(n - k)) AS score FROM parted),
    abbreviations AS (SELECT coalesce(list(type), []) AS abbreviations FROM abbreviation_scores WHERE score >= {sentences.ABBREVIATION})"""

# The learnt lists, then the rule's pieces put together again where no sentence ends.
LEARNT_CHUNKS = f"""
    WITH {ABBREVIATIONS},
    adjacent AS (SELECT unnest(w[1 : len(w) - 1]) AS a, unnest(w[2 : len(w)]) AS b FROM ww),
    told AS (SELECT a, b, period, (period AND NOT list_contains(abbreviations, a)) OR ends AS sure, count(*)::DOUBLE AS n
      FROM (SELECT {_type_sql("a")} AS a, {_type_sql("b")} AS b, a LIKE '%.' AS period, regexp_matches(a, '[!?]$') AS ends FROM adjacent), abbreviations GROUP BY ALL),
    sums AS (SELECT sum(n) AS every, coalesce(sum(n) FILTER (sure), 0) AS sure FROM told),
    begins AS (SELECT b, sum(n) AS n, sum(CASE WHEN sure THEN n ELSE 0 END) AS k FROM told GROUP BY b),
    starters AS (SELECT coalesce(list(b), []) AS starters FROM begins, sums WHERE k > 0 AND regexp_matches(b, '^\\p{{L}}') AND {_ratio_sql("k", "sure", "n", "every")} >= {sentences.STARTER}),
    firsts AS (SELECT a, sum(n) AS first FROM told WHERE period GROUP BY a),
    met AS (SELECT a, b, sum(n) AS met FROM told, abbreviations WHERE period AND list_contains(abbreviations, a) GROUP BY a, b HAVING sum(n) > 1),
    around AS (SELECT coalesce(list(a || ' ' || b), []) AS around FROM met JOIN firsts USING (a) JOIN (SELECT b, sum(n) AS second FROM told GROUP BY b) USING (b), sums, starters
      WHERE NOT list_contains(starters, b) AND {_ratio_sql("met", "first", "second", "every")} >= {sentences.PAIR}),
    parts AS (SELECT doc_id, string_split(regexp_replace(text, {lit("([.!?])(" + SPACES + ")")}, '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM documents),
    pieces AS (SELECT doc_id, len(p) AS size, unnest(p) AS piece, generate_subscripts(p, 1) AS i, unnest(list_append(p[2 : len(p)], '')) AS after FROM parts),
    ends AS (SELECT *, regexp_extract(piece, {lit("([^ \t\n\x0b\f\r]+)$")}, 1) AS word, regexp_extract(after, {lit("^" + SPACES + "+([^ \t\n\x0b\f\r]+)")}, 1) AS follows FROM pieces),
    cut AS (SELECT doc_id, i, piece, i < size AND (NOT (word LIKE '%.' AND list_contains(abbreviations, {_type_sql("word")}))
        OR (regexp_matches(regexp_replace(follows, {_OPEN_SQL}, ''), '^\\p{{Lu}}') AND list_contains(starters, {_type_sql("follows")})
            AND NOT list_contains(around, {_type_sql("word")} || ' ' || {_type_sql("follows")}))) AS done
      FROM ends, abbreviations, starters, around),
    whole AS (SELECT doc_id, string_split(regexp_replace(string_agg(piece || CASE WHEN done THEN chr(1) ELSE '' END, '' ORDER BY i), chr(1) || {lit(SPACES + "*")}, chr(1), 'g'), chr(1)) AS l FROM cut GROUP BY doc_id)
    SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS chunk_ix, unnest(l) AS chunk FROM whole"""


@query("abbreviation_scores", f"WITH {ABBREVIATIONS} SELECT type, CAST(k AS BIGINT) AS with_period, CAST(n - k AS BIGINT) AS without, round(score, 4) AS score FROM abbreviation_scores")
def abbreviation_scores(t):
    return sentences.abbreviation_scores(t.spread("documents"), F.col("text")).withColumn("score", F.round("score", 4))


@query("chunk_sentences_learnt", LEARNT_CHUNKS)
def chunk_sentences_learnt(t):
    found = sentences.learn_sentences(t.spread("documents"), "text")
    split = sentences.split_sentences(t.spread("documents").select("doc_id", "text"), "text", found)
    return split.select("doc_id", F.posexplode("sentences").alias("chunk_ix", "chunk"))


@query("chunk_newline", _chunks_sql("string_split(text, chr(10))"))
def chunk_newline(t):
    return _chunks(t, text.chunk_newline(F.col("text")))


@query("chunk_none", _chunks_sql("[text]"))
def chunk_none(t):
    return _chunks(t, text.chunker("anything else")(F.col("text")))


@query("distinct_words", """
    SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(text, ' '))), ' ') AS c FROM documents""")
def distinct_words(t):
    return _text(t, F.array_join(text.distinct_words(F.col("text")), " "))


@query("trim_context_tokens", f"""
    SELECT doc_id, array_to_string(w[greatest(len(w) - 40, 0) + 1 :], ' ') AS c
    FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)""")
def trim_context_tokens(t):
    return _text(t, F.array_join(text.trim_context_tokens(text.words(F.col("text")), 40), " "))


@query("trim_context_chars", "SELECT doc_id, right(text, 200) AS c FROM documents")
def trim_context_chars(t):
    return _text(t, text.trim_context_chars(F.col("text"), 200))


@query("strip_prompt", f"""
    SELECT doc_id, trim(replace(right(text, 200) || ' and ' || source || right(text, 200) || ' x ', right(text, 200), ''),
      {WS}) AS c FROM documents""")
def strip_prompt(t):
    prompt = text.trim_context_chars(F.col("text"), 200)
    generated = F.concat(prompt, F.lit(" and "), "source", prompt, F.lit(" x "))
    return _text(t, text.strip_prompt(generated, prompt, trim=True))


@query("paper_link", """
    SELECT doc_id, lang || '<br><br>' || text || '<br><br><a href="https://ui.adsabs.harvard.edu/abs/' || source
      || '/abstract" target="_blank">' || source || '</a>' AS c FROM documents""")
def paper_link(t):
    return _text(t, text.paper_link(F.col("lang"), F.col("source"), F.col("text")))


@query("paper_repr", """
    SELECT doc_id, 'doc_id:' || doc_id || ', lang:' || lang || ', quality:' || coalesce(CAST(quality AS VARCHAR), 'None') AS c
    FROM documents LEFT JOIN labels USING (doc_id)""")
def paper_repr(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    return joined.select("doc_id", text.paper_repr(["doc_id", "lang", "quality"]).alias("c"))


@query("first_or_scalar", """
    SELECT CAST(doc_id AS VARCHAR) AS bibcode, string_split(text, chr(10))[1] AS title, text AS abstract, source AS pub,
      CAST(n_chars AS INTEGER) AS year, 'exoplanet' AS categories FROM documents""")
def first_or_scalar(t):
    response = t.documents.select(
        F.col("doc_id").cast("string").alias("bibcode"), F.split("text", "\n").alias("title"),
        F.col("text").alias("abstract"), F.array("source").alias("pub"),
        F.col("n_chars").cast("string").alias("year"), F.split("text", " ").alias("keyword"),
    )
    return format_search_result(response, "exoplanet")
