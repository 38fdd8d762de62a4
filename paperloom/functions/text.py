"""Scalar text operators: every function maps Columns to a Column and stays in the JVM."""

from collections.abc import Callable, Mapping, Sequence

from html.entities import name2codepoint

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, functions as F

from paperloom.functions import fixed


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, also where a lambda uses it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_all(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for old, new in rules:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(fixed.WHITESPACE))


def words(c: Column) -> Column:
    """Words between runs of white space, without empty edges."""
    return F.filter(F.split(c, fixed.WHITESPACE_RUN), lambda w: w != "")


# --- titles, years, categories -----------------------------------------------------------------

def clean_text(c: Column) -> Column:
    """Newlines to spaces, one pass of two spaces to one, outer white space removed."""
    return strip(replace_all(c, [("\n", " "), ("  ", " ")]))


def derive_year(journal_ref: Column, versions: Column, strict: bool = False) -> Column:
    """Year after the last comma of the reference, else from the date of the last version."""
    from_journal = strip(F.element_at(F.split(journal_ref, ","), -1)).try_cast("int")
    created = F.get(versions, F.size(versions) - 1)["created"]
    from_version = F.get(F.split(created, " "), F.lit(3)).try_cast("int")
    year = F.coalesce(from_journal, from_version)
    if strict:
        year = F.coalesce(year, F.raise_error(F.lit("no year in reference or version")).cast("int"))
    return year


def map_categories(codes: Column, mapping: Mapping[str, str] = fixed.CATEGORY_NAMES) -> Column:
    """Names of the allowed codes of a space-separated list, in order, repeats kept."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    names = F.transform(F.split(codes, " "), lambda code: F.try_element_at(table, code))
    return F.filter(names, lambda name: name.isNotNull())


def category_string(names: Column) -> Column:
    """Stored form of a category list: every name followed by a comma."""
    return F.concat(F.array_join(names, ","), F.lit(","))


def category_from_name(path: Column) -> Column:
    """Base name of a file up to its first hyphen."""
    return F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("-"), F.lit(1))


# --- markup ------------------------------------------------------------------------------------

NAMED = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def decode_entities(c: Column) -> Column:
    """Character references, named and numeric, each decoded once; unknown ones stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, REFERENCE, 1)
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, F.lit(3), F.lit(8)), 16, 10)).otherwise(F.substring(name, F.lit(2), F.lit(8))).try_cast("int")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        character = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        return (
            F.when(name == "", F.concat(F.lit("&"), part))
            .when(name.startswith("#"), F.concat(character, rest))
            .otherwise(F.coalesce(F.concat(F.try_element_at(names, name), rest), F.concat(F.lit("&"), part)))
        )

    parts = F.split(c, "&")
    whole = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)


def drop_hidden_html(c: Column) -> Column:
    """Remove comments, doctype, scripts, styles and templates with their content."""
    for pattern in [
        r"(?s)<!--.*?-->",
        r"(?is)<script\b.*?</script\s*>",
        r"(?is)<style\b.*?</style\s*>",
        r"(?is)<template\b.*?</template\s*>",
    ]:
        c = F.regexp_replace(c, pattern, "")
    return c


def html_to_text(c: Column) -> Column:
    """Text nodes of a page."""
    return decode_entities(F.regexp_replace(drop_hidden_html(c), r"</?[a-zA-Z!?][^>]*>", ""))


# Markdown constructs and what remains of them, applied in this order.
MARKDOWN_RULES = [
    (r"(?d)!\[.*\]\(.*\)", ""),
    (r"(?d)\[.*\]\(.*\)", ""),
    (r"(?dm)^[ ]{0,3}#{1,6}[ \t]+", ""),
    (r"(?dm)^[ ]{0,3}>[ ]?", ""),
    (r"(?dm)^[ ]{0,3}(?:[-*+]|[0-9]+\.)[ \t]+", ""),
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"\*([^*\n]+)\*", "$1"),
    (r"`([^`\n]+)`", "$1"),
]


def markdown_to_text(c: Column) -> Column:
    """Plain text of a markdown document; images and links go together with their text."""
    for pattern, kept in MARKDOWN_RULES:
        c = F.regexp_replace(c, pattern, kept)
    c = F.replace(html_to_text(c), F.lit("\n"), F.lit(" "))
    return replace_all(F.regexp_replace(c, " +", " "), [("\\", ""), ("__", "")])


LINK_PATTERN = r"""(?is)<a(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def extract_links(html: Column, q: str = "arxiv", base_url: str = fixed.SERVICE_URL) -> Column:
    """Array of link targets whose lower-cased address contains ``q``, prefixed with ``base_url``."""
    raw = F.regexp_extract_all(drop_hidden_html(html), F.lit(LINK_PATTERN), F.lit(1))
    hrefs = F.transform(raw, lambda h: decode_entities(F.btrim(h, F.lit("\"'"))))
    hits = F.filter(hrefs, lambda h: F.contains(F.lower(h), F.lit(q)))
    return F.transform(hits, lambda h: F.concat(F.lit(base_url), h))


# --- corpus samples ----------------------------------------------------------------------------

def slice_sections(c: Column, markers: Sequence[str] = fixed.SECTION_MARKERS) -> Column:
    """Keep, marker by marker, the part between its first and its next occurrence."""
    for marker in markers:
        c = _between(c, marker)
    return c


def _between(c: Column, marker: str) -> Column:
    return bind(c, lambda v: F.when(
        F.contains(v, F.lit(marker)), F.split_part(v, F.lit(marker), F.lit(2))
    ).otherwise(v))


def _before(c: Column, marker: str) -> Column:
    return F.split_part(c, F.lit(marker), F.lit(1))


def strip_markup(c: Column) -> Column:
    return replace_all(c, fixed.MARKUP_RULES)


def _repaired_bytes(c: Column, safe: bool) -> Column:
    """The repaired UTF-8 bytes, one character (U+0000-00FF) per byte."""
    c = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    for raw, new in fixed.BYTE_RULES:
        if safe and not _is_whole(raw):
            continue
        c = F.replace(c, F.lit(raw.decode("latin-1")), F.lit(new))
    return c


def _is_whole(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def repair_bytes(c: Column, safe: bool = False) -> Column:
    """Replace ligatures, dashes and broken sequences on the byte level, then drop invalid bytes.

    The byte rules also hit continuation bytes of intact letters; ``safe`` keeps only the rules that
    name whole characters. A genuine U+FFFD of the input is dropped too.
    """
    return _valid_text(_repaired_bytes(c, safe))


def _valid_text(byte_characters: Column) -> Column:
    raw = F.encode(byte_characters, "ISO-8859-1").cast("string")
    return F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit(""))


def repaired_length(c: Column, safe: bool = False) -> Column:
    """Byte length after the repair, before invalid bytes are dropped."""
    return F.length(_repaired_bytes(c, safe))


def corpus_sample(c: Column, safe: bool = False) -> Column:
    """A sample through every cleaning step: ``struct(value, n_bytes)``, each step evaluated once."""
    marked = strip_markup(slice_sections(c))
    return bind(_repaired_bytes(marked, safe), lambda b: F.struct(
        strip(_valid_text(b)).alias("value"), F.length(b).alias("n_bytes"), F.contains(b, F.lit(" ")).alias("spaced"),
    ))


# --- full-text bodies --------------------------------------------------------------------------

def remove_brackets(c: Column) -> Column:
    """Drop bracketed citations; an unmatched bracket stays."""
    return F.regexp_replace(c, r"\[[^\]]*\]", "")


def journal_body(text: Column, pub: Column) -> Column:
    """Main section of an article by the rule of its journal; null for other journals."""
    start = F.lit(fixed.SCIENCE_START)
    science = bind(_before(text, fixed.REFERENCES), lambda head: F.when(
        F.contains(head, start), remove_brackets(replace_all(F.split_part(head, start, F.lit(2)), fixed.SCIENCE_NUMBERS))
    ).otherwise(head))
    body = _between(text, fixed.ABSTRACT_LINE)
    apj = _before(_between(body, fixed.APJ_START), fixed.APJ_END)
    mnras = _before(_between(body, fixed.MNRAS_START), fixed.MNRAS_END)
    return (
        F.when(pub == fixed.SCIENCE, science)
        .when(pub == fixed.APJ, apj)
        .when(pub == fixed.MNRAS, mnras)
    )


def cleanup_pdf_text(c: Column) -> Column:
    """Join lines and hyphenated words, drop form feeds, one pass of two spaces to one."""
    return replace_all(c, [("\n", " "), ("- ", ""), ("\x0c", ""), ("  ", " ")])


# --- tokens and chunks -------------------------------------------------------------------------

def default_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def raw_tokens(c: Column) -> Column:
    """Lower-cased words and runs of symbols."""
    return F.regexp_extract_all(F.lower(c), F.lit(fixed.TOKEN_OR_SYMBOL), F.lit(0))


def keep_token(token: Column, stop_words: Sequence[str]) -> Column:
    """True for a token that is neither a stop word nor a substring of the punctuation string, as is ''."""
    return ~(token.isin(list(stop_words)) | F.contains(F.lit(fixed.PUNCTUATION), token))


def normalize_tokens(c: Column, stop_words: Sequence[str] | None = None) -> Column:
    """Space-joined tokens without stop words and punctuation."""
    stop_words = default_stop_words() if stop_words is None else stop_words
    kept = F.filter(raw_tokens(c), lambda t: keep_token(t, stop_words))
    return F.array_join(kept, " ")


def tfidf_tokens(c: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(fixed.WORD_RUN), F.lit(0))


def chunk_words(c: Column, size: int) -> Column:
    """Windows of ``size`` words every ``size // 2`` words; short windows at the end stay."""
    if size < 2:
        raise ValueError("a chunk holds at least two words")
    return bind(
        words(c),
        lambda w: F.when(
            F.size(w) > 0,
            F.transform(
                F.sequence(F.lit(1), F.size(w), F.lit(size // 2)),
                lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def chunk_sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def chunk_newline(c: Column) -> Column:
    return F.split(c, "\n")


def chunk_none(c: Column) -> Column:
    return F.array(c)


def chunker(mode: int | str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Chunking expression for a word count, a named mode, or the caller's own expression; unknown modes keep
    the whole text."""
    if callable(mode):
        return mode
    if isinstance(mode, int):
        return lambda c: chunk_words(c, mode)
    return {"sentence": chunk_sentences, "newline": chunk_newline}.get(mode, chunk_none)


def distinct_words(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.split(c, " ")))


# --- prompts and display -----------------------------------------------------------------------

def trim_context_tokens(tokens: Column, n: int = 40) -> Column:
    return F.slice(tokens, F.greatest(F.size(tokens) - n, F.lit(0)) + 1, F.lit(n))


def trim_context_chars(c: Column, n: int = 200) -> Column:
    return F.right(c, F.lit(n))


def strip_prompt(generated: Column, prompt: Column, trim: bool = False) -> Column:
    """Remove every occurrence of the prompt; an empty prompt changes nothing."""
    out = F.when(prompt == "", generated).otherwise(F.replace(generated, prompt, F.lit("")))
    return strip(out) if trim else out


def paper_link(title: Column, bibcode: Column, abstract: Column) -> Column:
    """Display text of a paper with a link to its abstract page."""
    url = F.format_string(fixed.ABSTRACT_URL, bibcode)
    return F.concat(
        title, F.lit("<br><br>"), abstract,
        F.lit('<br><br><a href="'), url, F.lit('" target="_blank">'), bibcode, F.lit("</a>"),
    )


def paper_repr(keys: Sequence[str]) -> Column:
    """``key:value`` pairs of a row in the given order; missing values read None."""
    parts = [F.concat(F.lit(f"{k}:"), F.coalesce(F.col(k).cast("string"), F.lit("None"))) for k in keys]
    return F.concat_ws(", ", *parts)
