"""Row predicates as boolean Columns. None of them is ever null."""

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from paperloom.functions import fixed
from paperloom.functions.text import bind


def irreducible(words: Sequence[str]) -> list[str]:
    """The words that decide a substring test: a word containing another listed word adds nothing."""
    distinct = list(dict.fromkeys(words))
    return [w for w in distinct if not any(v != w and v in w for v in distinct)]


def contains_any(cols: Sequence[Column], words: Sequence[str]) -> Column:
    """Case-sensitive substring match of any word in any column; null matches nothing.

    A column is evaluated once, however many words there are, and the plan stays one expression long.
    """
    listed = F.array(*[F.lit(w) for w in irreducible(words)])
    hit = F.lit(False)
    for c in cols:
        found = bind(c, lambda v: F.exists(listed, lambda w: F.contains(v, w)))
        hit = hit | F.coalesce(found, F.lit(False))
    return hit


def non_blank(*cols: Column) -> Column:
    keep = F.lit(True)
    for c in cols:
        keep = keep & c.isNotNull() & (c != "")
    return F.coalesce(keep, F.lit(False))


def pub_in(pub: Column, journals: Sequence[str] = fixed.JOURNALS) -> Column:
    return F.coalesce(pub.isin(list(journals)), F.lit(False))


def unprocessed(c: Column) -> Column:
    """Null and empty both mean that the work is still to be done."""
    return F.coalesce(c, F.lit("")) == ""


def query_in_text(c: Column, query: str, loose: bool = False) -> Column:
    if loose:
        return F.lit(True)
    return F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))


def has_space_and_min_bytes(c: Column, n: int = 100) -> Column:
    return F.coalesce(F.contains(c, F.lit(" ")) & (F.octet_length(c) > n), F.lit(False))


def min_chars(c: Column, n: int = 100) -> Column:
    return F.coalesce(F.length(c) > n, F.lit(False))


def drop_tokens_containing(tokens: Column, parts: Sequence[str] = fixed.TITLE_NOISE) -> Column:
    listed = F.array(*[F.lit(p) for p in irreducible(parts)])
    return F.filter(tokens, lambda t: ~F.exists(listed, lambda p: F.contains(t, p)))
