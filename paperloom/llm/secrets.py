"""Secrets in text: fixed patterns, and strings that a primed compressor finds new.

A candidate is a long run of key characters, cut at its equals signs, in a sensitive context: a word such as
``key`` before it in its context, its own name in ``NAME=value`` included, or another candidate before it with
only white space or quotes between (the lines of a PEM body). So is any value of eight characters or more with digits, letters and marks or both
cases that is set to a sensitive name. Addresses, paths and names made of words are none. A candidate within a base span
adds nothing; one that reaches beyond is told whole. Its novelty is the number of bytes it
adds to the zstandard frame of its surroundings, primed with a dictionary of the identifiers that surround
candidates anywhere in the corpus, for each of its characters. Names and repeated values compress; secrets
do not.

Nulls and odd rows: a null or empty text has no span; repeated rows get the same answer; a null id is kept;
an empty table gives an empty result; columns not asked for are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F, types as T

from paperloom.llm.words import text_slices

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A run of at least 16 of these bytes holds every base match of the last two kinds and every candidate.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_NAMES = ("pass(?:word|wd|phrase|code)?", "pwd", "secrets?", "tokens?", "(?:api)?keys?", "auth(?:entication|orization)?", "bearer", "credentials?", "private", "signature", "access", "session", "login")
_TITLED = "|".join(n.removeprefix("(?:api)?").capitalize() for n in _NAMES)
#: A sensitive word by itself, or as a part of a name: api_key, apiKey, APIKEY_2, but not author, keynote or monkey.
_WORD = rf"(?:(?<![A-Za-z])(?:{'|'.join(_NAMES)}|{_TITLED})(?![a-z])|(?<=[a-z])(?:{_TITLED})(?![a-z])|(?<![A-Za-z])(?:{'|'.join(n.upper().replace('(?:', '(?:') for n in _NAMES)})(?![A-Za-z]))"
SENSITIVE = re.compile(_WORD, re.ASCII)
#: A value set to a sensitive name, in quotes or up to white space, and what makes a short one worth measuring.
VALUE = re.compile(_WORD + r"""\w{0,40}["']?[ \t]{0,8}[:=][ \t]{0,8}(?:"([^"\n]{8,200})"|'([^'\n]{8,200})'|([^\s"'<>]{8,200}))""", re.ASCII)
MIXED = re.compile(r"(?=.*\d)(?=.*[A-Za-z])(?:.*[^A-Za-z0-9\s]|(?=.*[a-z]).*[A-Z])", re.ASCII)
#: Parts of addresses, paths and names: words, also several in one with capitals, and small numbers.
WORDY = re.compile(r"[A-Za-z]?[a-z]*(?:[A-Z][a-z]+)*\d{0,4}|[A-Z]+\d{0,4}", re.ASCII)
#: Values of a run that sets names to values, and what may part the lines of one secret.
PART = re.compile(r"[A-Za-z0-9+/_.-]{16,}")
BETWEEN = re.compile(r"""(?:[\s=.'"|>-]|\\[nr])*""")
#: What follows a name that is set to a value.
NAMES = re.compile(r"=[^=\s]")
IDENTIFIER = r"[A-Za-z_]{4,}"
#: Characters of context on each side, identifiers in the dictionary, least novelty in bytes a character.
CONTEXT, IDENTIFIERS, NOVELTY = 160, 2000, 0.6

_in_run = np.zeros(256, bool)
_in_run[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_KEYWORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"bearer", b"credential", b"private", b"signature", b"access", b"session", b"login")
_SET = re.compile(rb"[:=][ \t]*[\"']?[^\s\"'<>]{7}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    for kind, pattern, least in ((1, ACCESS, 18), (2, HEX, 16)):
        for run in RUN.finditer(text):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text, run.start(), run.end()) if m.end() - m.start() >= least]
    return sorted(found)


def is_name(value: str) -> bool:
    """True for addresses, paths and names: at least three parts, and all of them words or small numbers."""
    parts = [p for p in re.split(r"[/._=+-]+", value) if p]
    return len(parts) >= 3 and all(WORDY.fullmatch(p) for p in parts)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str]]:
    """``(start, end, before, after)`` of what lies in a sensitive context and in no base span: long runs, and shorter values or
    values with other characters that are set to a sensitive name."""
    found, last = [], None
    for run in RUN.finditer(text):
        # A run without a long part is one candidate.
        for part in list(PART.finditer(text, run.start(), run.end())) or [run]:
            value = part.group().strip("=.-")
            start = part.start() + part.group().index(value)
            end = start + len(value)
            if len(value) < 16 or is_name(value):
                continue
            follows = last is not None and BETWEEN.fullmatch(text, last, start)
            if not follows and not SENSITIVE.search(text, max(0, start - CONTEXT), start):
                continue
            last = end
            found.append((start, end))
    for m in VALUE.finditer(text):
        start, end = m.span(m.lastindex)
        end = start + len(text[start:end].rstrip(".,;:)]}"))
        if end - start >= 8 and MIXED.match(text, start, end) and not is_name(text[start:end]) and "://" not in text[start:end]:
            found.append((start, end))
    out, reach, covered, place = [], -1, -1, 0
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        while place < len(base) and base[place][0] <= start:
            covered = max(covered, base[place][2])
            place += 1
        if end > covered and end > reach:  # neither within a base span nor within another candidate
            out.append((start, end, text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]))
            reach = end
    return out


def suspicious(column: pa.Array):
    """``(row, text)`` of the rows that may hold any span, found on the bytes of whole slices."""
    for first, _, data, offsets in text_slices(column):
        stops = np.concatenate([[-1], np.flatnonzero(~_in_run[data]), [len(data)]])
        wide = np.flatnonzero(np.diff(stops) > 16)
        flagged = set()
        for start, end in zip(stops[wide] + 1, stops[wide + 1], strict=True):
            flagged.update(range(int(np.searchsorted(offsets, start, side="right")) - 1, int(np.searchsorted(offsets, end, side="left"))))
        raw = data.tobytes()
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            own = raw[a:b]
            if i not in flagged:
                low = own.lower()
                if not any(k in low for k in _KEYWORDS) or not _SET.search(own):
                    continue
            yield first + i, own.decode("utf-8")


def _contexts(text: str) -> list[str]:
    """The surroundings of candidates without other candidates, which may be secrets, but with names set to values."""
    found = candidates(text, base_spans(text))
    values = [(start, end) for start, end, _, _ in found if not NAMES.match(text, end)]
    out, first = [], 0
    for start, end, before, after in found:
        for low, high in ((start - len(before), start), (end, end + len(after))):
            while first < len(values) and values[first][1] <= start - CONTEXT:
                first += 1
            for k in range(first, len(values)):
                a, b = values[k]
                if a >= high:
                    break
                if b > low:
                    out.append(text[low : max(low, a)])
                    low = b
            out.append(text[low:high])
    return out


def identifier_dictionary(docs: DataFrame, size: int = IDENTIFIERS) -> bytes:
    """The ``size`` identifiers most frequent around candidates of all texts, the most frequent last."""

    def contexts(batches):
        for batch in batches:
            near = [part for _, text in suspicious(batch.column("text")) for part in _contexts(text)]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], names=["near"])

    near = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(contexts, "near string")
    names = near.select(F.explode(F.regexp_extract_all("near", F.lit(IDENTIFIER), F.lit(0))).alias("name"))
    top = names.groupBy("name").count().orderBy(F.desc("count"), "name").limit(size).collect()
    return " ".join(r["name"] for r in reversed(top)).encode()


class Novelty:
    """Marginal compressed bytes for each character of a candidate."""

    def __init__(self, identifiers: bytes):
        import zstandard

        self.zstd, self.identifiers = zstandard, identifiers

    def __call__(self, value: str, before: str, after: str) -> float:
        prime = self.identifiers + b"\n" + after.encode() + b"\n" + before.encode()
        primed = self.zstd.ZstdCompressionDict(prime, dict_type=self.zstd.DICT_TYPE_RAWCONTENT)
        compressor = self.zstd.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
        around = before.encode()
        return (len(compressor.compress(around + value.encode())) - len(compressor.compress(around))) / len(value)


def spans(text: str, novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, int]]:
    """All spans of a text as ``(start, kind, end)`` in order; kind is a place in ``KINDS``."""
    base = base_spans(text)
    extra = [(start, 3, end) for start, end, before, after in candidates(text, base) if novelty(text[start:end], before, after) >= least]
    return sorted(base + extra)


def find_secrets(docs: DataFrame, identifiers: bytes | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and all spans as ``kind:start:end``."""
    identifiers = identifier_dictionary(docs) if identifiers is None else identifiers

    def run(batches):
        novelty = Novelty(identifiers)
        for batch in batches:
            n = len(batch)
            counts, base, told = np.zeros((4, n), np.int64), [_EMPTY] * n, [""] * n
            for row, text in suspicious(batch.column("text")):
                own = spans(text, novelty)
                names = [(kind, f"{KINDS[kind]}:{start}:{end}") for start, kind, end in own]
                for kind, _ in names:
                    counts[kind, row] += 1
                base[row] = hashlib.sha256(",".join(x for kind, x in names if kind < 3).encode()).hexdigest()
                told[row] = ",".join(x for _, x in names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in counts), pa.array(base, pa.string()), pa.array(told, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


_EMPTY = hashlib.sha256(b"").hexdigest()


def redact(docs: DataFrame, mark: str = "<SECRET>", identifiers: bytes | None = None) -> DataFrame:
    """``docs`` with every span of its column ``text`` replaced by ``mark``; touching spans share one mark."""
    identifiers = identifier_dictionary(docs) if identifiers is None else identifiers
    at = docs.columns.index("text")

    def run(batches):
        novelty = Novelty(identifiers)
        for batch in batches:
            column, changed = batch.column(at), {}
            for row, text in suspicious(column):
                parts, done = [], 0
                for start, _, end in spans(text, novelty):
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                if parts:
                    changed[row] = "".join(parts) + text[done:]
            if changed:
                keep = np.ones(len(batch), bool)
                keep[list(changed)] = False
                rows = sorted(changed)
                column = pa.compute.replace_with_mask(column.cast(pa.string()), pa.array(~keep), pa.array([changed[i] for i in rows], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], column.cast(pa.string()), *batch.columns[at + 1 :]], names=batch.schema.names)

    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType, True) for f in docs.schema])
    return docs.mapInArrow(run, schema)
