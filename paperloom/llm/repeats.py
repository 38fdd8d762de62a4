"""Exact repeats of word windows: fixed-block anchors, probed by every rolling window and extended.

Any window of ``width`` words holds a whole block of ``width // 2`` words of every text cut into such blocks.
The blocks are indexed; every rolling window of that length probes the index, through a filter of fixed size
first. Where a probe meets a block elsewhere, the repeat is extended to all full windows around the hit on
both sides, and these are compared by 96-bit hashes: a window that also starts earlier is a repeat.
Consecutive repeated windows join to maximal repeats.

Repeats within one batch of texts are settled there, so a passage that a third of all texts hold leaves a task
as one row for each batch, and first places are found by a minimum that combines before the shuffle.

Nulls and odd rows: a null or empty text has no words; a row with a null id is left whole and is nothing's
earlier place; rows that share id and text are one document and get the same answer; rows that share an id
alone are told apart by a checksum, which also orders them; an empty table gives an empty result; clashing
column names of the input are safe, as only id and text are read.
"""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.sketch import build_filter, passes, sliced
from paperloom.llm.words import frugal, mix, split_words, text_slices, windows, word_hashes
from paperloom.staging import share, stage

WIDTH = 20
#: Text that is compared within a task at a time.
BATCH_BYTES = 8_000_000


def _parts(batch: pa.RecordBatch, most: int):
    """``(ids, bytes, offsets, first word of each text, word hashes)`` of slices of a batch; null ids are left out."""
    batch = batch.filter(pa.compute.is_valid(batch.column("doc_id")))
    ids = batch.column("doc_id").to_numpy()
    for first, last, data, offsets in text_slices(batch.column("text"), most):
        starts, ends, of = split_words(data, offsets)
        yield ids[first:last], data, offsets, of, word_hashes(data, starts, ends)


def _inside(of: np.ndarray, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window lies within one text, and the place's text."""
    owner = np.repeat(np.arange(len(of) - 1), np.diff(of))
    at = np.flatnonzero(np.arange(count) + width <= of[owner[:count] + 1]) if count > 0 else np.zeros(0, np.int64)
    return at, owner


def block_filter(texts: DataFrame, width: int = WIDTH, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    """The filter of all reference blocks."""
    block = width // 2

    def run(batches):
        for batch in batches:
            for _, _, _, of, hashes in _parts(batch, batch_bytes):
                rolling = windows(hashes, block)
                at, owner = _inside(of, len(rolling), block)
                at = at[(at - of[owner[at]]) % block == 0]
                for part, raw in sliced(rolling[at]):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw], pa.binary())], names=["slice", "hashes"])

    return build_filter(texts.mapInArrow(frugal(run), "slice int, hashes binary"))


def repeated_filter(texts: DataFrame, blocks: np.ndarray, width: int = WIDTH, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    """The filter of block contents that occur at two places or more, counted exactly."""
    block = width // 2
    shared = share(texts.sparkSession, blocks)

    def probe(batches):
        for batch in batches:
            for _, _, _, of, hashes in _parts(batch, batch_bytes):
                rolling = windows(hashes, block)
                at, owner = _inside(of, len(rolling), block)
                at = at[passes(rolling[at], shared.value)]
                found, place, number = np.unique(rolling[at], return_inverse=True, return_counts=True)
                aligned = np.bincount(place[(at - of[owner[at]]) % block == 0], minlength=len(found)) > 0
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(number.astype(np.int64)), pa.array(aligned.astype(np.int32))], names=["h", "places", "block"])

    def packed(batches):
        for batch in batches:
            for part, raw in sliced(batch.column("h").to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw], pa.binary())], names=["slice", "hashes"])

    met = texts.mapInArrow(frugal(probe), "h long, places long, block int").groupBy("h").agg(F.sum("places").alias("places"), F.max("block").alias("block"))
    return build_filter(met.where("places > 1 and block = 1").select("h").mapInArrow(packed, "slice int, hashes binary"))


PLACE = "h1 long, h2 int, doc_id long, place long, run long"


def extended(texts: DataFrame, repeated: np.ndarray, width: int = WIDTH, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Full windows around hits: the first of its content in a batch by hash, with ``run`` 0, and runs of
    windows that repeat one of the same batch. ``place`` is the text's checksum, then the start word."""
    block = width // 2
    shared = share(texts.sparkSession, repeated)

    def places(ids, data, offsets, of, hashes):
        rolling = windows(hashes, block)
        at, owner = _inside(of, len(rolling), block)
        at = at[(at - of[owner[at]]) % block == 0]
        hits = np.zeros(len(hashes) + width, bool)
        hits[at[passes(rolling[at], shared.value)]] = True
        # A repeated window holds a block of its own text, or two, and that content is repeated too.
        at, owner = _inside(of, len(hashes) - width + 1, width)
        past = (at - of[owner[at]]) % block
        at = at[hits[at + (block - past) % block] & ((past > 0) | hits[at + block])]
        with np.errstate(over="ignore"):
            h1 = mix(rolling[at] * np.uint64(0x9E3779B97F4A7C15) + rolling[at + block])
            other = windows(hashes, block, seed=1)
            h2 = mix(other[at] * np.uint64(0xC2B2AE3D27D4EB4F) + other[at + block]).astype(np.uint32).view(np.int32)
        raw = data.tobytes()
        marks = np.array([zlib.crc32(raw[a:b]) >> 1 for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
        text = owner[at]
        doc, place = ids[text], (marks[text] << 32) + at - of[text]
        order = np.lexsort((place, doc, h1))
        h1, h2, doc, place = (x[order] for x in (h1, h2, doc, place))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else new.astype(int)
        again = ~new & ((doc != doc[lead]) | (place != place[lead]))
        yield h1[new], h2[new], doc[new], place[new], np.zeros(int(new.sum()), np.int64)
        doc, place = doc[again], place[again]
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        edge = np.ones(len(doc) + 1, bool)
        edge[1:-1] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)
        begin = np.flatnonzero(edge[:-1])
        end = np.flatnonzero(edge)[1:] - 1
        yield mix(doc[begin].view(np.uint64)), np.zeros(len(begin), np.int32), doc[begin], place[begin], place[end] - place[begin] + 1

    def run(batches):
        for batch in batches:
            for part in _parts(batch, batch_bytes):
                for h1, h2, doc, place, runs in places(*part):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1.view(np.int64), h2, doc, place, runs)], names=["h1", "h2", "doc_id", "place", "run"])

    return texts.mapInArrow(frugal(run), PLACE)


def later_places(places: DataFrame) -> DataFrame:
    """``doc_id, place, run`` of windows that also start earlier. The sorted places stream through a task."""

    def run(batches):
        last = None
        for batch in batches:
            h1, h2, doc, place, runs = (batch.column(i).to_numpy() for i in range(5))
            if not len(h1):
                continue
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = last is None or last[:2] != (h1[0], h2[0])
            at = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
            lead_doc, lead_place = doc[np.maximum(at, 0)], place[np.maximum(at, 0)]
            if last is not None:
                lead_doc, lead_place = np.where(at < 0, last[2], lead_doc), np.where(at < 0, last[3], lead_place)
            keep = (runs > 0) | (~new & ((doc != lead_doc) | (place != lead_place)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[keep], place[keep], np.maximum(runs[keep], 1))], names=["doc_id", "place", "run"])
            last = (h1[-1], h2[-1], lead_doc[-1], lead_place[-1])

    return places.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "place").mapInArrow(run, "doc_id long, place long, run long")


def covered_words(later: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, mark, spans``: the maximal runs of covered words of a text as pairs of 64-bit integers."""

    def merged(doc, place, runs):
        mark, start = place >> 32, place & 0xFFFFFFFF
        end = start + runs + width - 1
        edges = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])) + 1, [len(doc)]])
        ids, marks, spans = [], [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            reach = np.maximum.accumulate(end[a:b])
            gap = np.flatnonzero(start[a + 1 : b] > reach[:-1]) + 1
            first = np.concatenate([[0], gap])
            last = np.concatenate([gap - 1, [b - a - 1]])
            ids.append(int(doc[a]))
            marks.append(int(mark[a]))
            spans.append(np.stack([start[a:b][first], reach[last]], axis=1).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(spans, pa.binary())], names=["id", "mark", "spans"])

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest)]
            if len(now[0]):
                cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
                if cut:
                    yield merged(*(x[:cut] for x in now))
                rest = [x[cut:] for x in now]
        if len(rest[0]):
            yield merged(*rest)

    return later.repartition("doc_id").sortWithinPartitions("doc_id", "place").mapInArrow(run, "id long, mark long, spans binary")


def find_repeats(docs: DataFrame, width: int = WIDTH, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``id, mark, spans`` of every text with repeated windows; ``mark`` is half its CRC-32.

    ``batch_bytes`` of text are compared within a task at a time: fewer take less memory and shuffle more rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = repeated_filter(texts, block_filter(texts, width, batch_bytes), width, batch_bytes)
    return stage(covered_words(later_places(extended(texts, repeated, width, batch_bytes)), width), "repeats")


def _with_spans(docs: DataFrame, width: int, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    found = find_repeats(docs, width, batch_bytes)
    half = F.shiftright(F.crc32(F.col("text").cast("string").cast("binary")), 1)
    keyed = docs.withColumn("half_of_crc_", half)
    return keyed.join(found, (F.col("doc_id").cast("long") == found["id"]) & (F.col("half_of_crc_") == found["mark"]), "left").drop("half_of_crc_", "id", "mark")


def _kept(raw: bytes, spans: bytes) -> tuple[list[bytes], int]:
    """The words outside the spans, and how many there were."""
    words = raw.split()
    out, done = [], 0
    for start, end in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
        out += words[done:start]
        done = end
    return out + words[done:], len(words)


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                kept, number = _kept((text.as_py() or "").encode(), spans.as_py() or b"")
                rows.append((number, number - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_spans(picked, width).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, width: int = WIDTH, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` with repeated words cut out of ``text``; the rest keeps its white space. Texts without a repeat
    are unchanged, and those of which nothing is left are dropped."""
    import re

    word = re.compile(rb"[^ \t\n\x0b\x0c\r]+")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans, strict=True):
            if own is None:
                out.append(None)
                continue
            raw = text.encode()
            at = [m.start() for m in word.finditer(raw)] + [len(raw)]
            parts, done = [], 0
            for start, end in np.frombuffer(own, np.int64).reshape(-1, 2).tolist():
                parts.append(raw[done : at[start]])
                done = at[end]
            rest = b"".join([*parts, raw[done:]]).decode()
            out.append(rest if rest.strip() else None)
        return pd.Series(out, dtype=object)

    names = docs.columns
    marked = _with_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", F.col("text").cast("string").alias("text")), width, batch_bytes)
    less = cut(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans"))  # other texts stay where they are
    both = marked.select("row", "text", "spans", less.alias("less")).where("spans is null or less is not null")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.col("less"))
    return both.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])
