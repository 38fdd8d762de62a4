"""Stretches of words that repeat with a period, by a dictionary of basic factors.

Factors of ``1, 2, 4, ...`` words of a text get names, equal for equal content; the name of a factor is that of its
two halves. A factor that occurs again within twice its length proposes the distance as a period, and
positions that follow each other with the same distance form one proposal. The names then extend each
proposal to both sides, in steps that halve, to all words that keep the period; equal stretches are one.

A run of at least four periods holds factors between one and two periods long, and these occur next exactly one
period later: no run is lost. A proposal of four periods or more has no shorter period, since its factor would
have occurred earlier. Only positions whose factor occurs again go on to the next length, so ordinary text
ends after a few lengths; memory is at most 8 bytes for each word and length of a slice or of its one long text.

Nulls and odd rows: a null or empty text has no word and no run; null ids and repeated rows are rows like any
other; an empty table gives an empty result; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.words import text_slices

#: Shortest run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _named(positions: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose key occurs again, ascending, their names, and the distance to the next of the same name (0: none)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    again = np.zeros(len(keys) + 1, bool)
    again[1:-1] = ranked[1:] == ranked[:-1]
    names, distance = np.empty(len(keys), np.int32), np.zeros(len(keys), np.int32)
    names[order] = np.cumsum(~again[:-1]) - 1
    follows = np.flatnonzero(again[1:])
    distance[order[follows]] = positions[order[follows + 1]] - positions[order[follows]]
    alive = np.empty(len(keys), bool)
    alive[order] = again[:-1] | again[1:]
    return positions[alive], names[alive], distance[alive]


def _name_at(level: tuple[np.ndarray, np.ndarray], places: np.ndarray) -> np.ndarray:
    """Names at ``places``; -1 where the factor occurs once or has no room."""
    positions, names = level
    if not len(positions):
        return np.full(len(places), -1, np.int32)
    at = np.minimum(np.searchsorted(positions, places), len(positions) - 1)
    return np.where(positions[at] == places, names[at], -1)


def _common(levels: list, left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    """Number of equal words from ``left`` and ``right`` on (``step`` 1), or before them (-1)."""
    length = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        going = np.arange(len(left))
        while len(going):
            shift = length[going] if step > 0 else -length[going] - size
            one, two = _name_at(levels[k], left[going] + shift), _name_at(levels[k], right[going] + shift)
            going = going[(one >= 0) & (one == two)]
            length[going] += size
    return length


def runs_of(ids: np.ndarray, of: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows ``(text, start, length, period)`` of all runs, in order; text t holds the words ``ids[of[t]:of[t + 1]]``.

    ``least_periods`` must be 4 or more.
    """
    sizes = np.diff(of)
    longest = int(sizes.max(initial=0))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    end = of[1:][owner]
    levels, proposals, size = [], [np.zeros((0, 2), np.int64)], 1
    positions, names, distance = _named(np.arange(len(ids), dtype=np.int32), owner * (int(ids.max(initial=0)) + 1) + ids)
    while len(positions):
        levels.append((positions, names))
        near = np.flatnonzero((distance > 0) & (distance <= 2 * size))
        if len(near):
            first = np.ones(len(near), bool)
            first[1:] = (positions[near[1:]] != positions[near[:-1]] + 1) | (distance[near[1:]] != distance[near[:-1]])
            near = near[first]
            proposals.append(np.stack([positions[near], distance[near]], axis=1).astype(np.int64))
        if least_periods * size >= longest:
            break
        half = _name_at(levels[-1], positions + size)
        go = (half >= 0) & (positions + 2 * size <= end[positions])
        positions, names, distance = _named(positions[go], names[go].astype(np.int64) * (int(names.max()) + 1) + half[go])
        size *= 2
    start, period = np.concatenate(proposals).T
    ends = start + period + _common(levels, start, start + period, 1)
    start = start - _common(levels, start, start + period, -1)
    good = ends - start >= np.maximum(least_words, least_periods * period)
    found = np.unique(np.stack([start[good], period[good], ends[good]], axis=1), axis=0)
    text = owner[found[:, 0]]
    return np.stack([text, found[:, 0] - of[text], found[:, 2] - found[:, 0], found[:, 1]], axis=1)


def _texts(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None) -> Iterator[tuple[pa.Array, list[list[bytes]], np.ndarray]]:
    """Ids, words and runs of slices of text; equal words get equal numbers by the words themselves."""
    for batch in batches:
        for first, last, data, offsets in text_slices(batch.column("text")):
            raw, docs = data.tobytes(), batch.column("doc_id").slice(first, last - first)
            words = [raw[a:b].split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            if rewrite is not None:
                words = [rewrite(i, own) for i, own in zip(docs.to_pylist(), words, strict=True)]
            of = np.concatenate([[0], np.cumsum([len(own) for own in words])]).astype(np.int64)
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for own in words for w in own), np.int64, int(of[-1]))
            yield docs, words, runs_of(ids, of)


def _by_text(runs: np.ndarray, texts: int) -> Iterator[np.ndarray]:
    edges = np.searchsorted(runs[:, 0], np.arange(texts + 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield runs[a:b, 1:]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def find_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, start, length, period``: every run of every text, in words from 0."""

    def run(batches):
        for docs_, _, runs in _texts(batches, rewrite):
            yield pa.RecordBatch.from_arrays([docs_.take(pa.array(runs[:, 0])), *(pa.array(runs[:, c]) for c in (1, 2, 3))], names=["doc_id", "start", "length", "period"])

    return _rows(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with texts that hold a run cut to the words no run repeats, joined by one space; others are unchanged."""
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            out = []
            for _, words, runs in _texts([batch], None):
                own = _by_text(runs, len(words))
                out += [b" ".join(collapsed(w, r)).decode() if len(r) else None for w, r in zip(words, own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(out, pa.string())], names=["row", "doc_id", "text"])

    less = F.coalesce("text", F.col("row.text").cast("string"))
    return whole.mapInArrow(run, whole.schema).select(*[less.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])


def digest(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id``, number of runs, the longest one (ties: first, then shortest period), and checksums of runs and collapsed text."""

    def run(batches):
        for docs_, words, runs in _texts(batches, rewrite):
            rows = []
            for own, found in zip(words, _by_text(runs, len(words)), strict=True):
                listed = found.tolist()
                top = min(listed, key=lambda r: (-r[1], r[0], r[2])) if listed else (None, None, None)
                rows.append((len(listed), *top, 1000 * top[1] // top[2] if listed else None,
                             hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in listed).encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(own, found))).hexdigest()))
            types = [*[pa.int64()] * 5, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([docs_, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))],
                                             names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
