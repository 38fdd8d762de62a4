"""Token sequences of one length from documents of any length: best fit decreasing with certified bounds.

Documents are encoded once and only lengths move from then on. Groups of bounded size are packed by best fit
decreasing; a lower bound from dual feasible functions certifies a group's number of bins. Sequences with gaps change
groups, and the groups that their bound doesn't certify exchange their documents and are packed again.

Nulls and odd rows: a null or empty text is the end id alone; a null id is kept; repeated rows are packed
each for itself; ties of length keep the order of the group; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.words import text_slices
from paperloom.staging import stage

CAPACITY = 4096
END_ID = 1
#: Pieces in a group that one task packs.
GROUP = 20_000
#: Words and pieces that a task keeps between slices of text, and bytes of a slice.
KEPT_WORDS, KEPT_PIECES, ENCODED_BYTES = 300_000, 400_000, 8_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Ids of texts by words between ASCII white space, which the vocabulary drops and never merges over.

    Most words are Latin letters, then marks: two pieces that the vocabulary never joins either. Pieces are
    lower-cased and encoded many at a time, since the last token of each is known by its word end. All other
    words are encoded one by one. A task keeps the words and pieces that it meets first.
    """

    def __init__(self, definition: str, kept_words: int = KEPT_WORDS, kept_pieces: int = KEPT_PIECES):
        self.most_words, self.most_pieces = kept_words, kept_pieces
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept: dict[bytes, bytes] = {}
        self.kept_pieces: dict[str, bytes] = {}

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _pieces(self, pieces: set[str]) -> dict[str, bytes]:
        known = self.kept_pieces
        out = {p: known[p] for p in pieces & known.keys()}
        pieces = list(pieces - out.keys())
        for at in range(0, len(pieces), 4000):
            part = pieces[at : at + 4000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, bounds = ids.tobytes(), (4 * np.concatenate([[0], ends])).tolist()
                out.update(zip(part, [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], strict=True))
            else:
                out.update(zip(part, self._one_by_one(part), strict=True))
        if len(known) < self.most_pieces:
            known.update((p, out[p]) for p in pieces)
        return out

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = _LINE.findall(b"\n".join(words).decode())
        other = [(raw, rest) for raw, (_, _, rest) in zip(words, found, strict=True) if rest]
        ids = self._pieces({p.lower() for letters, marks, _ in found for p in (letters, marks) if p})
        ids[""] = b""
        out = {raw: ids[letters.lower()] + ids[marks] for raw, (letters, marks, rest) in zip(words, found, strict=True) if not rest}
        for at in range(0, len(other), 1000):
            part = other[at : at + 1000]
            out.update(zip([raw for raw, _ in part], self._one_by_one([word for _, word in part]), strict=True))
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        kept = self.kept
        words = [raw.split() for raw in texts]
        fresh = set().union(*words) - kept.keys()
        fresh = list(fresh)
        for at in range(0, len(fresh), 25_000):
            kept.update(self._words(fresh[at : at + 25_000]))
        try:
            return [b"".join(map(kept.__getitem__, own)) for own in words]
        finally:
            for word in fresh:
                if len(kept) <= self.most_words:
                    break
                del kept[word]


#: A word for each line: precomposed Latin letters, then marks that start no contraction and no special token,
#: or anything else.
_LINE = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&|()\"-]*)|(.+))$", re.MULTILINE)


_lasting: dict[tuple, WordEncoder] = {}


def _encoder(definition: str, lasting: bool, kept: dict[str, int]) -> WordEncoder:
    if not lasting:
        return WordEncoder(definition, **kept)
    name = (zlib.crc32(definition.encode()), len(definition), *sorted(kept.items()))
    if name not in _lasting:
        _lasting.clear()
        _lasting[name] = WordEncoder(definition, **kept)
    return _lasting[name]


def _ids(batches, definition: str, end_id: int, slice_bytes: int, lasting: bool, kept: dict[str, int]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    encode = _encoder(definition, lasting, kept)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for first, last, data, offsets in text_slices(batch.column("text"), slice_bytes):
            raw = data.tobytes()
            encoded = encode([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            yield batch.column("doc_id").slice(first, last - first), [x + end for x in encoded]


def encode_pieces(docs: DataFrame, definition: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, slice_bytes: int = ENCODED_BYTES, lasting: bool = False, **kept: int) -> DataFrame:
    """Cut every document's ids, then ``end_id``, into pieces of ``capacity``; only longer documents are cut.

    ``definition`` is the text of a tokenizer file. With ``with_ids`` the pieces carry their ids (uint32).
    ``slice_bytes``, ``kept_words`` and ``kept_pieces`` trade a task's memory for time (about 0.5 GB as they are). What a
    task has kept goes with it, or, if ``lasting``, serves the next tasks of its worker process.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        for ids, encoded in _ids(batches, shared.value, end_id, slice_bytes, lasting, kept):
            owner, piece, start, length, crc, raw = [], [], [], [], [], []
            for i, own in enumerate(encoded):
                for k, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    owner.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        raw.append(part)
            columns = [ids.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def bound_of(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing of ``counts[length]`` pieces needs: the best of two families of dual feasible functions."""
    number, volume = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    small = np.arange(0, capacity // 2 + 1)  # pieces below this vanish, those above its complement fill a bin
    big = number[-1] - number[capacity - small]
    below = np.where(small > 0, volume[np.maximum(small - 1, 0)], 0)
    best = int(np.max(-(-(big * capacity + volume[capacity - small] - below) // capacity)))
    size = np.arange(capacity + 1)
    for k in range(1, 21):  # rounds multiples of capacity / (k + 1) down to multiples of capacity / k
        scaled = np.where((k + 1) * size % capacity == 0, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, int(-(-int((counts * scaled).sum()) // (k * capacity))))
    return best


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing of pieces of these lengths needs."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every piece: longest first, each into the fullest bin that holds it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = open_rooms >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            at = room[free].pop()
            if not room[free]:
                open_rooms ^= 1 << free
        else:
            free, at, used = capacity, used, used + 1
        bins[i], offsets[i] = at, capacity - free
        left = free - need
        if left:
            room[left].append(at)
            open_rooms |= 1 << left
    return bins, offsets, used


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, and the certificate of their group.

    ``group_bins`` is the number of bins of the group that made the sequence and ``group_bound`` its lower bound. In
    a round, sequences with a gap meet in new groups of about ``group`` pieces, in other company each time. A group
    whose bound equals its number of sequences is certified and keeps them; any other exchanges its documents and is packed again, and
    takes the new packing if that has fewer sequences. Once that saves nothing, the sequences with a quarter of their room left meet
    among themselves. It ends when the bound of all pieces together is reached, or when that saves nothing either.
    """
    schema = PIECES + ", sequence_id long, offset long, group_bins long, group_bound long, gap long"
    names = [f.split()[0] for f in schema.split(", ")]

    def packed(key: int, table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, used = best_fit(lengths, capacity)
        filled = np.bincount(bins, weights=lengths, minlength=used)
        extra = {"sequence_id": (key << 24) + bins, "offset": offsets, "group_bins": np.full(len(bins), used),
                 "group_bound": np.full(len(bins), lower_bound(lengths, capacity)), "gap": (capacity - filled[bins]).astype(np.int64)}
        out = table.select(names[:5])
        for name, values in extra.items():
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    def first(key, table):
        return packed(key[0].as_py(), table)

    def again(number: int):
        def run(key, table):
            before = len(np.unique(table.column("sequence_id").to_numpy()))
            bound = lower_bound(table.column("length").to_numpy(), capacity)
            if before > bound:
                new = packed((number << 27) | key[0].as_py(), table.select(names[:5]))
                if new.column("group_bins")[0].as_py() < before:
                    return new
            return table.select(names[:7]).append_column("group_bins", pa.array(np.full(len(table), before))).append_column("group_bound", pa.array(np.full(len(table), bound))).append_column("gap", table.column("gap"))

        return run

    pieces = stage(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # a row for each length
        counts[row["length"]] = row["n"]
    bound, groups = bound_of(counts, capacity), max(1, -(-int(counts.sum()) // group))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    now = stage(dealt.groupBy("g").applyInArrow(first, schema), "packed")
    final, idle, number = [], 0, 0
    while idle < 2:
        least = 1 if idle == 0 else capacity // 4  # then the emptiest ones among themselves
        told = now.where("offset = 0").agg(F.count("*"), F.count(F.when(F.col("gap") > 0, 1)), F.count(F.when(F.col("gap") >= least, 1))).first()
        if told[0] + sum(n for _, n in final) <= bound:
            break
        final.append((now.where("gap = 0"), told[0] - told[1]))
        if told[2] < 2:
            now, idle = stage(now.where("gap > 0"), "packed"), idle + 1
            continue
        number += 1
        groups = max(1, -(-now.where(F.col("gap") >= least).count() // group))
        mixed = now.where(F.col("gap") >= least).withColumn("g", F.pmod(F.xxhash64("sequence_id", F.lit(number)), F.lit(groups)))
        now = stage(mixed.groupBy("g").applyInArrow(again(number), schema).unionByName(now.where((F.col("gap") > 0) & (F.col("gap") < least))), "packed")
        idle = idle + 1 if now.where("offset = 0").count() == told[1] else 0
    for part, _ in final:
        now = now.unionByName(part)
    return now.drop("gap")
