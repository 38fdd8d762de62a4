"""Byte-level byte-pair vocabulary, learnt from the word counts of a corpus.

A symbol is one code point of a private plane, so a word is a string, an adjacent pair is two
characters. Everything that grows with the corpus is a DataFrame; the driver sees the merges, which the
vocabulary size bounds, and a bounded number of word segments. Tasks look at the symbols of many words in one array.
"""

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from paperloom.functions import fixed, lists
from paperloom.staging import restage, stage

_SYMBOL_BASE = 0xF0000
MAX_SYMBOLS = 0x110000 - _SYMBOL_BASE
#: Pairs that the first round looks at, and the most different segments that the driver follows merges on.
_PAIRS = 4096
_SEGMENTS = 500_000
#: Words, or ids, that a task looks at together, whatever the length of texts and batches.
_SLICE = 500_000
#: Symbols of words that a task of the training looks at together, bits of a symbol, and merges of one word at which the others take the queue.
_TOGETHER = 2_000_000
_BITS = 17
_STEPS = 64
_NEVER = 1 << 62


def byte_characters() -> list[str]:
    """Printable character of every byte value: itself where printable, else the next of U+0100..."""
    shown = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    shifted = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in shown else next(shifted) for b in range(256)]


def pre_tokens(c: Column) -> Column:
    """Words with their leading space, numbers, symbol runs and spaces."""
    return F.regexp_extract_all(c, F.lit(fixed.BYTE_LEVEL_WORD), F.lit(0))


def _symbol(number: int) -> str:
    return chr(_SYMBOL_BASE + number)


def _spelt(key: int) -> str:
    """The pair of a key of two symbols."""
    return "".join(map(_symbol, divmod(key, 1 << _BITS)))


def _byte_string(c: Column) -> Column:
    """One character U+0000-00FF per UTF-8 byte."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


class BpeModel:
    """Tokens by id, and merges ``(left id, right id, merged id)`` in the order they were learnt."""

    def __init__(self, tokens: list[str], merges: list[tuple[int, int, int]]):
        self.tokens, self.merges = tokens, merges

    def vocabulary(self, spark) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.tokens)), "token_id int, token string")

    def save(self, spark, path: str) -> None:
        self.vocabulary(spark).write.mode("overwrite").parquet(f"{path}/vocabulary")
        ranked = [(rank, *merge) for rank, merge in enumerate(self.merges)]
        spark.createDataFrame(ranked, "rank int, left int, right int, merged int") \
            .write.mode("overwrite").parquet(f"{path}/merges")

    @classmethod
    def load(cls, spark, path: str) -> "BpeModel":
        tokens = spark.read.parquet(f"{path}/vocabulary").orderBy("token_id").collect()
        merges = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
        return cls([r.token for r in tokens], [(r.left, r.right, r.merged) for r in merges])


def bpe_train(
    df: DataFrame, column: str, vocab_size: int = 65_536, min_frequency: int = 3,
    special: Sequence[str] = (fixed.END_OF_TEXT,), pairs: int = _PAIRS, most_segments: int = _SEGMENTS,
) -> BpeModel:
    """Merge the most frequent adjacent pair until the vocabulary is full or counts fall too low.

    Ties go to the smallest pair of ids. A round looks at the ``pairs`` most frequent pairs. Between any two
    neighbours that are none of these, words are cut: a merge across a cut can't be as frequent as the pairs looked at. Equal
    segments are counted together over the corpus, and the driver follows the merges on them for as long as the
    next one is certain to outrank every pair outside; then the words take all merges of the round in one pass. When
    there are more than ``most_segments`` different segments the round looks at fewer pairs; one pair needs none.
    """
    if vocab_size > MAX_SYMBOLS:
        raise ValueError(f"at most {MAX_SYMBOLS} tokens")
    counted = df.select(F.explode(pre_tokens(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = counted.select(_byte_string(F.col("word")).alias("word"), "n")
    counted = stage(counted, "words")
    present = counted.select(F.explode(F.array_distinct(F.split("word", ""))).alias("b")).distinct().collect()
    shown = byte_characters()
    alphabet = sorted((shown[ord(r.b)], r.b) for r in present)
    tokens = list(special) + [c for c, _ in alphabet]
    raw = "".join(b for _, b in alphabet)
    symbols = "".join(_symbol(len(special) + i) for i in range(len(alphabet)))
    words = counted.select(F.translate("word", raw, symbols).alias("word"), "n") if alphabet else counted
    words = words.filter(F.length("word") > 1)
    merges: list[tuple[int, int, int]] = []
    held = counted
    while len(tokens) < vocab_size:
        ranked = _ranked_pairs(words, pairs + 1, min_frequency)
        if not ranked:
            break
        while True:
            outside = ranked[pairs] if len(ranked) > pairs else None
            segments = _segments(words, [pair for pair, _ in ranked[:pairs]], most_segments) if pairs > 1 else [(_spelt(ranked[0][0]), ranked[0][1])]
            if segments is not None:
                break
            pairs = max(1, pairs // 8)
        found = _certain_merges(segments, outside, min_frequency, len(tokens), vocab_size - len(tokens))
        for left, right, _ in found:
            tokens.append(tokens[left] + tokens[right])
        merges += found
        if outside is not None:
            pairs *= next((more for more in (8, 4, 2) if len(segments) < most_segments // more ** 2), 1)
        if len(tokens) < vocab_size:
            words = held = restage(_merge_words(words, found), held, "words")
    return BpeModel(tokens, merges)


def _symbols(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words one after the other, and how many each word has."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    raw = memoryview(words.buffers()[2])[offsets[0]:offsets[-1]]
    codes = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), "<u4").astype(np.int64)
    return codes - _SYMBOL_BASE, np.diff(offsets) // 4


def _strings(symbols: np.ndarray, lengths: np.ndarray) -> pa.Array:
    raw = (symbols + _SYMBOL_BASE).astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    offsets = np.concatenate([[0], 4 * np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(raw))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols, lengths and counts of the words of several batches at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append((*_symbols(batch.column("word").cast(pa.string())), batch.column("n").to_numpy()))
            size += len(held[-1][0])
        if size >= _TOGETHER:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held)))


def _keys(symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One number for each symbol and its right neighbour, in the order of the two ids; -1 for the last symbol of a word."""
    keys = np.full(len(symbols), -1, np.int64)
    keys[:-1] = symbols[:-1] << _BITS | symbols[1:]
    keys[last] = -1
    return keys


def _places(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted numbers ``known``, and whether they hold the keys."""
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def _summed(name: str, values: pa.Array | np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    table = pa.table({name: values, "n": n}).group_by(name, use_threads=False).aggregate([("n", "sum")])
    return table.rename_columns({"n_sum": "n"}).select([name, "n"]).combine_chunks().to_batches()[0]


def _ranked_pairs(words: DataFrame, limit: int, min_frequency: int) -> list[tuple[int, int]]:
    """Keys of the most frequent pairs with their counts, in the order in which ties are broken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, lengths, n in _gathered(batches):
            keys = _keys(symbols, np.cumsum(lengths) - 1)
            inside = keys >= 0
            if inside.any():
                yield _summed("pair", keys[inside], np.repeat(n, lengths)[inside])

    counted = words.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    ranked = counted.filter(F.col("n") >= min_frequency).orderBy(F.desc("n"), "pair").limit(limit)
    return [(r.pair, r.n) for r in ranked.collect()]


def _segments(words: DataFrame, pairs: list[int], most: int) -> list[tuple[str, int]] | None:
    """Stretches of words in which all neighbours are among ``pairs``, with their counts; None when there are too many."""
    shared = words.sparkSession.sparkContext.broadcast(np.sort(np.array(pairs, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for symbols, lengths, n in _gathered(batches):
            _, after = _places(_keys(symbols, np.cumsum(lengths) - 1), known)
            before = np.concatenate([[False], after[:-1]])
            starts, ends = np.flatnonzero(after & ~before), np.flatnonzero(before & ~after)
            if len(starts):
                parts = _strings(symbols[before | after], ends - starts + 1)
                yield _summed("segment", parts, np.repeat(n, lengths)[starts])

    counted = words.mapInArrow(run, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    found = counted.limit(most + 1).toArrow()
    shared.destroy()
    return list(zip(*(found.column(c).to_pylist() for c in ("segment", "n")))) if found.num_rows <= most else None


def _certain_merges(segments: list[tuple[str, int]], outside: tuple[int, int] | None, min_frequency: int, first: int,
                    room: int) -> list[tuple[int, int, int]]:
    """Merges ``(left, right, merged)`` in order, from id ``first`` on, for as long as no pair outside the segments can come before."""
    number = [n for _, n in segments]
    parts = [[ord(c) - _SYMBOL_BASE for c in segment] for segment, _ in segments]
    counts: dict[tuple[int, int], int] = {}
    holders: dict[tuple[int, int], set[int]] = {}
    for k, own in enumerate(parts):
        for pair in zip(own, own[1:]):
            counts[pair] = counts.get(pair, 0) + number[k]
            holders.setdefault(pair, set()).add(k)
    queue = [(-n, pair) for pair, n in counts.items()]
    heapq.heapify(queue)
    limit = (0, ()) if outside is None else (outside[1], divmod(outside[0], 1 << _BITS))
    merges: list[tuple[int, int, int]] = []
    while queue and len(merges) < room:
        n, pair = heapq.heappop(queue)
        now = counts.get(pair, 0)
        if now != -n:  # its count has fallen since
            if now >= min_frequency:
                heapq.heappush(queue, (-now, pair))
            continue
        if now < min_frequency or now < limit[0] or (now == limit[0] and pair >= limit[1]):
            break
        new = first + len(merges)
        merges.append((*pair, new))
        changed = set()
        for k in holders.pop(pair):
            own = parts[k]
            for p in zip(own, own[1:]):
                counts[p] -= number[k]
            parts[k] = own = _replaced(own, pair, new)
            for p in zip(own, own[1:]):
                counts[p] = counts.get(p, 0) + number[k]
                if new in p:  # counts of others have fallen or stayed, which is seen when their turn comes
                    holders.setdefault(p, set()).add(k)
                    changed.add(p)
        for p in changed:
            heapq.heappush(queue, (-counts[p], p))
    return merges


def _merge_words(words: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """The words after the merges; words of one symbol are done."""
    shared = words.sparkSession.sparkContext.broadcast(np.array(merges, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = shared.value
        for symbols, lengths, n in _gathered(batches):
            symbols, lengths, word = _merged_together(symbols, lengths, merges)
            longer = lengths > 1
            yield pa.RecordBatch.from_arrays(
                [_strings(symbols[np.repeat(longer, lengths)], lengths[longer]), pa.array(n[word[longer]])], names=["word", "n"])

    return words.mapInArrow(run, "word string, n long")


def _merged_together(symbols: np.ndarray, lengths: np.ndarray, merges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words after all merges in order: their symbols, their lengths, and the places of the words before.

    A step takes the first merge that each word still has, wherever it has it. Words that need more than ``_STEPS`` take the queue.
    """
    keys = merges[:, 0] << _BITS | merges[:, 1]
    rank_of = np.argsort(keys)
    known, new = keys[rank_of], merges[:, 2]
    word = np.repeat(np.arange(len(lengths)), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(_STEPS):
        first = np.concatenate([[True], word[1:] != word[:-1]])
        at, among = _places(_keys(symbols, np.concatenate([np.flatnonzero(first)[1:] - 1, [len(word) - 1]])), known)
        rank = np.where(among, rank_of[at], _NEVER)
        least = np.minimum.reduceat(rank, np.flatnonzero(first))[np.cumsum(first) - 1]
        more = least < _NEVER
        done.append((symbols[~more], word[~more]))
        symbols, word, rank, least = symbols[more], word[more], rank[more], least[more]
        if not len(word):
            break
        chosen = rank == least
        # In a stretch of one symbol the places overlap: every second counts, from the left.
        place = np.arange(len(word))
        begins = chosen & ~np.concatenate([[False], chosen[:-1]])
        chosen &= (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
        symbols[chosen] = new[rank[chosen]]
        left = ~np.concatenate([[False], chosen[:-1]])
        symbols, word = symbols[left], word[left]
    if len(word):
        ranks = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(merges.tolist())}
        edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        for number, part in zip(word[edges].tolist(), np.split(symbols, edges[1:])):
            own = np.array(_merged(part.tolist(), ranks), np.int64)
            done.append((own, np.full(len(own), number)))
    symbols, word = (np.concatenate(parts) for parts in zip(*done))
    edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    return symbols, np.diff(np.append(edges, len(word))), word[edges]


def _replaced(parts: list[int], pair: tuple[int, int], new: int) -> list[int]:
    out, at = [], 0
    while at < len(parts):
        if at + 1 < len(parts) and (parts[at], parts[at + 1]) == pair:
            out.append(new)
            at += 2
        else:
            out.append(parts[at])
            at += 1
    return out


def _merged(parts: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``parts`` after all merges in order of rank, each from left to right; a queue of places keeps long words cheap."""
    parts, size = list(parts), len(parts)
    left, right = list(range(-1, size - 1)), list(range(1, size + 1))
    queue = [(ranks[pair][0], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
    heapq.heapify(queue)
    while queue:
        rank, i = heapq.heappop(queue)
        j = right[i]
        rule = ranks.get((parts[i], parts[j])) if j < size and parts[i] >= 0 else None
        if rule is None or rule[0] != rank:  # one of the two is gone
            continue
        parts[i], parts[j], right[i] = rule[1], -1, right[j]
        if right[i] < size:
            left[right[i]] = i
        for a in (left[i], i):
            if a >= 0 and right[a] < size and (again := ranks.get((parts[a], parts[right[a]]))):
                heapq.heappush(queue, (again[0], a))
    return [p for p in parts if p >= 0]


class _WordEncoder:
    """Applies the merges to one word; a task keeps the words it has met."""

    def __init__(self, ids: dict[str, int], ranks: dict[tuple[int, int], tuple[int, int]], keep: int = 200_000):
        self.ids, self.ranks, self.keep, self.known = ids, ranks, keep, {}

    def __call__(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            found = self._encode(word)
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[word] = found
        return found

    def _encode(self, word: str) -> list[int]:
        return _merged([self.ids[c] for c in word if c in self.ids], self.ranks)


def _slices(batch: pa.RecordBatch, column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    return lists.slices(batch, column, most or _SLICE)


def _encoded(words: pa.ListArray, encode: _WordEncoder) -> pa.ListArray:
    """Ids of lists of words."""
    return lists.replaced(words, encode, pa.int32())


def bpe_encode(df: DataFrame, column: str, model: BpeModel, output: str = "token_ids") -> DataFrame:
    """Text to token ids, row by row: the corpus is not shuffled, the merges travel with the tasks."""
    shown = byte_characters()
    raw = "".join(chr(b) for b in range(256))
    words = F.transform(
        pre_tokens(F.col(column)), lambda w: F.translate(_byte_string(w), raw, "".join(shown))
    )
    ids = {t: i for i, t in enumerate(model.tokens) if len(t) == 1}
    ranks = {(a, b): (rank, new) for rank, (a, b, new) in enumerate(model.merges)}
    shared = df.sparkSession.sparkContext.broadcast((ids, ranks))
    source, names = df.withColumn("_words", words), df.columns
    out = T.StructType(df.schema.fields + [T.StructField(output, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _WordEncoder(*shared.value)
        for batch in batches:
            for part in _slices(batch, "_words"):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), _encoded(part.column("_words"), encode)], names=[*names, output])

    return source.mapInArrow(run, out)


def bpe_decode(token_ids: Column, model: BpeModel) -> Column:
    """Token ids back to text; ids that the model lacks are skipped."""
    of = {c: b for b, c in enumerate(byte_characters())}
    raw = [bytes(of[c] for c in token) for token in model.tokens]
    shared = SparkSession.active().sparkContext.broadcast(raw)

    def text(ids: list[int] | None, tokens: list[bytes]) -> str | None:
        return None if ids is None else b"".join([tokens[i] for i in ids if 0 <= i < len(tokens)]).decode("utf-8", "replace")

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        tokens, batch = shared.value, pa.RecordBatch.from_arrays([rows], names=["ids"])
        parts = [pa.array([text(ids, tokens) for ids in part.column("ids").to_pylist()], pa.string()) for part in _slices(batch, "ids")]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return decode(token_ids)
