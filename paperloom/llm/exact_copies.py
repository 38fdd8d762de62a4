"""Exact copies by Grace hashing: records go to buckets by their hash, and buckets that don't fit go on to finer ones.

Texts are compared without the white space ``[\\x20\\x09-\\x0D]``. Every task first meets its own rows in an
open-addressing table that compares complete content, so a text that a third of all rows hold leaves the task
once for each table it filled. The contents are written to the shared folder, dealt to buckets by hash, and each
bucket streams through such a table. A bucket whose distinct contents exceed the memory given to it is divided:
the largest of its parts are written out with their content and dealt again by other bits of the hash, until every
part fits. Rows refer to the entry that stands for them, never to a hash, so equal hashes of different
contents stay apart and a group of any size is no key of a join.

Nulls and odd rows: a null text counts as empty, and all empty ones are copies of each other; a null id loses
against any other; of rows that tie in text, length and id, one stays; an empty table gives an empty result; input
columns of any name are carried apart from those of the operator. A text longer than the memory of a table is held alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.words import text_slices
from paperloom.staging import stage

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of UTF-8 that begin no character.
TRAILING = bytes(range(0x80, 0xC0))
#: Contents that a task holds while it reads its rows, and those that it holds of a bucket.
OWN_BYTES, BUCKET_BYTES = 16_000_000, 48_000_000
#: Memory of an entry beside its content, and parts into which a full bucket falls.
ENTRY_BYTES, PARTS = 300, 16

RECORD = "content binary, digest binary, size long, rep long, n long, chars long, keep_id long, keep_row long"
RECORD_TYPES = [pa.binary(), pa.binary(), *[pa.int64()] * 6]
RECORD_NAMES = ["content", "digest", "size", "rep", "n", "chars", "keep_id", "keep_row"]


class ContentTable:
    """Open addressing with linear probing; two entries are equal when their complete contents are.

    An entry counts its rows and knows the one that stays: most characters, smallest id, first row.
    """

    def __init__(self):
        self.slots = [-1] * 64
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.digests: list[bytes] = []
        self.number: list[int] = []
        self.best: list[tuple] = []
        self.reps: list[list[int]] = []
        self.held = 0

    def __len__(self) -> int:
        return len(self.contents)

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = slots = [-1] * (mask + 1)
        for entry, h in enumerate(self.hashes):
            i = h & mask
            while slots[i] >= 0:
                i = (i + 1) & mask
            slots[i] = entry

    def add(self, digest: bytes, content: bytes, rep: int, number: int, best: tuple) -> int:
        """The entry of ``content``, made where there was none."""
        h = int.from_bytes(digest[:8], "little")
        slots, mask = self.slots, len(self.slots) - 1
        i = h & mask
        while (entry := slots[i]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                self.number[entry] += number
                if best < self.best[entry]:
                    self.best[entry] = best
                return entry
            i = (i + 1) & mask
        slots[i] = entry = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.digests.append(digest)
        self.number.append(number)
        self.best.append(best)
        self.reps.append([rep])
        self.held += len(content) + ENTRY_BYTES
        if 3 * len(self.contents) > 2 * len(slots):
            self._grow()
        return entry

    def records(self) -> list[list]:
        """The columns of ``RECORD``: a row for each entry, under its first representative."""
        chars, ids = [-b[0] for b in self.best], [None if b[1] else b[2] for b in self.best]
        return [self.contents, self.digests, [len(c) for c in self.contents], [r[0] for r in self.reps], self.number, chars, ids, [b[3] for b in self.best]]


def _order(chars: int, doc: int | None, row: int) -> tuple:
    return (-chars, doc is None, doc or 0, row)


def _records(rows: DataFrame) -> DataFrame:
    """A row for each input row (its own columns and its representative) and one for each entry of a task's tables."""
    carried_type = rows.schema["carried"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        table, names, kind = ContentTable(), ["carried", "member", *RECORD_NAMES], None

        def entries() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(table.records(), RECORD_TYPES, strict=True)]
            return pa.RecordBatch.from_arrays([pa.nulls(len(table), kind), pa.array([False] * len(table)), *columns], names=names)

        for batch in batches:
            kind = batch.schema.field("carried").type
            ids = batch.column("id")
            for first, last, data, offsets in text_slices(batch.column("text")):
                raw, own = data.tobytes(), ids.slice(first, last - first).to_pylist()
                digests, reps, begin = [], [], row
                for a, b, doc in zip(offsets[:-1].tolist(), offsets[1:].tolist(), own, strict=True):
                    text = raw[a:b]
                    content = text.translate(None, SPACE)
                    digest = hashlib.sha256(content).digest()
                    entry = table.add(digest, content, row, 1, _order(len(text.translate(None, TRAILING)), doc, row))
                    digests.append(digest)
                    reps.append(table.reps[entry][0])
                    row += 1
                none = pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("carried").slice(first, last - first), pa.array([True] * len(own)), pa.nulls(len(own), pa.binary()), pa.array(digests, pa.binary()),
                     none, pa.array(reps, pa.int64()), none, none, none, pa.array(range(begin, row), pa.int64())], names=names)
                if table.held > OWN_BYTES:
                    yield entries()
                    table = ContentTable()
        if len(table):
            yield entries()

    return rows.mapInArrow(run, f"carried {carried_type.simpleString()}, member boolean, {RECORD}")


def _buckets(records: DataFrame, level: int, number: int, bucket_bytes: int) -> DataFrame:
    """Each bucket through tables of its parts.

    A row without ``of`` and ``content`` is settled: ``rep`` belongs to a class of ``n`` rows. One with ``content`` goes to the
    next level; one with ``of`` follows that representative there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [*RECORD_NAMES, "of"], [*RECORD_TYPES, pa.int64()]
        tables: dict[int, ContentTable | None] = {}
        held = 0

        def made(columns: list[list], of: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, of], types, strict=True)], names=names)

        def divided(table: ContentTable) -> Iterator[pa.RecordBatch]:
            yield made(table.records(), [None] * len(table))
            follow = [(r, own[0]) for own in table.reps for r in own[1:]]
            yield made([*[[None] * len(follow)] * 3, [r for r, _ in follow], *[[None] * len(follow)] * 4], [first for _, first in follow])

        for batch in batches:
            on = []
            for k, (content, digest, size, rep, n, chars, doc, row) in enumerate(zip(*(batch.column(c).to_pylist() for c in RECORD_NAMES), strict=True)):
                part = digest[8 + level % 24] % PARTS
                table = tables.setdefault(part, ContentTable())
                if table is None:
                    on.append(k)
                    continue
                before, known = table.held, len(table)
                entry = table.add(digest, content, rep, n, _order(chars, doc, row))
                held += table.held - before
                if len(table) == known:
                    table.reps[entry].append(rep)
                while held > bucket_bytes:
                    part, table = max(((p, t) for p, t in tables.items() if t is not None), key=lambda x: (len(x[1]) > 1, x[1].held))
                    if len(table) < 2:  # one text alone can't be divided
                        break
                    yield from divided(table)
                    tables[part] = None
                    held -= table.held
            if on:
                passed = batch.take(pa.array(on, pa.int64()))
                yield pa.RecordBatch.from_arrays([*passed.columns, pa.nulls(len(on), pa.int64())], names=names)
        for table in tables.values():
            if table is None or not len(table):
                continue
            _, _, _, _, number_, chars, ids, rows = table.records()
            members = [(rep, number_[k], chars[k], ids[k], rows[k]) for k, own in enumerate(table.reps) for rep in own]
            rep, n, chars, ids, rows = zip(*members, strict=True)
            yield made([*[[None] * len(rep)] * 3, rep, n, chars, ids, rows], [None] * len(rep))

    return records.repartition(number, F.xxhash64("digest", F.lit(level))).mapInArrow(run, f"{RECORD}, of long")


def group_copies(docs: DataFrame, carry: Sequence[str] = ("doc_id",), bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The columns ``carry`` of every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (of the text without white space)."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    records = stage(_records(rows), "records")
    members = records.where("member").select("carried", "digest", "rep", F.col("keep_row").alias("row"))
    now, levels = records.where("not member").select(*RECORD_NAMES), []
    while True:
        size, count = now.agg(F.coalesce(F.sum(F.col("size") + ENTRY_BYTES), F.lit(0)), F.count("*")).first()
        if not count:
            break
        number = max(1 + 2 * size // bucket_bytes, min(spark.sparkContext.defaultParallelism, count))
        found = stage(_buckets(now, len(levels), int(number), bucket_bytes), "buckets")
        levels.append(found)
        now = found.where("content is not null").select(*RECORD_NAMES)
    kept = ["rep", "keep_id", "keep_row", "n"]
    settled = spark.createDataFrame([], "rep long, keep_id long, keep_row long, n long")
    for level, found in zip(range(len(levels), 0, -1), reversed(levels), strict=True):
        own = found.where("content is null and of is null").select(*kept)
        if level < len(levels):
            follow = found.where("of is not null").select("rep", "of").join(settled.withColumnRenamed("rep", "of"), "of").select(*kept)
            own = own.unionByName(settled).unionByName(follow)
        settled = own
    joined = members.join(settled, "rep")
    out = [F.col(f"carried.`{c}`").alias(c) for c in carry]
    return joined.select(*out, "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of copies, with all columns."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    return group_copies(whole, ("whole",), bucket_bytes).where("kept").select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns])
