"""Byte-level BPE of texts of any length: overlapping chunks, stitched where their pre-tokens meet again.

Short texts are encoded where they are read. Longer ones are dealt to tasks in chunks that overlap; a chunk
and its follower agree from the first pre-token boundary that both scans share, and the text between two such
points is encoded on its own. Chunks without a common boundary are joined first, so the ids are those of the
whole text. Decoding concatenates the bytes of the ids.

Nulls and odd rows: a null or empty text has no ids; repeated rows are returned as often as they came; a null
id is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Characters of a chunk and of the overlap with the next one.
CHUNK, OVERLAP = 32_768, 1_024
KEPT_TOKENS, KEPT_CHARS = 400_000, 40

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id long, n_tokens long, ids binary"


class Coder:
    """Ids by pre-token; a worker process keeps what it has encoded for its later tasks."""

    _kept: dict[str, bytes] = {}
    _of = None

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        mark = hashlib.sha256(ranks.encode()).digest()
        if Coder._of is None or Coder._of[0] != (mark, pattern):
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
            by_id = dict(zip(table.values(), table.keys(), strict=True))
            # White space as in the vocabulary's library, where the separators U+001C to U+001F aren't any.
            own = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
            Coder._kept = {}
            Coder._of = ((mark, pattern), tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={}), by_id, own)
        _, self.encoding, self.by_id, self.pattern = Coder._of

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; each pre-token is merged separately."""
        kept = Coder._kept
        if len(kept) > KEPT_TOKENS:
            kept.clear()
        out = []
        for token in self.pattern.findall(text):
            ids = kept.get(token)
            if ids is None:
                ids = np.array(self.encoding.encode_ordinary(token), "<u4").tobytes()
                if len(token) <= KEPT_CHARS:
                    kept[token] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def boundaries(self, text: str, start: int = 0) -> np.ndarray:
        """Ends of the pre-tokens from ``start`` on, ``start`` first; the last ones may move if text followed."""
        return np.array([start, *(m.end() for m in self.pattern.finditer(text, start))])


def meeting_point(coder: Coder, text: str, follower: int) -> int | None:
    """First boundary that the scans from 0 and from ``follower`` share and that later text can't move."""
    common = np.intersect1d(coder.boundaries(text), coder.boundaries(text, follower), assume_unique=True)
    common = common[(common >= follower) & (common <= len(text) - 2)]
    return int(common[0]) if len(common) else None


def encode(docs: DataFrame, ranks: str, pattern: str, digest: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every text, or with ``digest`` hashes of the ids and of the decoded bytes.

    ``ranks`` is the text of a rank file. The ids of a text are one value, as the text itself is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def finished(ids: pa.Array, encoded: list[list[bytes]], coder: Coder) -> pa.RecordBatch:
        """``encoded``: the ids of a row, in parts."""
        sizes = pa.array([sum(map(len, parts)) // 4 for parts in encoded], pa.int64())
        if not digest:
            return pa.RecordBatch.from_arrays([ids, sizes, pa.array([b"".join(parts) for parts in encoded], pa.binary())], names=["doc_id", "n_tokens", "ids"])
        hashes = []
        for parts in encoded:
            own, decoded = hashlib.sha256(), hashlib.sha256()
            for part in parts:
                own.update(part)
                decoded.update(coder.decode(part))
            hashes.append((own.hexdigest(), decoded.hexdigest()))
        return pa.RecordBatch.from_arrays([ids, sizes, *(pa.array([h[i] for h in hashes], pa.string()) for i in (0, 1))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = DIGEST if digest else IDS

    def encode_short(batches):
        coder = Coder(shared.value, pattern)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield finished(part.column("doc_id"), [[coder.encode(t.as_py() or "")] for t in part.column("text")], coder)

    size = F.length("text")
    short = docs.where(F.coalesce(size, F.lit(0)) <= chunk).mapInArrow(encode_short, schema)

    # Equal rows have equal ids: they are encoded once, under the hash of their text.
    long = docs.where(size > chunk).select("doc_id", "text", F.sha2("text", 256).alias("h"), size.cast("long").alias("size"))
    chunks = long.dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "size", "text", F.explode(F.expr(f"sequence(0L, (size - 1) div {chunk})")).alias("k"))
    chunks = chunks.select("doc_id", "h", "size", "k", F.expr(f"substring(text, cast(k * {chunk} + 1 as int), {chunk + overlap})").alias("part")).repartition("h", "k")

    def meet(batches):
        coder = Coder(shared.value, pattern)
        for batch in batches:
            points = []
            for k, size, part in zip(*(batch.column(c).to_pylist() for c in ("k", "size", "part")), strict=True):
                last = (k + 1) * chunk >= size
                point = size if last else meeting_point(coder, part, chunk)
                points.append(point if last or point is None else k * chunk + point)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(points, pa.int64())], names=[*batch.schema.names, "point"])

    met = chunks.mapInArrow(meet, "doc_id long, h string, size long, k long, part string, point long")
    by_text = Window.partitionBy("doc_id", "h").orderBy("k")
    met = met.withColumn("begin", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.lag("point").over(by_text)))
    met = met.withColumn("piece", F.last("begin", ignorenulls=True).over(by_text))
    # From the piece's begin or the chunk's own to the next chunk's, or to the meeting point that ends the piece.
    low, high = F.greatest("piece", F.col("k") * chunk), F.coalesce("point", (F.col("k") + 1) * chunk)
    own = F.expr(f"substring(part, cast(greatest(piece, k * {chunk}) - k * {chunk} + 1 as int), cast(coalesce(point, (k + 1) * {chunk}) - greatest(piece, k * {chunk}) as int))")
    pieces = met.where(low < high).select("doc_id", "h", "piece", F.struct("k", own.alias("t")).alias("own")).groupBy("doc_id", "h", "piece").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list("own")), lambda x: x["t"])).alias("text"))

    def encode_pieces(batches):
        coder = Coder(shared.value, pattern)
        for batch in batches:
            encoded = [coder.encode(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h", "piece")), pa.array(encoded, pa.binary())], names=["doc_id", "h", "piece", "ids"])

    encoded = pieces.mapInArrow(encode_pieces, "doc_id long, h string, piece long, ids binary")
    whole = encoded.groupBy("doc_id", "h").agg(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"]).alias("parts"))

    def finish_long(batches):
        coder = Coder(shared.value, pattern)
        for batch in batches:
            for at in range(0, len(batch), 16):
                part = batch.slice(at, 16)
                done = finished(part.column("doc_id"), [p.as_py() for p in part.column("parts")], coder)
                yield pa.RecordBatch.from_arrays([*done.columns, part.column("h")], names=[*done.schema.names, "h"])

    done = whole.mapInArrow(finish_long, schema + ", h string").withColumnRenamed("doc_id", "id").withColumnRenamed("h", "hash")
    rows = long.select("doc_id", "h")
    found = rows.join(done, rows["doc_id"].eqNullSafe(done["id"]) & (rows["h"] == done["hash"])).drop("id", "hash", "h")
    return short.unionByName(found)
