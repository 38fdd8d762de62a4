"""Jaccard join of texts on word shingles by token-combination prefixes.

Tokens (shingles) are ordered rare first, frequent last. Two sets of similarity t share a token within the
first ``n - ceil(t n) + 1`` tokens of each, and k tokens within k - 1 more. Rare tokens of the prefix are
indexed singly. If the first common token is frequent, so are the others: frequent tokens of the longer prefix
are indexed in pairs. Where a text has so many of them that its pairs would be too many, it is indexed by single
frequent tokens, against which all others are indexed too. Every candidate is verified on the whole sets
unless its ends are known to be connected.

How frequent a token is only decides the order, never whether a link is found. Equal sets are one class from
the start. In a bucket of texts that share an index key, all meet the bucket's first text; only pairs
that are then still in different components meet each other, in blocks, behind a bound from bit maps.

Nulls and odd rows: a null, empty or blank text has no shingle and links with nothing; a null id gets a null
component; rows with one id count as one text with several sets; repeated rows link; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.graph import components
from paperloom.llm.sketch import build_filter, passes, sliced
from paperloom.llm.words import frugal, mix, shingle_sets, split_words, text_slices, word_hashes
from paperloom.staging import discarding, share, stage

WIDTH, PERCENT = 5, 80
#: Tokens found in so many sets are frequent; the list holds at most so many (1 MB).
FREQUENT_SETS, FREQUENT_LIST = 64, 1 << 17
#: A text with more frequent prefix tokens than this is indexed by single ones.
MOST_IN_PAIRS = 32
#: Tokens counted at a time, texts of a block, least bits of a bit map.
FLUSH, BLOCK, LEAST_BITS = 2_000_000, 2048, 256
#: Bits a token, before the next power of two, up to a set size; and beyond.
BITS_A_TOKEN, LEAST_BITS_A_TOKEN = ((256, 8), (1024, 4)), 2


def needed_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _hash_sums(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free hashes of every set."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens * np.uint64(k)))]) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
        return tuple(s[bounds[1:]] - s[bounds[:-1]] for s in sums)


def _sets(batch: pa.RecordBatch, width: int):
    """``(ids as numpy with -1 for null, null mask, tokens, bounds)`` for slices of a batch."""
    ids = batch.column("doc_id")
    empty = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(-1).to_numpy()
    for first, last, data, offsets in text_slices(batch.column("text")):
        starts, ends, of = split_words(data, offsets)
        tokens, bounds = shingle_sets(word_hashes(data, starts, ends, lower=True), of, width)
        yield ids[first:last], empty[first:last], tokens, bounds


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _bit_maps(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Bit maps with room for the tokens, most for small sets; longer maps fold onto shorter ones."""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = max(1, b - a)
        room = next((bits for most, bits in BITS_A_TOKEN if n <= most), LEAST_BITS_A_TOKEN)
        size = max(LEAST_BITS, 1 << (room * n - 1).bit_length())
        bits = np.zeros(size, bool)
        bits[(tokens[a:b] % np.uint64(size)).astype(np.int64)] = True
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


SUMMARY = "doc_id long, n long, h1 long, h2 long, bits binary, token long, sets long"


def summaries(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each text (size, hashes and bit map of its set), and partial counts of shared tokens."""

    def run(batches):
        waiting, size, seen = [], 0, set()

        def counts():
            found, number = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = number >= 3
            none = pa.nulls(int(often.sum()), pa.int64())
            return _batch(SUMMARY, none, none, none, none, pa.nulls(len(none), pa.binary()), found[often].view(np.int64), number[often])

        for batch in batches:
            for ids, empty, tokens, bounds in _sets(batch, width):
                h1, h2 = _hash_sums(tokens, bounds)
                none = pa.nulls(len(ids), pa.int64())
                yield _batch(SUMMARY, pa.array(ids, mask=empty), np.diff(bounds), h1.view(np.int64), h2.view(np.int64), _bit_maps(tokens, bounds), none, none)
                fresh = [i for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)) if key not in seen and not seen.add(key)]
                waiting += [tokens[bounds[i] : bounds[i + 1]] for i in fresh]
                size += len(tokens)
                if size > FLUSH:
                    yield counts()
                    waiting, size, seen = [], 0, set()
        yield counts()

    return docs.mapInArrow(frugal(run), SUMMARY)


ENTRY = "key long, rank int, doc_id long, n long"


def index_entries(docs: DataFrame, frequent: np.ndarray, width: int = WIDTH, percent: int = PERCENT, most: int = MOST_IN_PAIRS) -> DataFrame:
    """Index entries of every text. ``rank`` is 0 for rare tokens and pairs; for single frequent tokens 2 if
    the text is indexed by them alone, else 1."""
    shared = share(docs.sparkSession, frequent)

    def entries(ids, tokens, bounds):
        n = np.diff(bounds)
        owner = np.repeat(np.arange(len(n)), n)
        often = shared.value
        at = np.searchsorted(often, tokens)
        hot = (often[np.minimum(at, len(often) - 1)] == tokens) if len(often) else np.zeros(len(tokens), bool)
        hot_before = np.concatenate([[0], np.cumsum(hot)])
        hots = hot_before[bounds[1:]] - hot_before[bounds[:-1]]
        among_hot = hot_before[:-1] - hot_before[bounds[owner]]
        place = np.where(hot, (n - hots)[owner] + among_hot, np.arange(len(tokens)) - bounds[owner] - among_hot)
        prefix = (n - needed_overlap(n, percent) + 1)[owner]
        rare = np.flatnonzero(~hot & (place < prefix))
        yield tokens[rare], np.zeros(len(rare), np.int32), owner[rare]
        longer = np.flatnonzero(hot & (place < prefix + 1))
        if not len(longer):
            return
        own = owner[longer]
        number = np.bincount(own, minlength=len(n))
        heavy = number > most
        single = longer[place[longer] < prefix[longer]]
        with np.errstate(over="ignore"):
            yield mix(tokens[single] ^ np.uint64(0x5851F42D4C957F2D)), np.where(heavy[owner[single]], 2, 1).astype(np.int32), owner[single]
            light = longer[~heavy[own]]
            for step in range(1, most):
                one, two = light[:-step], light[step:]
                both = owner[one] == owner[two]
                if not both.any():
                    break
                one, two = one[both], two[both]
                yield mix(mix(tokens[one]) * np.uint64(3) + tokens[two]), np.zeros(len(one), np.int32), owner[one]

    def run(batches):
        for batch in batches:
            seen = set()
            for ids, empty, tokens, bounds in _sets(batch, width):
                h1, h2 = _hash_sums(tokens, bounds)
                fresh = np.array([not null and n > 1 and key not in seen and not seen.add(key) for null, n, key in zip(empty, np.diff(bounds), zip(h1.tolist(), h2.tolist(), strict=True), strict=True)], bool)
                n = np.diff(bounds)
                tokens = tokens[np.repeat(fresh, n)]
                ids, n = ids[fresh], n[fresh]
                bounds = np.concatenate([[0], np.cumsum(n)])
                for keys, rank, owner in entries(ids, tokens, bounds):
                    yield _batch(ENTRY, keys.view(np.int64), rank, ids[owner], n[owner])

    return docs.mapInArrow(frugal(run), ENTRY)


BUCKET = "key long, doc_id long, n long, leader long, leader_n long"


def buckets(entries: DataFrame) -> DataFrame:
    """Members of index buckets with the bucket's first text, the first excepted; buckets of one text vanish.

    The sorted entries stream through a task, so a bucket of any size takes no memory. A bucket of single
    frequent tokens counts only if a text in it is indexed by them alone.
    """

    def run(batches):
        last = None
        for batch in batches:
            key, rank, doc, n = (batch.column(c).to_numpy() for c in ("key", "rank", "doc_id", "n"))
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            lead = np.stack([doc, n, rank.astype(np.int64)])
            if last is not None and last[0] == key[0]:
                new[0] = False
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first = lead[:, np.maximum(at, 0)]
            if last is not None:
                first = np.where(at < 0, np.array(last[1:])[:, None], first)
            keep = ~new & (first[2] != 1) & (first[0] != doc)
            yield _batch(BUCKET, key[keep], doc[keep], n[keep], first[0][keep], first[1][keep])
            last = (key[-1], *first[:, -1])

    ordered = entries.repartition("key").sortWithinPartitions("key", F.desc("rank"), "doc_id")
    return ordered.mapInArrow(run, BUCKET)


SETS = "doc_id long, tokens binary"


def token_sets(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """Sets of the texts whose id is in ``wanted(doc_id)``; a filter of fixed size spares the others."""

    def packed(batches):
        for batch in batches:
            for part, raw in sliced(mix(batch.column("doc_id").to_numpy().view(np.uint64))):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw], pa.binary())], names=["slice", "hashes"])

    shared = share(docs.sparkSession, build_filter(wanted.mapInArrow(packed, "slice int, hashes binary")))

    def run(batches):
        for batch in batches:
            known = passes(mix(batch.column("doc_id").fill_null(-1).to_numpy().view(np.uint64)), shared.value)
            batch = batch.filter(pa.array(known & ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)))
            for ids, _, tokens, bounds in _sets(batch, width):
                yield _batch(SETS, ids, [tokens[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])

    return docs.mapInArrow(frugal(run), SETS).join(wanted, "doc_id", "left_semi")


def _least_common(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection with 100 i >= percent (na + nb - i)."""
    return -(-percent * (na + nb) // (100 + percent))


def _possible(na, nb, ma: list[bytes], mb: list[bytes], percent) -> np.ndarray:
    """False where the bit maps prove that the sets have too few tokens in common."""
    least = _least_common(na, nb, percent)
    out = np.zeros(len(na), bool)
    lengths = np.array([(len(x), len(y)) for x, y in zip(ma, mb, strict=True)], np.int64).reshape(-1, 2)
    for la, lb in np.unique(lengths, axis=0):
        at = np.flatnonzero((lengths == (la, lb)).all(axis=1))
        for some in np.array_split(at, max(1, len(at) * int(max(la, lb)) // 8_000_000)):
            one, two = (np.frombuffer(b"".join([m[i] for i in some.tolist()]), np.uint64).reshape(len(some), -1) for m in (ma, mb))
            words = min(one.shape[1], two.shape[1])
            one, two = (np.bitwise_or.reduce(x.reshape(len(some), -1, words), axis=1) for x in (one, two))
            only_a = np.bitwise_count(one & ~two).sum(axis=1, dtype=np.int64)
            only_b = np.bitwise_count(two & ~one).sum(axis=1, dtype=np.int64)
            out[some] = (na[some] - only_a >= least[some]) & (nb[some] - only_b >= least[some])
    return out


def possible(pairs: DataFrame, sizes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` that ``sizes(doc_id, n, bits)`` can't rule out."""

    def bounded(batches):
        for batch in batches:
            if len(batch):
                keep = _possible(*(batch.column(c).to_numpy() for c in ("na", "nb")), *(batch.column(c).to_pylist() for c in ("ma", "mb")), percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    one = sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ma"))
    two = sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("mb"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(frugal(bounded), "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` that link, by the whole sets of their texts; only those texts are cut again."""

    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stage(pairs, "pairs")
    wanted = stage(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    sets = stage(token_sets(texts, wanted, width), "sets")
    one, two = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(frugal(exact), "a long, b long").distinct()


def unresolved(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of ``members(key, block, a, label, n, bits)`` that share key and block, differ in label, and may
    link by size and bit map. A group has at most two blocks of about ``BLOCK`` texts."""

    def compared(table: pa.Table):
        key, block, ids, label, n = (table.column(c).to_numpy() for c in ("key", "block", "a", "label", "n"))
        maps = table.column("bits").to_pylist()
        at, step = np.arange(len(key)), 0
        while True:
            step += 1
            at = at[at + step < len(key)]
            at = at[(key[at] == key[at + step]) & (block[at] == block[at + step])]
            if not len(at):
                return
            for part in np.array_split(at, max(1, len(at) // 20_000)):
                to = part + step
                some = (label[part] != label[to]) & (100 * np.minimum(n[part], n[to]) >= percent * np.maximum(n[part], n[to]))
                one, two = part[some], to[some]
                some = _possible(n[one], n[two], [maps[i] for i in one.tolist()], [maps[i] for i in two.tolist()], percent)
                one, two = ids[one[some]], ids[two[some]]
                yield np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1)

    def run(batches):
        rest = None

        def flush(table):
            found = list(compared(table))
            found = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            return _batch("a long, b long", found[:, 0], found[:, 1])

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
            same = (key == key[-1]) & (block == block[-1])
            whole = len(key) - int(same[::-1].argmin() if not same.all() else len(key))
            if whole:
                yield flush(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None and len(rest):
            yield flush(rest)

    return members.repartition("key", "block").sortWithinPartitions("key", "block", "a").mapInArrow(frugal(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, frequent_sets: int = FREQUENT_SETS, most: int = MOST_IN_PAIRS, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = stage(summaries(texts, width), "shingles")
    rows = told.where("token is null").select("doc_id", "n", "h1", "h2")
    with discarding(docs.sparkSession) as keep:
        often = told.where("token is not null").groupBy("token").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= frequent_sets)
        often = often.orderBy(F.desc("sets"), "token").limit(FREQUENT_LIST).select("token").toPandas()["token"].to_numpy(np.int64)  # at most 1 MB
        frequent = np.sort(often.view(np.uint64))

        classes = rows.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
        # A text whose set others have too joins its class; all others are their own.
        of = stage(rows.where("n > 0 and doc_id is not null").join(classes.select("rep", F.col("n").alias("cn"), F.col("h1").alias("c1"), F.col("h2").alias("c2")), F.expr("n = cn and h1 = c1 and h2 = c2")).where("rep <> doc_id").select("doc_id", "rep").distinct(), "classes")

        members = stage(buckets(index_entries(texts, frequent, width, percent, most)), "buckets")
        # Near texts share many keys: of the buckets with the same members one is enough.
        same = [F.sum(F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(1 << 31))).alias(f"s{i}") for i in (1, 2)]
        keys = members.groupBy("key", "leader", "leader_n").agg(F.count("*").alias("texts"), *same).groupBy("leader", "leader_n", "texts", "s1", "s2").agg(F.min("key").alias("key"))
        members = members.join(keys.select("key"), "key", "left_semi")
        for name in ("doc_id", "leader"):  # equal sets stand for each other
            members = members.join(of.select(F.col("doc_id").alias(name), "rep"), name, "left").withColumn(name, F.coalesce("rep", name)).drop("rep")
        members = stage(members.where("doc_id <> leader").distinct(), "members")
        whole = members.select("doc_id").unionByName(members.select(F.col("leader").alias("doc_id"))).distinct()
        sizes = stage(told.where("token is null and n > 0").select("doc_id", "n", "bits").join(whole, "doc_id", "left_semi"), "sizes")

        close = members.where(100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n"))
        stars = close.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()
        links = stage(verified(possible(stars, sizes, percent), texts, width, percent).unionByName(of.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "links")
        labels = stage(components(links), "labels")

        # The bucket's first text has met all others.
        marked = members.select("key", F.col("doc_id").alias("a"), "n").distinct().join(labels.withColumnRenamed("id", "a"), "a", "left").withColumn("label", F.coalesce("component", "a")).drop("component")
        open_keys = marked.groupBy("key").agg(F.count("*").alias("texts"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        open_keys = open_keys.select("key", F.expr(f"cast(ceil(texts / {block}) as long)").alias("blocks"))
        dealt = marked.join(open_keys, "key").withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")))
        dealt = dealt.select("key", "a", "label", "n", "own", "blocks", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
        dealt = dealt.withColumn("block", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).select("key", "block", "a", "label", "n")
        bits = sizes.select(F.col("doc_id").alias("a"), "bits")
        more = verified(unresolved(dealt.join(bits, "a"), percent), texts, width, percent)
        found = keep(stage(components(links.unionByName(more)), "components"))

    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the texts that are not the first of their component; a row with a null id stays."""
    found = near_duplicates(docs, **options).where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(found, docs["doc_id"] == found["gone"], "left_anti")
