"""Near-duplicates by b-bit MinHash.

A text's set holds the hashes of its distinct word shingles. Texts with equal sets are one class, found by a hash of
the whole set, so copies of any number cost a row of an aggregation each and no pair. For one text of each class, the
minima of 190 hash functions give 38 band keys of 5 minima; of each minimum the low 4 bits are kept, packed into 12
longs. A class meets, in each band bucket, the bucket's centre, the class that shares most with others (a star, not all
pairs); agreement of the packed
signatures, counted in bits and corrected for chance collisions (1/16), estimates the similarity, and pairs whose
estimate is far below the threshold (4.5 standard deviations) go. What is left is confirmed on the full sets.

Stars link a bucket's members only through its centre. So where a bucket holds more than one component after that, its
members are compared with each other exactly: by the prefix filter over shingles ordered from rare to frequent, whose
candidates (in different components, of fitting sizes) are confirmed on the full sets. Variants of one text that stay
just under the threshold differ in their rare shingles, so that they give few candidates however many they are. Two
texts at the threshold share no bucket with a chance of 3e-7, less above it.

A pair is confirmed where the centre's text and its partners' meet: the centre is sent once for each CENTRE_ROWS of its
partners, who pass by in a stream. Shingles of many postings are joined in parts, so that no task gets all of one.

Null and empty texts, and texts of white space, have an empty set and link with nothing. Texts under k words are one
shingle. Repeated rows are copies of each other. Rows that repeat an id with other texts are documents of their own:
each is in the class of its text. Extra columns are left out; an empty table gives an empty result. Ids are integers;
rows with a null id link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.llm.common import connected_components, discard, staged
from pipelens.llm.shingles import mix, shingle_sets

BANDS, ROWS, BITS = 38, 5, 4
HASHES = 192
#: Below the threshold by this much an estimate rules a pair out: 4.5 standard deviations of an estimate at 0.8.
MARGIN = 0.13
#: Buckets of the table of counts that orders shingles; it is collected and sent to all tasks, 2 MB.
ORDER = 1 << 18
LONGS = HASHES * BITS // 64
#: Partners that a centre's text is sent to at once; postings of a shingle that one part of its join holds.
CENTRE_ROWS, POSTINGS = 512, 4096
_A = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_C = (mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    half = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(half), 256):
        part = half[at : at + 256, None] * _A + _C
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(low, part.min(0), out=low)
    return low


def signature(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima (mixed first, as a minimum's own bits lean to 0), packed into longs."""
    bits = mix(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    return (bits.reshape(LONGS, -1) << shifts).sum(1, dtype=np.uint64).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    for j in range(ROWS):
        keys = mix(keys * np.uint64(31) + rows[:, j])
    return keys.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "th", "n_shingles", "s1", "s2", "sig", "bands"]
    for batch in batches:
        n, sums, sigs, bands, at = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            ids, hashes = batch.column(0)[at : at + len(n)], batch.column(2)[at : at + len(n)]
            both = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
            lists = [
                pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int64), *x])))
                for x in (sigs, bands)
            ]
            return pa.RecordBatch.from_arrays([ids, hashes, pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), *lists], names=names)

        for found in shingle_sets(batch.column(1), k):
            n.append(len(found))
            mixed = mix(found)
            sums.append((int(mixed.sum(dtype=np.uint64)), int(mix(mixed + np.uint64(1)).sum(dtype=np.uint64))))
            if len(found):
                low = minima(found)
                sigs.append(signature(low))
                bands.append(band_keys(low))
            else:
                sigs.append(np.zeros(0, np.int64))
                bands.append(np.zeros(0, np.int64))
            if len(n) == 2000:
                yield out()
                at += len(n)
                n, sums, sigs, bands = [], [], [], []
        if n:
            yield out()


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, th, n_shingles, s1, s2, sig, bands): th is the text's hash, s1 and s2 stand for the whole set; sig and
    bands of empty sets are empty."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("th")).mapInArrow(
        lambda batches: _sketch(batches, k),
        "doc_id long, th long, n_shingles long, s1 long, s2 long, sig array<long>, bands array<long>",
    )


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures, corrected for low bits that agree by chance."""
    ones = int("1" * (64 // BITS), 16)
    differ = F.lit(0)
    for j in range(LONGS):
        x = F.col(a)[j].bitwiseXOR(F.col(b)[j])
        for step in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(ones)))
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differ / F.lit(float(HASHES))) - chance) / (1 - chance)


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (v, salt, partner, id, text): a centre's text, then its partners'."""
    centre, other = None, None
    for batch in batches:
        centres, partner, ids = (batch.column(c).to_pylist() for c in (0, 2, 3))
        u, v = [], []
        for i, own in enumerate(shingle_sets(batch.column(4), k)):
            if not partner[i]:
                centre, other = centres[i], own
            elif centre == centres[i] and 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)):
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    u.append(ids[i])
                    v.append(centre)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def texts_of_classes(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text): one text of each class that ``wanted(id)`` names."""
    some = classes.select(F.col("rep").alias("id"), "doc_id", "th").join(wanted.distinct(), "id", "left_semi")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    return texts.join(some, ["doc_id", "th"]).groupBy("id").agg(F.first("text").alias("text"))


def _share(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(ORDER, np.int64)
    for batch in batches:
        for found in shingle_sets(batch.column(0), k):
            np.add.at(counts, (found % np.uint64(ORDER)).astype(np.int64), 1)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], order: np.ndarray, k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of each text its rarest shingles: as many as no partner of its size or more can all lack (indexed), and no smaller
    partner (the rest)."""
    names = ["id", "component", "n", "token", "at", "indexed"]
    for batch in batches:
        ids, components = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        columns: list[list] = [[] for _ in names]
        for i, found in enumerate(shingle_sets(batch.column(2), k)):
            n = len(found)
            probe = n - -(-percent * n // 100) + 1
            index = n - -(-2 * percent * n // (100 + percent)) + 1
            ranks = order[(found % np.uint64(ORDER)).astype(np.int64)]
            best = np.lexsort((found, ranks))[:probe]
            for c, v in zip(columns, (np.full(len(best), ids[i]), np.full(len(best), components[i]), np.full(len(best), n), found[best].view(np.int64), np.arange(len(best)), np.arange(len(best)) < index)):
                c.append(v)
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)


def prefix_pairs(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v) of ``texts(id, text, component)`` in different components that may be similar enough: no such pair is missed.

    Shingles are ordered from rare to frequent, by counts in a table of ORDER buckets (any order is right; this one is
    fast). Two similar sets share one of the first shingles of each: of the smaller one, those that are indexed.
    """
    counts = texts.select("text").mapInArrow(lambda batches: _share(batches, k), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    order = np.zeros(ORDER, np.int64)
    found = counts.toPandas()  # ORDER rows at most
    order[found["bucket"].to_numpy(np.int64)] = found["n"]
    rows = staged(
        texts.select("id", "component", "text").mapInArrow(
            lambda batches: _prefixes(batches, order, k, percent), "id long, component long, n long, token long, at long, indexed boolean"
        ),
        "prefixes",
    )
    small = rows.where("indexed").select("token", F.col("id").alias("u"), F.col("component").alias("cu"), F.col("n").alias("nu"), F.col("at").alias("pu"))
    large = rows.select("token", F.col("id").alias("v"), F.col("component").alias("cv"), F.col("n").alias("nv"), F.col("at").alias("pv"))
    fits = (F.col("cu") != F.col("cv")) & (100 * F.col("nu") >= percent * F.col("nv")) & (F.struct("nu", "u") < F.struct("nv", "v"))
    # The first shingle that two sets share leaves room for enough others behind it.
    room = (100 + percent) * (1 + F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv")) - 1) >= percent * (F.col("nu") + F.col("nv"))
    heavy = staged(rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > POSTINGS).select("token", F.ceil(F.col("c") / POSTINGS).alias("parts")), "heavy")
    keys = ["token"]
    if not heavy.isEmpty():  # one side of such a shingle is dealt to parts, the other goes to each
        parts = F.coalesce("parts", F.lit(1))
        small = small.join(heavy, "token", "left").withColumn("part", F.pmod(F.xxhash64("u"), parts)).drop("parts")
        large = large.join(heavy, "token", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
        keys = ["token", "part"]
    return small.join(large, keys).where(fits & room).select("u", "v").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs(u, v)`` of classes whose full sets, of ``texts(id, text)``, are similar enough."""
    crowds = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / CENTRE_ROWS).alias("salts"))
    salted = pairs.join(crowds, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("salts")).alias("salt"))
    partners = salted.select(F.col("u").alias("id"), "v", "salt").join(texts, "id").select("v", "salt", F.lit(True).alias("partner"), "id", "text")
    centres = salted.select("v", "salt").distinct().withColumn("id", F.col("v")).join(texts, "id").select("v", "salt", F.lit(False).alias("partner"), "id", "text")
    met = centres.unionByName(partners).repartition("v", "salt").sortWithinPartitions("v", "salt", "partner")
    return staged(met.mapInArrow(lambda batches: _confirm(batches, k, percent), "u long, v long"), "links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, th, leader), a row for each row of ``docs``.

    Texts link where 100 * size of intersection >= percent * size of union. component_id is the least id that links
    reach; kept marks the rows that have it. th is xxhash64 of the text; leader marks the document (doc_id, th) that
    comes first in its component, all documents without a word among them.
    """
    all_docs = staged(sketches(docs, k).withColumn("class", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("s1", "s2", "n_shingles"))), "sketches")
    classes = staged(
        all_docs.where("class is not null").groupBy(F.col("class").alias("rep"))
        .agg(F.min(F.struct("doc_id", "th")).alias("one"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .select("rep", "one.doc_id", "one.th", "sig", "bands"),
        "classes",
    )
    members = classes.select(F.explode("bands").alias("key"), "rep")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    shared = staged(members.join(sizes.select("key", "n"), "key"), "hits")
    # The text that most others resemble shares the most buckets, and the largest: the best centre of its buckets.
    weight = shared.groupBy("rep").agg(F.sum("n").alias("weight"))
    centres = shared.join(weight, "rep").groupBy("key").agg(F.max(F.struct("weight", "rep")).alias("best")).select("key", F.col("best.rep").alias("centre"))
    hits = staged(shared.select("key", "rep").join(centres, "key"), "hits")
    discard(shared)
    sigs = classes.select("rep", "sig")
    floor = percent / 100 - MARGIN
    pairs = hits.where("rep <> centre").select(F.col("rep").alias("u"), F.col("centre").alias("v")).distinct()
    pairs = staged(
        pairs.join(sigs.select(F.col("rep").alias("u"), F.col("sig").alias("a")), "u")
        .join(sigs.select(F.col("rep").alias("v"), F.col("sig").alias("b")), "v")
        .where(estimate("a", "b") >= floor)
        .select("u", "v")
        .distinct(),
        "pairs",
    )
    needed = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id")))
    texts = staged(texts_of_classes(docs, classes, needed), "texts")
    links = confirmed(pairs, texts, k, percent)
    discard(texts, pairs)
    component = connected_components(links)

    # Buckets that hold several components still: their members meet by the prefix filter, which loses no link.
    named = staged(
        hits.join(component.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
            "key", "rep", F.coalesce("component", "rep").alias("component")
        ),
        "members",
    )
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    unsettled = staged(named.join(mixed, "key").select(F.col("rep").alias("id"), "component").distinct(), "unsettled")
    discard(hits, named)
    if not unsettled.isEmpty():
        texts = staged(texts_of_classes(docs, classes, unsettled.select("id")).join(unsettled, "id"), "texts")
        more = staged(prefix_pairs(texts, k, percent), "pairs")
        if not more.isEmpty():
            before = component
            component = connected_components(links.unionByName(confirmed(more, texts.select("id", "text"), k, percent)))
            discard(before)
        discard(texts, more)
    grouped = classes.join(component.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "rep", F.coalesce("component", "rep").alias("component"), F.struct("doc_id", "th").alias("one")
    )
    first = grouped.groupBy("component").agg(F.min("one").alias("first"))
    tops = grouped.join(first, "component").select(F.col("rep").alias("class"), "first")
    here = F.struct("doc_id", "th")
    return all_docs.select("doc_id", "th", "n_shingles", "class").join(tops, "class", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("first.doc_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("first.doc_id", "doc_id"), F.lit(True)).alias("kept"),
        "th",
        F.coalesce(here == F.col("first"), F.lit(True)).alias("leader"),
    )
