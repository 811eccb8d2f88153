"""SimHash near-dedup with multi-index hashing.

``simhash_dedup`` links fingerprints of 64 bits.  Their two halves are the
segments: two fingerprints within four bits have a half within two, and so some
32-bit value within one bit of both.  Each fingerprint enumerates the ball of
radius one around each half, what meets under a value is fetched, and its whole
distances are verified.

``near_copy_dedup`` links texts by the similarity of their word shingles.  At a
similarity of 0.8 about 15 % of a fingerprint's bits differ, too many for 64
bits, so it takes 512 bits, looks up 20 segments of 25 bits each by balls of
radius one on both sides, verifies the whole distances, and then the true
similarity of what is left; what hangs together by distance, but not by
similarity, is compared again by its sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from memlake.llm.components import connected_components
from memlake.llm.scratch import BATCH_BYTES, bounded_batches, discard, written
from memlake.llm.shingles import WIDE, set_table, shingle_sets, similar, similar_pairs, texts_of, wide_fingerprint
from memlake.llm.substring_dedup import mix

RADIUS = 4
SEED = 42
#: Numbers of fingerprints whose distances are computed at once.
BLOCK = 2048
_BALL = np.concatenate([[0], 1 << np.arange(32)]).astype(np.uint64)
#: Parts of the other half, one of which agrees within the radius: 6 + 6 + 6 + 7 + 7 bits.
_PARTS = ((0, 6), (6, 6), (12, 6), (18, 7), (25, 7))
#: Segments of a wide fingerprint, their bits, and the lower ones of them that balls reach into.
SEGMENTS, SEGMENT_BITS, BALL_BITS = 20, 25, 19
#: Trees of a part of a cut bucket whose leaders meet first: those of at least one in so many of its rows.
LEADERS = 64
_WIDE_BALL = np.concatenate([[0], 1 << np.arange(BALL_BITS)]).astype(np.uint64)
ROW = "__row"
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", BATCH_BYTES: str(8 << 20)}


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64 majority bits over the XXH64 of all word shingles, repeats included; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = xxhash.xxh64_digest(b" ".join(words), SEED)
        n = 1
    else:
        line = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(sizes)
        start = end - sizes
        digest = xxhash.xxh64_digest
        n = len(words) - shingle + 1
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(start[:n].tolist(), (end[shingle - 1 :] - 1).tolist(), strict=True)])
    return majority(np.frombuffer(hashes, np.uint8).reshape(n, 8))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the rows of eight bytes, the highest first."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = parent[up]


class Forest:
    """Joins what is linked, and keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = _roots(self.parent, a), _roots(self.parent, b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            hi, first = np.unique(np.maximum(ra, rb), return_index=True)
            self.parent[hi] = np.minimum(ra, rb)[first]
            self.links.append(np.stack([a[first], b[first]], axis=1))

    def edges(self) -> np.ndarray:
        return np.concatenate(self.links) if self.links else np.empty((0, 2), np.int64)


def _within(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
    return a[near], b[near]


def _link_group(fps: np.ndarray, g: np.ndarray, forest: Forest) -> None:
    """All pairs of a group, in blocks."""
    for i in range(0, len(g), BLOCK):
        for j in range(i, len(g), BLOCK):
            a, b = np.nonzero(np.bitwise_count(fps[g[i : i + BLOCK], None] ^ fps[g[j : j + BLOCK]][None, :]) <= RADIUS)
            if i == j:
                a, b = a[a < b], b[a < b]
            forest.add(g[i + a], g[j + b])


def _link_runs(fps: np.ndarray, keys: np.ndarray, members: np.ndarray, other: np.ndarray, forest: Forest, wide: int) -> None:
    """Links the members that meet under one key.

    A group of over ``wide`` is split by parts of its members' other halves:
    members within the radius agree in one of the five parts, so no link is lost.
    """
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, members = keys[order], members[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.diff(at)
    few = np.repeat((size > 1) & (size <= 32), size)
    k, m = keys[few], members[few]
    for step in range(1, int(size[size <= 32].max(initial=1))):
        same = np.flatnonzero(k[step:] == k[:-step])
        forest.add(*_within(fps, m[same], m[same + step]))
    for n in np.flatnonzero(size > 32).tolist():
        g = members[at[n] : at[n + 1]]
        if len(g) <= wide:
            _link_group(fps, g, forest)
            continue
        for shift, bits in _PARTS:
            part = (other[g] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            o = np.argsort(part, kind="stable")
            for x in np.split(g[o], np.flatnonzero(np.diff(part[o])) + 1):
                _link_group(fps, x, forest)


def fingerprint_links(distinct: DataFrame, n_buckets: int, wide: int = 4096) -> DataFrame:
    """``(a, b)``: links between different fingerprints that join all within the radius.

    ``distinct`` has one row per fingerprint.  A bucket holds a share of the
    segments' values; within it, links that add nothing to its forest are left
    out, so a group of near copies gives as many links as it has fingerprints.
    """

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(whole), 1 << 14):
                fps = whole[k : k + (1 << 14)]
                parts = []
                for half in (0, 1):
                    seg = (fps >> np.uint64(32)) if half else (fps & np.uint64(0xFFFFFFFF))
                    key = (seg[:, None] ^ _BALL[None, :]).ravel() | (np.uint64(half) << np.uint64(32))
                    bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(n_buckets)
                    parts.append((bucket, key, np.repeat(fps, len(_BALL))))
                bucket, key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                rows = np.stack([key[order], fp[order]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([rows[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary())], names=["bucket", "rows"])

    def link(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), np.uint64).reshape(-1, 2)
        fps, member = np.unique(rows[:, 1], return_inverse=True)
        forest = Forest(len(fps))
        for half in (0, 1):
            own = (rows[:, 0] >> np.uint64(32)) == half
            other = (fps & np.uint64(0xFFFFFFFF)) if half else (fps >> np.uint64(32))
            _link_runs(fps, rows[own, 0], member[own], other, forest, wide)
        pairs = fps[forest.edges()].view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    sent = distinct.select("fp").mapInArrow(balls, "bucket long, rows binary")
    return sent.groupBy("bucket").applyInArrow(link, "a long, b long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, rows_per_bucket: int = 200_000) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z lower-cased; fewer
    words than a shingle make one of the whole sequence, and a text without
    words (null, empty) has fingerprint zero, which links like any other.
    Fingerprints link at four or fewer differing bits, and a component is named
    by the smallest id reachable.  Null ids never name a component unless all of
    its ids are null (then null).  Rows that repeat an id are rows of their own.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("low")), "fingerprint-classes")
    n = distinct.count()
    links = written(fingerprint_links(distinct, max(64, n * 2 * len(_BALL) // rows_per_bucket)), "fingerprint-links")
    comp = written(connected_components(links), "fingerprint-components")
    discard(links)
    named = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    named = written(named, "fingerprint-named")
    discard(comp, distinct)
    lows = written(named.groupBy("component").agg(F.min("low").alias("component_id")), "component-ids")
    of_fp = written(named.join(lows, "component").select("fp", "component_id"), "fingerprint-ids")
    discard(named, lows)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(of_fp, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


# --- wide fingerprints -------------------------------------------------------


def distance_bounds(t: Fraction) -> tuple[int, int]:
    """Bits in which the wide fingerprints of sets of similarity ``t`` differ: on average, and at most but for one pair in 30,000."""
    bits = 64 * WIDE
    p = math.acos(2 * t / (1 + t)) / math.pi
    return round(bits * p), round(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WIDE)


def _segment(fps: np.ndarray, j: int) -> np.ndarray:
    word, shift = divmod(SEGMENT_BITS * j, 64)
    out = fps[:, word] >> np.uint64(shift)
    if shift + SEGMENT_BITS > 64:
        out = out | (fps[:, word + 1] << np.uint64(64 - shift))
    return out & np.uint64((1 << SEGMENT_BITS) - 1)


def _met(keys: np.ndarray, member: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Pairs that connect all members that lie within ``radius`` under one key, nearest first.

    The first member of a key's group meets all others.  Those near it are done:
    they hang together through it.  The others go on in the same way.  One that
    is not near the first may still be near a member that is done; it can only be
    so within the radius and that member's distance from the first (distances of
    bits are a metric), and is then compared with those.
    """
    order = np.lexsort((member, keys))
    k, m = keys[order], member[order]
    found, joined = [np.empty((0, 3), np.int64)], Forest(len(fps))
    while len(k):
        new = np.concatenate([[True], k[1:] != k[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(k)))
        lead = np.repeat(m[start], size)
        alone = np.repeat(size == 1, size)
        apart = np.empty(len(k), np.int64)
        for i in range(0, len(k), 1 << 16):
            apart[i : i + (1 << 16)] = _apart(fps[lead[i : i + (1 << 16)]], fps[m[i : i + (1 << 16)]])
        near = apart <= radius
        hit = near & (lead != m)
        found.append(np.stack([lead[hit], m[hit], apart[hit]], axis=1))
        joined.add(lead[hit], m[hit])
        widest = np.repeat(np.maximum.reduceat(np.where(near, apart, 0), start), size)
        ring = np.flatnonzero(~near & (apart <= radius + widest))
        ring = ring[_roots(joined.parent, m[ring]) != _roots(joined.parent, lead[ring])]
        group = np.cumsum(new) - 1
        for g in np.unique(group[ring]).tolist():
            mine = slice(start[g], start[g] + size[g])
            done = m[mine][hit[mine]]
            outer = m[ring[group[ring] == g]]
            for i in range(0, len(outer), 64):
                some = outer[i : i + 64]
                d = _apart(fps[some][:, None], fps[done][None])
                best = d.argmin(axis=1)
                least = d[np.arange(len(some)), best]
                ok = least <= radius
                found.append(np.stack([done[best[ok]], some[ok], least[ok]], axis=1))
                joined.add(done[best[ok]], some[ok])
        k, m = k[~near & ~alone], m[~near & ~alone]
    pairs = np.concatenate(found)
    return pairs[np.argsort(pairs[:, 2], kind="stable")]


def _bucket_links(blobs: list[bytes], own_balls: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of what is near under a key in these rows, and the rows that lead its ``LEADERS`` largest trees at most."""
    rows = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, WIDE + 3)
    # An order of each segment's own, so that a group has another leader in each.
    rows = rows[np.argsort(mix(rows[:, 2] + (rows[:, 0] >> np.uint64(32))), kind="stable")]
    ids, at, member = np.unique(rows[:, 1], return_index=True, return_inverse=True)
    by_rank = np.argsort(at)
    rank = np.argsort(by_rank)
    ids, fps, member = ids[by_rank], rows[at[by_rank], 3:], rank[member]
    keys, of = rows[:, 0], member
    if own_balls:
        keys, of = (keys[:, None] ^ _WIDE_BALL).ravel(), np.repeat(member, len(_WIDE_BALL))
    pairs = _met(keys, of, fps, radius)
    forest = Forest(len(ids))
    forest.add(pairs[:, 0], pairs[:, 1])
    roots = _roots(forest.parent, np.arange(len(ids)))
    large = np.bincount(roots, minlength=len(ids)) * LEADERS >= len(ids)
    return ids[forest.edges()].view(np.int64), rows[large[member] & (roots[member] == member)]


def wide_pairs(nodes: DataFrame, n: int, radius: int, rows_per_bucket: int = 100_000) -> DataFrame:
    """``(a, b)``: pairs of nodes ``(node, digest, fp)`` within ``radius`` that connect all nodes which meet under a segment within it.

    A bucket holds the fingerprints that agree in a segment's upper bits; balls
    in its lower bits are enumerated there.  Where buckets would be too large,
    the balls' values are sent instead, to as many buckets as are needed; what is
    connected is the same either way.

    A bucket that still is much larger than others, because very many texts are
    near one, is cut into salted parts.  Each part sends on only the rows that
    lead its large trees, and these meet in the bucket.  What is not joined by then,
    but has a key in common there, is compared in tiles, so a cut loses no link.
    """
    upper = 1 << (SEGMENT_BITS - BALL_BITS)
    sent_balls = n > rows_per_bucket * upper
    n_buckets = SEGMENTS * (upper if not sent_balls else -(-n * len(_WIDE_BALL) // (rows_per_bucket * 8)))
    heavy_rows = 4 * rows_per_bucket * (8 if sent_balls else 1)

    def placed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each segment: buckets, keys and rows of the batch."""
        fps = _words(batch.column("fp"))
        for j in range(SEGMENTS):
            key, own = _segment(fps, j), np.arange(len(fps))
            if sent_balls:
                key, own = (key[:, None] ^ _WIDE_BALL).ravel(), np.repeat(own, len(_WIDE_BALL))
                bucket = mix(key | np.uint64(j << 32)) % np.uint64(n_buckets)
            else:
                bucket = (key >> np.uint64(BALL_BITS)) + np.uint64(j * upper)
            yield bucket, key | np.uint64(j << 32), own

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, _, _ in placed(batch):
                names, count = np.unique(bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(count)], names=["bucket", "n"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(k, BLOCK)
                fps, ids = _words(batch.column("fp")), batch.column("node").to_numpy().view(np.uint64)
                salt = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint64)[::2]
                for bucket, key, own in placed(batch):
                    order = np.argsort(bucket, kind="stable")
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
                    rows = np.column_stack([key, ids[own], salt[own], fps[own]])[order]
                    names = bucket[order][cut[:-1]].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([rows[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["bucket", "rows"])

    def link(table: pa.Table) -> pa.Table:
        edges, leaders = _bucket_links(table.column("rows").to_pylist(), not sent_balls, radius)
        cut = table.column("salts")[0].as_py() is not None
        a, b = edges.min(axis=1).tolist(), edges.max(axis=1).tolist()
        more = [leaders[k : k + BLOCK].tobytes() for k in range(0, len(leaders), BLOCK)] if cut else []
        none = [None] * len(more)
        bucket = [None] * len(a) + [table.column("bucket")[0].as_py()] * len(more)
        return pa.table([pa.array(a + none, pa.int64()), pa.array(b + none, pa.int64()), pa.array(bucket, pa.int64()), pa.array([None] * len(a) + more, pa.binary())], names=["a", "b", "bucket", "rows"])

    given = nodes.select("node", "digest", "fp")
    sent, no_salts = given.mapInArrow(spread, "bucket long, rows binary"), F.lit(None).cast("long")
    found = "a long, b long, bucket long, rows binary"
    load = given.mapInArrow(sizes, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > heavy_rows)
    heavy = written(load.select("bucket", F.ceil(F.col("n") / heavy_rows).cast("long").alias("salts")), "near-heavy")
    if heavy.isEmpty():
        return sent.withColumn("salts", no_salts).groupBy("bucket").applyInArrow(link, found).select("a", "b").distinct()
    parts = sent.join(heavy, "bucket", "left").withColumn("salt", F.pmod(F.xxhash64("rows"), F.coalesce("salts", F.lit(1))))
    first = written(parts.groupBy("bucket", "salt").applyInArrow(link, found), "near-parts")
    second = first.where("rows is not null").select("bucket", "rows").withColumn("salts", no_salts).groupBy("bucket").applyInArrow(link, found)
    links = written(first.where("rows is null").select("a", "b").unionByName(second.select("a", "b")).distinct(), "near-part-links")
    labels = connected_components(links).toDF("node", "label")
    own = written(given.join(labels, "node", "left").select("node", "fp", F.coalesce("label", "node").alias("label")), "near-part-labels")
    names = np.array([r.bucket for r in heavy.select("bucket").collect()], np.int64)  # one for so many rows

    def keyed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys and rows of the batch in the buckets that were cut."""
        for bucket, key, row in placed(batch):
            here = np.isin(bucket.astype(np.int64), names)
            key, row = key[here], row[here]
            if not sent_balls:
                key, row = (key[:, None] ^ _WIDE_BALL).ravel(), np.repeat(row, len(_WIDE_BALL))
            yield key.view(np.int64), row

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy()
            for key, row in keyed(batch):
                order = np.lexsort((label[row], key))
                key, of = key[order], label[row][order]
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
                last = np.append(new[1:], len(key)) - 1 if len(key) else order
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[new], of[new], of[last])], names=["key", "low", "high"])

    def under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            for key, row in keyed(batch):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[row])], names=["cluster", "node"])

    mixed = own.mapInArrow(ends, "key long, low long, high long").groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    mixed = written(mixed.where("low <> high").select(F.col("key").alias("cluster")), "near-mixed")
    members = own.select("node", "fp").mapInArrow(under, "cluster long, node long").join(mixed, "cluster", "left_semi").join(own, "node")
    rest = tile_links(members.withColumn("set", F.col("fp")), radius, None)
    return links.unionByName(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def tile_links(members: DataFrame, radius: int, t: Fraction | None, tile_bytes: int = 1 << 20) -> DataFrame:
    """``(a, b)``: similar pairs of members ``(node, cluster, label, fp, set)`` that have one cluster and different labels; without ``t`` those within ``radius``.

    A label of many bytes is cut into blocks of its own, the small ones of a
    cluster share blocks; two blocks of a cluster meet in a tile, unless both are
    of one label.  A tile compares whole fingerprints, then whole sets, and leaves
    out pairs that its own links already join.
    """
    size = members.groupBy("cluster", "label").agg(F.sum(F.length("set")).alias("bytes"))
    size = size.withColumn("big", F.col("bytes") > tile_bytes)
    small = size.where("not big").groupBy("cluster").agg(F.ceil(F.sum("bytes") / tile_bytes).alias("mixed"))
    size = size.join(small, "cluster", "left").select("cluster", "label", "big", F.when(F.col("big"), F.ceil(F.col("bytes") / tile_bytes)).otherwise(F.col("mixed")).alias("parts"))
    owner = F.when(F.col("big"), F.col("label"))
    part = F.when(F.col("big"), F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("label"), F.col("parts")))
    dealt = members.join(size, ["cluster", "label"]).select("node", "cluster", "label", "fp", "set", F.struct(owner.alias("owner"), part.alias("part")).alias("block"))
    dealt = written(dealt, "near-dealt")
    blocks = dealt.select("cluster", "block").distinct()
    other = blocks.select("cluster", F.col("block").alias("q"))
    same = F.col("p.owner").isNotNull() & (F.col("p.owner") == F.col("q.owner"))
    tiles = blocks.select("cluster", F.col("block").alias("p")).join(other, "cluster").where((F.col("p") <= F.col("q")) & ~F.coalesce(same, F.lit(False)))
    of_block = tiles.select("cluster", F.struct("p", "q").alias("tile"), F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, label = (table.column(c).to_numpy() for c in ("node", "label"))
        fps = _words(table.column("fp"))
        sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        first = np.array(table.column("first").to_pylist())
        whole = first.all()  # a block with itself
        names, tree = np.unique(label, return_inverse=True)
        joined, links = Forest(len(names)), []
        for x in range(len(node)) if whole else np.flatnonzero(first).tolist():
            y = np.arange(x + 1, len(node)) if whole else np.flatnonzero(~first)
            if t is not None:
                y = y[(sizes[y] * t.denominator >= sizes[x] * t.numerator) & (sizes[x] * t.denominator >= sizes[y] * t.numerator)]
            y = y[_roots(joined.parent, tree[y]) != _roots(joined.parent, tree[[x]])[0]]
            apart = _apart(fps[y], fps[x])
            y = y[np.argsort(apart, kind="stable")][: int((apart <= radius).sum())]
            while len(y):
                if t is None or similar(sets[x], sets[y[0]], t):
                    links.append((node[x], node[y[0]]))
                    joined.add(tree[[x]], tree[y[:1]])
                    y = y[_roots(joined.parent, tree[y]) != _roots(joined.parent, tree[[x]])[0]]
                else:
                    y = y[1:]
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    met = dealt.join(of_block, ["cluster", "block"]).select("cluster", "tile", "node", "label", "fp", "set", (F.col("block") == F.col("tile.p")).alias("first"))
    return met.groupBy("cluster", "tile").applyInArrow(link, "a long, b long")


def _linked(full: DataFrame, texts: DataFrame, shingle: int, t: Fraction) -> DataFrame:
    """``(node, component)`` of the nodes ``(node, digest, fp)`` that are similar to another."""
    met = written(wide_pairs(full, full.count(), distance_bounds(t)[1]), "near-met")
    ends = met.select(F.explode(F.array("a", "b")).alias(ROW)).distinct()
    sets = written(set_table(texts.join(ends, ROW, "left_semi"), shingle, ROW), "near-sets")
    links = written(similar_pairs(met, sets, t), "near-links")
    labels = written(connected_components(links), "near-labels")
    # What met hangs together in clusters.  Where that takes links that failed, members of
    # different labels may be similar all the same, and are compared.
    clusters = connected_components(met).toDF("node", "cluster").join(labels, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("label"))
    clusters = written(clusters, "near-clusters")
    split = clusters.groupBy("cluster").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("cluster")
    members = clusters.join(split, "cluster").join(full.select("node", "fp"), "node").join(sets, "node")
    more = written(tile_links(members, distance_bounds(t)[1], t), "near-more")
    discard(met, sets, clusters)
    if more.isEmpty():
        return labels
    out = written(connected_components(links.unionByName(more)), "near-components")
    discard(links, labels, more)
    return out


def _going(rows: DataFrame, id_col: str, text_col: str, shingle: int, t: Fraction) -> DataFrame:
    """``(__row)`` of the numbered rows that go."""
    texts = rows.select(ROW, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, fps = [], []
            for s in shingle_sets(texts_of(batch), shingle):
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                fps.append(wide_fingerprint(s) if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("id"), pa.array(digests, pa.binary()), pa.array(fps, pa.binary())], names=[ROW, "id", "digest", "fp"])

    sketches = written(texts.mapInArrow(sketch, f"{ROW} long, id long, digest binary, fp binary"), "near-sketches")
    low = F.struct(F.col("id").isNull().alias("none"), "id", ROW)
    # Rows of equal sets are one node, named by the row of the smallest id.
    nodes = sketches.groupBy("digest").agg(F.min(low).alias("low"), F.min("fp").alias("fp"))
    nodes = written(nodes.select("digest", F.col(f"low.{ROW}").alias("node"), "low", "fp"), "near-nodes")
    same = written(sketches.select("digest", ROW).join(nodes.select("digest", "node"), "digest").where(F.col(ROW) != F.col("node")).select(ROW), "near-same")
    discard(sketches)
    comp = _linked(nodes.where(F.length("fp") > 0).select("node", "digest", "fp"), texts, shingle, t)
    named = written(nodes.join(comp, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component")), "near-named")
    stays = named.groupBy("component").agg(F.min("low").alias("low")).select(F.col(f"low.{ROW}").alias("node"))
    goes = written(same.unionByName(named.join(stays, "node", "left_anti").select(F.col("node").alias(ROW))), "near-goes")
    discard(nodes, same, comp, named)
    return goes


def near_copy_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs``, with all columns, of each group of near copies.

    Two rows are linked where the Jaccard similarity of their sets of ``shingle``
    words is ``similarity`` or more, which is verified for every link; a group is
    what links reach.  Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; fewer
    words than a shingle make one of the whole sequence, and texts without words
    (null, empty) are copies of each other.  The row with the smallest id stays;
    a null id counts as larger than any other, and of rows that share an id and
    a group one stays.  An empty table gives an empty result.

    Equal sets always meet.  Others meet by their fingerprints, under a segment
    and within a radius that all but one pair in 30,000 of that similarity keep:
    a pair at 0.8 with a chance of 0.97, one at 0.9 nearly always.  What
    meets forms clusters, of any number of rows, and each similar pair of a
    cluster within the radius is linked, whichever of its rows met each other.
    Pairs that links already join are not compared; a cluster of ``m`` rows whose
    links leave ``g`` groups costs up to ``m * g`` comparisons of fingerprints, in
    tiles of 2 MB of their sets.
    """
    conf = docs.sparkSession.conf
    had = {k: conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        conf.set(k, v)
    given, own = (docs.withColumnRenamed(ROW, f"{ROW}_given"), True) if ROW in docs.columns else (docs, False)
    try:
        rows = written(given.withColumn(ROW, F.monotonically_increasing_id()), "near-rows")
        goes = _going(rows, id_col, text_col, shingle, Fraction(str(similarity)))
    finally:
        for k, v in had.items():
            conf.set(k, v) if v is not None else conf.unset(k)
    out = rows.join(goes, ROW, "left_anti").drop(ROW)
    return out.withColumnRenamed(f"{ROW}_given", ROW) if own else out
