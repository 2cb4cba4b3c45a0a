"""Near-duplicate documents by banded MinHash and sequential Bayesian verification.

Texts with the same words are one class, and only classes are compared. Classes that agree in a
band of their signatures are candidates:

1. In every bucket each class is paired with the bucket's smallest class; then, in buckets that
   still hold several components, with one drawn by a hash of bucket and class.
2. Pairs are compared in batches of signature values; a pair goes as soon as the posterior
   probability that its similarity reaches the threshold is below ``miss``. Survivors are verified
   on their full sets of shingles, and verified links give components.
3. In buckets that still hold several components, all pairs across components are compared, in
   blocks of bounded size, on their signatures; survivors are verified too. Pairs inside a
   component need no look: they cannot change it. So no candidate link is lost.

Pairs never travel as rows. Survivors are packed by groups: a center with a bounded number of its
partners, or two tiles of classes that are close to each other. A group's task gets every class in
it once, leaves out pairs that links found before connect already, and returns the links of a
spanning forest. So a large group of near copies costs a few rows a member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import bounded, spread_join, text_of, utf8_slices, with_row_keys
from seqloom.llm.components import components
from seqloom.llm.words import find_words, mix, shingle_hashes
from seqloom.session import materialize, materialize_with

_BLOCK = 2048
_BATCH = 16
_PARTNERS = 64  # of a center, in one group
_TILE_SHINGLES = 100_000
_GROUPED = "ga bigint, gb bigint, nodes array<bigint>, pairs binary"


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80  # linked where 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 4
    miss: float = 1e-6

    @property
    def values(self) -> int:
        return self.bands * self.rows


def least_matches(settings: Settings) -> np.ndarray:
    """Per number of compared values the matches below which the posterior (uniform prior) that the
    similarity reaches the threshold is less than ``miss``."""
    s = (np.arange(4000) + 0.5) / 4000
    above = s >= settings.percent / 100
    out = np.zeros(settings.values + 1, np.int64)
    for n in range(1, settings.values + 1):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            density = np.exp(log - log.max())
            if density[above].sum() >= settings.miss * density.sum():
                out[n] = m
                break
    return out


def _draws(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8191)
    odd = lambda: rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    return odd(), odd()


def signatures(hashes: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """The smallest of n pseudo-random values of each text's shingles; texts without one get 0."""
    out = np.zeros((len(where) - 1, n), np.uint32)
    some = np.flatnonzero(np.diff(where) > 0)
    if len(some) == 0:
        return out
    high, low = (hashes >> np.uint64(32)).astype(np.uint32), hashes.astype(np.uint32)
    for k, (a, b) in enumerate(zip(*_draws(n))):
        out[some, k] = np.minimum.reduceat(high * a + low * b, where[some])
    return out


def _sketcher(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in utf8_slices(batch.column(1)):
                words = find_words(buf, offsets)
                hashes, where = shingle_hashes(words, settings.shingle)
                text = np.repeat(np.arange(hi - lo), np.diff(where))
                order = np.lexsort((hashes, text))
                h, t = hashes[order], text[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                counts = np.bincount(t[fresh], minlength=hi - lo)
                sigs = signatures(hashes, where, settings.values)
                raw = buf.tobytes()
                bounds = offsets.tolist()
                marks = [class_mark(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(lo, hi - lo) for i in (0, 2, 3)),
                        pa.array(marks, pa.binary()),
                        pa.array(counts.astype(np.int64)),
                        pa.array([s.tobytes() if c else None for s, c in zip(sigs, counts)], pa.binary()),
                    ],
                    names=["doc_id", "file", "place", "mark", "n_shingles", "sig"],
                )

    return run


def class_mark(text: bytes) -> bytes:
    """Digest of the sequence of words; equal for texts with the same words."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def shingle_set(text: bytes, size: int) -> frozenset:
    """The set of runs of ``size`` words; of fewer words, the whole sequence."""
    words = text.lower().split()
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[j:] for j in range(size))))


def _packed(ga: np.ndarray, gb: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """One row per group (ga, gb): its distinct nodes and its pairs."""
    order = np.lexsort((b, a, gb, ga))
    ga, gb, a, b = ga[order], gb[order], a[order], b[order]
    cuts = np.flatnonzero(np.concatenate([[True], (ga[1:] != ga[:-1]) | (gb[1:] != gb[:-1])])) if len(ga) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(ga))
    pairs = [np.stack([a[x:y], b[x:y]], 1).astype("<i8") for x, y in zip(cuts, ends)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ga[cuts], pa.int64()),
            pa.array(gb[cuts], pa.int64()),
            pa.array([np.unique(p).tolist() for p in pairs], pa.list_(pa.int64())),
            pa.array([p.tobytes() for p in pairs], pa.binary()),
        ],
        names=["ga", "gb", "nodes", "pairs"],
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ga, gb, a, b -> groups."""
    for batch in batches:
        yield _packed(*(batch.column(i).to_numpy() for i in range(4)))


def _merged(group: pa.Table) -> pa.Table:
    """Rows of one group as one."""
    pairs = np.unique(np.frombuffer(b"".join(group["pairs"].to_pylist()), "<i8").reshape(-1, 2), axis=0)
    whole = [np.full(len(pairs), group[c][0].as_py(), np.int64) for c in ("ga", "gb")]
    return pa.Table.from_batches([_packed(*whole, pairs[:, 0], pairs[:, 1])])


def _group_verifier(settings: Settings, enough: np.ndarray):
    """Members (node, root, sig, text) and packed pairs of one group -> links of a spanning forest."""

    def run(group: pa.Table) -> pa.Table:
        members = group.filter(group["node"].is_valid()).sort_by("node")
        nodes = members["node"].to_numpy()
        packed = group.filter(group["pairs"].is_valid())["pairs"].to_pylist()
        pairs = np.unique(np.frombuffer(b"".join(packed), "<i8").reshape(-1, 2), axis=0)
        i, j = np.searchsorted(nodes, pairs[:, 0]), np.searchsorted(nodes, pairs[:, 1])
        sig = _matrix(members["sig"], settings)
        texts = members["text"].to_pylist()
        parent = {r: r for r in members["root"].to_pylist()}
        root = members["root"].to_pylist()
        sets: dict[int, np.ndarray] = {}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def hashes(k: int) -> np.ndarray:
            if k not in sets:
                raw = np.frombuffer(texts[k].encode(), np.uint8)
                sets[k] = np.unique(shingle_hashes(find_words(raw, np.array([0, len(raw)])), settings.shingle)[0])
            return sets[k]

        def reaches(common: int, x: int, y: int) -> bool:
            return 100 * common >= settings.percent * (x + y - common)

        links = []
        for at in range(0, len(i), 65_536):
            own = slice(at, at + 65_536)
            alive = np.flatnonzero(surviving(sig[i[own]], sig[j[own]], enough)) + at
            for a, b in zip(i[alive].tolist(), j[alive].tolist()):
                p, q = top(root[a]), top(root[b])
                if p == q:
                    continue
                x, y = hashes(a), hashes(b)
                if not reaches(len(np.intersect1d(x, y, True)), len(x), len(y)):  # equal shingles have equal hashes
                    continue
                u, v = (shingle_set(texts[k].encode(), settings.shingle) for k in (a, b))
                if reaches(len(u & v), len(u), len(v)):
                    parent[max(p, q)] = min(p, q)
                    links.append((int(nodes[a]), int(nodes[b])))
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return run


def _matrix(column: pa.Array, settings: Settings) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, settings.values)


def surviving(a: np.ndarray, b: np.ndarray, enough: np.ndarray) -> np.ndarray:
    """Which rows' signatures pass every batch of the comparison."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for at in range(0, a.shape[1], _BATCH):
        stop = min(at + _BATCH, a.shape[1])
        matches[alive] += (a[alive, at:stop] == b[alive, at:stop]).sum(1)
        alive = alive[matches[alive] >= enough[stop]]
    keep = np.zeros(len(a), bool)
    keep[alive] = True
    return keep


def _bucket_rows(classes: DataFrame, settings: Settings) -> DataFrame:
    """band, key, node: one row per band; the band's number is part of the key's hash."""
    size = 4 * settings.rows
    bands = F.posexplode(
        F.transform(
            F.sequence(F.lit(0), F.lit(settings.bands - 1)),
            lambda k: F.xxhash64(k, F.col("sig").substr(k * size + 1, F.lit(size))),
        )
    )
    return classes.filter("sig is not null").select(bands.alias("band", "key"), "node")


def _verified(groups: DataFrame, classes: DataFrame, rooted: DataFrame, rows: DataFrame, settings: Settings, enough: np.ndarray) -> DataFrame:
    """Links u, v (written) of a spanning forest of the packed pairs' links; ``rooted`` has node, root."""
    members = groups.select("ga", "gb", F.explode("nodes").alias("node")).distinct()
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "rep.file", "rep.place", "sig")
    wanted = materialize(wanted.join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "file", "place", "sig"), "wanted")
    # Only the texts in question move, unless there are too many of them to send their places.
    texts = rows.join(bounded(wanted.select("file", "place")), ["file", "place"], "left_semi").join(wanted, ["file", "place"])
    texts = materialize(texts.select("node", "root", "sig", "text"), "candidate-texts")
    nothing = F.lit(None).cast("binary").alias("pairs")
    both = members.join(texts, "node").select("ga", "gb", "node", "root", "sig", "text", nothing)
    both = both.unionByName(groups.select("ga", "gb", "pairs"), True)
    verified = both.groupBy("ga", "gb").applyInArrow(_group_verifier(settings, enough), "u bigint, v bigint")
    return materialize(verified, "links")


def _cross_pairs(settings: Settings, enough: np.ndarray):
    """Sorted rows key, lo, hi, block, band, node, root, tile, n_shingles, sig -> the surviving pairs
    across components, packed by their tiles; of the buckets that two nodes share, the first band's
    one reports them."""

    def compare(rows: pa.RecordBatch) -> pa.RecordBatch:
        lo, hi = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
        band = rows.column(4)[0].as_py()
        block, node, root, tile, n = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 5, 6, 7, 8))
        sig = _matrix(rows.column(9), settings)
        left = np.flatnonzero(block == lo)
        right = left if lo == hi else np.flatnonzero(block == hi)
        found = []
        for i in left:
            other = right[right > i] if lo == hi else right
            small, large = np.minimum(n[other], n[i]), np.maximum(n[other], n[i])
            other = other[(root[other] != root[i]) & (node[other] != node[i]) & (100 * small >= settings.percent * large)]
            if len(other):
                other = other[surviving(np.broadcast_to(sig[i], (len(other), sig.shape[1])), sig[other], enough)]
                earlier = (sig[other, : band * settings.rows] == sig[i, : band * settings.rows]).reshape(len(other), band, settings.rows)
                other = other[~earlier.all(2).any(1)]
                found.append(np.stack([np.full(len(other), i), other]))
        i, j = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        ends, tiles = np.stack([node[i], node[j]]), np.stack([tile[i], tile[j]])
        return _packed(tiles.min(0), tiles.max(0), ends.min(0), ends.max(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(parts):
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                part = batch.slice(at, end - at)
                if held and any(held[0].column(i)[0] != part.column(i)[0] for i in (0, 1, 2)):
                    yield compare(whole(held))
                    held = []
                held.append(part)
        if held:
            yield compare(whole(held))

    return run


def near_duplicates(
    docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", row: list[str] | None = None
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, and the columns ``row``.

    Words are runs of other than white space, A-Z count as a-z. A text without words (or null) has
    no shingles and is linked with nothing. component_id is the smallest id that links reach, rows
    with the same words being linked; ``kept`` marks the rows with that id. Rows without an id count
    where another member has one; a component of unknown ids has the component_id null. With ``row``,
    two columns of numbers that tell rows apart, one row of a component is kept, repeated ids or not.
    """
    if row is None:
        docs, names = with_row_keys(docs)
    else:
        names = row
    keys = [F.col(c).cast("bigint").alias(own) for c, own in zip(names, ("file", "place"))]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"), *keys)
    enough = least_matches(settings)
    schema = "doc_id bigint, file bigint, place bigint, mark binary, n_shingles bigint, sig binary"
    sketched = materialize(rows.mapInArrow(_sketcher(settings), schema), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "file", "place")).alias("rep")
    grouped = sketched.filter("n_shingles > 0").groupBy("mark").agg(
        first, F.count(F.lit(1)).alias("size"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig")
    )
    classes, seen = materialize_with(grouped.withColumn("node", F.monotonically_increasing_id()), "classes", {"rows": F.sum("size")})

    buckets = _bucket_rows(classes, settings)
    shared = buckets.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(buckets.join(shared, "key"), "buckets")
    root_of = F.coalesce("root", "node")

    def several(rooted: DataFrame) -> DataFrame:
        """band, key, node, n, root of the members of buckets with several components."""
        placed = members.join(rooted, "node", "left").select("band", "key", "node", "n", root_of.alias("root"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
        return placed.join(mixed, "key")

    def linked(groups: DataFrame, rooted: DataFrame) -> DataFrame:
        edges = _verified(groups, classes, rooted, rows, settings, enough)
        known = rooted.filter("root != node").select(F.col("node").alias("u"), F.col("root").alias("v"))
        return components(edges.unionByName(known))

    def around(pairs: DataFrame) -> DataFrame:
        """Pairs of a center a with b, and the size n of a bucket of both, in groups of bounded size."""
        each = pairs.groupBy("a", "b").agg(F.max("n").alias("n"))
        part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / F.lit(_PARTNERS))).alias("gb")
        dealt = each.select(F.col("a").alias("ga"), part, F.col("a"), F.col("b")).repartition("ga", "gb")
        return materialize(dealt.mapInArrow(_pack, _GROUPED), "star-groups")

    nothing = classes.select("node", F.col("node").alias("root")).limit(0)
    rooted = linked(around(members.filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"), "n")), nothing)

    centers = several(rooted).groupBy("key").agg(
        F.min_by(F.struct(F.col("node").alias("center"), F.col("root").alias("its")), F.xxhash64("node", "key")).alias("c")
    )
    apart = several(rooted).join(centers.select("key", "c.*"), "key").filter("root != its")
    rooted = linked(around(apart.select(F.col("center").alias("a"), F.col("node").alias("b"), "n")), rooted)

    # In a bucket of two, both were compared as the star already.
    mixed = materialize(several(rooted).filter("n > 2").join(classes.select("node", "n_shingles"), "node"), "mixed-buckets")
    # Classes near each other share their label mostly; a tile is a bounded part of a label's classes.
    labelled = mixed.groupBy("node").agg(F.min("low").alias("label"), F.max("n_shingles").alias("n_shingles"))
    tiles = labelled.groupBy("label").agg(F.ceil(F.sum("n_shingles") / F.lit(_TILE_SHINGLES)).alias("tiles"))
    tile = F.xxhash64("label", F.pmod(F.xxhash64("node"), F.col("tiles"))).alias("tile")
    tiled = labelled.join(tiles, "label").select("node", tile)
    n_blocks = F.ceil(F.col("n") / F.lit(_BLOCK)).cast("int")
    dealt = mixed.withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(tiled, "node").join(classes.select("node", "sig"), "node").select(
        "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "band", "node", "root", "tile", "n_shingles", "sig"
    )
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    more, found = materialize_with(dealt.mapInArrow(_cross_pairs(settings, enough), _GROUPED), "cross-groups", {"n": F.count(F.lit(1))})
    if found["n"]:
        whole = more.select("ga", "gb", "pairs").groupBy("ga", "gb").applyInArrow(_merged, _GROUPED)
        rooted = linked(materialize(whole, "tile-groups"), rooted)

    named = classes.join(rooted, "node", "left").select("mark", "size", "rep", root_of.alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("best"))
    ids = materialize(named.join(smallest, "root").select("mark", "size", "best"), "component-ids")
    told = spread_join(sketched.filter("n_shingles > 0").drop("sig"), ids, ["mark"], "size", seen["rows"] or 0, "place")
    mine = F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    if row is not None:
        mine = mine & (F.col("file") == F.col("best.file")) & (F.col("place") == F.col("best.place"))
    own = [F.col(x).alias(c) for x, c in zip(("file", "place"), row or [])]
    linked_rows = told.select("doc_id", "n_shingles", F.col("best.doc_id").alias("component_id"), mine.alias("kept"), *own)
    alone = sketched.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), *own)
    return linked_rows.unionByName(alone)
