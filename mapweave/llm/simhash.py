"""SimHash near-duplicates by pigeonhole blocks.

**Fingerprints within a few bits** (``near_groups``). A 64-bit fingerprint of each text's word shingles; equal
fingerprints are collapsed first. Fingerprints are cut into ``blocks`` blocks; two that differ in at most ``max_bits``
bits agree in at least blocks - max_bits of them, so each choice of that many blocks is a key to meet on, and no pair
is lost. Rows with one key are streamed in sorted order, the Hamming distances within a run are computed by numpy, and
each batch gives the edges of a spanning forest rather than all its pairs. Runs of more than ``tile`` fingerprints are
not compared in one task: they are dealt out as pairs of tiles. The default of 7 blocks makes 35 keys of 27 or 28 bits:
at 10^9 distinct fingerprints a key holds a handful.

**Texts with a similarity of 0.8 or more** (``drop_near_copies``, for the pipeline). At a Jaccard similarity of 0.8 two
texts differ in about 15 % of a 64-bit fingerprint's bits, too many for its blocks. There the fingerprint is as long as
that takes: the different five-word shingles are dealt by their hash into parts of about the same number, and each part
has a 64-bit SimHash of its own, a block of the fingerprint. A shingle that only one of two texts has changes one block;
the blocks without any such shingle are equal. A table by size (``Layout``) says how many parts there are and how many
of them are written as blocks, so that a pair at exactly 0.8 shares no block with a probability of at most 1 in 100,000,
whatever the length (closer pairs: less). Texts that share a block are candidates and are compared by
the exact similarity of the shingles' hashes (``_block_links``): first with the least text of each of their blocks, then
those that this leaves apart, by blocks that hang together or block by block, whichever moves less. Blocks that are
equal by chance link nothing. Members of one group already found aren't compared again by tiles of their own, and none
of more than ``tile`` shingles meets another in one task.

Null and empty texts have no words and the fingerprint zero (for drop_near_copies: one empty shingle); they link like
any other. Fewer words than a shingle's are one shingle. In near_groups rows with a null id get a component like all
rows; nulls are passed over when its smallest id is taken. drop_near_copies keeps of each group the row with the
smallest id (nulls last), of rows with that id the one with the least text digest, of equal rows any one; its extra
columns pass through, whatever their names. near_groups ignores extra columns. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, in_batches, named, sliced, stage, table, texts_of, with_numbers
from .components import components


def fingerprint(text: str, width: int = 4) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = max(1, len(words) - width + 1)
    xxh = xxhash.xxh64_intdigest
    hashes = np.array([xxh(line[a:b], 42) for a, b in zip(starts[:k].tolist(), (ends[-k:] - 1).tolist(), strict=True)], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, k, 65536):
        part = hashes[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > k, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """docs' columns without text, and fp (the fingerprint as a signed long)."""
    at = docs.columns.index("text")
    fields = [f for i, f in enumerate(docs.schema) if i != at] + [T.StructField("fp", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in texts_of(batch, at)], dtype=np.uint64).view(np.int64)
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fp)], [str(i) for i in range(len(fields))])

    return in_batches(docs, run, fields)


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """The masks, as signed longs, of each choice of blocks - max_bits blocks out of blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    of = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    masks = [sum(of[i] for i in c) for c in combinations(range(blocks), blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars with the same components as the edges u, v."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, label = ends[: len(u)], ends[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _links(run_of: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of the pairs within max_bits in each run of equal values of the sorted array run_of."""
    us, vs, size = [], [], 0
    left, d = np.arange(len(fp) - 1), 1
    while len(left):
        left = left[left + d < len(fp)]
        left = left[run_of[left] == run_of[left + d]]
        a, b = fp[left], fp[left + d]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits
        us.append(a[near])
        vs.append(b[near])
        size += int(near.sum())
        if size > 1 << 20:
            u, v = _forest(np.concatenate(us), np.concatenate(vs))
            us, vs, size = [u], [v], 0
        d += 1
    if not size:
        return fp[:0], fp[:0]
    return _forest(np.concatenate(us), np.concatenate(vs))


def _meet(keyed: DataFrame, keys: list[str], max_bits: int, tile: int | None) -> DataFrame:
    """Edges (u, v) of rows with equal keys; with tile, members of larger runs come back as (u, null, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rest, hot = ["fp", *keys], None, None

        def out(u, v, key=None):
            cols = [pa.array(u), pa.array(v) if v is not None else pa.nulls(len(u), pa.int64())]
            cols += [pa.array(np.asarray(x, np.int64)) for x in key] if key is not None else [pa.nulls(len(u), pa.int64())] * len(keys)
            return pa.RecordBatch.from_arrays(cols, ["u", "v", *keys])

        def done(cols):
            """Whole runs."""
            change = np.concatenate(([0], np.cumsum(np.any([c[1:] != c[:-1] for c in cols[1:]], axis=0))))
            if tile is not None and len(change):
                large = np.bincount(change)[change] > tile
                if large.any():
                    yield out(cols[0][large], None, [c[large] for c in cols[1:]])
                    cols, change = [c[~large] for c in cols], change[~large]
            u, v = _links(change, cols[0], max_bits) if len(change) else (cols[0], cols[0])
            if len(u):
                yield out(u, v)

        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            if not len(cols[0]):
                continue
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if hot is not None:  # the run that is being passed on goes on here
                same = np.all([c == h for c, h in zip(cols[1:], hot, strict=True)], axis=0)
                n = int(same.sum())
                yield out(cols[0][:n], None, [c[:n] for c in cols[1:]])
                cols = [c[n:] for c in cols]
                if not len(cols[0]):
                    rest = None
                    continue
                hot = None
            last = np.all([c == c[-1] for c in cols[1:]], axis=0)
            at = len(last) - int(last[::-1].argmin() if not last.all() else len(last))
            if at:
                yield from done([c[:at] for c in cols])
            rest = [c[at:] for c in cols]
            if tile is not None and len(rest[0]) > tile:
                hot = [c[0] for c in rest[1:]]
                yield out(rest[0], None, rest[1:])
                rest = None
        if rest is not None and len(rest[0]):
            yield from done(rest)

    dealt = keyed.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInArrow(run, ", ".join(["u long", "v long", *(f"{k} long" for k in keys)]))


def near_links(fps: DataFrame, max_bits: int = 4, blocks: int = 7, tile: int = 4096) -> DataFrame:
    """Edges (u, v) that connect all distinct values of fps.fp within max_bits, without all pairs of a group."""
    masks = block_masks(blocks, max_bits)
    key = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks))))
    keyed = fps.select("fp", key.alias("x")).select("fp", "x.c", "x.k")
    met = stage(_meet(keyed, ["c", "k"], max_bits, tile))
    edges, large = met.filter("v is not null").select("u", "v"), met.filter("v is null").select(F.col("u").alias("fp"), "c", "k")
    if large.isEmpty():
        return edges
    sizes = large.groupBy("c", "k").agg(F.ceil(F.count(F.lit(1)) / tile).alias("n"))
    t = large.join(sizes, ["c", "k"]).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("n")))
    cells = t.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    cells = cells.select("fp", "c", "k", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"))
    return edges.union(_meet(cells, ["c", "k", "a", "b"], max_bits, None).select("u", "v"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", max_bits: int = 4, blocks: int = 7, tile: int = 4096, width: int = 4) -> DataFrame:
    """id_col, fp and component_id, one row for each document."""
    marked = stage(fingerprints(docs.select(named(id_col).alias("id"), "text"), width))
    fps = stage(marked.groupBy("fp").agg(F.min("id").alias("first")))
    linked = components(near_links(fps, max_bits, blocks, tile)).select(F.col("node").alias("fp"), "root")
    rooted = stage(fps.join(linked, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    # written, so that the rows of a hot root or fingerprint can be split in the joins
    smallest = stage(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = stage(rooted.join(smallest.hint("merge"), "root").select("fp", "component_id"))
    return marked.join(classes.hint("merge"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


# ---- texts with a similarity of 0.8 or more


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Ascending hashes of the text's different shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k, xxh = len(words) - width + 1, xxhash.xxh3_64_intdigest
    return np.unique(np.array([xxh(line[a:b]) for a, b in zip(starts[:k].tolist(), (ends[-k:] - 1).tolist(), strict=True)], np.uint64))


class Layout:
    """How texts with ``lo`` to ``hi`` different shingles (and those of the next smaller size that reach them) are dealt.

    A pair at the similarity of 0.8 has at most (a + b) / 9 shingles that only one of the two has. A part is good if it
    has a common shingle and none of those: of ``parts`` parts each is with a probability of g at least, and all of
    ``blocks`` parts fail with (1 - g) ^ blocks at most, as the numbers in the parts are negatively associated.
    parts is the least number, so the parts are as large as can be, for which ``most`` blocks are enough. Where there
    are fewer parts than blocks the shingles are dealt again by another hash.
    """

    def __init__(self, level: int, most: int = 52, loss: float = 1e-5):
        bound = lambda k: math.ceil(4 * 2 ** (k / 2))
        self.level, self.lo, self.hi = level, bound(level), bound(level + 1) - 1
        self.least = math.ceil(0.8 * self.lo)
        cases = [(2 * self.hi // 9, self.hi - self.hi // 9), (self.lo - self.least, self.least)]  # differing, common
        at = lambda m: min((1 - 1 / m) ** d * (1 - (1 - 1 / m) ** c) for d, c in cases)
        need = lambda m: math.ceil(math.log(loss) / math.log1p(-max(at(m), 1e-9)))
        low, high = 1, 2
        while need(high) > most:
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if need(mid) <= most else (mid, high)
        self.parts, self.blocks = high, need(high)


_LAYOUTS: list[Layout] = []
#: Changes the hashes before each deal.
_DEALS = np.arange(64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def layouts(n: int) -> list[Layout]:
    """The layouts that a text with n different shingles has blocks in; with fewer than 4 only equal sets are similar."""
    if n < 4:
        return []
    level = int(2 * math.log2(n / 4))
    while len(_LAYOUTS) < level + 3:
        _LAYOUTS.append(Layout(len(_LAYOUTS)))
    return [x for x in _LAYOUTS[max(0, level - 1) : level + 3] if x.least <= n <= x.hi]


def simhash_blocks(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingles: a signed long for each block, of its SimHash, its place and the layout."""
    out = []
    for x in layouts(len(hashes)):
        deals = -(-x.blocks // x.parts)
        h = hashes if deals == 1 else (hashes ^ _DEALS[:deals, None]).ravel()
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        part = ((h >> np.uint64(32)) * np.uint64(x.parts) >> np.uint64(32)).astype(np.int64)
        if deals > 1:
            part += np.repeat(np.arange(deals) * x.parts, len(hashes))
        own = np.flatnonzero(part < x.blocks)
        own = own[np.argsort(part[own], kind="stable")]
        if not len(own):
            continue
        part = part[own]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        bits = np.unpackbits(hashes[own % len(hashes)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.uint32)
        n = np.diff(first, append=len(own))[:, None]
        sim = np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64)[:, 0]
        key = (sim ^ (part[first] + ((x.level << 32) + 1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xA0761D6478BD642F)
        key ^= key >> np.uint64(29)
        out.append(key * np.uint64(0xE7037ED1A0B428DB))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def similar(sets: list[np.ndarray], num: int = 4, den: int = 5) -> list[tuple[int, int]]:
    """Forest edges (places in sets) with the components of all pairs whose Jaccard similarity is num / den or more."""
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(code, np.cumsum(size)[:-1])
    left, edges = np.arange(len(sets)), []
    while len(left) > 1:
        # the places of each shingle among the texts without a component
        part = np.concatenate([own[i] for i in left])
        order = np.argsort(part, kind="stable")
        place = np.repeat(np.arange(len(left)), size[left])[order]
        begin = np.searchsorted(part[order], np.arange(code.max() + 2))
        free, queue, done = np.ones(len(left), bool), [0], 0
        free[0] = False
        while done < len(left):
            if not queue:
                if 2 * done > len(left):
                    break
                queue = [int(free.argmax())]
                free[queue[0]] = False
            at = queue.pop()
            done += 1
            a, b = begin[own[left[at]]], begin[own[left[at]] + 1]
            n = b - a
            met = place[np.repeat(b - np.cumsum(n), n) + np.arange(n.sum())]
            both = np.bincount(met[free[met]], minlength=len(left))
            hit = np.flatnonzero(free & ((num + den) * both >= num * (size[left] + size[left[at]])))
            free[hit] = False
            edges += [(int(left[at]), int(left[i])) for i in hit]
            queue += hit.tolist()
        left = left[free]
    return edges


def _sketches(numbered: DataFrame, width: int) -> DataFrame:
    """row, id, digest of the text, key (a hash of the set of shingles), n (of shingles) and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, sizes, found, digests = [], [], [], []
            for t in texts_of(batch):
                h = shingles(t, width)
                keys.append(int.from_bytes(xxhash.xxh3_64_digest(h.tobytes()), "big", signed=True))
                sizes.append(len(h))
                found.append(simhash_blocks(h))
                digests.append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
            cols = [pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *cols], ["row", "id", "digest", "key", "n", "blocks"])

    kind = numbered.schema["id"].dataType.simpleString()
    return numbered.mapInArrow(run, f"row long, id {kind}, digest binary, key long, n long, blocks array<long>")


def _compared(cells: DataFrame, width: int) -> DataFrame:
    """Edges (u, v) of the similar texts in each cell (root, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets = None, [], []

        def done():
            found = similar(sets) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([keys[e[i]] for e in found], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in ("root", "a", "b")), strict=True)
            for cell, key, text in zip(names, batch.column("key").to_pylist(), texts_of(batch), strict=True):
                if cell != now:
                    yield done()
                    now, keys, sets = cell, [], []
                keys.append(key)
                sets.append(shingles(text, width))
        yield done()

    dealt = cells.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")
    return dealt.mapInArrow(run, "u long, v long")


def _starred(cells: DataFrame, width: int) -> DataFrame:
    """Edges (u, v) of the texts in each cell (u, s) that are similar to its pivot, the text whose key is u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivot = None, np.zeros(0, np.uint64)
        for batch in sliced(batches):
            found: list[tuple[int, int]] = []
            for u, s, key, text in zip(*(batch.column(c).to_pylist() for c in ("u", "s", "key", "text")), strict=True):
                own = shingles(text or "", width)
                if key == u:
                    now, pivot = (u, s), own
                elif now == (u, s):
                    both = int(np.isin(own, pivot, assume_unique=True).sum())
                    if 9 * both >= 4 * (len(own) + len(pivot)):  # a similarity of 0.8
                        found.append((u, key))
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    dealt = cells.repartition("u", "s").sortWithinPartitions("u", "s", F.col("key") != F.col("u"))
    return dealt.select("u", "s", "key", "text").mapInArrow(run, "u long, v long")


def _with_texts(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """cells (key and more) with their keys' texts; only those texts are moved."""
    return with_numbers(texts, "key", cells.select("key")).join(cells.hint("merge"), "key")


def _to_pivots(texts: DataFrame, shared: DataFrame, width: int, tile: int) -> DataFrame:
    """Edges of shared (block, u, key, n): each text against the least one, u, of each of its blocks, every pair once."""
    pairs = stage(shared.filter("key <> u").select("u", "key", "n").distinct())
    tiles = stage(pairs.groupBy("u").agg(F.ceil(F.sum("n") / tile).alias("tiles")))
    others = pairs.join(tiles.hint("merge"), "u").select("u", F.pmod(F.xxhash64("key"), F.col("tiles")).alias("s"), "key")
    pivots = tiles.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("s"), F.col("u").alias("key"))
    return stage(_starred(_with_texts(stage(others.union(pivots)), texts), width))


def _weighed(members: DataFrame, cell: str, tile: int, *more: str) -> DataFrame:
    """For each cell of members (cell, root, n): its heaviest root, tiles of that (na) and of the rest (nr), and work.

    work is the number of shingles that comparing the rest with all members would move.
    """
    by_root = members.groupBy(cell, *more, "root").agg(F.sum("n").alias("own"))
    found = by_root.groupBy(cell, *more).agg(F.max(F.struct("own", "root")).alias("x"), F.sum("own").alias("all"))
    rest = F.col("all") - F.col("x.own")
    found = found.select(cell, *more, F.col("x.root").alias("big"), F.col("x.own").alias("a"), rest.alias("r"))
    found = found.withColumn("na", F.ceil(F.col("a") / tile)).withColumn("nr", F.ceil(F.col("r") / tile))
    return found.withColumn("work", F.expr("cast(a as decimal(38, 0)) * nr + cast(r as decimal(38, 0)) * (na + nr)"))


def _in_tiles(members: DataFrame, cells: DataFrame) -> DataFrame:
    """members (cell, key, root) as (key, root, a, b) for ``_compared``: every pair of members whose roots differ meets.

    The heaviest root's members, already known to be one group, are dealt into na tiles and the others into nr. Cell
    (r, t) holds tile r of the others with tile t of the heaviest root, cell (r, na + q) the tiles r < q of the others.
    """
    long = lambda c: F.lit(c).cast("long")
    m = members.join(cells.hint("merge"), "cell").withColumn("of_big", F.col("root") == F.col("big"))
    t = F.pmod(F.xxhash64("key"), F.when(F.col("of_big"), F.col("na")).otherwise(F.col("nr")))
    m = m.withColumn("t", t)
    big = m.filter("of_big").withColumn("a", F.explode(F.sequence(long(0), F.col("nr") - 1))).withColumn("b", F.col("t"))
    rest = m.filter("not of_big").withColumn("o", F.explode(F.sequence(long(0), F.col("na") + F.col("nr") - 1))).withColumn("q", F.col("o") - F.col("na"))
    rest = rest.filter("q < 0 or q <> t").withColumn("a", F.when(F.col("q") < 0, F.col("t")).otherwise(F.least("t", "q")))
    rest = rest.withColumn("b", F.when(F.col("q") < 0, F.col("o")).otherwise(F.col("na") + F.greatest("t", "q")))
    return big.select("key", F.col("cell").alias("root"), "a", "b").union(rest.select("key", F.col("cell").alias("root"), "a", "b"))


def _block_links(texts: DataFrame, sets: DataFrame, width: int, tile: int) -> DataFrame:
    """Edges (u, v) of sets (key, n, blocks) with the components of all similar pairs that share a block.

    A set's key is the number of one row that has it, so texts (key, text) are found without another table.

    First each text is held against the least one of each of its blocks. What is left are blocks whose members are then
    of several components. Such blocks that hang together are compared in one go where that moves fewer shingles, and
    each on its own where chains of blocks that are equal by chance have made the whole larger than its parts.
    """
    met = stage(sets.select("key", "n", F.explode("blocks").alias("block")))
    least = stage(met.groupBy("block").agg(F.min("key").alias("u"), F.count(F.lit(1)).alias("c")).filter("c > 1"))
    shared = stage(met.join(least.hint("merge"), "block"))
    near = _to_pivots(texts, shared, width, tile)

    roots = stage(components(near))
    rooted = shared.filter("c > 2").join(roots.hint("merge"), F.col("key") == F.col("node"), "left")
    rooted = stage(rooted.select("block", "u", "key", "n", F.coalesce("root", "key").alias("root")))
    own = F.xxhash64("key")
    state = [(F.min("root") != F.max("root")).alias("mixed"), F.count(F.lit(1)).alias("c"), F.bit_xor(own).alias("x"), F.sum(own.cast("decimal(38,0)")).alias("y")]
    mixed = rooted.groupBy("block").agg(*state).filter("mixed")
    mixed = stage(mixed.groupBy("c", "x", "y").agg(F.min("block").alias("block")).select("block"))  # the same members are compared once
    left = stage(rooted.join(mixed.hint("merge"), "block"))
    if left.isEmpty():
        return near

    whole = stage(components(left.filter("key <> u").select("u", F.col("key").alias("v"))))
    # joined by text and by block: left has a row for each block of each text
    group_of = lambda name: whole.select(F.col("node").alias(name), F.col("root").alias("group")).hint("merge")
    members = stage(left.select("key", "n", "root").distinct().join(group_of("key"), "key"))
    by_block = stage(_weighed(left, "block", tile, "u").join(group_of("u"), "u"))
    by_group = stage(_weighed(members, "group", tile))
    parts = by_block.groupBy("group").agg(F.sum("work").alias("parts"))
    apart = stage(by_group.join(parts.hint("merge"), "group").select("group", (F.col("work") > F.col("parts")).alias("apart")))
    plan = ["cell", "big", "na", "nr"]
    cells_of = lambda weighed, cell, which: weighed.join(apart.filter(which).hint("merge"), "group").withColumn("cell", F.col(cell)).select(*plan)
    at_once = _in_tiles(members.withColumn("cell", F.col("group")).select("cell", "key", "root"), stage(cells_of(by_group, "group", "not apart")))
    singly = _in_tiles(left.withColumn("cell", F.col("block")).select("cell", "key", "root"), stage(cells_of(by_block, "block", "apart")))
    return near.union(stage(_compared(_with_texts(stage(at_once.union(singly)), texts), width)))


def _staying(numbered: DataFrame, width: int, tile: int) -> DataFrame:
    """numbered (row, id, text) to the rows that stay."""
    marked = stage(_sketches(numbered, width))
    best = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", "row")
    sets = stage(marked.groupBy("key").agg(F.min(best).alias("best"), F.first("n").alias("n"), F.first("blocks").alias("blocks")))
    rows = sets.select(F.col("best.row").alias("key"), "n", "blocks")
    linked = stage(components(_block_links(numbered.select(F.col("row").alias("key"), "text"), rows, width, tile)))

    rooted = sets.join(linked, F.col("best.row") == F.col("node"), "left").select("best", F.coalesce("root", "best.row").alias("root"))
    return rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.row")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", width: int = 5, tile: int = 250_000) -> DataFrame:
    """One row of each group of near copies, and all rows without any."""
    row = fresh(docs, "row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    plain = numbered.select(F.col(row).alias("row"), named(id_col).alias("id"), "text")
    return with_numbers(numbered, row, _staying(plain, width, tile)).select(*map(named, docs.columns))


# ---- the query


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
