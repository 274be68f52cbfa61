"""Exact n-gram Jaccard join by signature trees (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import map_batches, map_tasks, release_memory, row_slices, stored, table, text_bytes
from tessera.llm.hashing import LOWER, mixed, windows, words

WORDS = 5
#: Similarity at least PARTS_OF / PARTS.
PARTS_OF, PARTS = 80, 100
#: Distinct sets of a candidate cluster that meet in one task, and shingles that they may have; a larger cluster meets block by block.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 22
#: Shingles that a task counts while it looks for frequent ones: those in over a share of 1 / FREQUENT of its rows stay.
FREQUENT = 4096
#: Bits of the filter that texts pass before they are joined.
FILTER_BITS = 1 << 25
#: Bits of a signature, sets in a leaf, children of a node.
BITS, LEAF, FAN = 1024, 8, 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes) for each row of concatenated texts."""
    for a, b in row_slices(offsets):
        part = LOWER[data[offsets[a] : offsets[b]]]
        bounds = offsets[a : b + 1] - offsets[a]
        hashes, at = words(part, bounds)
        rolled = windows(hashes, WORDS)
        for i in range(b - a):
            lo, hi = int(at[i]), int(at[i + 1])
            if hi - lo >= WORDS:
                yield a + i, np.unique(rolled[lo : hi - WORDS + 1])
            elif hi > lo:
                acc = hashes[lo : lo + 1]
                for j in range(lo + 1, hi):
                    acc = mixed(acc * np.uint64(0x100000001B3)) + hashes[j : j + 1]
                # the count of words keeps short sequences apart from shingles
                yield a + i, mixed(acc + np.uint64(hi - lo))
            else:
                yield a + i, np.zeros(0, dtype=np.uint64)


def spare(n: int) -> int:
    """Shingles that a set of n tells beyond those that it may miss."""
    return max(1, n // 8)


def told(s: np.ndarray) -> np.ndarray:
    """The shingles of a sorted set that stand for it in the candidate search.

    Two sets that link share four fifths of the larger one, so a set of n misses floor(n / 5) at most. Of
    its floor(n / 5) + spare(n) smallest hashes, then, as many are among its partner's as the smaller of both
    sets has to spare (the prefix filter in the order of hashes). Either is at most a quarter larger than the other.
    """
    return s[: len(s) // 5 + spare(len(s))]


class Frequent:
    """The frequent ones of a stream of hashes, in bounded space: any in over 1 / `most` of it is among those kept (Misra and Gries).

    A count is too low by at most that share of the stream.
    """

    def __init__(self, most: int = FREQUENT):
        self.most, self.keys, self.counts, self.waiting, self.size = most, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.size += len(hashes)
        if self.size > 64 * self.most:
            self.settle()

    def settle(self) -> None:
        keys, counts = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *self.waiting]), return_counts=True)
        self.waiting, self.size = [], 0
        keys, same = np.unique(np.concatenate((self.keys, keys)), return_inverse=True)
        counts = np.bincount(same, np.concatenate((self.counts, counts)), len(keys)).astype(np.int64)
        if len(keys) > self.most:
            counts -= np.partition(counts, -self.most - 1)[-self.most - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts


def set_id(s: np.ndarray) -> int | None:
    """A set's 64-bit name; the empty set has none."""
    if not len(s):
        return None
    return int(mixed((mixed(s) * np.uint64(3)).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def possibly_in(rows: DataFrame, a: str, wanted: DataFrame, b: str) -> DataFrame:
    """Rows whose column a may be among b of `wanted`: all that are, and few others, before a join shuffles them.

    One bit a hash, FILTER_BITS in all: the broadcast has that size however many rows are wanted; if they fill it, all rows pass.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    maps = wanted.select(bit(b).alias("bit")).select(F.shiftright("bit", 15).alias("__map"), F.col("bit").bitwiseAND(32767).alias("at")).groupBy("__map").agg(F.bitmap_construct_agg("at").alias("__bits"))
    own = rows.withColumn("__bit", bit(a)).withColumn("__map", F.shiftright("__bit", 15)).join(F.broadcast(maps), "__map")
    byte = F.expr("cast(conv(hex(substring(__bits, cast((__bit & 32767) div 8 as int) + 1, 1)), 16, 10) as int)")
    return own.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(__bit % 8 as int))")) != 0).select(rows.columns)


def squeezed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (k, t, th) with the text compressed for the shuffle."""
    import zstandard as zstd

    c = zstd.ZstdCompressor(level=1)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.compress(t or b"") for t in batch.column(1).to_pylist()], pa.binary()), batch.column(2)], names=["k", "z", "th"])


def find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


class SignatureTree:
    """Sets under nodes that hold the OR of their members' bitmaps, their range of sizes and largest excess.

    A set's bitmap has a bit for each shingle by hash; its excess is its size less its bits. No member of one node
    can share more with a member of another than the bits that both nodes have, and the smaller
    excess on top.
    """

    def __init__(self, sets: list[np.ndarray]):
        n = len(sets)
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        bitmap = np.zeros((n, BITS), dtype=bool)
        for i, s in enumerate(sets):
            bitmap[i, (s >> np.uint64(7)) % np.uint64(BITS)] = True
        low = np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64)
        # neighbours of a leaf share their smallest hash if they are alike
        self.order = np.lexsort((self.sizes, low))
        bits = np.packbits(bitmap[self.order], axis=1).view(np.uint64)
        size = self.sizes[self.order]
        excess = size - bitmap[self.order].sum(axis=1)
        self.levels = [(bits, size, size, excess)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(b), width)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))
            width = FAN


def possible(a, i: np.ndarray, b, j: np.ndarray) -> np.ndarray:
    """Which pairs of nodes (i of a, j of b) may hold sets that link."""
    most = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1).astype(np.int64) + np.minimum(a[3][i], b[3][j])
    most = np.minimum(most, np.minimum(a[2][i], b[2][j]))
    least = a[1][i] + b[1][j]
    # overlap o of sizes x and y links if 100 o >= 80 (x + y - o)
    return ((PARTS + PARTS_OF) * most >= PARTS_OF * least) & (PARTS * a[2][i] >= PARTS_OF * b[1][j]) & (PARTS * b[2][j] >= PARTS_OF * a[1][i])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    same = int((large[at] == small).sum())
    return PARTS * same >= PARTS_OF * (len(x) + len(y) - same)


def dual_join(left: list[np.ndarray], right: list[np.ndarray] | None, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever links connect, within `left`, or across left and right (numbered on).

    Both trees are walked down together, pair by pair of nodes; pairs that `possible` rules out go, and so
    do pairs of sets that are connected already, by links or by equal labels.
    """
    own = right is None
    a = SignatureTree(left)
    b = a if own else SignatureTree(right)
    sets = left if own else left + right
    shift = 0 if own else len(left)
    parent = np.arange(len(sets)) if labels is None else np.unique(labels, return_index=True, return_inverse=True)[1:]
    if labels is not None:
        parent = parent[0][parent[1]]
    links: list[tuple[int, int]] = []

    def descend(i: np.ndarray, j: np.ndarray, la: int, lb: int) -> None:
        ok = possible(a.levels[la], i, b.levels[lb], j)
        i, j = i[ok], j[ok]
        if not len(i):
            return
        if la == 0 and lb == 0:
            x, y = a.order[i], b.order[j] + shift
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                if p != q:
                    rp, rq = find(parent, p), find(parent, q)
                    if rp != rq and linked(sets[p], sets[q]):
                        parent[max(rp, rq)] = min(rp, rq)
                        links.append((p, q))
            return
        na, nb = max(la - 1, 0), max(lb - 1, 0)
        wa, wb = (1 if la == 0 else LEAF if la == 1 else FAN), (1 if lb == 0 else LEAF if lb == 1 else FAN)
        for at in range(0, len(i), 512):
            p, q = i[at : at + 512], j[at : at + 512]
            ca = (p[:, None] * wa + np.arange(wa)[None, :])[:, :, None]
            cb = (q[:, None] * wb + np.arange(wb)[None, :])[:, None, :]
            ca, cb = (x.reshape(-1) for x in np.broadcast_arrays(ca, cb))
            ok = (ca < len(a.levels[na][0])) & (cb < len(b.levels[nb][0]))
            if own:
                ok &= ca <= cb
            descend(ca[ok], cb[ok], na, nb)

    if left and (own or right):
        descend(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), len(a.levels) - 1, len(b.levels) - 1)
    return links


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that edges reach from each node of a table of edges.

    Large-star and small-star steps in turn until every edge joins a node with its root; every step is a written
    table, so an executor that is lost costs one step. Nothing but whether that is so comes to the driver.
    """
    pairs = stored(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())
    while not _is_star(pairs):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written first: a join of plain shuffles is one that Spark can split where a node has very many edges
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: larger neighbours go to the smallest
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        large = stored(large)
        # small star: smaller neighbours and the node itself go to the smallest of them
        low2 = stored(large.groupBy("x").agg(F.min("y").alias("m")))
        small = large.join(low2, "x").select(F.explode(F.array(F.struct(F.col("y").alias("v"), F.col("m").alias("u")), F.struct(F.col("x").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        pairs = stored(small)
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root")).union(pairs.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _is_star(pairs: DataFrame) -> bool:
    """Whether no node is the larger end of two edges, or of one and the smaller end of another."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("u").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below = 1 and above = 1)").isEmpty()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, set_id, component_id, n_links, component, text_hash) for every document.

    Sets of distinct WORDS-word shingles of ASCII-lower-cased words; a shorter text is one shingle; a
    null or empty text has none and stands alone. Documents of Jaccard similarity at least
    PARTS_OF / PARTS are linked; component_id is the smallest key that links reach. Documents of the same set
    (exact copies, whatever their number) go on as one, by a hash of the set, set_id.

    Candidates: each set tells a third of its shingles, smallest hashes first (`told`);
    a set of which too few are told by others can link with none and goes. What is left forms clusters
    over common shingles, of which each set takes the rarest only, as many as must hold a common one (the prefix
    filter again, in the order of frequency). Passages that many documents share are among them where nothing rarer is.
    In a cluster, sets meet in signature trees. A cluster of over BLOCK sets meets block by block, its first
    set visiting each block; then sets not connected with that one meet all the others, again by blocks. Links that
    trees find make the components. All this is exact but for the 64 bits of hashes.
    n_links counts those links, a spanning set; it is 0 for a set that links with no other. component tells
    components apart where keys repeat.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"))
    rows = rows.select("k", "t", F.xxhash64("t").alias("th"))
    kind, arrow = dict(rows.dtypes)["k"], to_arrow_type(rows.schema["k"].dataType)

    def signing() -> tuple:
        often = Frequent()

        def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = text_bytes(batch.column(1))
            n, ids = [], []
            for _, s in shingle_sets(data, offsets):
                n.append(len(s)), ids.append(set_id(s))
                often.add(told(s))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), batch.column(2), pa.nulls(len(n), pa.int64())], names=["k", "n", "sid", "th", "h"])

        def last() -> pa.RecordBatch:
            often.settle()
            x = len(often.keys)
            return pa.RecordBatch.from_arrays([pa.nulls(x, arrow), pa.array(often.counts, pa.int64()), *(pa.nulls(x, pa.int64()),) * 2, pa.array(often.keys.view(np.int64))], names=["k", "n", "sid", "th", "h"])

        return sign, last

    def speak(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sent, seen = [], [], set()
        for _, s in shingle_sets(*text_bytes(batch.column(0))):
            sid = set_id(s)
            # a copy within the batch need not speak again
            if sid is not None and sid not in seen:
                seen.add(sid)
                out = told(s)
                ids.append(np.full(len(out), sid, dtype=np.int64))
                sent.append(out.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64)) for x in (sent, ids)], names=["h", "sid"])

    # the texts are signed twice: that costs less than keeping what they tell. Rows with h are tasks' frequent shingles
    signed = stored(map_tasks(rows, signing, f"k {kind}, n long, sid long, th long, h long"))
    sets = signed.where("h is null").select("k", "n", "sid", "th")
    spoken = map_batches(rows.select("t"), speak, "h long, sid long")
    total = sets.where("n > 0").agg(F.sum(F.expr("n div 5 + greatest(1, n div 8)")).alias("total"))
    often = signed.where("h is not null").groupBy("h").agg(F.sum("n").alias("n")).join(F.broadcast(total)).withColumn("parts", F.ceil(F.col("n") * FREQUENT / F.col("total")).cast("int"))
    # a frequent shingle's sets are dealt to several groups, each of about 1 / FREQUENT of all rows
    often = F.broadcast(stored(often.where("parts > 1").select("h", "parts").orderBy(F.desc("parts"), "h").limit(FREQUENT)))
    dealt = lambda df: df.join(often, "h", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("sid"), F.col("parts")), F.lit(0)))

    # shingles that more than one set tells, once for each set
    by_hash, ordered = Window.partitionBy("h", "part"), Window.partitionBy("h", "part").orderBy("sid")
    new = F.col("prev").isNull() | (F.col("prev") != F.col("sid"))
    spoken = dealt(spoken).withColumn("prev", F.lag("sid").over(ordered)).withColumn("df", F.sum(new.cast("int")).over(by_hash)).where(new & (F.col("parts").isNotNull() | (F.col("df") > 1)))
    told_by = stored(spoken.select("h", "sid", F.col("df").cast("int").alias("df"), F.col("parts").isNotNull().alias("often")))
    # of the frequent ones, FREQUENT at most, the counts of the groups add up
    many = told_by.where("often").groupBy("h").agg(F.count("*").cast("int").alias("many"))
    common = told_by.join(F.broadcast(many), "h", "left").select("h", "sid", F.coalesce("many", "df").alias("df")).where("df > 1")
    heard = common.groupBy("sid").agg(F.count("*").alias("shared"))
    known = sets.where("sid is not null").groupBy("sid").agg(F.first("n").alias("n"), F.min(F.struct("k", "th")).alias("row"))
    # the smallest partner's spare shingles are shared at least; of those shared, the rarest suffice that
    # leave out one fewer. Shingles of one set only would come before them, and need no row
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * 4 / 5) / 8))
    alive = stored(heard.join(known, "sid").where(F.col("shared") >= least).select("sid", "n", "row.k", "row.th", (F.col("shared") - least + 1).alias("rare")))
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("df", "h"))
    near = common.join(alive.select("sid", "rare"), "sid").withColumn("i", rank).where("i <= rare").select("h", "sid")
    near = stored(dealt(near).withColumn("u", F.min("sid").over(by_hash)).select("h", "sid", "u", F.col("parts").isNotNull().alias("often")))
    first = near.where("often").groupBy("h").agg(F.min("u").alias("first"))
    star = near.join(F.broadcast(first), "h", "left").select(F.coalesce("first", "u").alias("a"), F.col("sid").alias("b")).where("a <> b").distinct()
    cluster = components(star)
    cluster = stored(cluster.join(alive, F.col("node") == F.col("sid")).select("sid", "k", "th", "n", "root"))
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")
    size = stored(cluster.groupBy("root").agg(blocks.alias("blocks")))
    member = cluster.join(size, "root").select("sid", "k", "th", "n", F.col("root").alias("cluster"), "blocks")
    member = member.withColumn("first", F.col("sid") == F.col("cluster"))
    member = stored(member.select("sid", F.col("k").alias("mk"), F.col("th").alias("mh"), "n", "cluster", "first", "blocks", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block")))

    # the sets themselves
    packed = map_batches(possibly_in(rows, "th", member, "mh"), squeezed, f"k {kind}, z binary, th long")
    body = packed.join(member, (F.col("th") == F.col("mh")) & F.col("k").eqNullSafe(F.col("mk"))).select("sid", "cluster", "first", "blocks", "block", "z")

    def again(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard as zstd

        d = zstd.ZstdDecompressor()
        found = [s for _, s in shingle_sets(*text_bytes(pa.array([d.decompress(z) for z in batch.column(5).to_pylist()], pa.binary())))]
        # hashes of texts may coincide; only the row with the very set counts
        ok = [set_id(s) == sid for s, sid in zip(found, batch.column(0).to_pylist(), strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + [pa.array([s.tobytes() for s in found], pa.binary())], names=["sid", "cluster", "first", "blocks", "block", "shingles"])
        return out.filter(pa.array(ok, pa.bool_()))

    body = map_batches(body, again, "sid long, cluster long, first boolean, blocks int, block int, shingles binary")
    large = member.where("blocks > 1")
    if large.isEmpty():
        met = body.select("cluster", F.lit(0).alias("p"), F.lit(0).alias("q"), "sid", F.col("sid").alias("label"), F.lit(False).alias("other"), "shingles")
        return _labelled(sets, stored(_meet(met)), key)
    body = stored(body)
    where = F.explode(F.when(F.col("first"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))).alias("p")
    met = body.select("cluster", where, F.lit(0).alias("q"), "sid", F.col("sid").alias("label"), F.lit(False).alias("other"), "shingles")
    links = stored(_meet(met))
    # in large clusters: what is connected with the first set, and what is not yet
    label = components(links)
    seen = stored(large.join(label, F.col("sid") == F.col("node"), "left").select("sid", "n", "cluster", "first", F.coalesce("root", "sid").alias("label")))
    main = stored(seen.where("first").select("cluster", F.col("label").alias("main")))
    seen = stored(seen.join(main, "cluster").withColumn("rest", F.col("label") != F.col("main")))
    need = lambda on: F.ceil(F.greatest(F.count_if(on) / F.lit(BLOCK), F.sum(F.when(on, F.col("n")).otherwise(0)) / F.lit(BLOCK_SHINGLES))).cast("int")
    n = stored(seen.groupBy("cluster").agg(need(F.col("rest")).alias("nr"), need(~F.col("rest")).alias("nm")))
    part = F.pmod(F.xxhash64("sid"), F.when(F.col("rest"), F.col("nr")).otherwise(F.col("nm"))).cast("int")
    seen = seen.join(n, "cluster").where("nr > 0").select("sid", "label", "rest", "nr", "nm", part.alias("own"))
    # (p, q): block p of the rest meets block q of the main part, or a later block of the rest, those counted on from nm
    meets = F.expr("""case when not rest then transform(sequence(0, nr - 1), x -> named_struct('p', x, 'q', own, 'other', true))
      else concat(transform(sequence(0, nm - 1), x -> named_struct('p', own, 'q', x, 'other', false)), transform(sequence(own, nr - 1), x -> named_struct('p', own, 'q', nm + x, 'other', false)),
      transform(filter(sequence(0, nr - 1), x -> x < own), x -> named_struct('p', x, 'q', nm + own, 'other', true))) end""")
    met = body.where("blocks > 1").join(seen, "sid").select("cluster", "sid", "label", "shingles", F.explode(meets).alias("m")).select("cluster", "m.p", "m.q", "sid", "label", "m.other", "shingles")
    return _labelled(sets, stored(links.unionByName(_meet(met))), key)


def _meet(met: DataFrame) -> DataFrame:
    """(a, b): links that trees find in each group (cluster, p, q) of sets (sid, label, other, shingles), within it or across `other`."""

    def join(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side: dict[bool, dict[int, tuple[int, np.ndarray]]] = {False: {}, True: {}}
        for b in batches:
            for sid, label, other, raw in zip(*(b.column(c).to_pylist() for c in ("sid", "label", "other", "shingles")), strict=True):
                side[other][sid] = (label, np.frombuffer(raw, dtype=np.uint64))
        left, right = ([(k, *side[x][k]) for k in sorted(side[x])] for x in (False, True))
        names, labels = [k for k, _, _ in left + right], [v for _, v, _ in left + right]
        links = dual_join([s for _, _, s in left], [s for _, _, s in right] if right else None, labels) if left else []
        out = pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in links], pa.int64()), pa.array([names[j] for _, j in links], pa.int64())], names=["a", "b"])
        del side, left, right, links
        release_memory()
        yield out

    return met.groupBy("cluster", "p", "q").applyInArrow(join, "a long, b long")


def _labelled(sets: DataFrame, links: DataFrame, key: str) -> DataFrame:
    label = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("n_links"))
    # each set's smallest key first, then each component's: a set of many copies never meets in one task
    smallest = sets.where("sid is not null").groupBy("sid").agg(F.min("k").alias("m"))
    # written, so that joins are of plain shuffles and a component of very many sets can be split
    smallest = stored(smallest.join(label, F.col("sid") == F.col("node"), "left").select("sid", "m", F.coalesce("root", "sid").alias("root")))
    top = stored(smallest.groupBy("root").agg(F.min("m").alias("component_id")))
    known = smallest.join(top, "root").join(degree, "sid", "left").select("sid", F.col("root").alias("component"), "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = sets.join(known, "sid", "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("sid").alias("set_id"), F.coalesce("component_id", "k").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component", F.col("th").alias("text_hash"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one of each component: that of the smallest key, ties by text hash.

    Texts without words link with nothing and all stay. All columns stay as they are.
    """
    found = near_duplicates(docs, key, text)
    first = found.where("set_id is not null").groupBy("component").agg(F.min(F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("k"), F.col("text_hash").alias("th"))).alias("m"))
    chosen = first.select(F.col("m.k").alias("__k"), F.col("m.th").alias("__th"))
    rows = docs.withColumn("__h", F.xxhash64(F.col(text).cast("binary")))
    empty = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = rows.where(~empty).join(chosen, (F.col(key).eqNullSafe(F.col("__k"))) & (F.col("__h") == F.col("__th"))).dropDuplicates([key, "__h"])
    return kept.select(*docs.columns).unionByName(rows.where(empty).select(*docs.columns))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = {
    "op4_jaccard": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
sh as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as root from n union select e.b, r.root from r join e on r.doc_id = e.a where r.root < e.b)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(min(r.root), w.doc_id) as component_id from w left join n using (doc_id) left join r using (doc_id) group by w.doc_id, n.n"""
}
