"""Copy detection in image columns by local descriptors (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, release_memory, row_slices, stored, table
from tessera.llm.jaccard import components

#: Corner strength against the image's strongest, radius of the patch that is described, and directions told apart.
STRENGTH, RADIUS, DIRECTIONS = 0.02, 9, 24
#: Reductions of the image at which corners are sought.
SCALES = (1, 2)
#: Quarters of a gray level by which the second pixel of a test must be brighter, so that noise in flat areas sets no bits.
MARGIN = 32
#: Bits in which two descriptors of a match may differ; corners that must agree on one movement, also as a share of the
#: corners of the image that has fewer; its grain in pixels.
MAX_BITS, MIN_AGREE, MIN_SHARE, GRAIN = 24, 4, 0.5, 6
#: Corners out of the tables that must agree before all corners of two images are compared.
SEED = 3
#: Tables of the Hamming join: 32 bits each of the 256; entries before it in its bucket that an entry is compared with.
TABLES, NEIGHBOURS = 4, 4
#: Where all images meet: corners of a group of them, groups at least, corners that meet in one matrix product, and pairs
#: whose turns are told at once.
GROUP, GROUPS, PANEL, TILE, TURNED = 1 << 17, 8, 1536, 1024, 4096
CELL = 8


def _patterns() -> np.ndarray:
    """256 pairs of points (y, x, y, x) in the patch, turned to each direction."""
    rng = np.random.default_rng(11)
    p = np.clip(rng.normal(0, RADIUS / 2, (256, 2, 2)), -RADIUS + 2, RADIUS - 2)
    out = []
    for d in range(DIRECTIONS):
        a = 2 * np.pi * d / DIRECTIONS
        turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        out.append(np.rint(np.clip(p @ turn, -RADIUS, RADIUS)).astype(np.int64).reshape(256, 4))
    return np.array(out)


_PATTERNS = _patterns()
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_Y**2 + _X**2 <= RADIUS**2).astype(np.float32)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2 r + 1 pixels, of a stack of images; borders repeat."""
    p = np.pad(x, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge").cumsum(axis=1).cumsum(axis=2)
    n = 2 * r + 1
    return p[:, n:, n:] - p[:, :-n, n:] - p[:, n:, :-n] + p[:, :-n, :-n]


def corners(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, y, x) of the local maxima of Harris's corner measure, those near the border left out."""
    x = stack.astype(np.float64)
    gy, gx = np.zeros_like(x), np.zeros_like(x)
    gy[:, 1:-1], gx[:, :, 1:-1] = x[:, 2:] - x[:, :-2], x[:, :, 2:] - x[:, :, :-2]
    a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    r = a * b - c * c - 0.05 * (a + b) ** 2
    top = r.copy()
    for axis in (1, 2):
        # the largest of five in a row, then in a column
        m = top
        for shift in (-2, -1, 1, 2):
            m = np.maximum(m, np.roll(top, shift, axis))
        top = m
    strong = r > STRENGTH * r.max(axis=(1, 2), keepdims=True)
    ok = (r >= top) & strong & (r > 1e3)
    ok[:, : RADIUS + 1] = ok[:, -RADIUS - 1 :] = False
    ok[:, :, : RADIUS + 1] = ok[:, :, -RADIUS - 1 :] = False
    return np.nonzero(ok)


def describe_stack(stack: np.ndarray) -> tuple[np.ndarray, ...]:
    """(image, y, x, direction, scale, bits as four longs) of all corners of a stack of equally large gray images.

    A corner's direction is that from it to the centre of brightness of its disc; the tests compare pairs
    of smoothed pixels, turned by the direction; a bit is set where the second is brighter by MARGIN. Positions are in pixels of the full image.
    """
    found = []
    for scale in SCALES:
        h, w = stack.shape[1] // scale * scale, stack.shape[2] // scale * scale
        x = stack[:, :h, :w].astype(np.float32).reshape(len(stack), h // scale, scale, w // scale, scale).mean(axis=(2, 4)) if scale > 1 else stack.astype(np.float32)
        if min(x.shape[1:]) < 2 * RADIUS + 5:
            continue
        i, y, c = corners(x)
        if not len(i):
            continue
        smooth = np.rint(_box(x.astype(np.float64), 1) / 9 * 4).astype(np.int32)
        yy, xx = y[:, None, None] + _Y, c[:, None, None] + _X
        patch = x[i[:, None, None], yy, xx] * _DISC
        angle = np.arctan2((patch * _Y).sum(axis=(1, 2)), (patch * _X).sum(axis=(1, 2)))
        d = np.rint(angle / (2 * np.pi) * DIRECTIONS).astype(np.int64) % DIRECTIONS
        p = _PATTERNS[d]
        n = np.arange(len(i))[:, None]
        one = smooth[i[n], y[n] + p[:, :, 0], c[n] + p[:, :, 1]]
        two = smooth[i[n], y[n] + p[:, :, 2], c[n] + p[:, :, 3]]
        bits = np.packbits(one + MARGIN < two, axis=1).view(np.int64)
        found.append((i, y * scale, c * scale, d, np.full(len(i), scale), bits))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5)) + (np.zeros((0, 4), dtype=np.int64),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def descriptors(images: DataFrame) -> DataFrame:
    """(image, y, x, direction, scale, a, b, c, d) from images (image, height, width, pixels: gray bytes by rows).

    Images whose pixels are missing or don't fit their size have none.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        groups: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        for k, h, w, p in zip(*(batch.column(c).to_pylist() for c in ("image", "height", "width", "pixels")), strict=True):
            if p is not None and h and w and len(p) == h * w:
                groups.setdefault((h, w), []).append((k, p))
        cols: list[list[np.ndarray]] = [[] for _ in range(9)]
        for (h, w), rows in groups.items():
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                stack = np.frombuffer(b"".join(p for _, p in some), dtype=np.uint8).reshape(len(some), h, w)
                i, y, x, d, s, bits = describe_stack(stack)
                keys = np.array([k for k, _ in some], dtype=np.int64)
                for col, v in zip(cols, (keys[i], y, x, d, s, *bits.T), strict=True):
                    col.append(np.ascontiguousarray(v))
        if not cols[0]:
            return None
        kinds = [pa.int64()] + [pa.int32()] * 4 + [pa.int64()] * 4
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds, strict=True)], names=["image", "y", "x", "direction", "scale", "a", "b", "c", "d"])

    return map_batches(images.select("image", "height", "width", "pixels"), run, "image long, y int, x int, direction int, scale int, a long, b long, c long, d long")


def _packed(y, x, direction, scale):
    """A corner as one long, which shuffles in a third of a struct's bytes; sides have less than 2^27 pixels, as 2^31 make an image."""
    long = lambda c: F.col(c).cast("long")
    return F.shiftleft(long(y), 36) + F.shiftleft(long(x), 9) + F.shiftleft(long(direction), 4) + long(scale)


def _unpacked(p: str):
    part = lambda at, n: F.shiftright(F.col(p), at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    return F.struct(part(36, 27).alias("y"), part(9, 27).alias("x"), part(4, 5).alias("direction"), part(0, 4).alias("scale")).alias(p)


def linked(match: DataFrame, least: int = MIN_AGREE) -> DataFrame:
    """(i, j, n) of the pairs of images whose matches (i, j, p, q: two corners) agree in n corners p, `least` or more.

    Turns are told to two directions, on two overlapping grids around the circle.
    """
    # dealt by pair before the votes are made, so that votes stay where they are
    match = match.select("i", "j", *(_packed(*(f"{c}.{x}" for x in ("y", "x", "direction", "scale"))).alias(c) for c in "pq"))
    match = match.repartition("i", "j").distinct().withColumn("matches", F.count("*").over(Window.partitionBy("i", "j")))
    # fewer matches than votes asked for cannot agree
    match = match.where(F.col("matches") >= least).select("i", "j", _unpacked("p"), _unpacked("q"))
    turn = F.pmod(F.col("q.direction") - F.col("p.direction"), F.lit(DIRECTIONS))
    grow = F.log2(F.col("q.scale") / F.col("p.scale"))
    angle, ratio = turn * (2 * np.pi / DIRECTIONS), F.col("q.scale") / F.col("p.scale")
    dy = F.col("q.y") - ratio * (F.cos(angle) * F.col("p.y") + F.sin(angle) * F.col("p.x"))
    dx = F.col("q.x") - ratio * (F.cos(angle) * F.col("p.x") - F.sin(angle) * F.col("p.y"))
    # grids at two offsets, so that no agreement is lost to a border
    grid = lambda k: F.struct(F.lit(k).alias("k"), F.floor(F.pmod(turn + k // 4, F.lit(DIRECTIONS)) / 2).alias("turn"), F.floor(dy / (2 * GRAIN) + 0.5 * (k % 2)).alias("y"), F.floor(dx / (2 * GRAIN) + 0.5 * (k // 2 % 2)).alias("x"))
    agreed = match.select("i", "j", "p", F.floor(grow).alias("grow"), F.explode(F.array(*map(grid, range(8)))).alias("cell")).groupBy("i", "j", "grow", "cell").agg(F.count_distinct("p").alias("n"))
    return agreed.where(F.col("n") >= least).groupBy("i", "j").agg(F.max("n").alias("n"))


def _differ(one: str, two: str):
    """Bits in which the descriptors of two structs differ."""
    return sum((F.bit_count(F.col(f"{one}.{c}").bitwiseXOR(F.col(f"{two}.{c}"))) for c in "abcd"), F.lit(0))


def compared(pairs: DataFrame, corner: DataFrame) -> DataFrame:
    """(i, j, p, q) of all matches between the images of each pair (i, j): each corner of one against each of the other."""
    end = lambda image, point, bits: corner.select(F.col("image").alias(image), F.struct("y", "x", "direction", "scale").alias(point), F.struct(*"abcd").alias(bits))
    both = pairs.select("i", "j").join(end("i", "p", "v"), "i").join(end("j", "q", "w"), "j")
    return both.where(_differ("v", "w") <= MAX_BITS).select("i", "j", "p", "q")


def _ones(bits: np.ndarray) -> np.ndarray:
    """Descriptors as rows of 255 zeros and ones; the last bit is left out, so that a byte holds any number of bits that differ."""
    return np.unpackbits(bits.view(np.uint8).reshape(len(bits), 32), axis=1)[:, :255]


def _signs(bits: np.ndarray) -> np.ndarray:
    """Descriptors as rows of 1 and -1, and 255 less their ones."""
    ones = _ones(bits)
    return np.column_stack([ones * np.float32(2) - 1, 255 - ones.sum(axis=1, dtype=np.float32)])


def _triples(bits: np.ndarray) -> np.ndarray:
    """Descriptors as columns of zeros and ones and a last one, three to a column by weights of 1, 2^8 and 2^16.

    A row of `_signs` times a column has 255 less the bits in which they differ in three bytes: no sum of some of its terms
    leaves 2^24, so float32 doesn't round. The number of columns is even; what fills up the last ones is zero.
    """
    ones = np.zeros((-(-len(bits) // 6) * 2, 3, 256), dtype=np.float32)
    ones.reshape(-1, 256)[: len(bits), :255] = _ones(bits)
    ones.reshape(-1, 256)[: len(bits), 255] = 1
    return np.ascontiguousarray((ones[:, 0] + ones[:, 1] * 256 + ones[:, 2] * 65536).T)


def _near(signs: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """Whether descriptors differ in MAX_BITS of 255 bits at most, a row for each of signs, four bytes for three of triples, the last false."""
    return (signs @ triples).astype("<i4").view(np.uint8) >= 255 - MAX_BITS


def close(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the images i of one and j > i of two of which as many corners of i match, in one turn and scale, as a link needs.

    Each side is (images in order, offsets of their corners, directions, scales, bits). All corners of one meet all of two, in matrix products,
    by all bits but the last; `_turned` looks at that too. Shifts are not looked at, so no link is missing, and `linked` decides.
    """
    (ids, at, _, _, bits), (ids2, at2, _, _, bits2) = one, two
    size, size2 = np.diff(at), np.diff(at2)
    # a panel is whole images; one of more corners goes part by part
    panels = [(a, b, [_triples(bits[k : min(k + PANEL, at[b])]) for k in range(at[a], at[b], PANEL)]) for a, b in row_slices(at, PANEL)]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def good() -> tuple[np.ndarray, np.ndarray]:
        u, v = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        ok = _turned(one, two, u, v) >= np.maximum(MIN_AGREE, MIN_SHARE * np.minimum(size2[v], size[u]))
        return ids[u[ok]], ids2[v[ok]]

    for c, d in row_slices(at2, TILE):
        tile, rows = _signs(bits2[at2[c] : at2[d]]), at2[c : d + 1] - at2[c]
        for a, b, parts in panels:
            if ids[a] >= ids2[d - 1]:
                break
            hit = []
            for part in parts:
                # eight verdicts to a long
                met = _near(tile, part).view(np.int64)
                any_of = np.empty((d - c, met.shape[1]), dtype=np.int64)
                for k in range(d - c):
                    np.bitwise_or.reduce(met[rows[k] : rows[k + 1]], axis=0, out=any_of[k])
                hit.append(any_of.view(bool))
            first = at[a:b] - at[a]
            n = np.add.reduceat(np.concatenate(hit, axis=1) if len(hit) > 1 else hit[0], first // 3 * 4 + first % 3, axis=1, dtype=np.int64)
            least = np.maximum(MIN_AGREE, MIN_SHARE * np.minimum(size2[c:d, None], size[a:b]))
            v, u = np.nonzero((n >= least) & (ids2[c:d, None] > ids[a:b]))
            if len(u):
                found.append((u + a, v + c))
                if sum(len(x) for x, _ in found) >= TURNED:
                    yield good()
    if found:
        yield good()


def _matches(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(pair, corner p, turn, log2 of the growth) of the matches between the u-th images of one and the v-th of two, some corners p at a time."""
    (_, at, turns, scales, bits), (_, at2, turns2, scales2, bits2) = one, two
    size, size2 = at[u + 1] - at[u], at2[v + 1] - at2[v]
    pairs = np.repeat(np.arange(len(u)), size)
    points = np.arange(len(pairs)) - np.repeat(size.cumsum() - size, size) + at[u][pairs]
    for s, t in row_slices(np.concatenate([[0], size2[pairs].cumsum()]), 1 << 18):
        wide = size2[pairs[s:t]]
        pair, p = np.repeat(pairs[s:t], wide), np.repeat(points[s:t], wide)
        q = np.arange(len(pair)) - np.repeat(wide.cumsum() - wide, wide) + at2[v][pair]
        # unsigned: of a negative number, numpy counts the bits of its absolute value
        near = np.bitwise_count((bits[p] ^ bits2[q]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= MAX_BITS
        pair, p, q = pair[near], p[near], q[near]
        yield pair, p, (turns2[q] - turns[p]) % DIRECTIONS, np.floor(np.log2(scales2[q] / scales[p])).astype(np.int64)


def _turned(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each pair of the u-th image of one and the v-th of two, the most corners of the first that match with one turn and scale, told as in `linked`."""
    votes, points = [np.zeros(0, dtype=np.int64)], len(one[4])
    for pair, p, turn, grow in _matches(one, two, u, v):
        for k in range(2):
            cell = (pair * 64 + grow + 32) * DIRECTIONS + k * (DIRECTIONS // 2) + (turn + k) % DIRECTIONS // 2
            votes.append(np.unique(cell * points + p))
    cells, n = np.unique(np.unique(np.concatenate(votes)) // points, return_counts=True)
    most = np.zeros(len(u), dtype=np.int64)
    np.maximum.at(most, cells // DIRECTIONS // 64, n)
    return most


def alike(corner: DataFrame) -> DataFrame:
    """(i, j) of all pairs of images that `close` finds, whatever the tables hold: groups of images, by ranges of their ids, meet two by two."""
    columns = ("direction", "scale", *"abcd")
    count = corner.count()
    parts = max(GROUPS, -(-count // GROUP))
    bounds = sorted(set(corner.approxQuantile("image", [k / parts for k in range(1, parts)], 0.1 / parts))) if count else []
    of = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < F.col("image").cast("double")))
    image = corner.groupBy("image").agg(F.collect_list(F.struct(*columns)).alias("l")).select("image", of.alias("of"), *(f"l.{c}" for c in columns))
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(bounds))), lambda k: F.struct(F.least("of", k).alias("g"), F.greatest("of", k).alias("h"))))
    # many more partitions than pairs of groups, so that few hold two
    dealt = image.select("*", meet.alias("m")).select("m.*", "*").drop("m").repartition(2 * (len(bounds) + 1) * (len(bounds) + 2), "g", "h")

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("image").combine_chunks()

        def side(group: int) -> tuple[np.ndarray, ...]:
            part = rows.filter(pc.equal(rows["of"], group)).combine_chunks()
            flat = np.stack([pc.list_flatten(part[c]).to_numpy().astype(np.int64) for c in columns], axis=1)
            at = np.concatenate([[0], pc.list_value_length(part["a"]).to_numpy().astype(np.int64).cumsum()])
            return part["image"].to_numpy(), at, flat[:, 0], flat[:, 1], np.ascontiguousarray(flat[:, 2:])

        g, h = (k.as_py() for k in key)
        one = side(g)
        two = one if g == h else side(h)
        found = [(np.zeros(0, dtype=np.int64),) * 2, *close(one, two)]
        release_memory()
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64())})

    return dealt.groupBy("g", "h").applyInArrow(run, "i long, j long")


def supported(links: DataFrame, corner: DataFrame) -> DataFrame:
    """(i, j) of the links (i, j, n) whose n corners are MIN_SHARE of those of the image that has fewer."""
    # written, so that the joins are of plain shuffles and an image of very many links can be split
    count = stored(corner.groupBy("image").agg(F.count("*").alias("corners")))
    both = links.join(count.toDF("i", "ni"), "i").join(count.toDF("j", "nj"), "j")
    return both.where(F.col("n") >= MIN_SHARE * F.least("ni", "nj")).select("i", "j")


def image_copies(images: DataFrame) -> DataFrame:
    """(image, class_id, copy_of, n_links) of every image of a table (image, height, width, pixels), ids unique.

    copy_of is the smallest id with the same pixels. One image of each such class goes on. Its descriptors enter
    TABLES tables by 32 of their bits each; entries with the same bits stand next to each other, by the
    rest of their bits, and each is compared with the NEIGHBOURS entries before it, those of its own image left out: however many
    images share an entry, comparisons grow with entries only. Matches differ in at most MAX_BITS bits. Where SEED different corners of two images
    agree on one turn, one scale and one shift, to the grain, the pair is a candidate. What the tables and their neighbours miss, `alike` brings: there all corners of
    all images meet, so no link is lost; its work grows with the square of the corners. Of a candidate, all corners are compared with each other. The pair is linked if then MIN_AGREE
    different corners, and MIN_SHARE of the corners of the image that has fewer, agree. class_id is the smallest copy_of
    that links reach. Images without pixels or corners stand alone, images without pixels not even together.
    """
    size = F.concat_ws("x", "height", "width")
    classes = stored(images.select("image", F.when(F.col("pixels").isNotNull(), F.sha2(F.concat(size.cast("binary"), F.col("pixels")), 256)).alias("h")))
    first = classes.where("h is not null").groupBy("h").agg(F.min("image").alias("copy_of"))
    known = classes.join(first, "h", "left").select("image", F.coalesce("copy_of", "image").alias("copy_of"))
    lone = known.where("image = copy_of").select("image")
    corner = stored(descriptors(images.join(lone, "image")))

    entry = F.array(*(F.struct(F.lit(i).alias("t"), F.shiftrightunsigned(c, 32 * (i % 2)).bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")) for i, c in zip(range(TABLES), "abcd", strict=True)))
    point = _packed("y", "x", "direction", "scale").alias("p")
    listed = corner.select("image", point, "a", "b", "c", "d", F.explode(entry).alias("e")).select("e.t", "e.v", "a", "b", "c", "d", "image", "p")
    near = Window.partitionBy("t", "v").orderBy("a", "b", "c", "d", "image", "p")
    before = F.collect_list(F.struct("image", "p", "a", "b", "c", "d")).over(near.rowsBetween(-NEIGHBOURS, -1))
    pair = listed.withColumn("before", before).select(F.struct("image", "p", "a", "b", "c", "d").alias("e"), F.explode("before").alias("o")).where("o.image <> e.image")
    pair = pair.where(_differ("e", "o") <= MAX_BITS)
    # the smaller image first
    ends = lambda one, two: F.struct(*(F.col(f"{c}.{x}").alias(k) for c, x, k in ((one, "image", "i"), (two, "image", "j"), (one, "p", "p"), (two, "p", "q"))))
    match = pair.select(F.when(F.col("e.image") < F.col("o.image"), ends("e", "o")).otherwise(ends("o", "e")).alias("m")).select("m.*")

    seeds = linked(match.select("i", "j", _unpacked("p"), _unpacked("q")), SEED).select("i", "j")
    # what the tables miss: all images meet
    seeds = stored(seeds.union(alike(corner)).distinct())
    links = stored(supported(stored(linked(compared(seeds, corner))), corner))

    label = components(links, "i", "j").select(F.col("node").alias("copy_of"), F.col("root"))
    degree = links.select(F.explode(F.array("i", "j")).alias("copy_of")).groupBy("copy_of").agg(F.count("*").alias("n_links"))
    out = known.join(label, "copy_of", "left").join(degree, "copy_of", "left")
    return out.select("image", F.coalesce("root", "copy_of").alias("class_id"), "copy_of", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def mosaic(vector: np.ndarray) -> np.ndarray:
    """A gray image of 8 x 8 cells from 64 numbers."""
    cells = np.clip(128 + 300 * np.asarray(vector, dtype=np.float64), 0, 255).astype(np.uint8)[:64].reshape(8, 8)
    return np.kron(cells, np.ones((CELL, CELL), dtype=np.uint8))


def vector_images(embeddings: DataFrame) -> DataFrame:
    """An image table made from vectors (vec_id, embedding), as no table holds pictures: image id 2 vec_id is the vector's mosaic.

    Of every tenth vector there is an edited copy too, id 2 vec_id + 1: cut by a few pixels on each side, with less contrast and, of every
    twentieth, turned by a right angle. Vectors that are null, of other than 64 numbers, or hold nulls give no pixels.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple[int, int, int, bytes | None]] = []
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if v is None or len(v) != 64 or any(x is None for x in v):
                rows.append((2 * k, 0, 0, None))
                continue
            m = mosaic(np.array(v))
            rows.append((2 * k, *m.shape, m.tobytes()))
            if k % 10 == 0:
                e = np.rint(m[3:-2, 2:-3] * 0.9 + 8).astype(np.uint8)
                e = np.ascontiguousarray(np.rot90(e)) if k % 20 == 0 else e
                rows.append((2 * k + 1, *e.shape, e.tobytes()))
        ids, h, w, p = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(p, pa.binary())], names=["image", "height", "width", "pixels"])

    return map_batches(embeddings.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null"), run, "image long, height int, width int, pixels binary")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of copies of every image made from the embeddings table."""
    return image_copies(vector_images(table(spark, sf_dir, "embeddings")))
