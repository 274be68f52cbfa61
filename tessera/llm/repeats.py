"""Byte-exact removal of repeated passages by merged Burrows-Wheeler transforms (operator 3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, release_memory, row_slices, stored, table, text_bytes
from tessera.llm.hashing import powers, prefix, ranges

#: A string of so many bytes that starts twice is a repeat.
LENGTH = 200
#: Bytes of the grams by whose hash strings meet, and how many grams a string has.
GRAM = 64
SPREAD = LENGTH - GRAM
#: A row of more bytes is looked through in stretches.
SLICE_BYTES = 1 << 19
#: Contexts of a shard, of a merge, and kinds of a gram that are refined in one task.
SHARD, MERGE, HOT = 8192, 1 << 15, 1 << 11
#: Distances from the gram that parts of a larger gram's contexts have, one width after another; the last must be 1.
WIDTHS = (16, 1)
#: Columns of contexts: row, start, gram's distance, gram, hash of the bytes, whether they count twice, bytes; of parts, the context's gram and hash, and the place in it, too.
_CONTEXT = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
_PART = (*_CONTEXT, pa.int64(), pa.int64(), pa.int32())


def runs_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first start, number of starts, gram's distance, gram hash, hash of all bytes) of each run.

    Each start of a LENGTH-byte string in a row has its smallest gram, by hash, the leftmost of equals; that depends
    on the string's bytes alone, so equal strings have the same gram at the same distance. A run is a
    stretch of starts with the same gram; its bytes are those that its strings cover.
    """
    for a, b in row_slices(offsets):
        begin, end = int(offsets[a]), int(offsets[b])
        # a very long row goes by stretches that overlap by one string
        for at in range(begin, max(begin + 1, end), SLICE_BYTES):
            to = min(end, at + SLICE_BYTES + LENGTH - 1) if end - begin > SLICE_BYTES else end
            if at == begin or end - begin > SLICE_BYTES:
                yield from _runs(data[at:to], offsets[a : b + 1] - at, a)


def _runs(part: np.ndarray, bounds: np.ndarray, first_row: int) -> Iterator[tuple[np.ndarray, ...]]:
    n = len(part) - LENGTH + 1
    if n <= 0:
        return
    row_begin, row_end = np.maximum(bounds[:-1], 0), np.minimum(bounds[1:], len(part))
    sums = prefix(part)
    gram = (sums[GRAM:] - sums[:-GRAM]) * powers(len(sums))[1][: len(sums) - GRAM]
    gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    gram ^= gram >> np.uint64(32)
    bits = np.uint64(21)
    low = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= SPREAD + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPREAD + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    where = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
    # starts whose string ends inside their row
    mark = np.zeros(n + 1, dtype=np.int32)
    ok = row_end - row_begin >= LENGTH
    np.add.at(mark, row_begin[ok], 1)
    np.add.at(mark, row_end[ok] - LENGTH + 1, -1)
    inside = np.cumsum(mark[:-1]) > 0
    new = np.ones(n, dtype=bool)
    new[1:] = where[1:] != where[:-1]
    new[row_begin[ok]] = True
    start = np.flatnonzero(new & inside)
    if not len(start):
        return
    breaks = np.flatnonzero(new | ~inside)
    nxt = np.searchsorted(breaks, start, side="right")
    stop = np.where(nxt < len(breaks), breaks[np.minimum(nxt, len(breaks) - 1)], n)
    row = np.searchsorted(bounds, start, side="right") - 1
    q = where[start]
    # a stretch's rows are counted from where the row begins, which may be before the stretch
    yield row + first_row, start - bounds[row], stop - start, q - start, gram[q], ranges(sums, start, stop + LENGTH - 1)


def _refine(symbol: np.ndarray, lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """One refinement: where each place of the new interleave comes from, and the new common prefixes.

    lcp[i] is the common prefix of the suffixes at places i - 1 and i. Suffixes move one symbol to the left: they
    order by that symbol, and as before among equals; neighbours of the same symbol then share `depth` more than
    the least common prefix between their old places.
    """
    order = np.argsort(symbol, kind="stable")
    out = np.zeros(len(lcp), dtype=np.int32)
    s = symbol[order]
    same = np.flatnonzero(s[1:] == s[:-1]) + 1
    if len(same):
        a, b = order[same - 1] + 1, order[same] + 1
        at = np.empty(2 * len(same), dtype=np.int64)
        at[0::2], at[1::2] = a, b
        out[same] = np.minimum.reduceat(np.append(lcp, 0), at)[0::2] + depth
    return order, out


def shard_columns(columns: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """A shard's transform: for each depth its suffixes in order, and the symbols before them."""
    order = np.arange(len(columns[0]))
    out = []
    for c in columns:
        symbol = c[order]
        out.append((order, symbol))
        order = order[np.argsort(symbol, kind="stable")]
    out.append((order, np.zeros(0)))
    return out


def repeated_starts(group: np.ndarray, distance: np.ndarray, contexts: list[bytes]) -> list[np.ndarray]:
    """For each context, the starts (from its first byte) of strings that another context of its group has too.

    Contexts are distinct within a group and hold the group's gram `distance` bytes in. Each shard of contexts has a
    transform of its own, whose column at each depth lists the symbols before its suffixes in their order: right of the gram from the far end,
    the gram as one symbol, then left of it. The shards' transforms merge by their interleave
    alone: it starts as one shard after another, and each round distributes it by the shards' next
    symbols, deriving common prefixes on the way; no suffixes are compared. Neighbours with LENGTH
    bytes in common at a start are repeats.
    """
    n = len(contexts)
    if n < 2:
        return [np.zeros(0, dtype=np.int64)] * n
    left = np.zeros((SPREAD, n), dtype=np.uint16)
    right = np.zeros((SPREAD, n), dtype=np.uint16)
    size = np.zeros(n, dtype=np.int64)
    for i, (d, c) in enumerate(zip(distance.tolist(), contexts, strict=True)):
        x = np.frombuffer(c, dtype=np.uint8).astype(np.uint16) + 1
        left[:d, i] = x[:d][::-1]
        tail = x[d + GRAM :]
        right[: len(tail), i] = tail
        size[i] = len(c) - LENGTH + 1
    # groups in one merge are told apart by their number, which is enough for the gram's order
    number = np.unique(group, return_inverse=True)[1].astype(np.uint32)
    shards = [slice(i, min(i + SHARD, n)) for i in range(0, n, SHARD)]
    own = [shard_columns([*(right[d, s] for d in range(SPREAD - 1, -1, -1)), number[s], *(left[d, s] for d in range(SPREAD))]) for s in shards]
    base = np.array([s.start for s in shards])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint16), [s.stop - s.start for s in shards])
    lcp = np.zeros(n, dtype=np.int32)
    found: list[list[int]] = [[] for _ in range(n)]
    for depth in range(2 * SPREAD + 2):
        places = np.argsort(interleave, kind="stable")
        offset = depth - SPREAD - 1
        if offset >= 0:
            deep = lcp >= LENGTH
            deep[:-1] |= lcp[1:] >= LENGTH
            if deep.any():
                ids = np.empty(n, dtype=np.int64)
                ids[places] = np.concatenate([own[k][depth][0] + base[k] for k in range(len(shards))])
                hit = ids[deep]
                start = distance[hit] - offset
                for i, s in zip(hit.tolist(), start.tolist(), strict=True):
                    if 0 <= s < size[i]:
                        found[i].append(s)
        if depth == 2 * SPREAD + 1:
            break
        symbol = np.empty(n, dtype=own[0][depth][1].dtype)
        symbol[places] = np.concatenate([own[k][depth][1] for k in range(len(shards))])
        order, lcp = _refine(symbol, lcp, GRAM if depth == SPREAD else 1)
        interleave = interleave[order]
    return [np.array(sorted(x), dtype=np.int64) for x in found]


def _stretches(starts: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive starts as (first, how many)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return [(int(p[0]), len(p)) for p in np.split(starts, cut)]


def _hash64(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


def _packed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (keep, dk, t) with their texts compressed for the shuffle, as z."""
    kinds = dict(rows.dtypes)
    names = [*keep, "dk"]

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard as zstd

        c = zstd.ZstdCompressor(level=1)
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array([c.compress(t) for t in batch.column(len(names)).to_pylist()], pa.binary())], names=[*names, "z"])

    return map_batches(rows.select(*names, "t"), pack, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", z binary")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(dk, cover) for rows (dk, t): runs of repeated starts (s, n) of each row that has any.

    Every LENGTH-byte string of every row takes part. Strings meet by their smallest gram, and a run whose gram is nowhere
    else has none that occurs again. Of all other runs, those of the same bytes are one kind; the first and the last of a
    kind bring their bytes, and the merged transforms of a gram's contexts decide which strings occur twice, within a kind or
    between kinds. A gram of over HOT kinds would not fit one task: its contexts are cut by `narrower`, which loses nothing, until all
    groups fit, and merged in the same way. What is decided for a kind holds for all its runs, however many.
    """

    def runs(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = text_bytes(batch.column(1))
        out = list(runs_of(data, offsets))
        if not out:
            return None
        row, s, n, d, g, h = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(s, pa.int32()), pa.array(n, pa.int32()), pa.array(d, pa.int32()), pa.array(g.view(np.int64)), pa.array(h.view(np.int64))], names=["dk", "s", "n", "d", "g", "h"])

    found = map_batches(rows.select("dk", F.col("t").cast("binary")), runs, "dk long, s int, n int, d int, g long, h long")
    # each step either aggregates inside tasks first or joins with a written table, so that both sides are plain
    # shuffles and Spark can split the large partitions: a passage of very many rows is nobody's task
    often = stored(found.groupBy("g").agg(F.count("*").alias("many")).where("many > 1").select("g"))
    shared = stored(found.join(often, "g", "left_semi"))
    run = F.struct("dk", "s", "n", "d")
    kinds = stored(shared.groupBy("g", "h").agg(F.min(run).alias("one"), F.max(run).alias("two"), (F.count("*") > 1).alias("twice")))
    large = stored(kinds.groupBy("g").agg(F.count("*").alias("sorts")).where(F.col("sorts") > HOT).select("g"))
    # a kind whose first and last run are in wholly equal rows brings its bytes once, and they count twice
    two = F.when(F.col("twice") & (F.col("one") != F.col("two")), F.array("one", "two")).otherwise(F.array("one"))
    speak = kinds.select("g", "h", (F.col("twice") & (F.col("one") == F.col("two"))).alias("twice"), F.explode(two).alias("r")).select("r.*", "g", "h", "twice")
    speak = stored(speak.groupBy("dk").agg(F.collect_list(F.struct("s", "n", "d", "g", "h", "twice")).alias("r")))
    joined = _packed(rows, []).join(speak, "dk").select("dk", "z", "r")

    def contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard as zstd

        out = zstd.ZstdDecompressor()
        cols: dict[str, list] = {k: [] for k in ("dk", "s", "d", "g", "h", "twice", "c")}
        for dk, z, rs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            t = out.decompress(z)
            for r in rs:
                for k in ("s", "d", "g", "h", "twice"):
                    cols[k].append(r[k])
                cols["dk"].append(dk)
                cols["c"].append(t[r["s"] : r["s"] + r["n"] + LENGTH - 1])
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), _CONTEXT, strict=True)], names=list(cols))

    context = map_batches(joined, contexts, "dk long, s int, d int, g long, h long, twice boolean, c binary")
    if large.isEmpty():
        decided = _merged(context)
    else:
        context = stored(context)
        decided = _merged(context.join(large, "g", "left_anti")).unionByName(_merged_by_parts(context.join(large, "g", "left_semi")))
    decided = stored(decided)
    cover = shared.join(decided, ["g", "h"]).select("dk", (F.col("s") + F.col("a")).alias("s"), F.col("k").alias("n"))
    return cover.groupBy("dk").agg(F.sort_array(F.collect_set(F.struct("s", "n"))).alias("cover"))


def _merged(context: DataFrame) -> DataFrame:
    """(g, h, a, k): of each kind of context (dk, s, d, g, h, twice, c), runs of repeated starts, counted from its first byte."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups, about MERGE contexts at a time; rows come sorted by gram."""
        held: list[dict] = []

        def done(rows_: list[dict]) -> pa.RecordBatch | None:
            # equal rows of the input bring a context more than once
            each = {(r["g"], r["h"], r["dk"], r["s"]): r for r in rows_}.values()
            each = [r for r in each for _ in range(1 + r["twice"])]
            # grams are told apart by their bytes too
            name: dict[tuple[int, bytes], int] = {}
            group = np.array([name.setdefault((r["g"], r["c"][r["d"] : r["d"] + GRAM]), len(name)) for r in each])
            starts = repeated_starts(group, np.array([r["d"] for r in each]), [r["c"] for r in each])
            cols: list[list[int]] = [[], [], [], []]
            for (g, h), x in {(r["g"], r["h"]): x for r, x in zip(each, starts, strict=True)}.items():
                for a, k in _stretches(x):
                    for col, v in zip(cols, (g, h, a, k), strict=True):
                        col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["g", "h", "a", "k"]) if cols[0] else None

        for batch in batches:
            held += batch.to_pylist()
            if len(held) >= MERGE and held[0]["g"] != held[-1]["g"]:
                cut = max(i for i in range(len(held)) if i == 0 or held[i]["g"] != held[i - 1]["g"])
                out, held = done(held[:cut]), held[cut:]
                if out is not None:
                    yield out
        out = done(held) if held else None
        held = []
        if out is not None:
            yield out
        del out
        release_memory()

    ordered = context.select("dk", "s", "d", "g", "h", "twice", "c").repartition("g").sortWithinPartitions("g")
    return ordered.mapInArrow(merge, "g long, h long, a int, k int")


def narrower(c: bytes, d: int, width: int) -> Iterator[tuple[int, int, bytes]]:
    """(first start, how many, core) of parts of a context whose gram is `d` bytes in: starts by distance from the gram, `width` distances each.

    All strings of such a part hold its core, the bytes from the last to begin up to the first to end. Equal strings have the same
    distance and so the same core: they meet in the same part.
    """
    last = d - (len(c) - LENGTH)
    for low in range(last // width * width, d + 1, width):
        first, to = d - min(d, low + width - 1), d - max(last, low)
        yield first, to - first + 1, c[d - low : d - low - width + 1 + LENGTH]


def _merged_by_parts(context: DataFrame) -> DataFrame:
    """_merged for grams of too many kinds: parts of contexts are grouped by their cores, narrow ones first, then by single strings.

    A group of single strings has one kind, so no group is left that is too large.
    """
    out, rest = None, context.select("dk", "s", "d", "g", "h", "twice", "c", F.col("g").alias("g0"), F.col("h").alias("h0"), F.lit(0).alias("a0"))
    for width in WIDTHS:

        def parts(batch: pa.RecordBatch, width: int = width) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in _PART]
            for r in batch.to_pylist():
                for a, n, core in narrower(r["c"], r["d"], width):
                    c = r["c"][a : a + n + LENGTH - 1]
                    # equal cores at other distances stay apart
                    g = _hash64(core + ((r["d"] - a) // width).to_bytes(4, "little"))
                    for col, v in zip(cols, (r["dk"], r["s"] + a, r["d"] - a, g, _hash64(c), r["twice"], c, r["g0"], r["h0"], r["a0"] + a), strict=True):
                        col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, _PART, strict=True)], names=["dk", "s", "d", "g", "h", "twice", "c", "g0", "h0", "a0"])

        part = stored(map_batches(rest, parts, "dk long, s int, d int, g long, h long, twice boolean, c binary, g0 long, h0 long, a0 int"))
        run = F.struct("dk", "s")
        kinds = stored(part.groupBy("g", "h").agg(F.min(run).alias("one"), F.max(run).alias("two")))
        large = stored(kinds.groupBy("g").agg(F.count("*").alias("sorts")).where(F.col("sorts") > HOT).select("g"))
        speak = kinds.join(large, "g", "left_anti").select("g", "h", F.explode(F.array_distinct(F.array("one", "two"))).alias("r")).select("g", "h", "r.dk", "r.s")
        decided = stored(_merged(part.join(stored(speak), ["g", "h", "dk", "s"])))
        found = part.join(decided, ["g", "h"]).select(F.col("g0").alias("g"), F.col("h0").alias("h"), (F.col("a") + F.col("a0")).alias("a"), "k").distinct()
        out = found if out is None else out.unionByName(found)
        rest = part.join(large, "g", "left_semi").select(part.columns)
    return out


def _spans(cover, size: int) -> list[tuple[int, int]]:
    """Maximal covered byte ranges from sorted (s, n) runs of starts."""
    if cover is None or not len(cover):
        return []
    out: list[list[int]] = []
    for r in cover:
        a, b = r["s"], r["s"] + r["n"] + LENGTH - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (all but text by default), n_bytes, n_removed, spans and kept (binary).

    Every byte covered by a LENGTH-byte string that starts anywhere else too, in the same or another
    row, is removed; strings are judged on the input and never cross rows. Null texts count as empty. Rows wholly equal
    in key columns and text are still separate rows, so they are copies of each other.
    spans are maximal removed byte ranges (start, end); kept is what remains, in order. Clashing columns are replaced.
    """
    added = ("n_bytes", "n_removed", "spans", "kept", "dk")
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c not in added]
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    rows = rows.select(*keep, F.xxhash64(*keep, "t").alias("dk"), "t")
    cover = repeated_spans(rows.select("dk", "t"))
    kinds = dict(rows.dtypes)

    head = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    head += ", " if head else ""
    packed = _packed(rows, keep)
    joined = packed.join(cover, "dk", "left").select(*keep, "z", "cover")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard as zstd

        d = zstd.ZstdDecompressor()
        size, removed, spans, kept = [], [], [], []
        for z, cover_ in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True):
            t = d.decompress(z)
            sp = _spans(cover_, len(t))
            rest, at = [], 0
            for a, b in sp:
                rest.append(t[at:a])
                at = b
            rest.append(t[at:])
            size.append(len(t)), removed.append(sum(b - a for a, b in sp)), spans.append([{"start": a, "end": b} for a, b in sp]), kept.append(b"".join(rest))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=[*keep, "n_bytes", "n_removed", "spans", "kept"])

    return map_batches(joined, cut, f"{head}n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept binary")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes, removed runs and a digest of what stays, for each document."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
