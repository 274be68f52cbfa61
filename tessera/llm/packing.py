"""Hierarchical packing of tokenised documents into context windows (operator 9)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, row_slices, stored, table, text_bytes
from tessera.llm.hashing import mixed

WINDOW = 4096
TIERS = (4096, 2048, 1024, 512)
END_ID = 2
#: Sequences of a training step.
STEP = 64
#: Pieces of a length are ranked in parts of about so many.
PART_ROWS = 1 << 9

#: Bytes of a unit that the table holds, ids that it may have, and slots of the table: 48 bytes each.
KEY, MOST_IDS, SLOT_BITS = 24, 8, 20
SLOTS = 1 << SLOT_BITS
#: What a byte is part of; the mark between words in the byte-pair encoder, an id that the vocabulary lacks.
BLANK, LETTER, DIGIT, MARK, ODD = range(5)
NEW_LINE = 60_000


def _classes() -> np.ndarray:
    out = np.full(256, ODD, dtype=np.uint8)
    out[33:127] = MARK
    out[ord("'")] = ODD
    out[[9, 10, 11, 12, 13, 32]] = BLANK
    out[48:58] = DIGIT
    out[65:91] = out[97:123] = LETTER
    return out


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Second bytes of the two-byte Latin letters from U+00C0 to U+00FF.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: Bytes inside lower-case words; names of last bytes, zero where there is none. Names keep words valid UTF-8: an upper-case letter's bytes, and
#: for the sharp s those of the multiplication sign.
_INNER = np.zeros(256, dtype=bool)
_INNER[97:123] = _INNER[0xA0:0xC0] = _INNER[[0x9F, 0xC3]] = True
_LAST = np.zeros(256, dtype=np.uint8)
_LAST[97:123] = np.arange(65, 91)
_LAST[0xA0:0xBF] = np.arange(0x80, 0x9F)
_LAST[0x9F] = 0x97
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def _byte_names() -> dict[str, int]:
    """The characters by which byte-level vocabularies name bytes: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds:
    """Ids of texts by a word-level BPE tokenizer, as little-endian 32-bit words.

    The tokenizer cuts at white space, between letters and what is none, and around each digit, and drops white space; so
    strings of plain letters, single digits and runs of ASCII marks are units whose ids follow one another. A batch's units
    are found, keyed by their own bytes (KEY at most) and looked up in a table of bounded size all at once. Words that it does
    not hold go through a byte-pair encoder over the same vocabulary, in which the last byte of a word has a name of its own in
    place of the vocabulary's word-end mark; ids rank merges there as here. All other units, strings with apostrophes, controls or other
    letters, and texts with rarer letters or marks that may be special, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        model = json.loads(self.whole.to_str())["model"]
        names, mark = _byte_names(), model["end_of_word_suffix"]
        ranks = {b"\n": NEW_LINE}
        for token, rank in model["vocab"].items():
            end = token.endswith(mark)
            body = token[: -len(mark)] if end else token
            raw = bytes(names[c] for c in body) if body and all(c in names for c in body) else b""
            if raw and all(_INNER[b] for b in raw) and not (end and not _LAST[raw[-1]]):
                ranks[raw[:-1] + bytes([_LAST[raw[-1]]]) if end else raw] = rank
        self.words = tiktoken.Encoding("words", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})
        # two ways a slot: the unit's bytes and how many ids it has; the ids
        self.keys = np.zeros((SLOTS, 4), dtype=np.uint64)
        self.ids = np.zeros((SLOTS, MOST_IDS), dtype=np.uint16)
        self.short = lru_cache(maxsize=1 << 15)(self._encode)

    def _encode(self, raw: bytes) -> np.ndarray:
        return np.array(self.whole.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4")

    def _rare(self, raw: bytes) -> np.ndarray:
        return self.short(raw) if len(raw) <= 128 else self._encode(raw)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return [x.tobytes() for x in self.rows(*text_bytes(pa.array(texts, pa.string())))]

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each row of concatenated UTF-8 texts."""
        for a, b in row_slices(offsets):
            yield from self._slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    def _slice(self, part: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        n = len(bounds) - 1
        if not len(part):
            return [np.zeros(0, dtype="<u4")] * n
        kind, lower = _CLASS[part], np.zeros(len(part) + KEY, dtype=np.uint8)
        np.take(_LOWER, part, out=lower[: len(part)])
        starts = np.zeros(len(part) + 1, dtype=bool)
        starts[bounds] = True
        whole = self._letters_of_two_bytes(part, kind, lower, bounds)
        self._odd_strings(kind, starts)
        # a unit begins where the class changes, at each digit and at each row
        fresh = starts[:-1].copy()
        fresh[1:] |= kind[1:] != kind[:-1]
        fresh |= kind == DIGIT
        full = kind != BLANK
        begin = np.flatnonzero(fresh & full)
        last = full.copy()
        last[:-1] &= fresh[1:] | ~full[1:]
        end = np.flatnonzero(last) + 1
        flat, count = self._look_up(part, lower, kind[begin], begin, end)
        at = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(begin, bounds)]
        out = [flat[at[i] : at[i + 1]] for i in range(n)]
        for i in whole:
            out[i] = self._encode(part[bounds[i] : bounds[i + 1]].tobytes())
        return out

    def _letters_of_two_bytes(self, part: np.ndarray, kind: np.ndarray, lower: np.ndarray, bounds: np.ndarray) -> list[int]:
        """Marks Latin letters of two bytes as such and lowers them; rows that must go whole are blanked and returned."""
        c3 = np.flatnonzero(part[:-1] == 0xC3)
        c3 = c3[_LATIN[part[c3 + 1]]]
        kind[c3] = kind[c3 + 1] = LETTER
        up = c3[(part[c3 + 1] < 0x9F)] + 1
        lower[up] += 0x20
        far = np.flatnonzero(part >= 0xC9)
        far = far[(part[far] > 0xC9) | (part[np.minimum(far + 1, len(part) - 1)] >= 0x90)]
        special = np.flatnonzero((part[:-1] == ord("<")) & (part[1:] == ord("|")))
        whole = np.unique(np.searchsorted(bounds, np.concatenate((far, special)), side="right") - 1).tolist()
        for i in whole:
            kind[bounds[i] : bounds[i + 1]] = BLANK
        return whole

    def _odd_strings(self, kind: np.ndarray, starts: np.ndarray) -> None:
        """Strings between blanks that hold an odd byte are odd as a whole."""
        odd = np.flatnonzero(kind == ODD)
        if not len(odd):
            return
        full = kind != BLANK
        first = full & starts[:-1]
        first[1:] |= full[1:] & ~full[:-1]
        last = full & starts[1:]
        last[:-1] |= full[:-1] & ~full[1:]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        k = np.unique(np.searchsorted(begin, odd, side="right") - 1)
        step = np.zeros(len(kind) + 1, dtype=np.int8)
        step[begin[k]] += 1
        step[end[k]] -= 1
        kind[np.cumsum(step[:-1]) > 0] = ODD

    def _look_up(self, part: np.ndarray, lower: np.ndarray, kind: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and how many each has."""
        n, size = len(begin), end - begin
        count = np.zeros(n, dtype=np.int64)
        # eight bytes at any place as one number; a unit is short enough for three of them, and holds no zero byte
        eight = np.ndarray((len(lower) - 7,), dtype="<u8", buffer=lower, strides=(1,))
        key = np.empty((n, 3), dtype=np.uint64)
        for j in range(3):
            key[:, j] = eight[np.minimum(begin + 8 * j, len(lower) - 8)] & _MASK[np.clip(size - 8 * j, 0, 8)]
        short = (size <= KEY) & (kind != ODD)
        h = mixed(key[:, 0] + mixed(key[:, 1] + mixed(key[:, 2])))
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        todo, place = np.flatnonzero(short), np.full(n, -1)
        for way in (0, 1):
            s = slot[todo] ^ way
            row = np.take(self.keys, s, axis=0)
            hit = _same(row, np.take(key, todo, axis=0)) & (row[:, 3] > 0)
            at = todo[hit]
            count[at], place[at] = row[hit, 3], s[hit]
            todo = todo[~hit]
        known = np.flatnonzero(place >= 0)
        if len(known) == n:
            found = np.take(self.ids, place, axis=0)
        else:
            found = np.zeros((n, MOST_IDS), dtype=np.uint16)
            found[known] = np.take(self.ids, place[known], axis=0)
        rare = np.flatnonzero(~short)
        if len(todo):
            _, one, same = np.unique(h[todo], return_index=True, return_inverse=True)
            new = todo[one]
            c, ids = self._learn(part, lower, kind[new], begin[new], end[new])
            self._keep(key[new], slot[new], h[new], c, ids)
            ok = (c[same] > 0) & _same(key[new[same]], key[todo])
            count[todo[ok]], found[todo[ok]] = c[same][ok], ids[same][ok]
            rare = np.concatenate((rare, todo[~ok]))
        # the first ids of each row, as many as it has
        lead = np.cumsum(count) - count
        table = np.take(found.reshape(-1), np.arange(int(count.sum())) + np.repeat(np.arange(n) * MOST_IDS - lead, count)).astype("<u4")
        if not len(rare):
            return table, count
        by_table = np.ones(n, dtype=bool)
        by_table[rare] = False
        rest = [self._rare(part[b:e].tobytes()) for b, e in zip(begin[rare].tolist(), end[rare].tolist(), strict=True)]
        count[rare] = [len(x) for x in rest]
        flat = np.empty(int(count.sum()), dtype="<u4")
        flat[np.repeat(by_table, count)] = table
        at = np.cumsum(count) - count
        for i, x in zip(rare.tolist(), rest, strict=True):
            flat[at[i] : at[i] + len(x)] = x
        return flat, count

    def _learn(self, part: np.ndarray, lower: np.ndarray, kind: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each unit has, and they; units with more than MOST_IDS count as having none here."""
        count, ids = np.zeros(len(begin), dtype=np.int64), np.zeros((len(begin), MOST_IDS), dtype=np.uint16)
        last = _LAST[lower[end - 1]]
        plain = np.flatnonzero((kind == LETTER) & (last > 0))
        if len(plain):
            named = lower.copy()
            named[end[plain] - 1] = last[plain]
            raw = named.tobytes()
            got = self.words.encode_to_numpy("\n".join(raw[b:e].decode() for b, e in zip(begin[plain].tolist(), end[plain].tolist(), strict=True)) + "\n", disallowed_special=())
            stop = np.flatnonzero(got == NEW_LINE)
            first = np.concatenate(([0], stop[:-1] + 1))
            size = stop - first
            fits = size <= MOST_IDS
            count[plain[fits]] = size[fits]
            place = np.minimum(first[fits, None] + np.arange(MOST_IDS), len(got) - 1)
            ids[plain[fits]] = np.where(np.arange(MOST_IDS) < size[fits, None], got[place], 0)
        for i in np.setdiff1d(np.arange(len(begin)), plain).tolist():
            x = self._rare(part[begin[i] : end[i]].tobytes())
            if 0 < len(x) <= MOST_IDS:
                count[i], ids[i, : len(x)] = len(x), x
        return count, ids

    def _keep(self, key: np.ndarray, slot: np.ndarray, h: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Puts units into a free way of their slots, or else into one of the two: a unit that is put out is learned anew."""
        ok = count > 0
        key, slot, h, count, ids = key[ok], slot[ok], h[ok], count[ok], ids[ok]
        other = slot ^ 1
        free, free2 = self.keys[slot, 3] == 0, self.keys[other, 3] == 0
        at = np.where(free, slot, np.where(free2 | (h & np.uint64(1) > 0), other, slot))
        # where several fall into one place the last one stays, with its own ids
        at, one = np.unique(at[::-1], return_index=True)
        one = len(key) - 1 - one
        self.keys[at, :3], self.keys[at, 3], self.ids[at] = key[one], count[one], ids[one]


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows begin with the same three numbers."""
    return (a[:, 0] == b[:, 0]) & (a[:, 1] == b[:, 1]) & (a[:, 2] == b[:, 2])


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for each worker process: what it has learned stays from task to task, in a table of fixed size."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each document's ids and END_ID, cut at multiples of WINDOW.

    Whole windows are pieces of their own; the rest of the document is the last piece. A null or empty
    text is one piece of one id. Ids never leave the task; only their checksums do.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, length, crc, total = [], [], [], [], []
        for i, ids in enumerate(word_ids(path).rows(*text_bytes(batch.column(1)))):
            ids = memoryview(np.append(ids, np.uint32(END_ID)).astype("<u4").tobytes())
            n = len(ids) // 4
            for at in range(0, n, WINDOW):
                part = ids[4 * at : 4 * (at + WINDOW)]
                row.append(i), start.append(at), length.append(len(part) // 4), crc.append(zlib.crc32(part)), total.append(n)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["k", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(rows, cut, f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("k", key)


def plan(histogram: dict[int, int]) -> tuple[list[tuple[int, int, list[int]]], np.ndarray]:
    """How pieces of the given lengths go together: (tier, how often, lengths in a sequence), and the segments.

    Lengths are routed to the shortest tier that holds them. Every piece of the longest tier opens a
    window, and its gap is filled from the shorter tiers: by one or two pieces that fill it exactly if there are
    such, else by the longest that fits, and so on. What is left of the shorter tiers is packed tier by
    tier into windows of that size, of which only exactly full ones stay, and last into windows of the
    longest tier. A step takes a combination as often as stock allows, so that at least one length runs
    out: the plan has at most about as many entries as WINDOW for each tier, whatever the corpus.

    Segments are rows (length, first rank, how many, first sequence, offset): the pieces of a length, by rank.
    """
    stock = np.zeros(WINDOW + 1, dtype=np.int64)
    for n, c in histogram.items():
        stock[n] = c
    out: list[tuple[int, int, list[int]]] = []

    def fill(used: list[int], gap: int, most: int) -> int:
        """Adds pieces of at most `most` tokens to `used`; the gap that stays."""
        left = stock.copy()
        for x in used:
            left[x] -= 1
        while gap > 0:
            top = min(gap, most)
            if gap <= most and left[gap] > 0:
                used.append(gap)
                return 0
            # two that fill the gap; the long one first
            a = np.arange((gap + 1) // 2, min(gap - 1, most) + 1)
            if len(a):
                ok = (left[a] > 0) & (left[gap - a] > (a == gap - a))
                if ok.any():
                    x = int(a[ok][-1])
                    used += [x, gap - x]
                    return 0
            fits = np.flatnonzero(left[1 : top + 1] > 0)
            if not len(fits):
                return gap
            x = int(fits[-1]) + 1
            used.append(x)
            left[x] -= 1
            gap -= x
        return gap

    def take(used: list[int], tier: int) -> None:
        lengths, times = np.unique(used, return_counts=True)
        often = int((stock[lengths] // times).min())
        stock[lengths] -= often * times
        out.append((tier, often, used))

    if stock[WINDOW]:
        take([WINDOW], WINDOW)
    for n in range(WINDOW - 1, TIERS[1], -1):
        while stock[n] > 0:
            used = [n]
            fill(used, WINDOW - n, TIERS[1])
            take(used, WINDOW)
    for tier in TIERS[1:]:
        for n in range(tier, tier // 2, -1):
            while stock[n] > 0:
                used = [n]
                if fill(used, tier - n, tier):
                    break
                take(used, tier)
    for n in range(TIERS[1], 0, -1):
        while stock[n] > 0:
            used = [n]
            fill(used, WINDOW - n, TIERS[1])
            take(used, WINDOW)

    rank = np.zeros(WINDOW + 1, dtype=np.int64)
    segments, sequence = [], 0
    for _, often, used in out:
        at = 0
        for n in used:
            segments.append((n, rank[n], often, sequence, at))
            rank[n] += often
            at += n
        sequence += often
    return out, np.array(segments, dtype=np.int64).reshape(-1, 5)


def pack(cut: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id, offset, tier and step_group to pieces.

    The plan is made on the driver from the histogram of lengths, which has at most WINDOW rows. Pieces of equal length are
    interchangeable, so each finds its place from its rank among them; ranks are counted in parts by hash, as many
    as the length's count asks for, with the parts' sizes summed up beforehand. step_group deals sequences, which are
    numbered from long tiers to short, to steps in turn, so that each step gets the same mix.
    `cut` is read three times and should be a stored table. No piece gives no row.
    """
    histogram = {int(r["length"]): r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made, segments = plan(histogram)
    order = np.lexsort((segments[:, 1], segments[:, 0]))
    segments = segments[order]
    first = segments[:, 0] * (1 << 44) + segments[:, 1]
    total = sum(often for _, often, _ in made)
    steps = max(1, -(-total // STEP))
    tiers = np.array([t for t, _, _ in made], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum([often for _, often, _ in made])))[:-1].astype(np.int64)

    spark = cut.sparkSession
    parts = F.broadcast(spark.createDataFrame([(n, -(-c // PART_ROWS)) for n, c in histogram.items()], "length long, parts int"))
    parted = cut.join(parts, "length").withColumn("part", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.col("parts")))
    sizes = parted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0).cast("long")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy(key, "start", "ids_crc32")) - 1
    ranked = parted.withColumn("within", within).join(sizes, ["length", "part"]).withColumn("rank", F.col("within") + F.col("before"))
    names = [key, "start", "length", "ids_crc32", "doc_tokens"]
    kind = dict(cut.dtypes)[key]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column(2).to_numpy(zero_copy_only=False)
        rank = batch.column(5).to_numpy(zero_copy_only=False)
        s = segments[np.searchsorted(first, length * (1 << 44) + rank, side="right") - 1]
        sequence = s[:, 3] + rank - s[:, 1]
        tier = tiers[np.searchsorted(starts, sequence, side="right") - 1]
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + [pa.array(x, pa.int64()) for x in (sequence, s[:, 4], tier, sequence % steps)], names=[*names, "sequence_id", "offset", "tier", "step_group"])

    return map_batches(ranked.select(*names, "rank"), place, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences."""
    import public_tokenizers

    return pack(stored(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, tokens, padded): how full each sequence is; a power of two needs no padding."""
    s = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    power = F.expr("(tokens & (tokens - 1)) = 0")
    return s.withColumn("padded", F.when(power, F.lit(0)).otherwise(WINDOW - F.col("tokens")))
