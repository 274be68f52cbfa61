"""Secret scans: fixed patterns, and character Markov models for the rest (operator 7)."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, table, text_bytes

#: The patterns of the base kinds, in their order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: Strings that the Markov models judge: runs of these characters, at least so long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RANDOM = 20
#: Nats a character by which the model of random strings must be ahead.
THRESHOLD = 0.5

#: Parts of which the labelled samples of ordinary identifiers are made.
STEMS = (
    "get set user name file path list item count index value data table column row key node tree page line text word number total time date "
    "start end first last next open close read write load save copy move delete insert update select create build make test check error message "
    "request response client server host port address config option setting default local global public private static class method function "
    "module package version release branch commit account order customer product price amount balance transfer payment invoice report summary "
    "the and that with from this which have been their other about would there some could into than then them these only over after also"
).split()


def labelled_samples(n: int = 4000, seed: int = 7) -> tuple[list[str], list[str]]:
    """Random strings and ordinary identifiers, `n` of each, the same for the same seed."""
    rng = np.random.default_rng(seed)
    sets = [ALPHABET[:62], ALPHABET[:64], "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ALPHABET[26:62]]
    random = ["".join(rng.choice(list(sets[i % len(sets)]), rng.integers(20, 64))) for i in range(n)]
    ordinary = []
    for i in range(n):
        parts = list(rng.choice(STEMS, rng.integers(2, 7)))
        style = i % 6
        if style == 0:
            s = "_".join(parts)
        elif style == 1:
            s = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == 2:
            s = "-".join(parts)
        elif style == 3:
            s = "/".join(parts)
        elif style == 4:
            s = "_".join(parts).upper()
        else:
            s = "".join(parts)
        if i % 4 == 0:
            s += str(rng.integers(0, 2100))
        ordinary.append(s)
    return random, ordinary


def _codes() -> np.ndarray:
    table_ = np.full(256, -1, dtype=np.int16)
    for i, c in enumerate(ALPHABET):
        table_[ord(c)] = i
    return table_


CODES = _codes()


def fit_markov(samples: list[str]) -> np.ndarray:
    """Log-probabilities of a character after another (last row: at the start), with half a count added to each."""
    k = len(ALPHABET)
    counts = np.full((k + 1, k), 0.5)
    for s in samples:
        x = CODES[np.frombuffer(s.encode("ascii"), dtype=np.uint8)]
        counts[k, x[0]] += 1
        np.add.at(counts, (x[:-1], x[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


@lru_cache(maxsize=4)
def ratio_table(n: int, seed: int) -> np.ndarray:
    random, ordinary = labelled_samples(n, seed)
    return fit_markov(random) - fit_markov(ordinary)


def log_ratio(s: bytes, table_: np.ndarray) -> float:
    """Mean log-likelihood ratio a character, random over ordinary."""
    x = CODES[np.frombuffer(s, dtype=np.uint8)]
    return float((table_[len(ALPHABET), x[0]] + table_[x[:-1], x[1:]].sum()) / len(x))


def _member(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars.encode(), dtype=np.uint8)] = True
    return out


_IS_HEX, _IS_WORD = _member("0123456789abcdef"), _member(ALPHABET)
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of member bytes within a row, at least so long: begins and ends."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = member[data]
    step = np.diff(inside)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - begin >= least
    begin, end = begin[long], end[long]
    if not len(begin):
        return begin, end
    # a run over a row's end is cut there
    out_b, out_e = [], []
    for b, e in zip(begin, end, strict=True):
        at = np.concatenate(([b], offsets[np.searchsorted(offsets, b, "right") : np.searchsorted(offsets, e, "left")], [e]))
        for x, y in zip(at[:-1], at[1:], strict=True):
            if y - x >= least:
                out_b.append(x), out_e.append(y)
    return np.array(out_b, dtype=np.int64), np.array(out_e, dtype=np.int64)


def _find_all(low: bytes, word: bytes) -> list[int]:
    out, at = [], low.find(word)
    while at >= 0:
        out.append(at)
        at = low.find(word, at + 1)
    return out


def uncovered(begin: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of [begin, end) outside all spans."""
    out, at = [], begin
    for x, y in sorted(s for s in spans if s[0] < end and begin < s[1]):
        if x > at:
            out.append((at, x))
        at = max(at, y)
    return [*out, (at, end)] if at < end else out


def scan(data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
    """Spans of each row that has any: (start, end, kind) in code points, sorted by start, then kind as listed."""
    found: dict[int, list[tuple[int, int, str]]] = {}
    raw = data.tobytes()

    def put(b: int, e: int, kind: str) -> None:
        row = int(np.searchsorted(offsets, b, "right")) - 1
        found.setdefault(row, []).append((b, e, kind))

    for b, e in zip(*_runs(data, offsets, _IS_HEX, MIN_HEX), strict=True):
        put(int(b), int(e), "hex")
    rows: set[int] = set()
    low = raw.lower()
    for word in _WORDS:
        rows.update((np.searchsorted(offsets, _find_all(low, word), "right") - 1).tolist())
    for row in rows:
        a = int(offsets[row])
        # every pattern is ASCII: matching on Latin-1 of the bytes finds the same matches by byte
        for m in _ASSIGN.finditer(raw[a : int(offsets[row + 1])].decode("latin-1")):
            if len(m.group(2)) >= MIN_VALUE:
                found.setdefault(row, []).append((a + m.start(), a + m.end(), "assign"))
    for row in {int(np.searchsorted(offsets, x, "right")) - 1 for x in _find_all(raw, b"AKIA")}:
        a = int(offsets[row])
        for m in _ACCESS.finditer(raw[a : int(offsets[row + 1])].decode("latin-1")):
            if m.end() - m.start() >= MIN_ACCESS:
                found.setdefault(row, []).append((a + m.start(), a + m.end(), "access"))
    for b, e in zip(*_runs(data, offsets, _IS_WORD, MIN_RANDOM), strict=True):
        row = int(np.searchsorted(offsets, b, "right")) - 1
        for x, y in uncovered(int(b), int(e), [(x, y) for x, y, k in found.get(row, ()) if k != "random"]):
            part = raw[x:y]
            # digits only are a number
            if y - x >= MIN_RANDOM and not part.isdigit() and log_ratio(part, ratio) >= THRESHOLD:
                put(x, y, "random")
    out = {}
    for row, spans in found.items():
        a = int(offsets[row])
        lead = np.concatenate(([0], np.cumsum((data[a : int(offsets[row + 1])] & 0xC0) != 0x80)))
        out[row] = sorted(((int(lead[b - a]), int(lead[e - a]), k) for b, e, k in spans), key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, samples: int = 4000, seed: int = 7) -> DataFrame:
    """Adds `spans`, an array of (start, end, kind), to the columns of docs, or to those in `keep`.

    Base kinds are leftmost, non-overlapping matches of the patterns above, kinds on their own; matches
    shorter than the least lengths are dropped after matching. `random` spans are runs of ALPHABET, or
    what base spans leave of them, at least MIN_RANDOM long, that are not mere numbers and look random: two first-order Markov models,
    of random strings and of ordinary identifiers, are fitted on labelled samples (`samples` of each, a
    fixed bound), and the mean log-likelihood ratio decides. Null and empty texts have no spans. Offsets are
    in code points, ends exclusive. A column called `spans` is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("spans", "__bytes")]
    kinds = dict(docs.dtypes)
    source = docs.select(*keep, F.col(text).cast("binary").alias("__bytes"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(len(keep)))
        found = scan(data, offsets, ratio_table(samples, seed))
        spans = [[{"start": b, "end": e, "kind": k} for b, e, k in found.get(i, ())] for i in range(batch.num_rows)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(spans, kind)], names=[*keep, "spans"])

    return map_batches(source, run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", spans array<struct<start: bigint, end: bigint, kind: string>>")


def redact(docs: DataFrame, mask: str = "[SECRET]", text: str = "text") -> DataFrame:
    """The same rows and columns with every span of the text replaced by `mask`, overlapping spans by one."""
    columns = docs.columns
    found = find_secrets(docs, text)
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)).alias("out"), s["end"].alias("at"))
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    return found.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(F.col(text))).select(*columns)


def _digest(spans) -> str:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, their digest and all spans, for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "random")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), n("random").alias("n_random"))
