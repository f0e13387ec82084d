"""What the operators of this subpackage share: durable cuts, byte slices of Arrow batches, vectorised text hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import cut, drop_cut, made, release, shared_dir  # noqa: F401

#: Multiplier of the polynomial text hashes (odd, so it has an inverse modulo 2**64), and that inverse.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame) -> list[F.Column]:
    """All columns of df, whatever signs their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def documents_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text (null: empty), and the named columns; any others are left out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets into them; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``most`` bytes of text (or one row), their bytes and offsets from 0."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.names.index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; kept for later calls up to 4 M of them."""
    if len(_powers[0]) < n:
        made = []
        for b in (BASE, INVERSE):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if n > 1 << 22:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of bytes (each plus one), n+1 of them, modulo 2**64."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, independent of where they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n successive hashes, in order; len(h)-n+1 of them."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(BASE) + h[j : j + m]
    return mix(out)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that aren't ``gap`` (a table of 256 booleans), within each text; and for each text its first word's number (n+1 of them)."""
    inside = ~gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[: len(data)]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:] & ~first[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: A bitmap has 2**BITMAP bits, whatever the input.
BITMAP = 26


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = mix(keys) >> np.uint64(64 - BITMAP)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def bitmap_of(keys: DataFrame, column: str, picked: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> np.ndarray:
    """A bitmap of BITMAP bits of the column's values, or of what ``picked`` makes of the rows (in the same Python worker: two Arrow maps in a row would take two). Each task adds up its own; their words are dealt once, by the part of the bitmap that they lie in."""

    def words_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BITMAP - 6), np.uint64)
        for batch in picked(batches) if picked else batches:
            slot = mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITMAP)
            np.bitwise_or.at(bits, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        word = np.flatnonzero(bits)
        for at in range(0, len(word), 1 << 16):
            w = word[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((w >> 14).astype(np.int32)), pa.array(w), pa.array(bits[w].view(np.int64))], names=["part", "word", "bits"])

    def parts_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            part, word, bits = (batch.column(k).to_numpy() for k in range(3))
            for p in np.unique(part).tolist():
                own = part == p
                np.bitwise_or.at(found.setdefault(p, np.zeros(1 << 14, np.int64)), word[own] - (p << 14), bits[own])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["part", "bits"])

    some = (keys if picked else keys.select(column)).mapInArrow(words_, "part int, word long, bits long").repartition("part")
    parts = some.mapInArrow(parts_, "part int, bits binary").collect()  # 2**(BITMAP-20) rows of 128 KB at most
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    for part, bits in parts:
        out[part << 14 : (part + 1) << 14] = np.frombuffer(bits, np.uint64)
    return out
