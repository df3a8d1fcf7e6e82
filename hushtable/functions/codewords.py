"""Column functions: codewords, bucket offsets, ring owners, record sizes and JSON checks."""

from __future__ import annotations

import bisect
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from ..errors import OutOfRange
from ..plans.schema import Kind, TableSchema

KEY_BITS, BUCKETS, RECORD_BYTES, VIRTUAL_NODES = 16, 16, 128, 128

# FNV-1a with 64 bits for codewords, another offset basis for the ring, and the SplitMix64 finisher.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
RING_BASIS = 1469598103934665603
MIX_ADD, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
U64 = (1 << 64) - 1


def fnv(data: bytes, basis: int = FNV_BASIS) -> int:
    for b in data:
        basis = (basis ^ b) * FNV_PRIME & U64
    return basis


def text_codeword(value: str, key_bits: int = KEY_BITS) -> int:
    return fnv(value.encode()) & ((1 << key_bits) - 1)


def codeword_of(value: int | str, key_bits: int = KEY_BITS) -> int:
    if isinstance(value, str):
        return text_codeword(value, key_bits)
    if not 0 <= value < 1 << key_bits:
        raise OutOfRange(f"{value} has no codeword of {key_bits} bits")
    return value


def codeword(column: str, kind: Kind, key_bits: int = KEY_BITS) -> Column:
    """The codeword of each value. With up to 40 bits the prime is 435 modulo the mask, so no product overflows; INT values out of range raise an error."""
    c = F.col(column)
    if kind is Kind.INT:
        value = c.cast("long")
        fits = value.between(0, (1 << min(key_bits, 62)) - 1)
        return F.when(fits | value.isNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"{column} has no codeword of {key_bits} bits: "), value.cast("string"))).cast("long"))
    if key_bits > 40:
        raise OutOfRange("text codewords have 40 bits at most")
    mask = (1 << key_bits) - 1
    def hashed_bytes(digits: Column) -> Column:
        code_units = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
        return F.aggregate(code_units, F.lit(FNV_BASIS & mask).cast("long"), lambda h, b: (h.bitwiseXOR(b) * (FNV_PRIME & mask)).bitwiseAND(F.lit(mask).cast("long")))

    # an array of one binds the digits, so that they are made once and not for every byte
    hashed = F.get(F.transform(F.array(F.hex(F.encode(c, "UTF-8"))), hashed_bytes), F.lit(0))
    return F.when(c == "", F.lit(FNV_BASIS & mask).cast("long")).otherwise(hashed)


def mix(value: int) -> int:
    x = (value + MIX_ADD) & U64
    x = (x ^ x >> 30) * MIX_A & U64
    x = (x ^ x >> 27) * MIX_B & U64
    return x ^ x >> 31


def first_bucket(codeword: Column, buckets: int = BUCKETS) -> Column:
    """``mix(codeword) mod buckets``, over Arrow batches, as Spark's integer products don't wrap."""

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        x = values.to_numpy(np.int64).astype(np.uint64) + np.uint64(MIX_ADD)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
        return pd.Series(((x ^ (x >> np.uint64(31))) & np.uint64(buckets - 1)).astype(np.int32))

    return run(codeword)


def ring(nodes: list[str]) -> tuple[list[int], list[str]]:
    """The points of the ring, ascending, and the node of each."""
    points = sorted((fnv(f"{n}#{v}".encode(), RING_BASIS), n) for n in sorted(set(nodes)) for v in range(VIRTUAL_NODES))
    return [p for p, _ in points], [n for _, n in points]


def shard_map_text(nodes: list[str]) -> str:
    """The nodes of a ring as text: sorted, each once, one a line."""
    return "\n".join(sorted(set(nodes)))


def shard_map_nodes(text: str) -> list[str]:
    return sorted({line.strip() for line in text.splitlines()} - {""})


def ring_owner(key: str, points: list[int], owners: list[str]) -> str:
    return owners[bisect.bisect_left(points, fnv(key.encode(), RING_BASIS)) % len(points)]


def owner(key: Column, nodes: list[str]) -> Column:
    """The node that owns each key string: the first point at or after its hash, around the ring."""
    points, owners = ring(nodes)
    places, names = np.array(points, np.uint64), np.array(owners, object)

    @F.pandas_udf("string")
    def run(keys: pd.Series) -> pd.Series:
        raw = [str(k).encode() for k in keys]
        h = np.full(len(raw), RING_BASIS, np.uint64)
        width = max(map(len, raw), default=0)
        grid = np.zeros((len(raw), width), np.uint8)
        for i, r in enumerate(raw):
            grid[i, : len(r)] = np.frombuffer(r, np.uint8)
        sizes = np.array([len(r) for r in raw])
        for j in range(width):
            live = j < sizes
            h[live] = (h[live] ^ grid[live, j]) * np.uint64(FNV_PRIME)
        return pd.Series(names[np.searchsorted(places, h) % len(places)])

    return run(key)


def record_bytes(schema: TableSchema) -> Column:
    """Bytes of a row's payload record: eight for a number, two and the UTF-8 length for text; the KEY isn't in it."""
    total = F.lit(0).cast("long")
    for c in schema.columns:
        if c.name in schema.returned:
            total = total + (F.lit(8) if c.kind in (Kind.INT, Kind.REAL) else F.octet_length(c.name) + 2)
    return total


def is_json(column: str) -> Column:
    """Whether the whole text is one JSON document; Spark's own parser takes trailing garbage."""

    def refused(x: str) -> None:
        raise ValueError(x)

    def valid(text: str | None) -> bool:
        try:
            json.loads(text, parse_constant=refused)
            return True
        except (TypeError, ValueError, RecursionError):
            return False

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        return values.map(valid).astype(bool)

    return run(F.col(column))
