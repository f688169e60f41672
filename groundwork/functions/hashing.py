"""Digest, bucket and SimHash expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_key(*parts: Column | str, sep: str = "|") -> Column:
    """SHA-256 of the parts joined by ``sep``; strings are literals."""
    columns = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return sha256(F.concat_ws(sep, *columns))


def hex_bucket(digest: Column, chars: int = 8, mod: int | None = None) -> Column:
    """Unsigned integer of the first hex characters, optionally modulo ``mod``."""
    value = F.conv(F.substring(digest, 1, chars), 16, 10).cast("bigint")
    return value if mod is None else value % mod


def head_long(digest: Column) -> Column:
    """First 64 bits of a hex digest as a signed long."""
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint")


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Hashes whose bits are laid out at a time.
_VOTED = 1 << 16


def _majority(lists: pa.ListArray) -> np.ndarray:
    """Per list of longs the long of the bits that at least half of them have; -1 for none.
    Nulls do not count."""
    values, parents = lists.flatten(), pc.list_parent_indices(lists)
    flat = values.drop_null().to_numpy(zero_copy_only=False)
    counts = np.bincount(parents.filter(values.is_valid()).to_numpy(zero_copy_only=False), minlength=len(lists))
    out, rows, ends = np.full(len(counts), -1, dtype=np.int64), np.flatnonzero(counts), np.cumsum(counts[counts > 0])
    start = done = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(ends, done + _VOTED, side="right")))
        some = counts[rows[start:stop]]
        bits = np.unpackbits(flat[done : ends[stop - 1]].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
        # runs of at most 255 hashes are summed in bytes, then the runs of a row
        runs = -(-some // 255)
        firsts, before = np.cumsum(some) - some, np.cumsum(runs) - runs
        at = np.repeat(firsts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(before, runs))
        ones = np.add.reduceat(np.add.reduceat(bits, at, axis=0, dtype=np.uint8), before, axis=0, dtype=np.int64)
        out[rows[start:stop]] = np.packbits(ones * 2 >= some[:, None], axis=1).view(">i8").ravel()
        start, done = stop, ends[stop - 1]
    return out


def with_simhash(df: DataFrame, keys: list[str], shingles: dict[str, Column]) -> DataFrame:
    """``keys`` and, per name, the SimHash of an array of strings as a signed long: bit b is set
    when at least half of their SHA-256 heads have it, all bits for none. A row's votes are
    counted where the row is, so nothing is shuffled."""
    heads = [F.transform(c, lambda g: head_long(sha256(g))).alias(n) for n, c in shingles.items()]
    hashed = df.select(*keys, *heads)
    names = hashed.columns

    def vote(batches):
        for batch in batches:
            columns = [batch.column(i) if i < len(keys) else pa.array(_majority(batch.column(i))) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([f if i < len(keys) else T.StructField(f.name, T.LongType()) for i, f in enumerate(hashed.schema)])
    return hashed.mapInArrow(vote, schema)


def stable_json(**fields: Column) -> Column:
    """One JSON object per row with keys in bytewise order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
