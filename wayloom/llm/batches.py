"""Arrow batches in and out of Python workers, shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_text(df: DataFrame, id_col: str, text_col: str, fn: Callable[[list, list], dict], schema: str) -> DataFrame:
    """``fn(ids, texts)`` over batches of two columns; it returns columns named as in ``schema``."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, min(b.num_rows, int(4_000_000 * b.num_rows / max(1, b.nbytes)))) if b.num_rows else 1
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                cols = fn(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type, from_pandas=False) for f in out], schema=out)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], dict | None], schema: str,
             parts: int | None = None) -> DataFrame:
    """``fn`` over each group of ``keys`` (rows in ``order``), streamed partition by partition.

    A task holds one group at a time, so groups must be of bounded size.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table, bounds):
            got: dict[str, list] = {f.name: [] for f in out}
            for lo, hi in bounds:
                cols = fn(t.slice(lo, hi - lo))
                if cols:
                    for n, v in cols.items():
                        got[n].extend(v)
            if out.names and got[out.names[0]]:
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

        for b in batches:
            if not b.num_rows:
                continue
            if held:  # a long group: look only at the seam until another key comes
                last = held[-1]
                if all(last.column(k)[last.num_rows - 1] == b.column(k)[b.num_rows - 1] for k in keys):
                    held.append(b)
                    continue
            t = pa.Table.from_batches([*held, b])
            s = starts(t)
            yield from done(t, zip(s[:-1], s[1:]))
            held = t.slice(s[-1]).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield from done(t, [(0, t.num_rows)])

    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


_M = (1 << 64) - 1


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


class Rolling:
    """64-bit hashes of substrings of a byte string, from prefix sums of random byte values times powers."""

    def __init__(self, seed: int = 20240):
        r = np.random.default_rng(seed)
        self.values = r.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(r.integers(1 << 40, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = max(n, 2 * len(self.up), 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.ones(1, np.uint64)
                while len(p) < size:  # doubling keeps every product in numpy
                    p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
                setattr(self, name, p)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def sums_of(self, codes: np.ndarray) -> np.ndarray:
        """The same for code points."""
        self._powers(len(codes) + 1)
        out = np.zeros(len(codes) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mix64(codes + self.values[0]) * self.up[: len(codes)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((sums[end] - sums[start]) * self.down[start])


def hash_part(col: str | Column, parts: Column | int) -> Column:
    """A number below ``parts`` from the hash of a column."""
    return F.pmod(F.xxhash64(col, F.lit(977)), F.lit(parts) if isinstance(parts, int) else parts)
