"""Percentiles with bounded error from dyadic Count-sketches.

A value becomes a code of BITS bits in the order of values: sign, exponent and 14 bits of the mantissa of its
double, so a code's values differ by less than 2**-14 of their size, and whole numbers up to 2**15 have codes of
their own. For every number of leading bits, the sketch counts the codes by those bits: exactly for up to EXACT
bits, by a Count-sketch (DEPTH rows of WIDTH signed counters) for more. Sketches of parts are added; a
negative weight deletes. A rank is inverted from the top: at each level the estimated count of the left half
tells which half has it.

The sizes follow from the error. A rank is off by no more than the errors of the LEVELS estimates on its way down, so
each may be off by t = RANK_ERROR / LEVELS of the n values. Take a row of WIDTH = 8 / t counters. The WIDTH / 16
heaviest other nodes share the estimated one's counter with a probability of at most 1/16. The squares of the rest
add up to at most n^2 / (4 * WIDTH / 16), whatever the values, so by Chebyshev their part is beyond t * n with at most
another 1/16; signs are symmetric, so either side has half of the 1/8. The median of DEPTH rows is beyond on a side
only if (DEPTH + 1) / 2 rows are, which has a probability of at most C(DEPTH, (DEPTH + 1) / 2) * 16^-((DEPTH + 1) / 2);
both sides of all levels together stay below FAILURE. This takes the hash for random and holds for any values, ties
included; real errors are far smaller.

On their way between tasks, the counts of a group of few different codes travel as pairs of code and weight,
which is the shorter form of the same sketch; answers always come from the counters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .leaks import mixed

#: A percentile's rank is off by no more than RANK_ERROR of the rows with a probability of 1 - FAILURE at least, its value by
#: less than 2**-MANTISSA of its size.
RANK_ERROR, FAILURE = 0.01, 1e-3
MANTISSA = 14
BITS = 12 + MANTISSA
EXACT = 16
LEVELS = BITS - EXACT
WIDTH = 1 << (int(8 * LEVELS / RANK_ERROR) - 1).bit_length()
DEPTH = next(d for d in range(1, 99, 2) if 2 * LEVELS * comb(d, (d + 1) // 2) * 16.0 ** -((d + 1) // 2) <= FAILURE)
#: Different codes up to which a group travels as pairs (12 bytes each; counters take 4 MB); buffered numbers and open sketches of
#: counters (8 MB each) at which a task sends off what it has.
PAIRS, BUFFER, OPEN = 1 << 18, 4_000_000, 12
#: Tasks' parts of one group are added in so many heaps before the heaps are added.
HEAPS = 16
#: Bytes of states that a task hands on at once.
STATES = 1 << 24
#: Rows of counters that one hash of 64 bits serves: their number, a bit for the sign and the bits of a place each.
ROWS = 64 // (WIDTH.bit_length())
_SEEDS = mixed(np.arange(1, LEVELS * -(-DEPTH // ROWS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(LEVELS, -1)


def encode(x: np.ndarray) -> np.ndarray:
    """Codes of doubles, in their order."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.int64)
    key = np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64)
    return (key >> np.uint64(64 - BITS)).astype(np.uint32)


def decode(codes: np.ndarray) -> np.ndarray:
    """The least value of each code."""
    key = (np.asarray(codes, np.uint64) << np.uint64(64 - BITS)).view(np.int64)
    return np.where(key < 0, key ^ np.int64(-(2**63)), ~key).view(np.float64)


def _slots(nodes: np.ndarray, level: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row: its number, the nodes' counters in it and their signs."""
    step = WIDTH.bit_length()
    for row in range(DEPTH):
        if row % ROWS == 0:
            z = mixed(nodes.astype(np.uint64) + _SEEDS[level, row // ROWS])
        part = z >> np.uint64(step * (row % ROWS))
        yield row, (part & np.uint64(WIDTH - 1)).astype(np.int64), 1 - 2 * ((part >> np.uint64(step - 1)) & np.uint64(1)).astype(np.int64)


class Sketch:
    """Counters of one group; weights are whole numbers."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.pending = 0
        self.exact: np.ndarray | None = None
        self.signed: np.ndarray | None = None

    def add(self, codes: np.ndarray, weights: np.ndarray) -> None:
        self.codes.append(codes)
        self.weights.append(weights)
        self.pending += len(codes)
        if self.pending > 4 * PAIRS:
            self._settle(self.exact is not None)

    def _settle(self, dense: bool) -> None:
        """Pending pairs become one for each code, then counters, if told to or if they are many."""
        if self.pending:
            codes, where = np.unique(np.concatenate(self.codes), return_inverse=True)
            weights = np.bincount(where, np.concatenate(self.weights), len(codes)).astype(np.int64)
            live = weights != 0
            self.codes, self.weights = [codes[live]], [weights[live]]
            self.pending = int(live.sum())
        if dense or self.pending > PAIRS:
            if self.exact is None:
                self.exact, self.signed = np.zeros(1 << EXACT, np.int64), np.zeros((LEVELS, DEPTH, WIDTH), np.int64)
            if self.pending:
                codes, weights = self.codes[0], self.weights[0]
                self.exact += np.bincount(codes >> np.uint32(LEVELS), weights, 1 << EXACT).astype(np.int64)
                for level in range(LEVELS):
                    for row, at, sign in _slots(codes, level):
                        self.signed[level, row] += np.bincount(at, sign * weights, WIDTH).astype(np.int64)
                    codes = codes >> np.uint32(1)  # in order, so the nodes of the next level are runs
                    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                    codes, weights = codes[first], np.add.reduceat(weights, first)
            self.codes, self.weights, self.pending = [], [], 0

    def merge(self, state: bytes) -> None:
        kind, raw = state[:1], zlib.decompress(state[1:])
        if kind == b"p":
            n = len(raw) // 12
            self.add(np.frombuffer(raw, np.uint32, n), np.frombuffer(raw, np.int64, n, 4 * n))
            return
        self._settle(True)
        counters = np.frombuffer(raw, {b"i": np.int32, b"l": np.int64}[kind])
        self.exact += counters[: 1 << EXACT]
        self.signed += counters[1 << EXACT :].reshape(LEVELS, DEPTH, WIDTH)

    def state(self) -> bytes:
        self._settle(self.exact is not None)
        if self.exact is None:
            codes = self.codes[0] if self.codes else np.empty(0, np.uint32)
            weights = self.weights[0] if self.weights else np.empty(0, np.int64)
            return b"p" + zlib.compress(codes.tobytes() + weights.tobytes(), 1)
        counters = np.concatenate((self.exact, self.signed.ravel()))
        kind, to = (b"i", np.int32) if np.abs(counters).max() < 2**31 else (b"l", np.int64)
        return kind + zlib.compress(counters.astype(to).tobytes(), 1)

    def quantiles(self, qs: list[float]) -> tuple[int, list[float | None]]:
        """Number of values, and for each q the value at rank floor(q * (n - 1)); None without values."""
        self._settle(True)
        n = int(self.exact.sum())
        if n <= 0:
            return max(n, 0), [None] * len(qs)
        below = np.cumsum(self.exact)
        return n, [self._value(min(n - 1, max(0, int(np.floor(q * (n - 1))))), below) for q in qs]

    def _value(self, rank: int, below: np.ndarray) -> float:
        node = int(np.searchsorted(below, rank, "right"))
        rest, count = rank - int(below[node] - self.exact[node]), int(self.exact[node])
        for level in range(LEVELS - 1, -1, -1):
            guess = [int(sign[0] * self.signed[level, row, at[0]]) for row, at, sign in _slots(np.array([2 * node]), level)]
            left = min(count, max(0, int(np.median(guess))))
            node, rest, count = (2 * node, rest, left) if rest < left else (2 * node + 1, rest - left, count - left)
        return float(decode(np.array([node]))[0])


def _schema(df: DataFrame, keys: list[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), T.StructField("measure", T.StringType()), *more])


def sketches(df: DataFrame, keys: list[str], measures: list[str], weight: Column | None = None) -> DataFrame:
    """(keys, measure, state): the sketch of each measure in each group of keys, one row for each.

    Null, NaN values and null weights are left out; null keys make a group; a group without any value has no row.
    weight: a whole number for each row (1 by default), below 0 to delete. Columns are taken by name, others are
    ignored. Groups of any size: every task sends at most its share of the rows or the counters of each group.
    """
    sent = df.select(*keys, *(F.col(m).cast("double").alias(f"__v{i}") for i, m in enumerate(measures)), (F.lit(1) if weight is None else weight).cast("long").alias("__w"))
    schema = _schema(sent, keys, T.StructField("heap", T.IntegerType()), T.StructField("state", T.BinaryType()))
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = TaskContext.get().partitionId() % HEAPS
        types, held, open_sketches = None, 0, {}

        def sent_off() -> pa.RecordBatch:
            rows = [(*k, m, s.state()) for (k, m), s in open_sketches.items()]
            cols = [pa.array([r[i] for r in rows], types[i]) for i in range(n_keys)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([r[n_keys] for r in rows], pa.string()), pa.array([heap] * len(rows), pa.int32()), pa.array([r[-1] for r in rows], pa.binary())], schema.names)

        for b in batches:
            types = [b.column(i).type for i in range(n_keys)]
            group, values = np.zeros(b.num_rows, np.int64), []
            for i in range(n_keys):
                d = b.column(i).dictionary_encode(null_encoding="encode")
                group = group * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
                values.append(d.dictionary.to_pylist())
            weights = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            for i, m in enumerate(measures):
                v = b.column(n_keys + i).to_numpy(zero_copy_only=False)
                ok = np.flatnonzero(~np.isnan(v) & ~pd.isna(weights))
                ok = ok[np.argsort(group[ok], kind="stable")]
                if not len(ok):
                    continue
                codes, w = encode(v[ok]), weights[ok].astype(np.int64)
                cuts = np.flatnonzero(np.diff(group[ok], prepend=-1))
                for a, z in zip(cuts, np.append(cuts[1:], len(ok)), strict=True):
                    g, key = int(group[ok[a]]), []
                    for names in reversed(values):
                        key.append(names[g % len(names)])
                        g //= len(names)
                    s = open_sketches.setdefault((tuple(reversed(key)), m), Sketch())
                    held -= s.pending
                    s.add(codes[a:z], w[a:z])
                    held += s.pending
            if held > BUFFER or sum(s.exact is not None for s in open_sketches.values()) > OPEN or len(open_sketches) > 100_000:
                yield sent_off()
                open_sketches, held = {}, 0
        if open_sketches:
            yield sent_off()

    parts = sent.mapInArrow(run, schema)
    return merged(_added(parts, [*keys, "measure", "heap"]).drop("heap"), keys)


def _added(parts: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group of by: the states of parts added up, one after another in sorted order."""
    sent = parts.select(*by, "state").repartition(*by).sortWithinPartitions(*by)
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sketch, rows, types, size = None, None, [], None, 0

        def done() -> pa.RecordBatch:
            cols = [pa.array([r[0][i] for r in rows], types[i]) for i in range(n)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([r[1] for r in rows], pa.binary())], [*by, "state"])

        for b in batches:
            types = [b.column(i).type for i in range(n)]
            keys = list(zip(*(b.column(i).to_pylist() for i in range(n)), strict=True))
            for key, state in zip(keys, b.column(n), strict=True):
                if key != at or sketch is None:
                    if sketch is not None:
                        rows.append((at, sketch.state()))
                        size += len(rows[-1][1])
                    at, sketch = key, Sketch()
                    if size > STATES:
                        yield done()
                        rows, size = [], 0
                sketch.merge(state.as_py())
        if sketch is not None:
            rows.append((at, sketch.state()))
            yield done()

    return sent.mapInArrow(run, sent.schema)


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups (days, parts) added up to those of keys: (keys, measure, state)."""
    return _added(states, [*keys, "measure"])


def percentiles(states: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """(keys, measure, n, p<q>...): for each sketch its number of values and its percentiles.

    A percentile is the value at rank floor(q * (n - 1)), counted from 0; each one's rank is off by at most RANK_ERROR * n
    with a probability of 1 - FAILURE at least, and it is below the value by less than 2**-14 of its size. A group whose
    values were all deleted has n = 0 and nulls.
    """
    names = [f"p{round(100 * q):02d}" for q in qs]
    schema = _schema(states, keys, T.StructField("n", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, found = [], []
            for state in b.column(b.num_columns - 1):
                s = Sketch()
                s.merge(state.as_py())
                n, values = s.quantiles(qs)
                ns.append(n)
                found.append(values)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ns, pa.int64()), *(pa.array([v[i] for v in found], pa.float64()) for i in range(len(qs)))], schema.names)

    return states.select(*keys, "measure", "state").mapInArrow(run, schema)
