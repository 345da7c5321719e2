"""Whitening of embeddings from an exact characteristic polynomial.

Entries become integers (`scale` times the entry, rounded down, plus `shift`), so the scatter n * sum(x x') - S S' is a matrix of
integers, summed exactly: tasks add products of 20-bit limbs that stay below 2**53, Spark adds the tasks' sums as decimals. The
characteristic polynomial of that matrix is found modulo enough primes below 2**31 to cover its coefficients (Hessenberg form by
similarity, then the recurrence over leading blocks), the primes dealt over Spark's tasks, and put together by the Chinese
remainder theorem. All roots are real and none is negative, so the number of sign changes after a shift by a (Descartes' rule,
exact for such polynomials) is the number of roots above a: integers isolate the leading roots and bisection refines them far
below double precision. Components are null vectors of the matrix less the root, by inverse iteration in fixed point; roots
that agree to `DIGITS` bits are one of several dimensions, whose vectors are made orthogonal.

Rows whose vector is null or holds null or non-finite entries are dropped. Shorter vectors count as ended by zeros, empty ones
included. Null or repeated ids are kept as rows of their own; repeated rows count each time. Entries whose integer would leave
the range of +-2**62 are set to that bound. `deviation` is null where it exceeds a long. Directions without variance cannot be
whitened, so at most as many components are returned as roots are positive: equal rows, a single row and an empty table give no
rows. The column `embedding` and the id are all that is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilelab.llm.common import table

LIMB = 20  # bits; 4096 products of two limbs stay below 2**53
AT_ONCE = 1 << 12
LIMIT = 2**62
DIGITS = 120  # bits to which a root is known, relative to the largest
PRIMES_A_TASK = 32


@dataclass
class Scatter:
    n: int
    sums: list[int]  # of x
    matrix: list[list[int]] = field(repr=False)  # n * sum(x x') - S S'


def usable(vecs: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(v, e): rows whose vector is whole, as doubles."""
    e = F.col(embedding).cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vecs.select(F.col(vec_id).cast("long").alias("v"), e.alias("e")).where(F.col("e").isNotNull() & fine)


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * entry) as int64, one row a vector, ended by zeros."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * out), -LIMIT, LIMIT).astype(np.int64)


def _exact_products(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers. Signed limbs of 20 bits keep every partial sum exact in doubles."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), AT_ONCE):
        part, limbs = y[at : at + AT_ONCE], []
        while part.any():
            low = ((part + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))  # -2**19 .. 2**19 - 1
            limbs.append(low.astype(float))
            part = (part - low) >> LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def scatter(rows: DataFrame, width: int, scale: int, shift: int) -> Scatter | None:
    """The exact scatter of all rows; None without any. A task sends one row an entry of its upper triangle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((width + 1, width + 1), object)
        for batch in it:
            y = integers(batch.column("e"), width, scale)
            total += _exact_products(np.hstack([y, np.ones((len(y), 1), np.int64)]))
            n += len(y)
        if n:
            i, j = np.triu_indices(width + 1)
            v = total[i, j]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([str(x >> 64) for x in v]), pa.array([str(x & (2**64 - 1)) for x in v])], ["i", "j", "hi", "lo"])

    sums = rows.select("e").mapInArrow(batches, "i long, j long, hi string, lo string")
    sums = sums.groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(28,0)")).cast("string").alias(c) for c in ("hi", "lo")])
    got = {(r.i, r.j): (int(r.hi) << 64) + int(r.lo) for r in sums.collect()}  # (width + 1)(width + 2) / 2 numbers
    if not got:
        return None
    n = got[width, width]
    s = [got[i, width] for i in range(width)]
    m = [[n * got[min(i, j), max(i, j)] - s[i] * s[j] for j in range(width)] for i in range(width)]  # the shift cancels
    return Scatter(n, [x + n * shift for x in s], m)


def primes_below(limit: int, bits: int) -> list[int]:
    """The largest primes below `limit` whose product has more than `bits` bits."""
    small = [p for p in range(2, math.isqrt(limit) + 1) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    found, have, at = [], 0.0, limit
    while have <= bits:
        at -= 1
        if all(at % p for p in small):
            found.append(at)
            have += math.log2(at) - 1e-9
    return found


def polynomial_mod(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Characteristic polynomials, lowest coefficient first, of the matrices m[k] modulo the primes p[k] (below 2**31)."""
    a, k, d = m.copy(), len(p), m.shape[1]
    q, every = p[:, None], np.arange(len(p))

    def inverse(x: np.ndarray) -> np.ndarray:
        out, e, x = np.ones_like(x), p - 2, x.copy()
        while e.any():
            out = np.where(e & 1, out * x % p, out)
            x, e = x * x % p, e >> 1
        return out

    for c in range(d - 2):  # Hessenberg form: rows and columns change together
        at = c + 1 + np.argmax(a[:, c + 1 :, c] != 0, axis=1)
        rows = a[every, at].copy()
        a[every, at], a[:, c + 1] = a[:, c + 1].copy(), rows
        cols = a[every, :, at].copy()
        a[every, :, at], a[:, :, c + 1] = a[:, :, c + 1].copy(), cols
        factor = a[:, c + 2 :, c] * inverse(a[:, c + 1, c])[:, None] % q
        a[:, c + 2 :] = (a[:, c + 2 :] - factor[:, :, None] * a[:, None, c + 1] % p[:, None, None]) % p[:, None, None]
        for r in range(d - c - 2):
            a[:, :, c + 1] = (a[:, :, c + 1] + factor[:, r, None] * a[:, :, c + 2 + r]) % q
    polys = [np.zeros((k, d + 1), np.int64)]
    polys[0][:, 0] = 1
    for i in range(d):
        new = np.roll(polys[i], 1, axis=1)
        new = (new - a[:, i, i, None] * polys[i]) % q
        down = np.ones(k, np.int64)
        for j in range(i - 1, -1, -1):
            down = down * a[:, j + 1, j] % p
            new = (new - (a[:, j, i] * down % p)[:, None] * polys[j]) % q
        polys.append(new)
    return polys[d]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients of det(x - m), lowest first, for a symmetric integer matrix without negative roots."""
    d = len(m)
    trace = max(1, sum(m[i][i] for i in range(d)))
    # Coefficients are elementary symmetric sums of the roots: at most binomial(d, k) * (trace / d) ** k.
    bits = max(math.log2(math.comb(d, k)) + k * max(0.0, math.log2(trace) - math.log2(d)) for k in range(d + 1)) + 8
    primes = primes_below(1 << 31, math.ceil(bits))
    sent = spark.sparkContext.broadcast(m)  # d * d numbers

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            p = batch.column("p").to_numpy()
            for at in range(0, len(p), PRIMES_A_TASK):
                q = p[at : at + PRIMES_A_TASK]
                residues = np.array([[[x % int(y) for x in row] for row in sent.value] for y in q], np.int64)
                got = polynomial_mod(residues, q)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(list(got), pa.list_(pa.int64()))], ["p", "c"])

    tasks = -(-len(primes) // PRIMES_A_TASK)
    found = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(batches, "p long, c array<long>").collect()
    product, out = 1, [0] * (d + 1)
    for r in sorted(found, key=lambda r: r.p):  # Chinese remainders, one prime more at a time
        up = pow(product, -1, r.p)
        out = [x + product * ((c - x) * up % r.p) for x, c in zip(out, r.c, strict=True)]
        product *= r.p
    return [x - product if 2 * x > product else x for x in out]


def _shifted(poly: list[int], a: int, k: int) -> list[int]:
    """Coefficients, lowest first, of 2**(k d) * poly(x + a / 2**k) in powers of 2**k x."""
    d = len(poly) - 1
    c = [v << (k * (d - i)) for i, v in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    return c


def roots_above(poly: list[int], a: int, k: int) -> int:
    """Roots larger than a / 2**k of a polynomial with real roots only: the sign changes after the shift."""
    signs = [c > 0 for c in _shifted(poly, a, k) if c]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], a: int, k: int) -> int:
    value = 0
    for i, c in enumerate(reversed(poly)):
        value = value * a + (c << (k * i))
    return (value > 0) - (value < 0)


def leading_roots(poly: list[int], want: int) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) of the largest positive roots, falling, until `want` roots are found; exact to DIGITS bits of the
    largest. Roots that agree so far are one with a multiplicity."""
    d = len(poly) - 1
    top = max(1, -poly[d - 1])  # the trace bounds every root
    k = max(0, DIGITS + d.bit_length() - top.bit_length())
    found: list[tuple[Fraction, int]] = []

    def search(lo: int, hi: int, above_lo: int, above_hi: int) -> None:
        """The roots in (lo, hi], the right half first."""
        if above_lo == above_hi or sum(x for _, x in found) >= want:
            return
        least = max(1, (top << k) >> (DIGITS + d.bit_length()))
        if above_lo - above_hi == 1:  # isolated: the sign tells the side
            right = 1 if above_hi % 2 == 0 else -1  # right of it, as no other root lies between
            while hi - lo > least:
                mid = (lo + hi) // 2
                s = _sign(poly, mid, k)
                if s == 0:
                    lo = hi = mid
                elif s == right:
                    hi = mid
                else:
                    lo = mid
            found.append((Fraction(lo + hi, 2 << k), 1))
            return
        if hi - lo <= least:
            found.append((Fraction(lo + hi, 2 << k), above_lo - above_hi))
            return
        mid = (lo + hi) // 2
        above = roots_above(poly, mid, k)
        search(mid, hi, above, above_hi)
        search(lo, mid, above_lo, above)

    search(0, top << k, roots_above(poly, 0, k), 0)
    return found


def null_vectors(m: list[list[int]], root: Fraction, count: int) -> list[list[Fraction]]:
    """`count` orthogonal vectors that m - root sends to (nearly) nothing, by two steps of inverse iteration in fixed point."""
    d, bits = len(m), 2 * DIGITS + 64 + len(m).bit_length()
    size = max(1, max(abs(x) for row in m for x in row))
    one = 1 << bits
    off = round(root * one / size)
    a = np.array([[(x * one) // size - (off if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(m)], object)
    order, factors = [], []
    for c in range(d):  # triangular factors with row exchange
        best = c + max(range(d - c), key=lambda r: abs(a[c + r, c]))
        order.append(best)
        if best != c:
            a[[c, best]] = a[[best, c]]
        if a[c, c] == 0:
            a[c, c] = 1  # an exact root: the least step the numbers hold
        f = np.array([(x << bits) // a[c, c] for x in a[c + 1 :, c]], object)
        factors.append(f)
        if len(f):
            a[c + 1 :, c:] -= (f[:, None] * a[None, c, c:]) >> bits
    rng = np.random.default_rng(d)
    out: list[np.ndarray] = []
    for _ in range(count):
        v = np.array([int(x) << (bits - 32) for x in rng.integers(-(1 << 31), 1 << 31, d)], object)
        for _ in range(2):
            for c in range(d):
                if order[c] != c:
                    v[[c, order[c]]] = v[[order[c], c]]
                v[c + 1 :] -= (factors[c] * v[c]) >> bits
            for c in range(d - 1, -1, -1):
                v[c] = ((v[c] - ((a[c, c + 1 :] * v[c + 1 :]).sum() >> bits if c + 1 < d else 0)) << bits) // a[c, c]
            for u in out:
                v = v - ((u * ((u * v).sum() >> bits)) >> bits)
            length = math.isqrt(int((v * v).sum()))
            v = np.array([(int(x) << bits) // length for x in v], object)
        out.append(v)
    return [[Fraction(int(x), one) for x in v] for v in out]


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]
    shift: int
    scale: int
    values: tuple[float, ...]  # eigenvalues of the covariance of x, falling
    explained: tuple[float, ...]
    axes: np.ndarray  # unit vectors, one a row

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """Rows of integers without the shift, centred before they are projected."""
        return (self.centred(y) / self.n) @ (self.axes / np.sqrt(np.array(self.values))[:, None]).T

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * x - S as doubles, exact where it fits 53 bits."""
        s = [x - self.n * self.shift for x in self.sums]
        if max(abs(v) for v in (*s, 0)) < 2**61 and self.n * (np.abs(y).max() if y.size else 0) < 2**61:
            return (self.n * y - np.array(s, np.int64)).astype(float)
        return (self.n * y.astype(object) - np.array(s, object)).astype(float)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) ** 2 as integers; None beyond a long."""
        s = np.array([x - self.n * self.shift for x in self.sums], object)
        far = float(self.n) * float(np.abs(y).max() if y.size else 0) + float(max(abs(v) for v in (*s, 0)))
        if far * far * max(1, y.shape[1]) < 2**62:
            c = self.n * y - s.astype(np.int64)
            return (c * c).sum(1).tolist()
        c = self.n * y.astype(object) - s
        return [int(v) if v < 2**63 else None for v in (c * c).sum(1)]


def fit(vecs: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> Whitening | None:
    """The whitening of all usable rows; None where nothing varies."""
    rows = usable(vecs, vec_id, embedding)
    width = rows.agg(F.max(F.size("e"))).first()[0]
    if not width:
        return None
    got = scatter(rows, width, scale, shift)
    if got is None or not any(got.matrix[i][i] for i in range(width)):
        return None
    roots = leading_roots(characteristic_polynomial(vecs.sparkSession, got.matrix), min(components, width))
    trace = sum(got.matrix[i][i] for i in range(width))
    values, explained, axes = [], [], []
    for root, times in roots:
        for v in null_vectors(got.matrix, root, min(times, components - len(axes))):
            values.append(float(root / (got.n * got.n)))
            explained.append(float(root / trace))
            axes.append([float(x) for x in v])
    return Whitening(got.n, tuple(got.sums), shift, scale, tuple(values), tuple(explained), np.array(axes))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, from the rows themselves."""
    width, c = len(model.sums), len(model.values)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((c, c + 1)), 0
        for batch in it:
            w = model.whiten(integers(batch.column("e"), width, model.scale))
            total += np.hstack([w.T @ w, w.sum(0)[:, None]])
            n += len(w)
        if n:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    got = rows.select("e").mapInArrow(batches, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((c, c + 1))
    for r in got:
        total[r.i, r.j] = r.v / model.n
    return float(np.abs(total[:, :c] - np.outer(total[:, c], total[:, c]) - np.eye(c)).max())


def whiten(vecs: DataFrame, model: Whitening, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(v, deviation, whitened): one row per usable row, `whitened` an array with one entry a component."""
    width = len(model.sums)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            y = integers(batch.column("e"), width, model.scale)
            w = model.whiten(y)
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), w.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(model.deviations(y), pa.int64()), lists], ["v", "deviation", "whitened"])

    return usable(vecs, vec_id, embedding).mapInArrow(batches, "v long, deviation long, whitened array<double>")


def op13_whitening(spark, sf: str) -> DataFrame:
    vecs = table(spark, sf, "embeddings").select("vec_id", "embedding")
    model = fit(vecs)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(usable(vecs, "vec_id", "embedding"), model)
    long = whiten(vecs, model).select("v", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*[F.lit(x) for x in model.explained]), F.col("at") + 1)
    return long.select(F.col("v").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       share.alias("explained"), F.lit(error).alias("identity_error"))
