"""Differences between two copies of a table, by set reconciliation over a finite field.

Every row with a key is hashed to an element of GF(2^61 - 1) and put into a bucket of about
``BUCKET_ROWS`` rows. Each side keeps the elements of its buckets to itself and makes sketches of
them: the number of elements and evaluations of their characteristic polynomial (the product of
``z - h`` over the rows) at a few points. Only sketches are exchanged. Where they differ, the ratio
of the two polynomials is a rational function whose numerator has the hashes of rows on the first side only as
roots, the denominator those on the second side only. It is interpolated under a bound on the number
of differences that starts at ``FIRST_BOUND`` and is doubled, with longer sketches of the buckets
concerned, until two further points confirm the function. A bucket that ``LAST_BOUND`` does not
serve is cut into ``SPLIT`` smaller ones, which start anew; since a bucket of few elements is always
served, this ends for copies as different as may be. Each side then finds the roots among its own elements.
All rows of the keys that the hashes so recovered belong to are fetched and compared field by field.

Buckets are cut from the row hash, not from the key, so no key, however frequent, fills one; equal
rows are merged before the shuffle. What is shuffled is hashes of rows, each on its own side, then sketches, then keys and
hashes to find the differing keys, and rows once at most, to fetch those of them.

Cases: equal rows count once; a null field equals a null field; a row without key is the same row as
one with equal fields on the other side and is no case itself; of several versions of a key each is
compared with each of the other side's, one row per pair and differing field, and a key that the
other side lacks has one row per version; empty tables and extra columns are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.session import cut, drop, small_side

PRIME = (1 << 61) - 1
#: Elements lie below this, evaluation points at or above it.
ELEMENTS = PRIME - (1 << 20)
BUCKET_ROWS = 32
FIRST_BOUND = 4
LAST_BOUND = 16
CHECKS = 2
SPLIT = 8
#: Buckets solved at a time in a task; bounds its memory.
BATCH = 4096

_P, _LOW, _MID = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_31, _30, _61, _1 = np.uint64(31), np.uint64(30), np.uint64(61), np.uint64(1)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in GF(2^61 - 1) of arrays of uint64 below the prime."""
    ah, al, bh, bl = a >> _31, a & _LOW, b >> _31, b & _LOW
    mid = ah * bl + al * bh
    r = ((ah * bh) << _1) + (mid >> _30) + ((mid & _MID) << _31) + al * bl
    r = (r & _P) + (r >> _61)
    return np.where(r >= _P, r - _P, r)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    r = a + (_P - b)
    return np.where(r >= _P, r - _P, r)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    r = a + b
    return np.where(r >= _P, r - _P, r)


def inverse(a: np.ndarray) -> np.ndarray:
    """By Fermat; zero gives zero."""
    out, base, e = np.ones_like(a), a, PRIME - 2
    while e:
        if e & 1:
            out = mul(out, base)
        base, e = mul(base, base), e >> 1
    return out


def evaluate(members: np.ndarray, present: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Characteristic polynomials of the rows of ``members`` at ``points``: [sets, points]."""
    out = np.empty((len(members), len(points)), np.uint64)
    for j, z in enumerate(points):
        v = np.where(present, sub(np.full(members.shape, z), members), _1)
        while v.shape[1] > 1:
            half = v.shape[1] // 2
            v = np.concatenate([mul(v[:, :half], v[:, half : 2 * half]), v[:, 2 * half :]], axis=1)
        out[:, j] = v[:, 0] if v.shape[1] else _1
    return out


def solve(system: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve many square systems at once, without division until the end; singular ones give rubbish."""
    n, k, _ = system.shape
    m = np.concatenate([system, right[:, :, None]], axis=2)
    rows = np.arange(n)
    for c in range(k):
        pivot = c + np.argmax(m[:, c:, c] != 0, axis=1)
        top = m[rows, pivot].copy()
        m[rows, pivot] = m[:, c]
        m[:, c] = top
        d = top[:, c]
        for r in range(k):
            if r != c:
                m[:, r] = sub(mul(m[:, r], d[:, None]), mul(top, m[:, r, c][:, None]))
    return np.stack([mul(m[:, c, k], inverse(m[:, c, c])) for c in range(k)], axis=1) if k else np.zeros((n, 0), np.uint64)


def horner(coefficients: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monic polynomials (low coefficients first, leading 1 left out) at the rows of ``at``."""
    v = np.ones_like(at)
    for j in range(coefficients.shape[1] - 1, -1, -1):
        v = add(mul(v, at), coefficients[:, j][:, None])
    return v


def powers(points: np.ndarray, k: int) -> np.ndarray:
    out = [np.ones_like(points)]
    for _ in range(k):
        out.append(mul(out[-1], points))
    return np.stack(out[:-1], axis=1) if k else np.zeros((len(points), 0), np.uint64)


def points(bound: int) -> np.ndarray:
    """Where polynomials are evaluated under a bound: as many points, and ``CHECKS`` more."""
    return np.uint64(ELEMENTS) + np.arange(bound + CHECKS, dtype=np.uint64)


def interpolate(na: np.ndarray, nb: np.ndarray, fa: np.ndarray, fb: np.ndarray, bound: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """From sketches of two sides' buckets the polynomials of the elements of one side only.

    ``na``, ``nb``: numbers of elements; ``fa``, ``fb``: evaluations at ``points(bound)``, by bucket.
    Gives per bucket the coefficients of both monic polynomials, low ones first and the leading 1 left out, or null
    where the differences are more than the bound allows: the further points do not confirm any.
    """
    z = points(bound)
    ratio = mul(fa, inverse(fb))
    delta = na - nb
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(na)
    open_ = np.ones(len(na), bool)
    for t in range(bound + 1):
        for s in np.unique(delta[open_]):
            if abs(s) > t or (t - s) % 2:
                continue
            k = np.flatnonzero(open_ & (delta == s))
            da, db = (t + s) // 2, (t - s) // 2
            f = ratio[k]
            x = np.zeros((len(k), 0), np.uint64)
            if t:
                za, zb = powers(z[:t], da + 1), powers(z[:t], db + 1)
                left = np.broadcast_to(za[:, :da], (len(k), t, da))
                system = np.concatenate([left, sub(np.zeros((), np.uint64), mul(f[:, :t, None], zb[None, :, :db]))], axis=2) if db else left
                x = solve(np.ascontiguousarray(system), sub(mul(f[:, :t], zb[None, :, db]), np.broadcast_to(za[:, da], (len(k), t))))
            # The function must hold at every point, the unused ones too.
            at = np.broadcast_to(z, (len(k), len(z)))
            good = (horner(x[:, :da], at) == mul(f, horner(x[:, da:], at))).all(1)
            for i in np.flatnonzero(good):
                out[k[i]] = x[i, :da], x[i, da:]
            open_[k[good]] = False
    return out


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    present = np.arange(width)[None, :] < lengths[:, None]
    out = np.zeros((len(lengths), width), np.uint64)
    out[present] = column.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
    return out, present


def _sketches(bound: int):
    z = points(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), BATCH):
                batch = whole.slice(start, BATCH)
                x, present = _matrix(batch.column(2))
                f = evaluate(x, present, z).astype(np.int64)
                rows = pa.ListArray.from_arrays(np.arange(0, f.size + 1, len(z), dtype=np.int32), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(present.sum(1).astype(np.int32)), rows], names=["side", "bucket", "n", "f"])

    return run


def _interpolated(bound: int):
    width = len(points(bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), BATCH):
                batch = whole.slice(start, BATCH)
                na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 3))
                fa, fb = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(-1, width) for i in (2, 4))
                got = interpolate(na, nb, fa, fb, bound)
                for side in (0, 1):
                    some = [None if g is None else g[side].astype(np.int64).tolist() for g in got]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), side, np.int8)), batch.column(0), pa.array(some, pa.list_(pa.int64()))], names=["side", "bucket", "c"])

    return run


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of a bucket at which its polynomial is zero."""
    for whole in batches:
        for start in range(0, len(whole), BATCH):
            batch = whole.slice(start, BATCH)
            x, present = _matrix(batch.column(1))
            c, known = _matrix(batch.column(2))
            degree = known.sum(1)
            for d in np.unique(degree[degree > 0]):
                k = np.flatnonzero(degree == d)
                hit = present[k] & (horner(c[k][:, :d], x[k]) == 0)
                h = x[k][hit].astype(np.int64)
                side = np.repeat(batch.column(0).to_numpy(zero_copy_only=False)[k], hit.sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(side.astype(np.int8)), pa.array(h)], names=["side", "h"])


def row_hash(columns: Sequence[str]) -> Column:
    """An element of the field for the row; a null field differs from every value."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return F.pmod(F.xxhash64(*parts), F.lit(ELEMENTS))


def reconcile_hashes(left: DataFrame, right: DataFrame, rows: int) -> DataFrame:
    """Hashes (column ``h`` of each side) of rows on one side only: ``side`` 0 or 1, ``h``."""
    buckets, bound, depth = max(1, rows // BUCKET_ROWS), FIRST_BOUND, 0
    # The low bits of h are the element; the bucket takes an independent hash of it.
    tagged = left.select(F.lit(0).cast("tinyint").alias("side"), "h").unionAll(right.select(F.lit(1).cast("tinyint").alias("side"), "h"))
    sets = cut(tagged.groupBy("side", F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")).agg(F.collect_set("h").alias("x")))
    found, written = None, [sets]
    while True:
        sketch = sets.mapInArrow(_sketches(bound), "side tinyint, bucket bigint, n int, f array<bigint>")
        # A side without elements in a bucket has the empty product there.
        of = [F.max(F.when(F.col("side") == i, F.struct("n", "f"))).alias(c) for i, c in ((0, "a"), (1, "b"))]
        none = F.struct(F.lit(0).alias("n"), F.array_repeat(F.lit(1).cast("bigint"), len(points(bound))).alias("f"))
        both = sketch.groupBy("bucket").agg(*of).select("bucket", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b")).where(F.col("a") != F.col("b"))
        solved = cut(both.select("bucket", F.col("a.n").alias("na"), F.col("a.f").alias("fa"), F.col("b.n").alias("nb"), F.col("b.f").alias("fb")).mapInArrow(_interpolated(bound), "side tinyint, bucket bigint, c array<bigint>"))
        some = solved.where(F.size("c") > 0)
        roots = sets.join(small_side(some), ["side", "bucket"]).select("side", "x", "c").mapInArrow(_roots, "side tinyint, h bigint")
        found = roots if found is None else found.unionAll(roots)
        left_ = solved.where(F.col("c").isNull()).select("bucket").distinct()
        written.append(solved)
        if left_.isEmpty():
            out = cut(found)
            drop(*written)
            return out
        rest = sets.join(small_side(left_), "bucket", "left_semi").select("side", "bucket", "x")
        if bound < LAST_BOUND:
            bound *= 2
        else:
            # Other bits of the same hash cut the bucket further.
            bound, depth = FIRST_BOUND, depth + 1
            part = F.pmod(F.xxhash64("h", F.lit(depth)), F.lit(SPLIT))
            rest = rest.select("side", "bucket", F.explode("x").alias("h")).groupBy("side", (F.col("bucket") * SPLIT + part).alias("bucket")).agg(F.collect_set("h").alias("x"))
        sets = cut(rest)
        written.append(sets)


def differences(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], names: tuple[str, str] = ("only_left", "only_right")) -> DataFrame:
    """One row (key, diff) per difference: ``names`` for rows of one side, else the field's name."""
    every = [key, *fields]
    left, right = left.select(*every), right.select(*every)
    rows = max(left.count(), right.count())  # from Parquet's footers
    keyed = [d.where(F.col(key).isNotNull()).withColumn("h", row_hash(every)) for d in (left, right)]
    found = reconcile_hashes(keyed[0].select("h"), keyed[1].select("h"), rows)
    both = keyed[0].withColumn("side", F.lit(0).cast("tinyint")).unionAll(keyed[1].withColumn("side", F.lit(1).cast("tinyint")))
    keys = both.select(key, "side", "h").join(small_side(found), ["side", "h"], "left_semi").select(key)
    # Equal sets of several versions have no hash on one side only; one side's counts find them.
    k = F.xxhash64(key).alias("k")
    several = cut(keyed[0].select(k, "h").groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("k"))
    if not several.isEmpty():
        keys = keys.unionAll(left.select(key, k).join(small_side(several), "k", "left_semi").select(key))
    keys = cut(keys.distinct())
    drop(found, several)
    # All versions of a differing key, those equal on both sides too.
    versions = cut(both.join(small_side(keys), key, "left_semi").select("side", *every).distinct())
    version = F.struct(*fields)
    x, y = (versions.where(F.col("side") == i).select(key, version.alias(v)) for i, v in ((0, "x"), (1, "y")))
    # Rows without key stand for a row with equal fields on the other side.
    keyless = left.where(F.col(key).isNull()).select(F.lit(0).alias("side"), version.alias("v")).unionAll(right.where(F.col(key).isNull()).select(F.lit(1).alias("side"), version.alias("v"))).distinct()
    lone = x.join(y.select(key).distinct(), key, "left_anti").select(key, F.lit(1).alias("lone"), F.col("x").alias("v")).unionAll(y.join(x.select(key).distinct(), key, "left_anti").select(key, F.lit(0).alias("lone"), F.col("y").alias("v")))
    unmatched = lone.join(keyless, (lone["lone"] == keyless["side"]) & lone["v"].eqNullSafe(keyless["v"]), "left_anti")
    changed = [F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), F.lit(c)) for c in fields]
    fields_ = x.join(y, key).select(key, F.explode(F.array_compact(F.array(*changed))).alias("diff"))
    return unmatched.select(key, F.when(F.col("lone") == 1, F.lit(names[0])).otherwise(F.lit(names[1])).alias("diff")).unionAll(fields_)
