"""Vector arithmetic on array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def let(value: Column, fn) -> Column:
    """Evaluate a value once and hand it to `fn`; lambdas would redo it per element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, and 0 for empty, zero or unequal vectors."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def normalise(a: Column) -> Column:
    def scale(v: Column) -> Column:
        size = F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
        return let(size, lambda s: F.transform(v, lambda x: x.cast("double") / s))
    return let(a, scale)


def unit_project(a: Column, dim: int) -> Column:
    """Cut or zero-pad to `dim`, then scale to length 1."""
    padded = F.concat(F.transform(a, lambda x: x.cast("double")),
                      F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(a), F.lit(0))))
    return normalise(F.slice(padded, 1, dim))


def hash_embed(text: Column, dim: int) -> Column:
    """Deterministic text vector from counter-mode sha256 blocks, 32 values each."""
    return let(F.sha2(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 256), lambda seed: _from_seed(seed, dim))


def _from_seed(seed: Column, dim: int) -> Column:
    counters = F.lit([i.to_bytes(4, "little").hex() for i in range(math.ceil(dim / 32))])
    # a block as Latin-1 text: one character per byte, so a byte is one `ascii` call
    block = lambda c: F.decode(F.unhex(F.sha2(F.unhex(F.concat(seed, c)), 256)), "ISO-8859-1")
    spread = lambda text: F.transform(
        F.lit(list(range(1, 33))), lambda i: F.ascii(F.substr(text, i, F.lit(1))) / 255.0 * 2.0 - 1.0)
    values = F.flatten(F.transform(counters, lambda c: let(block(c), spread)))
    return normalise(F.slice(values, 1, dim))


def emo_project(scalars: list[Column], dim: int) -> Column:
    """Fixed sine projection of affect scalars onto `dim` values."""
    matrix = [[math.sin((j + 1) * (i + 1) * 0.17) for i in range(len(scalars))] for j in range(dim)]

    def cell(row: Column) -> Column:
        total = row[0] * scalars[0]
        for i, s in enumerate(scalars[1:], 1):
            total = total + row[i] * s
        return total
    return normalise(F.transform(F.lit(matrix), cell))


def emo_query(valence: Column, arousal: Column, dim: int) -> Column:
    return normalise(F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda j: F.sin((j + 1) * 0.11) * valence + F.cos((j + 1) * 0.13) * arousal))
