"""Deterministic draws.

The random choices of resampling (folds, halves, permutations, bootstrap draws) are a
function of (row id, replicate, seed) only, so they do not depend on partitioning, survive
a lost executor, and can be recomputed by any engine with 64-bit integers.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from signalops.functions.nulls import col

# Fixed values of the generator: a Mersenne prime modulus and three multipliers.
MODULUS = 2147483647
ID_STEP, REP_STEP, SEED_STEP = 48271, 69621, 16807


def draw(row_id: str | Column, rep: int | Column = 0, seed: int = 42) -> Column:
    """Integer in [0, MODULUS): linear mix, then two squaring rounds to break linearity."""
    i = F.pmod(col(row_id).cast("bigint"), F.lit(MODULUS))
    r = F.lit(rep).cast("bigint") if isinstance(rep, int) else rep.cast("bigint")
    h0 = (i * ID_STEP + r * REP_STEP + F.lit(seed * SEED_STEP)) % MODULUS
    h1 = (h0 * h0 + i) % MODULUS
    return (h1 * h1 + h0) % MODULUS


def unit(row_id: str | Column, rep: int | Column = 0, seed: int = 42) -> Column:
    """Uniform value in [0, 1)."""
    return draw(row_id, rep, seed) / float(MODULUS)
