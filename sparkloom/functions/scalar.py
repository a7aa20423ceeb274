"""Scalar functions as Spark columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dimensions import ALGORITHMS

#: Decibels that stand for a perfect match, and other sentinels of exchanged files.
LOSSLESS_PSNR, MASKED_COST = 120.0, 99999.0
#: Smallest magnitude of a measured value that a percentage error is taken of.
TINY = 1e-6


# -- configuration ids ------------------------------------------------------------------------


def action_algo(action: Column) -> Column:
    return F.pmod(action, F.lit(8)).cast("int")


def action_quant(action: Column) -> Column:
    return F.pmod(F.floor(action / 8), F.lit(2)).cast("int")


def action_shuffle(action: Column) -> Column:
    return F.pmod(F.floor(action / 16), F.lit(2)).cast("int")


def action_name(action: Column) -> Column:
    """Name of a 32-space action; ``none`` for a negative one."""
    algo = F.element_at(F.array(*[F.lit(n) for n in ALGORITHMS[1:]]), action_algo(action) + 1)
    name = F.concat(algo, F.when(action_shuffle(action) == 1, "+shuf").otherwise(""), F.when(action_quant(action) == 1, "+quant").otherwise(""))
    return F.when(action < 0, "none").otherwise(name)


def action_index(name: Column) -> Column:
    """32-space action of a name in any case and order of suffixes, or of digits; -1 if unknown."""
    parts = F.split(F.lower(F.trim(name)), r"\+")
    algo = F.array_position(F.array(*[F.lit(n) for n in ALGORITHMS[1:]]), parts[0]).cast("int")
    known = F.size(F.array_except(F.slice(parts, 2, 8), F.array(F.lit("shuf"), F.lit("quant")))) == 0
    coded = algo - 1 + 8 * F.array_contains(parts, "quant").cast("int") + 16 * F.array_contains(parts, "shuf").cast("int")
    number = F.trim(name).try_cast("int")
    return F.when(number.between(0, 31), number).when((algo > 0) & known, coded).otherwise(F.lit(-1))


def to_nn_index(action64: Column, bounds: Column) -> Column:
    """32-space action of a 64-space id and its error bound."""
    return (F.floor(action64 / 8) + 8 * (bounds > 0).cast("int") + 16 * F.pmod(F.floor(action64 / 4), F.lit(2))).cast("int")


def algorithm_id(name: Column, unknown: str = "lz4") -> Column:
    """Id by name in any case; an unknown one is ``unknown``'s id, or an error for ``unknown="raise"``."""
    at = F.array_position(F.array(*[F.lit(n) for n in ALGORITHMS]), F.lower(name))
    other = F.raise_error(F.concat(F.lit("unknown algorithm "), name)).cast("int") if unknown == "raise" else F.lit(ALGORITHMS.index(unknown))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(other)


# -- quantisation -----------------------------------------------------------------------------


def effective_bound(bound: Column, low: Column, high: Column) -> Column:
    """The bound that quantisation works with, so that float rounding keeps the promised one."""
    # fixed values: share of the largest magnitude that a float loses, safety share, finest step
    rounding = 2.4e-7 * F.greatest(F.abs(low), F.abs(high))
    span = high - low
    finest = span / 4e9
    left = bound - rounding - 0.05 * bound
    usable = F.when(left > 0, left).otherwise(F.greatest(finest, 0.1 * rounding))
    return F.when(span <= 0, F.lit(1.0)).otherwise(F.greatest(usable, finest))


def precision_bits(low: Column, high: Column, bound: Column) -> Column:
    """8, 16 or 32 bits for the number of steps a range needs."""
    bins = (high - low) / (2 * bound) * 1.1
    return F.when(bins <= 127, 8).when(bins <= 32767, 16).otherwise(32)


def precision_bytes(bits: Column) -> Column:
    return (bits / 8).cast("int")


def quantize(x: Column, low: Column, scale: Column, bits: Column) -> Column:
    """``round((x - low) * scale)``, halves away from zero, clamped to the signed range of ``bits``."""
    top = F.when(bits == 8, 127).when(bits == 16, 32767).otherwise(2147483647)
    return F.greatest(-top - 1, F.least(top, F.round((x - low) * scale))).cast("long")


def dequantize(q: Column, low: Column, inverse_scale: Column) -> Column:
    return (q * inverse_scale + low).cast("float")


# -- model inputs and outputs -----------------------------------------------------------------


def standard(x: Column, mean: Column, deviation: Column, floor: float = 1e-8) -> Column:
    return (x - mean) / F.greatest(deviation, F.lit(floor))


def log_time(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(1.0)))


def log_positive(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def psnr_target(x: Column) -> Column:
    """Clamped to 0..120; missing, NaN or infinite is lossless."""
    return F.when(x.isNull() | F.isnan(x), F.lit(LOSSLESS_PSNR)).otherwise(F.greatest(F.lit(0.0), F.least(x, F.lit(LOSSLESS_PSNR))))


def ssim_target(x: Column) -> Column:
    return -F.log(1 - x + 1e-7)


def ssim_from_target(y: Column) -> Column:
    return 1 - F.exp(-F.greatest(F.lit(0.0), y))


def clamp_prediction(ct: Column, dt: Column, ratio: Column, psnr: Column) -> list[Column]:
    """Predictions within the limits of the network's outputs."""
    # fixed values: limits of times (ms), ratio and PSNR (dB)
    return [F.greatest(F.lit(1e-6), F.least(ct, F.lit(1e6))), F.greatest(F.lit(1e-6), F.least(dt, F.lit(1e6))), F.greatest(F.lit(0.1), F.least(ratio, F.lit(1e5))), F.greatest(F.lit(0.0), F.least(psnr, F.lit(120.0)))]


# -- cost and error ---------------------------------------------------------------------------


def cost(ct: Column, dt: Column, ratio: Column, n_bytes: Column, w0, w1, w2, bandwidth: float = 5e6, time_floor_ms: float = 1.0, ratio_cap: float = 100.0, no_ratio: float = 1e30) -> Column:
    """Linear cost in ms: weighted times and the time to store the bytes at ``bandwidth`` bytes per ms."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    stored = n_bytes / (F.least(ratio, F.lit(ratio_cap)) * bandwidth)
    total = lit(w0) * F.greatest(ct, F.lit(time_floor_ms)) + lit(w1) * F.greatest(dt, F.lit(time_floor_ms)) + lit(w2) * stored
    return F.when(ratio <= 0, F.lit(no_ratio)).otherwise(total)


def bandwidth_bytes_per_ms(gb_per_s: Column) -> Column:
    return gb_per_s * 1e6


def analytical_psnr(span: Column, bound: Column) -> Column:
    """PSNR of uniform quantisation error, 120 at most; null where it is undefined."""
    return F.when((span > 0) & (bound > 0), F.least(10 * F.log10(span * span / (bound * bound / 3)), F.lit(LOSSLESS_PSNR)))


def fraction_error(predicted: Column, real: Column) -> Column:
    """``|p - r| / r`` as a fraction, 0 where ``r`` is too small."""
    return F.when(real > TINY, F.abs(predicted - real) / real).otherwise(F.lit(0.0))


def explore_mode(error_frac: Column, x1: float = 0.30, x2: float = 0.50) -> Column:
    """0: none, 1: learn from the primary, 2: explore alternatives as well."""
    return F.when(error_frac > x2, 2).when(error_frac > x1, 1).otherwise(0)


def max_compressed_size(n: Column) -> Column:
    """Room that a codec and header may need; 0 where it would overflow."""
    return F.coalesce(F.try_add(n, F.floor(n / 8).cast("long") + 1024 + 64), F.lit(0).cast("long"))


def heuristic_algorithm(entropy: Column) -> Column:
    """Algorithm by byte entropy alone."""
    # fixed values: limits in bits
    return F.when(entropy < 3.5, "zstd").when(entropy < 5.5, "gdeflate").otherwise("lz4")


def log_grid(low: float, high: float, n: int) -> list[float]:
    """``n`` values from ``low`` to ``high``, evenly spaced in the logarithm."""
    return [low * (high / low) ** (i / (n - 1)) for i in range(n)] if n > 1 else [low]


# -- bits -------------------------------------------------------------------------------------


def float_word(x: Column) -> Column:
    """The 32 bits of a float as an int, in the JVM."""
    return F.reflect(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x.cast("float")).cast("int")


def word_bytes(word: Column) -> Column:
    """The four bytes of an int, lowest first."""
    return F.array(*[F.shiftrightunsigned(word, s).bitwiseAND(255) for s in (0, 8, 16, 24)])


# -- 64-byte header ---------------------------------------------------------------------------


def quant_flags(kind: Column, precision_code: Column, enabled: Column, algo_id: Column) -> Column:
    """Bits 0-3 kind, 4-7 precision, 8 enabled, 9-12 algorithm."""
    return kind.bitwiseOR(F.shiftleft(precision_code, 4)).bitwiseOR(F.shiftleft(enabled.cast("int"), 8)).bitwiseOR(F.shiftleft(algo_id, 9))


def unpack_quant_flags(flags: Column) -> dict[str, Column]:
    return {"kind": flags.bitwiseAND(15), "precision_code": F.shiftright(flags, 4).bitwiseAND(15), "enabled": F.shiftright(flags, 8).bitwiseAND(1), "algo_id": F.shiftright(flags, 9).bitwiseAND(15)}


def double_halves(x: Column) -> tuple[Column, Column]:
    """The low and high 32 bits of a double, as filter parameters carry it."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x).cast("long")
    return bits.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(bits, 32)


def double_of_halves(low: Column, high: Column) -> Column:
    """The double of :func:`double_halves`."""
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), F.shiftleft(high, 32).bitwiseOR(low)).cast("double")


def whole_floats(n_bytes: Column) -> Column:
    """Whether a size is positive and a whole number of floats."""
    return (n_bytes > 0) & (n_bytes % 4 == 0)
