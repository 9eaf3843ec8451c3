"""Column expressions on vectors: normalisation, padding, relative actions, discretisation."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def mean_std(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / (std + F.lit(EPS))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """2 (x - low) / (high - low) - 1; with the 1 % and 99 % quantiles it is the quantile mode, which doesn't clip."""
    return F.lit(2.0) * (x - low) / (high - low + F.lit(EPS)) - F.lit(1.0)


def quantile_clipped(x: Column, low: Column, high: Column, eps: float = 1e-6, bound: float = 50.0) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), F.lit(2.0) * (x - low) / (high - low + F.lit(eps)) - F.lit(1.0)))


def undo_mean_std(y: Column, mean: Column, std: Column) -> Column:
    return y * std + mean


def undo_min_max(y: Column, low: Column, high: Column) -> Column:
    return (y + F.lit(1.0)) / F.lit(2.0) * (high - low) + low


MODES = {"MEAN_STD": (mean_std, undo_mean_std, "mean", "std"), "MIN_MAX": (min_max, undo_min_max, "min", "max"), "QUANTILE": (min_max, undo_min_max, "q01", "q99")}


def state_bin(s: Column, bins: int = 1000) -> Column:
    """(s + 1) / 2 * bins cut toward zero, from -1 to bins."""
    return F.greatest(F.lit(-1), F.least(F.lit(bins), ((s + F.lit(1.0)) / F.lit(2.0) * F.lit(float(bins))).cast("int")))


def pad(v: Column, size: int) -> Column:
    """v with zeros up to size; wider vectors raise."""
    return F.when(F.size(v) <= size, F.concat(v, F.array_repeat(F.lit(0.0).cast("double"), F.lit(size) - F.size(v)))).otherwise(F.raise_error(F.lit("vector is wider than its target")))


def pad_mask(v: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i < F.size(v)).cast("int"))


def relative(action: Column, state: Column, mask: list[bool], sign: int = -1) -> Column:
    """action with state subtracted (or added back, sign 1) where mask says so; dims past the mask or the state stay."""
    m = F.array(*[F.lit(x) for x in mask])
    return F.transform(action, lambda a, d: a + F.when(F.coalesce(F.get(m, d), F.lit(False)), F.coalesce(F.get(state, d), F.lit(0.0)) * F.lit(float(sign))).otherwise(F.lit(0.0)))


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def dct(x: Column, size: int, scale: float = 10.0) -> Column:
    """Orthonormal DCT-II of a vector of given size, times scale, rounded half to even: an array of ints."""
    rows = [[math.sqrt((1 if k == 0 else 2) / size) * math.cos(math.pi * (2 * n + 1) * k / (2 * size)) for n in range(size)] for k in range(size)]
    return F.array(*[F.rint(sum((F.get(x, F.lit(n)) * F.lit(c) for n, c in enumerate(row)), F.lit(0.0)) * F.lit(scale)).cast("int") for row in rows])


def inverse_dct(q: Column, size: int, scale: float = 10.0) -> Column:
    rows = [[math.sqrt((1 if k == 0 else 2) / size) * math.cos(math.pi * (2 * n + 1) * k / (2 * size)) for k in range(size)] for n in range(size)]
    return F.array(*[sum((F.get(q, F.lit(k)) * F.lit(c) for k, c in enumerate(row)), F.lit(0.0)) / F.lit(scale) for row in rows])


def axis_angle(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Of a unit quaternion; zeros where it doesn't turn."""
    w = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w))
    den = F.sqrt(F.lit(1.0) - w * w)
    return [F.when(den == 0, F.lit(0.0)).otherwise(c * F.lit(2.0) * F.acos(w) / den) for c in (x, y, z)]


def sinusoid(t: Column, size: int, low: float = 4e-3, high: float = 4.0) -> Column:
    """Sines, then cosines, of t over size/2 log-spaced periods."""
    half = size // 2
    angles = [t * F.lit(2 * math.pi / (low * (high / low) ** (i / max(half - 1, 1)))) for i in range(half)]
    return F.array(*[F.sin(a) for a in angles], *[F.cos(a) for a in angles])


def normalise(mode: str, x: Column, stats: dict[str, Column], undo: bool = False) -> Column:
    """By mode (MEAN_STD, MIN_MAX, QUANTILE, IDENTITY); statistics that are null or infinite raise."""
    if mode == "IDENTITY":
        return x
    forward, back, a, b = MODES[mode]
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    missing = F.raise_error(F.lit(f"no statistics for {mode}")).cast("double")
    return F.when(finite(stats[a]) & finite(stats[b]), (back if undo else forward)(x, stats[a], stats[b])).otherwise(missing)


def mode_of(role: str, action_mode: str = "MEAN_STD") -> str:
    """States are always normalised by quantiles, actions by their mode, all else not at all."""
    return {"STATE": "QUANTILE", "ACTION": action_mode}.get(role, "IDENTITY")


def concat_vectors(*vectors: Column) -> Column:
    """Vectors one after the other, in the order of their keys."""
    return F.concat(*vectors)


def relative_keys(actions: dict[str, tuple[Column, int]], states: list[Column], mask: list[bool], sign: int = -1) -> dict[str, Column]:
    """relative over several keys (each with its size): each takes the next slice of the mask and of the joined states; those past
    the mask stay, and without states all do."""
    if not states:
        return {k: v for k, (v, _) in actions.items()}
    joined, at, out = F.concat(*states), 0, {}
    for key, (v, size) in actions.items():
        part = mask[at : at + size]
        out[key] = relative(v, F.slice(joined, at + 1, size), part, sign) if len(part) == size else v
        at += size
    return out


def coefficient_span(df: DataFrame, q: str) -> tuple[int, int]:
    """The least and the largest coefficient of a table's arrays; (0, 0) without any."""
    r = df.agg(F.min(F.array_min(q)), F.max(F.array_max(q))).first()
    return r[0] or 0, r[1] or 0


def alphabet_size(least: int, most: int, vocabulary: int = 1024) -> int:
    """How many letters stand for the coefficients from least to most.

    Raises if their range is wider than the vocabulary that is to begin with them; warns if it leaves less than 100 entries."""
    if most - least > vocabulary:
        raise ValueError(f"a vocabulary of {vocabulary} is too small for coefficients over a range of {most - least}")
    if most - least + 100 > vocabulary:
        warnings.warn(f"coefficients over a range of {most - least} nearly fill a vocabulary of {vocabulary}", stacklevel=2)
    return most - least + 1


def coefficient_text(q: Column, least: int) -> Column:
    """Coefficients as characters: each less the least one (0 at least) is a code point."""
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")
    return F.array_join(F.transform(q, lambda x: letter(F.greatest(x - F.lit(least), F.lit(0)).cast("long"))), "")


def text_coefficients(text: Column, size: int, least: int) -> Column:
    """The coefficients of coefficient_text; zeros where the text isn't size characters long."""
    letters = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.ascii(F.substring(text, i, F.lit(1))) + F.lit(least))
    return F.when(F.char_length(text) == size, letters).otherwise(F.array_repeat(F.lit(0), size))


def wave(t: Column, size: int, base: float = 10000.0) -> Column:
    """Sines, then cosines, of t times size/2 frequencies that fall from 1 towards 1/base."""
    half = size // 2
    angles = [t * F.lit(math.exp(-i * math.log(base) / half)) for i in range(half)]
    return F.array(*[F.sin(a) for a in angles], *[F.cos(a) for a in angles])


def noisy(action: Column, noise: Column, t: Column) -> Column:
    """The point between noise (t 0) and action (t 1)."""
    return (F.lit(1.0) - t) * noise + t * action


def velocity(action: Column, noise: Column) -> Column:
    return action - noise


def flow_time(sample: Column, most: float = 0.999) -> Column:
    """Time from a sample of the unit interval, which is cut at most."""
    return (F.lit(most) - F.least(sample, F.lit(most))) / F.lit(most)


def euler(start: Column, speed, steps: int) -> Column:
    """start moved on by speed(x, t) in equal steps from time 0 to 1."""
    x = start
    for k in range(steps):
        x = x + speed(x, k / steps) * F.lit(1.0 / steps)
    return x
