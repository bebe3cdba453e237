"""Scalar functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = float("-inf")  # the time of a row that has none: visible at any seed time


def number_or_zero(c: Column) -> Column:
    """Text as a number; blanks and junk give 0."""
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))


def parse_time(c: Column) -> Column:
    """Seconds since 1970 from a number or a date; the time of day is left out, blanks and junk give -inf."""
    text = F.trim(c)
    number = text.try_cast("double")
    date = F.substring(text, 1, 10).try_cast("date")
    return F.coalesce(number, F.unix_date(date) * F.lit(86400.0), F.lit(NEVER))


def seconds(c: Column) -> Column:
    """Seconds since 1970 of a date or timestamp (UTC session)."""
    return F.unix_timestamp(c.cast("timestamp")).cast("double")


def cyclic_time(t: Column, t_max: Column) -> dict[str, Column]:
    """The relative time and its sine and cosine over the whole span, a quarter and a twelfth of it."""
    safe = F.when((F.abs(t) < F.lit(float("inf"))) & ~F.isnan(t), t).otherwise(F.lit(0.0))
    out = {"t_rel": safe / t_max}
    for name, part in (("full", 1), ("quarter", 4), ("twelfth", 12)):
        angle = F.lit(2 * math.pi) * safe / (t_max / part)
        out |= {f"sin_{name}": F.sin(angle), f"cos_{name}": F.cos(angle)}
    return out


def sinusoidal(position: Column, dim: int) -> Column:
    """The standard sinusoidal encoding of a position, an array of ``dim`` doubles."""
    angle = lambda i: position / F.pow(F.lit(10000.0), F.lit((i // 2) * 2 / dim))
    return F.array(*[F.sin(angle(i)) if i % 2 == 0 else F.cos(angle(i)) for i in range(dim)])


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bce_with_logits(logit: Column, label: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def activation(name: str, x: Column) -> Column:
    """relu, gelu, tanh, sigmoid, leakyrelu or swish, by name."""
    known = {
        "relu": lambda: F.greatest(x, F.lit(0.0)),
        "gelu": lambda: x * 0.5 * (F.lit(1.0) + F.tanh(F.lit(math.sqrt(2 / math.pi)) * (x + F.lit(0.044715) * x * x * x))),
        "tanh": lambda: F.tanh(x),
        "sigmoid": lambda: sigmoid(x),
        "leakyrelu": lambda: leaky_relu(x, 0.01),
        "swish": lambda: x * sigmoid(x),
    }
    return known[name.lower().replace("-", "").replace("_", "")]()


def l2_normalised(v: Column) -> Column:
    """A vector scaled to length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def temporal_decay(age_seconds: Column, decay_days: float) -> Column:
    return F.exp(-age_seconds / F.lit(86400.0 * decay_days))


def quantised(x: Column, low: Column, high: Column, bits: int) -> Column:
    """Whole steps of a range cut into 2^bits; the top of the range is the last step, an empty range 0."""
    steps = float(2**bits)
    return F.when(high > low, F.least(F.floor((x - low) * steps / (high - low)), F.lit(2**bits - 1))).otherwise(F.lit(0)).cast("int")


def dequantised(q: Column, low: Column, high: Column, bits: int) -> Column:
    return low + q * (high - low) / float(2**bits)


def learning_rate(step: int, base: float, kind: str = "constant", total: int = 1, warmup: int = 0, gamma: float = 0.1, every: int = 10) -> float:
    """Constant, cosine, warm-up cosine, step or exponential schedule."""
    if kind == "constant":
        return base
    if kind == "step":
        return base * gamma ** (step // every)
    if kind == "exponential":
        return base * gamma**step
    if kind in ("cosine", "warmup_cosine"):
        if kind == "warmup_cosine" and step < warmup:
            return base * (step + 1) / warmup
        first = warmup if kind == "warmup_cosine" else 0
        return base * 0.5 * (1 + math.cos(math.pi * min(1.0, (step - first) / max(1, total - first))))
    raise ValueError(f"unknown schedule: {kind}")


def learning_rates(step: Column, base: float, kind: str, total: Column | int = 1, warmup: int = 0, gamma: float = 0.1, every: int = 10) -> Column:
    """The same schedules for a column of steps."""
    rate = F.lit(float(base))
    if kind == "step":
        return rate * F.pow(F.lit(float(gamma)), F.floor(step / every))
    if kind == "exponential":
        return rate * F.pow(F.lit(float(gamma)), step)
    if kind in ("cosine", "warmup_cosine"):
        first = warmup if kind == "warmup_cosine" else 0
        last = (total if isinstance(total, Column) else F.lit(total)) - first
        fall = rate * 0.5 * (1 + F.cos(F.lit(math.pi) * F.least(F.lit(1.0), (step - first) / F.greatest(F.lit(1), last))))
        return F.when(step < first, rate * (step + 1) / max(1, warmup)).otherwise(fall)
    if kind == "constant":
        return rate
    raise ValueError(f"unknown schedule: {kind}")


def sinusoidal_pairwise(position: Column, dim: int) -> Column:
    """The variant whose exponent is 2i/d for every place i, sine and cosine by turns."""
    angle = lambda i: position / F.pow(F.lit(10000.0), F.lit(2 * i / dim))
    return F.array(*[F.sin(angle(i)) if i % 2 == 0 else F.cos(angle(i)) for i in range(dim)])


def date_parts(t: Column) -> dict[str, Column]:
    """Day of the month, month, year and hour, as indices of embeddings."""
    return {"day": F.dayofmonth(t), "month": F.month(t), "year": F.year(t), "hour": F.hour(t)}


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def norm_clipped(v: Column, most: float) -> Column:
    """A vector scaled down to a norm of ``most`` if it is longer."""
    norm = l2_norm(v)
    return F.when(norm > most, F.transform(v, lambda x: x * (F.lit(most) / norm))).otherwise(v)


def compression_ratio(raw_bytes: Column, packed_bytes: Column) -> Column:
    """Raw over packed size; 1 where nothing was packed."""
    return F.when(packed_bytes > 0, raw_bytes / packed_bytes).otherwise(F.lit(1.0))


def database_name(url: Column) -> Column:
    """The last part of a connection URL's path, without its options."""
    return F.regexp_extract(url, r"/([^/?]*)(?:\?.*)?$", 1)


def attribute(document: Column, key: str) -> Column:
    """A number in a JSON object by its key; 0 if it is missing or no number."""
    return F.coalesce(F.get_json_object(document, f"$.{key}").try_cast("double"), F.lit(0.0))
