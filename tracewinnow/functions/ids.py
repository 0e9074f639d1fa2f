"""Hashes and fields of trace and span ids, as Spark columns over lower-case hex strings, and as Python functions."""

from __future__ import annotations

import math
from collections.abc import Iterable
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: FNV-1a parameters and the seeds put before an id.  Fixed values.
FNV64_START, FNV64_PRIME = 0xCBF29CE484222325, 0x100000001B3
FNV32_START, FNV32_PRIME = 0x811C9DC5, 0x01000193
DEFAULT_SALT, SHARD_SEED = "default-hash-seed", b"s33d"
M32, M64 = (1 << 32) - 1, (1 << 64) - 1
FLIP = -(1 << 63)
MAX_RV = (1 << 56) - 1


def fnv64(data: bytes, state: int = FNV64_START) -> int:
    for b in data:
        state = (state ^ b) * FNV64_PRIME & M64
    return state


@lru_cache(maxsize=4096)
def hash64(salt: str, trace_id: str) -> int:
    """The hash of salt and trace id; a trace's units, and policies with one salt, share it."""
    return fnv64((salt or DEFAULT_SALT).encode() + bytes.fromhex(trace_id))


def fnv32(data: bytes, state: int = FNV32_START) -> int:
    for b in data:
        state = (state ^ b) * FNV32_PRIME & M32
    return state


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark holds it."""
    return x - (1 << 64) if x >> 63 else x


def halves(trace_id: Column) -> tuple[Column, Column]:
    """The two 64-bit halves of a trace id."""
    part = lambda a: F.conv(F.substring(trace_id, a, 16), 16, -10).cast("long")
    return part(1), part(17)


def id_bytes(trace_id: Column) -> Column:
    """The 16 bytes of a trace id, each as a long."""
    high, low = halves(trace_id)
    return F.array(*[F.shiftrightunsigned(h, s).bitwiseAND(F.lit(255).cast("long")) for h in (high, low) for s in range(56, -8, -8)])


def hash_column(salt: str = "") -> str:
    """The name of the column that :func:`with_hash64` adds for a salt."""
    return f"_hash_{fnv64((salt or DEFAULT_SALT).encode()):016x}"


def with_hash64(df: DataFrame, salts: Iterable[str] = ("",), trace_id: str = "trace_id") -> DataFrame:
    """Adds the unsigned FNV-1a 64 of salt and id, held in a signed long, for each salt.

    The salt is folded on the driver.  The prime is 2**40 + 0x1b3, so a step is
    done on two halves of 32 bits without overflow.  Two bytes are a projection
    of their own: the optimizer leaves these apart, since each value is used
    more than once, and they stay within one generated loop, which computes what
    recurs in a projection once.
    """
    names = {hash_column(s): fnv64((s or DEFAULT_SALT).encode()) for s in salts}
    if not names:
        return df
    quoted = ", ".join(f"`{c}`" for c in df.columns)
    rows = f"SELECT {quoted}, CAST(conv(substring(`{trace_id}`, 1, 16), 16, -10) AS BIGINT) AS _h0, CAST(conv(substring(`{trace_id}`, 17, 16), 16, -10) AS BIGINT) AS _h1"
    rows += "".join(f", {x >> 32}L AS {n}_hi, {x & M32}L AS {n}_lo" for n, x in names.items()) + " FROM {source}"

    def step(hi: str, lo: str, byte: int) -> tuple[str, str]:
        x = f"({lo} ^ (shiftrightunsigned(_h{byte // 8}, {56 - 8 * (byte % 8)}) & 255L))"
        return f"(({hi} * 435L + shiftrightunsigned({x} * 435L, 32) + shiftleft({x}, 8)) & {M32}L)", f"(({x} * 435L) & {M32}L)"

    for i in range(0, 16, 2):
        both = {n: step(*step(f"{n}_hi", f"{n}_lo", i), i + 1) for n in names}
        rows = f"SELECT {quoted}, _h0, _h1{''.join(f', {hi} AS {n}_hi, {lo} AS {n}_lo' for n, (hi, lo) in both.items())} FROM ({rows})"
    return df.sparkSession.sql(f"SELECT {quoted}" + "".join(f", shiftleft({n}_hi, 32) | {n}_lo AS {n}" for n in names) + f" FROM ({rows})", source=df)


def shard(trace_id: Column, shards: int) -> Column:
    """The shard of a trace: FNV-1a 32 of seed and id, modulo ``shards``."""
    mask = F.lit(M32).cast("long")
    h = F.aggregate(id_bytes(trace_id), F.lit(fnv32(SHARD_SEED)).cast("long"), lambda acc, b: (acc.bitwiseXOR(b) * FNV32_PRIME).bitwiseAND(mask))
    return (h % shards).cast("int")


def at_most(value: Column, bound: int) -> Column:
    """``value <= bound`` as unsigned 64-bit numbers."""
    return value.bitwiseXOR(F.lit(FLIP)) <= F.lit(signed(bound) ^ FLIP)


@lru_cache(maxsize=1024)
def sampling_threshold(percentage: float) -> int:
    """The largest hash that is sampled at a percentage: the ratio of 2**64 - 1, rounded to 64 significant bits, cut off, within bounds."""
    ratio = percentage / 100
    if math.isnan(ratio) or ratio <= 0:
        return 0
    if ratio >= 1:
        return M64
    exact = Fraction(ratio) * M64
    shift = 64 - (exact.numerator // exact.denominator).bit_length()
    scaled = exact * Fraction(2) ** shift
    rounded = round(scaled)  # half to even
    return min(M64, int(Fraction(rounded) / Fraction(2) ** shift))


def rv(trace_id: Column) -> Column:
    """The rightmost 56 bits of a trace id."""
    return F.conv(F.substring(trace_id, 19, 14), 16, 10).cast("long")


def parse_threshold(text: Column) -> Column:
    """A threshold attribute: ``0x`` and at most 14 hex digits, padded with zeros on the right; null if it isn't one."""
    digits = F.rpad(F.substring(text, 3, 14), 14, "0")
    return F.when(text.rlike("^0x[0-9a-fA-F]{0,14}$") & ~text.contains("\n"), F.conv(digits, 16, 10).cast("long"))


def threshold_value(text: str | None) -> int | None:
    digits = text[2:] if isinstance(text, str) and text.startswith("0x") else None
    if digits is None or len(digits) > 14 or any(c not in "0123456789abcdefABCDEF" for c in digits):
        return None
    return int(digits.ljust(14, "0"), 16)


def is_root(trace_id: Column, parent: Column) -> Column:
    """Whether a span has no parent, or the right half of its trace id as one."""
    parent = F.coalesce(parent, F.lit("0" * 16))
    return (parent == "0" * 16) | (parent == F.substring(trace_id, 17, 16))


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two times in nanoseconds, cut towards 0."""
    return F.call_function("div", end - start, F.lit(1_000_000).cast("long"))
