"""Scalar functions over columns: numbers, units, addresses, text, dates.  All are built-in expressions but IPv6."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: inside a lambda, each mention of an expression is an evaluation of it."""
    return F.element_at(F.transform(F.array(value), use), 1)


# --- numbers and units -----------------------------------------------------------------------


def finite_nonneg(c: Column) -> Column:
    """True for a finite number of at least zero; null gives false."""
    return F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")) & (c >= 0), F.lit(False))


def _hex_digits(c: Column) -> Column:
    """Hexadecimal digits without 0x and leading zeros; null if it is no hexadecimal text."""
    return F.when(c.rlike("^(0[xX])?[0-9a-fA-F]+$"), F.regexp_replace(c, "^(0[xX])?0*", ""))


def _conv(digits: Column) -> Column:
    """At most 16 hexadecimal digits as DECIMAL(20,0); none are 0."""
    return F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("decimal(20,0)")


def _of_digits(digits: Column) -> Column:
    n = F.length(digits)
    high, low = F.substr(digits, F.lit(1), n - 15), F.substr(digits, n - 14, F.lit(15))
    long = (_conv(high) * F.lit(1 << 60).cast("decimal(19,0)")).cast("decimal(38,0)") + _conv(low)
    return F.when(n <= 15, _conv(digits).cast("decimal(38,0)")).when(n <= 31, long.cast("decimal(38,0)"))


def hex_to_decimal(c: Column) -> Column:
    """A hexadecimal quantity, with or without 0x, as DECIMAL(38,0); null if it is no hex text or has over 31 digits."""
    return bound(_hex_digits(c), _of_digits)


def quantity(c: Column) -> Column:
    """Hexadecimal text, or decimal digits, as DECIMAL(38,0)."""
    return bound(c, lambda t: F.when(t.rlike("^0[xX]"), bound(_hex_digits(t), _of_digits)).when(t.rlike("^[0-9]{1,38}$"), t.try_cast("decimal(38,0)")))


def wide_key(c: Column) -> Column:
    """A sort key for quantities of up to 256 bits: their length, then their digits."""
    digits = F.ltrim(F.regexp_replace(F.lower(c), "^0x", ""), F.lit("0"))
    return F.struct(F.length(digits).alias("n"), digits.alias("digits"))


def nonneg_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("decimal(38,0)"))


def wei_to_gwei(c: Column) -> Column:
    """Exact ratio, rounded once to double."""
    wei = c.cast("decimal(38,0)")
    rest = (wei % 1_000_000_000).cast("long")
    whole = ((wei - rest) / 1_000_000_000).cast("decimal(38,0)")
    return F.concat_ws(".", whole.cast("string"), F.lpad(rest.cast("string"), 9, "0")).cast("double")


#: Quantities of up to 256 bits are three limbs of 26 decimal digits, the most significant first, so that
#: structs compare as the numbers do.
_LIMB = 10**26
_LIMBS = "struct<hi:decimal(26,0),mid:decimal(26,0),lo:decimal(26,0)>"


def _limbs(hi: Column, mid: Column, lo: Column) -> Column:
    return F.struct(hi.alias("hi"), mid.alias("mid"), lo.alias("lo")).cast(_LIMBS)


def _carry(x: Column) -> tuple[Column, Column]:
    """Quotient and rest of a DECIMAL(38,0) by a limb."""
    limb = F.lit(str(_LIMB)).cast("decimal(27,0)")
    return ((x - x % limb) / limb).cast("decimal(38,0)"), x % limb


def wide_of(c: Column) -> Column:
    """The limbs of a DECIMAL(38,0) of at least zero."""
    high, low = _carry(c.cast("decimal(38,0)"))
    return F.when(c.isNotNull(), _limbs(F.lit(0), high, low))


def _wide_text(digits: Column) -> Column:
    text = F.lpad(digits, 78, "0")
    made = _limbs(*[F.substr(text, F.lit(i), F.lit(26)).cast("decimal(26,0)") for i in (1, 27, 53)])
    most = str((1 << 256) - 1)
    greatest = _limbs(*[F.lit(most[a:z]).cast("decimal(26,0)") for a, z in ((0, 26), (26, 52), (52, 78))])
    return F.when(made <= greatest, made)


def _wide_hex(digits: Column) -> Column:
    """Four digits at a time."""
    text = F.lpad(digits, 64, "0")
    chunks = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: _conv(F.substr(text, i * 4 + 1, F.lit(4))))

    def step(acc: Column, chunk: Column) -> Column:
        up = lambda limb, add: (limb.cast("decimal(31,0)") * F.lit(65_536).cast("decimal(5,0)") + add).cast("decimal(38,0)")
        over, lo = _carry(up(acc["lo"], chunk))
        over, mid = _carry(up(acc["mid"], over))
        return _limbs(up(acc["hi"], over), mid, lo)

    return F.aggregate(chunks, _limbs(F.lit(0), F.lit(0), F.lit(0)), step)


def wide(c: Column) -> Column:
    """Hexadecimal text, or decimal digits, of at most 256 bits as limbs; null for other text and larger numbers."""

    def of_hex(digits: Column) -> Column:
        n = F.length(digits)
        return F.when(n <= 15, _limbs(F.lit(0), F.lit(0), _conv(digits))).when(n <= 31, bound(_of_digits(digits), wide_of)).when(n <= 64, _wide_hex(digits))

    return bound(c, lambda t: F.when(t.rlike("^0[xX]"), bound(_hex_digits(t), of_hex)).when(t.rlike("^[0-9]{1,78}$"), bound(t, _wide_text)))


def wide_zero() -> Column:
    return _limbs(F.lit(0), F.lit(0), F.lit(0))


def wide_sub(a: Column, b: Column) -> Column:
    """``max(a - b, 0)`` of limbs."""
    limb = F.lit(str(_LIMB)).cast("decimal(27,0)")
    lo = a["lo"] - b["lo"]
    mid = a["mid"] - b["mid"] - (lo < 0).cast("int")
    hi = a["hi"] - b["hi"] - (mid < 0).cast("int")
    up = lambda x: F.when(x < 0, x + limb).otherwise(x)
    small = (a["mid"] == 0) & (a["hi"] == 0)  # so are those of the lesser one
    return F.when(a <= b, wide_zero()).when(small, _limbs(F.lit(0), F.lit(0), lo)).when(a > b, _limbs(hi, up(mid), up(lo)))


def _wide_digits(c: Column) -> Column:
    return F.concat(*[F.lpad(c[x].cast("string"), 26, "0") for x in ("hi", "mid", "lo")])


def wide_text(c: Column) -> Column:
    """The decimal digits of limbs."""
    return F.regexp_replace(_wide_digits(c), "^0+(?=[0-9])", "")


def wide_gwei(c: Column) -> Column:
    """Wei to gwei, rounded once to double."""
    digits = _wide_digits(c)
    return F.concat(F.substr(digits, F.lit(1), F.lit(69)), F.lit("."), F.substr(digits, F.lit(70), F.lit(9))).cast("double")


def wide_ratio(a: Column, b: Column) -> Column:
    """``a / b`` as double; null where b is zero."""
    return F.when(b > wide_zero(), _wide_digits(a).cast("double") / _wide_digits(b).cast("double"))


def gas_ratio(used: Column, limit: Column) -> Column:
    """Used gas over the limit, in [0, 1]; null at limit 0."""
    return F.when(limit > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), used.cast("double") / limit.cast("double"))))


def to_millis(seconds: Column) -> Column:
    return F.when(finite_nonneg(seconds), seconds * 1000.0)


def byte_size(c: Column) -> Column:
    """``1.5 GB`` as bytes; units of 1024 from B to TB."""
    number = F.regexp_extract(c, r"^\s*([0-9.]+)\s*([KMGT]?B)\s*$", 1).try_cast("double")
    unit = F.regexp_extract(c, r"^\s*([0-9.]+)\s*([KMGT]?B)\s*$", 2)
    return number * F.when(unit == "B", 1.0).when(unit == "KB", 1024.0).when(unit == "MB", 1024.0**2).when(unit == "GB", 1024.0**3).when(unit == "TB", 1024.0**4)


def nonneg_diff(a: Column, b: Column) -> Column:
    """``a - b``, not below zero; null where either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a - b, F.lit(0)))


def relation(a: Column, b: Column) -> Column:
    """``fewer``, ``equal`` or ``more``."""
    return F.when(a < b, "fewer").when(a > b, "more").when(a == b, "equal")


def nonneg_age(then: Column, now: Column) -> Column:
    """Seconds from ``then`` to ``now``, not below zero."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 1e6
    return F.when(age.isNotNull(), F.greatest(F.lit(0.0), age))


# --- addresses, hosts, ports -----------------------------------------------------------------


def is_full_address(c: Column) -> Column:
    return F.coalesce(c.rlike("^0x[0-9a-f]{40}$"), F.lit(False))


def normalize_address(c: Column) -> Column:
    """Lower case and trimmed; null unless full, or truncated as ``0xabcd..1234`` with 4 to 6 leading digits."""
    a = F.lower(F.trim(c))
    return F.when(a.rlike(r"^0x([0-9a-f]{40}|[0-9a-f]{4,6}\.\.[0-9a-f]{4})$"), a)


def truncate_address(c: Column) -> Column:
    """First 6 characters, two dots, last 4."""
    return F.concat(F.substring(c, 1, 6), F.lit(".."), F.substring(c, -4, 4))


def wire_key(c: Column) -> Column:
    """One spelling for a full address and its truncation."""
    a = normalize_address(c)
    return F.when(is_full_address(a), truncate_address(a)).otherwise(a)


def canonical_ipv4(c: Column) -> Column:
    """Dotted text of an IPv4 or v4-mapped address; null for others."""
    a = F.regexp_replace(F.lower(F.trim(c)), r"^::ffff:(?=\d+\.)", "")
    part = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(a.rlike(rf"^{part}(\.{part}){{3}}$"), a)


@F.pandas_udf(StringType())
def _ipv6(addresses: pd.Series) -> pd.Series:
    import ipaddress

    def one(text):
        try:
            a = ipaddress.ip_address((text or "").strip())
        except ValueError:
            return None
        if a.version == 4 or a.scope_id:
            return None
        return str(a.ipv4_mapped or a)

    return addresses.map({a: one(a) for a in addresses.unique()})


def canonical_ip(c: Column) -> Column:
    """Canonical text of an address; zones are refused.  Only text with a colon leaves the JVM."""
    v4 = canonical_ipv4(c)
    return F.coalesce(v4, F.when(c.contains(":"), _ipv6(F.when(v4.isNull(), c))))


def dotted(octets: Column) -> Column:
    """An array of four octets as dotted text."""
    return F.when((F.size(octets) == 4) & F.forall(octets, lambda x: x.between(0, 255)), F.array_join(octets.cast("array<string>"), "."))


def port_label(port: Column, allowed: Sequence[int]) -> Column:
    """The port if it is one of 1 to 16 different allowed ones, else ``other``."""
    if not 1 <= len(set(allowed)) <= 16:
        raise ValueError("1 to 16 different ports")
    return F.when(port.isin(list(allowed)), port.cast("string")).otherwise("other")


# --- text ------------------------------------------------------------------------------------


def name_or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))


def cut_at(c: Column, marker: str) -> Column:
    return F.substring_index(c, marker, 1)


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def direction_port(c: Column) -> Column:
    """``in_4001`` as a struct of direction and port."""
    return F.struct(F.nullif(F.regexp_extract(c, r"^(in|out)_(\d+)$", 1), F.lit("")).alias("direction"), F.regexp_extract(c, r"^(in|out)_(\d+)$", 2).try_cast("int").alias("port"))


def classify_text(c: Column, classes: Sequence[tuple[str, Sequence[str]]], empty: str = "none", unknown: str = "unknown") -> Column:
    """The first class with a needle in the text, without regard to case."""
    low = F.lower(c)
    made = F.when(c.isNull() | (F.trim(c) == ""), empty)
    for label, needles in classes:
        any_of = F.lit(False)
        for n in needles:
            any_of = any_of | low.contains(n.lower())
        made = made.when(any_of, label)
    return made.otherwise(unknown)


def normalize_vocab(c: Column, vocabulary: Sequence[str], other: str = "other") -> Column:
    """The value if it is in the closed list, else ``other``."""
    return F.when(c.isin(list(vocabulary)), c).otherwise(other)


def categorize(c: Column, mapping: Mapping[str, str], other: str = "other") -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(pairs[c], F.lit(other))


# --- times and dates -------------------------------------------------------------------------


def parse_ts(c: Column) -> Column:
    """ISO text with or without a fraction or a zone; text without a zone is UTC (the session's zone must be UTC)."""
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
    return F.when(c.rlike(shape), c.try_cast("timestamp"))


def path_date(c: Column) -> Column:
    """A ``YYYYMMDD`` name as a date if it writes back as itself."""
    d = F.when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "yyyyMMdd"))
    return F.when(F.date_format(d, "yyyyMMdd") == c, d)


def fresh(ts: Column, now: Column, max_age_s: float, max_future_s: float = 60.0) -> Column:
    """Not older than the limit and not stamped further in the future than allowed."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1e6
    return F.coalesce((age <= max_age_s) & (age >= -max_future_s), F.lit(False))


def exclude_future(ts: Column, now: Column) -> Column:
    return F.when(ts <= now, ts)


# --- actions ---------------------------------------------------------------------------------


def operation_count(kind: Column, orders: Column, cancels: Column, modifies: Column) -> Column:
    """Operations of one action: the array's length for order, cancel and modify batches, otherwise 1."""
    return F.when(kind == "order", F.size(orders)).when(kind.isin("cancel", "cancelByCloid"), F.size(cancels)).when(kind == "batchModify", F.size(modifies)).otherwise(1)
