"""Column helpers (scalar function family H1-H25).

All return ``Column`` expressions built from ``pyspark.sql.functions`` so
they stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------
# Transaction-type codes (PAYMENT 0, TRANSFER 1, CASH_OUT 2, DEBIT 3,
# CASH_IN 4; anything else 0).
TYPE_CODES = {"PAYMENT": 0, "TRANSFER": 1, "CASH_OUT": 2, "DEBIT": 3, "CASH_IN": 4}
HIGH_RISK_TYPES = ["TRANSFER", "CASH_OUT"]
# VPN / Tor prefixes and "suspicious" prefixes used by the network rules.
VPN_PREFIXES = ["185.220.", "199.87.", "104.244.", "45.142.", "198.96.", "23.129.", "171.25.", "51.15."]
SUSPICIOUS_PREFIXES = ["1.2.3.", "5.6.7.", "185.220.", "199.87."]
SUSPICIOUS_IPS = ["1.2.3.4", "5.6.7.8"]
VPN_PROVIDERS = ["nordvpn", "expressvpn", "surfshark", "cyberghost"]
BOT_PATTERNS = [r"scrapy/[\d.]+", r"selenium|webdriver", r"headless|phantom", r"automation|bot|crawler|spider"]
# IPv4 ranges Python's ``ipaddress.is_private`` treats as private.
PRIVATE_V4_CIDRS = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
]


def get(df: DataFrame, name: str, default) -> Column:
    """``data.get(name, default)``: the column with nulls defaulted, or the
    literal default when the column is absent."""
    if name in df.columns:
        return F.coalesce(F.col(name), F.lit(default)) if default is not None else F.col(name)
    return F.lit(default)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def capped_sum(terms: Iterable[tuple[Column, float]], cap: float | None = 1.0) -> Column:
    """sum(weight if cond) in the given order, optionally capped."""
    total = F.lit(0.0)
    for cond, w in terms:
        total = total + F.when(cond, F.lit(float(w))).otherwise(F.lit(0.0))
    return F.least(F.lit(cap), total) if cap is not None else total


def factors(conds: Sequence[tuple[Column, str]], k: int | None = 3, default: str | None = None) -> Column:
    """Names whose condition holds, in order; first ``k``; ``[default]``
    when none holds (H19 + F4)."""
    arr = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in conds]), lambda x: x.isNotNull())
    if k is not None:
        arr = F.slice(arr, 1, k)
    if default is not None:
        arr = F.when(F.size(arr) == 0, F.array(F.lit(default))).otherwise(arr)
    return arr


def band(score: Column, cuts: Sequence[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """First label whose threshold is reached (``>`` when strict)."""
    expr = None
    for thr, label in cuts:
        cond = score > thr if strict else score >= thr
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise))


def confidence(score: Column) -> Column:
    """min(.95, max(.6, 2*|s-.5|))."""
    return F.least(F.lit(0.95), F.greatest(F.lit(0.6), F.abs(score - 0.5) * 2))


def type_code(t: Column) -> Column:
    m = F.create_map(*[x for kv in TYPE_CODES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(m, t), F.lit(0))


def is_round(amount: Column, unit: int) -> Column:
    """amount % unit == 0 (H2)."""
    return F.pmod(amount, F.lit(float(unit))) == 0


def hour_of_step(step: Column) -> Column:
    return F.pmod(step, F.lit(24))


def day_of_step(step: Column) -> Column:
    return F.floor(step / 24)


def sigmoid_outside_unit(x: Column) -> Column:
    """Logistic squash only when x is outside [0, 1]."""
    return F.when((x > 1) | (x < 0), 1 / (1 + F.exp(-x))).otherwise(x)


def starts_with_any(s: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.coalesce(s.startswith(p), F.lit(False))
    return out


def ipv4_to_long(ip: Column) -> Column:
    """Dotted quad to its 32-bit value; null when not a valid IPv4."""
    parts = F.split(ip, r"\.")
    octs = [F.element_at(parts, i).try_cast("long") for i in range(1, 5)]
    ok = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    val = F.lit(0).cast("long")
    for o in octs:
        ok = ok & (o <= 255)
        val = val * 256 + o
    return F.when(ok, val)


def _cidr_bounds(cidr: str) -> tuple[int, int]:
    net, bits = cidr.split("/")
    a, b, c, d = (int(x) for x in net.split("."))
    base = (a << 24) | (b << 16) | (c << 8) | d
    size = 1 << (32 - int(bits))
    return base, base + size - 1


def is_private_ip(ip: Column) -> Column:
    """Private / reserved IPv4 test (H12); invalid addresses are not private."""
    v = ipv4_to_long(ip)
    cond = F.lit(False)
    for cidr in PRIVATE_V4_CIDRS:
        lo, hi = _cidr_bounds(cidr)
        cond = cond | v.between(lo, hi)
    return F.coalesce(cond, F.lit(False))


def subnet24(ip: Column) -> Column:
    """First three octets."""
    return F.substring_index(ip, ".", 3)


def vpn_probability(ip: Column, geo_velocity_anomaly: Column) -> Column:
    """0.8 for a VPN/Tor prefix, +0.3 for a geo-velocity anomaly, cap 1."""
    return capped_sum([(starts_with_any(ip, VPN_PREFIXES), 0.8),
                       (F.coalesce(geo_velocity_anomaly, F.lit(False)), 0.3)])


def has_bot_agent(ua: Column) -> Column:
    low = F.lower(ua)
    out = F.lit(False)
    for p in BOT_PATTERNS:
        out = out | low.rlike(p)
    return F.coalesce(out, F.lit(False))


def vpn_provider_hits(ua: Column) -> Column:
    """Number of VPN provider names contained in the lower-cased agent."""
    low = F.lower(ua)
    total = F.lit(0)
    for p in VPN_PROVIDERS:
        total = total + F.when(low.contains(p), 1).otherwise(0)
    return total


def token_bucket(token: Column, buckets: int = 10000) -> Column:
    """Deterministic token -> user bucket."""
    return F.concat(F.lit("user_from_token_"), F.pmod(F.xxhash64(token), F.lit(buckets)).cast("string"))


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch for a TIMESTAMP or TIMESTAMP_NTZ column."""
    from pyspark.sql.types import TimestampNTZType
    c = F.col(ts)
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        c = c.cast("timestamp")
    return F.unix_micros(c)


def money(x: Column) -> Column:
    """Amount as an exact decimal: sums of it are independent of order."""
    return x.cast("decimal(38,2)")


def money_sum(x: Column) -> Column:
    return F.sum(money(x)).cast("double")


def money_avg(x: Column) -> Column:
    """Exact sum divided by the count, as a double."""
    return F.sum(money(x)).cast("double") / F.count(x)


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))
