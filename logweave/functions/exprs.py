"""Scalar functions of the event log as Column expressions, and the parsers that run on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sizes of the per-event metadata record without and with a hybrid clock, and the value that says "no urgency".
META_BYTES, META_HLC_BYTES, NO_URGENCY = 50, 62, 0xFFFF


def extract_partition(path: Column) -> Column:
    """The segment after the first /p/ if it is a 32-bit number, else 0."""
    return F.coalesce(F.regexp_extract(path, "/p/([^/]*)", 1).try_cast("int"), F.lit(0))


def extract_key(path: Column) -> Column:
    """What stands between the first /k/ and the last slash; null if there is none or nothing."""
    return F.nullif(F.regexp_extract(path, "/k/(.+)/[^/]*$", 1), F.lit(""))


def keyed_path(prefix: Column, partition: Column, key: Column, seq: Column) -> Column:
    return F.concat_ws("/", prefix, F.lit("p"), partition.cast("string"), F.lit("k"), key, seq.cast("string"))


def unkeyed_path(prefix: Column, partition: Column, seq: Column) -> Column:
    return F.concat_ws("/", prefix, F.lit("p"), partition.cast("string"), seq.cast("string"))


def path_pattern(pattern: str) -> str:
    """A key expression as an anchored regular expression: * is one segment, ** any number of them."""
    special = set(r"\.[]{}()+?^$|")
    if pattern == "**":
        return "^.*$"
    out = ""
    for i, part in enumerate(pattern.split("/")):
        if part == "**":
            out += "(?:/[^/]+)*" if i else "[^/]*(?:/[^/]+)*"
            continue
        plain = "".join(f"\\{c}" if c in special else "[^/]*" if c == "*" else c for c in part)
        out += ("/" if i else "") + ("[^/]+" if part == "*" else plain)
    return f"^{out}$"


def valid_key(key: Column) -> Column:
    """Non-empty, without wildcard signs. Null is not valid."""
    return F.coalesce((F.length(key) > 0) & ~key.rlike("[*$]"), F.lit(False))


def is_internal(path: Column) -> Column:
    """Control traffic has a segment that begins with an underscore."""
    return path.contains("/_")


def _big_endian(number: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.right(F.hex(number), F.lit(2 * size)), 2 * size, "0"))


def encode_metadata(publisher_id: Column, event_id: Column, seq: Column, ts_ns: Column, urgency_ms: Column, hlc_physical_ns: Column | None = None, hlc_logical: Column | None = None) -> Column:
    """The fixed big-endian record: seq 8, publisher 16, event 16, time 8, urgency 2 and, with a clock, 8 + 4 bytes.

    publisher_id and event_id are canonical UUID strings; a null urgency is stored as the reserved value."""
    raw = lambda x: F.unhex(F.replace(x, F.lit("-"), F.lit("")))
    parts = [_big_endian(seq, 8), raw(publisher_id), raw(event_id), _big_endian(ts_ns, 8), _big_endian(F.coalesce(urgency_ms.cast("int"), F.lit(NO_URGENCY)), 2)]
    base = F.concat(*parts)
    if hlc_physical_ns is None:
        return base
    return F.when(hlc_physical_ns.isNull(), base).otherwise(F.concat(base, _big_endian(hlc_physical_ns, 8), _big_endian(hlc_logical, 4)))


def decode_metadata(record: Column) -> Column:
    """The record as a struct; null unless it has one of the two sizes."""
    number = lambda at, n: F.conv(F.hex(F.substring(record, at, n)), 16, 10).cast("long")

    def uuid(at: int) -> Column:
        h = F.lower(F.hex(F.substring(record, at, 16)))
        return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    clock = F.length(record) == META_HLC_BYTES
    return F.when(
        is_metadata(record),
        F.struct(
            number(1, 8).alias("seq"), uuid(9).alias("publisher_id"), uuid(25).alias("event_id"), number(41, 8).alias("ts_ns"),
            F.nullif(number(49, 2), F.lit(NO_URGENCY)).cast("int").alias("urgency_ms"),
            F.when(clock, number(51, 8)).alias("hlc_physical_ns"), F.when(clock, number(59, 4)).alias("hlc_logical"),
        ),
    )


def is_metadata(record: Column) -> Column:
    return F.coalesce(F.length(record).isin(META_BYTES, META_HLC_BYTES), F.lit(False))


def parse_hlc(text: Column) -> Column:
    """'physical:logical' as a struct; null if either is no number."""
    parts = F.split(text, ":")
    p, l = F.get(parts, F.lit(0)).try_cast("long"), F.get(parts, F.lit(1)).try_cast("long")  # noqa: E741
    return F.when((F.size(parts) == 2) & p.isNotNull() & l.isNotNull(), F.struct(p.alias("physical_ns"), l.alias("logical")))


def payload_checksum(payload: Column) -> Column:
    return F.crc32(payload)


def fnv1a64(text: Column) -> Column:
    """64-bit FNV-1a of a string's UTF-8 bytes as an unsigned decimal(20); in decimals, as a long would overflow."""
    prime, modulus = F.expr("cast(1099511628211 as decimal(38,0))"), F.expr("cast(18446744073709551616 as decimal(38,0))")
    codes = F.transform(F.filter(F.split(F.hex(text.cast("binary")), "(?<=\\G..)"), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("long"))

    def mix(state: Column, byte: Column) -> Column:
        low = F.pmod(state, F.expr("cast(256 as decimal(38,0))")).cast("long")
        mixed = state - low.cast("decimal(38,0)") + low.bitwiseXOR(byte).cast("decimal(38,0)")
        return F.pmod((mixed * prime).cast("decimal(38,0)"), modulus).cast("decimal(38,0)")

    return F.aggregate(codes, F.expr("cast(14695981039346656037 as decimal(38,0))"), mix).cast("decimal(20,0)")


def key_filter_tag(kind: Column, value: Column) -> Column:
    """The string under which offsets of a key filter are kept: exact:<key> or prefix:<prefix>."""
    return F.concat_ws(":", kind, value)


def deadline_ns(ts_ns: Column, urgency_ms: Column) -> Column:
    """Time at which an urgent event must be acknowledged; null without urgency. Urgency is cut to what its field holds."""
    return ts_ns + F.least(urgency_ms, F.lit(NO_URGENCY - 1)).cast("long") * 1_000_000


def backoff_ms(attempt: Column, base_ms: int, max_ms: int | None = None) -> Column:
    """Fixed delay without `max_ms`, else min(base * 2^attempt, max) without overflow for large attempts."""
    if max_ms is None:
        return F.lit(base_ms).cast("long") + 0 * attempt
    return F.least(F.lit(base_ms) * F.pow(F.lit(2.0), F.least(attempt, F.lit(60))), F.lit(float(max_ms))).cast("long")


def channel_fullness(held: Column, capacity: Column) -> Column:
    return F.coalesce(F.try_divide(held.cast("double"), capacity.cast("double")), F.lit(0.0))


def next_batch_size(current: int, took_ms: float, target_ms: float, least: int, most: int) -> int:
    """Double below half the target time, halve above twice the target, within bounds."""
    size = current * 2 if took_ms < target_ms / 2 else current // 2 if took_ms > 2 * target_ms else current
    return max(least, min(most, size))


def map_processor(payload: Column) -> Column:
    """{"processed":true,"original":...} around a JSON payload; other payloads pass unchanged."""
    whole = F.try_parse_json(payload)
    wrapped = F.concat(F.lit('{"processed":true,"original":'), F.to_json(whole), F.lit("}"))
    return F.when(whole.isNotNull(), wrapped).otherwise(payload)


def header_timestamp_ns(payload: Column) -> Column:
    """Little-endian unsigned 64-bit number in the first eight bytes."""
    h = F.hex(F.substring(payload, 1, 8))
    swapped = F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
    return F.when(F.length(payload) >= 8, F.conv(swapped, 16, 10).cast("long"))


def build_payload(ts_ns: Column, size: int) -> Column:
    """A payload of `size` bytes that begins with the time in little-endian order."""
    h = F.lpad(F.hex(ts_ns), 16, "0")
    swapped = F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
    return F.unhex(F.rpad(swapped, 2 * max(size, 8), "0"))


def dotted_topic(topic: Column) -> Column:
    return F.replace(topic, F.lit("/"), F.lit("."))


def short_id(text: Column, n: int = 8) -> Column:
    return F.substring(text, 1, n)


def format_bytes(n: Column) -> Column:
    step = F.least(F.floor(F.log(1024.0, F.greatest(n, F.lit(1)).cast("double"))), F.lit(4)).cast("int")
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), step + 1)
    shown = F.when(step == 0, n.cast("string")).otherwise(F.format_string("%.1f", n / F.pow(F.lit(1024.0), step)))
    return F.concat_ws(" ", shown, unit)


def format_micros(us: Column) -> Column:
    return F.when(us < 1000, F.concat(us.cast("string"), F.lit("us"))).when(us < 1_000_000, F.concat(F.format_string("%.1f", us / 1000), F.lit("ms"))).otherwise(
        F.concat(F.format_string("%.2f", us / 1_000_000), F.lit("s"))
    )


def time_ago(seconds: Column) -> Column:
    part = lambda k, unit: F.concat(F.floor(seconds / k).cast("string"), F.lit(unit))
    return F.when(seconds < 5, F.lit("just now")).when(seconds < 60, part(1, "s ago")).when(seconds < 3600, part(60, "m ago")).when(seconds < 86400, part(3600, "h ago")).otherwise(part(86400, "d ago"))


@dataclass(frozen=True)
class QueryFilters:
    """Filters of a log scan. All bounds are exclusive; what is None doesn't filter."""

    after_seq: int | None = None
    before_seq: int | None = None
    after_time_ns: int | None = None
    before_time_ns: int | None = None
    publisher_id: str | None = None
    limit: int | None = None


@dataclass(frozen=True)
class ReplayFilters:
    """Filters of a replay. Clock bounds are exclusive; an exact key makes the prefix irrelevant."""

    after_hlc: tuple[int, int] | None = None
    before_hlc: tuple[int, int] | None = None
    key: str | None = None
    key_prefix: str | None = None
    publisher_id: str | None = None
    limit: int | None = None


def selector_params(selector: str) -> dict[str, str]:
    """The parameters behind the ? of a selector, split at ; or &, trimmed; the last of equal names counts."""
    text = selector.split("?", 1)[1] if "?" in selector else selector
    found = {}
    for part in text.replace("&", ";").split(";"):
        name, sep, value = part.partition("=")
        if sep and name.strip():
            found[name.strip()] = value.strip()
    return found


def _whole(params: dict[str, str], name: str) -> int | None:
    if name not in params:
        return None
    if not params[name].isdigit():
        raise ValueError(f"{name} is no number: {params[name]!r}")
    return int(params[name])


def parse_query_selector(selector: str) -> QueryFilters:
    """Unknown names are ignored, bad numbers are errors."""
    p = selector_params(selector)
    return QueryFilters(*(_whole(p, n) for n in ("after_seq", "before_seq", "after_time", "before_time")), p.get("publisher_id"), _whole(p, "limit"))


def parse_replay_selector(selector: str) -> ReplayFilters:
    p = selector_params(selector)

    def clock(name: str) -> tuple[int, int] | None:
        if name not in p:
            return None
        a, sep, b = p[name].partition(":")
        if not sep or not a.isdigit() or not b.isdigit():
            raise ValueError(f"{name} is no hybrid clock: {p[name]!r}")
        return int(a), int(b)

    return ReplayFilters(clock("after_hlc"), clock("before_hlc"), p.get("key"), p.get("key_prefix"), p.get("publisher_id"), _whole(p, "limit"))


def is_replay_selector(selector: str) -> bool:
    """Replay is asked for by any of its own parameters."""
    return bool({"after_hlc", "before_hlc", "key", "key_prefix"} & set(selector_params(selector)))
