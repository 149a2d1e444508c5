"""Validators and printers of the stream vocabulary, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "18446744073709551615"
CONTENT_TYPE_BYTES = 256
#: The characters of an HTTP token.
TOKEN = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"


def path_error(p: Column) -> Column:
    """Null if p is a stream path, else the first rule that it breaks."""
    parts = F.split(p, "/")
    first_bad = F.element_at(F.filter(parts, lambda s: s.isin("", ".", "..")), 1)
    return (
        F.when(F.octet_length(p) > 512, "OverMaxBytes")
        .when(p.rlike(r"\p{Cc}"), "ControlCharacter")
        .when(F.get(parts, F.lit(0)) == "__ds", "ReservedRootSegment")
        .when(F.size(F.filter(parts, lambda s: s.isin("", ".", ".."))) > 0, F.when(first_bad == "", "EmptySegment").otherwise("RelativeSegment"))
    )


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def content_type(raw: Column) -> Column:
    """struct(canonical, error). The first parameter that breaks a rule names the error."""
    parts = F.split(raw, ";", -1)
    essence = _trim(F.get(parts, F.lit(0)))
    params = F.transform(F.slice(parts, F.lit(2), F.size(parts)), _trim)
    name = lambda p: F.lower(_trim(F.substring_index(p, "=", 1)))
    value = lambda p: _trim(p.substr(F.instr(p, "=") + 1, F.length(p)))
    wrong = lambda p, i: F.when(~p.contains("="), "Malformed").when(name(p) != "charset", "UnsupportedParameter").when((i > 0) | ~value(p).rlike(rf"^{TOKEN}$"), "Malformed")
    first = F.get(F.filter(F.transform(params, wrong), lambda e: e.isNotNull()), F.lit(0))
    canonical = F.lower(F.when(F.size(params) == 0, essence).otherwise(F.concat(essence, F.lit("; charset="), value(F.get(params, F.lit(0))))))
    error = F.when(F.octet_length(raw) > CONTENT_TYPE_BYTES, "OverMaxBytes").when(~essence.rlike(rf"^{TOKEN}/{TOKEN}$"), "Malformed").when(first.isNotNull(), first).when(F.octet_length(canonical) > CONTENT_TYPE_BYTES, "OverMaxBytes")
    return F.struct(F.when(error.isNull(), canonical).alias("canonical"), error.alias("error"))


def canonical_content_type_error(raw: Column) -> Column:
    """Null if raw is spelt canonically, else the rule that it breaks."""
    essence, mark = F.substring_index(raw, "; charset=", 1), F.instr(raw, "; charset=")
    charset = F.when(mark > 0, raw.substr(mark + 10, F.length(raw)))
    token = rf"^(?!.*[A-Z]){TOKEN}$"
    slash = F.instr(essence, "/")
    halves = [F.substring_index(essence, "/", 1), essence.substr(slash + 1, F.length(essence))]
    return (
        F.when(F.octet_length(raw) > CONTENT_TYPE_BYTES, "OverMaxBytes")
        .when(essence.contains(";") | F.coalesce(charset.contains(";"), F.lit(False)) | (slash == 0), "Malformed")
        .when(~halves[0].rlike(token) | ~halves[1].rlike(token) | F.coalesce(~charset.rlike(token), F.lit(False)), "NonCanonical")
    )


def essence(ct: Column) -> Column:
    """The loose form: parameters cut off, lower-case."""
    return F.lower(F.trim(F.substring_index(ct, ";", 1)))


def is_json(ct: Column) -> Column:
    return F.substring_index(ct, ";", 1) == "application/json"


def is_text(ct: Column) -> Column:
    return F.startswith(ct, F.lit("text/"))


def ttl(raw: Column) -> Column:
    """struct(seconds decimal(20,0), error). Digits are read from the left: too many of them come before a later bad character."""
    digits = F.regexp_extract(raw, "^[0-9]*", 0)
    over = (F.length(digits) > 20) | ((F.length(digits) == 20) & (digits > U64))
    error = F.when((raw == "") | ((F.length(raw) > 1) & F.startswith(raw, F.lit("0"))), "Malformed").when(over, "OverMax").when(digits != raw, "Malformed").when(raw == "0", "Zero")
    return F.struct(F.when(error.isNull(), raw.try_cast("decimal(20,0)")).alias("seconds"), error.alias("error"))


def instant_ns(raw: Column) -> Column:
    """An RFC 3339 instant as nanoseconds since 1970, decimal(38,0); null if it is none (a [zone] suffix too)."""
    shape = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?([Zz]|[+-]\d{2}:\d{2})$"
    part = lambda i: F.regexp_extract(raw, shape, i)
    day = F.unix_date(F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3))).cast("date")).cast("bigint")
    second = day * 86400 + part(4).try_cast("bigint") * 3600 + part(5).try_cast("bigint") * 60 + part(6).try_cast("bigint")
    zone = F.when(F.lower(part(8)) == "z", F.lit(0)).otherwise((part(8).substr(2, 2).try_cast("bigint") * 3600 + part(8).substr(5, 2).try_cast("bigint") * 60) * F.when(part(8).startswith("-"), -1).otherwise(1))
    good = raw.rlike(shape) & (part(4).try_cast("int") < 24) & (part(5).try_cast("int") < 60) & (part(6).try_cast("int") < 60) & day.isNotNull()
    return F.when(good, (second - zone).cast("decimal(29,0)") * F.lit(1_000_000_000).cast("decimal(10,0)") + F.rpad(part(7), 9, "0").try_cast("decimal(9,0)")).cast("decimal(38,0)")


def policy(ttl_raw: Column, at_raw: Column) -> Column:
    return F.when(ttl_raw.isNotNull() & at_raw.isNotNull(), "Conflict").when(ttl_raw.isNotNull(), "SlidingTtl").when(at_raw.isNotNull(), "AbsoluteExpiry").otherwise("None")


def uuid(raw: Column) -> Column:
    """The canonical spelling, or null."""
    low = F.lower(raw)
    return F.when(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$") & (low != "00000000-0000-0000-0000-000000000000"), low)


def reverse_key(prefix: str, n: Column) -> Column:
    """A key whose ascending order is the descending order of n."""
    return F.concat(F.lit(f"{prefix}/v1/"), F.lpad((F.lit(U64).cast("decimal(20,0)") - n.cast("decimal(19,0)")).cast("decimal(20,0)").cast("string"), 20, "0"))


def reverse_number(key: Column) -> Column:
    tail = F.regexp_extract(key, r"^[a-z]+/v1/(\d{20})$", 1)
    return (F.lit(U64).cast("decimal(20,0)") - tail.try_cast("decimal(20,0)")).cast("decimal(20,0)")


def table_key(store: Column, birth: Column, owner: Column, counter: Column, ordinal: Column) -> Column:
    wide = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(F.lit("table/v1/"), store, F.lit("/"), wide(birth, 20), F.lit("/"), wide(owner, 20), F.lit("-"), wide(counter, 20), F.lit("/"), wide(ordinal, 10))


def object_key_ok(key: Column) -> Column:
    return (F.octet_length(key) <= 1024) & key.rlike("^[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*$")


def successor(n: Column) -> Column:
    """n + 1, null at the end of the 64-bit range or below 1."""
    return F.when((n >= 1) & (n < 9223372036854775807), n + 1)


def fnv1a_64(text: Column) -> Column:
    """FNV-1a, 64 bits, of the text's bytes, as decimal(20,0); worked out in two halves of 32 bits."""
    mask = F.lit((1 << 32) - 1)
    half = lambda hi, lo: F.struct(hi.cast("bigint").alias("hi"), lo.cast("bigint").alias("lo"))
    # the prime is 2^40 + 435

    def step(h: Column, byte: Column) -> Column:
        lo = h["lo"].bitwiseXOR(byte)
        low = lo * 435
        return half((h["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(lo, 8)).bitwiseAND(mask), low.bitwiseAND(mask))

    digits = F.hex(text.cast("binary"))
    byte = lambda d: lambda i: F.conv(F.substring(d, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")
    values = F.when(F.length(digits) == 0, F.array().cast("array<bigint>")).otherwise(F.get(F.transform(F.array(digits), lambda d: F.transform(F.sequence(F.lit(0), (F.length(d) / 2).cast("int") - 1), byte(d))), F.lit(0)))
    end = F.aggregate(values, half(F.lit(0xCBF29CE4), F.lit(0x84222325)), step)
    return (end["hi"].cast("decimal(10,0)") * F.lit(1 << 32).cast("decimal(10,0)") + end["lo"].cast("decimal(10,0)")).cast("decimal(20,0)")


def glob_regex(pattern: Column) -> Column:
    """An anchored expression to match '/' || path with; '*' is one segment, '**' any number, %2A a star."""
    escaped = lambda s: F.regexp_replace(F.regexp_replace(s, "%2[Aa]", "*"), r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    one = lambda s: F.when(s == "**", "(/[^/]+)*").when(s == "*", "/[^/]+").otherwise(F.concat(F.lit("/"), escaped(s)))
    return F.concat(F.lit("^"), F.array_join(F.transform(F.split(pattern, "/"), one), ""), F.lit("$"))


def enriched(raw: Column, offset: Column) -> Column:
    """A JSON message with its offset put into its headers, if it is an object whose headers have a string operation or control.

    raw is compact JSON; what is not such an object comes back unchanged.
    """
    v = F.try_parse_json(raw)
    text = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.lit(False))
    headers = F.get_json_object(raw, "$.headers")
    more = F.concat(F.lit('"headers":'), headers.substr(F.lit(1), F.length(headers) - 1), F.lit(',"offset":"'), offset, F.lit('"}'))
    return F.when(text("$.headers.operation") | text("$.headers.control"), F.replace(raw, F.concat(F.lit('"headers":'), headers), more)).otherwise(raw)


def cursor(now_seconds: Column) -> Column:
    return F.floor((now_seconds - 1728432000) / 20)


def etag(path: Column, start: Column, end: Column, closed: Column) -> Column:
    return F.concat(F.base64(path.cast("binary")), F.lit(":"), start, F.lit(":"), end, F.when(closed, ":c").otherwise(""))


def offset_text(read_seq: Column, byte_offset: Column) -> Column:
    return F.concat(F.lpad(read_seq.cast("string"), 16, "0"), F.lit("_"), F.lpad(byte_offset.cast("string"), 16, "0"))


def all_of(checks: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, checks)
