"""Column expressions: parsing, addresses, text tests and scores. All run inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """A projection that the optimiser doesn't repeat: each row's columns are computed once, behind a generator of one row.

    Without it, filters on the columns are pushed below the projection with a copy of every expression in them.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def log_time_ms(x: Column) -> Column:
    """``23/May/2025:08:30:00 -0500`` as epoch milliseconds; null where it doesn't parse."""
    return F.unix_millis(F.try_to_timestamp(x, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))


def number(x: Column, kind: str) -> Column:
    """Empty and ``-`` are 0; what isn't a plain number is null."""
    plain = x.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$") if kind == "double" else x.rlike(r"^-?\d+$")
    return F.when(x.isin("", "-"), F.lit(0).cast(kind)).when(plain, x.try_cast(kind))


def url_decode(x: Column) -> Column:
    """Percent and plus decoding; a malformed escape stays as it is."""
    return F.try_url_decode(F.regexp_replace(F.trim(x), "%(?![0-9A-Fa-f]{2})", "%25"))


def request_parts(x: Column) -> tuple[Column, Column, Column]:
    """Method, path and protocol: split at the first and the last blank. ``-`` and '' are three dashes."""
    none, blanks, dash = x.isin("-", ""), F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))), F.lit("-")
    first, last = F.substring_index(x, " ", 1), F.substring_index(x, " ", -1)
    middle = F.substring(x, F.length(first) + 2, F.length(x) - F.length(first) - F.length(last) - 2)
    method = F.when(none | (blanks == 0), dash).otherwise(first)
    path = F.when(none, dash).when(blanks == 0, x).when(blanks == 1, last).otherwise(middle)
    protocol = F.when(~none & (blanks > 1), last).otherwise(dash)
    return method, F.when(path == "", F.lit("/")).otherwise(path), protocol


def ip_number(x: Column) -> Column:
    """An IPv4 address as a number, 0 where it isn't one."""
    parts = F.split(x, r"\.", -1)
    octets = [F.get(parts, i).try_cast("long") for i in range(4)]
    good = x.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$") & reduce(lambda a, b: a & b, [o <= 255 for o in octets])
    return F.when(good, reduce(lambda a, b: a * 256 + b, octets)).otherwise(F.lit(0).cast("long"))


def cidr(x: Column) -> tuple[Column, Column]:
    """Network number and prefix length; null for what isn't an address or a block."""
    text = F.trim(x)
    address, prefix = F.substring_index(text, "/", 1), F.when(text.contains("/"), F.substring_index(text, "/", -1)).otherwise(F.lit("32"))
    length = F.when(prefix.rlike(r"^\d{1,2}$"), prefix.try_cast("int"))
    valid = (length <= 32) & ((ip_number(address) > 0) | (address == "0.0.0.0"))
    return F.when(valid, masked(ip_number(address), length)), F.when(valid, length)


def masked(ip: Column, length: Column) -> Column:
    """The network of an address number for a prefix length."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), 32 - length)
    return ip - F.pmod(ip, size)


def contains_any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(w) for w in words], F.lit(False))


def literal(text: str) -> str:
    """A string as SQL text."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def first_match(x: str, patterns: tuple[str, ...]) -> str:
    """SQL of the pattern whose occurrence in ``x`` ends first, of those the longest; null without a match."""
    found = [f"CASE WHEN locate({literal(p)}, {x}) > 0 THEN named_struct('end', locate({literal(p)}, {x}) + {len(p)}, 'short', -{len(p)}, 'p', {literal(p)}) END" for p in patterns]
    return f"array_min(array({', '.join(found)})).p" if found else "CAST(NULL AS STRING)"


def first_listed(x: str, patterns: tuple[str, ...]) -> str:
    """SQL of the first pattern of the list that occurs in ``x``."""
    return f"CASE {' '.join(f'WHEN contains({x}, {literal(p)}) THEN {literal(p)}' for p in patterns)} END" if patterns else "CAST(NULL AS STRING)"


def major_version(agent: Column, browser: str) -> Column:
    """Digits behind the first ``browser/``; null without them."""
    return F.regexp_extract(agent, f"{browser}/(\\d+)", 1).try_cast("int")


def request_type(path: Column, cfg) -> Column:
    """HTML, ASSET or OTHER: exact pages, asset folders, page endings, asset endings, in this order."""
    clean = F.substring_index(F.substring_index(path, "?", 1), "#", 1)
    ending = F.regexp_extract(clean, r"(\.[^.]*)$", 1)
    in_folder = reduce(lambda a, b: a | b, [clean.startswith(p) for p in cfg.asset_prefix])
    return F.when(clean.isin(*cfg.html_exact), "HTML").when(in_folder, "ASSET").when(ending.isin(*cfg.html_suffix), "HTML").when(ending.isin(*cfg.asset_suffix), "ASSET").otherwise("OTHER")


def score_threshold(v: str, t: float | str, d: float | str, base: float, most: float = 98.0) -> str:
    """SQL of a score: 0 up to the threshold, then from ``base`` in proportion to ``most`` at ``d``."""
    t, d = (x if isinstance(x, str) else f"{float(x)}D" for x in (t, d))
    return f"(CASE WHEN {v} <= {t} THEN 0.0D WHEN {d} <= {t} THEN {base}D WHEN {v} >= {d} THEN {most}D ELSE {base}D + ({v} - {t}) / ({d} - {t}) * {most - base}D END)"


def score_z(z: str, t: float, base: float = 65.0) -> str:
    """SQL of a score: 0 below ``t``, then 5 more for each deviation, up to 99."""
    return f"(CASE WHEN abs({z}) < {t}D THEN 0.0D ELSE least(99.0D, {base}D + 5.0D * (abs({z}) - {t}D)) END)"


def fixed(x: str, digits: int = 6) -> str:
    """SQL of a double as text with so many digits, like printf: the binary value is rounded, an exact half to the even digit.

    (``format_string`` rounds the shortest decimal instead: 2.025 lies below the half and is 2.02 here, 2.03 there.) The product with
    the power of ten is held exactly, as the sum of two doubles; where it is over 2**52 and can't be, ``format_string`` is used.
    """
    scale = 10**digits
    big = "(abs(v) * 134217729.0D)"
    high = f"({big} - ({big} - abs(v)))"
    parts = f"named_struct('p', {high} * {scale}.0D, 'q', (abs(v) - {high}) * {scale}.0D)"
    whole = "named_struct('k', floor(s.p + s.q), 'rest', (s.p - floor(s.p + s.q) - 0.5D) + s.q)"
    up = "r.k + CASE WHEN r.rest > 0 OR (r.rest = 0 AND pmod(r.k, 2) = 1) THEN 1 ELSE 0 END"
    text = f"concat(CASE WHEN v < 0 THEN '-' ELSE '' END, CAST(n DIV {scale} AS STRING), '.', lpad(CAST(n % {scale} AS STRING), {digits}, '0'))"
    steps = f"transform(transform(transform(array({parts}), s -> {whole}), r -> {up}), n -> {text})[0]"
    return f"transform(array(CAST({x} AS DOUBLE)), v -> CASE WHEN abs(v) * {scale} < {2.0**52}D THEN {steps} WHEN v IS NOT NULL THEN format_string('%.{digits}f', v) END)[0]"


def figure(x: str) -> str:
    """SQL of a number in a reason: rounded to nine digits, so that the order of adding doesn't decide a half, and printed with six."""
    return fixed(f"round(CAST({x} AS DOUBLE), 9)", 6)
