"""Column functions for messy text: normal forms, tolerant parsing, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squash(s, drop: str = " ") -> Column:
    """Trimmed, lower-cased, without the characters of drop."""
    return F.translate(F.lower(F.trim(_c(s))), drop, "")


def alnum_key(s) -> Column:
    """Lower-cased letters and digits of any script."""
    return F.regexp_replace(F.lower(F.trim(_c(s))), r"[^\p{L}\p{N}]", "")


def word_key(s) -> Column:
    """Lower-cased word characters (letters, digits, underscore)."""
    return F.regexp_replace(F.lower(_c(s)), r"[^\p{L}\p{N}_]", "")


def az_key(s) -> Column:
    return F.regexp_replace(F.lower(_c(s)), "[^a-z]", "")


def upper_camel(s, keep_case: bool = False) -> Column:
    """ASCII words joined, each with an upper-case first letter; the rest lower-cased unless kept."""
    words = F.regexp_extract_all(_c(s), F.lit("[A-Za-z0-9]+"), F.lit(0))
    rest = (lambda w: F.substr(w, F.lit(2))) if keep_case else (lambda w: F.lower(F.substr(w, F.lit(2))))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), rest(w))), "")


def prettify(s) -> Column:
    """Underscores and dashes as spaces; title case where there is a space then, else an upper-case first letter and the rest as it is."""
    spaced = F.regexp_replace(_c(s), "[_-]", " ")
    one = F.concat(F.upper(F.substr(spaced, F.lit(1), F.lit(1))), F.substr(spaced, F.lit(2)))
    return F.when(spaced.contains(" "), F.initcap(spaced)).otherwise(one)


def without_prefix(s, prefix: str) -> Column:
    s = _c(s)
    return F.when(s.startswith(prefix), F.substr(s, F.lit(len(prefix) + 1))).otherwise(s)


def join_filled(sep: str, *cols) -> Column:
    """The columns that are neither null nor empty, joined."""
    return F.concat_ws(sep, *[F.nullif(_c(c), F.lit("")) for c in cols])


def search_text(*cols) -> Column:
    """One lower-cased text of several fields; a match may span two of them."""
    return F.lower(F.concat_ws(" ", *[_c(c) for c in cols]))


def first_int(s) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(_c(s), "([0-9]{1,18})", 1), F.lit("")), F.lit("9" * 18)).cast("bigint")


def int_pair(s) -> Column:
    """(a, b) of 'a / b'; null where there is none."""
    s = _c(s)
    pattern = r"([0-9]{1,18})\s*/\s*([0-9]{1,18})"
    a, b = (F.nullif(F.regexp_extract(s, pattern, k), F.lit("")).try_cast("bigint") for k in (1, 2))
    return F.when(a.isNotNull(), F.struct(a.alias("a"), b.alias("b")))


def comma_int(s) -> Column:
    """Digits with thousands commas."""
    return F.regexp_replace(F.regexp_extract(_c(s), "([0-9][0-9,]*)", 1), ",", "").try_cast("bigint")


def digits_or_zero(s) -> Column:
    return F.coalesce(F.regexp_replace(_c(s), "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def capped_level(s, cap: int = 25) -> Column:
    """The first integer, at most cap; null without one."""
    n = first_int(s)
    return F.when(n.isNotNull(), F.least(n, F.lit(cap).cast("bigint")))


def stat_value(s) -> Column:
    """(num, is_pct, raw): '5.00%' and '1234' are numbers, else num is null. NaN isn't a number."""
    s = _c(s)
    plain = F.trim(s)
    pct = plain.endswith("%")
    num = F.regexp_replace(plain, "%$", "").try_cast("double")
    return F.struct(F.when(~F.isnan(num), num).alias("num"), F.coalesce(pct, F.lit(False)).alias("is_pct"), s.alias("raw"))


def captured_name(s, lead: str = "equipped by") -> Column:
    """What follows the lead, in any case; null on a miss."""
    return F.nullif(F.trim(F.regexp_extract(_c(s), rf"(?i){lead}\s+(.+)", 1)), F.lit(""))


def asset_path(s, marker: str, extension: str) -> Column:
    """The part behind the marker with another extension."""
    return F.regexp_replace(F.substring_index(_c(s), marker, -1), r"\.[^./]*$", extension)


def label_parts(s) -> Column:
    """(name, value) of 'label: name value': split at the first ': ' and the last space."""
    pattern = r"^[^:]*: (.+) (\S+)$"
    return F.struct(F.regexp_extract(_c(s), pattern, 1).alias("name"), F.regexp_extract(_c(s), pattern, 2).alias("value"))


def list_index(x, values: list) -> Column:
    """Position of x in an ordered list, from 0; 0 on a miss."""
    found = F.array_position(F.array(*[F.lit(v) for v in values]), _c(x))
    return F.coalesce(F.greatest(found - 1, F.lit(0)), F.lit(0)).cast("int")


def list_value(i, values: list) -> Column:
    """The inverse; null outside."""
    return F.get(F.array(*[F.lit(v) for v in values]), _c(i))


def short_hash(payload, index) -> Column:
    """First ten hexadecimal digits of the sha1 of a payload and its index."""
    return F.substr(F.sha1(F.concat(_c(payload), F.lit("#"), _c(index).cast("string")).cast("binary")), F.lit(1), F.lit(10))


def safe_relative_path(s, extension: str = ".png") -> Column:
    """Relative, without '..', drive or backslash root, and with the extension."""
    s = _c(s)
    return F.coalesce(~s.rlike(r"^[/\\]") & ~s.rlike("^[A-Za-z]:") & ~s.rlike(r"(^|[/\\])\.\.([/\\]|$)") & F.lower(s).endswith(extension), F.lit(False))


def claimed(status, claim: str = "claim") -> Column:
    """Whether a status is the claim text, in any case, or shows progress with a slash; unknown is not."""
    s = F.lower(F.trim(_c(status)))
    return F.coalesce((s == claim.lower()) | s.contains("/"), F.lit(False))


def session_name(at) -> Column:
    """A time as the name of a session, 2024-01-31_23-59-59; and back by session_time."""
    return F.date_format(_c(at), "yyyy-MM-dd_HH-mm-ss")


def session_time(name) -> Column:
    """The time of a session's name; NULL for other names."""
    return F.try_to_timestamp(_c(name), F.lit("yyyy-MM-dd_HH-mm-ss"))


# Coercions, which differ on purpose; each takes text (bools as 'true' and 'false').
def export_int(s, default=None) -> Column:
    """Digits only; anything else is the default."""
    s = _c(s)
    return F.coalesce(F.when(s.rlike("^[0-9]+$"), s.try_cast("bigint")), F.lit(default).cast("bigint"))


def item_int(s) -> Column:
    return export_int(s)


def viewer_int(s) -> Column:
    """Bools as 0 and 1, signed integers; floats are null."""
    s = _c(s)
    return F.when(s == "true", 1).when(s == "false", 0).when(s.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(s).try_cast("bigint"))


def loose_number(s) -> Column:
    """The first number in a text; bools are null."""
    s = _c(s)
    return F.when(~s.isin("true", "false"), F.regexp_extract(s, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"))
