"""Column hygiene: cleaning, names, URLs, contacts, pseudonyms. JVM expressions but for Unicode normalization."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that turn the direction of text.
BIDI = "[؜‎‏‪-‮⁦-⁩]"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(c: Column) -> Column:
    """Unicode NFC; plain ASCII is it already."""
    return F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(_nfc(c))


def unsafe(c: Column, strict: bool = True) -> Column:
    """Why a text is refused: invalid, nul, replacement, control, bidi; null if it is fine."""
    out = F.when(~F.is_valid_utf8(c), "invalid").when(F.contains(c, F.char(F.lit(0))), "nul")
    if strict:
        out = out.when(F.contains(c, F.lit("�")), "replacement").when(c.rlike(r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"), "control").when(c.rlike(BIDI), "bidi")
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def slug(c: Column, sep: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", "")


def truncate(c: Column, n: int) -> Column:
    """At most n bytes and "...", cut on a character's boundary. Bytes that aren't UTF-8 are dropped, characters never."""
    clean = F.when(F.is_valid_utf8(c), c).otherwise(_without_invalid(c))
    raw = F.encode(clean, "UTF-8")
    # a character's later bytes are 80 to BF: the cut moves left past them
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("int")
    within = lambda i: (byte(i) >= 0x80) & (byte(i) < 0xC0)
    keep = F.when(~within(n + 1), n).when(~within(n), n - 1).when(~within(n - 1), n - 2).otherwise(n - 3)
    cut = F.decode(F.substring(raw, F.lit(1), F.greatest(keep, F.lit(0))), "UTF-8")
    return F.when(F.octet_length(clean) <= n, clean).otherwise(F.concat(cut, F.lit("...")))


def _without_invalid(c: Column) -> Column:
    """Text without bytes that aren't UTF-8: the text's own replacement characters are kept apart meanwhile."""
    mark = "\ue000\ufff8\ue001"
    apart = F.replace(F.make_valid_utf8(F.replace(c, F.lit("\ufffd"), F.lit(mark))), F.lit("\ufffd"), F.lit(""))
    return F.replace(apart, F.lit(mark), F.lit("\ufffd"))


def label(c: Column, n: int = 128) -> Column:
    """A label's value: without control characters, at most n bytes, cut on a character's boundary, nothing added."""
    short = truncate(strip_control(c), n)
    return F.when(F.octet_length(strip_control(c)) <= n, short).otherwise(F.substring(short, F.lit(1), F.length(short) - 3))


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Cc}", "")


def split_list(c: Column) -> Column:
    """The items between commas, without spaces around them; empty ones are left out."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")  # F.trim itself would take an item's index as what to trim


def snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_"))


def pascal(c: Column) -> Column:
    return F.array_join(F.transform(F.split(snake(c), "_"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def url_host(*urls: Column) -> Column:
    return F.coalesce(*[F.try_parse_url(u, F.lit("HOST")) for u in urls])


def with_query(url: Column, name: str, value: str) -> Column:
    """The URL with the parameter, if it has none of that name; before the fragment."""
    bare, fragment = F.substring_index(url, "#", 1), F.regexp_extract(url, "#.*$", 0)
    added = F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit(f"{name}={value}"), fragment)
    return F.when(bare.rlike(rf"[?&]{name}="), url).otherwise(added)


def valid_phone(c: Column) -> Column:
    return c.rlike(r"^\+[1-9][0-9]{7,14}$")


def valid_email(c: Column) -> Column:
    """local@domain of the common subset: dot-separated atoms, a domain of two labels or more."""
    return c.rlike(r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+$")


def pseudonym(c: Column, secret: str | None = None) -> Column:
    return F.sha2(F.concat(F.lit(f"{secret}:"), c) if secret else c, 256)
