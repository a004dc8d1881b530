"""Column functions: urls, hash-based randomness, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """The host of a url in lower case; null where the url has none or is malformed."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def site(name: Column) -> Column:
    """A host without a leading www., m. or blog."""
    return F.regexp_replace(name, r"^(www|m|blog)\.", "")


def resolve(base: Column, href: Column) -> Column:
    """The target of a link on the page at `base`: absolute, protocol-relative, root-relative, fragment or relative to the folder."""
    scheme = F.regexp_extract(base, "(?i)^([a-z][a-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, "(?i)^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, "^([^?#]*)", 1)
    # The folder ends with the last slash after the origin.
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    return (
        F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#") | (href == ""), F.concat(page, href))
        .otherwise(F.concat(folder, href))
    )


def hashed(*parts: Column | str) -> Column:
    """A non-negative long of 60 bits that the parts decide, whatever the partitioning."""
    text = F.concat_ws("-", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision; null where the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
