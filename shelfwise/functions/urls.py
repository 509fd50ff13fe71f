"""Barcodes in requests and page addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.scalars import strip


def barcode_from_url(url: Column) -> Column:
    """First path segment made of digits only; null where there is none."""
    return F.nullif(F.regexp_extract(url, r"(?:^|/)([0-9]+)(?:/|\z)", 1), F.lit(""))


def requested_barcode(barcode_or_url: Column) -> Column:
    """Barcode of a request: taken out of an address, else the stripped text itself."""
    return F.when(
        barcode_or_url.startswith("http"), barcode_from_url(barcode_or_url)
    ).otherwise(strip(barcode_or_url))


def page_barcode(url: Column, mode: str = "path", host: str = "") -> Column:
    """Barcode of a viewed product page, else null.

    ``path``    the path starts with ``/product/<digits>`` and that segment is all digits.
    ``prefix``  ``<host>/product/<digits>`` occurs anywhere, in any letter case; digits
                may be followed by other text.
    """
    if mode == "path":
        pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+product/+([0-9]+)(?:[/?#]|\z)"
    elif mode == "prefix":
        pattern = f"(?i){re.escape(host)}/product/([0-9]+)"
    else:
        raise ValueError(f"mode must be 'path' or 'prefix', not {mode!r}")
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
