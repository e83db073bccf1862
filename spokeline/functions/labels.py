"""Texts that are shown: escaped labels, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numfmt import to_fixed

# Signs of markup and what stands for them; the ampersand first.
MARKUP = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escaped(text: Column) -> Column:
    """A text that markup shows as it is; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for sign, said in MARKUP:
        out = F.replace(out, F.lit(sign), F.lit(said))
    return out


def coordinates(lat: Column, lng: Column) -> Column:
    """What is shown of a point until its address is known."""
    return F.concat(to_fixed(lat, 4), F.lit(", "), to_fixed(lng, 4))
