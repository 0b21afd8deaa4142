"""Scanned and printed pages: word boxes, and which text of a page to trust. Recognition itself is a caller's backend."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_LEAST, IMAGE_SHARE = 20, 0.5


class OcrBackend(Protocol):
    """Turns a page image into words with boxes and places: text, x0, y0, x1, y1, start, end."""

    def words(self, image: bytes) -> list[dict]: ...


def page_text(text: Column, image_share: Column, ocr_text: Column) -> Column:
    """A page's text if there is enough of it, else what was recognised; a picture that nobody read is an error."""
    enough = F.length(F.trim(F.coalesce(text, F.lit("")))) >= TEXT_LEAST
    unread = (F.coalesce(image_share, F.lit(0.0)) >= IMAGE_SHARE) & ocr_text.isNull()
    return F.when(enough, text).when(unread, F.raise_error(F.lit("a page is a picture and was not read")).cast("string")).otherwise(F.coalesce(ocr_text, text, F.lit("")))


def boxes_for_span(boxes: Column, start: Column, end: Column, pad: float = 1.0) -> Column:
    """The boxes that a span touches, a little wider. boxes: array of text, x0, y0, x1, y1, start, end."""
    hit = F.filter(boxes, lambda b: (b["end"] > start) & (b["start"] < end))
    return F.transform(hit, lambda b: F.struct((b["x0"] - pad).alias("x0"), (b["y0"] - pad).alias("y0"), (b["x1"] + pad).alias("x1"), (b["y1"] + pad).alias("y1")))
