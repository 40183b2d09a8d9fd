"""When a text is blank: null, without letter or digit, or only one marker in square brackets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKER = re.compile(r"[\s\u200b\ufeff]*\[[^\[\]]*\][\s\u200b\ufeff]*")


def is_blank(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    words = text.rlike(r"[\p{L}\p{Nd}]") & ~text.rlike(r"^[\s\p{Z}\x{200B}\x{FEFF}]*\[[^\[\]]*\][\s\p{Z}\x{200B}\x{FEFF}]*$")
    return ~F.coalesce(words, F.lit(False))


def blank(text: str | None) -> bool:
    return not text or not any(c.isalnum() for c in text) or _MARKER.fullmatch(text) is not None
