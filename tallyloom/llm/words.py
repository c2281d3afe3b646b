"""Words of whole texts as bytes, in lists of bounded length."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

#: Texts of up to WHOLE bytes give one list; longer ones give lists of up to AT_ONCE words.
WHOLE, AT_ONCE = 1 << 20, 1 << 16


def words(text: bytes | None, pattern: re.Pattern[bytes], lower: bool = True) -> Iterator[list[bytes]]:
    """All matches of ``pattern`` in UTF-8 text, of which A-Z alone are lower-cased; null gives none."""
    text = text or b""
    text = text.lower() if lower else text  # bytes.lower() knows A-Z only
    if len(text) <= WHOLE:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(islice(found, AT_ONCE)):
        yield part
