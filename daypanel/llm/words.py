"""Words for models and n-grams: lower case, ASCII punctuation as space, cut at spaces, as UTF-8."""

from __future__ import annotations

import string

_TABLE = bytes(32 if chr(b) in string.punctuation or b < 32 or b == 127 else b for b in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split()
