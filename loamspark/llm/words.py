"""Words of a text: the longest runs of letters and digits after NFKC and lower-casing."""

from __future__ import annotations

import re
import unicodedata

_find = re.compile(r"[^\W_]+").findall
#: ASCII characters in lower case, with spaces for all but letters and digits.
_spaced = "".join(chr(c).lower() if chr(c).isalnum() else " " for c in range(128))


def words(text: str | None) -> list[str]:
    """Words in order; none for null."""
    if not text:
        return []
    return text.translate(_spaced).split() if text.isascii() else _find(unicodedata.normalize("NFKC", text).lower())
