"""Terms and tokens of a text, shared by the operators of this subpackage."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator

#: Letters and digits, general categories L and N: Python's word characters without the underscore.
TERM = re.compile(r"[^\W_]{2,}")
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern published with the byte-level BPE vocabularies.
BPE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, object] = {}


def terms(text: str) -> list[str]:
    """Maximal runs of letters and digits, two or longer, of the NFC and then lower-cased text."""
    return TERM.findall(unicodedata.normalize("NFC", text).lower())


def encoder(path: str = TOKENIZER):
    """The tiktoken encoder of a rank file; one per Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(path, pat_str=BPE_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def slices(texts: list[str | None], most_chars: int) -> Iterator[range]:
    """Consecutive index ranges whose texts have about `most_chars` characters together."""
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t) if t else 0
        if chars >= most_chars:
            yield range(start, i + 1)
            start, chars = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))
