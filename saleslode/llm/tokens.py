"""Token ids of texts by a public byte-pair vocabulary, whose place is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

RANKS_NAME, RANKS_JSON = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
END_OF_TEXT = 50256


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS_NAME)


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a text as unsigned 16-bit numbers; the ranks hold the ids of ``RANKS_JSON``.

    The strings of special tokens are ordinary text. Long texts without a pause are the
    encoder's slowest case, so it gets a text in whole, never cut.
    """
    if not text:
        return np.zeros(0, np.uint16)
    return np.array(_encoder(path).encode_ordinary(text), np.uint16)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id; the free ids between the ranks have none."""
    encoder = _encoder(path)
    return [encoder.decode_single_token_bytes(i) for i in range(encoder.n_vocab)]
