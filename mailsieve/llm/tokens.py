"""Public tokenizers, opened once in each worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

END_OF_DOCUMENT = "<|endoftext|>"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def byte_bpe(path: str | None = None, special: bool = True):
    """Encoder of the 50k byte-level vocabulary: text to ids as unsigned 32-bit.

    The ids are those of the JSON file of the same vocabulary, in which the
    end-of-document string inside a text is its special id. Without `special` it is
    ordinary text.
    """
    import public_tokenizers
    import tiktoken

    with open(path or vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(
        "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_DOCUMENT: len(ranks)}
    )

    def encode(text: str) -> np.ndarray:
        if special and END_OF_DOCUMENT in text:
            return np.array(encoding.encode(text, allowed_special="all"), dtype="<u4")
        return encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    return encode


@lru_cache(maxsize=4)
def pieces(path: str | None = None):
    """The SentencePiece model with byte fallback."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path("piece_bpe_32k.model"))
