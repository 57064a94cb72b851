"""Token ids of whole texts for the operators that need ids only.

``ByteIds`` gives what the byte-level vocabulary of a tokenizers file gives
with added special tokens off: text that spells the special token becomes its
id, all else is split and merged.  It runs on the vocabulary's rank file, which
is several times as fast; the tests hold both against each other.  A text with
a run of ``LONG_RUN`` characters or more without a change between white space
and other characters goes to the tokenizers library itself: such a run can be
one pre-token, on which the fast way recurses or takes quadratic time.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

LONG_RUN = 4096
_SPACES = re.compile(r"\s{%d}" % LONG_RUN)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def has_long_run(text: str) -> bool:
    return len(text) >= LONG_RUN and (_SPACES.search(text) is not None or max(map(len, text.split()), default=0) >= LONG_RUN)


class ByteIds:
    def __init__(self, name: str = "byte_bpe_50k.json") -> None:
        import public_tokenizers
        import tiktoken
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(tokenizer_path(name))
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder()
        with open(tokenizer_path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        special = {token.content: i for i, token in added.items()}
        self.encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if has_long_run(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)


@lru_cache(2)
def byte_ids(name: str = "byte_bpe_50k.json") -> ByteIds:
    """One per Python worker; workers are kept from task to task."""
    return ByteIds(name)
