"""Token ids of the public byte-level BPE vocabulary, whose files stay where they are installed."""

from __future__ import annotations

import base64
import re

#: Texts of these characters only are split alike by every Unicode version: ASCII, Latin-1 and Latin Extended-A.
PLAIN = re.compile(r"[\x00-ſ–—‘-„…€]*")


class Encoder:
    """Ids as ``tokenizers`` gives them with ``add_special_tokens=False``.

    ``tiktoken`` reads the same vocabulary as ranks and finds the same ids in a quarter of the time.
    It serves the texts in which both are sure to agree; texts with other characters, with a
    special token's string or with a run of white space too long for its matcher's stack go to
    ``tokenizers`` itself.
    """

    LONG = re.compile(r"\s{2000}")

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))

    def __call__(self, text: str) -> list[int]:
        if "<|" in text or not PLAIN.fullmatch(text) or self.LONG.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)
