"""Token ids of whole texts by a public tokenizer's vocabulary files."""

from __future__ import annotations

import base64
import os

import numpy as np

END_OF_TEXT = "<|endoftext|>"


def default_files() -> tuple[str, str]:
    """The byte-level BPE vocabulary in its two formats; the paths are parameters everywhere."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids as tokenizers gives them for the .json file without special tokens added. The same
    vocabulary read as ranks is four times faster and gives the same ids, so it takes every text
    but those that hold a special token's string or that it fails on."""

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path
        self.slow = None

    def encode(self, text: str) -> np.ndarray:
        if END_OF_TEXT not in text:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as error:  # the Rust side panics on some very long runs of spaces
                if isinstance(error, KeyboardInterrupt | SystemExit):
                    raise
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_ready: dict[tuple[str, str], Encoder] = {}


def encoder(files: tuple[str, str]) -> Encoder:
    """One for each Python worker."""
    if files not in _ready:
        _ready[files] = Encoder(*files)
    return _ready[files]
