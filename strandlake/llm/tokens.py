"""Token ids inside Arrow batches, for operators that need the ids of a text at hand."""

from __future__ import annotations

import base64
import os

import numpy as np

#: Fixed value of the tokenizer: the pattern of words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """A rank file with what is known of its pieces. Made once in each task."""

    def __init__(self, folder: str, name: str) -> None:
        import tiktoken

        with open(os.path.join(folder, name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        n = max(ranks.values()) + 1
        self.lengths = np.zeros(n, np.int64)
        self.line_end, self.starts_char, self.starts_word, self.content = (np.zeros(n, bool) for _ in range(4))
        for piece, i in ranks.items():
            self.lengths[i] = len(piece)
            self.line_end[i] = b"\n" in piece or b"\r" in piece
            self.starts_char[i] = not 0x80 <= piece[0] < 0xC0
            self.starts_word[i] = piece[:1].isspace()
            self.content[i] = any(b >= 0x80 or chr(b).isalnum() for b in piece)

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a text; none for null or empty."""
        return np.array(self.encoding.encode_ordinary(text), np.int64) if text else np.zeros(0, np.int64)
