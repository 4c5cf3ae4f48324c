"""Token ids of whole texts by a public byte-level vocabulary.

Texts are cut at single blanks between other characters, where the vocabulary's pattern starts a
new piece in any case, so that memory stays flat for texts of any length.  A part with a very long
run of blanks, or of anything else, goes to a second encoder of the same vocabulary, whose pattern
does not recurse.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PART = 1 << 18
LONG_RUN = 20_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r"\s+|\S+")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the supplied vocabulary lies in this environment."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary file stands for: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Encodes texts by a tokenizer file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        letters = _byte_letters()
        vocab = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
        ranks = {bytes(letters[c] for c in word): k for word, k in vocab.items() if all(c in letters for c in word)}
        for word in [w for w, k in ranks.items() if len(w) > 1 and w.startswith(b"<|") and w.endswith(b"|>")]:
            del ranks[word]
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def _long(self, text: str) -> np.ndarray:
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def parts(self, text: str):
        """The ids of a text, part by part."""
        i = 0
        while i < len(text):
            cut = _CUT.search(text, i + PART) if len(text) - i > PART else None
            part = text[i : cut.start()] if cut else text[i:]
            i += len(part)
            if len(part) > LONG_RUN and max(map(len, _RUN.findall(part))) > LONG_RUN:
                yield self._long(part)
            else:
                yield self.fast.encode_to_numpy(part, disallowed_special=())

    def count(self, text: str) -> int:
        return sum(len(p) for p in self.parts(text))

    def ids(self, text: str) -> np.ndarray:
        found = list(self.parts(text))
        return np.concatenate(found).astype("<u4") if found else np.zeros(0, "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
