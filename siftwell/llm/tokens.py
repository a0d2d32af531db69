"""Token ids and counts as the tokenizer's own library gives them, inside tasks.

The word tokenizer drops white space and splits runs of letters from runs of
other signs before it merges, so a text may be cut at any of these places and
its tokens are those of the parts. Parts are therefore encoded once by the
library and remembered; a full memory is emptied, so it stays bounded.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from unicodedata import is_normalized

import numpy as np

#: Fixed value: the splitting rule for which the cuts below are proven.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A letter followed by an ASCII sign other than the apostrophe ends a part.
_PART_END = re.compile(rb"(?<=[A-Za-z])(?=[!-&(-/:-@\[-`{-~])")

#: Parts that a worker remembers, under 200 bytes each.
MEMORY = 800_000


def _byte_signs() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


BYTE_SIGNS = _byte_signs()


class Tokenizer:
    """One loaded vocabulary file: ``.json`` or ``.model``."""

    def __init__(self, path: str):
        self.path = path
        self._memory: dict[bytes, bytes] = {}
        self.words = False
        if path.endswith(".model"):
            import sentencepiece

            self._model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        import tokenizers

        self._model = tokenizers.Tokenizer.from_file(path)
        self._model.no_truncation()
        self._model.no_padding()
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self._special = [x["content"] for x in config.get("added_tokens", ())]
        steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        split = steps[0]
        self.words = (
            split.get("type") == "Split"
            and split.get("pattern") == {"Regex": WORD_RULE}
            and (split.get("behavior"), split.get("invert")) == ("Removed", True)
            and all(not x.get("add_prefix_space") and not x.get("use_regex") for x in steps[1:])
            and not any(re.search(r"\s", x) for x in self._special)
        )

    def ids(self, text: str) -> np.ndarray:
        """Token ids of a text, no added tokens."""
        if not text:
            return np.empty(0, "<u4")
        if self.path.endswith(".model"):
            return np.asarray(self._model.encode(text, num_threads=1), "<u4")
        if not self.words or any(x in text for x in self._special):
            return np.asarray(self._model.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(self._parts(text)), "<u4")

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def spans(self, text: str) -> np.ndarray:
        """First character of each token."""
        if self.path.endswith(".model"):
            pieces = self._model.encode(text, return_type="proto", num_threads=1).pieces
            begin = np.fromiter((p.begin for p in pieces), np.int64, len(pieces))  # in bytes
            heads = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80
            return np.r_[0, np.cumsum(heads)][begin]
        offsets = self._model.encode(text, add_special_tokens=False).offsets
        return np.fromiter((a for a, _ in offsets), np.int64, len(offsets))

    def _parts(self, text: str) -> list[bytes]:
        data = text.encode()
        parts = (data.lower() if data.isascii() else data).split()
        memory = self._memory
        try:
            return [memory[x] for x in parts]
        except KeyError:
            self._learn({x for x in parts if x not in memory})
        out = [memory[x] for x in parts]
        if len(memory) > MEMORY:
            memory.clear()
        return out

    def _learn(self, parts: set[bytes]) -> None:
        """Ask the library; a word of normalised letters goes straight to its merges."""
        memory, merge, rest = self._memory, self._model.model.tokenize, []
        for part in parts:
            word = part.decode()
            if is_normalized("NFC", word) and "\u03a3" not in word and (low := word.lower()).isalpha():
                if not low.isascii():
                    low = low.encode().decode("latin-1").translate(BYTE_SIGNS)
                memory[part] = array("I", [token.id for token in merge(low)]).tobytes()
            else:
                rest.append(part)
        cut = [(part, _PART_END.sub(b" ", part).split()) for part in rest]
        whole = [part for part, pieces in cut if len(pieces) == 1]
        encoded = self._model.encode_batch_fast([x.decode() for x in whole], add_special_tokens=False)
        for part, one in zip(whole, encoded):
            memory[part] = array("I", one.ids).tobytes()
        cut = [(part, pieces) for part, pieces in cut if len(pieces) > 1]
        new = {x for _, pieces in cut for x in pieces if x not in memory}
        if new:
            self._learn(new)
        for part, pieces in cut:
            memory[part] = b"".join([memory[x] for x in pieces])


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of this Python worker; loaded once."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]
