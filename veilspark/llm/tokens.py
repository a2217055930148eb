"""Subword ids of whole texts by a byte-level BPE file of the tokenizers library."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pre-token pattern of that family of vocabularies. A fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose class all regular expression engines agree; texts with others take the slower engine.
PLAIN = r"^[\t-\r -~\x{A1}-\x{24F}\x{2010}-\x{2027}\x{20AC}]*$"


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in means: printable bytes are themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids as the tokenizers library gives them, without special tokens; their strings are ordinary text.

    A merge list whose ids rise in the order of the merges is a ranking, so a faster engine can apply it. It is used for
    ``PLAIN`` texts, and only if the file has such ids, this pre-token pattern's form and no normaliser.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.slow.no_truncation()
        self.fast = self._ranking(path)

    @staticmethod
    def _ranking(path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, before = said["model"], said.get("pre_tokenizer") or {}
        vocab, byte = model.get("vocab", {}), _byte_of()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        made = [vocab.get("".join(p), -1) for p in pairs]
        plain = model.get("type", "BPE") == "BPE" and not said.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or made != sorted(made) or not made or made[0] < 256 or len(set(made)) < len(made):
            return None
        import tiktoken

        special = {t["content"] for t in said.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with ``end`` behind it, and the n+1 offsets."""
        plain = pc.match_substring_regex(texts, PLAIN).to_numpy(zero_copy_only=False) if self.fast else np.zeros(len(texts), bool)
        ids: list[int] = []
        off = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts.to_pylist()):
            ids += self.fast.encode_ordinary(text) if plain[k] else self.slow.encode(text, add_special_tokens=False).ids
            ids.append(end)
            off[k + 1] = len(ids)
        return np.array(ids, np.uint32), off
