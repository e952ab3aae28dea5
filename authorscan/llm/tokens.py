"""Token ids and token bytes of two kinds of public vocabulary files, for texts of any length.

``ByteTokens`` reads a byte-level BPE file of ``tokenizers``. If its merges are in the order of their ids and its pre-tokenizer is the plain
byte-level one, the ids come from the same merges run by ``tiktoken`` over the file's own vocabulary; any other file, and any
text with a very long run of white space (which that pattern matcher can't take), goes through ``tokenizers`` itself.
``PieceTokens`` reads a sentencepiece model. If no piece holds a word start inside, merges never cross one,
so a very long text is encoded in parts cut before spaces. Strings of special tokens in a text are ordinary text in both.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

LONG = 100_000  # characters; shorter texts need no precaution
META = "▁"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        vocab = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.bytes = [b""] * size
        for token, i in [*vocab.items(), *((t["content"], t["id"]) for t in spec.get("added_tokens", []))]:
            self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        pre = spec.get("pre_tokenizer") or {}
        merges = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"].get("merges", [])]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        plain = (spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                 and pre.get("use_regex", True) and not spec.get("normalizer") and merges == sorted(merges)
                 and all(vocab[c] < merges[0] for c in of))
        self.fast = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                      mergeable_ranks={self.bytes[i]: i for t, i in vocab.items() if t not in special}) if plain else None
        self.blank = re.compile(rf"\s{{{LONG}}}")

    def covers(self, text: str, ids: list[int]) -> bool:
        """The joined token bytes are the text's (in the plain case always: every byte is a token, and merges only join)."""
        return self.fast is not None or b"".join(map(self.bytes.__getitem__, ids)) == text.encode()

    def ids(self, text: str) -> list[int]:
        if self.fast is None or len(text) > LONG and self.blank.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceTokens:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(META, " ").encode() for i, p in enumerate(pieces)]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        probe = "ﬁ ①  é\tx "
        same = sentencepiece.SentencePieceNormalizer(model_file=path).normalize(probe).replace(META, " ").strip() == probe.strip()
        self.cut = re.compile(rf"(?<=[^ {META}]) (?=[^ {META}])") if same and not any(re.search(rf"[^{META}]{META}", p) for p in pieces) else None

    def covers(self, text: str, ids: list[int]) -> bool:
        """The joined token bytes are space + text."""
        return b"".join(map(self.bytes.__getitem__, ids)) == b" " + text.encode()

    def ids(self, text: str) -> list[int]:
        """Ids of ``text``; the model itself puts a space before it."""
        if len(text) <= LONG or self.cut is None:
            return self.model.encode(text)
        out, at = [], 0
        while len(text) - at > LONG and (m := self.cut.search(text, at + LONG)):
            out += self.model.encode(text[at:m.start()])
            at = m.end()  # the space itself is the one that the model puts before the next part
        return out + self.model.encode(text[at:])


@functools.lru_cache(2)
def byte_tokens(path: str) -> ByteTokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteTokens(path)


@functools.lru_cache(2)
def piece_tokens(path: str) -> PieceTokens:
    return PieceTokens(path)
