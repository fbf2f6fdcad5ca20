"""Ids of texts under a byte-level BPE file of the tokenizers library, with a cache of words.

Words of running text repeat, so a text is cut at single spaces between two visible characters,
where no token of this family can span, and each distinct word is encoded once. Texts with other
white space around spaces, or with the string of an added token, are encoded whole.
"""

from __future__ import annotations

import json

import tiktoken
from tokenizers import Tokenizer

# Fixed value: the public pattern that splits text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_WORDS = 400_000
PLAIN = 0x250


class ByteVocabulary:
    """Encodes texts to ids as little-endian 32-bit bytes, exactly as the tokenizers library does."""

    def __init__(self, content: bytes):
        self.tokenizer = Tokenizer.from_str(content.decode())
        self.added = [a["content"] for a in json.loads(content).get("added_tokens", [])]
        self.fast = rank_encoding(json.loads(content))
        self.words: dict[str, bytes] = {}
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def bytes_of(self, ids) -> bytes:
        return b"".join([self.packed[i] for i in ids])

    def whole(self, text: str) -> bytes:
        # Outside the plain letters the two libraries may know different versions of character classes.
        if self.fast is None or max(text) >= chr(PLAIN):
            return self.bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return self.bytes_of(self.fast.encode_ordinary(text))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self.bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        if not first or first[0].isspace() or first[-1].isspace():
            return self.whole(text)
        found = list(map(self.words.get, rest))
        if None in found:
            for i, word in enumerate(rest):
                if found[i] is None:
                    if not word or word[0].isspace() or word[-1].isspace():
                        return self.whole(text)
                    found[i] = self.whole(" " + word)
                    if len(self.words) < CACHED_WORDS and len(word) < 64:
                        self.words[word] = found[i]
        return self.whole(first) + b"".join(found)


def rank_encoding(model: dict):
    """The same vocabulary for the faster library, or None unless ids follow the order of merges."""
    letters = model.get("pre_tokenizer") or {}
    if model["model"]["type"] != "BPE" or model.get("normalizer") or letters.get("type") != "ByteLevel":
        return None
    if letters.get("add_prefix_space", True) or not letters.get("use_regex", True):
        return None
    vocabulary = dict(model["model"]["vocab"])
    for added in model.get("added_tokens", []):
        vocabulary.pop(added["content"], None)
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
    if [vocabulary.get(m.replace(" ", "")) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    back = byte_alphabet()
    ranks = {bytes(back[c] for c in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_alphabet() -> dict[str, int]:
    """The visible character that byte-level vocabularies write for each byte, turned round."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
