"""Byte-level BPE by last tokens, propagated through a trie of the distinct words.

The encoding of a word's prefix is fixed by its last token: before it stands the encoding of the
shorter prefix. A token can be last if it ends the prefix and if it and the last token of the
shorter prefix stay apart when merged as a pair, and exactly one does. So the distinct words
of a slice of texts that are not known yet are inserted in a trie, which is walked depth first;
every node adds one last token to those on the path to it, and words with the same beginning share
its encoding. Ids are read off backwards at the ends of words.

Words are the pieces that the tokenizer file's pre-tokenizer cuts, exactly. Known ones are kept per
worker, as are the stretches between two spaces that they were cut from.

Defined results: a null text is an empty one and has no ids; strings of added tokens become their
ids, as in the library; null ids decode to an empty text; an empty table gives an empty result.
Only the named columns are read, so other columns cannot clash. Files of other kinds of tokenizers
raise a ``ValueError``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm.tasks import cached, slices, strings
from tesserae.llm.vocabulary import PATTERN, byte_alphabet

CACHED = 500_000
CACHED_LENGTH = 64
# Texts that share a trie: more than in other operators, since words that are not kept recur.
SLICE_BYTES = 4 << 20
# Where the library may know other versions of character classes, it cuts itself.
PLAIN = re.compile(r"[\t\n\r -~\xa0-ɏ]*")
# Before a space that a visible character follows, a piece always ends.
STRETCHES = re.compile(r"(?= \S)")


class Node:
    """A place in the trie: the bytes that lead to it from its parent, its children, and whether a word ends here."""

    __slots__ = ("label", "children", "ends")

    def __init__(self, label: bytes, ends: bool):
        self.label, self.children, self.ends = label, None, ends


def insert(root: Node, word: bytes) -> None:
    """Adds a word; a label that only partly agrees with it is split."""
    node, at, size = root, 0, len(word)
    while at < size:
        children = node.children
        if children is None:
            node.children = {word[at]: Node(word[at:], True)}
            return
        child = children.get(word[at])
        if child is None:
            children[word[at]] = Node(word[at:], True)
            return
        label = child.label
        if not word.startswith(label, at):
            rest = word[at : at + len(label)]
            same = next((i for i, (a, b) in enumerate(zip(label, rest)) if a != b), len(rest))
            upper = Node(label[:same], False)
            child.label = label[same:]
            upper.children = {child.label[0]: child}
            children[word[at]] = child = upper
        at += len(child.label)
        node = child
    node.ends = True


class PrefixSharing:
    """A byte-level BPE file of the tokenizers library."""

    def __init__(self, content: bytes):
        described = json.loads(content)
        model, cutter = described["model"], described.get("pre_tokenizer") or {}
        added = described.get("added_tokens", [])
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
        plain = plain and not model.get("end_of_word_suffix") and not described.get("normalizer")
        plain = plain and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True)
        plain = plain and not cutter.get("add_prefix_space", True) and not described.get("post_processor")
        if not plain or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("not a byte-level BPE file that cuts words by its pattern alone")
        self.cutter = Tokenizer.from_str(content.decode()).pre_tokenizer
        self.pattern = regex.compile(PATTERN)
        self.letters = byte_alphabet()
        names = {a["content"]: a["id"] for a in added}
        self.added = names
        found = sorted(map(re.escape, names), key=len, reverse=True)
        self.split_added = re.compile(f"({'|'.join(found)})").split if names else lambda text: [text]
        ids = {self.bytes_of(t): i for t, i in model["vocab"].items() if t not in names}
        self.tokens = dict(map(reversed, ids.items())) | {i: n.encode() for n, i in names.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {
            (model["vocab"][a], model["vocab"][b]): (rank, model["vocab"][a + b]) for rank, (a, b) in enumerate(merges)
        }
        self.single = [ids.get(bytes([b])) for b in range(256)]
        self.ids = ids
        self.left = {self.merges[p][1]: p for p in self.merges}
        self.beginnings = {token[:n] for token in ids for n in range(len(token) + 1)}
        # Reached states: the longest end of a path that begins a token, and the tokens that end it, longest first.
        self.states: list[tuple[bytes, list[tuple[int, int]]]] = [(b"", [])]
        self.numbers: dict[bytes, int] = {b"": 0}
        self.steps: dict[int, int] = {}
        self.pairs: dict[tuple[int | None, int], bool] = {}
        self.sides: dict[tuple[int, int], list[tuple[int, int]]] = {}
        # Ids are kept as little-endian 32-bit bytes, which join fast.
        self.pieces: dict[bytes, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        self.decimal = {i: str(i) for i in self.tokens}
        self.packed = {i: i.to_bytes(4, "little") for i in self.tokens}
        self.sizes = {i: len(t) for i, t in self.tokens.items()}

    def bytes_of(self, token: str) -> bytes:
        return bytes(self.letters[c] for c in token)

    def merged(self, word: bytes) -> list[int]:
        """Ids of a short word by merging its bytes in the order of ranks."""
        ids = [self.single[b] for b in word]
        while len(ids) > 1:
            best = min((self.merges.get(p, (len(self.merges), 0)) for p in zip(ids, ids[1:])), default=None)
            if best[0] == len(self.merges):
                break
            out, at = [], 0
            while at < len(ids):
                if self.merges.get(tuple(ids[at : at + 2]), (-1,))[0] == best[0]:
                    out.append(best[1])
                    at += 2
                else:
                    out.append(ids[at])
                    at += 1
            ids = out
        return ids

    def side(self, token: int, end: int) -> list[tuple[int, int]]:
        """The parts on one side of a token's merges (0: first, 1: last), with the rank that merges each on."""
        found = self.sides.get((token, end))
        if found is None:
            found, until = [], len(self.merges)
            part = token
            while True:
                found.append((part, until))
                pair = self.left.get(part)
                if pair is None:
                    break
                until, part = self.merges[pair][0], pair[end]
            self.sides[token, end] = found
        return found

    def fits(self, before: int | None, last: int) -> bool:
        """Whether two tokens stay apart when they are merged as a pair; without a first, whether one is whole.

        Parts at the border merge if their rank comes before those that merge them on to their own
        sides; of two equal ranks the one further to the left comes first.
        """
        known = self.pairs.get((before, last))
        if known is None:
            if before is None:
                known = self.merged(self.tokens[last]) == [last]
            else:
                known = self.fits(None, before) and self.fits(None, last)
                for left, until in self.side(before, 1):
                    for right, on in self.side(last, 0):
                        rank = self.merges.get((left, right))
                        if rank is not None and rank[0] < until and rank[0] <= on:
                            known = False
            if len(self.pairs) > CACHED * 4:
                self.pairs.clear()
            self.pairs[before, last] = known
        return known

    def step(self, state: int, byte: int) -> int:
        """The state of a path that goes on from ``state`` by a byte."""
        key = state << 8 | byte
        found = self.steps.get(key)
        if found is None:
            end = self.states[state][0] + bytes([byte])
            while end not in self.beginnings:
                end = end[1:]
            found = self.numbers.get(end)
            if found is None:
                found = self.numbers[end] = len(self.states)
                tails = [end[at:] for at in range(len(end))]
                self.states.append((end, [(self.ids[t], len(t)) for t in tails if t in self.ids]))
            self.steps[key] = found
        return found

    def last_token(self, state: int, last: list[int]) -> int:
        """The last token of the encoding of a path in ``state``, given those of all its shorter beginnings."""
        pairs, n = self.pairs, len(last)
        for token, size in self.states[state][1]:
            before = last[n - size] if size <= n else None
            known = pairs.get((before, token))
            if known or known is None and self.fits(before, token):
                return token
        raise ValueError("a byte has no token")

    def encode_pieces(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Packed ids of distinct words, each beginning that words share encoded once."""
        packed, sizes = self.packed, self.sizes
        root = Node(b"", False)
        for word in words:
            insert(root, word)
        # A path is its bytes, and after each of them the state and the last token.
        found, path, states, last = {}, bytearray(), [0], []
        waiting = [(0, child) for child in (root.children or {}).values()]
        while waiting:
            depth, node = waiting.pop()
            del path[depth:], states[depth + 1 :], last[depth:]
            path += node.label
            state = states[-1]
            for byte in node.label:
                state = self.steps.get(state << 8 | byte) or self.step(state, byte)
                states.append(state)
                last.append(self.last_token(state, last))
            if node.ends:
                ids, at = [], len(path)
                while at:
                    token = last[at - 1]
                    ids.append(packed[token])
                    at -= sizes[token]
                ids.reverse()
                found[bytes(path)] = b"".join(ids)
            if node.children:
                waiting.extend((len(path), child) for child in node.children.values())
        return found

    def cut(self, stretch: str) -> list[bytes]:
        """The words of a stretch, as the file's pre-tokenizer cuts them."""
        if stretch.isascii() and stretch[1:].isalpha() and (stretch[0] == " " or stretch[0].isalpha()):
            return [stretch.encode()]
        if PLAIN.fullmatch(stretch):
            return [p.encode() for p in self.pattern.findall(stretch)]
        return [self.bytes_of(p) for p, _ in self.cutter.pre_tokenize_str(stretch)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without special tokens of its own."""
        parts, owners = [], []
        for i, text in enumerate(texts):
            for part in self.split_added(text):
                if part:
                    parts.append([part] if part in self.added else STRETCHES.split(part))
                    owners.append(i)
        known = self.stretches.get
        found = [list(map(known, part)) for part in parts]
        open_parts = [(part, ids) for part, ids in zip(parts, found) if None in ids]
        asked = {s for part, ids in open_parts for s, i in zip(part, ids) if i is None}
        fresh = self.encode_stretches(asked)
        for part, ids in open_parts:
            ids[:] = [fresh[s] if i is None else i for s, i in zip(part, ids)]
        keep(self.stretches, fresh)
        joined: list[list[bytes]] = [[] for _ in texts]
        for owner, ids in zip(owners, found):
            joined[owner].extend(ids)
        return [np.frombuffer(b"".join(j), "<i4") for j in joined]

    def encode_stretches(self, asked: set[str]) -> dict[str, bytes]:
        """Packed ids of stretches; their new words go through one trie."""
        cuts = {s: self.cut(s) for s in asked if s not in self.added}
        pieces = self.pieces
        fresh = self.encode_pieces({p for words in cuts.values() for p in words if p not in pieces})
        out = {s: b"".join([pieces[p] if p in pieces else fresh[p] for p in words]) for s, words in cuts.items()}
        keep(pieces, fresh)
        return out | {s: self.packed[self.added[s]] for s in asked if s in self.added}

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode(errors="replace")


def keep(cache: dict, fresh: dict) -> None:
    """Adds what is short to a cache of bounded size."""
    if len(cache) < CACHED:
        cache.update((k, v) for k, v in fresh.items() if len(k) < CACHED_LENGTH)


def encode(
    docs: DataFrame, tokenizer_file: str, id_column: str = "doc_id", text_column: str = "text", digests: bool = False
) -> DataFrame:
    """Per row ``doc_id``, ``n_tokens`` and ``ids``, or digests of the ids and of the text that they decode to.

    ``ids_sha256`` is that of the decimal ids joined by commas, ``decoded_sha256`` that of the text in UTF-8.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    with open(tokenizer_file, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        coder = cached(("prefix-sharing", tokenizer_file), lambda: PrefixSharing(content.value))
        for batch in slices(batches, "text", SLICE_BYTES):
            ids = [i.tolist() for i in coder.encode(strings(batch.column("text")))]
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(map(len, ids), pa.int64())}
            if digests:
                joined = (",".join(map(coder.decimal.__getitem__, i)) for i in ids)
                columns["ids_sha256"] = pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string())
                decoded = (coder.decode(i).encode() for i in ids)
                columns["decoded_sha256"] = pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())
            else:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = rows.schema["doc_id"].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {rest}")


def decode(encoded: DataFrame, tokenizer_file: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Per row ``doc_id`` and the ``text`` that its ids decode to; null ids give an empty text."""
    rows = encoded.select(F.col(id_column).alias("doc_id"), F.col(ids_column).alias("ids"))
    with open(tokenizer_file, "rb") as file:
        content = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        coder = cached(("prefix-sharing", tokenizer_file), lambda: PrefixSharing(content.value))
        for batch in batches:
            texts = [coder.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
