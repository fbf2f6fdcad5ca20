"""Offset-preserving encoding and decoding with SentencePiece models.

A text is normalised by the model's compiled character map: at every place the longest matching
prefix of a double-array trie is replaced, and each normalised byte keeps the source byte it came
from. Pieces cover the normalised text without gaps, so their lengths project every piece to its
byte span in the original. Segmentation itself is the library's. Where the model's normaliser is
the identity and no piece goes over a word boundary, each distinct word is segmented once.

Defined results: a null text is an empty one and has no pieces; an empty table gives an empty
result. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.tasks import cached, slices, strings

# Fixed values of the model format: the visible space, and field numbers and types of its messages.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHED_WORDS = 400_000


def fields(message: bytes):
    """(number, value) of each field of an encoded message; nested messages stay bytes."""

    def varint(at):
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if byte < 0x80:
                return value, at

    at = 0
    while at < len(message):
        tag, at = varint(at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = message[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = message[at : at + size], at + size
        else:
            raise ValueError(f"field {number} has the unknown wire type {kind}")
        yield number, value


class CharacterMap:
    """The compiled map of a model: a double-array trie from byte strings to replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int]:
        """(replacement, bytes replaced) at a place; a character without a match stands for itself."""
        found, units = None, self.units
        if units:
            place = offset_of(units[0])
            for i in range(at, len(text)):
                place ^= text[i]
                if place >= len(units) or units[place] & 0x800000FF != text[i]:
                    break
                leaf = units[place] >> 8 & 1
                place ^= offset_of(units[place])
                if leaf:
                    found = units[place] & 0x7FFFFFFF, i + 1 - at
        if found:
            start, used = found
            return self.texts[start : self.texts.index(b"\0", start)], used
        lead = text[at]
        used = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return text[at : at + used], used


def offset_of(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


class Model:
    """A SentencePiece model with its normalisation rules."""

    def __init__(self, content: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        pieces, rules, trainer = [], {}, {}
        for number, value in fields(content):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        self.map = CharacterMap(rules.get(2, b""))
        self.dummy_prefix, self.trim, self.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        kinds = np.array([k for _, k in pieces])
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0])
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in pieces])
        self.source_sizes = np.array([1 if k == BYTE else len(p.replace(SPACE, " ").encode()) for p, k in pieces])
        plain = not self.map.units and not self.trim and self.dummy_prefix and self.escape and not self.suffix
        whole = all(SPACE not in p.lstrip(SPACE) for p, k in pieces if k == NORMAL) and USER_DEFINED not in kinds
        bytewise = BYTE in kinds
        self.by_words = plain and whole and bytewise and trainer.get(3, 1) == 2
        self.leads = [p.startswith(SPACE) for p, _ in pieces]
        self.words: dict[str, tuple[int, ...]] = {}
        self.decimal = [str(i) for i in range(len(pieces))]

    def normalized(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end its byte in the source."""
        source = text.encode()
        out, places, at = bytearray(), [], 0
        if not source:
            return b"", np.zeros(1, np.int64)
        blank = SPACE.encode() if self.escape else b" "
        if self.trim:
            while at < len(source):
                part, used = self.map.longest(source, at)
                if part != b" ":
                    break
                at += used
            if at == len(source):
                return b"", np.zeros(1, np.int64)

        def space():
            out.extend(blank)
            places.extend([at] * len(blank))

        if not self.suffix and self.dummy_prefix:
            space()
        after_space = self.trim
        while at < len(source):
            part, used = self.map.longest(source, at)
            if after_space:
                part = part.lstrip(b" ")
            for byte in part:
                if byte == 0x20:
                    space()
                else:
                    out.append(byte)
                    places.append(at)
            if part:
                after_space = part.endswith(b" ")
            at += used
            after_space = after_space and self.trim
        if self.trim:
            while out.endswith(blank):
                at = places[len(out) - len(blank)]
                del out[len(out) - len(blank) :], places[len(places) - len(blank) :]
        if self.suffix and self.dummy_prefix:
            space()
        return bytes(out), np.array([*places, at], np.int64)

    def encode(self, text: str) -> list[int]:
        """The ids of a text, as the library gives them."""
        if not text:
            return []
        words = text.split(" ") if self.by_words else [""]
        if "" in words or SPACE in text:
            return self.library.encode(text)
        found = list(map(self.words.get, words))
        if None in found:
            missing = list(dict.fromkeys([w for w, f in zip(words, found) if f is None]))
            ids = self.library.encode(" ".join(missing))
            edges = [i for i, x in enumerate(ids) if self.leads[x]]
            fresh = {w: tuple(ids[a:b]) for w, a, b in zip(missing, edges, [*edges[1:], len(ids)])}
            found = [fresh[w] if f is None else f for w, f in zip(words, found)]
            if len(self.words) < CACHED_WORDS:
                self.words.update((w, f) for w, f in fresh.items() if len(w) < 64)
        return list(chain.from_iterable(found))

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last byte in the source of each piece; a byte piece covers its byte."""
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n_bytes = len(text.encode())
        if self.by_words and SPACE not in text:
            ends = np.cumsum(self.source_sizes[ids]) - 1  # the space put before the text is not in the source
            edges = np.concatenate([[0], ends])
        else:
            normal, places = self.normalized(text)
            if self.unknown in ids:
                found = self.library.encode(text, return_type="proto").pieces
                sizes = [1 if self.sizes[p.id] == 1 else len(p.piece.encode()) for p in found]
            else:
                sizes = self.sizes[ids]
            ends = np.cumsum(sizes)
            if ends[-1] != len(normal):
                raise ValueError("pieces and normalised text differ in length")
            edges = places[np.concatenate([[0], ends])]
        if edges[-1] > n_bytes:
            raise ValueError("a piece ends outside the text")
        return edges[:-1], edges[1:]


def encode(
    docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text", digests: bool = False
) -> DataFrame:
    """Per row ``doc_id``, ``n_tokens`` and either ``ids``, ``starts`` and ``ends`` of the pieces, or digests.

    Digests are ``ids_sha256`` of the decimal ids joined by commas, ``decoded_sha256`` of the text
    that the ids decode to, and ``covered``, the last byte that a piece covers.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    with open(model_file, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        model = cached(("sentence pieces", model_file), lambda: Model(content.value))
        for batch in slices(batches, "text"):
            columns: dict = {"doc_id": batch.column("doc_id")}
            texts = strings(batch.column("text"))
            ids = [model.encode(t) for t in texts]
            edges = [model.spans(t, np.array(i, np.int64)) for t, i in zip(texts, ids)]
            columns["n_tokens"] = pa.array([len(i) for i in ids], pa.int64())
            if digests:
                joined = (",".join([model.decimal[x] for x in i]) for i in ids)
                columns["ids_sha256"] = pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined])
                decoded = (model.library.decode(i) for i in ids)
                columns["decoded_sha256"] = pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])
                columns["covered"] = pa.array([int(e[-1]) if len(e) else 0 for _, e in edges], pa.int64())
            else:
                kind = pa.list_(pa.int32())
                for name, values in (("ids", ids), ("starts", [s for s, _ in edges]), ("ends", [e for _, e in edges])):
                    columns[name] = pa.array(values, kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = rows.schema["doc_id"].dataType.simpleString()
    rest = (
        "ids_sha256 string, decoded_sha256 string, covered bigint"
        if digests
        else "ids array<int>, starts array<int>, ends array<int>"
    )
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {rest}")


def decode(encoded: DataFrame, model_file: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Per row ``doc_id`` and the ``text`` that its ids decode to; null ids give an empty text."""
    rows = encoded.select(F.col(id_column).alias("doc_id"), F.col(ids_column).alias("ids"))
    with open(model_file, "rb") as file:
        content = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        model = cached(("sentence pieces", model_file), lambda: Model(content.value))
        for batch in batches:
            texts = [model.library.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
