"""Quality rules: plain counts, and the distance of a document's histograms from its language's.

For every language the whole table gives two references: the shares of character classes, and the
shares of its ``common`` most common words,
with one bin for all other words. A document is compared with the
references of its language by the Jensen-Shannon distance (base 2, from 0 to 1) and rejected when
it is further away than a limit, provided that it is long enough for its histogram to mean
something, and its reference has at least ``reference_chars`` characters or ``reference_words``
words. Nulls and languages in fewer than ``least_docs`` documents have the distance from the whole
table, which never rejects. The references of the ``languages`` largest languages are sent to the
tasks, so that is bounded by ``languages`` * (``common`` + classes) numbers; documents of all
others are joined with theirs.

Defined results: a null text is an empty one, which fails the base rules; repeated rows are judged
alike; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.tasks import cached, filled, free, kept_rows, settled, slices
from tesserae.llm.words import Words, mixed, window_starts, windows

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
REPEAT_WIDTH = 3
REPEAT_PERCENT = 50

CLASSES = ("lower", "upper", "digit", "blank", "line", "sentence", "exclamation", "symbol", "beyond_ascii", "control")
SENTENCE = b".,;:?'\"()-/"
WORD, CLASS, DOCS, TOTAL = range(4)
ALL = None
KEY_BUCKETS = (512, 16)
REFERENCE = "_language_reference"


@dataclass(frozen=True)
class Limits:
    """When a distance rejects, and the lengths from which it is asked."""

    class_distance: float = 0.30
    class_chars: int = 200
    word_distance: float = 0.50
    word_words: int = 80
    common: int = 64
    languages: int = 200
    least_docs: int = 1
    reference_chars: int = 10_000
    reference_words: int = 4_000


def class_table():
    """The class number of each byte; bytes inside a character are one past the last class."""
    table = np.full(256, CLASSES.index("control"))
    for name, members in (
        ("symbol", range(33, 127)), ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)),
        ("blank", b" \t"), ("line", b"\n\r\x0b\x0c"), ("sentence", SENTENCE), ("exclamation", b"!"),
        ("beyond_ascii", range(0xC0, 256)),
    ):
        table[list(members)] = CLASSES.index(name)
    table[0x80:0xC0] = len(CLASSES)
    return table


def class_counts(words):
    """Characters of each class per text, as a matrix."""

    width = len(CLASSES) + 1
    kinds = cached("character classes", class_table)[words.data]
    texts = np.repeat(np.arange(words.n_texts), np.diff(words.offsets))
    return np.bincount(texts * width + kinds, minlength=words.n_texts * width).reshape(-1, width)[:, :-1]


def corpus_counts(rows: DataFrame) -> DataFrame:
    """(``lang``, ``kind``, ``key``, ``n``): word, class and document counts of the whole table."""

    def run(batches):
        found: dict = {}

        def out():
            for lang, parts in found.items():
                for kind, (keys, counts) in parts.items():
                    names = pa.array([lang] * len(keys), pa.string())
                    kinds = pa.array(np.full(len(keys), kind, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [names, kinds, pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "kind", "key", "n"]
                    )
            found.clear()

        def add(lang, kind, keys, counts):
            parts = found.setdefault(lang, {})
            if kind in parts:
                keys, counts = np.concatenate([parts[kind][0], keys]), np.concatenate([parts[kind][1], counts])
                keys, places = np.unique(keys, return_inverse=True)
                counts = np.bincount(places, counts, len(keys)).astype(np.int64)
            parts[kind] = keys, counts

        for batch in slices(batches, "text", 1 << 22):
            words = Words(batch.column("text"))
            keys, owner, classes = words.keys(), words.texts_of_words(), class_counts(words)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                own = langs == lang if lang is not None else np.array([x is None for x in langs])
                add(lang, WORD, *np.unique(keys[own[owner]], return_counts=True))
                add(lang, CLASS, np.arange(len(CLASSES), dtype=np.uint64), classes[own].sum(axis=0))
                add(lang, DOCS, np.zeros(1, np.uint64), np.array([own.sum()]))
            if sum(len(k) for parts in found.values() for k, _ in parts.values()) > 1 << 20:
                yield from out()
        yield from out()

    counted = rows.mapInArrow(run, "lang string, kind int, key bigint, n bigint")
    return counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def references(rows: DataFrame, limits: Limits) -> tuple[dict, DataFrame | None]:
    """References by language, and under ``ALL`` that of the whole table, as ``unpacked`` gives them.

    At most ``languages`` languages and ``common`` words of each reach the driver. The second value
    has ``lang`` and ``REFERENCE``, the packed reference, of all other languages, or is None without any.
    """

    counts = settled(corpus_counts(rows), "corpus-counts")
    whole = counts.groupBy("kind", "key").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "kind", "key", "n")
    counts = counts.filter(F.col("lang").isNotNull()).unionByName(whole)
    words = counts.filter(F.col("kind") == WORD)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    totals = settled(totals.select("lang", F.lit(TOTAL).alias("kind"), F.lit(0).cast("bigint").alias("key"), "n"), "corpus-totals")
    # The best of each bucket of keys, and of these the best: a task ranks a small share of a language's words.
    common = words
    for buckets in (*KEY_BUCKETS, 1):
        order = Window.partitionBy("lang", F.pmod("key", F.lit(buckets))).orderBy(F.desc("n"), "key")
        common = common.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limits.common)
    common = common.select("lang", "kind", "key", "n")
    found = common.unionByName(counts.filter(F.col("kind").isin(CLASS, DOCS))).unionByName(totals)
    docs = F.max(F.when(F.col("kind") == DOCS, F.col("n"))).alias("docs")
    packed = found.groupBy("lang").agg(docs, F.collect_list(F.struct("kind", "key", "n")).alias(REFERENCE))
    packed = settled(packed.filter(F.col("lang").isNull() | (F.col("docs") >= limits.least_docs)), "language-references")
    order = F.col("lang").isNull().desc(), F.desc("docs"), "lang"
    largest = packed.orderBy(*order).limit(limits.languages + 1).collect()
    known = {r.lang: unpacked(r[REFERENCE]) for r in largest} or {ALL: unpacked([])}
    if len(largest) <= limits.languages:
        return known, None
    others = packed.filter(~F.col("lang").isin([x for x in known if x is not ALL])).select("lang", REFERENCE)
    return known, others


def unpacked(entries) -> tuple:
    """(class counts, word count, common word keys, their counts) of a packed reference."""
    classes = np.zeros(len(CLASSES))
    for r in entries:
        if r["kind"] == CLASS:
            classes[r["key"]] = r["n"]
    best = sorted((r["key"], r["n"]) for r in entries if r["kind"] == WORD)
    total = sum(r["n"] for r in entries if r["kind"] == TOTAL)
    return classes, total, np.array([k for k, _ in best], np.int64), np.array([n for _, n in best], float)


def with_references(rows: DataFrame, lang_column: str, known: dict, others: DataFrame | None) -> DataFrame:
    """``rows``, and if there are ``others`` the packed references of these languages as a further column."""
    if others is None:
        return rows
    lang, of, packed = F.col(lang_column).cast("string"), free("_reference_of", rows.columns), reference_column(rows)
    small = lang.isNotNull() & ~lang.isin([x for x in known if x is not ALL])
    rest = others.select(F.col("lang").alias(of), F.col(REFERENCE).alias(packed))
    joined = rows.filter(small).join(rest, F.col(lang_column).cast("string") == F.col(of), "left").drop(of)
    plain = rows.filter(~small).withColumn(packed, F.lit(None).cast(others.schema[REFERENCE].dataType))
    return plain.unionByName(joined)


def reference_column(rows: DataFrame) -> str:
    """The name under which rows bring their language's reference along."""
    return free(REFERENCE, rows.columns)


def all_known(batch: pa.RecordBatch, langs: list, known: dict, packed: str) -> dict:
    """``known`` and the references that the rows of the batch bring along in the column ``packed``."""
    if packed not in batch.schema.names:
        return known
    column, more = batch.column(packed), {}
    for i, lang in enumerate(langs):
        if lang not in known and lang not in more and column[i].is_valid:
            more[lang] = unpacked(column[i].as_py())
    return known | more


def distances(counts, reference):
    """Jensen-Shannon distance of each row of counts from one histogram; 0 where either has no counts."""
    totals, whole = counts.sum(axis=1, keepdims=True), reference.sum()
    p = counts / np.maximum(totals, 1)
    q = np.broadcast_to(reference / max(whole, 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    found = np.sqrt(np.clip(terms.sum(axis=1) / 2, 0, 1))
    return np.where((totals[:, 0] > 0) & (whole > 0), found, 0.0)


def repeated_words(words, keys):
    """Words per text inside 3-word windows that the text holds at least twice."""


    starts = window_starts(words.first, REPEAT_WIDTH)
    if not len(starts):
        return np.zeros(words.n_texts, np.int64)
    owner = np.repeat(np.arange(words.n_texts), np.maximum(words.counts - REPEAT_WIDTH + 1, 0))
    own = windows(keys, REPEAT_WIDTH, 0, starts) ^ mixed(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own)
    ordered = own[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(keys) + REPEAT_WIDTH, bool)
    for shift in range(REPEAT_WIDTH):
        marks[starts[twice] + shift] = True
    return np.bincount(words.texts_of_words(), marks[: len(keys)], words.n_texts).astype(np.int64)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def measured(text: pa.Array, langs: list, known: dict, limits: Limits) -> dict[str, np.ndarray]:
    """All result columns of the texts of one slice."""
    words = Words(text)
    keys, owner, classes = words.keys(), words.texts_of_words(), class_counts(words)
    symbols = np.isin(np.arange(256), list(SYMBOLS))
    inside = (words.data & 0xC0) != 0x80
    text_of = np.repeat(np.arange(words.n_texts), np.diff(words.offsets))
    per_text = lambda mask: np.bincount(text_of[mask], minlength=words.n_texts)
    repeats = repeated_words(words, keys)
    langs = [x if x in known else ALL for x in langs]
    by_class, by_word = np.zeros(words.n_texts), np.zeros(words.n_texts)
    class_counted, words_counted = np.zeros(words.n_texts, bool), np.zeros(words.n_texts, bool)
    for lang in set(langs):
        own = np.array([x == lang for x in langs])
        reference, total, common, counts = known[lang]
        class_counted[own] = lang is not ALL and reference.sum() >= limits.reference_chars
        words_counted[own] = lang is not ALL and total >= limits.reference_words
        by_class[own] = distances(classes[own], reference)
        mine = own[owner]
        asked = keys[mine].view(np.int64)
        place = np.searchsorted(common, asked)
        hit = place < len(common)
        hit[hit] = common[place[hit]] == asked[hit]
        place = np.where(hit, place, len(common))
        width = len(common) + 1
        number = np.cumsum(own) - 1
        table = np.bincount(number[owner[mine]] * width + place, minlength=int(own.sum()) * width)
        by_word[own] = distances(table.reshape(-1, width), np.append(counts, total - counts.sum()))
    failed = (words.counts < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * words.counts)
    far = class_counted & (by_class > limits.class_distance) & (classes.sum(axis=1) >= limits.class_chars)
    far |= words_counted & (by_word > limits.word_distance) & (words.counts >= limits.word_words)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": per_text(words.solid & inside).astype(np.int64),
        "n_symbols": per_text(symbols[words.data]).astype(np.int64),
        "n_dup_lines": np.array([repeated_lines(t) for t in text.cast(pa.large_binary()).to_pylist()], np.int64),
        "n_repeat_words": repeats,
        "class_distance": by_class,
        "word_distance": by_word,
        "base_failed": failed,
        "kept": ~failed & ~far,
    }


def language_references(docs: DataFrame, text_column: str, lang_column: str, limits: Limits) -> tuple[dict, DataFrame | None]:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    return references(docs.select(F.col(lang_column).cast("string").alias("lang"), text), limits)


def judge(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    limits: Limits = Limits(),
) -> DataFrame:
    """Per row: ``doc_id``, the base counts, both distances, ``base_failed`` and ``kept``."""
    known, others = language_references(docs, text_column, lang_column, limits)
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(lang_column).cast("string").alias("lang"),
        F.col(text_column).cast("string").alias("text"),
    )

    def run(batches):
        for batch in slices(batches, "text"):
            langs = batch.column("lang").to_pylist()
            found = measured(filled(batch, "text"), langs, all_known(batch, langs, known, REFERENCE), limits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return with_references(rows, "lang", known, others).mapInArrow(
        run,
        f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, class_distance double, word_distance double, base_failed boolean, kept boolean",
    )


def passing(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs``, with all columns, that ``judge`` keeps."""
    known, others = language_references(docs, text_column, lang_column, limits)
    packed = reference_column(docs)

    def kept(batch):
        langs = batch.column(lang_column).cast(pa.string()).to_pylist()
        return measured(filled(batch, text_column), langs, all_known(batch, langs, known, packed), limits)["kept"]

    return kept_rows(with_references(docs, lang_column, known, others), text_column, kept).select(docs.columns)
