"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: the bins of its hashed words with their normalised counts, and one
indicator per statistic, for the range its value falls into. Statistics describe the whole text
(shares of character classes, repeated words and lines, lengths), its worst run of 64 words, and
the metadata column. The machine adds a weight per feature and the product of two rank-``rank``
vectors per pair of features; by the identity 2 * sum over pairs = (sum)^2 - sum of squares, that
takes time linear in the features present.

The machine is fitted on at most ``sample`` labelled documents of each class, picked by a digest
of their id, with at most about ``entries`` features in all, on the driver; scores are corrected to the share of the classes among all labels
it may learn from. Scoring is a map over the table.

Defined results: null texts are empty ones and are scored too; documents with a null id are never
held out; labels that are null are left out, and of several labels of one document the smallest
counts; with labels of fewer than two classes every score is the share of ones, (ones + 1) /
(labels + 2); an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.divergence import CLASSES, class_counts, repeated_lines, repeated_words
from tesserae.llm.tasks import filled, kept_rows, picked, settled, slices
from tesserae.llm.words import Words

FOLDS = 5
WORD_BINS = 1 << 14
RUN = 64
RANGES = 16


@dataclass(frozen=True)
class Settings:
    """What the machine is fitted with."""

    sample: int = 3000
    entries: int = 20_000_000
    rank: int = 8
    steps: int = 1000
    batch: int = 64
    rate: float = 0.08
    decay: float = 1e-4
    threshold: float = 0.3
    seed: int = 17


def cut(values, steps) -> np.ndarray:
    return np.searchsorted(np.asarray(steps, float), values, side="right")


SHARES = (0.001, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9)
POWERS = tuple(float(2**i) for i in range(1, 16))


def word_flags(words: Words) -> list[np.ndarray]:
    """Per word: all letters upper case, holds a symbol or exclamation mark, has no letter or digit."""
    data = words.data
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    beyond = data >= 0xC0
    digit = (data >= 48) & (data <= 57)
    marks = np.isin(np.arange(256), list(b"#*$%&|<>!=+^~@{}[]\\_"))[data]

    def inside(mask):
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[words.ends] - sums[words.starts]

    n_upper, n_lower = inside(upper), inside(lower)
    plain = inside(digit) + inside(beyond) + n_upper + n_lower
    return [(n_upper > 1) & (n_lower == 0), inside(marks) > 0, plain == 0]


def statistics(words: Words, keys, texts: list[bytes], metadata) -> np.ndarray:
    """The range number of every statistic of every text."""
    n = np.maximum(words.counts, 1)
    classes = class_counts(words)
    chars = np.maximum(classes.sum(axis=1), 1)
    owner = words.texts_of_words()
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
    flags = [*word_flags(words), same]
    ordered = np.lexsort((keys, owner))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[ordered][1:] != keys[ordered][:-1]) | (owner[ordered][1:] != owner[ordered][:-1])
    distinct = np.bincount(owner[ordered], fresh, words.n_texts)
    sizes = np.bincount(owner, words.ends - words.starts, words.n_texts)
    lines = np.array([t.count(b"\n") + 1 for t in texts], float)
    columns = [cut(words.counts, POWERS), cut(metadata, POWERS), cut(words.counts / lines, POWERS)]
    columns += [cut(classes[:, i] / chars, SHARES) for i in range(len(CLASSES))]
    columns.append(cut(sizes / n, np.arange(1, RANGES)))
    columns.append(cut(distinct / n, SHARES))
    columns.append(cut(repeated_words(words, keys) / n, SHARES))
    columns.append(cut([repeated_lines(t) for t in texts] / lines, SHARES))
    # The worst run of words: a text that is sound on the whole may hold a passage of junk.
    runs = (np.arange(len(keys)) - np.repeat(words.first[:-1], words.counts)) // RUN
    for flag in flags:
        columns.append(cut(np.bincount(owner, flag, words.n_texts) / n, SHARES))
        worst = np.zeros(words.n_texts)
        if len(keys):
            edges = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])]))
            sums = np.add.reduceat(flag.astype(float), edges)
            long = np.diff(np.append(edges, len(keys)))
            np.maximum.at(worst, owner[edges], sums / np.maximum(long, RUN // 4))
        columns.append(cut(worst, SHARES))
    return np.stack(columns, axis=1)


def features(batch: pa.RecordBatch, text: str = "text", metadata: str = "metadata"):
    """(text, feature, value) triples of the texts of a batch."""
    values = filled(batch, text)
    words = Words(values)
    keys, owner = words.keys(), words.texts_of_words()
    texts = values.cast(pa.large_binary()).to_pylist()
    metadata = np.nan_to_num(batch.column(metadata).to_numpy(zero_copy_only=False).astype(float))
    pairs, counts = np.unique(owner * WORD_BINS + (keys % np.uint64(WORD_BINS)).astype(np.int64), return_counts=True)
    of = pairs // WORD_BINS
    weight = np.sqrt(counts)
    length = np.sqrt(np.bincount(of, counts, words.n_texts))
    values = weight / np.maximum(length[of], 1)
    ranges = statistics(words, keys, texts, metadata)
    rows = np.repeat(np.arange(words.n_texts), ranges.shape[1])
    fixed = WORD_BINS + np.arange(ranges.shape[1]) * RANGES + ranges
    return (
        np.concatenate([of, rows]),
        np.concatenate([pairs % WORD_BINS, fixed.ravel()]),
        np.concatenate([values, np.full(len(rows), 0.5)]),
    )


@dataclass
class Machine:
    """Weights of a factorisation machine."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows, columns, values, n: int) -> np.ndarray:
        """The score (log odds) of each of ``n`` rows of a sparse matrix given as triples."""
        linear = np.bincount(rows, self.weights[columns] * values, n)
        pairs = np.zeros(n)
        for j in range(self.factors.shape[1]):
            part = self.factors[columns, j] * values
            pairs += np.bincount(rows, part, n) ** 2 - np.bincount(rows, part * part, n)
        return self.bias + linear + pairs / 2


def fit(rows, columns, values, labels: np.ndarray, settings: Settings, n_features: int) -> Machine:
    """Mini-batches with step sizes that shrink per weight, in the order of a fixed seed."""
    rng = np.random.default_rng(settings.seed)
    weights = np.zeros(n_features)
    factors = rng.normal(0, 0.05, (n_features, settings.rank))
    seen_w, seen_f, bias = np.full(n_features, 1e-2), np.full((n_features, settings.rank), 1e-2), 0.0
    order = np.argsort(rows, kind="stable")
    rows, columns, values = rows[order], columns[order], values[order]
    first = np.searchsorted(rows, np.arange(len(labels) + 1))
    batches = -(-len(labels) // settings.batch)
    for _ in range(-(-settings.steps // batches)):  # as many steps for a small sample as for a large one
        shuffled = rng.permutation(len(labels))
        for at in range(0, len(labels), settings.batch):
            own = shuffled[at : at + settings.batch]
            sizes = first[own + 1] - first[own]
            take = np.arange(sizes.sum()) + np.repeat(first[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            of, x = np.repeat(np.arange(len(own)), sizes), values[take]
            used, place = np.unique(columns[take], return_inverse=True)
            v = factors[used][place] * x[:, None]
            sums = np.stack([np.bincount(of, v[:, j], len(own)) for j in range(settings.rank)], axis=1)
            squares = np.bincount(of, (v * v).sum(axis=1), len(own))
            score = bias + np.bincount(of, weights[used][place] * x, len(own)) + ((sums**2).sum(axis=1) - squares) / 2
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[own]
            pull = error[of] * x
            slope = np.bincount(place, pull, len(used)) / len(own) + settings.decay * weights[used]
            seen_w[used] += slope**2
            weights[used] -= settings.rate * slope / np.sqrt(seen_w[used])
            turn = pull[:, None] * (sums[of] - v)
            turn = np.stack([np.bincount(place, turn[:, j], len(used)) for j in range(settings.rank)], axis=1) / len(own)
            turn += settings.decay * factors[used]
            seen_f[used] += turn**2
            factors[used] -= settings.rate * turn / np.sqrt(seen_f[used])
            bias -= settings.rate * error.mean()
    return Machine(bias, weights, factors)


def held_out(id_column):
    return F.coalesce(F.crc32(id_column.cast("string")) % FOLDS == 0, F.lit(False))


def table_of(docs: DataFrame, id_column: str, text_column: str, metadata_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
        F.col(metadata_column).cast("double").alias("metadata"),
    )


def learn(rows: DataFrame, labels: DataFrame, settings: Settings) -> Machine | float:
    """A machine fitted on a sample of the labels outside the held-out fold, or the share of ones."""
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    known = settled(known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()), "labels")
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, total = counts.get(1, 0), sum(counts.values())
    if len(counts) < 2:
        return (ones + 1) / (total + 2)
    some = [picked(known.filter(F.col("label") == c), settings.sample, counts[c], "doc_id") for c in (0, 1)]
    sample = rows.join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    # Of rows with the same id one counts, that with the smallest digest: the sample is bounded in rows.
    one = F.min_by(F.struct("label", "text", "metadata"), F.struct(F.xxhash64("text"), "text")).alias("one")
    sample = sample.groupBy("doc_id").agg(one).select("doc_id", "one.*")

    def run(batches):
        for batch in slices(batches, "text"):
            of, column, value = features(batch)
            order = np.argsort(of, kind="stable")
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=batch.num_rows))]).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(column[order].astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(value[order].astype(np.float32))),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), *lists], ["doc_id", "label", "columns", "values"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = sample.mapInArrow(run, f"doc_id {kind}, label int, columns array<int>, values array<float>")
    found = settled(found, "label-features")
    n = found.agg(F.sum(F.size("columns"))).first()[0] or 0
    if n > settings.entries:  # very long documents: an even share of the sample, picked by another digest
        found = found.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(n)) < settings.entries)
    found = found.toArrow().sort_by("doc_id").combine_chunks()
    if len(set(found.column("label").to_pylist())) < 2:
        return (ones + 1) / (total + 2)
    labels_of = found.column("label").to_numpy().astype(float)
    columns, values = (found.column(c).combine_chunks() for c in ("columns", "values"))
    sizes = np.asarray(columns.value_lengths())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.asarray(columns.flatten()).astype(np.int64)
    n_features = max(int(flat.max()) + 1, WORD_BINS + RANGES * 64)
    machine = fit(owner, flat, np.asarray(values.flatten()).astype(float), labels_of, settings, n_features)
    shift = np.log(ones / (total - ones)) - np.log(labels_of.sum() / (len(labels_of) - labels_of.sum()))
    machine.bias += shift
    machine.weights, machine.factors = machine.weights.astype(np.float32), machine.factors.astype(np.float32)
    return machine


def scorer(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str,
    text_column: str,
    metadata_column: str,
    label_column: str,
    settings: Settings,
):
    """Fits a machine; returns a function for tasks from (batch, text column, metadata column) to scores."""
    named = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("label"))
    machine = learn(table_of(docs, id_column, text_column, metadata_column), named, settings)
    parts = machine if isinstance(machine, float) else (machine.bias, machine.weights, machine.factors)
    model = docs.sparkSession.sparkContext.broadcast(parts)  # bounded by WORD_BINS, the statistics and the rank

    def scores(batch, text, metadata):
        if isinstance(model.value, float):
            return np.full(batch.num_rows, model.value)
        found = Machine(*model.value).scores(*features(batch, text, metadata), batch.num_rows)
        return 1 / (1 + np.exp(-np.clip(found, -30, 30)))

    return scores


def passing(
    docs: DataFrame,
    labels: DataFrame,
    fit_on: DataFrame | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    metadata_column: str = "n_chars",
    label_column: str = "quality",
    settings: Settings = Settings(),
) -> DataFrame:
    """The rows of ``docs``, with all columns, that are predicted to be good; fitted on ``fit_on`` if given."""
    source = docs if fit_on is None else fit_on
    scores = scorer(source, labels, id_column, text_column, metadata_column, label_column, settings)
    least = settings.threshold
    return kept_rows(docs, text_column, lambda batch: scores(batch, text_column, metadata_column) >= least)


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    metadata_column: str = "n_chars",
    label_column: str = "quality",
    settings: Settings = Settings(),
) -> DataFrame:
    """Per row ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted``; ``labels`` names rows by ``id_column``."""
    rows = table_of(docs, id_column, text_column, metadata_column)
    scores = scorer(docs, labels, id_column, text_column, metadata_column, label_column, settings)

    def run(batches):
        for batch in slices(batches, "text"):
            found = scores(batch, "text", "metadata")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= settings.threshold).cast("int").alias("predicted"),
    )
