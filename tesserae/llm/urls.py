"""URL rules in a sorted digest array.

Rules are (host, path prefix, verdict). The strings of host and path are kept in the order of their
64-bit xxhash digests: a memory-mapped file of digests, and next to it the offsets and bytes of
the strings. A URL probes the digests of every host suffix with every path prefix of a length
that occurs among the rules, as far as its host has no more labels than a rule's, by vectorised binary search; an equal digest counts only if the
stored string is equal too. The longest rule that fits decides.

The three files go into the shared folder and reach every executor once through Spark's file
distribution. Lists above ``map_bytes`` are not distributed: URLs then meet the rules in an
equi-join on host suffix and path prefix, which returns the same rows.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule;
URLs that fit no rule are allowed, as a blocked one must be listed; of rules repeated with both
verdicts ``block`` holds; a null in a rule's host, path or verdict leaves that rule out; an empty
table or rule list is fine. Only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.tasks import cached
from tesserae.workspace import new_path

MAP_BYTES = 1 << 26
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts_of(url):
    """Host and path columns of a URL column: what stands between ``://``, the first ``/?#`` and ``?#``."""
    known = url.isNotNull() & url.contains("://")
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


class DigestArray:
    """The rules in the order of their digests, over memory-mapped files."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, text: np.ndarray):
        self.keys, self.ends, self.text = keys, ends, text

    @staticmethod
    def pack(rules: Iterable[tuple[str, str, str]]) -> dict[str, bytes]:
        """The bytes of the files for (host, path, verdict) rules; the first byte of a string is its verdict."""
        verdicts: dict[str, str] = {}
        for host, path, verdict in rules:
            if None in (host, path, verdict):
                continue
            name = f"{host.lower()}{path}"
            verdicts[name] = BLOCK if BLOCK in (verdict, verdicts.get(name)) else ALLOW
        order = sorted((xxhash.xxh64_intdigest(n.encode()), n) for n in verdicts)
        strings = [(b"B" if verdicts[n] == BLOCK else b"A") + n.encode() for _, n in order]
        keys = np.array([k for k, _ in order], np.uint64)
        ends = np.cumsum([0, *map(len, strings)], dtype=np.int64)
        return {"keys": keys.tobytes(), "ends": ends.tobytes(), "text": b"".join(strings)}

    @classmethod
    def open(cls, files: dict[str, str]) -> DigestArray:
        def view(name, kind):
            try:
                return np.memmap(files[name], kind, "r")
            except ValueError:  # an empty file cannot be mapped
                return np.zeros(0, kind)

        return cls(view("keys", np.uint64), view("ends", np.int64), view("text", np.uint8))

    def find(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(found, blocks) per string."""
        digests = np.array([xxhash.xxh64_intdigest(n) for n in names], np.uint64)
        place = np.searchsorted(self.keys, digests)
        found, blocks = np.zeros(len(names), bool), np.zeros(len(names), bool)
        waiting = np.flatnonzero(place < len(self.keys))
        while len(waiting):
            waiting = waiting[self.keys[place[waiting]] == digests[waiting]]
            for i in waiting:  # confirm the stored string; a collision goes on to the next equal digest
                start, end = self.ends[place[i]], self.ends[place[i] + 1]
                stored = self.text[start:end].tobytes()
                found[i], blocks[i] = stored[1:] == names[i], stored[:1] == b"B"
            waiting = waiting[~found[waiting]]
            place[waiting] += 1
            waiting = waiting[place[waiting] < len(self.keys)]
        return found, blocks & found


def suffixes(host: str, most: int) -> list[str]:
    """A host and its parent domains of at most ``most`` labels, longest first."""
    labels = host.rsplit(".", most)[-most:] if most else []
    return [".".join(labels[i:]) for i in range(len(labels))]


def most_labels(rules) -> int:
    """Labels of the longest host among the rules; longer suffixes of a URL's host fit none."""
    return max((h.count(".") + 1 for h, p, v in rules if None not in (h, p, v)), default=0)


def spread_files(spark: SparkSession, files: dict[str, bytes]) -> dict[str, str]:
    """Writes the files to the shared folder, has Spark bring them to each executor, and returns their names there."""
    folder, own = new_path(spark, "digests"), uuid.uuid4().hex
    hadoop, names = spark._jvm.org.apache.hadoop.fs, {}
    for part, content in files.items():
        names[part] = f"{own}-{part}"
        path = hadoop.Path(f"{folder}/{names[part]}")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out = system.create(path)
        out.write(bytearray(content))
        out.close()
        spark.sparkContext.addFile(system.makeQualified(path).toString())
    return names


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    id_column: str = "page_id",
    url_column: str = "url",
    map_bytes: int = MAP_BYTES,
) -> DataFrame:
    """Per row ``page_id``, ``host``, ``path``, ``rule`` and ``verdict``."""
    host, path = parts_of(F.col(url_column).cast("string"))
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    files = DigestArray.pack(rules)
    lengths = sorted({len(p) for h, p, v in rules if None not in (h, p, v)}, reverse=True)
    most = most_labels(rules)
    if sum(map(len, files.values())) > map_bytes:
        return joined(rows, rules, lengths, most)
    names = spread_files(pages.sparkSession, files)

    def run(batches):
        array = cached(("digest array", names["keys"]), lambda: DigestArray.open({p: SparkFiles.get(n) for p, n in names.items()}))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            # Addresses of one site share most candidates, so each is looked up once a batch.
            heads = [[p[:n] for n in lengths if len(p) >= n] for p in paths]
            wanted = [[s + p for s in suffixes(h, most) for p in own] for h, own in zip(hosts, heads)]
            distinct = list({w for own in wanted for w in own})
            found, blocks = array.find([w.encode() for w in distinct])
            known = {w: bool(b) for w, f, b in zip(distinct, found, blocks) if f}
            best = [max((w for w in own if w in known), key=lambda w: (len(w), w), default=None) for own in wanted]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("page_id", "host", "path")),
                    pa.array(best, pa.string()),
                    pa.array([BLOCK if known.get(b) else ALLOW for b in best], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def joined(rows: DataFrame, rules, lengths: list[int], most: int) -> DataFrame:
    """The same rows by an equi-join with the rules, for lists too large to give to every executor."""
    spark = rows.sparkSession
    names = [(f"{h.lower()}{p}", v) for h, p, v in rules if None not in (h, p, v)]
    listed = spark.createDataFrame(names, "rule string, listed string").groupBy("rule").agg(F.max("listed").alias("listed"))
    address = rows.select("host", "path").distinct()
    # The ends of a host from its last dots on.
    hosts = F.array_distinct(F.expr(f"transform(sequence(1, {max(most, 1)}), i -> substring_index(host, '.', -i))"))
    cuts = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    asked = address.select("host", "path", F.explode(hosts).alias("h"), cuts.alias("cuts"))
    asked = asked.select("host", "path", "h", F.explode("cuts").alias("n"))
    asked = asked.select("host", "path", F.concat("h", F.expr("substring(path, 1, n)")).alias("rule")).distinct()
    best = asked.join(listed, "rule").groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "rule", "listed")).alias("b"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.listed", F.lit(ALLOW)).alias("verdict")
    )
