"""Writers of the preprocessing artifacts, for all categories in one job each.

A line holds at most ``CHUNK_ITEMS`` entries, so no task has to build one huge line. Larger
sequences continue in the folder of the next ``chunk_no``. The chunks of larger maps need no order,
so the folder ``chunk_no=n`` of a map holds the chunks from n, a power of two, to 2n - 1: a map has as
many folders as its number of chunks has binary digits. Ordinary ones have a single chunk 0, whose lines are those of the
reference's files.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.interactions import CHUNK_ITEMS, chunked
from tesserae.sources.artifacts import EXTENSION, ID_MAPS, ITEM_ATTRIBUTES, NEGATIVES, SEQUENCES


def _write_lines(lines: DataFrame, path: str) -> None:
    """One folder per category and chunk; large categories get several files, small ones few."""
    lines.select("category", "chunk_no", "value").hint("rebalance", "category").write.partitionBy(
        "category", "chunk_no"
    ).text(path)


def _id_lists(rows: DataFrame, pos: str, root: str, artifact: str, chunk: int) -> None:
    lists = chunked(rows, ["category", "user_id"], pos, "item_id", "ids", chunk)
    listed = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    _write_lines(lists.withColumn("value", F.concat_ws(" ", "user_id", listed)), f"{root}/{artifact}")


def write_sequences(encoded: DataFrame, root: str, chunk: int = CHUNK_ITEMS) -> None:
    """``"<user id> <item id> ..."`` per user, items in time order."""
    _id_lists(encoded, "pos", root, SEQUENCES, chunk)


def write_negatives(negatives: DataFrame, root: str, chunk: int = CHUNK_ITEMS) -> None:
    """``"<user id> <item id> ..."`` per user, items in the order drawn."""
    _id_lists(negatives, "neg_pos", root, NEGATIVES, chunk)


def _map(key: Column, value: Column) -> Column:
    return F.map_from_entries(F.collect_list(F.struct(key.alias("key"), value.alias("value"))))


def _chunk_no(id_column: str, chunk: int) -> Column:
    return F.floor((F.col(id_column) - 1) / chunk).alias("chunk_no")


def _write_maps(maps: DataFrame, path: str) -> None:
    """A folder per chunk would be one of a few lines for each of many thousand chunks."""
    first = F.pow(F.lit(2.0), F.length(F.bin("chunk_no")) - 1).cast("bigint")
    _write_lines(maps.withColumn("chunk_no", F.when(F.col("chunk_no") > 0, first).otherwise(F.col("chunk_no"))), path)


def write_item_attributes(lists: DataFrame, root: str, chunk: int = CHUNK_ITEMS) -> None:
    """JSON object per chunk: item id to list of attribute ids."""
    entries = _map(F.col("item_id").cast("string"), F.col("attribute_ids"))
    maps = lists.groupBy("category", _chunk_no("item_id", chunk)).agg(entries.alias("_m"))
    _write_maps(maps.withColumn("value", F.to_json("_m")), f"{root}/{ITEM_ATTRIBUTES}")


def write_id_maps(
    users: DataFrame, items: DataFrame, attributes: DataFrame, root: str, chunk: int = CHUNK_ITEMS
) -> None:
    """JSON object per chunk with all id maps; ids are strings, attribute ids and counts integers."""

    def two_way(frame: DataFrame, name: str, other: list[Column]) -> DataFrame:
        named, numbered = F.col(name), F.col(f"{name}_id")
        return frame.groupBy("category", _chunk_no(f"{name}_id", chunk)).agg(
            _map(named, numbered if other else numbered.cast("string")).alias(f"{name}2id"),
            _map(numbered.cast("string"), named).alias(f"id2{name}"),
            *other,
        )

    counts = _map(F.col("attribute_id").cast("string"), F.col("num")).alias("attributeid2num")
    key = ["category", "chunk_no"]
    maps = two_way(users, "user", []).join(two_way(items, "item", []), key, "full")
    maps = maps.join(two_way(attributes, "attribute", [counts]), key, "full")
    names = ["user2id", "item2id", "id2user", "id2item", "attribute2id", "id2attribute", "attributeid2num"]
    empty = F.map_from_arrays(F.array(), F.array())
    filled = [F.coalesce(F.col(n), empty.cast(maps.schema[n].dataType)).alias(n) for n in names]
    _write_maps(maps.select(*key, F.to_json(F.struct(*filled)).alias("value")), f"{root}/{ID_MAPS}")


def to_category_folders(spark: SparkSession, root: str, out: str) -> None:
    """Moves artifacts to ``<out>/<category>/<artifact>.<txt|json>``, each a folder of part files.

    Only folders are renamed; no line passes through the driver. That layout has no chunks, so
    artifacts must have been written with a ``chunk`` that no sequence or map exceeds.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for artifact, extension in EXTENSION.items():
        folder = hadoop.Path(f"{root}/{artifact}")
        if not files.exists(folder):
            continue
        for entry in files.listStatus(folder):
            name = entry.getPath().getName()
            if not name.startswith("category="):
                continue
            chunks = [c.getPath() for c in files.listStatus(entry.getPath())]
            if [c.getName() for c in chunks] != ["chunk_no=0"]:
                raise ValueError(f"{artifact} of {name} has several chunks; write it with a larger chunk")
            target = hadoop.Path(f"{out}/{unquote(name.removeprefix('category='))}")
            files.mkdirs(target)
            files.rename(chunks[0], hadoop.Path(target, f"{artifact}.{extension}"))
