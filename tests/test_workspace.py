"""The folder of intermediate tables: its default, and that a run can be cleaned up."""

import subprocess
import sys

import pytest

from tesserae.workspace import shared_folder

SCRIPT = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[2]")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.warehouse.dir", {warehouse!r})
    .getOrCreate()
)
from tesserae.workspace import clear, run_folder, store
assert store(spark.range(5), "t").count() == 5
folder = run_folder(spark).removeprefix("file:")
assert folder.startswith({warehouse!r}) and os.listdir(folder)
clear(spark)
assert not os.path.exists(folder)
"""


def test_without_a_setting_tables_go_to_the_warehouse(tmp_path):
    import os

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    empty = tmp_path / "conf"
    empty.mkdir()
    script = SCRIPT.format(repo=repo, warehouse=str(tmp_path / "warehouse"))
    env = os.environ | {"SPARK_CONF_DIR": str(empty)}
    done = subprocess.run([sys.executable, "-c", script], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def fake(master, checkpoint=None, warehouse="file:/opt/warehouse", default="file:///"):
    from types import SimpleNamespace as N

    settings = {"spark.checkpoint.dir": checkpoint, "spark.sql.warehouse.dir": warehouse}
    hadoop = N(get=lambda name: default)
    conf = N(get=lambda name, *other: settings.get(name))
    return N(conf=conf, sparkContext=N(master=master, _jsc=N(hadoopConfiguration=lambda: hadoop)))


def test_a_local_warehouse_is_refused_on_a_cluster():
    for spark in (fake("yarn"), fake("spark://m:7077", warehouse="/opt/warehouse"), fake("local-cluster[2,1,1024]")):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(spark)
    assert shared_folder(fake("local[4]")) == shared_folder(fake("local")) == "file:/opt/warehouse"
    assert shared_folder(fake("yarn", warehouse="hdfs://n/warehouse/")) == "hdfs://n/warehouse"
    assert shared_folder(fake("yarn", warehouse="/warehouse", default="hdfs://n")) == "/warehouse"
    assert shared_folder(fake("yarn", checkpoint="file:/mnt/shared")) == "file:/mnt/shared"


def test_no_machine_local_folder_is_used():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "tesserae"
    assert not [p for p in root.rglob("*.py") if "mkdtemp" in p.read_text() or "tempfile" in p.read_text()]
