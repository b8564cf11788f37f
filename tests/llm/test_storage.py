"""The folder of intermediate tables."""

import os
import subprocess
import sys
import textwrap

import pytest

from canopyql.llm.storage import shared_dir


class _Session:
    """What shared_dir asks of a session."""

    def __init__(self, master: str, folder: str | None = None):
        self.sparkContext, self.conf, self.master, self.folder = self, self, master, folder

    def get(self, name, default):
        return self.folder if name == "spark.checkpoint.dir" and self.folder else default


def test_only_local_mode_has_a_folder_of_its_own():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        assert shared_dir(_Session(master, "hdfs://x/y/")) == "hdfs://x/y"
        with pytest.raises(RuntimeError):
            shared_dir(_Session(master))
    assert shared_dir(_Session("local[4]")).startswith("file://")


def test_tables_are_deleted_when_the_driver_ends(tmp_path):
    code = """
        import sys
        sys.path.insert(0, sys.argv[1])
        from pyspark.sql import SparkSession
        from canopyql.llm.storage import Scratch
        s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
        t = Scratch(s).save(s.range(5))
        assert t.count() == 5
        s.stop()
    """
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", textwrap.dedent(code), repo, f"file://{tmp_path}/shared"], check=True, capture_output=True, timeout=120)
    import time

    # Spark makes an empty folder of its own there
    left = lambda: [f for _, _, files in os.walk(tmp_path / "shared") for f in files]
    for _ in range(50):
        if not left():
            break
        time.sleep(0.1)
    assert left() == []
