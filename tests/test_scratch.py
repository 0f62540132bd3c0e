from pathlib import Path
from types import SimpleNamespace

import pytest

from papyrine import scratch


def test_discard(spark):
    table = scratch.materialize(spark.range(3), "x")
    folder = Path(table._written_to.removeprefix("file://"))
    assert folder.is_dir() and table.count() == 3
    scratch.discard(table)
    scratch.discard(table)
    assert not folder.exists()


def test_no_local_folder_on_a_cluster():
    nothing = SimpleNamespace(get=lambda key, default: None)
    session = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: nothing, master=master), conf=nothing)
    with pytest.raises(ValueError):
        scratch.shared_dir(session("spark://host:7077"))
    assert scratch.shared_dir(session("local[8]")).startswith("file://")
