import os
import sys
import time
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tillstream.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="tests", master="local[4]",
        conf={
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.sql.maxMetadataStringLength": "2000",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def feed(tmp_path):
    """Write lists of lines as files whose times are a minute apart, in order."""

    def write(name, *files, start=None):
        folder = tmp_path / name
        folder.mkdir()
        base = start or time.time() - 3600
        for i, lines in enumerate(files):
            target = folder / f"part-{i:03d}.json"
            target.write_text("\n".join(lines) + "\n", encoding="utf-8")
            os.utime(target, (base + 60 * i, base + 60 * i))
        return str(folder)

    return write
