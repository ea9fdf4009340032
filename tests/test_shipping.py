"""Queries with Python workers must run when Spark is started from another folder."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF_DIR = "/root/testdata/sf0.001"

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from tidemark.session import local_session
spark = local_session(2, partitions=2, memory="1g")
for name in ("evaluation_fields", "stream_frame_arrivals"):
    assert entry.queries()[name](spark, {data!r}).count() >= 0
print("shipped")
"""


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_workers_find_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=str(ROOT), data=SF_DIR)
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "shipped" in done.stdout, done.stderr[-2000:]
