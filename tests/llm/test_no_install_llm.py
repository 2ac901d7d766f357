"""The operators' queries with the package on the driver's path alone."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path[:0] = [{root!r}]
from tokenloom.session import local_session
spark = local_session(4, 4, "4g")
from tokenloom.llm.queries import QUERIES
for name in QUERIES:
    assert QUERIES[name](spark, {sf!r}).count() > 0, name
print("all ran")
"""


def test_queries_without_an_install(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
