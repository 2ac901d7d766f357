"""Executors need no install: the package is on the driver's path alone."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path[:0] = [{root!r}]
from tokenloom.session import local_session
spark = local_session(4, 4, "4g")
from tokenloom.plans.queries import REGISTRY
def missing(batches):
    import importlib.util
    import pyarrow as pa
    found = importlib.util.find_spec("tokenloom") is not None
    yield pa.RecordBatch.from_pydict({{"found": [found]}})
assert not any(r.found for r in spark.range(1).mapInArrow(missing, "found boolean").collect())
for name in {names!r}:
    assert REGISTRY[name](spark, {sf!r}).count() > 0, name
print("all ran")
"""
NAMES = ["encode_corpus", "encode_small_head", "pack_bfd", "pack_nextfit_chained", "collate_batch", "render_tool_calls", "render_tools",
         "expectation_check", "mask_pairs", "stream_pack", "stream_pack_resumed", "render_turn_rows"]


def run_apart(script: str, folder: str) -> str:
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", script], cwd=folder, env=env, capture_output=True, text=True, timeout=400)
    return done.stdout + done.stderr[-3000:]


def test_queries_without_an_install(sf, tmp_path):
    assert "all ran" in run_apart(SCRIPT.format(root=ROOT, names=NAMES, sf=sf), str(tmp_path))
