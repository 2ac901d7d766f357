"""Times the headline queries and prints one JSON line.

The dictionary is built once, by ``vocab_build``; queries that encode read the stored one, so each
figure is that of its own operator. Tokens, tokens per second and packing utilization come along.
"""

from __future__ import annotations

import json
import os
import sys
import time

import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tokenloom.plans.queries import REGISTRY, _stored_dictionary  # noqa: E402
from tokenloom.session import local_session  # noqa: E402
from tokenloom.staging import staging_area  # noqa: E402

HEADLINE = [
    "scan_text", "jsonl_strict", "pretokenize", "vocab_build", "encode_corpus", "chunk_documents",
    "pack_windows", "pack_nextfit", "pack_bfd", "pack_padded", "collate_batch", "mask_pairs",
    "step_plan", "sft_format", "render_chat", "render_tool_calls",
]
TOKEN_QUERIES = ["vocab_build", "encode_corpus", "chunk_documents", "pack_padded", "collate_batch"]


def _warm_up(spark, cpus: int) -> None:
    """Start the JVM's and the Python workers once, so that the first query does not pay for it."""
    @F.arrow_udf("long")
    def same(x: pa.Array) -> pa.Array:
        return x

    spark.range(0, 1_000_000, 1, cpus).select(same("id").alias("id")).agg(F.sum("id")).collect()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    _warm_up(spark, cpus)
    times: dict[str, float] = {}
    with staging_area(spark):
        for name in sys.argv[1:] or HEADLINE:
            if name in TOKEN_QUERIES[1:] or name == "mask_pairs":
                _stored_dictionary(spark, sf_dir)
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        tokens = REGISTRY["encode_corpus"](spark, sf_dir).agg(F.sum("n")).first()[0]
        packed = {r.strategy: round(r.utilization, 4) for r in REGISTRY["pack_compare"](spark, sf_dir).collect()}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "tokens": tokens,
        "tokens_per_sec": {n: round(tokens / times[n]) for n in TOKEN_QUERIES if n in times}, "utilization": packed,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
