"""Python memory of a blob task: payloads of a batch are held a few at a time."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pyarrow.parquet as pq

from snapplan.operators import blobs


def test_a_blob_task_holds_less_than_its_batch(tmp_path):
    n, size = 16_000, 8_192
    rows = pa.RecordBatch.from_pydict({
        "path": [f"/f{i}" for i in range(n)], "dest": [f"f{i}" for i in range(n)], "hash": [f"{i:032x}" for i in range(n)],
        "size": [size] * n, "ext": [""] * n, "shard": ["0"] * n, "block": pa.array([0] * n, pa.int32()),
        "n_blocks": pa.array([1] * n, pa.int32()), "start": [0] * n, "length": [size] * n,
        "content": [bytes([i % 251]) * size for i in range(n)]})
    writer = blobs.BlobWriter({"path": str(tmp_path / "table"), "commit": "c"})
    tracemalloc.start()
    try:
        done = writer.write(iter([rows]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.6 * blobs.HELD_BYTES + 16e6 < n * size
    writer.commit([done])
    assert pq.read_table(tmp_path / "table/commit=c/shard=0", partitioning=None).num_rows == n
