"""What a worker holds at once does not grow with its partition."""

import tracemalloc

import numpy as np
import pyarrow as pa
from graphnom.llm import common as C
from graphnom.llm import near_dedup, quality


def test_batches_to_workers_are_bounded(spark):
    rows = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('some words ', 400) text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"])

    got = C.arrow_map(rows, sizes, "size long, n long").collect()
    assert sum(r.n for r in got) == 6000
    assert max(r.size for r in got) <= 1.1 * C.BATCH_BYTES < sum(r.size for r in got) / 4


def test_kernels_take_texts_by_small_pieces():
    rnd = np.random.default_rng(4)
    texts = [" ".join(map(str, rnd.integers(0, 5000, 500))) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([True] * len(texts))], ["text", "_trusted"])
    list(quality._count(iter([batch.slice(0, 10)])))
    tracemalloc.start()
    list(quality._count(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 3_000_000 and peak < 24_000_000


def test_small_tables_are_written_in_few_files(spark):
    rows = spark.range(0, 2000, 1, 300)
    written = C.materialise(rows)
    assert len(written.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism < 300
    assert sorted(r.id for r in written.collect()) == list(range(2000))
    large = spark.range(0, 1 << 24, 1, 60)  # 8 bytes a row: as many parts as before
    assert C.few_parts(large).rdd.getNumPartitions() == min(60, -(-large.count() * 8 // (4 << 20)))
