"""What a task of line dedup holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from murmullo.llm import lines


def test_table_of_lines_is_bits(spark):
    pairs = spark.createDataFrame([(3, 1, 2, 0), (9, 4, 3, 1)], "doc long, line int, to_doc long, to_line int")
    table = lines._in_question(pairs)
    assert table.nbytes == 1 << (lines.SEEN_BITS - 3)
    assert lines._asked(table, np.array([3, 2, 9, 3, 4, 1]), np.array([1, 0, 4, 0, 9, 3])).tolist() == [True, True, True, False, False, False]
    assert np.bitwise_count(table).sum() == 3


def test_texts_are_taken_a_few_at_a_time():
    texts = [f"{i} ".ljust(4000, "x") for i in range(8000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    tracemalloc.start()
    try:
        seen = [(i, len(raw)) for some in lines.parts(lines._raw(batch), batch.column("id").to_pylist()) for i, _, raw in some]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert seen == [(i, 4000) for i in range(len(texts))]
    assert most < 5 * lines.RUN_BYTES  # all texts together are 32 MB
