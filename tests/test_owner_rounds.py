"""Parts of a parent are never counted before their labels have settled."""

import pytest

from lamella.operators import owners


def test_raises_where_rounds_run_out(spark):
    rows = [("s", 1, y, x) for y in range(12) for x in (range(9) if y % 2 == 0 else [0 if y % 4 == 1 else 8])]
    frame = spark.createDataFrame(rows, "section_id string, parent_id long, y int, x int")
    assert [r.parts for r in owners.parts(frame).collect()] == [1]
    with pytest.raises(RuntimeError):
        owners.parts(frame, rounds=1)
