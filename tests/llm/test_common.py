"""Helpers of the corpus operators."""

import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfmark.llm import common
from shelfmark.llm.common import buffers, drawn, slices


def test_drawn_rows_are_bounded_distinct_and_the_same_for_any_layout(spark):
    frame = spark.range(5000).select((F.col("id") % 2000).alias("a"), F.lit("x").alias("b"))
    for rows in (frame, frame.repartition(7)):
        got = [r.a for r in drawn(rows, 300, ["a"]).collect()]
        assert len(got) == len(set(got)) == 300
        first = got if rows is frame else first
        assert sorted(got) == sorted(first)
    assert drawn(frame, 10_000, ["a"]).count() == 2000
    assert drawn(frame.where("a < 0"), 5, ["a"]).count() == 0


def test_buffers_of_slices_and_nulls():
    column = pa.array(["a", None, "é", ""])
    for part, want in ((column, "aé"), (column.slice(1, 2), "é"), (column.slice(3), ""), (column.slice(0, 0), "")):
        data, offsets = buffers(part)
        assert data.tobytes().decode() == want and len(offsets) == len(part) + 1 and offsets[-1] == len(data)


def test_slices_cover_all_rows_once():
    offsets = np.cumsum([0, 5, 0, 100, 1, 1, 1, 50])
    got = list(slices(offsets, 10))
    assert [a for a, _ in got][1:] == [b for _, b in got][:-1] and got[0][0] == 0 and got[-1][1] == 7


def test_tables_kept_for_another_operator_go():
    """A worker that encoded with BPE keeps its tables for BPE only, and tasks of the stages that follow let them go."""

    class Tables:
        pass

    common.kept_for("bpe")["file"] = made = Tables()
    gone = weakref.ref(made)
    del made
    assert common.kept_for("bpe")["file"] is gone()
    assert common.kept_for("near_dedup") == {} and gone() is None
    assert common.kept_for("bpe") == {}
