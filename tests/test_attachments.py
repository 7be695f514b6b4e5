"""Captions: bounded batches, failures of one image or one call, the attachment table."""

from pyspark.sql import functions as F

from shelfmark.operators import attachments as at


def make_model(calls_fail):
    def make():
        def caption(images):
            if any(i == calls_fail for i in images):
                raise RuntimeError("down")
            return [ValueError("bad") if i == b"bad" else None if i == b"none" else f" {len(i)} in a call of {len(images)} " for i in images]

        return caption

    return make


def images(spark, values):
    return spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "attachment_id long, data binary, caption_of string")


def test_captions_and_failures(spark):
    values = [b"bad", b"none", b"abc", None, b"", b"x" * 50, b"down"]
    found = {r.attachment_id: r for r in at.caption_images(images(spark, values).coalesce(1), make_model(b"down"), most=40, calls_of=4).collect()}
    assert sorted(found) == [0, 1, 2, 4, 6]  # no null, none beyond the bound
    assert (found[0].caption, found[0].caption_error) == (None, "bad") and (found[1].caption, found[1].caption_error) == (None, None)
    assert found[2].caption == "3 in a call of 4" and found[6].caption_error == "down"
    assert "data" not in found[2].asDict() and found[2].caption_of == "x"


def test_batches_are_bounded_by_bytes(spark):
    def make():
        return lambda values: [str(len(values))] * len(values)

    before = spark.conf.get(at.BATCH_ROWS_CONF)
    many = images(spark, [b"x" * 100] * 50).coalesce(1)
    found = at.caption_images(many, make, most=100, batch_bytes=700, calls_of=1000)
    assert max(int(r.caption) for r in found.collect()) == 7 and found.count() == 50
    assert spark.conf.get(at.BATCH_ROWS_CONF) == before


def test_table(spark):
    shape = "attachment_id string, page_id long, filename string, caption string"
    old = spark.createDataFrame([("a", 1, "old", "old"), ("b", 1, "old", "old")], shape)
    new = spark.createDataFrame([("a", 1, "new", None), ("c", 2, "new", "new"), ("c", 2, "new", "new")], shape)
    rows = {r.attachment_id: tuple(r)[1:] for r in at.upsert_attachments(old, new).collect()}
    assert rows == {"a": (1, "new", None), "b": (1, "old", "old"), "c": (2, "new", "new")}
    assert at.upsert_attachments(old, new.limit(0)).count() == 2
    files = new.withColumns({"media_type": F.lit("image/png"), "file_size": F.lit(3), "data": F.lit(b"abc")})
    pages = spark.createDataFrame([(2,), (2,)], "page_id long")
    assert [r.attachment_id for r in at.page_images(pages, files).collect()] == ["c"]
