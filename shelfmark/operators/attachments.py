"""Images of pages: captions from a model, in batches bounded by bytes, and the attachment table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfmark.operators.filters import MAX_ATTACHMENT_BYTES, eligible_attachment
from shelfmark.operators.merge import latest_by_key, upsert
from shelfmark.operators.spread import stored

#: Gets images as bytes and returns a caption, None or an exception for each.
Captioner = Callable[[Sequence[bytes]], Sequence[object]]
BATCH_BYTES = 64 << 20
BATCH_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def caption_images(images: DataFrame, make_captioner: Callable[[], Captioner], *, data: str = "data", most: int = MAX_ATTACHMENT_BYTES,
                   batch_bytes: int = BATCH_BYTES, calls_of: int = 8) -> DataFrame:
    """All columns but the bytes, with ``caption`` and ``caption_error``, as a stored table.

    Images beyond ``most`` bytes, and null ones, are left out. Spark forms the
    batches that go to Python by rows; as no row has more than ``most`` bytes, so
    many rows that ``batch_bytes`` hold are never exceeded. The result is written
    at once: a model is asked about an image once, however often it is used.
    ``make_captioner`` runs once per task; an exception in place of a caption
    fails only its image, one that is raised fails its call's images. A blank
    caption is none.
    """
    spark = images.sparkSession
    kept = [f for f in images.schema.fields if f.name != data]
    out = T.StructType([*kept, *T.StructType.fromDDL("caption string, caption_error string").fields])
    schema, names = to_arrow_schema(out), [f.name for f in kept]

    def answers(captioner: Captioner, values: list[bytes]) -> list[object]:
        try:
            found = list(captioner(values))
            if len(found) != len(values):
                raise ValueError(f"{len(values)} images gave {len(found)} captions")
            return found
        except Exception as problem:  # noqa: BLE001 - the call's images carry it
            return [problem] * len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        captioner = make_captioner()
        for batch in batches:
            values = batch.column(len(names)).to_pylist()
            found = [a for i in range(0, len(values), calls_of) for a in answers(captioner, values[i : i + calls_of])]
            errors = [str(a) or type(a).__name__ if isinstance(a, Exception) else None for a in found]
            captions = [None if isinstance(a, Exception) or a is None or not a.strip() else a.strip() for a in found]
            columns = [*batch.columns[: len(names)], pa.array(captions, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    sized = images.where(F.octet_length(data) <= most).select(*names, data)
    before = spark.conf.get(BATCH_ROWS_CONF)
    spark.conf.set(BATCH_ROWS_CONF, max(1, batch_bytes // max(1, most)))
    try:
        return stored(sized.mapInArrow(run, out))
    finally:
        spark.conf.set(BATCH_ROWS_CONF, before)


def page_images(pages: DataFrame, attachments: DataFrame, *, data: str = "data", most: int = MAX_ATTACHMENT_BYTES) -> DataFrame:
    """Eligible images (attachment_id, page_id, filename, media_type, file_size, data) of the given pages, one row per id."""
    real = F.octet_length(data)
    usable = attachments.where(eligible_attachment(F.col("media_type"), F.col("file_size"), real, most)).join(pages.select("page_id").distinct(), "page_id", "left_semi")
    return usable.dropDuplicates(["attachment_id"])


def upsert_attachments(table: DataFrame, captioned: DataFrame) -> DataFrame:
    """The attachment table after new rows: a known id takes all of the new row, its caption too, others are added."""
    newest = latest_by_key(captioned.select(*table.columns), "attachment_id", F.struct("page_id", "filename"))
    return upsert(table, newest, "attachment_id")
