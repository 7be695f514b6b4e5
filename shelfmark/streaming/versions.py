"""Page facts as a stream: what adds nothing new is held back, so that the log grows with changes and not with deliveries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfmark.operators.versions import FACTS


class _Newest(StatefulProcessor):
    """Per kind and id, the time and mark of the newest fact; a newer one passes and takes its place.

    Most keys have few rows, so rows are handled as they are, without a frame
    for each key, and the state is asked once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "at long, mark long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        top = max(rows, key=lambda r: (r.at, r.mark), default=None)  # one row is kept, so a crowded key needs no memory
        if top is None:
            return
        held = self.held.get()
        if held is None or (top.at, top.mark) > tuple(held):
            self.held.update((top.at, top.mark))
            yield top

    def close(self) -> None:
        pass


def newest_stream(facts: DataFrame) -> DataFrame:
    """The facts that are newer than all before them of their kind and id; needs RocksDB as state store.

    Appended to a log they give the same ``live_pages`` as all facts do, in any
    order and after any retry. ``facts`` comes from ``operators.versions.facts``.
    """
    return facts.groupBy("kind", "id").transformWithState(_Newest(), FACTS, "Append", "None")
