"""Order life cycles on a stream: a keyed state machine that answers each request once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.orders import ANSWERS, TRANSITIONS


class OrderMachine(StatefulProcessor):
    """Holds an order's status, and which requests it has seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")
        self.seen = handle.getMapState("seen", "request long", "step long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        status = self.status.get()[0] if self.status.exists() else "PENDING"
        out = []
        # what one batch holds of an order, which is a few steps
        for step, request, target in pd.concat(rows).sort_values("step")[["step", "request", "target"]].itertuples(index=False):
            before = status
            if self.seen.containsKey((request,)):
                outcome = "DUPLICATE_REQUEST"
            else:
                self.seen.updateValue((request,), (step,))
                outcome = "APPLIED" if target in TRANSITIONS.get(status, ()) else "INVALID_STATE_TRANSITION"
                status = target if outcome == "APPLIED" else status
            out.append((key[0], step, request, target, before, status, outcome))
        self.status.update((status,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    def close(self) -> None:
        pass


def stream_life_cycles(events: DataFrame) -> DataFrame:
    """``ANSWERS`` of a stream (or table) of ``order_id, step, request, target`` whose steps come in order; needs the RocksDB state store."""
    return events.groupBy("order_id").transformWithStateInPandas(OrderMachine(), ANSWERS, "append", "none")
