"""The ledger as a keyed state machine over a stream of invocations, with the same fold as the batch.

State of a project: its head (last sequence number, counter, stems), its ledger by key, and its words.  Each batch reads
and writes only the keys that it names, however long the history.  An invocation at or before the last one seen is a
replay and does nothing.  Qualified keys keep their placeholder for ever; the counter only rises.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.naming import ROW, Ledger, Run, asked, frame, name_runs

#: Stores that keep such state need a provider that can hold more than one value a key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Kept(Ledger):
    """A project's ledger in its keyed state."""

    def __init__(self, number: int, stems: set[str], names, words) -> None:  # noqa: ANN001
        self.number, self.stems, self.by_key, self.by_word = number, stems, names, words

    def word_of(self, key: str) -> str | None:
        return self.by_key.getValue((key,))[0] if self.by_key.containsKey((key,)) else None

    def holds(self, word: str) -> bool:
        return self.by_word.containsKey((word,))

    def after(self, run: Run) -> "Kept":
        for key, (word, original) in run.fresh.items():
            if not self.by_key.containsKey((key,)):
                self.by_key.updateValue((key,), (word, original))
                self.by_word.updateValue((word,), (key,))
        return Kept(run.number, self.stems | run.stems, self.by_key, self.by_word)


class Namer(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "last long, number int, stems array<string>")
        self.names = handle.getMapState("names", "key string", "placeholder string, original string")
        self.words = handle.getMapState("words", "placeholder string", "key string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        last, number, stems = self.head.get() if self.head.exists() else (-1, 1, [])
        all_ = pd.concat(list(rows))
        new = all_[all_["seq"] > last]
        if len(new):
            out, ledger = name_runs(new, Kept(number, set(stems), self.names, self.words))
            self.head.update((int(new["seq"].max()), ledger.number, sorted(ledger.stems)))
            yield frame(out)

    def close(self) -> None:
        pass


def stream(invocations: DataFrame) -> DataFrame:
    """Placeholders as ROW for a stream of invocations, of which each micro-batch brings whole ones."""
    return asked(invocations).groupBy("project_id").transformWithStateInPandas(Namer(), ROW, "append", "none")
