"""Progress of streams as rows that can be queried."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps the last ``most`` batches: name, batch, rows in, rows a second."""

    def __init__(self, most: int = 1000):
        self.most, self.batches, self.ended = most, [], []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches = [*self.batches, (p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond)][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.id))
