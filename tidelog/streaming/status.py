"""The ordered channel on which a shard's worker reports: progress that only counts when new, barriers that must arrive, heartbeats."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class StatusChannel:
    """One slot of each kind. A newer report takes an older one's slot; a barrier is tried again, later each time, until it
    arrives or a newer one supersedes it, and goes before progress. If there is nothing to say for a while, a heartbeat is sent.
    """

    def __init__(self, send: Callable[[tuple], None], heartbeat_s: float = 30.0, base_s: float = 0.5, most_s: float = 30.0, sleep: Callable[[float], None] = time.sleep):
        self.send, self.heartbeat_s, self.base_s, self.most_s, self.sleep = send, heartbeat_s, base_s, most_s, sleep
        self.ready, self.slots, self.tries = threading.Condition(), {}, 0

    def put(self, kind: str, report) -> None:
        with self.ready:
            self.slots[kind] = report
            self.ready.notify()

    def barrier(self, report) -> None:
        with self.ready:
            self.tries = 0
            self.slots["barrier"] = report
            self.ready.notify()

    def step(self) -> None:
        """Send one thing: a waiting barrier, else progress, else a heartbeat when the time is over."""
        with self.ready:
            if not self.slots:
                self.ready.wait(self.heartbeat_s)
            kind = "barrier" if "barrier" in self.slots else next(iter(self.slots), "heartbeat")
            report = self.slots.pop(kind, None)
        try:
            self.send((kind, report))
        except Exception:
            if kind != "barrier":
                return  # the next one says as much
            with self.ready:
                self.slots.setdefault("barrier", report)
                self.tries += 1
                pause = min(self.base_s * 2 ** (self.tries - 1), self.most_s)
            self.sleep(pause)

    def run(self, stop: threading.Event) -> None:
        while not stop.is_set():
            self.step()
