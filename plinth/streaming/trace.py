"""Steps of one question as it is worked on: kept by trace, replayed to late listeners, and sent as server events.

This is the driver's side: steps are small records about batches. The rings
of traces inside event streams are :func:`plinth.streaming.bus.trace_history`.
"""

from __future__ import annotations

import contextlib
import contextvars
import json
import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

from plinth.streaming.bus import HISTORY, IDLE_S

#: Seconds without a step after which a stream of server events ends (fixed default).
WAIT_S = 120.0

_current: contextvars.ContextVar[str | None] = contextvars.ContextVar("plinth_trace", default=None)


class Traces:
    """The last ``keep`` steps of each trace; traces without a step for ``idle_s`` seconds and without listeners are forgotten."""

    def __init__(self, keep: int = HISTORY, idle_s: float = IDLE_S, clock: Callable[[], float] = time.monotonic) -> None:
        self.keep, self.idle_s, self.clock = keep, idle_s, clock
        self._lock = threading.Lock()
        self._rings: dict[str, deque] = {}
        self._seen: dict[str, float] = {}
        self._listeners: dict[str, list[queue.SimpleQueue]] = {}

    def publish(self, trace: str, step: dict) -> None:
        with self._lock:
            now = self.clock()
            for old in [t for t, at in self._seen.items() if now - at > self.idle_s and not self._listeners.get(t)]:
                del self._rings[old], self._seen[old]
            self._rings.setdefault(trace, deque(maxlen=self.keep)).append({**step, "trace_id": trace})
            self._seen[trace] = now
            for listener in self._listeners.get(trace, []):
                listener.put(self._rings[trace][-1])

    def history(self, trace: str) -> list[dict]:
        with self._lock:
            return list(self._rings.get(trace, []))

    def subscribe(self, trace: str) -> queue.SimpleQueue:
        """A queue that holds the steps so far and gets those to come."""
        with self._lock:
            listener: queue.SimpleQueue = queue.SimpleQueue()
            for step in self._rings.get(trace, []):
                listener.put(step)
            self._listeners.setdefault(trace, []).append(listener)
            return listener

    def unsubscribe(self, trace: str, listener: queue.SimpleQueue) -> None:
        with self._lock:
            self._listeners[trace] = [x for x in self._listeners.get(trace, []) if x is not listener]


TRACES = Traces()


@contextlib.contextmanager
def scope(trace: str) -> Iterator[None]:
    """Steps emitted inside belong to ``trace``."""
    token = _current.set(trace)
    try:
        yield
    finally:
        _current.reset(token)


def emit(stage: str, status: str = "info", worker: str = "api", message: str | None = None, traces: Traces = TRACES, **details) -> None:
    """A step of the present trace; nothing outside of a trace."""
    trace = _current.get()
    if trace is not None:
        step = {"stage": stage, "status": status, "worker": worker, "message": message, "details": details or None}
        traces.publish(trace, {k: v for k, v in step.items() if v is not None})


def frame(event: dict) -> bytes:
    return b"data: " + json.dumps(event, ensure_ascii=False, default=str).encode() + b"\n\n"


def server_events(trace: str, work: Callable[[], dict | None], wait_s: float = WAIT_S, traces: Traces = TRACES) -> Iterator[bytes]:
    """Frames of a running question: an opening one, its steps as they come, and at the end its answer or its error.

    ``work`` runs beside, under the trace. The stream ends when the work is
    done and its steps are out, or after ``wait_s`` seconds without a step,
    and then waits for the work to name its result.
    """
    result: dict = {}
    done = object()
    listener = traces.subscribe(trace)

    def run() -> None:
        try:
            with scope(trace):
                result["answer"] = work()
        except Exception as problem:
            result["error"] = str(problem)
        listener.put(done)

    worker = threading.Thread(target=run, daemon=True)
    yield frame({"stage": "trace.open", "status": "info", "worker": "api", "trace_id": trace, "message": "Trace stream opened"})
    worker.start()
    try:
        while True:
            try:
                step = listener.get(timeout=wait_s)
            except queue.Empty:
                break
            if step is done:
                break
            yield frame(step)
    finally:
        traces.unsubscribe(trace, listener)
    worker.join()
    end = {"stage": "answer.ready", "status": "end", "worker": "api", "trace_id": trace}
    if "error" in result:
        yield frame({**end, "error": result["error"]})
    elif result["answer"] is not None:
        yield frame({**end, "answer": result["answer"]})
