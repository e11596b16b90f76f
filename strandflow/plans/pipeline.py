"""Pipelines: named streams, sinks, side tasks and status."""

from __future__ import annotations

import inspect
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Observation
from pyspark.sql import functions as F

from .. import errors as E
from ..stream import Stream


class State(Enum):
    WAITING = "Waiting"
    RUNNING = "Running"
    SUCCESS = "Success"
    ERROR = "Error"


@dataclass
class NodeStatus:
    """A node's state and the records that passed its observed ports."""

    name: str
    inputs: tuple[str, ...] = ()
    state: State = State.WAITING
    records: dict[str, int] = field(default_factory=dict)
    error: str | None = None
    #: Where the node was declared: file and line.
    site: str | None = None


class ThreadControl:
    """Tells a background task when the regular ones have ended."""

    def __init__(self) -> None:
        self._event = threading.Event()

    @property
    def interrupted(self) -> bool:
        return self._event.is_set()

    def wait_until_interrupted(self, timeout: float | None = None) -> bool:
        return self._event.wait(timeout)


class Pipeline:
    """A graph under construction: each named stream is consumed exactly once, and sinks run together."""

    def __init__(self, variables: dict[str, str] | None = None):
        self.variables = dict(variables or {})
        self._streams: dict[str, Stream] = {}
        self._taken: set[str] = set()
        self._sinks: list[tuple[NodeStatus, Callable[[], Any], list[tuple[str, Observation]]]] = []
        self._tasks: list[tuple[NodeStatus, Callable[[ThreadControl], Any], bool]] = []
        self.nodes: dict[str, NodeStatus] = {}
        self.edges: list[tuple[str, str]] = []

    def name(self, name: str, stream: Stream) -> None:
        if name in self._streams:
            raise E.StreamAlreadyExists(f"stream `{name}` already exists")
        self._streams[name] = stream

    def take(self, name: str) -> Stream:
        if name not in self._streams:
            raise E.StreamNotFound(f"stream `{name}` not found")
        if name in self._taken:
            raise E.InputAlreadyDerived(f"stream `{name}` is already connected")
        self._taken.add(name)
        return self._streams[name]

    def _node(self, name: str, inputs: tuple[str, ...]) -> NodeStatus:
        if name in self.nodes:
            raise E.Other(f"node `{name}` already exists")
        caller = inspect.stack()[2]
        status = self.nodes[name] = NodeStatus(name, inputs, site=f"{caller.filename}:{caller.lineno}")
        self.edges += [(i, name) for i in inputs]
        return status

    def sink(self, name: str, body: Callable[..., Any], *streams: Stream) -> None:
        """``body`` gets the streams when the pipeline runs; their records are counted as they pass."""
        watched, seen = [], []
        for n, s in enumerate(streams):
            seen.append((f"in{n}", Observation(f"{name}_{n}_{id(s)}")))
            watched.append(Stream(s.df.observe(seen[-1][1], F.count(F.lit(1)).alias("records")), s.facts, s.name))
        status = self._node(name, tuple(s.name for s in streams))
        self._sinks.append((status, lambda: body(*watched), seen))

    def execute(self, name: str, body: Callable[[ThreadControl], Any], background: bool = False) -> None:
        """A side task; a background one is interrupted when all others have ended."""
        self._tasks.append((self._node(name, ()), body, background))

    def run(self) -> dict[str, Any]:
        """Runs sinks and tasks concurrently; results by name. The first error is raised after all have ended."""
        if left := set(self._streams) - self._taken:
            raise E.StreamNotFound(f"dangling streams: {sorted(left)}")
        control, results, failed = ThreadControl(), {}, []

        def guard(status: NodeStatus, call: Callable[[], Any], seen=()) -> None:
            status.state = State.RUNNING
            try:
                results[status.name] = call()
                status.state = State.SUCCESS
                for port, o in seen:
                    status.records[port] = o.get.get("records", 0) if _ready(o) else 0
            except Exception as cause:
                status.state, status.error = State.ERROR, str(cause)
                cause.add_note(f"in node `{status.name}`" + (f", declared at {status.site}" if status.site else ""))
                failed.append(cause)

        regular = [threading.Thread(target=guard, args=(s, b, seen)) for s, b, seen in self._sinks]
        regular += [threading.Thread(target=guard, args=(s, lambda b=b: b(control))) for s, b, background in self._tasks if not background]
        side = [threading.Thread(target=guard, args=(s, lambda b=b: b(control))) for s, b, background in self._tasks if background]
        for t in regular + side:
            t.start()
        for t in regular:
            t.join()
        control._event.set()
        for t in side:
            t.join()
        if failed:
            raise failed[0]
        return results

    def to_dot(self) -> str:
        """The graph in Graphviz' language."""
        lines = [f'  "{a}" -> "{b}";' for a, b in self.edges]
        return "digraph pipeline {\n" + "\n".join([*(f'  "{n}";' for n in self.nodes), *lines]) + "\n}"


def _ready(observation: Observation) -> bool:
    return getattr(observation, "_jo", None) is not None and observation._jo.future().isCompleted()


def monitor(path: str = "monitor.csv", every: float = 1.0, spark: Any = None) -> Callable[[ThreadControl], None]:
    """A background task that writes memory to a CSV file once a period; the file starts anew with each run.

    Resident and swapped memory are the driver's Python; ``memory_object`` and ``memory_wrapped`` are the heap that the JVM of ``spark``
    uses and has reserved (0 without a session).
    """

    def body(control: ThreadControl) -> None:
        with open(path, "w") as out:
            out.write("Timestamp,memory_rss,memory_swap,memory_object,memory_wrapped\n")
            while True:
                held = dict.fromkeys(("VmRSS", "VmSwap"), 0)
                with open("/proc/self/status") as status:
                    for line in status:
                        key, _, rest = line.partition(":")
                        if key in held:
                            held[key] = int(rest.split()[0]) * 1024
                heap = (0, 0)
                if spark is not None:
                    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
                    heap = (runtime.totalMemory() - runtime.freeMemory(), runtime.totalMemory())
                out.write(f"{time.time():.0f},{held['VmRSS']},{held['VmSwap']},{heap[0]},{heap[1]}\n")
                out.flush()
                if control.wait_until_interrupted(every):
                    return

    return body
