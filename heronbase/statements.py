"""Handles of statements, the history of queries, and warehouses that exist by name only."""

from __future__ import annotations

import atexit
import json
import threading
import time
import uuid
import weakref
from collections import deque
from dataclasses import dataclass, field

from heronbase.errors import AlreadyExists, InvalidValue, NotFound
from heronbase.sources.catalog import upper

PENDING, RUNNING, SUCCESS, FAILED, CANCELED = "pending", "running", "success", "failed", "canceled"


@dataclass
class Handle:
    id: str
    sql: str
    session: str = ""
    status: str = PENDING
    result: object = None
    error: Exception | None = None
    created_at: float = field(default_factory=time.time)
    ended_at: float | None = None


class Statements:
    """A bounded memory of statements: those that ended are forgotten after ``ttl`` seconds."""

    def __init__(self, spark=None, ttl: float = 3600):
        self.spark, self.ttl, self.lock = spark, ttl, threading.Lock()
        self.held: dict[str, Handle] = {}

    def create(self, sql: str, session: str = "") -> Handle:
        self.cleanup()
        h = Handle("01" + str(uuid.uuid4())[:32], sql, session)
        with self.lock:
            self.held[h.id] = h
        return h

    def get(self, id: str) -> Handle:
        found = self.held.get(id)
        if not found:
            raise NotFound(f"statement {id} does not exist")
        return found

    def _move(self, id: str, status: str, **more) -> Handle:
        with self.lock:
            h = self.held[id]
            if h.status in (SUCCESS, FAILED, CANCELED):
                return h
            h.status = status
            for k, v in more.items():
                setattr(h, k, v)
            if status not in (PENDING, RUNNING):
                h.ended_at = time.time()
            return h

    def running(self, id: str) -> Handle:
        return self._move(id, RUNNING)

    def succeeded(self, id: str, result: object) -> Handle:
        return self._move(id, SUCCESS, result=result)

    def failed(self, id: str, error: Exception) -> Handle:
        return self._move(id, FAILED, error=error)

    def cancel(self, id: str) -> Handle:
        """Stops the statement's Spark jobs, which carry its handle as tag."""
        h = self.get(id)
        if h.status in (PENDING, RUNNING):
            self._move(id, CANCELED)
            if self.spark:
                self.spark.interruptTag(id)
        elif h.status != CANCELED:
            raise InvalidValue(f"statement {id} has ended")
        return h

    def cleanup(self) -> int:
        limit = time.time() - self.ttl
        with self.lock:
            old = [k for k, h in self.held.items() if h.ended_at and h.ended_at < limit]
            for k in old:
                del self.held[k]
        return len(old)


@dataclass
class Entry:
    id: str
    session_id: str
    query_id: str
    sql_text: str
    status: str
    rows_affected: int = 0
    execution_time_ms: int = 0
    error_message: str = ""
    started_at: float = 0.0
    completed_at: float | None = None


class History:
    """Queries that ran, newest first.

    The last ``MOST`` stay in memory.  With a store, those that ended are written beside
    the catalog, ``BATCH`` at a time and at the end of the process, in files named after
    their first and last start; so they outlive it, and engines on one warehouse see each
    other's.  ``clear`` removes whole files.
    """

    COLUMNS = "id string, session_id string, query_id string, sql_text string, status string, rows_affected long, execution_time_ms long, error_message string, started_at double, completed_at double"
    MOST, BATCH = 10_000, 64

    def __init__(self, store=None):
        self.store, self.lock = store, threading.Lock()
        self.entries: deque[Entry] = deque(maxlen=self.MOST)
        self.waiting: list[Entry] = []
        self.own: set[str] = set()
        if store:
            atexit.register(_flushed(weakref.ref(self)))

    def start(self, session: str, sql: str) -> Entry:
        e = Entry(str(uuid.uuid4()), session, str(uuid.uuid4()), sql, "RUNNING", started_at=time.time())
        with self.lock:
            self.entries.append(e)
        return e

    def end(self, e: Entry, rows: int = 0, error: Exception | None = None) -> None:
        e.completed_at = time.time()
        e.execution_time_ms = int(1000 * (e.completed_at - e.started_at))
        e.status, e.rows_affected, e.error_message = ("FAILED", 0, str(error)) if error else ("SUCCESS", rows, "")
        if self.store:
            with self.lock:
                self.waiting.append(e)
                full = len(self.waiting) >= self.BATCH
            if full:
                self.flush()

    def flush(self) -> None:
        """Writes what has ended and is not written yet."""
        with self.lock:
            batch, self.waiting = self.waiting, []
        if batch and self.store:
            times = [e.started_at for e in batch]
            name = f"{min(times):.6f}-{max(times):.6f}-{uuid.uuid4().hex}.json"
            self.store.write("".join(json.dumps(vars(e)) + "\n" for e in batch).encode(), "history", name)
            self.own.add(name)

    def _files(self) -> list[tuple[float, str]]:
        """Last start and name of the files, newest first."""
        if not self.store:
            return []
        return sorted(((float(n.split("-")[1]), n) for n, _ in self.store.files("history") if n.endswith(".json") and not n.startswith(".")), reverse=True)

    def list(self, session: str | None = None, limit: int = 100) -> list[Entry]:
        limit = limit if limit > 0 else 100
        fits = lambda e: session is None or e.session_id == session
        with self.lock:
            found = {e.id: e for e in self.entries if fits(e)}
        for last, name in self._files():
            newest = sorted((e.started_at for e in found.values()), reverse=True)
            if len(newest) >= limit and newest[limit - 1] > last:
                break
            if name in self.own and len(self.entries) < self.MOST:
                continue
            for line in self.store.read("history", name).decode().splitlines():
                e = Entry(**json.loads(line))
                if fits(e):
                    found.setdefault(e.id, e)
        return sorted(found.values(), key=lambda e: e.started_at, reverse=True)[:limit]

    def clear(self, older_than: float) -> int:
        """Forgets queries that began earlier; of written files those that are wholly older."""
        self.flush()
        gone: set[str] = set()
        for last, name in self._files():
            if last < older_than:
                gone |= {json.loads(x)["id"] for x in self.store.read("history", name).decode().splitlines()}
                self.store.delete("history", name)
        with self.lock:
            gone |= {e.id for e in self.entries if e.started_at < older_than}
            self.entries = deque((e for e in self.entries if e.id not in gone), maxlen=self.MOST)
        return len(gone)

    def frame(self, spark, session: str | None = None, limit: int = 100):
        return spark.createDataFrame([tuple(vars(e).values()) for e in self.list(session, limit)], self.COLUMNS)


def _flushed(ref):
    """Flushes a history that is still alive, if its store still is."""

    def run() -> None:
        try:
            if history := ref():
                history.flush()
        except Exception:  # the session may be gone already
            pass

    return run


SIZES = ("X-SMALL", "SMALL", "MEDIUM", "LARGE", "X-LARGE", "2X-LARGE", "3X-LARGE", "4X-LARGE", "5X-LARGE", "6X-LARGE")


@dataclass
class Warehouse:
    name: str
    size: str = "X-SMALL"
    state: str = "SUSPENDED"
    auto_suspend: int = 600
    auto_resume: bool = True
    comment: str = ""
    created_at: float = field(default_factory=time.time)


class Warehouses:
    def __init__(self):
        self.held: dict[str, Warehouse] = {}
        self.lock = threading.Lock()

    def create(self, name: str, size: str = "", auto_suspend: int | None = None, auto_resume: bool | None = None, comment: str = "") -> Warehouse:
        name, size = upper(name), (size or "X-SMALL").upper()
        if size not in SIZES:
            raise InvalidValue(f"no such size: {size}")
        with self.lock:
            if name in self.held:
                raise AlreadyExists(f"warehouse {name} already exists")
            self.held[name] = Warehouse(name, size, auto_suspend=600 if auto_suspend is None else auto_suspend, auto_resume=True if auto_resume is None else auto_resume, comment=comment)
            return self.held[name]

    def get(self, name: str) -> Warehouse:
        if upper(name) not in self.held:
            raise NotFound(f"warehouse {name} does not exist")
        return self.held[upper(name)]

    def resume(self, name: str) -> Warehouse:
        w = self.get(name)
        w.state = "STARTED"
        return w

    def suspend(self, name: str) -> Warehouse:
        w = self.get(name)
        w.state = "SUSPENDED"
        return w

    def drop(self, name: str) -> None:
        self.get(name)
        with self.lock:
            del self.held[upper(name)]

    def list(self) -> list[Warehouse]:
        return sorted(self.held.values(), key=lambda w: w.name)
