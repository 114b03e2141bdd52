"""Requests that run once, under leases: a folder for each key, kept beside the tables.

Attempts are numbered files, ``attempt-N`` and, when one is over, ``attempt-N.end`` with its outcome. Both
are only ever created, so an attempt has one owner and one outcome. An owner renews its lease while it
works. One that stops doing so (its process died, its machine is gone) is passed by once the lease is
over: the next caller writes the end of the attempt itself and takes the next number. The number is a
fence: whoever wakes up late finds its attempt ended and can record nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.pointers import Files


class RequestConflict(ValueError):
    """The key was used for another request, or the attempt is not under work."""


class RequestRunning(RuntimeError):
    """The same request is being worked on."""


class LeaseLost(RequestConflict):
    """Another caller took the request over."""


def request_hash(payload: dict) -> str:
    """SHA-256 of the canonical JSON: sorted keys, no blanks, characters as they are."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@dataclass(frozen=True)
class Lease:
    """One attempt at a request; ``number`` grows with each."""

    key: str
    wanted: str
    number: int
    owner: str


class Requests:
    """``lease_seconds`` after its owner's last sign of life an attempt counts as dead. Clocks of the machines
    may differ by less than that."""

    def __init__(self, spark: SparkSession, root: str, lease_seconds: float = 60.0):
        self.spark, self.files, self.root, self.lease_seconds = spark, Files(spark), f"{root.rstrip('/')}/requests", lease_seconds
        self._held: dict[str, Lease] = {}

    def _at(self, key: str, number: int, what: str = "") -> str:
        return f"{self.root}/{hashlib.sha256(key.encode()).hexdigest()}/attempt-{number:06d}{what}"

    def _last(self, key: str) -> int:
        names = self.files.names(f"{self.root}/{hashlib.sha256(key.encode()).hexdigest()}")
        return max((int(found[1]) for name in names if (found := re.fullmatch(r"attempt-(\d+)", name))), default=0)

    def _json(self, path: str) -> dict | None:
        text = self.files.read(path)
        return json.loads(text) if text else None

    def take(self, key: str, wanted: str) -> Lease | dict:
        """A lease if the caller is to work on the request, else the result that it had. Another request
        under the key raises RequestConflict, one under work RequestRunning. A request that failed, or whose
        owner shows no sign of life, goes to one caller."""
        number = self._last(key)
        if number:
            record, end = self._json(self._at(key, number)), self._json(self._at(key, number, ".end"))
            if record["request_hash"] != wanted:
                raise RequestConflict(f"key {key!r} was used for another request")
            if end and end["status"] == "completed":
                return end["result"]
            if not end:
                alive = self._json(self._at(key, number, ".lease")) or record
                if time.time() < alive["until"]:
                    raise RequestRunning(f"request {key!r} is being worked on")
                if not self._end(key, number, "expired"):  # its owner ended it just now, or another caller was faster
                    return self.take(key, wanted)
        lease = Lease(key, wanted, number + 1, uuid.uuid4().hex)
        record = {"key": key, "request_hash": wanted, "owner": lease.owner, "attempt": lease.number, "until": time.time() + self.lease_seconds}
        if not self.files.create(self._at(key, lease.number), json.dumps(record, ensure_ascii=False)):
            raise RequestRunning(f"request {key!r} is being worked on")
        return lease

    def _end(self, key: str, number: int, status: str, result: dict | None = None) -> bool:
        return self.files.create(self._at(key, number, ".end"), json.dumps({"status": status, "result": result, "at": time.time()}, ensure_ascii=False))

    def renew(self, lease: Lease) -> None:
        """A sign of life; LeaseLost if the attempt is over."""
        self.check(lease)
        self.files.write(self._at(lease.key, lease.number, ".lease"), json.dumps({"owner": lease.owner, "until": time.time() + self.lease_seconds}))

    def check(self, lease: Lease) -> None:
        if self.files.exists(self._at(lease.key, lease.number, ".end")):
            raise LeaseLost(f"request {lease.key!r} was taken over from attempt {lease.number}")

    def finish(self, lease: Lease, status: str, result: dict | None = None) -> None:
        """Record the outcome; LeaseLost if there is one already."""
        if not self._end(lease.key, lease.number, status, result):
            raise LeaseLost(f"request {lease.key!r} was taken over from attempt {lease.number}")

    def outcomes(self) -> DataFrame:
        """(key, attempt, status, at, result): what became of every attempt that is over; ``result`` is JSON text,
        null where it has none. Read by a job, however many requests there are."""
        of = "key string, attempt long, status string, at timestamp, result string"
        if not self.files.exists(self.root):
            return self.spark.createDataFrame([], of)
        files = self.spark.read.option("recursiveFileLookup", True).text(self.root, wholetext=True)
        name = F.regexp_extract("_metadata.file_path", r"/([0-9a-f]{64})/attempt-(\d+)(\.end)?$", 0)
        files = files.select("value", name.alias("name")).filter("name != ''")
        made = files.filter(~F.col("name").endswith(".end")).select("name", F.get_json_object("value", "$.key").alias("key"), F.get_json_object("value", "$.attempt").cast("long").alias("attempt"))
        ended = files.filter(F.col("name").endswith(".end")).select(
            F.regexp_replace("name", r"\.end$", "").alias("name"), F.get_json_object("value", "$.status").alias("status"),
            F.timestamp_millis((F.get_json_object("value", "$.at").cast("double") * 1000).cast("long")).alias("at"), F.get_json_object("value", "$.result").alias("result"),
        )
        return made.join(ended, "name").select("key", "attempt", "status", "at", "result")

    # the same for a caller that keeps no lease of its own

    def claim(self, key: str, wanted: str) -> dict | None:
        """None if the caller is to work on the request, else the result it had; see ``take``."""
        taken = self.take(key, wanted)
        if isinstance(taken, Lease):
            self._held[key] = taken
            return None
        return taken

    def complete(self, key: str, wanted: str, result: dict) -> None:
        self._close(key, wanted, "completed", result)

    def fail(self, key: str, wanted: str) -> None:
        self._close(key, wanted, "failed", None)

    def _close(self, key: str, wanted: str, status: str, result: dict | None) -> None:
        lease = self._held.pop(key, None)
        if lease is None or lease.wanted != wanted:
            raise RequestConflict(f"request {key!r} is not under work")
        self.finish(lease, status, result)

    def once(self, key: str, payload: dict, work: Callable[..., dict], fenced: bool = False) -> dict:
        """The result of ``work``, run unless the key already has one for this payload. The lease is renewed
        beside it. With ``fenced``, ``work`` gets a function that raises LeaseLost when it is no longer its
        turn, to be called before anything is published."""
        taken = self.take(key, request_hash(payload))
        if not isinstance(taken, Lease):
            return taken
        over = threading.Event()

        def beat() -> None:
            while not over.wait(self.lease_seconds / 3):
                try:
                    self.renew(taken)
                except LeaseLost:
                    return
                except Exception:  # noqa: BLE001  the store is out of reach; the next beat may get through
                    continue

        threading.Thread(target=beat, daemon=True).start()
        try:
            result = work(lambda: self.check(taken)) if fenced else work()
        except BaseException:
            over.set()
            self._end(key, taken.number, "failed")
            raise
        over.set()
        self.finish(taken, "completed", result)
        return result
