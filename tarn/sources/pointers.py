"""Immutable generations of tables and the pointer to the current one, on any file system Spark reaches."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Files:
    """Small files through Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._gateway, self._conf = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self._conf)

    def read(self, path: str) -> str | None:
        at, system = self._at(path)
        if not system.exists(at):
            return None
        stream = system.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Through a temporary neighbour that is renamed over the file, in one step where the store has one
        (HDFS and POSIX do), so that a reader sees the old or the new text."""
        at, system = self._at(path)
        part, _ = self._at(f"{path}.{uuid.uuid4().hex}")
        stream = system.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        qualified = system.makeQualified(at)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self._conf).rename(system.makeQualified(part), qualified, options)

    def create(self, path: str, text: str) -> bool:
        """Make a file that must not be there yet, with its whole text at once; False if it is there.

        The text is written to a neighbour that then gets the name, in a step that fails where the name is
        taken: a hard link on a local disk, a rename elsewhere (HDFS refuses one onto a file). Of any number
        of callers one succeeds, and nobody ever sees a part of the text. Stores that cannot refuse, such as
        plain object stores, are not for pointers."""
        at, system = self._at(path)
        if system.exists(at):
            return False
        system.mkdirs(at.getParent())
        at = self._jvm.org.apache.hadoop.fs.Path(system.resolvePath(at.getParent()), at.getName())  # below mount tables
        system = at.getFileSystem(self._conf)
        part = self._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
        stream = system.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if system.getUri().getScheme() != "file":
                return system.rename(part, at)
            local = [self._jvm.java.nio.file.Path.of(x.toUri().getPath(), self._gateway.new_array(self._jvm.java.lang.String, 0)) for x in (at, part)]
            try:
                self._jvm.java.nio.file.Files.createLink(*local)
            except Exception as error:  # py4j
                if "FileAlreadyExists" in str(error):
                    return False
                raise
            return True
        finally:
            system.delete(part, False)

    def delete(self, path: str) -> None:
        at, system = self._at(path)
        system.delete(at, True)

    def exists(self, path: str) -> bool:
        at, system = self._at(path)
        return system.exists(at)

    def age(self, path: str) -> float:
        """Seconds since the last change of what lies right in a folder."""
        at, system = self._at(path)
        times = [x.getModificationTime() for x in (system.getFileStatus(at), *system.listStatus(at))]
        return time.time() - max(times) / 1000

    def names(self, path: str) -> list[str]:
        """Names in a folder, without hidden ones; none if there is no such folder."""
        at, system = self._at(path)
        found = [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []
        return [x for x in found if not x.startswith(".")]


class ConcurrentChange(RuntimeError):
    """Another writer has published since this one began."""


class Generations:
    """``root/generations/generation-<id>/`` with a manifest each, and numbered pointers
    ``root/CURRENT-<number>`` of which the last one counts.

    A pointer is never changed: publishing is the creation of the next one, which only one writer can do. It
    names its generation and the one before it, so a writer that was late (its number had come and gone)
    sees that the chain passes it by. Readers skip an empty pointer, which an older version could leave, and
    the next writer passes by it after SLOW seconds."""

    SLOW = 5.0
    KEPT = 16

    def __init__(self, spark: SparkSession, root: str):
        self.files, self.root = Files(spark), root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/generations/{name}"

    def new(self) -> tuple[str, str]:
        name = f"generation-{uuid.uuid4().hex}"
        return name, self.path(name)

    def _pointer(self, number: int) -> str:
        return f"{self.root}/CURRENT-{number:010d}"

    def _numbers(self) -> list[int]:
        """Of all pointers, the last one first."""
        return sorted((int(found[1]) for name in self.files.names(self.root) if (found := re.fullmatch(r"CURRENT-(\d+)", name))), reverse=True)

    def publish(self, name: str, manifest: dict, after: str | None = None, guard: Callable[[], None] | None = None) -> None:
        """Make a generation current. One that was built from another (``after``) can be the only one to
        follow it: a second writer that began from the same one gets ConcurrentChange. ``guard`` is called
        just before and may raise."""
        self.files.write(f"{self.path(name)}/manifest.json", json.dumps(manifest | {"generation": name}, sort_keys=True))
        while True:
            last = next(iter(self._numbers()), 0)
            if last and after is not None:  # an older version's writer may be about to fill the last pointer
                began = time.monotonic()
                while not self.files.read(self._pointer(last)) and time.monotonic() - began < self.SLOW:
                    time.sleep(0.1)
                if self.current() != after:
                    raise ConcurrentChange(f"{after} is no longer current")
            if guard:
                guard()
            before = self.current() or ""
            if self.files.create(self._pointer(last + 1), f"{name} {before}"):
                later = any(number > last + 1 for number in self._numbers())
                if not later or (self.files.read(self._pointer(last + 2)) or "").split()[-1:] == [name]:
                    break
                self.files.delete(self._pointer(last + 1))  # the number was free again, long after its time
            if after is not None:
                raise ConcurrentChange(f"{after} has a successor already")
        for number in self._numbers()[self.KEPT :]:
            self.files.delete(self._pointer(number))

    def current(self) -> str | None:
        for number in self._numbers():
            name = (self.files.read(self._pointer(number)) or "").partition(" ")[0].strip()
            if name:
                if not re.fullmatch(r"generation-[0-9a-f]+", name):
                    raise ValueError(f"the pointer under {self.root} names no generation")
                return name
        return None

    def sweep(self, keep: int = 2, grace_seconds: float = 86_400.0) -> list[str]:
        """Mark and sweep: the last ``keep`` generations and those that their manifests use stay, and whatever
        was written within the grace period; others are deleted. Their names."""
        if keep < 1:
            raise ValueError("the current generation must stay")
        used: set[str] = set()
        for number in self._numbers()[:keep]:
            name = (self.files.read(self._pointer(number)) or "").partition(" ")[0]
            if name:
                used |= {name, *self.manifest(name).get("uses", ())}
        gone = [name for name in self.files.names(f"{self.root}/generations") if name not in used and self.files.age(self.path(name)) > grace_seconds]
        for name in gone:
            self.files.delete(self.path(name))
        return gone

    def manifest(self, name: str) -> dict:
        found = json.loads(self.files.read(f"{self.path(name)}/manifest.json") or "{}")
        if found.get("generation") != name:
            raise ValueError(f"the manifest of {name} is missing or belongs to another generation")
        return found
