"""A corpus as a shallow, sparse Git checkout on the driver's disk; Spark reads the folder afterwards."""

from __future__ import annotations

import subprocess
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Checkout:
    folder: str
    origin: str
    commit: str


def _git(folder: Path | None, *words: str) -> str:
    where = ["-C", str(folder)] if folder else []
    done = subprocess.run(["git", *where, *words], capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {words[0]} failed: {done.stderr.strip()[-300:]}")
    return done.stdout.strip()


def inspect(folder: str) -> Checkout:
    at = Path(folder)
    return Checkout(folder, _git(at, "remote", "get-url", "origin"), _git(at, "rev-parse", "HEAD"))


def checkout(url: str, folder: str, paths: Sequence[str]) -> Checkout:
    """Clone ``url`` with only ``paths``, or take the checkout that is there. Paths missing from one are
    added if it has no changes of its own; a folder with other content raises FileExistsError, one with
    another origin ValueError."""
    at = Path(folder)
    if not (at / ".git").exists():
        if at.exists() and any(at.iterdir()):
            raise FileExistsError(f"{folder} holds something else")
        at.parent.mkdir(parents=True, exist_ok=True)
        _git(None, "clone", "--quiet", "--depth", "1", "--filter=blob:none", "--sparse", url, str(at))
    elif inspect(folder).origin != url:
        raise ValueError(f"{folder} is a checkout of another repository")
    if not all((at / p).exists() for p in paths):
        if _git(at, "status", "--porcelain"):
            raise RuntimeError(f"{folder} has changes; paths can't be added")
        _git(at, "sparse-checkout", "set", *paths)
    return inspect(folder)
