"""Sparse checkouts of a local repository."""

import subprocess

import pytest

from tarn.sources.checkout import checkout


@pytest.fixture
def origin(tmp_path):
    at = tmp_path / "origin"
    for name in ("docs/en/a.md", "docs/zh/b.md", "src/c.py"):
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(name)
    for words in (["init", "-q"], ["add", "."], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x"], ["config", "uploadpack.allowFilter", "true"]):
        subprocess.run(["git", "-C", str(at), *words], check=True)
    return f"file://{at}"


def test_checkout(tmp_path, origin):
    folder = tmp_path / "copy" / "here"
    first = checkout(origin, str(folder), ["docs/en"])
    assert (folder / "docs/en/a.md").exists() and not (folder / "docs/zh").exists() and first.origin == origin and len(first.commit) == 40
    assert checkout(origin, str(folder), ["docs/en", "docs/zh"]) == first and (folder / "docs/zh/b.md").exists()
    (folder / "docs/en/a.md").write_text("changed")
    with pytest.raises(RuntimeError):
        checkout(origin, str(folder), ["src"])
    with pytest.raises(ValueError):
        checkout(origin + "x", str(folder), ["docs/en"])
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "x").write_text("x")
    with pytest.raises(FileExistsError):
        checkout(origin, str(tmp_path / "full"), ["docs"])
