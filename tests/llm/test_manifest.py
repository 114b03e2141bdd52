"""Merkle manifests against a plain tree; blocks small enough for several rounds."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tarn.llm import manifest

OF = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, for each node its path: what lies left and right of it, level by level)."""
    paths, at = [[] for _ in nodes], [*range(len(nodes))]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % 3
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes, at = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0] if nodes else None, paths


def expected(rows, changed=lambda row: row):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    parts = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in parts[s]]) for s in sources}
    root, above = tree([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above):
        for r, path in zip(parts[s], trees[s][1]):
            digest = leaf(changed(r))
            for left, right in path + up:
                digest = sha(left + digest + right)
            out.append((leaf(r), trees[s][0], root, sha("".join(a + b for a, b in path + up)), digest, digest == root))
    return sorted(out)


def got(frame, **options):
    rows = manifest.merkle_manifest(frame, COLUMNS, ["doc_id"], **options).collect()
    return sorted((r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in rows)


def corpus(n, sources, seed=1):
    rng = random.Random(seed)
    return [(i * 3, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "é\n", f"line\n{i}"])) for i in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_trees_of_several_rounds(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    rows = corpus(130, ["hot"] * 60 + [None, "", "one", "é", "𝒳"] + [f"s{i}" for i in range(9)])
    frame = spark.createDataFrame(rows, OF).repartition(5)
    assert got(frame) == expected(rows) and all(r[-1] for r in got(frame))


def test_a_changed_text_does_not_verify(spark):
    rows = corpus(60, ["a", "b"])
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    result = got(spark.createDataFrame(rows, OF), against=manifest.leaf([*(F.col(c) for c in COLUMNS[:-1]), text]))
    assert result == expected(rows, lambda r: (*r[:4], r[4].replace("\n", "") if r[4] is not None and r[0] % 2 == 0 else r[4]))
    assert {r[-1] for r in result} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_one_source_of_any_size(spark, n):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(n)]
    assert got(spark.createDataFrame(rows, OF)) == expected(rows)


def test_nulls_ties_repeats_long_texts_and_clashing_names(spark):
    rows = [(None, None, None, None, None)] * 40 + [(None, "s", "en", 1, "x")] * 7 + [(5, "s", "en", 1, "a"), (5, "s", "en", 1, "b"), (6, "s", "en", 3, "w" * 300_000)]
    assert got(spark.createDataFrame(rows, OF).repartition(6)) == expected(rows)
    clash = spark.createDataFrame([(*r, "kept", 1) for r in rows], OF + ", path string, node int")
    kept = manifest.merkle_manifest(clash, COLUMNS, ["doc_id", "path", "node"]).collect()
    assert {(r["path"], r["node"]) for r in kept} == {("kept", 1)} and len(kept) == len(rows)


def test_order_of_the_input_does_not_matter(spark):
    rows = corpus(50, ["a", "b", None])
    frames = [spark.createDataFrame(r, OF).repartition(n) for r, n in ((rows, 1), (rows[::-1], 6))]
    assert got(frames[0]) == got(frames[1])


def test_plan_has_no_python(spark, capsys):
    manifest.merkle_manifest(spark.createDataFrame(corpus(5, ["a"]), OF), COLUMNS, ["doc_id"]).explain()
    assert "Python" not in capsys.readouterr().out
