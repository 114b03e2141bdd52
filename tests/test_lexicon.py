"""Han words: dictionary against plain counts, the best path against all paths, search terms, a whole search."""

import itertools
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.operators import blocks, bm25, lexicon
from tarn.plans.engine import Engine
from tarn.plans.settings import Settings

WORDS = ["数据", "数据库", "请求", "请求体", "模型", "参数", "路径", "返回", "响应", "任务"]


def sentences(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))) + rng.choice(["。", " json ", "，", ""]) for _ in range(n)]


def test_strings_against_plain_counts(spark):
    texts = [*sentences(60), None, "", "abc 字", "的" * 30]
    found = lexicon.string_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), "text")
    want = Counter()
    for t in texts:
        for run in "".join(c if "一" <= c <= "鿿" else " " for c in t or "").split():
            want.update(run[i : i + k] for k in range(1, 6) for i in range(len(run) - k + 1))
    counts = {r["gram"]: r["n"] for r in found.collect()}
    assert counts == want
    total = sum(n for g, n in counts.items() if len(g) == 1)
    judged = {r["gram"]: r for r in lexicon.judged_strings(found, min_count=3).collect()}
    assert set(judged) == {g for g, n in counts.items() if 2 <= len(g) <= 4 and n >= 3}
    for g, r in judged.items():
        n = counts[g]
        assert r["cohesion"] == pytest.approx(min(math.log(n * total / (counts[g[:i]] * counts[g[i:]])) for i in range(1, len(g))), abs=1e-8)
        sides = [[c for x, c in counts.items() if len(x) == len(g) + 1 and (x[1:] if left else x[:-1]) == g] for left in (True, False)]
        entropy = [-sum(c / n * math.log(c / n) for c in s + [1] * (n - sum(s))) for s in sides]
        assert r["freedom"] == pytest.approx(min(entropy), abs=1e-8)


def test_the_words_come_out_of_the_corpus(spark):
    frame = spark.createDataFrame([(t,) for t in sentences()], "retrieval_text string")
    words = {r["word"]: r["n"] for r in lexicon.build(frame, min_cohesion=1.0).collect()}
    assert {w for w in words if len(w) == 2} == {w for w in WORDS if len(w) == 2} and {w for w in words if len(w) == 1} == set("".join(WORDS))
    own = {r["word"]: r["n"] for r in lexicon.build(frame, more=[("不在", 7), ("数据", 9)], max_words=3).collect()}
    assert own["不在"] == 7 and own["数据"] == 9 and sum(len(w) > 1 for w in own) <= 5


def paths(run, known, longest):
    """All ways to cut a run into single characters and known words."""
    if not run:
        yield []
    for k in range(1, min(longest, len(run)) + 1):
        if k == 1 or run[:k] in known:
            for rest in paths(run[k:], known, longest):
                yield [run[:k], *rest]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("甲乙丙丁", min_size=1, max_size=4), st.integers(1, 50), max_size=12), st.text("甲乙丙丁戊", max_size=9))
def test_the_best_path_against_all_paths(counts, run):
    made = lexicon.Lexicon(counts, 1 + sum(n for w, n in counts.items() if len(w) == 1))
    weight = lambda path: sum(math.log(counts[w] / made.total) if w in counts else math.log(0.5 / made.total) for w in path)
    best = max(paths(run, counts, made.longest), key=lambda p: (round(weight(p), 9), [len(w) for w in p]))
    assert made.cut(run) == best


def test_search_terms():
    made = lexicon.Lexicon({"数据": 9, "数据库": 5, "据库": 1, "连接": 4, "数": 9, "据": 9, "库": 6}, 100)
    assert made("数据库连接") == ["数据", "据库", "数据库", "连接"]
    assert made("新数据库") == ["新", "数据", "据库", "数据库"]
    assert made("未知的事") == ["未知", "知的", "的事"] and made("") == []
    assert made.version != lexicon.Lexicon({"数据": 9}, 100).version


CASE = [("请求体", "使用 Pydantic 模型让接口接收 JSON 对象。"), ("OAuth2", "OAuth2PasswordBearer 从 HTTP 请求头读取 Bearer Token。"), ("后台任务", "BackgroundTasks 可以在返回响应以后执行任务。")]


@pytest.mark.parametrize("more", [(), (("接口", 5), ("接收", 5), ("对象", 5), ("请求", 9), ("请求体", 5))])
def test_identifiers_words_and_what_is_not_there(spark, more):
    """Three chunks as users know them: an identifier, a question in words, and one that nothing answers."""
    chunks = spark.createDataFrame([(i, f"[文档：BM25 测试]\n[章节：{h}]\n{t}") for i, (h, t) in enumerate(CASE)], "chunk_id long, retrieval_text string")
    queries = spark.createDataFrame([(0, "OAuth2PasswordBearer"), (1, "接口接收 JSON 对象"), (2, "绝对不存在的独特词条 xyznotfound")], "query_id long, query string")
    own = lexicon.lexicon_of(lexicon.build(chunks, more=more))
    assert {"接口", "接收", "对象"} <= set(own("怎样让接口接收一个") + own("对象"))
    got = {r["query_id"]: r["chunk_id"] for r in blocks.bm25_topk(queries, blocks.build(chunks, segmenter=own), 3, segmenter=own).filter("rank = 1").collect()}
    assert got == {0: 1, 1: 0}


def test_an_engine_with_its_own_words(spark, tmp_path):
    engine = Engine(spark, Settings(root=str(tmp_path / "e"), embedding_dimensions=8, segmenter="lexicon"))
    pages = [(f"{i}.md", f"# 页\n\n{t}\n") for i, t in enumerate(sentences(120))] + [("x.md", "# 页\n\n数据库路径\n")]
    engine.ingest_texts(spark.createDataFrame(pages, "source_path string, text string"), "r", "c", "zh")
    with pytest.raises(bm25.IndexMissing):
        engine.rebuild_bm25()
    assert engine.rebuild_lexicon(min_cohesion=1.0)["words"] >= 9
    engine.rebuild_bm25()
    top = engine.search(spark.createDataFrame([(0, "数据库路径")], "query_id long, query string"), use_reranker=False).bm25.collect()
    assert top and top[0]["score"] > 0
    engine.rebuild_lexicon(min_cohesion=1.0, more=[("数据库路径", 99)])
    with pytest.raises(bm25.IndexMismatch):
        engine.reload_bm25()


def test_all_segments_of_a_small_alphabet_have_a_path():
    made = lexicon.Lexicon({"甲乙": 3, "乙丙丁": 2}, 10)
    for run in map("".join, itertools.product("甲乙丙丁", repeat=4)):
        assert "".join(made.cut(run)) == run
