"""BM25 (Lucene variant) as tables: postings, document lengths, term and corpus statistics.

``bm25_topk`` here scores every chunk that shares a term with a query, by joins alone; ``blocks`` gives the
same rows from an index that leaves most postings unread, and is what is published and searched.

Texts are read and split once, and a chunk's terms are counted within its row, so its postings need no
shuffle; one aggregation of them gives the document frequencies. Scoring takes the frequencies of the
queries' terms only and joins those with their postings. A term that every chunk holds costs its
postings once per query that asks for it, in files and tasks cut by (term, chunk), never by term alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions.text import TOKENIZER_VERSION, Segmenter, has_ascii_terms, term_counts, terms
from tarn.shared import spread, written
from tarn.sources.pointers import Generations

FORMAT_VERSION = 3
DIGITS = 9


class IndexMissing(LookupError):
    """No generation has been published."""


class IndexMismatch(ValueError):
    """The published generation does not fit the asked format, tokenizer or vector space."""


class EmptyCorpus(ValueError):
    """There is nothing to index."""


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, chunk_id, tf, dl
    term_stats: DataFrame  # term, df
    corpus_stats: DataFrame  # n, avgdl (one row)


def tokenized(chunks: DataFrame, text: str = "retrieval_text", segmenter: Segmenter | None = None) -> DataFrame:
    """chunk_id, dl (its terms) and counts (array of term and tf), read from a table that is written here."""
    rows = spread(chunks.select("chunk_id", F.col(text).alias("text")))
    # terms that are ASCII are found and counted in Arrow, a batch at a time; of other texts they go along
    given = terms(F.col("text"), segmenter)
    rows = rows.select("chunk_id", F.col("text").cast("string").alias("text"), given.alias("terms") if segmenter else F.when(~has_ascii_terms(F.col("text")), given).alias("terms"))
    of = rows.schema["chunk_id"].dataType.simpleString()
    return written(rows.mapInArrow(term_counts, f"chunk_id {of}, dl long, counts array<struct<term:string,tf:bigint>>"), "tokens")


def build_index(chunks: DataFrame, text: str = "retrieval_text", segmenter: Segmenter | None = None) -> Index:
    """Every chunk counts in n and avgdl, also one without terms. Chunk ids are unique."""
    tokens = tokenized(chunks, text, segmenter)
    corpus = tokens.agg(F.count("*").alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl"))
    postings = tokens.select("chunk_id", "dl", F.explode("counts").alias("c")).select(F.col("c.term").alias("term"), "chunk_id", F.col("c.tf").alias("tf"), "dl")
    return Index(postings, postings.groupBy("term").agg(F.count("*").alias("df")), corpus)


def query_terms(queries: DataFrame, text: str = "query", segmenter: Segmenter | None = None) -> DataFrame:
    """query_id, term, qtf: how often each term stands in each query."""
    return queries.select("query_id", F.explode(terms(F.col(text), segmenter)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def scores(queries: DataFrame, index: Index, text: str = "query", k1: float = 1.5, b: float = 0.75, segmenter: Segmenter | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of all chunks that share a term with the query; a term that a query
    repeats counts each time. Scores have DIGITS digits, as a sum's last bits depend on its order and
    equal texts must tie."""
    asked = written(query_terms(queries, text, segmenter), "asked")
    wanted = asked.select("term").distinct()
    # the semi join goes below the aggregation that makes the frequencies, where they are not a table
    known = index.term_stats.join(wanted, "term", "left_semi")
    weighted = asked.join(known, "term").crossJoin(F.broadcast(index.corpus_stats))  # one row
    weighted = weighted.select("query_id", "term", "qtf", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    matched = index.postings.join(weighted, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return matched.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), DIGITS).alias("score"))


def bm25_topk(queries: DataFrame, index: Index, k: int, text: str = "query", k1: float = 1.5, b: float = 0.75, segmenter: Segmenter | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score of the k best chunks with a positive score; ties by chunk_id."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = scores(queries, index, text, k1, b, segmenter).filter("score > 0").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def tokenizer_version(segmenter: Segmenter | None) -> str:
    if segmenter is None:
        return TOKENIZER_VERSION
    return getattr(segmenter, "version", None) or f"{segmenter.__module__}:{segmenter.__qualname__}"


def _described(model: str, dimensions: int, segmenter: Segmenter | None) -> dict:
    return {"format_version": FORMAT_VERSION, "tokenizer_version": tokenizer_version(segmenter), "embedding_model": model, "embedding_dimensions": dimensions}


def publish(chunks: DataFrame, root: str, model: str, dimensions: int, text: str = "retrieval_text", segmenter: Segmenter | None = None, source: str = "") -> str:
    """Build a generation of one segment under ``root`` and make it the current one; the old one stays readable.
    ``source`` says what the chunks were read from."""
    from tarn.operators import segments  # which builds on this module

    if chunks.isEmpty():
        raise EmptyCorpus("no chunks of this vector space")
    store = Generations(chunks.sparkSession, root)
    name, path = store.new()
    entry = segments.added(chunks, path, text=text, segmenter=segmenter)
    store.publish(name, _described(model, dimensions, segmenter) | {"segments": [entry], "uses": [name], "source": source})
    return name


def grow(added: DataFrame, removed: DataFrame, root: str, model: str, dimensions: int, text: str = "retrieval_text", segmenter: Segmenter | None = None, source: str = "") -> str:
    """The current generation plus a segment that adds and removes chunks, with what is due merged. Whoever
    else published meanwhile makes this raise ConcurrentChange."""
    from tarn.operators import segments

    store = Generations(added.sparkSession, root)
    before, manifest = current(added.sparkSession, root, model, dimensions, segmenter)
    name, path = store.new()
    held = segments.merged(added.sparkSession, [*manifest["segments"], segments.added(added, f"{path}/added", removed, text, segmenter)], f"{path}/merged")
    uses = sorted({s["path"].split("/generations/")[1].split("/")[0] for s in held} | {name})
    store.publish(name, _described(model, dimensions, segmenter) | {"segments": held, "uses": uses, "source": source}, after=before)
    return name


def current(spark: SparkSession, root: str, model: str, dimensions: int, segmenter: Segmenter | None = None) -> tuple[str, dict]:
    """(name, manifest) of the current generation, which must fit."""
    store = Generations(spark, root)
    name = store.current()
    if name is None:
        raise IndexMissing(f"no index under {root}")
    manifest = store.manifest(name)
    for key, wanted in _described(model, dimensions, segmenter).items():
        if manifest.get(key) != wanted:
            raise IndexMismatch(f"the index has {key} {manifest.get(key)!r}, not {wanted!r}")
    return name, manifest


def load(spark: SparkSession, root: str, model: str, dimensions: int, segmenter: Segmenter | None = None):
    """The current generation (``segments.Segments``)."""
    from tarn.operators import segments

    return segments.opened(spark, current(spark, root, model, dimensions, segmenter)[1]["segments"])
