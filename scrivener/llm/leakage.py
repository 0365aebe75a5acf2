"""Problem 8: evaluation texts leaking into training text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words in common that make a leak, and words of text in one suffix array.
WINDOW = 10
SHARD_WORDS = 1_000_000
#: Held-out words that are sent to every task; a larger set is worked off in parts of this size, one pass over the corpus each.
ITEM_WORDS = 2_000_000
_WORD = re.compile(r"[^\W_]+")
_OUT = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("words", pa.int32()), ("item_at", pa.int32()), ("doc_at", pa.int32())])


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    return [w.lower() for w in _WORD.findall(text)] if text else []


def _ladder(window: int) -> list[int]:
    """Lengths 1, 2, 4, ... up to the largest within the window."""
    return [1 << i for i in range(window.bit_length())]


def _rank(base: np.ndarray, step: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of prefixes twice as long from ranks of their halves (-1: none); known: the sorted keys of the shard, for queries."""
    right = np.full(len(base), -1, np.int64)
    right[: max(0, len(base) - step)] = base[step:]
    keys = np.where((base >= 0) & (right >= 0), (base << 32) | right, -1)
    return _place(keys, known)


def _place(keys: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if known is None:
        known = np.unique(keys[keys >= 0])
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    found = (keys >= 0) & (known[at] == keys) if len(known) else np.zeros(len(keys), bool)
    return np.where(found, at, -1), known


class Shard:
    """Suffix array of one shard of documents, sorted by the first `window` words by prefix doubling; -1 parts documents."""

    def __init__(self, docs: list[list[int]], window: int):
        self.window = window
        self.text = np.array([w for d in docs for w in (*d, -1)], np.int64)
        self.doc = np.repeat(np.arange(len(docs)), [len(d) + 1 for d in docs])
        self.begin = np.cumsum([0, *[len(d) + 1 for d in docs]])
        self.known, rank = [], self.text
        for step in _ladder(window)[:-1]:
            rank, known = _rank(rank, step, None)
            self.known.append(known)
        rest = window - _ladder(window)[-1]
        rank, known = _rank(rank, rest, None) if rest else (rank, None)
        self.last = known
        self.suffixes = np.argsort(rank, kind="stable")
        self.ranks = rank[self.suffixes]

    def find(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Binary search of every suffix of the query: the suffixes searched for, and the first and last of their places in the array."""
        rank = query
        for step, known in zip(_ladder(self.window)[:-1], self.known):
            rank, _ = _rank(rank, step, known)
        if self.last is not None:
            rank, _ = _rank(rank, self.window - _ladder(self.window)[-1], self.last)
        at = np.flatnonzero(rank >= 0)
        return at, np.searchsorted(self.ranks, rank[at], "left"), np.searchsorted(self.ranks, rank[at], "right")

    def common(self, query: np.ndarray, i: int, j: int) -> int:
        """Words in common from place i of the query and j of the shard on."""
        n = min(len(query) - i, len(self.text) - j)
        step = 64
        done = 0
        while done < n:
            a, b = query[i + done : i + min(n, done + step)], self.text[j + done : j + min(n, done + step)]
            off = np.flatnonzero((a != b) | (a < 0))
            if len(off):
                return done + int(off[0])
            done += len(a)
        return n


def _search(items, window: int):
    def run(batches):
        queries = items.value
        vocab: dict[str, int] = {}
        for _, ws in queries:
            for w in ws:
                vocab.setdefault(w, len(vocab))
        query = np.array([x for _, ws in queries for x in (*(vocab[w] for w in ws), -1)], np.int64)
        item = np.repeat(np.arange(len(queries)), [len(ws) + 1 for _, ws in queries]) if queries else np.zeros(0, int)
        begin = np.cumsum([0, *[len(ws) + 1 for _, ws in queries]])
        ids, docs, n = [], [], 0

        def leaks():
            shard, best = Shard(docs, window), {}
            at, lo, hi = shard.find(query)
            for i, a, b in zip(at, lo, hi):
                hits = shard.suffixes[a:b]
                if i and query[i - 1] >= 0:  # only where a match begins
                    hits = hits[(hits == 0) | (shard.text[hits - 1] != query[i - 1])]
                for s in hits:
                    pair = (int(item[i]), int(shard.doc[s]))
                    m = shard.common(query, int(i), int(s))
                    if m > best.get(pair, (0,))[0]:
                        best[pair] = (m, int(i - begin[item[i]]), int(s - shard.begin[shard.doc[s]]))
            rows = [(queries[k][0], ids[d], *v) for (k, d), v in best.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _OUT)], schema=_OUT)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words_of(text)
                if len(ws) < window:
                    continue
                ids.append(doc_id)
                docs.append([vocab.get(w, -1) for w in ws])
                n += len(ws) + 1
                if n >= SHARD_WORDS:
                    yield leaks()
                    ids, docs, n = [], [], 0
        if docs:
            yield leaks()

    return run


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_words: int = ITEM_WORDS) -> DataFrame:
    """(item_id, doc_id, words, item_at, doc_at): items and documents with `window` consecutive words in common, the longest run of such
    words and where it begins in both, counted in words from 0.

    Each task builds suffix arrays over shards of its documents and looks up every suffix of every item by binary search; documents are
    never shuffled. Words that no item has end every match, so they are one mark in the arrays. Null texts, null item_ids and texts
    shorter than the window give nothing. Held-out items go to the tasks in parts of at most item_words words.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], "item_id long, doc_id long, words int, item_at int, doc_at int")
    part, n = [], 0

    def search():
        shared = spark.sparkContext.broadcast(part)
        return docs.mapInArrow(_search(shared, window), "item_id long, doc_id long, words int, item_at int, doc_at int")

    results = []
    for item_id, text in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct().toLocalIterator():
        ws = words_of(text)
        if len(ws) < window:
            continue
        part.append((item_id, ws))
        n += len(ws)
        if n >= item_words:
            results.append(search())
            part, n = [], 0
    if part:
        results.append(search())
    for r in results:
        found = found.unionByName(r)
    best = F.max(F.struct("words", (-F.col("doc_at")).alias("d"), (-F.col("item_at")).alias("i"))).alias("best")
    return found.groupBy("item_id", "doc_id").agg(best).select(
        "item_id", "doc_id", "best.words", (-F.col("best.i")).alias("item_at"), (-F.col("best.d")).alias("doc_at")
    )


def clean(docs: DataFrame, leaked: DataFrame) -> DataFrame:
    """The documents, all columns, without those in leaked; a null doc_id is never leaked."""
    return docs.join(leaked.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
