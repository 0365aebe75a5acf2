"""Problem 7: encoding of the whole corpus with a public tokenizer."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Folder of the vocabulary files where no path is given.
VOCABULARIES = os.environ.get("SCRIVENER_VOCABULARIES", "/opt/tokenizers")
#: Characters of text that are put together again in one piece; and the part of all (block, word) pairs from which a word is heavy: at most
#: so many words can be.
BLOCK_CHARS = 1_000_000
HEAVY_PART = 4096
_BLOCKS = pa.schema([("block", pa.int64()), ("words", pa.list_(pa.string())), ("codes", pa.binary()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])
_VOCAB = pa.schema([("word", pa.string()), ("n", pa.int64()), ("ids", pa.list_(pa.int32()))])
_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
# Fixed value: the public pattern by which byte-level tokenizers cut text into words.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class is the same in this pattern and in the tokenizer's own (a test goes through them); texts with others go the slow way.
_SETTLED = r"[\u0000-\u0557\u0cdd-\u208e\u20a0-\ua7cd\ufffd]*"


def vocabulary(name: str = "byte_bpe_50k") -> str:
    return os.path.join(VOCABULARIES, f"{name}.json")


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The letter by which each byte is written in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


@lru_cache(2)
def splitter(path: str):
    """text -> its words, as they stand in the vocabulary, and a function that makes them so. Byte-level tokenizers with the public pattern
    are cut by it, which is several times faster, where the text's characters allow; all others by the tokenizer itself."""
    own = _tokenizer(path).pre_tokenizer.pre_tokenize_str
    with open(path, encoding="utf-8") as f:
        kind = json.load(f).get("pre_tokenizer") or {}
    slow = lambda text: [w for w, _ in own(text)]
    if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
        return lambda text: None, slow, str
    letters, words, settled = byte_letters(), regex.compile(_PATTERN), regex.compile(_SETTLED)
    return lambda text: words.findall(text) if settled.fullmatch(text) else None, slow, lambda w: "".join([letters[b] for b in w.encode()])


class _Codes(dict):
    """word -> place in the order of first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _block(no: int, docs: list, texts: list[str | None], split) -> pa.RecordBatch:
    """One row: a block's distinct words, and of its documents the code of every word in order."""
    quick, slow, written = split
    raw, made, codes, sizes = _Codes(), _Codes(), [], []
    for text in texts:
        words = quick(text) if text else []
        if words is None:
            words = [~made[w] for w in slow(text)]  # words that are written as in the vocabulary already
        else:
            words = [raw[w] for w in words]
        codes += words
        sizes.append(len(words))
    both = _Codes()
    place = np.array([both[written(w)] for w in raw] + [both[w] for w in made][::-1], np.int64)  # ~i counts from the end
    codes = place[np.array(codes, np.int64)] if codes else np.zeros(0, np.int64)
    plain = codes.astype(np.uint32).tobytes()
    packed = len(plain).to_bytes(8, "big") + pa.compress(plain, codec="zstd", asbytes=True)
    columns = [[no], [list(both)], [packed], [docs], [sizes]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCKS)], schema=_BLOCKS)


def _split_words(path: str):
    def run(batches):
        split = splitter(path)
        task, no = TaskContext.get(), 0
        base = (task.partitionId() if task else 0) << 32
        docs, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc)
                texts.append(text)
                size += len(text or "")
                if size >= BLOCK_CHARS:
                    yield _block(base + no, docs, texts, split)
                    docs, texts, size, no = [], [], 0, no + 1
        if docs:
            yield _block(base + no, docs, texts, split)

    return run


def _encode_words(path: str):
    def run(batches):
        model = _tokenizer(path).model
        for batch in batches:
            ids = [[t.id for t in model.tokenize(w)] for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, _VOCAB.field("ids").type)], schema=_VOCAB)

    return run


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _reassemble(heavy):
    """One block's row and the ids of its words -> its documents. heavy: ids of the heavy words, which come by broadcast."""

    def run(block: pa.Table) -> pa.Table:
        own = block.filter(pc.is_valid(block.column("codes")))
        words, sizes = own.column("words")[0].as_py(), np.array(own.column("sizes")[0].as_py(), np.int64)
        packed = own.column("codes")[0].as_py()
        codes = np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "big"), codec="zstd"), np.uint32)
        others = block.filter(pc.is_null(block.column("codes"))).combine_chunks()
        ids, length = _flat(others.column("ids")) if others.num_rows else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        per_word, begin = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if others.num_rows:
            at = others.column("at").to_numpy()
            per_word[at], begin[at] = length, np.cumsum(length) - length
        known = heavy.value
        more, end = [], len(ids)
        for i, w in enumerate(words):
            if (x := known.get(w)) is not None:
                per_word[i], begin[i] = len(x), end
                more.append(x)
                end += len(x)
        ids = np.concatenate([ids, *more]).astype(np.int32) if more else ids.astype(np.int32)
        each = per_word[codes]
        start = np.concatenate([[0], np.cumsum(each)])
        out = ids[np.repeat(begin[codes] - start[:-1], each) + np.arange(start[-1])]
        edges = start[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.Table.from_arrays([own.column("docs").chunk(0).flatten(), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(out))], schema=_OUT)

    return run


def encode(docs: DataFrame, path: str | None = None, heavy_part: int = HEAVY_PART) -> DataFrame:
    """(doc_id, ids): token ids of every row's text without special tokens; one row per row, repeated ones too.

    Strings that look like special tokens are ordinary text; an empty or null text gives an empty list, a null doc_id stays null.
    Texts are cut into words once. A block of about a million characters keeps its distinct words, and its text as codes of these, in one row
    of a written table; places of words never leave it. One shuffle counts the distinct words, and each is encoded once. Heavy words, of
    which there are at most heavy_part by the counts, go to the blocks by broadcast; all other ids are joined back by word, so no word brings
    more than one part in heavy_part of the rows to a task.
    """
    path = path or vocabulary()
    spark = docs.sparkSession
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _split_words(path), "block long, words array<string>, codes binary, docs array<long>, sizes array<int>"
    )
    blocks = checkpoint(blocks)
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    vocab = checkpoint(counts.mapInArrow(_encode_words(path), "word string, n long, ids array<int>"))
    total = vocab.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * heavy_part > total
    heavy = {r[0]: np.array(r[1], np.int32) for r in vocab.where(often).select("word", "ids").collect()}
    pairs = blocks.select("block", F.posexplode("words").alias("at", "word")).where(~F.col("word").isin(list(heavy)))
    none = lambda kind: F.lit(None).cast(kind)
    light = pairs.join(vocab.where(~often), "word").select("block", "at", "ids", none("array<string>").alias("words"), none("binary").alias("codes"), none("array<long>").alias("docs"), none("array<int>").alias("sizes"))
    own = blocks.select("block", none("int").alias("at"), none("array<int>").alias("ids"), "words", "codes", "docs", "sizes")
    return light.unionByName(own).groupBy("block").applyInArrow(_reassemble(spark.sparkContext.broadcast(heavy)), "doc_id long, ids array<int>")


def token_bytes(spark, path: str | None = None) -> DataFrame:
    """(id, hex): the bytes of every token of the vocabulary; its size is that of the vocabulary file."""
    byte = {c: b for b, c in byte_letters().items()}
    vocab = _tokenizer(path or vocabulary()).get_vocab(with_added_tokens=False)
    return spark.createDataFrame([(i, bytes(byte[c] for c in t).hex()) for t, i in vocab.items()], "id int, hex string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, text): the inverse of encode by a join with the table of token bytes. An empty or null list
    gives an empty text; an id that is no token gives nothing; equal rows are decoded once."""
    rows = encoded.select("doc_id", "ids").distinct().withColumn("row", F.xxhash64("doc_id", "ids"))
    tokens = rows.select("row", "doc_id", F.posexplode("ids").alias("at", "id")).join(token_bytes(encoded.sparkSession, path), "id")
    text = tokens.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "hex"))).alias("parts")).select(
        "row", F.decode(F.unhex(F.array_join(F.col("parts.hex"), "")), "UTF-8").alias("text")
    )
    return rows.join(text, "row", "left").select("doc_id", "ids", F.coalesce("text", F.lit("")).alias("text"))
