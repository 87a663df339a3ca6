"""Operator 3: token ids in binary files, Simple-8b coded, and their reading.

``write_ids`` deals documents out by ranges of doc_id, encodes each partition in order and writes it through Spark's own
writer and committer, ``FILE_SEGMENTS`` segments a file, so that a lost executor costs a repeated task, never a broken file,
and a reader holds a file of bounded size.

File: segments, each followed by one newline byte. Segment, little-endian: ``S8B2``; u32 documents, u32 of them, the first
ones, without an id, u64 ids, u32 blocks of ids, u32 words of ids; i64 doc_id of each document; u32 ids of each document; u32 words before each block; u64 words.
A segment holds whole documents and about ``SEGMENT_IDS`` ids, more only for a single longer document.

Rows: a null text is an empty one, and has the end id alone; rows with a null doc_id come first; repeated rows are written as often as they come; rows of one doc_id are ordered by a
hash of their text. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b, textvec
from .common import fresh_path, shared_dir, small_batches, tidy, worker_keeps

MAGIC = b"S8B2"
HEAD = np.dtype([("magic", "S4"), ("docs", "<u4"), ("nulls", "<u4"), ("ids", "<u8"), ("blocks", "<u4"), ("words", "<u4")])
SEGMENT_IDS = 1 << 17
FILE_SEGMENTS = 256
CACHED_WORDS = 1_000_000
"""Distinct words that a worker keeps encoded; beyond these it forgets them all and begins again. Results don't differ."""


class WordEncoder:
    """Ids of white-space-separated words by the tokenizers library, each distinct word encoded once.

    Right for tokenizers that never merge or match across ASCII white space, and that drop it. For one that also lowers
    case and marks word ends, a run of letters is one piece whatever punctuation follows it: words are then cut before
    their punctuation and lowered first, and runs of letters are encoded together, told apart by the marked ends.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.marked = bool(suffix) and '"Lowercase"' in json.dumps(spec["normalizer"])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, at in self.tokenizer.get_vocab().items():
            self.ends[at] = piece.endswith(suffix)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.uint32), np.zeros(0, np.uint16)
        self.flat, self.used = np.zeros(1 << 20, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32), 0

    def one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((y for x in ids for y in x), np.uint32, int(count.sum())), count

    def together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words that are runs of letters."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(np.concatenate([[0], ends]))) if len(ends) == len(words) else self.one_by_one(words)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        alpha = np.fromiter((self.marked and x.isalpha() for x in words), bool, len(words))
        for some, encode in ((np.flatnonzero(alpha), self.together), (np.flatnonzero(~alpha), self.one_by_one)):
            if not len(some):
                continue
            flat, count = encode([words[i] for i in some])
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(flat), self.used // 4), self.flat.dtype)])
            self.flat[self.used : self.used + len(flat)] = flat
            place = np.searchsorted(self.known, hashes[some])
            if len(count) and count.max() > 0xFFFF:  # a word of tens of thousands of ids
                self.count = self.count.astype(np.uint32)
            self.begin = np.insert(self.begin, place, (self.used + np.cumsum(count) - count).astype(np.uint32))
            self.count = np.insert(self.count, place, count.astype(self.count.dtype))
            self.known = np.insert(self.known, place, hashes[some])
            self.used += len(flat)

    def encode(self, chunk: textvec.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk's texts, and the ids of each text."""
        raw = chunk.data.tobytes()
        cut = self.marked and not any(x in raw for x in self.special)
        w = textvec.words(chunk, lower=cut, cut=textvec.before_punctuation(chunk.data) if cut else None)
        distinct, first, which = textvec.distinct(w.hash)
        if len(self.known) > CACHED_WORDS:
            self.forget()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        here = place < len(self.known)
        new[here] = self.known[place[here]] != distinct[here]
        if new.any():
            raw = textvec.lowered(chunk.data).tobytes() if cut else raw
            self.learn(distinct[new], [raw[a:b].decode() for a, b in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
            place = np.searchsorted(self.known, distinct)
        place = place[which]
        count = self.count[place].astype(np.int64)
        ids = self.flat[textvec.ragged(self.begin[place].astype(np.int64), count)]
        upto = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(upto[w.of])


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """One segment; its first ``nulls`` documents have no id."""
    words, offsets = simple8b.encode(ids)
    head = np.array([(MAGIC, len(doc_ids), nulls, len(ids), len(offsets), len(words))], HEAD)
    return b"".join(x.tobytes() for x in (head, doc_ids.astype("<i8"), lengths.astype("<u4"), offsets.astype("<u4"), words.astype("<u8")))


def unpack(data: memoryview | bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each segment of a file: doc ids, lengths, ids, and how many of its first documents have no id."""
    at, data = 0, memoryview(data)

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data[at : at + n * np.dtype(kind).itemsize], kind)
        at += out.nbytes
        return out

    while at < len(data):
        head = np.frombuffer(data[at : at + HEAD.itemsize], HEAD)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a segment")
        at += HEAD.itemsize
        doc_ids, lengths = take("<i8", int(head["docs"])), take("<u4", int(head["docs"])).astype(np.int64)
        offsets, words = take("<u4", int(head["blocks"])), take("<u8", int(head["words"]))
        at += 1
        yield doc_ids, lengths, simple8b.decode(words, offsets, int(head["ids"])), int(head["nulls"])


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> str:
    """Writes the ids of ``docs`` (doc_id, text) under ``path``, in files whose names follow the order of doc_id."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_keeps(("encoder", tokenizer_path), lambda: WordEncoder(tokenizer_path))
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc_ids, lengths, ids, nulls = zip(*held, strict=True)
            out = pack(*(np.concatenate(x) for x in (doc_ids, lengths, ids)), nulls=sum(nulls))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["value"])

        for batch in batches:
            doc_ids, null = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for chunk in textvec.chunks(batch.column(1)):
                ids, lengths = encoder.encode(chunk)
                ends = np.cumsum(lengths)
                ids = np.insert(ids.astype(np.uint32), ends, np.uint32(end_id))
                held.append((doc_ids[chunk.lo : chunk.hi], lengths + 1, ids, int(null[chunk.lo : chunk.hi].sum())))
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        tidy()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = rows.mapInArrow(segments, "value binary")
    with small_batches(docs.sparkSession):
        rows.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path)
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, part (the file's place in order), at (ids before the document in its file), n_tokens, ids_crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                name = name.as_py().rsplit("/part-", 1)[1]  # the partition, and the file's number within it
                part = (int(name.split("-")[0]) << 32) + int(name.rsplit("-c", 1)[1].split(".")[0])
                at = 0
                for doc_ids, lengths, ids, nulls in unpack(memoryview(content.as_buffer())):
                    upto = np.concatenate([[0], np.cumsum(lengths)])
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]
                    arrays = [pa.array(doc_ids, mask=np.arange(len(doc_ids)) < nulls), pa.array(np.full(len(doc_ids), part, np.int64)), pa.array(at + upto[:-1]), pa.array(lengths), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "part", "at", "n_tokens", "ids_crc32"])
                    at += int(upto[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(documents, "doc_id long, part long, at long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes the files to the shared folder, reads them back, and returns one row per document.

    doc_id, start (ids of all documents before it, in order of doc_id), n_tokens (with the end id), ids_crc32. What is
    collected is one number per file, of some 30 million ids, or per partition, if that is less.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    path = write_ids(docs, tokenizer_path, end_id, fresh_path(spark, "ids"))
    read = read_ids(spark, path).checkpoint()
    totals = sorted((r["part"], r["n"]) for r in read.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, upto = [], 0
    for part, n in totals:
        before.append((part, upto))
        upto += n
    offsets = spark.createDataFrame(before, "part long, before long")
    joined = read.join(F.broadcast(offsets), "part")
    return joined.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
