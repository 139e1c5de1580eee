"""Concatenate and cut: documents become one long token stream, cut into full windows.

Pass one encodes each document once, in input order, and writes its ids with its partition and its token offset
there.  The partitions' totals (one row per input split) are prefix-summed; adding a partition's start to an offset
gives a document's place in the whole stream without moving any document.  Pass two reads the written ids and
cuts them at multiples of the window, with one boundary record per piece.  Only the very last window needs padding.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_letters
from .common import pick, shared_dir, sliced, written

#: Partition starts (12 bytes each) are broadcast up to this many input splits, and joined by shuffle beyond.
BROADCAST_SPLITS = 1_000_000

STAGED = "doc_id bigint, part int, local bigint, doc_tokens bigint, ids binary"
_STAGED = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


#: Runs of white space (of the Unicode property) that the compiled pattern is spared: it backtracks over a run on a stack.
LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tuple[tiktoken.Encoding, int, dict[str, int]]:
    """The vocabulary file as a compiled tokenizer (one per Python worker), its number of ids, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {b: i for b, i in ranks.items() if i not in special.values()}
    return tiktoken.Encoding("packed", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), max([*ranks.values(), *special.values()]) + 1, special


@lru_cache(maxsize=2)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def token_ids(path: str, text: str | None) -> np.ndarray:
    """Ids of the whole text; special tokens in it count as such."""
    if not text:
        return np.zeros(0, np.uint32)
    encoding, _, special = tokenizer(path)
    if not LONG_RUN.search(text):
        return encoding.encode_to_numpy(text, allowed_special="all")
    parts = []
    marks = sorted(map(re.escape, special), key=len, reverse=True)
    for piece in re.split(f"({'|'.join(marks)})", text) if marks else [text]:
        if piece in special:
            parts.append([special[piece]])
            continue
        at = 0
        for run in LONG_RUN.finditer(piece):
            # The pattern takes a run as one word, less its last character where text follows: that one leads the next word.
            end = run.end() if run.end() == len(piece) else run.end() - 1
            parts.append(encoding.encode_to_numpy(piece[at : run.start()], disallowed_special=()))
            parts.append(library(path).encode(piece[run.start() : end], add_special_tokens=False).ids)
            at = end
        parts.append(encoding.encode_to_numpy(piece[at:], disallowed_special=()))
    return np.concatenate([np.asarray(p, np.uint32) for p in parts])


def encoded(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pass one.  ids are little-endian unsigned 16- or 32-bit numbers, whichever the vocabulary needs."""

    def run(batches):
        kind = "<u2" if max(tokenizer(vocabulary)[1], end_id + 1) <= 1 << 16 else "<u4"
        part, local = TaskContext.get().partitionId(), 0
        for batch in sliced(batches):
            keys, rows = batch.column(0), []
            for text in batch.column(1).to_pylist():
                ids = np.append(token_ids(vocabulary, text), end_id).astype(kind)
                rows.append((part, local, len(ids), ids.tobytes()))
                local += len(ids)
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_STAGED)[1:], strict=True))], schema=_STAGED)

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, STAGED)


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Boundary records PIECES: which ids of which document lie where in which sequence.

    A null text is the empty one and gives the end id alone; repeated rows are packed each; an empty table gives no
    rows; other columns are ignored.  Every sequence but the last is full.
    """
    staged = written(encoded(docs, vocabulary, end_id, id_col, text_col), "encoded", shared_dir(docs.sparkSession))
    totals = staged.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    # One row per input split: the window over all of them is as small as the list of splits.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    if docs.rdd.getNumPartitions() <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)

    def run(batches):
        for batch in sliced(batches):
            out = [[] for _ in _PIECES]
            for key, total, at, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                width = len(raw) // total
                ids, done = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4"), 0
                while done < total:
                    sequence, offset = divmod(at + done, length)
                    take = min(length - offset, total - done)
                    row = (key, done, take, zlib.crc32(ids[done : done + take].tobytes()), total, sequence, offset)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    done += take
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

    placed = staged.join(starts, "part").select("doc_id", "doc_tokens", (F.col("base") + F.col("local")).alias("at"), "ids")
    return placed.mapInArrow(run, PIECES)
