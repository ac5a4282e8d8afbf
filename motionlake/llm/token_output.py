"""Token ids in binary files: whole texts, ascending doc_id, range-coded blocks.

Documents are dealt out by ranges of doc_id and sorted; every task encodes its
texts and writes records. A record has an index of its documents, the list of
its ids from frequent to rare, both under one checksum, and independently coded,
checksummed blocks of places in that list (see range_coder). Records go through
Spark's writer, so a failed task leaves nothing and the files are where the
shared folder is.

Words recur, and the tokenizer's own splitting never joins characters across
ASCII white space, so a text's ids are its words' ids in a row: Arrow numbers a
batch's distinct words, a worker keeps the ids of words that it has met, and
numpy gathers.

Cases: null or blank text has the end id only; repeated rows are written as
often as they occur, side by side; an empty table writes and gives none; other
columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .common import small_batches, table, work_dir

END = 1
#: Ids in a block at most, and blocks for which a task cuts its ids shorter; ids from which a record is closed; ids that a task codes at once.
BLOCK = 4096
ABREAST = 256
RECORD = 1 << 20
AT_ONCE = BLOCK * range_coder.LANES
#: Words whose ids a worker keeps.
CACHE = 700_000
#: Unknown words that the tokenizer gets as one text.
JOINED = 200
#: Letters that no normal form changes, and signs.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)").fullmatch
_HEAD = struct.Struct("<4sIIII")
_MAGIC = b"TOK2"
_workers: dict[str, Words] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids of texts, as little-endian 16-bit numbers, by way of their words' ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > range_coder.MOST:
            raise ValueError("ids must fit 16 bits")
        # ids of words; of those of letters alone, lower-cased, for words that are letters and then signs
        self.known: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        # characters that are one id, which nothing else gives: for any words, and for letters, to which only the model matters
        self.mark = next(c for c in "♥★™€£" if len(self.tokenizer.encode(c, add_special_tokens=False).ids) == 1)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])

    @classmethod
    def of(cls, path: str) -> Words:
        """One for each worker process."""
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    @staticmethod
    def _apart(tokenizer, words: list[str], mark: str) -> Iterator[bytes]:
        """The ids of each word, many at a time as one text, parted by a sign that is an id of its own."""
        mark_id = tokenizer.encode(mark, add_special_tokens=False).ids[0]
        texts = [f" {mark} ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)]
        for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, "<u2")
            cuts = np.flatnonzero(ids == mark_id)
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in zip([0, *(2 * cuts + 2).tolist()], [*(2 * cuts).tolist(), len(raw)], strict=True))

    def learn(self, words: list[str]) -> None:
        """Keep the ids of words that aren't known. Letters and the signs after them are split from each other whatever stands around them."""
        known, letters, plain, odd = self.known, self.letters, [], []
        for w in words:
            m = _PLAIN(w)
            if m:
                plain.append((w, m[1].lower(), m[2]))
            else:
                odd.append(w)
        odd += {s for _, _, s in plain if s and s not in known}.difference(odd)
        alone = [w for w in odd if self.mark in w]
        for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u2").tobytes()
        together = [w for w in odd if self.mark not in w] if alone else odd
        known.update(zip(together, self._apart(self.tokenizer, together, self.mark), strict=True))
        new = list({x for _, x, _ in plain}.difference(letters))
        letters.update(zip(new, self._apart(self.plain, new, "0"), strict=True))
        for w, x, sign in plain:
            known[w] = letters[x] + known[sign] if sign else letters[x]
        for x in new[: max(0, len(letters) - CACHE)]:
            del letters[x]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        parts = list(map(self.known.get, words))
        new = [k for k, p in enumerate(parts) if p is None]
        self.learn([words[k] for k in new])
        for k in new:
            parts[k] = self.known[words[k]]
        for k in new[: max(0, len(self.known) - CACHE)]:
            del self.known[words[k]]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
        listed = np.frombuffer(b"".join(parts), "<u2")
        of = coded.indices.to_numpy()
        n = size.take(of)
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size).take(of) - ends + n, n)
        at += np.arange(len(at))
        return listed.take(at), np.concatenate(([0], ends)).take(split.offsets.to_numpy()[1:] - split.offsets[0].as_py())


def pack(docs: np.ndarray, null: np.ndarray, lengths: np.ndarray, listed: np.ndarray, blocks: list[bytes]) -> bytes:
    """One record: head, doc ids, a byte for each that tells nulls, ids of each, the list of ids, block sizes, blocks."""
    index = docs.astype("<i8").tobytes() + null.astype(np.uint8).tobytes() + lengths.astype("<u8").tobytes() + listed.astype("<u2").tobytes()
    index += np.array([len(b) for b in blocks], "<u4").tobytes()
    return _HEAD.pack(_MAGIC, len(docs), len(listed), len(blocks), zlib.crc32(index)) + index + b"".join(blocks)


def unpack(record: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    magic, n, ids, m, check = _HEAD.unpack_from(record)
    at, end = _HEAD.size, _HEAD.size + 17 * n + 2 * ids + 4 * m
    if magic != _MAGIC or zlib.crc32(record[at:end]) != check:
        raise ValueError("not a record of token ids, or a damaged one")
    ends = end + np.cumsum(np.frombuffer(record, "<u4", m, end - 4 * m), dtype=np.int64)
    blocks = [record[a:b] for a, b in zip([end, *ends[:-1].tolist()], ends.tolist(), strict=True)] if m else []
    return np.frombuffer(record, "<i8", n, at), np.frombuffer(record, np.uint8, n, at + 8 * n), np.frombuffer(record, "<u8", n, at + 9 * n).astype(np.int64), np.frombuffer(record, "<u2", ids, at + 17 * n), blocks


def coded(docs: np.ndarray, null: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> list[tuple[int, bytes]]:
    """Records of consecutive documents (ends: where each one's ids end), each with its number of ids."""
    block = min(BLOCK, max(BLOCK // 4, len(ids) // ABREAST))
    cuts, lists, blocks, sizes = [0], [], [], []
    while cuts[-1] < len(docs):
        first = int(ends[cuts[-1] - 1]) if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, first + RECORD, side="right"))))
        own = ids[first : ends[cuts[-1] - 1]]
        seen = np.bincount(own, minlength=1)
        listed = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)]
        place = np.zeros(len(seen), np.uint16)
        place[listed] = np.arange(len(listed))
        places = place.take(own)
        lists.append(listed)
        sizes.append(len(own))
        blocks.append([places[k : k + block] for k in range(0, len(places), block)])
    done = iter(range_coder.encode([b for some in blocks for b in some]))
    lengths = np.diff(ends, prepend=0)
    return [
        (n, pack(docs[a:b], null[a:b], lengths[a:b], listed, [next(done) for _ in some]))
        for n, a, b, listed, some in zip(sizes, cuts, cuts[1:], lists, blocks, strict=False)
    ]


def _records(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) in order to rows (shard, seq, before, n_ids, record)."""
    from pyspark import TaskContext

    words = Words.of(path)
    shard, seq, before = TaskContext.get().partitionId(), 0, 0
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal seq, before
        if held:
            docs, null, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = []
            for n, record in coded(docs, null, np.cumsum(lengths), ids):
                rows.append((shard, seq, before, n, record))
                seq, before = seq + 1, before + n
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["shard", "seq", "before", "n_ids", "record"])

    for batch in batches:
        if batch.num_rows:
            ids, ends = words.ids(batch.column(1))
            docs = batch.column(0)
            held.append((pc.fill_null(docs, 0).to_numpy(zero_copy_only=False), docs.is_null().to_numpy(zero_copy_only=False), np.diff(ends, prepend=0) + 1, np.insert(ids, ends, end)))
            size += len(held[-1][-1])
            if size >= AT_ONCE:
                yield from flush()
                held, size = [], 0
    yield from flush()


def write(docs: DataFrame, to: str, path: str | None = None, end: int = END) -> None:
    """Write the ids of docs(doc_id, text) to the folder `to`. path: the tokenizer's file, which every machine has."""
    small_batches(docs.sparkSession, 2000)
    path = path or tokenizer_path()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(lambda batches: _records(batches, path, end), "shard long, seq long, before long, n_ids long, record binary").write.parquet(to)


def read(spark: SparkSession, source: str) -> DataFrame:
    """One row a document, from the files alone: doc_id, start, n_tokens, ids_crc32, in no order. A damaged block raises."""
    stored = spark.read.parquet(source)
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row for each task that wrote: ordered in one place
    first = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored.join(shards.select("shard", first.alias("first")), "shard").select((F.col("first") + F.col("before")).alias("start"), "n_ids", "record")

    def rows(starts: list[int], records: list[bytes]) -> Iterator[pa.RecordBatch]:
        opened = [unpack(r) for r in records]
        places = iter(range_coder.decode([b for *_, blocks in opened for b in blocks]))
        for start, (docs, null, lengths, listed, blocks) in zip(starts, opened, strict=True):
            ids = listed.astype("<u4").take(np.concatenate([next(places) for _ in blocks]))
            ends = np.cumsum(lengths)
            sums = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, mask=null.astype(bool)), pa.array(start + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # as many records at once as have AT_ONCE ids
        for batch in batches:
            starts, held, size = [], [], 0
            for start, n, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held and size + n > AT_ONCE:
                    yield from rows(starts, held)
                    starts, held, size = [], [], 0
                starts.append(start)
                held.append(record.as_py())
                size += n
            if held:
                yield from rows(starts, held)

    return starts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """Write docs to a new folder in the shared place, and read it back."""
    to = f"{work_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write(docs, to, path, end)
    return read(docs.sparkSession, to)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
