"""Token ids in Arrow's stream-file (IPC file) format: fixed-size-list batches of equal-length sequences and masks.

write() orders documents by doc_id, encodes them and packs all ids of a partition, end id after each document, into
sequences of one length. Each partition makes two Arrow files in the shared folder: `ids`/`mask` sequences, uncompressed,
so a reader maps the file and takes any sequence without a copy, and an index of the documents (doc_id, start, n_tokens).
A file's name is new for each task attempt and reaches the manifest only with the attempt that succeeded, so retries and
speculative tasks leave no wrong files behind. Only the last sequence of a file is padded; its mask says where.

Nulls: a null text counts as empty and has the end id alone; null ids come first. Repeated rows are written as often as
they come. Texts are encoded whole. An empty table gives an empty manifest. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import json
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, count
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthoplan.llm import scratch

MANIFEST = "shard int, path string, index_path string, n_docs long, n_tokens long, n_sequences long"
#: Sequences of a record batch.
BATCH = 256
#: Entries that a worker's word cache holds before it starts again.
CACHE = 1_000_000
#: New pieces that are encoded as one text; longer texts cost the tokenizer more for each piece.
TOGETHER = 32
#: Characters that are cut into words at a time.
PORTION = 1 << 19
#: Marks that may close a word; none begins a contraction.
MARKS = ".,!?;:"
# The characters that stand for bytes in a byte-level vocabulary; visible ones stand for themselves.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: b for b in _SELF} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SELF)}
#: White space other than the blank and the line feed.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


class Encoder:
    """Whole texts to ids (little-endian uint16 or uint32 bytes) with the tokenizers library.

    A byte-level pre-tokenizer always splits before a single blank, and before and after a single line feed, between
    visible characters. Texts are cut there, each distinct piece (a blank or a line feed, and the word behind it) is
    encoded once and kept, and the pieces' ids are joined. New pieces are encoded together, a line feed between them,
    as that is a token of its own. Texts with other white space, texts that hold an added token where these are
    recognised, and other kinds of tokenizer, are encoded in one go.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not (special_as_text and t.special)]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        parts = json.loads(self.tokenizer.to_str())
        split = parts["pre_tokenizer"] or {}
        feed = self.ids("\n")
        self.by_piece = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and parts["normalizer"] is None and len(feed) == 1
        self.feed = feed[0] if len(feed) else None
        self.start = feed.tobytes()
        self.model, self.code = self.tokenizer.model, self.dtype.char
        self.pieces: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def word(self, text: str) -> bytes:
        """One piece that the pre-tokenizer leaves whole: straight to the merges, in the alphabet that stands for bytes."""
        return array(self.code, [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(BYTES))]).tobytes()

    def learn(self, new: list[str]) -> None:
        """Pieces without their blank, or with their line feed. Letters with or without closing marks need no splitting."""
        others, pieces, feed = [], self.pieces, self.start
        for x in new:
            after_feed = x[0] == "\n"
            whole = x[1:] if after_feed else x
            core = whole.rstrip(MARKS)
            if not core.isalpha():
                others.append(x)
                continue
            if after_feed:
                raw = feed + self.word(core)
            elif (raw := pieces.get(core)) is None:
                raw = pieces[core] = self.word(" " + core)
            if tail := whole[len(core) :]:
                if tail not in self.tails:
                    self.tails[tail] = self.ids(tail).tobytes()
                raw += self.tails[tail]
            pieces[x] = raw
        self.learn_together(others)

    def learn_together(self, new: list[str]) -> None:
        width, feed = self.dtype.itemsize, self.start
        texts, groups = [], []
        for after_feed in (False, True):
            words = [x for x in new if (x[0] == "\n") == after_feed]
            for at in range(0, len(words), TOGETHER):
                groups.append((w := words[at : at + TOGETHER], feed if after_feed else b""))
                texts.append("".join(w)[1:] if after_feed else " " + "\n ".join(w))
        for (words, before), e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            ends = (np.flatnonzero(ids == self.feed) * width).tolist()
            if len(ends) != len(words) - 1:
                raise ValueError("the tokenizer joins line feeds with what stands beside them")
            raw = ids.tobytes()
            self.pieces.update((x, before + raw[a:b]) for x, a, b in zip(words, [0, *(e + width for e in ends)], [*ends, len(raw)]))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order; so many texts at a time that their words fit in little memory."""
        portion, size = [], 0
        for t in texts:
            portion.append(t)
            size += len(t)
            if size >= PORTION:
                yield from self.portion(portion)
                portion, size = [], 0
        yield from self.portion(portion)

    def portion(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > CACHE:
            self.pieces, self.tails = {}, {}
        cut, found, new = [], [], set()
        for t in texts:
            t = "\n" + t
            words = t.replace("\n", " \n").split(" ")[1:]
            if not self.by_piece or "" in words or "\n" in words or any(c in t for c in OTHER_SPACE) or any(c in t for c in self.added):
                cut.append(None)
                found.append(None)
                continue
            cut.append(words)
            found.append(parts := list(map(self.pieces.get, words)))
            if None in parts:
                new.update(compress(words, map(not_, parts)))
        if new:
            self.learn(list(new))
        get, width, out = self.pieces.__getitem__, self.dtype.itemsize, []
        for t, words, parts in zip(texts, cut, found):
            if words is None:
                out.append(self.ids(t).tobytes() if t else b"")
                continue
            if None in parts:
                for i in list(compress(count(), map(not_, parts))):
                    parts[i] = get(words[i])
            out.append(b"".join(parts)[width:])
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool) -> Encoder:
    return Encoder(path, special_as_text)


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Shard:
    """Writes one partition's sequences."""

    def __init__(self, uri: str, length: int, dtype: np.dtype):
        self.fs, self.path = opened(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        value = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.length, self.dtype = length, dtype
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.rest, self.held, self.n_tokens, self.n_sequences = [], 0, 0, 0

    def add(self, raw: bytes) -> None:
        self.rest.append(raw)
        self.held += len(raw) // self.dtype.itemsize
        if self.held >= BATCH * self.length:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.rest), self.dtype)
        n = -(-len(ids) // self.length) if last else len(ids) // (BATCH * self.length) * BATCH
        whole, self.rest = ids[: n * self.length], [ids[n * self.length :].tobytes()]
        self.held = len(ids) - len(whole)
        self.n_tokens += len(whole)
        self.n_sequences += n
        mask = np.ones(n * self.length, bool)
        if len(whole) < len(mask):
            mask[len(whole) :] = False
            whole = np.concatenate([whole, np.zeros(len(mask) - len(whole), self.dtype)])
        for at in range(0, n, BATCH):
            part = slice(at * self.length, min(n, at + BATCH) * self.length)
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), self.length) for x in (whole, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        self.flush(True)
        self.writer.close()
        self.sink.close()


def write(docs: DataFrame, folder: str, tokenizer: str, length: int = 2048, end_id: int = 0, special_as_text: bool = True) -> DataFrame:
    """Writes the files under folder and returns the manifest, kept in the shared folder.

    special_as_text: a special token's string in a text is ordinary text; False: it gets that token's id, as in the library's
    plain call.
    """

    def shards(batches):
        enc, shard, index = encoder(tokenizer, special_as_text), None, []
        number = TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        name = f"{folder}/shard-{number:06d}-{uuid.uuid4().hex}"
        for b in batches:
            shard = shard or Shard(f"{name}.arrow", length, enc.dtype)
            counts = []
            for raw in enc.encode([t or "" for t in b.column("text").to_pylist()]):
                shard.add(raw)
                shard.add(end)
                counts.append(len(raw) // enc.dtype.itemsize + 1)
            index.append(pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"]))
        if shard is None:
            return
        shard.close()
        table = pa.Table.from_batches(index)
        n = table.column("n_tokens").to_numpy()
        table = table.append_column("start", pa.array(np.cumsum(n) - n, pa.int64()))
        fs, path = opened(f"{name}.index.arrow")
        with fs.open_output_stream(path) as sink, pa.ipc.new_file(sink, table.schema) as w:
            w.write_table(table)
        row = {"shard": number, "path": f"{name}.arrow", "index_path": f"{name}.index.arrow", "n_docs": len(table), "n_tokens": shard.n_tokens, "n_sequences": shard.n_sequences}
        types = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return scratch.written(ordered.mapInArrow(shards, MANIFEST), "tokens-manifest")


def batches_of(uri: str):
    """The file's record batches one by one; a local file is mapped, not read."""
    fs, path = opened(uri)
    with pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path) as source:
        reader = pa.ipc.open_file(source)
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)


def sequence(uri: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The i-th sequence's ids and mask; the ids are a view of the mapped file."""
    fs, path = opened(uri)
    reader = pa.ipc.open_file(pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path))
    b = reader.get_batch(i // BATCH)
    ids, mask = b.column("ids")[i % BATCH], b.column("mask")[i % BATCH]
    return ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False)


def checksums(uri: str, counts: np.ndarray) -> list[int]:
    """crc32 of each document's ids as little-endian uint32, in one pass over the file."""
    out, crc, left, at = [], 0, int(counts[0]) if len(counts) else 0, 0
    for b in batches_of(uri):
        ids = b.column("ids").flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        pos = 0
        while at < len(counts) and pos < len(ids):
            take = min(4 * left, len(ids) - pos)
            crc = zlib.crc32(memoryview(ids)[pos : pos + take], crc)
            pos += take
            left -= take // 4
            if not left:
                out.append(crc)
                at += 1
                crc, left = 0, int(counts[at]) if at < len(counts) else 0
    return out


def documents(manifest: DataFrame) -> DataFrame:
    """The files read back: doc_id, start (over all files), n_tokens, ids_crc32. Offsets are a window over one row a file."""

    def rows(batches):
        for b in batches:
            for m in b.to_pylist():
                index = pa.Table.from_batches(list(batches_of(m["index_path"])))
                n = index.column("n_tokens").to_numpy()
                yield from pa.table(
                    {"doc_id": index.column("doc_id"), "start": pa.array(index.column("start").to_numpy() + m["offset"], pa.int64()), "n_tokens": index.column("n_tokens"), "ids_crc32": pa.array(checksums(m["path"], n), pa.int64())}
                ).to_batches()

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    m = manifest.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    m = m.select("path", "index_path", "offset").repartition(max(1, manifest.count()))  # a file a task, dealt in turn
    return m.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
