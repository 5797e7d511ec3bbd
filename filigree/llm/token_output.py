"""Token-ID output: Arrow stream files of fixed-size-list batches.

Format. Documents, in ascending order, are one run of token ids, each document closed by the end id. A file holds a
consecutive part of the run, cut into sequences of `sequence` ids, and consists of one Arrow IPC stream:

    ids   fixed_size_list<uint16 or uint32>[sequence]   the ids, the end of the file's last sequence filled with the end id
    mask  fixed_size_list<bool>[sequence]               true where an id belongs to a document

All record batches but the last have `batch` sequences, and nothing is compressed, so sequence k of a memory-mapped file
is a slice at a computed place: batch k // batch, row k % batch, without a copy (see `sequences`). Beside it stands
`<file>.index`, another stream: doc_id, offset (of the document's first id in the file), n_tokens. Ids are stored in 16
bits where the vocabulary allows it.

Exact encoding at low cost. Byte-level BPE encodes each piece of its pre-tokenisation alone. A text is cut before every
run of non-space characters with its leading space, before every run of other white space, and between a letter and a
following mark, which are places where that pre-tokenisation always cuts. That is done on the bytes of a whole slice of texts, and
Arrow finds its different pieces, so that Python has no object for a word. Each different piece goes through the tokenizers library once for a worker (a
bounded cache), and a text's ids are gathered from the table. Tokenizers of another kind encode whole texts.

Scale and recovery. Texts are range-partitioned by their place, each task writes one file (in row groups; a task holds one
slice of texts at a time) under a name of its own and then renames it, so a task that runs twice leaves one whole file.
The driver sees one row for each file, never one for a document.

Defined cases: a null or empty text is the end id alone; rows with a null place come first, equal places in order of
text; other columns are ignored; an empty table gives an index of no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_bytes, fresh_path, table
from .words import slices

SEQUENCE, BATCH, END_ID = 2048, 64, 0
#: Pieces that a worker remembers, at most, and between tasks.
CACHE_PIECES, KEPT_PIECES = 600_000, 300_000


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Growing:
    """An array that is appended to."""

    def __init__(self, dtype) -> None:
        self.held, self.n = np.zeros(1 << 16, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.resize(self.held, 2 * (self.n + len(values)))
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


def _these(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of bytes: those from one to the other of each pair."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


# Unicode's White_Space: of one byte, and the first bytes of the others
_SPACE, _SPACE_LEAD = _these((9, 13), (32, 32)), _these((0xC2, 0xC2), (0xE1, 0xE3))
# A letter and then one of these marks: the pre-tokenisation always cuts between them, too.
_LETTER, _MARK = _these((65, 90), (97, 122)), np.isin(np.arange(256), list(b"!#$%&*,.:;?"))


def _spaces(raw: np.ndarray) -> np.ndarray:
    """The bytes of white space in UTF-8."""
    space = _SPACE[raw]
    k = np.flatnonzero(_SPACE_LEAD[raw])
    if len(k):
        x, y, z = raw[k], raw[np.minimum(k + 1, len(raw) - 1)], raw[np.minimum(k + 2, len(raw) - 1)]
        two = k[(x == 0xC2) & ((y == 0x85) | (y == 0xA0))]
        three = (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
        three |= (x == 0xE2) & ((y == 0x80) & ((z >= 0x80) & (z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (y == 0x81) & (z == 0x9F))
        three = k[three]
        space[two], space[two + 1] = True, True
        space[three], space[three + 1], space[three + 2] = True, True, True
    return space


def cuts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces begin in the bytes of some texts; text i has those from bounds[i] to bounds[i + 1]."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    space = _spaces(raw)
    cut = edge[:n].copy()
    cut[1:] |= space[1:] & ~space[:-1]
    # the last space before other characters stands apart from those before it, and leads the word if it is a plain one
    last = space[:-1] & ~space[1:] & ~edge[1:n]
    cut[1:] |= last & (raw[:-1] != 0x20)
    letter = _LETTER[raw]
    if raw.max() < 0x80:
        cut[:-1] |= last
    else:
        cut[:-1] |= last & (raw[:-1] < 0x80)
        k = np.flatnonzero(last & (raw[:-1] >= 0x80))
        cut[np.where(raw[k - 1] == 0xC2, k - 1, k - 2)] = True
        letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    cut[1:] |= letter[:-1] & _MARK[raw[1:]]
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts, exactly those of Tokenizer.encode(text, add_special_tokens=False), special strings being plain text."""

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint32 if size > 1 << 16 else np.uint16
        self.bytes = np.zeros(size, np.int64)  # of each id: a byte-level token has a character for each byte
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes[k] = len(token)
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)  # of each piece, as they are first asked for
        self.size, self.at, self.flat = _Growing(np.int64), _Growing(np.int64), _Growing(self.dtype)

    def _has_special(self, raw: np.ndarray) -> bool:
        flat = raw.tobytes()
        return any(s in flat for s in self.special)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, new: pa.BinaryArray) -> None:
        """Encodes the new pieces. Those that begin with a space stay apart in a row of them, so many go as one text, and
        the tokens' bytes tell whose they are."""
        size, at = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        _, _, raw, bounds = next(slices(new, 1 << 62))
        led = (raw[bounds[:-1]] == 0x20) & (np.diff(bounds) > 1)
        led[led] = ~_spaces(raw)[bounds[:-1][led] + 1]
        k = np.flatnonzero(led)
        if len(k):
            _, _, raw, bounds = next(slices(new.take(pa.array(k)), 1 << 62))
        for first in range(0, len(k), 2000):
            own, ends = k[first : first + 2000], bounds[first : first + 2001]
            text = raw[ends[0] : ends[-1]].tobytes().decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            last = np.searchsorted(np.cumsum(self.bytes[ids]), ends[1:] - ends[0]) + 1
            size[own] = np.diff(last, prepend=0)
            at[own] = self.flat.n + last - size[own]
            self.flat.add(ids)
        k = np.flatnonzero(~led)
        for i, found in zip(k, self.tokenizer.encode_batch_fast([x.decode() for x in new.take(pa.array(k)).to_pylist()], add_special_tokens=False)):
            ids = np.array(found.ids, self.dtype)
            size[i], at[i] = len(ids), self.flat.n
            self.flat.add(ids)
        self.size.add(size)
        self.at.add(at)

    def encode(self, texts: pa.Array | list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts with the end id after each, and how many each has; a null is empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        _, _, raw, bounds = next(slices(texts, 1 << 62))
        if not self.by_piece or self._has_special(raw):
            if len(texts) > 1 and self.by_piece:
                parts = [self.encode(texts.slice(i, 1), end) for i in range(len(texts))]
                return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])
            own = [np.append(self.whole(t or ""), self.dtype(end)) for t in texts.to_pylist()]
            return np.concatenate(own), np.array([len(x) for x in own], np.int64)
        if len(self.number) > CACHE_PIECES:
            self.clear()
        begin = cuts(raw, bounds)
        pieces = np.diff(np.searchsorted(begin, bounds))
        offsets = pa.py_buffer(np.append(begin, len(raw)).astype(np.int32))
        different = pa.Array.from_buffers(pa.binary(), len(begin), [None, offsets, pa.py_buffer(raw)]).dictionary_encode()
        known, listed = len(self.number), different.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.number.__getitem__, listed), np.int64, len(listed))
        if len(self.number) > known:
            self._learn(different.dictionary.take(pa.array(np.flatnonzero(number >= known))))
        k = number[different.indices.to_numpy()]
        # one more "piece" closes each text
        stop = np.cumsum(pieces + 1) - 1
        held = np.ones(len(k) + len(pieces), bool)
        held[stop] = False
        size, at = np.ones(len(held), np.int64), np.zeros(len(held), np.int64)
        size[held], at[held] = self.size.held[k], self.at.held[k]
        first = np.cumsum(size) - size
        out = self.flat.held[np.arange(int(size.sum())) + np.repeat(at - first, size)]
        out[first[stop]] = end
        return out, np.diff(first[stop] + 1, prepend=0)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _schema(dtype, sequence: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


class _File:
    """Writes ids as they come; keeps less than one batch."""

    def __init__(self, stream, dtype, sequence: int, batch: int, end: int) -> None:
        self.schema, self.sequence, self.room, self.end, self.dtype = _schema(dtype, sequence), sequence, sequence * batch, end, dtype
        self.out, self.left, self.total = pa.ipc.new_stream(stream, self.schema), np.zeros(0, dtype), 0

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        ids = np.concatenate([self.left, ids])
        whole = len(ids) // self.room * self.room
        for k in range(0, whole, self.room):
            self._batch(ids[k : k + self.room], self.room)
        self.left = ids[whole:].copy()

    def close(self) -> None:
        if n := len(self.left):
            self._batch(np.concatenate([self.left, np.full(-n % self.sequence, self.end, self.dtype)]), n)
        self.out.close()


def _write(folder: str, tokenizer: str, sequence: int, batch: int, end: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        store, root = _file_system(folder)
        name, out = f"{root}/{uuid.uuid4().hex}", None
        low = None
        for rows in batches:
            for part in by_bytes(rows, "text", rows=4096):
                ids, counts = encode.encode(part.column("text"), end)
                if out is None:
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(f"{name}.part")
                    index = pa.ipc.new_stream(store.open_output_stream(f"{name}.index"), INDEX)
                    out, low = _File(stream, encode.dtype, sequence, batch, end), part.column("part")[0].as_py()
                at = out.total + np.cumsum(counts) - counts
                index.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(at), pa.array(counts)], schema=INDEX))
                out.add(ids)
        if len(encode.number) > KEPT_PIECES:  # the worker goes on to other work, too
            encode.clear()
        if out is not None:
            out.close()
            stream.close()
            index.close()
            store.move(f"{name}.part", f"{name}.arrow")
            yield pa.RecordBatch.from_arrays([pa.array([low], pa.int32()), pa.array([name.rpartition("/")[2]]), pa.array([out.total], pa.int64())], ["part", "file", "n_tokens"])

    return of


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, sequence: int = SEQUENCE, batch: int = BATCH, end: int = END_ID, order: list[str] | None = None) -> list[tuple[str, int, int]]:
    """Writes the files into folder and returns (file, its first id's place in the whole run, its ids), in order. docs:
    doc_id, text and the columns of order (by default doc_id)."""
    order = order or ["doc_id"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_{c}") for c in order))
    by = [F.col(f"_{c}").asc_nulls_first() for c in order]
    rows = docs.repartitionByRange(*by).sortWithinPartitions(*by, "text").select("doc_id", "text", F.spark_partition_id().alias("part"))
    done = rows.mapInArrow(_write(folder, tokenizer, sequence, batch, end), "part int, file string, n_tokens long").collect()  # a row for each file
    done.sort(key=lambda r: r.part)
    starts = accumulate((r.n_tokens for r in done), initial=0)
    return [(r.file, start, r.n_tokens) for r, start in zip(done, starts)]


def sequences(path: str) -> list[pa.RecordBatch]:
    """The record batches of a local file, over mapped memory; sequence k is row k % BATCH of batch k // BATCH."""
    return list(pa.ipc.open_stream(pa.memory_map(path)))


def _read(folder: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(folder)
        for rows in batches:
            for name, start in zip(rows.column("file").to_pylist(), rows.column("start").to_pylist()):
                places = pa.ipc.open_stream(store.open_input_stream(f"{root}/{name}.index"))
                stream = pa.ipc.open_stream(store.open_input_stream(f"{root}/{name}.arrow"))
                have, base = np.zeros(0, np.uint16), 0  # ids of the run from base on
                for place in places:
                    offsets, counts = place.column("offset").to_numpy(), place.column("n_tokens").to_numpy()
                    until, more = int(offsets[-1] + counts[-1]), []
                    if int(offsets[0]) > base:
                        have, base = have[int(offsets[0]) - base :], int(offsets[0])
                    n = base + len(have)
                    while n < until:
                        b = stream.read_next_batch()
                        ids = b.column("ids").flatten().to_numpy()[b.column("mask").flatten().to_numpy(zero_copy_only=False)]
                        more.append(ids)
                        n += len(ids)
                    if more:
                        have = np.concatenate([have, *more]) if len(have) else np.concatenate(more)
                    crc = [zlib.crc32(have[o - base : o - base + c].astype("<u4")) for o, c in zip(offsets.tolist(), counts.tolist())]
                    yield pa.RecordBatch.from_arrays([place.column("doc_id"), pa.array(offsets + start), place.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return of


def read_index(spark: SparkSession, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian uint32)."""
    names = spark.createDataFrame(files, "file string, start long, n_tokens long")
    return names.repartition(max(1, len(files)), "file").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    files = write_tokens(table(spark, sf_dir, "documents"), folder, default_tokenizer())
    return read_index(spark, folder, files)
