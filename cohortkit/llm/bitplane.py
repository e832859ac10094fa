"""Token ids in bit-plane files.

A file holds the ids of a run of documents, cut into blocks of ``block`` ids.  A
block's ids are transposed: plane b has bit (or byte) b of every id, one after
another, so high planes are long runs and compress to almost nothing.  Each plane
is compressed with zstandard by itself, and the chunk index at the end of the
file gives each plane's place: a reader fetches the blocks it needs and no more,
and skips planes that are empty.

File: magic, planes one after another, then the index, its length, magic.  The
index (zstandard) has, as little-endian 64-bit numbers: the block size, the plane
width in bits, the number of planes, ids and documents; the end of each plane; each
document's id and number of ids (the number's complement if the id is null).

Files are written in ascending document order (a range shuffle), one or more a
task, each under a name of its own; only names in the manifest, which Spark
commits, count, so a task that runs twice leaves no trace.

Encoding.  Byte-level BPE never merges across the borders of its pre-tokens, and
no pre-token crosses a cut made where a letter or digit meets another class, or
before a single blank, or around a single line break.  Texts are cut there and
each distinct piece of a batch is encoded once by the tokenizers library.  A text
that holds a special token's string is encoded whole.

Defined results: a null or empty text has no ids of its own, only the end id; a
null document id stays null, before all others; rows
with the same id keep an order by text; an empty table has no files.
"""

from __future__ import annotations

import sys
import types
import uuid
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import open_store, pieces, shuffle_partitions, stage, stage_path

MAGIC = b"BITPLN1\n"


@dataclass(frozen=True)
class Planes:
    block: int = 1 << 16
    unit: str = "byte"  # or "bit"
    level: int = 3
    file_ids: int = 1 << 24  # a file is closed after so many ids


# -- planes -----------------------------------------------------------------

def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """32 bit planes or 4 byte planes of unsigned 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [raw[:, b].tobytes() for b in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, b], bitorder="little").tobytes() for b in range(32)]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    if unit == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class Writer:
    """Writes one file; ``add`` documents, then ``close``."""

    def __init__(self, out, how: Planes):
        self.out, self.how, self.zip = out, how, zstandard.ZstdCompressor(level=how.level)
        self.ends, self.docs, self.wait, self.waiting, self.ids = [], [], [], 0, 0
        self.at = out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((0, ~len(ids)) if doc_id is None else (doc_id, len(ids)))
        self.wait.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= self.how.block:
            all_ids = np.concatenate(self.wait)
            cut = len(all_ids) - len(all_ids) % self.how.block
            for a in range(0, cut, self.how.block):
                self._block(all_ids[a:a + self.how.block])
            self.wait, self.waiting = [all_ids[cut:].copy()], len(all_ids) - cut

    def _block(self, ids) -> None:
        for plane in to_planes(ids, self.how.unit):
            self.at += self.out.write(self.zip.compress(plane))
            self.ends.append(self.at)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.wait))
        head = [self.how.block, 1 if self.how.unit == "bit" else 8, len(self.ends), self.ids, len(self.docs)]
        docs = np.array(self.docs, dtype="<i8").reshape(-1, 2)
        index = np.concatenate([np.array(head, "<i8"), np.array(self.ends, "<i8"), docs[:, 0], docs[:, 1]])
        raw = self.zip.compress(index.astype("<i8").tobytes())
        self.out.write(raw)
        self.out.write(len(raw).to_bytes(8, "little") + MAGIC)


class Reader:
    """Random access to the ids of a file (a seekable binary file and its length)."""

    def __init__(self, src, size: int):
        self.src = src
        src.seek(size - 16)
        n = int.from_bytes(src.read(8), "little")
        if src.read(8) != MAGIC:
            raise ValueError("not a bit-plane file, or cut short")
        src.seek(size - 16 - n)
        x = np.frombuffer(zstandard.ZstdDecompressor().decompress(src.read(n)), "<i8")
        self.block, width, planes, self.n_ids, n_docs = (int(v) for v in x[:5])
        self.unit, self.per_block = ("bit", 32) if width == 1 else ("byte", 4)
        self.ends = np.concatenate([[len(MAGIC)], x[5:5 + planes]])
        sizes = x[5 + planes + n_docs:]
        self.doc_ids = [None if n < 0 else int(d) for d, n in zip(x[5 + planes:5 + planes + n_docs], sizes)]
        self.sizes = np.where(sizes < 0, ~sizes, sizes)
        self.unzip = zstandard.ZstdDecompressor()

    def read_block(self, b: int) -> np.ndarray:
        ends = self.ends[b * self.per_block:(b + 1) * self.per_block + 1]
        self.src.seek(int(ends[0]))
        raw = self.src.read(int(ends[-1] - ends[0]))
        n = min(self.block, self.n_ids - b * self.block)
        planes = [self.unzip.decompress(raw[x - ends[0]:y - ends[0]]) for x, y in zip(ends[:-1], ends[1:])]
        return from_planes(planes, n, self.unit)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a..b of the file, reading only the blocks they lie in."""
        if a >= b:
            return np.zeros(0, "<u4")
        first, last = a // self.block, (b - 1) // self.block
        got = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return got[a - first * self.block:b - first * self.block]

    def documents(self):
        """(doc_id, ids) in file order, one block in memory (and the document that crosses it)."""
        rest, block = np.zeros(0, "<u4"), 0
        for doc_id, n in zip(self.doc_ids, self.sizes):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.read_block(block))
                have += len(parts[-1])
                block += 1
            got = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc_id, got[:n]
            rest = got[n:]


# -- encoding -------------------------------------------------------------------

LETTER, DIGIT, BLANK, BREAK, MARK, OTHER = 1, 2, 3, 4, 5, 0
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[32], _CLASS[10] = BLANK, BREAK
_CLASS[[c for c in range(33, 127) if _CLASS[c] == OTHER]] = MARK


def cuts(buf: np.ndarray) -> np.ndarray:
    """Flags of UTF-8 bytes where a pre-token surely begins."""
    cls = _CLASS[buf]
    # letters of the Latin-1 supplement: lead byte C3 and the byte after it, without the two signs among them
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    cls[lead] = cls[lead + 1] = LETTER
    before, here = cls[:-1], cls[1:]
    solid = (cls == LETTER) | (cls == DIGIT) | (cls == MARK)
    cut = np.zeros(len(buf), dtype=bool)
    # a letter or digit, then a mark, a digit or a letter; a mark other than the apostrophe, then a letter or digit
    word_b, word_h = (before == LETTER) | (before == DIGIT), (here == LETTER) | (here == DIGIT)
    cut[1:] = (word_b & (here == MARK)) | (word_b & word_h & (before != here)) | (
        (before == MARK) & (buf[:-1] != 39) & word_h)
    if len(buf) > 2:
        single = solid[:-2] & solid[2:]
        blank, brk = single & (cls[1:-1] == BLANK), single & (cls[1:-1] == BREAK)
        cut[1:-1] |= blank | brk
        cut[2:] |= brk
    return cut


class Encoder:
    """Ids of whole texts; distinct pieces are encoded once while the cache holds them."""

    def __init__(self, path: str, cache: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        # the byte-level alphabet: printable bytes are themselves, the others follow from 256
        self.alphabet = {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(rest)}}
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.cache = cache
        self._clear()

    def _clear(self):
        self.known = {}  # piece -> its number; piece k has ids table[ends[k]:ends[k + 1]]
        self.table, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _pre_token(self, piece: str) -> bool:
        """Whether the piece is surely one pre-token: a blank at most, then only letters or only digits."""
        word = piece[1:] if piece[0] == " " else piece
        return word.isalpha() or (word.isascii() and word.isdigit())

    def _learn(self, new: list[str]) -> None:
        bpe, letters = self.model.tokenize, self.alphabet
        ids = [[t.id for t in bpe(u.encode().decode("latin-1").translate(letters))] if self._pre_token(u)
               else self.tok.encode(u, add_special_tokens=False).ids for u in new]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.table = np.concatenate([self.table, np.fromiter(chain.from_iterable(ids), "<u4")])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in ids])])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        whole = {i: np.array(self.tok.encode(t.decode(), add_special_tokens=False).ids, dtype="<u4")
                 for i, t in enumerate(texts) if any(s in t for s in self.special)}
        joined = b"".join(t for i, t in enumerate(texts) if i not in whole)
        if not joined:
            return [whole.get(i, np.zeros(0, "<u4")) for i in range(len(texts))]
        ends = np.cumsum([0 if i in whole else len(t) for i, t in enumerate(texts)])
        buf = np.frombuffer(joined, np.uint8)
        begin = cuts(buf)
        # texts are cut apart; a cut found by looking across the seam of two texts is none
        near = np.concatenate([ends - 1, ends + 1])
        begin[near[(near >= 0) & (near < len(buf))]] = False
        begin[ends[ends < len(buf)]] = begin[0] = True
        at = np.append(np.flatnonzero(begin), len(buf))
        arr = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(joined)])
        code = pc.dictionary_encode(arr)
        uniq = code.dictionary.to_pylist()
        if len(self.known) + len(uniq) > self.cache:
            self._clear()
        known = self.known
        new = [u for u in uniq if u not in known]
        if new:
            self._learn(new)
        number = np.fromiter(map(known.__getitem__, uniq), np.int64, len(uniq))[code.indices.to_numpy()]
        first = self.ends[number]
        upto = np.cumsum(self.ends[number + 1] - first)
        flat = self.table[np.arange(upto[-1]) + np.repeat(first - np.append(0, upto[:-1]), np.diff(upto, prepend=0))]
        place = np.append(0, upto)[np.searchsorted(at, np.append(0, ends))]
        return [whole[i] if i in whole else flat[place[i]:place[i + 1]] for i in range(len(texts))]


def encoder(path: str) -> Encoder:
    """The worker process's encoder: its cache of pieces outlives a task."""
    held = sys.modules.setdefault("_bitplane_encoders", types.ModuleType("_bitplane_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def write_ids(docs: DataFrame, tokenizer: str, path: str, how: Planes = Planes(), end_id: int = 0,
              id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Writes bit-plane files under ``path``; returns their manifest (part, file_no, name, n_docs, n_ids), committed."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = parts or shuffle_partitions(docs.sparkSession)
    src = (src.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
           .select("doc_id", "text", F.spark_partition_id().alias("part")))

    def run(batches):
        store, root = open_store(path)
        store.create_dir(root, recursive=True)
        enc, out, writer, name, number, done = encoder(tokenizer), None, None, None, 0, []
        part = 0

        def close():
            nonlocal writer
            writer.close()
            out.close()
            done.append((part, number, name, len(writer.docs), writer.ids))
            writer = None

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            ids = batch.column(0).to_pylist()
            for a, b in pieces(texts, 8_000_000):
                part = batch.column(2)[a].as_py()
                for d, x in zip(ids[a:b], enc.encode([t or b"" for t in texts[a:b]])):
                    if writer is None:
                        name = f"ids-{part:05d}-{number:05d}-{uuid.uuid4().hex}.bpl"
                        out = store.open_output_stream(f"{root}/{name}")
                        writer = Writer(out, how)
                    writer.add(d, np.append(x, np.uint32(end_id)))
                    if writer.ids >= how.file_ids:
                        close()
                        number += 1
        if writer is not None:
            close()
        cols = list(zip(*done)) or [[], [], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
            ["part", "file_no", "name", "n_docs", "n_ids"])

    return stage(src.mapInArrow(run, "part int, file_no int, name string, n_docs long, n_ids long"), "ids-manifest")


def read_ids(spark: SparkSession, path: str, manifest: DataFrame, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files of the manifest, in any row order.

    ``start`` counts the ids of all documents before it in file order.
    """
    order = Window.orderBy("part", "file_no")  # a row a file
    files = manifest.withColumn("before", F.sum("n_ids").over(order) - F.col("n_ids"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")

    def run(batches):
        store, root = open_store(path)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = store.get_file_info(f"{root}/{name}").size
                with store.open_input_file(f"{root}/{name}") as src:
                    rows = []
                    held = 0
                    for doc_id, ids in Reader(src, size).documents():
                        rows.append((doc_id, before, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()),
                                     *([] if digest_only else [ids.astype(np.int64)])))
                        before += len(ids)
                        held += len(ids)
                        if held > 1 << 22 or len(rows) >= 10_000:
                            yield out(rows)
                            rows, held = [], 0
                    yield out(rows)

    def out(rows):
        cols = list(zip(*rows)) or [[]] * (4 if digest_only else 5)
        arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if not digest_only:
            arrays.append(pa.array(cols[4], pa.list_(pa.int64())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    n = shuffle_partitions(spark)
    return files.select("name", "before").repartition(n, "name").mapInArrow(run, schema)


def encode_documents(docs: DataFrame, tokenizer: str, how: Planes = Planes(), **cols) -> DataFrame:
    """Writes ``docs`` as bit-plane files in the shared folder and reads their digests back."""
    path = stage_path(docs.sparkSession, "bitplanes")
    return read_ids(docs.sparkSession, path, write_ids(docs, tokenizer, path, how, **cols), digest_only=True)
