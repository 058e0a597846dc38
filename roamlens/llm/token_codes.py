"""Token-ID output in directly addressable codes.

A file holds the token ids of consecutive documents.  Every id is cut into 8-bit
chunks: level 0 has the low chunk of all ids, level 1 the next chunk of those
ids that need one, and so on.  Each level's bitmap marks the ids that continue,
and a rank directory (ones before every block of 512 bits) tells where an id's
next chunk lies, so any token is read from any level without decoding a block.

    magic "DACT" | u32 levels | u64 documents | u64 tokens
    i64 ids[documents] | u8 has_id[documents] | u64 start[documents + 1]
    per level: u64 n | u8 chunk[n] | u64 bits[ceil(n / 64)] | u64 ones_before[ceil(n / 512)]

``write_token_files`` ranges the documents by id over tasks; each task encodes
its texts and writes one file under a temporary name, then renames it, so a
repeated task leaves the same file.  ``read_token_files`` reads the files back.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamlens.llm.common import as_uri, materialise, new_folder

END_ID = 2
BLOCK_BITS = 512
_MAGIC = b"DACT"
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Texts that are encoded together.
ROWS_AT_ONCE = 256
#: A task begins another file before its present one would hold more tokens (one document may).
FILE_TOKENS = 1 << 24
#: Ids are read in runs of at most so many tokens.
RUN_TOKENS = 1 << 22


# --- the file format -------------------------------------------------------

def pack_levels(ids: np.ndarray) -> list[bytes]:
    out, rest = [], ids.astype(np.uint64)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), np.uint8)))
        ones = _POPCOUNT[bits].reshape(-1, BLOCK_BITS // 8).sum(1, dtype=np.uint64)
        before = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u8") if len(ones) else ones.astype("<u8")
        words = -(-len(rest) // 64) * 8
        out.append(struct.pack("<Q", len(rest)) + (rest & np.uint64(255)).astype(np.uint8).tobytes()
                   + bits[:words].tobytes() + before.tobytes())
        if not more.any():
            return out
        rest = rest[more] >> np.uint64(8)


def pack_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    levels = pack_levels(ids)
    n = len(doc_ids)
    start = np.concatenate(([0], np.cumsum(lengths))).astype("<u8")
    return b"".join([
        _MAGIC, struct.pack("<IQQ", len(levels), n, len(ids)),
        np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
        np.array([x is not None for x in doc_ids], np.uint8).tobytes(), start.tobytes(), *levels])


class TokenFile:
    """Random access to the tokens of one file's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a token file")
        self.buf = memoryview(data)
        n_levels, n, self.n_tokens = struct.unpack_from("<IQQ", data, 4)
        self.at = 24
        ids, has = self._take("<i8", n), self._take("u1", n)
        self.doc_ids = [int(i) if h else None for i, h in zip(ids, has)]
        self.start = self._take("<u8", n + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            k = int(self._take("<u8", 1)[0])
            chunk, bits = self._take("u1", k), self._take("u1", -(-k // 64) * 8)
            self.levels.append((chunk, bits, self._take("<u8", -(-k // BLOCK_BITS))))

    def _take(self, kind: str, n: int) -> np.ndarray:
        a = np.frombuffer(self.buf, kind, n, self.at)
        self.at += a.nbytes
        return a

    @staticmethod
    def _rank(level: tuple, i: int) -> int:
        """Continuing ids before place ``i`` of a level."""
        chunk, bits, before = level
        if i >= len(chunk):
            return int(_POPCOUNT[bits].sum())
        block = i // BLOCK_BITS
        part = np.unpackbits(bits[block * BLOCK_BITS // 8:i // 8 + 1], bitorder="little")[:i - block * BLOCK_BITS]
        return int(before[block]) + int(part.sum())

    def token(self, i: int) -> int:
        """The ``i``-th id of the file."""
        value, shift = 0, 0
        for level in self.levels:
            chunk, bits, _ = level
            value |= int(chunk[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i, shift = self._rank(level, i), shift + 8
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids ``a`` to ``b`` (excluded)."""
        out, where, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for level in self.levels:
            chunk, bits, _ = level
            out[where] |= chunk[a:b].astype(np.uint32) << np.uint32(shift)
            lo = a // 8
            more = np.unpackbits(bits[lo:-(-b // 8)], bitorder="little")[a - lo * 8:b - lo * 8].astype(bool)
            where, shift = where[more], shift + 8
            if not len(where):
                break
            a, b = self._rank(level, a), self._rank(level, b)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.start[k]), int(self.start[k + 1]))


# --- encoding --------------------------------------------------------------

#: Places where the byte-level splitter always cuts: before a single space, and
#: between letters and anything else, as long as there is no apostrophe
#: (contractions), no run of white space and no letter outside these ranges.
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f"
_S = rf"{_L}0-9.,!?;:#$%&*|\"()+=@/<>_-"
_SAFE = re.compile(rf"[ \n]?(?:[{_S}]+[ \n])*+[{_S}]*")
_UNIT = re.compile(rf" ?[{_L}]+| ?[^{_L} ]+| ")


#: The letter that stands for each byte in a byte-level vocabulary: printable bytes
#: stand for themselves, the others are counted from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _plain_byte_pairs(tokenizer) -> bool:
    """Whether a piece of the splitter is spelt in byte letters and merged, and nothing else."""
    from tokenizers import models, pre_tokenizers

    split, model = tokenizer.pre_tokenizer, tokenizer.model
    return (tokenizer.normalizer is None and isinstance(split, pre_tokenizers.ByteLevel) and not split.add_prefix_space
            and isinstance(model, models.BPE) and not model.dropout)


class _Units(dict):
    """What ``fn`` gives for each key, kept for two generations of ``most`` keys: what was
    not asked for in a whole generation goes."""

    def __init__(self, fn, most: int):
        super().__init__()
        self.fn, self.most, self.old = fn, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        self[key] = got = self.fn(key) if got is None else got
        return got


class Encoder:
    """Whole texts to ids with the tokenizers library.  A text is encoded as the
    units between places where the vocabulary's splitter always cuts, and each
    worker keeps the units it has seen.  A new unit of letters goes straight to the
    library's merge model, as the splitter and its offsets cost more than the merges;
    other units and texts where the cuts are not certain go to the library as they are."""

    MOST_KEPT = 400_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.units = _Units(self._unit_ids, self.MOST_KEPT)
        self.model = self.tokenizer.model if _plain_byte_pairs(self.tokenizer) else None
        #: Strings that the library takes out of a text before it is split.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _certain(self, text: str) -> bool:
        return _SAFE.fullmatch(text) is not None and not any(a in text for a in self.added)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in got]

    def _unit_ids(self, unit: str) -> bytes:
        """The ids of a unit; one of letters is one piece to the splitter."""
        if self.model is None or not (unit[1:] if unit[0] == " " else unit).isalpha():
            return self._ids([unit])[0]
        spelt = unit.replace(" ", "\u0120") if unit.isascii() else unit.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = [t or "" for t in texts]
        certain = [self._certain(t) for t in texts]
        of = self.units.__getitem__
        out = [b"".join(map(of, _UNIT.findall(t))) if c else b"" for t, c in zip(texts, certain)]
        whole = [i for i, c in enumerate(certain) if not c]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole])):
            out[i] = ids
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- the operator ----------------------------------------------------------

def write_token_files(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode all texts and write their files in ascending id order (null ids
    first, equal ids by text).  Returns the manifest: part, file (within the part),
    path, n_docs, n_tokens, base (tokens in all files before it).  A file holds at
    most ``file_tokens`` tokens, or one document, so neither the writer nor the
    reader keeps more, whatever the number of rows in a task.

    A null or empty text has the end id alone; an empty table makes no files;
    other columns are not read."""
    import pyarrow as pa

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    uri = as_uri(folder)

    def write(it):
        from pyarrow import fs
        from pyspark import TaskContext

        enc, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(uri)
        ids, lengths, blobs, held, made = [], [], [], 0, 0

        def save():
            nonlocal ids, lengths, blobs, held, made
            data = pack_file(ids, np.array(lengths), np.frombuffer(b"".join(blobs), "<u4"))
            store.create_dir(root, recursive=True)
            path = f"{root}/part-{part:08d}-{made:06d}.dact"
            temporary = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(data)
            store.move(temporary, path)
            row = {"part": part, "file": made, "path": path, "n_docs": len(ids), "n_tokens": held}
            ids, lengths, blobs, held, made = [], [], [], 0, made + 1
            return pa.RecordBatch.from_pylist([row])

        for b in it:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), ROWS_AT_ONCE):
                for i, e in zip(names[at:at + ROWS_AT_ONCE], enc.encode_all(texts[at:at + ROWS_AT_ONCE])):
                    n = len(e) // 4 + 1
                    if ids and held + n > file_tokens:
                        yield save()
                    ids.append(i)
                    lengths.append(n)
                    blobs += (e, end)
                    held += n
        if ids:
            yield save()

    ranged = (docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
              .repartitionByRange(parts, "id", F.xxhash64("text"))
              .sortWithinPartitions("id", F.xxhash64("text"), "text"))
    files = materialise(ranged.mapInArrow(write, "part long, file long, path string, n_docs long, n_tokens long"), "token-manifest")
    # One row for each file.
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    import pyarrow as pa

    uri = as_uri(folder)
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(it):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri)
        for b in it:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_input_file(path) as f:
                    tf = TokenFile(f.read())
                at, n = 0, len(tf.doc_ids)
                while at < n:  # a run of whole documents
                    to = max(at + 1, int(np.searchsorted(tf.start, tf.start[at] + RUN_TOKENS, "right")) - 1)
                    run, first = tf.tokens(int(tf.start[at]), int(tf.start[to])), int(tf.start[at])
                    cut = tf.start[at:to + 1] - first
                    crc = [zlib.crc32(run[x:y].astype("<u4").tobytes()) for x, y in zip(cut[:-1], cut[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tf.doc_ids[at:to], pa.int64()), pa.array(tf.start[at:to] + base, pa.int64()),
                         pa.array(np.diff(cut), pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = to

    files = manifest.select("path", "base").repartition(parts, "path")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_codes(docs: DataFrame, vocabulary: str, folder: str | None = None, **names) -> DataFrame:
    """Write the token files and read them back."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, vocabulary, folder, **names), folder)
