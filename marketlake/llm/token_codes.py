"""Token ids in files of directly addressable codes.

Ids are cut into chunks of `WIDTH` bits, the lowest first. Level k of a file holds chunk k of every id that has one, and a bitmap which
of them go on in level k + 1; the last level needs none. A directory counts the set bits before every
`RANK` bits, so the place of an id in the next level is one entry plus the bits of one stretch: any
token is read without decoding others.

A file is a header (magic, number of documents, of ids, of levels), the documents' ids, null marks and lengths, and for each
level its chunks, its bitmap and its directory. Files follow one another in ascending order of doc_id.
"""

from __future__ import annotations

import gc
import json
import os
import string
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlake.llm._tables import file_system, new_file, shuffle_partitions, stored
from marketlake.plans.scratch import scratch_path

END = 2
WIDTH = 8
RANK = 512
#: Ids of a file, about.
FILE = 1 << 22
#: Bytes of text encoded at once, about.
TEXT = 1 << 22
MAGIC = b"DACTOK01"
HEADER = struct.Struct("<8sQQB")

MANIFEST = "part int, file int, path string, n_docs long, n_tokens long"


#: No letters, digits or blanks, and no part of a letter before them.
SIGNS = string.punctuation.encode()

# How a file of the tokenizers library says that texts are composed, blanks folded, letters lowered, and words cut
# into letters, single digits and runs of signs, as bytes.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": CUT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _byte_letters() -> dict[int, int]:
    """The character by which byte-level models write each byte: itself if it is printed, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


BYTES = _byte_letters()


class Words(dict):
    """Ids of the tokenizer for each blank-separated word, as bytes of unsigned 32-bit numbers.

    A tokenizer of the rules above cuts at white space, and drops it, before it merges; so the ids of a text are those
    of its words. ASCII signs after the letters of a word are a stretch of their own, and letters go
    to the merges as the rules leave them, so the forms of a word are merged once. `by_words` tells whether a tokenizer has these
    rules; with others, texts are encoded whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        rules = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in rules["added_tokens"]]
        self.by_words = (
            (rules["normalizer"], rules["pre_tokenizer"], rules["model"]["type"]) == (NORMALIZER, PRE_TOKENIZER, "BPE")
            and rules["truncation"] is None
            and rules["padding"] is None
            # No added token may lie within letters or signs alone, or hold a blank.
            and all(any(c.isalpha() for c in t) and not t.isalpha() and len(t.split()) == 1 for t in added)
        )
        self.model = self.tokenizer.model

    def whole(self, texts: list[bytes | None]) -> list[np.ndarray]:
        every = self.tokenizer.encode_batch_fast([(t or b"").decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in every]

    def _stem(self, core: bytes) -> bytes | None:
        """A word of letters alone as the normalizer leaves it, None for other words.

        Latin letters below U+0250 are composed already and have one lower case each, but for U+0130.
        """
        if core.isascii():
            return core.lower() if core.isalpha() else None
        text = core.decode()
        if not text.isalpha():
            return None
        if max(text) < "\u0250" and "\u0130" not in text:
            return text.lower().encode()
        text = self.tokenizer.normalizer.normalize_str(text)
        return text.encode() if text.isalpha() else None

    def learn(self, words: set[bytes]) -> None:
        """Makes an entry for each of `words`; of those before, a full table keeps what `words` holds."""
        if len(self) > self.most:
            kept = {w: self[w] for w in words if w in self}
            self.clear()
            self.update(kept)
        forms, plain = {}, set()
        for w in words.difference(self):
            core = w.rstrip(SIGNS)
            stem = self._stem(core) if core else None
            if stem is None:
                plain.add(w)
                continue
            tail = w[len(core) :]
            if tail:
                plain.add(tail)
            forms[w] = (stem, tail)
        plain = list(plain.difference(self))
        for w, ids in zip(plain, self.whole(plain), strict=True):
            self[w] = ids.tobytes()
        merge = self.model.tokenize
        for w, (stem, tail) in forms.items():
            ids = self.get(stem)
            if ids is None:
                text = stem.decode("latin-1")
                ids = self[stem] = array("I", [t.id for t in merge(text if stem.isascii() else text.translate(BYTES))]).tobytes()
            self[w] = ids + self[tail] if tail else ids


_kept: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """The table of a tokenizer that this worker keeps from task to task."""
    if path not in _kept:
        _kept[path] = Words(path)
    return _kept[path]


def encode_texts(texts: list[bytes | None], words: Words) -> list[np.ndarray]:
    """Ids of each text, without the end id."""
    if not words.by_words:
        return words.whole(texts)
    collects = gc.isenabled()
    gc.disable()  # nothing here holds a circle, and each search for one walks the whole table
    try:
        split = [(t or b"").split() for t in texts]
        every: set[bytes] = set()
        for s in split:
            every.update(s)
        words.learn(every)
        return [np.frombuffer(b"".join(map(words.__getitem__, s)), np.uint32) for s in split]
    finally:
        if collects:
            gc.enable()


def _levels(ids: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks and continuation bits of each level."""
    kind = np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32
    while True:
        more = ids >> np.uint32(width) > 0 if width < 32 else np.zeros(len(ids), bool)
        yield (ids & np.uint32((1 << width) - 1)).astype(kind), more
        ids = ids[more] >> np.uint32(width)
        if not len(ids):
            return


def pack(docs: list[tuple[int | None, np.ndarray]], width: int = WIDTH) -> bytes:
    """A file of documents (doc_id, ids)."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.empty(0, np.uint32)
    levels = list(_levels(ids.astype(np.uint32), width))
    if len(levels) > 7:  # the header keeps the number of levels in three bits
        raise ValueError(f"ids up to {int(ids.max())} take {len(levels)} levels of {width} bits; at most 7 are allowed")
    parts = [HEADER.pack(MAGIC, len(docs), len(ids), len(levels) | (width - 1) << 3)]
    parts.append(np.array([d or 0 for d, _ in docs], np.int64).tobytes())
    parts.append(np.packbits(np.array([d is None for d, _ in docs], bool)).tobytes())
    parts.append(np.array([len(x) for _, x in docs], np.uint64).tobytes())
    for k, (chunks, more) in enumerate(levels):
        parts.append(struct.pack("<Q", len(chunks)) + chunks.tobytes())
        if k < len(levels) - 1:
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate((bits, np.zeros(-len(bits) % (RANK // 8), np.uint8)))
            counts = np.bitwise_count(bits.reshape(-1, RANK // 8)).sum(axis=1, dtype=np.uint64)
            parts += [bits.tobytes(), (np.cumsum(counts) - counts).astype(np.uint64).tobytes()]
    return b"".join(parts)


class Codes:
    """A file of codes: `docs` are (doc_id, first, length); single tokens and ranges are decoded from the levels."""

    def __init__(self, data: bytes):
        magic, n_docs, self.n, shape = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of codes")
        n_levels, self.width = shape & 7, (shape >> 3) + 1
        at = HEADER.size

        def take(kind, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take(np.int64, n_docs), np.unpackbits(take(np.uint8, -(-n_docs // 8)), count=n_docs)
        lengths = take(np.uint64, n_docs).astype(np.int64)
        self.docs = [
            (None if x else int(d), int(f), int(k))
            for d, x, f, k in zip(ids, null, np.cumsum(lengths) - lengths, lengths, strict=True)
        ]
        kind = np.uint8 if self.width <= 8 else np.uint16 if self.width <= 16 else np.uint32
        self.levels = []
        for k in range(n_levels):
            size = int(take(np.uint64, 1)[0])
            chunks = take(kind, size)
            blocks = -(-size // RANK)
            rest = (take(np.uint8, blocks * RANK // 8), take(np.uint64, blocks)) if k < n_levels - 1 else (None, None)
            self.levels.append((chunks, *rest))

    def _rank(self, level: int, place: int) -> int:
        _, bits, counts = self.levels[level]
        block = place // RANK
        first, last = block * RANK // 8, place // 8
        inside = int(np.bitwise_count(bits[first:last]).sum()) + int(bits[last] & ((1 << place % 8) - 1)).bit_count()
        return int(counts[block]) + inside

    def token(self, place: int) -> int:
        """The id at `place`."""
        out = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            out |= int(chunks[place]) << (k * self.width)
            if bits is None or not bits[place // 8] >> (place % 8) & 1:
                break
            place = self._rank(k, place)
        return out

    def tokens(self, first: int, last: int) -> np.ndarray:
        """The ids from `first` up to `last`, without looking at others."""
        out = np.zeros(last - first, np.uint32)
        at = np.arange(last - first)
        for k, (chunks, bits, _) in enumerate(self.levels):
            if last <= first:
                break
            out[at] |= chunks[first:last].astype(np.uint32) << np.uint32(k * self.width)
            if bits is None:
                break
            low = first // 8
            more = np.unpackbits(bits[low : -(-last // 8)], bitorder="little")[first - 8 * low :][: last - first].astype(bool)
            at = at[more]
            first = self._rank(k, first)
            last = first + len(at)
        return out


def _writer(folder: str, tokenizer: str, end: int, width: int, file: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), words_of(tokenizer)
        held, n, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            uri, fs, path = new_file(folder, ".dac")
            with fs.open_output_stream(path, compression=None) as f:
                f.write(pack(held, width))
            row = [[part], [number], [uri], [len(held)], [n]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            names = ["part", "file", "path", "n_docs", "n_tokens"]
            return pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at, done = 0, 0
            while at < b.num_rows:
                end_row = max(at + 1, int(np.searchsorted(sizes, done + TEXT, "right")))
                piece = b.slice(at, end_row - at)
                at, done = end_row, int(sizes[end_row - 1])
                texts = piece.column("text").cast(pa.large_binary()).to_pylist()
                ids = encode_texts(texts, words)
                for doc_id, x in zip(piece.column("doc_id").to_pylist(), ids, strict=True):
                    held.append((doc_id, np.append(x, np.uint32(end))))
                    n += len(x) + 1
                    if n >= file:
                        yield flush()
                        held, n, number = [], 0, number + 1
        if held:
            yield flush()

    return run


def write(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = END, width: int = WIDTH, file: int = FILE
) -> DataFrame:
    """Encodes every whole text of `docs` (doc_id, text), `end` after each, into files below `folder`; the stored manifest.

    Null counts as empty. Documents without doc_id come first; rows that repeat a doc_id are in
    order of their texts' hashes. `tokenizer` is the path of a file of the tokenizers library on every executor.
    The manifest has part and file (in order), path, n_docs, n_tokens, and first_token, the ids in all files before.
    """
    folder = folder or scratch_path(docs.sparkSession, "codes")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    written = stored(
        rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "mark")
        .sortWithinPartitions("doc_id", "mark")
        .select("doc_id", "text")
        .mapInArrow(_writer(folder, tokenizer, end, width, file), MANIFEST),
        "codes-files",
    )
    # Sums of the ranges first: the window without a key has a row for each shuffle partition.
    ranges = written.groupBy("part").agg(F.sum("n_tokens").alias("s"))
    before = ranges.select(
        "part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return (
        written.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(before), "part")
        .withColumn("first_token", F.col("before") + F.col("inside"))
        .drop("before", "inside")
    )


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, first in zip(b.column("path").to_pylist(), b.column("first_token").to_pylist(), strict=True):
            fs, name = file_system(path)
            with fs.open_input_file(name) as f:
                codes = Codes(f.read())
            for at in range(0, len(codes.docs), 1024):
                docs = codes.docs[at : at + 1024]
                ids = [codes.tokens(f, f + n) for _, f, n in docs]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))
                )
                yield pa.record_batch(
                    [
                        pa.array([d for d, _, _ in docs], pa.int64()),
                        pa.array([first + f for _, f, _ in docs], pa.int64()),
                        pa.array([n for _, _, n in docs], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        lists,
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of every document in the files of `manifest`."""
    files = manifest.select("path", "first_token").repartition(shuffle_partitions(manifest.sparkSession), "path")
    return files.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
