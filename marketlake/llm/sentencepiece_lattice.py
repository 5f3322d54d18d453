"""SentencePiece encoding as a relational lattice, and decoding.

The text is prepared as the library does for a model without further rules: a blank in front, blanks as U+2581. It falls
into chunks, a run of blanks with the characters up to the next blank, and chunks into units, cut wherever no
piece holds the two characters side by side: no piece crosses a cut, so the best path of a text is that of its units.
Spark takes each different unit once: explodes its substrings of up to the length of the longest piece,
equi-joins them to the piece table and groups the edges by unit; where units meet their asks, Viterbi goes over thousands at once. A unit is never cut
where a piece may span; one of more than `UNIT` characters, as a run of letters without blanks, is folded where its documents are put together, by
the same costs and the same rule for ties. A character without a piece falls back to its UTF-8 bytes.

Documents are dealt to blocks of some `BLOCK` bytes, as many as the bytes of all texts need, their texts packed with Zstandard.
Each block asks for its different units, one row for each bucket of their hashes that holds any, so never more rows than units.
The lattice knows nothing of who asks: a bucket's paths meet its asks once they are found, and a block gets one row of pieces back
for each row it asked, in the same order. Texts, chunks and units are Arrow arrays with numbers for repeats.

A path's cost is the sum of its pieces' costs. For a unigram model that is minus the score. A BPE model has no
probabilities but ranks; by Zipf's law a piece of rank r costs ln r, and `PIECE` more for being a piece.
"""

from __future__ import annotations

import ctypes
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm._tables import shuffle_partitions
from marketlake.llm._words import lanes

BLANK = "▁"
#: Characters of a unit in the join at most.
UNIT = 64
#: Costs are whole numbers of hundredths. What each piece of a BPE model costs besides the logarithm of its rank.
SCALE, PIECE = 100, 6.0
#: Bytes of text that a task packs at once, and of a block, about; there are as many buckets as blocks.
PACK, BLOCK = 1 << 23, 6 << 20
#: Shuffle partitions at most, for each one that the session sets: more blocks share partitions.
SPREAD = 2
#: Units whose paths are looked for at once.
SOLVED = 1 << 14
# Bits of a place in a unit and of a number in the piece table; a path's cost has the other 29.
PLACE, NUMBER = 7, 20
NONE = np.empty(0, np.int32)

_CHUNK = re.compile("(?<=[^ ]) ")


class Pieces:
    """The piece table of a model: piece, cost, and ids; a character that only longer pieces hold stands for its bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        model, proto = SentencePieceProcessor(model_file=path), ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        bpe = proto.trainer_spec.model_type == 2
        size = model.vocab_size()
        self.byte = next(i for i in range(size) if model.is_byte(i))
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.spelled = {i: model.id_to_piece(i).encode() for i in plain} | {self.byte + b: bytes([b]) for b in range(256)}
        costs = [np.log(rank) + PIECE if bpe else -model.get_score(i) for rank, i in enumerate(plain, 1)]
        lowest = min(0.0, min(costs))
        self.table = [(model.id_to_piece(i), round((c - lowest) * SCALE), (i,)) for i, c in zip(plain, costs, strict=True)]
        dear = max(c for _, c, _ in self.table) + SCALE
        self.single = {p: ids for p, _, ids in self.table if len(p) == 1}
        lost = sorted({c for p, _, _ in self.table for c in p} - self.single.keys())
        self.table += [(c, dear * len(c.encode()), self.bytes_of(c)) for c in lost]
        self.costs = np.array([c for _, c, _ in self.table], np.int64)
        self.lengths = np.array([len(p) for p, _, _ in self.table], np.int32)
        # Numbers of the characters that pieces hold, 0 for all others, and which of them pieces hold side by side.
        every = sorted({c for p, _, _ in self.table if len(p) > 1 for c in p})
        self.letters = np.zeros(0x110000, np.uint16)
        self.letters[[ord(c) for c in every]] = np.arange(1, len(every) + 1)
        self.side_by_side = np.zeros((len(every) + 1, len(every) + 1), bool)
        for p, _, _ in self.table:
            if len(p) > 1:
                n = self.letters[[ord(c) for c in p]]
                self.side_by_side[n[:-1], n[1:]] = True
        self.longest = max(len(p) for p, _, _ in self.table)
        self.number = {p: k for k, (p, _, _) in enumerate(self.table)}

    def bytes_of(self, character: str) -> tuple[int, ...]:
        return tuple(self.byte + b for b in character.encode())

    def different_units(self, some: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The different units of chunks, which have no U+2581 of their own in front; their numbers, one chunk after another; how many each chunk has."""
        if not len(some):
            return pa.array([], pa.large_string()), np.empty(0, np.int64), np.empty(0, np.int64)
        gap = pa.scalar(BLANK, pa.large_string())
        text = BLANK + pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), gap)[0].as_py().replace(" ", BLANK)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        letters = self.letters[points]
        begin = np.cumsum(np.concatenate(([0], np.asarray(pc.utf8_length(some)).astype(np.int64)[:-1] + 1)))
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.side_by_side.ravel()[letters[:-1].astype(np.int32) * len(self.side_by_side) + letters[1:]]
        cut[begin] = True
        at = np.flatnonzero(cut)
        # Where each character begins in UTF-8.
        bounds = np.append(at, len(points)).astype(np.int64)
        if not text.isascii():
            bounds = np.cumsum(np.concatenate(([0], 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))), dtype=np.int64)[bounds]
        every = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(text.encode())).dictionary_encode()
        return every.dictionary, np.asarray(every.indices), np.diff(np.append(np.searchsorted(at, begin), len(at)))

    def units(self, some: list[str]) -> tuple[list[str], np.ndarray]:
        """The units of chunks, one after another; how many each chunk has."""
        every, numbers, counts = self.different_units(pa.array(some, pa.large_string()))
        return every.take(pa.array(numbers)).to_pylist(), counts

    def alone(self, character: str) -> bytes:
        """The ids of a unit of one character, which needs no lattice."""
        return np.array(self.single.get(character) or self.bytes_of(character), "<i4").tobytes()

    def folded(self, unit: str) -> bytes:
        """The ids of a unit of more than `UNIT` characters: as `lattice`, in one pass that hands on the best costs of the last `longest` places."""
        size = self.longest + 1
        best, last = [(0, 0)] * size, array("i", [0])
        for end in range(1, len(unit) + 1):
            here = []
            for begin in range(max(0, end - self.longest), end):
                k = self.number.get(unit[begin:end])
                if k is not None:
                    cost, count = best[begin % size]
                    here.append((cost + self.table[k][1], count + 1, k))
            cost, count, k = min(here)
            best[end % size] = cost, count
            last.append(k)
        numbers, place = array("i"), len(unit)
        while place:
            numbers.append(last[place])
            place -= len(self.table[last[place]][0])
        return np.array([i for k in reversed(numbers) for i in self.table[k][2]], "<i4").tobytes()


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def chunks(text: str | None) -> list[str]:
    """The chunks of a text, each without its first blank; none of an empty one."""
    if not text:
        return []
    if "  " not in text and text[0] != " ":
        return text.split(" ")
    found = _CHUNK.split(" " + text)
    found[0] = found[0][1:]
    return found


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of what a task has held: the ids of documents, the ends of their texts, the texts packed."""
    held: dict[int, tuple[list, list[bytes]]] = {}
    zstd, size, kind = zstandard.ZstdCompressor(level=3), 0, pa.int64()

    def flush() -> pa.RecordBatch:
        ids = pa.array([d for d, _ in held.values()], pa.list_(kind))
        ends = pa.array([np.cumsum([len(t) for t in x]).tolist() for _, x in held.values()], pa.list_(pa.int64()))
        texts = pa.array([zstd.compress(b"".join(x)) for _, x in held.values()], pa.binary())
        return pa.record_batch([pa.array(list(held), pa.int32()), ids, ends, texts], names=["block", "doc_ids", "ends", "texts"])

    for b in batches:
        kind = b.schema.field("doc_id").type
        rows = zip(b.column("block").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()), strict=True)
        for block, doc_id, text in rows:
            ids, texts = held.setdefault(block, ([], []))
            ids.append(doc_id)
            texts.append(text.as_py() or b"")
            size += len(texts[-1])
            if size > PACK:
                yield flush()
                held, size = {}, 0
    if held:
        yield flush()
    held = {}
    _hand_back()


def _hand_back() -> None:
    """Gives the system what Arrow and the C library keep of freed memory: the worker lives on, idle beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim:
        trim(0)


@dataclass
class Ragged:
    """Lists of whole numbers, laid end to end."""

    values: np.ndarray
    sizes: np.ndarray

    def take(self, at: np.ndarray) -> Ragged:
        """Lists by number, which Arrow copies as the bytes that they are."""
        values, width = np.ascontiguousarray(self.values), self.values.itemsize
        ends = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64))) * width
        lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.sizes), [None, pa.py_buffer(ends), pa.py_buffer(values)]).take(pa.array(at))
        size = int(pc.sum(pc.binary_length(lists)).as_py() or 0) // width
        found = np.frombuffer(lists.buffers()[2], values.dtype, size) if size else values[:0]
        return Ragged(found, np.asarray(pc.binary_length(lists)).astype(np.int64) // width)

    def joined(self, counts: np.ndarray) -> Ragged:
        """The lists put together, so many at a time."""
        ends = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))
        return Ragged(self.values, np.diff(ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]))


def _split(doc_ids: pa.Array, ends: list[int], packed: bytes) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The ids of packed documents, how many chunks each has, and the chunks of all; the order of documents may change."""
    data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, ends[-1])) if ends[-1] else b""
    bounds = pa.py_buffer(np.array([0, *ends], np.int64))
    texts = pa.LargeStringArray.from_buffers(len(ends), bounds, pa.py_buffer(data))
    none = pc.equal(pc.binary_length(texts), 0)
    odd = pc.or_(none, pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, "  ")))
    plain = pc.invert(odd)
    simple = pc.split_pattern(texts.filter(plain), " ")
    rest = pa.array([chunks(t) for t in texts.filter(odd).to_pylist()], simple.type)
    both = pa.concat_arrays([simple, rest])
    ids = pa.concat_arrays([doc_ids.filter(plain), doc_ids.filter(odd)])
    return ids, np.asarray(pc.list_value_length(both)).astype(np.int64), both.flatten()


def _hashes(units: pa.Array) -> np.ndarray:
    ends = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]
    data = np.frombuffer(units.buffers()[2] or b"", np.uint8)
    return lanes(data, ends[:-1], ends[1:])


def _shares(every: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of some different units need the join, by bucket and in order of hash, then of text, and the bucket of each.

    Line breaks part units on the way, so a unit with one, which a piece of the model must hold, is none of them.
    """
    size = pc.utf8_length(every)
    asked = pc.and_(pc.and_(pc.greater(size, 1), pc.less_equal(size, UNIT)), pc.invert(pc.match_substring(every, "\n")))
    at = np.flatnonzero(np.asarray(asked))
    units = every.take(pa.array(at))
    hashes = _hashes(units.cast(pa.large_string()))
    order = np.argsort(hashes)
    if (hashes[order][1:] == hashes[order][:-1]).any():
        order = np.asarray(pc.array_sort_indices(units)).astype(np.int64)
        order = order[np.argsort(hashes[order], kind="stable")]
    of = (hashes[order] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(of, kind="stable")
    return at[order][by], of[by]


def _ask(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different units of each block by bucket, after the block's number, joined by line breaks; the rows of a block follow one another."""
        last, some = None, []

        def flush() -> pa.RecordBatch:
            every = shared.value.different_units(pc.unique(pa.chunked_array(some)))[0]
            at, of = _shares(every, buckets)
            begins = np.flatnonzero(np.diff(of, prepend=-1))
            units = every.take(pa.array(at)).cast(pa.large_string())
            lists = pa.LargeListArray.from_arrays(pa.array(np.append(begins, len(of)).astype(np.int64)), units)
            number, gap = pa.scalar(str(last), pa.large_string()), pa.scalar("\n", pa.large_string())
            texts = pc.binary_join_element_wise(number, pc.binary_join(lists, gap), gap).cast(pa.string())
            return pa.record_batch([pa.array(of[begins], pa.int32()), texts], names=["bucket", "asked"])

        for b in batches:
            for k in range(b.num_rows):
                block, ends, packed = (b.column(n)[k].as_py() for n in ("block", "ends", "texts"))
                if block != last and some:
                    yield flush()
                    some = []
                last = block
                some.append(pc.unique(_split(b.column("doc_ids")[k].values, ends, packed)[2]))
        if some:
            yield flush()
        some = []
        _hand_back()

    return run


def _answer(shared, kind: pa.DataType):
    def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))

    def run(asked: pa.Table, edges: pa.Table) -> pa.Table:
        """For each row of asked units of a bucket, how many pieces the cheapest path of each has, and the pieces."""
        asked, different = asked.combine_chunks(), edges.column("unit").combine_chunks().cast(pa.large_string())
        paths = []
        for b in edges.to_batches(max_chunksize=SOLVED):
            held = b.column("edges")
            paths.append(_cheapest(b.column("unit"), Ragged(np.asarray(held.flatten()), np.asarray(pc.list_value_length(held)).astype(np.int64)), shared.value))
        known = Ragged(np.concatenate([NONE, *(x.values for x in paths)]), np.concatenate([NONE, *(x.sizes for x in paths)]))
        whole = pc.split_pattern(asked.column("asked").combine_chunks().cast(pa.large_string()), "\n")
        blocks, units = pc.list_element(whole, 0).cast(pa.int32()), pc.list_slice(whole, 1)
        at = np.asarray(pc.index_in(units.flatten(), value_set=different)).astype(np.int64)
        found = known.take(at)
        counts = np.asarray(pc.list_value_length(units)).astype(np.int64)
        each = found.joined(counts)
        return pa.table(
            [blocks, asked.column("bucket"), lists(found.sizes, counts, pa.int8()), lists(each.values, each.sizes, kind)],
            names=["block", "bucket", "sizes", "path"],
        )

    return run


def lattice(words: DataFrame, known: Pieces) -> DataFrame:
    """(bucket, unit, edges) of different (bucket, unit): the pieces that the unit holds, their places in the piece table and in the unit in one number.

    A unit has one bucket. Its edges are in no order.
    """
    table = [(p, k) for k, (p, _, _) in enumerate(known.table)]
    # A vocabulary: a row for each piece of the model file.
    frame = words.sparkSession.createDataFrame(table, "known string, number int").withColumn("key", F.xxhash64("known"))
    # Numbers that rise within a task, which are cheaper to group by than text. They don't leave it.
    units = words.select(F.monotonically_increasing_id().alias("word"), "bucket", "unit")
    size, begin = F.length("unit"), F.col("begin")
    spans = units.select("*", F.explode(F.sequence(F.lit(0), size - 1)).alias("begin")).select(
        "*", F.explode(F.sequence(F.lit(1), F.least(F.lit(known.longest), size - begin))).alias("n")
    )
    cut = spans.withColumn("piece", F.col("unit").substr(begin + 1, F.col("n")))
    # The join is on one number, for which Spark's table needs no row for each key; the texts are compared where numbers agree.
    same = (F.xxhash64("piece") == F.col("key")) & F.col("piece").startswith(F.col("known")) & F.col("known").startswith(F.col("piece"))
    return (
        cut.join(F.broadcast(frame), same)
        .select("word", "bucket", "unit", (F.col("number") * (1 << PLACE) + begin).alias("edge"))
        .groupBy("word", "bucket")  # a word has one unit
        .agg(F.first("unit").alias("unit"), F.collect_list("edge").alias("edges"))
        .drop("word")
    )


def _cheapest(units: pa.Array, edges: Ragged, known: Pieces) -> Ragged:
    """Viterbi over many units at once, one place after another: the cheapest path of each, as places in the piece table.

    A path is one number too: its cost, how many pieces it has, the last one, and where that begins. So of paths of equal
    cost that with the fewest pieces wins, then that whose last piece is the first of the table.
    """
    length, count = np.asarray(pc.utf8_length(units)).astype(np.int64), NUMBER + PLACE
    first = np.cumsum(length + 1) - (length + 1)
    number, begin = edges.values >> PLACE, edges.values & ((1 << PLACE) - 1)
    end = begin + known.lengths[number]
    # By end; the edges of a unit follow one another, so do those to one of its places.
    order = np.argsort(end.astype(np.uint8), kind="stable")
    start = np.repeat(first, edges.sizes)[order]
    end, before, after = end[order], start + begin[order], start + end[order]
    more = (((known.costs[number] << PLACE) + 1 << count) + edges.values)[order]
    best = np.zeros(int((length + 1).sum()), np.int64)
    stops = np.searchsorted(end, np.arange(1, int(length.max(initial=0)) + 2)).tolist()
    for x, y in zip(stops, stops[1:]):
        if x < y:
            heads = np.flatnonzero(np.diff(after[x:y], prepend=-1))
            best[after[x:y][heads]] = np.minimum.reduceat((best[before[x:y]] >> count << count) + more[x:y], heads)
    # The way back from the last place of each.
    sizes = best[first + length] >> count & ((1 << PLACE) - 1)
    place, free, left = length, np.cumsum(sizes), np.flatnonzero(length)
    out = np.empty(int(sizes.sum()), np.int32)
    while len(left):
        path = best[first[left] + place[left]]
        free[left] -= 1
        out[free[left]] = path >> PLACE & ((1 << NUMBER) - 1)
        place[left] = path & ((1 << PLACE) - 1)
        left = left[place[left] > 0]
    return Ragged(out, sizes)


def _assemble(shared, buckets: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        """The ids of a block's documents from the pieces of its units."""
        known: Pieces = shared.value
        spelled = Ragged(np.array([i for _, _, ids in known.table for i in ids], np.int32), np.array([len(ids) for _, _, ids in known.table], np.int64))
        parts, word = [], []
        for k in range(len(docs)):
            ids, counts, some = _split(docs.column("doc_ids")[k].values, docs.column("ends")[k].as_py(), docs.column("texts")[k].as_py())
            parts.append((ids, counts))
            word.append(some.dictionary_encode())  # of the texts only their different chunks are held
        del some
        word = pa.chunked_array(word).unify_dictionaries().chunks
        words, word = word[0].dictionary, [np.asarray(x.indices) for x in word]
        every, numbers, per_word = known.different_units(words)
        at, _ = _shares(every, buckets)
        found = found.combine_chunks().sort_by("bucket")
        sizes, paths = (found.column(n).combine_chunks().flatten() for n in ("sizes", "path"))
        joined = spelled.take(np.asarray(paths).astype(np.int64)).joined(np.asarray(sizes).astype(np.int64))
        if len(joined.sizes) != len(at):
            raise ValueError(f"a block asked for {len(at)} units and got {len(joined.sizes)}")
        others = np.ones(len(every), bool)
        others[at] = False
        others = np.flatnonzero(others)
        own = [known.alone(u) if len(u) == 1 else known.folded(u) for u in every.take(pa.array(others)).to_pylist()]
        # Units in the order of `at`, then the others, and each one's place there.
        units = Ragged(
            np.concatenate((joined.values, np.frombuffer(b"".join(own), "<i4"))), np.concatenate((joined.sizes, np.array([len(x) // 4 for x in own], np.int64)))
        )
        place = np.empty(len(every), np.int64)
        place[np.concatenate((at, others))] = np.arange(len(every))
        of_words = units.take(place[numbers]).joined(per_word)
        out = []
        for (ids, counts), numbers in zip(parts, word, strict=True):
            texts = of_words.take(numbers).joined(counts)
            ends = np.concatenate(([0], np.cumsum(texts.sizes, dtype=np.int64)))
            values = np.ascontiguousarray(texts.values, "<i4")
            data = memoryview(values).cast("B")
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(values)).cast(pa.list_(pa.int32()))
            out.append(pa.table([ids, pa.array(texts.sizes), pa.array(crc, pa.int64()), lists], names=["doc_id", "n_pieces", "ids_crc32", "ids"]))
        del joined, units, of_words, found, paths, sizes
        _hand_back()
        return pa.concat_tables(out)

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers) and ids of every row of `docs` (doc_id, text).

    Null and empty texts have no ids. `path` is read on the driver. The bytes of all texts, counted first, give the number of blocks.
    Rows may repeat; other columns are not looked at. With a BPE model the ids are those of the cheapest path by the costs above,
    not always those of its merges.
    """
    spark = docs.sparkSession
    known = pieces(path)
    n = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK))
    over = min(n, SPREAD * shuffle_partitions(spark))
    shared = spark.sparkContext.broadcast(known)  # a vocabulary
    kind = docs.schema["doc_id"].dataType.simpleString()
    block = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n)).cast("int").alias("block")
    rows = (
        docs.select(block, "doc_id", "text")
        .mapInArrow(_pack, f"block int, doc_ids array<{kind}>, ends array<long>, texts binary")
        .repartition(over, "block")
    )
    asked = (
        rows.sortWithinPartitions("block")
        .mapInArrow(_ask(shared, n), "bucket int, asked string")
        .repartition(over, "bucket")
    )
    # Both columns are read on either way, so that the exchange is made once.
    words = asked.select("bucket", F.explode(F.expr("slice(split(asked, '\\n'), 2, length(asked))")).alias("unit")).distinct()
    number = "smallint" if len(known.table) < 1 << 15 else "int"
    edges = lattice(words, known).withColumnRenamed("bucket", "of")
    kind_of = pa.int16() if number == "smallint" else pa.int32()
    replies = (
        asked.groupBy("bucket")
        .cogroup(edges.groupBy("of"))
        .applyInArrow(_answer(shared, kind_of), f"block int, bucket int, sizes array<tinyint>, path array<{number}>")
    )
    return (
        rows.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInArrow(_assemble(shared, n), f"doc_id {kind}, n_pieces long, ids_crc32 long, ids array<int>")
    )


def _speller(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = shared.value
        table = pa.array([spelled.get(i, b"") for i in range(max(spelled) + 1)], pa.large_binary())
        for b in batches:
            names = [n for n in b.schema.names if n != "ids"]
            for i in range(0, b.num_rows, 256):
                piece = b.slice(i, 256)
                ids = piece.column("ids")
                whole = table.take(ids.flatten())
                data = memoryview(whole.buffers()[2] or b"")
                ends = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1) if len(whole) else np.zeros(1, np.int64)
                cuts = np.cumsum(np.asarray(pc.list_value_length(ids).fill_null(0)))
                bounds = ends[np.concatenate(([0], cuts))].tolist()
                texts = [str(data[x:y], "utf-8", "replace").replace(BLANK, " ")[1:] for x, y in zip(bounds, bounds[1:])]
                yield pa.record_batch([*(piece.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "text"])
        _hand_back()

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of `encoded` with `text` in place of `ids`; a U+2581 in the source comes back as a blank."""
    spark: SparkSession = encoded.sparkSession
    shared = spark.sparkContext.broadcast(pieces(path).spelled)  # a vocabulary
    rest = [f for f in encoded.schema.fields if f.name != "ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", text string"
    return encoded.mapInArrow(_speller(shared), schema)
