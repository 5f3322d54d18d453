"""Removing passages that occur again, word for word.

Every window of `size` consecutive words gets a Rabin-Karp hash modulo a prime of 61 bits; Spark counts the hashes, and windows
that occur again merge into maximal intervals to remove. What is shuffled are packed arrays, not a row for each window: a batch
of texts sends each bucket of hash values the distinct ones of its own, with their places in the batch. A window
that a third of all texts hold so reaches its bucket once for each batch. Buckets answer with the places that occur
elsewhere too, and the batch turns them into intervals of its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.llm._tables import shuffle_partitions
from marketlake.llm._words import lanes, places, prime_runs, split, text_groups

WINDOW = 35
#: Windows held at once by a task before it sends them off.
BATCH = 1 << 20

_SENT = "batch long, bucket int, hashes binary, places binary"
_FOUND = "batch long, hashes binary, places binary"
_CUTS = "cut_id long, cut_text long, cuts binary"


def _pack(numbers: np.ndarray) -> bytes:
    """Ascending numbers as differences, two bytes each where they fit."""
    steps = np.diff(numbers, prepend=0)
    small = bool((steps < 65536).all())
    return bytes([small]) + steps.astype(np.uint16 if small else np.uint32).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint16 if data[0] else np.uint32, offset=1), dtype=np.int64)


def _send(size: int, bits: int):
    def flush(ids: list, marks: list, counts: list, hashes: list) -> Iterator[pa.RecordBatch]:
        if not ids:
            return
        ids, marks, counts, h = (np.concatenate(x) for x in (ids, marks, counts, hashes))
        batch = int.from_bytes(hashlib.blake2b(h.tobytes() + ids.tobytes(), digest_size=8).digest(), "little", signed=True)
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.empty(0, bool)
        again = np.zeros(len(h), bool)
        again[order] = ~(new & np.concatenate((new[1:], [True]))) if len(s) else False
        layout = np.rec.fromarrays([ids, marks, counts], formats=["i8", "i8", "i4"]).tobytes()
        out = [(batch, -1 - batch % 4096, layout, np.packbits(again).tobytes())]
        s, at = s[new], order[new]
        buckets = (s >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(buckets, prepend=-1))
        for i, j in zip(cuts, [*cuts[1:], len(s)], strict=True):
            o = np.argsort(at[i:j])
            # The first byte of a hash is known from its bucket.
            low = s[i:j][o].view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
            out.append((batch, int(buckets[i]), low, _pack(at[i:j][o])))
            if len(out) >= 256:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def _rows(out: list) -> pa.RecordBatch:
        b, k, h, p = zip(*out, strict=True)
        return pa.record_batch(
            [pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(h, pa.binary()), pa.array(p, pa.binary())],
            names=["batch", "bucket", "hashes", "places"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = ([], [], [], []), 0
        for b in batches:
            column_ids = np.asarray(b.column(0).fill_null(0)).astype(np.int64)
            column_marks = np.asarray(b.column(1)).astype(np.int64)
            for i, j, data, offsets in text_groups(b.column(2)):
                starts, _, h = split(data, hashed=lanes)
                first = np.searchsorted(starts, offsets)
                w = prime_runs(h, size)[places(first, size)]
                count = np.maximum(np.diff(first) - size + 1, 0)
                some = count > 0
                for kept, x in zip(held, (column_ids[i:j][some], column_marks[i:j][some], count[some].astype(np.int32), w), strict=True):
                    kept.append(x)
                n += len(w)
                if n >= BATCH:
                    yield from flush(*held)
                    held, n = ([], [], [], []), 0
        if n:
            yield from flush(*held)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Of one bucket, the places of the hashes that more than one batch holds."""
    names = ["batch", "hashes", "places"]
    if not len(table) or table.column("bucket")[0].as_py() < 0:
        return table.select(names)
    rows = list(zip(*(table.column(n).to_pylist() for n in names), strict=True))
    wide = []
    for _, h, _p in rows:
        low = np.zeros((len(h) // 7, 8), np.uint8)
        low[:, :7] = np.frombuffer(h, np.uint8).reshape(-1, 7)
        wide.append(low.reshape(-1).view(np.uint64))
    every = np.sort(np.concatenate(wide))
    double = every[1:][every[1:] == every[:-1]]
    out = []
    if len(double):
        double = np.unique(double)
        for (batch, _, p), h in zip(rows, wide, strict=True):
            at = np.minimum(np.searchsorted(double, h), len(double) - 1)
            hit = double[at] == h
            if hit.any():
                out.append((batch, None, _pack(_unpack(p)[hit])))
    b, h, p = zip(*out, strict=True) if out else ((), (), ())
    return pa.table([pa.array(b, pa.int64()), pa.array(h, pa.binary()), pa.array(p, pa.binary())], names=names)


def _intervals(size: int):
    def run(table: pa.Table) -> pa.Table:
        batch = table.column("batch").to_pylist()
        h, p = table.column("hashes").to_pylist(), table.column("places").to_pylist()
        head = [i for i in range(len(batch)) if h[i] is not None]
        if not head:
            raise ValueError(f"batch {batch[0]} was computed anew from other rows; store the input first")
        layout = np.frombuffer(h[head[0]], np.dtype([("id", "i8"), ("mark", "i8"), ("n", "i4")]))
        total = int(layout["n"].sum())
        again = np.unpackbits(np.frombuffer(p[head[0]], np.uint8), count=total).astype(bool)
        for i in range(len(batch)):
            if h[i] is None:
                again[_unpack(p[i])] = True
        ids, marks, cuts = [], [], []
        ends = np.cumsum(layout["n"].astype(np.int64))
        hits = np.flatnonzero(again)
        of = np.searchsorted(ends, hits, side="right")
        for d in np.unique(of):
            at = hits[np.searchsorted(of, d) : np.searchsorted(of, d, "right")] - (ends[d] - layout["n"][d])
            new = np.flatnonzero(np.diff(at, prepend=-size - 1) > size)
            begin, end = at[new], at[np.concatenate((new[1:] - 1, [len(at) - 1]))] + size
            ids.append(int(layout["id"][d]))
            marks.append(int(layout["mark"][d]))
            cuts.append(np.stack((begin, end), 1).astype(np.int64).tobytes())
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(cuts, pa.binary())],
            names=["cut_id", "cut_text", "cuts"],
        )

    return run


def repeated_spans(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """For each text of `docs` (doc_id, text) with something to remove: cut_id (its doc_id, 0 for null), cut_text (a hash of its
    text) and cuts, the maximal intervals [begin, end) of word numbers as pairs of 64-bit integers.

    A window counts wherever it starts, in the same text too, and windows are judged on the input. Windows are told apart by their hash: two
    different ones share it by chance with 2**-61, so among n windows n**2 / 2**62 pairs are expected to. Buckets follow `spark.sql.shuffle.partitions`.
    `docs` must give the same rows when it is computed again, as a scan or a stored table does.
    """
    bits = max(8, (4 * shuffle_partitions(docs.sparkSession) - 1).bit_length())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").where("text is not null")
    sent = rows.mapInArrow(_send(size, bits), _SENT)
    found = sent.groupBy("bucket").applyInArrow(_answer, _FOUND)
    return found.groupBy("batch").applyInArrow(_intervals(size), _CUTS).dropDuplicates(["cut_id", "cut_text"])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, kept = [], [], []
        texts = b.column("text").cast(pa.large_binary())
        cuts = b.column("cuts")
        for text, cut in zip(texts, cuts, strict=True):
            words = (text.as_py() or b"").split()  # bytes split at the six blanks of ASCII
            n_words.append(len(words))
            if cut.is_valid:
                keep, last = [], 0
                for begin, end in np.frombuffer(cut.as_py(), np.int64).reshape(-1, 2).tolist():
                    keep += words[last:begin]
                    last = end
                words = keep + words[last:]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        rest = [b.column(i) for i, n in enumerate(b.schema.names) if n not in ("text", "cuts")]
        names = [n for n in b.schema.names if n not in ("text", "cuts")]
        yield pa.record_batch(
            [*rest, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=[*names, "n_words", "n_removed", "kept_text"],
        )


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words that stay, one space apart) of every row of `docs`.

    Null and empty texts have no words and keep ''. Rows that repeat id and text repeat each other's windows, so both lose
    them. Other columns of `docs` are not looked at.
    """
    spans = repeated_spans(docs, size)
    rows = docs.select("doc_id", "text").withColumns(
        {"_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "_mark": F.xxhash64("text")}
    )
    joined = rows.join(spans, (F.col("_id") == F.col("cut_id")) & (F.col("_mark") == F.col("cut_text")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "cuts").mapInArrow(
        _clean, f"doc_id {kind}, n_words long, n_removed long, kept_text string"
    )
