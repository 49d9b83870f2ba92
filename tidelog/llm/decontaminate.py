"""Benchmark decontamination with a distributed positional inverted index of the training tokens.

The index is cut by documents: a row is a segment of some documents, with its
dictionary and, for every term, the sorted places where it stands. Places run
through the segment, with one left free between documents. Segments are stored once as
Parquet in the shared folder, then each is searched by itself, so no list of a
common word is ever gathered over the corpus: for every window of test words the
shortest list (the segment's rarest term) is taken, moved by the term's offset in
the window, and intersected with the other lists, moved likewise, from rare to
frequent. What remains are exact phrases. Proximity matches ask for all terms in a
span of the window's length plus `slop`, in any order. Places of the rarest terms are
taken SLICE at a time, whatever their number.

Test items go to the executors in blocks of bounded size (BLOCK_BYTES); each block
is searched against all segments. Only what it finds is written and joined, by segment.

Null or wordless documents give zeros. Null or wordless items match nothing; a null
item id is an empty string. Rows with equal ids, of documents or items, stay apart, but
an item id that matches twice is named once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, forget, give_back, make_room, stored, utf8
from .words import WORD_TABLE

WINDOW, SLOP = 10, 5
#: Bytes of text in a segment (one document at least), and of test items in a block.
SEGMENT_BYTES, BLOCK_BYTES = 1 << 20, 1 << 20
#: Places of rarest terms that a search takes at a time.
SLICE = 1 << 16


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """segment, ids, bases and sizes of its documents, terms, ends of their lists, postings (int32, sorted by term and place)."""
    bounded_batches(df.sparkSession)
    rows = df.select(id_col, text_col)
    schema = T.StructType([
        T.StructField("segment", T.StringType()), T.StructField("ids", T.ArrayType(rows.schema[0].dataType)),
        *(T.StructField(x, T.BinaryType()) for x in ("bases", "sizes", "terms", "ends", "postings")),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        task, n, size = TaskContext.get().partitionId(), 0, 0
        ids, terms, known = [], [], {}  # of the segment that grows

        def segment() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in terms], np.int64)
            bases = np.cumsum(sizes + 1) - sizes - 1
            every = np.concatenate(terms)
            places = np.arange(len(every)) + np.repeat(np.arange(len(sizes)), sizes)
            ends = np.cumsum(np.bincount(every, minlength=len(known)))
            binary = [bases.astype("<i4").tobytes(), sizes.astype("<i4").tobytes(), b" ".join(known), ends.astype("<i4").tobytes(), places[np.argsort(every, kind="stable")].astype("<i4").tobytes()]
            chunk = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{n}"]), pa.ListArray.from_arrays(pa.array([0, len(chunk)], pa.int32()), chunk), *(pa.array([x], pa.binary()) for x in binary)], schema.fieldNames())

        for batch in batches:
            start = 0
            for k, text in enumerate(utf8(batch.column(1))):
                terms.append(np.fromiter((known.setdefault(w, len(known)) for w in text.translate(WORD_TABLE).split()), np.int32))
                size += len(text) + 64
                if size >= SEGMENT_BYTES:
                    ids.append(batch.column(0).slice(start, k + 1 - start))
                    yield segment()
                    ids, terms, known = [], [], {}
                    size, n, start = 0, n + 1, k + 1
            if start < batch.num_rows:
                ids.append(batch.column(0).slice(start))
        if terms:
            yield segment()
        ids, terms, known = [], [], {}
        give_back()

    return rows.mapInArrow(run, schema)


class Windows:
    """All windows of some test items: their terms, lengths, and the items that have them."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            words = [vocabulary.setdefault(w, len(vocabulary)) for w in text.translate(WORD_TABLE).split()]
            for s in range(max(1, len(words) - width + 1) if words else 0):
                owners.setdefault(tuple(words[s : s + width]), set()).add(k)
        self.vocabulary = list(vocabulary)
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.terms = np.full((len(owners), width), -1, np.int64)
        #: The same without order: distinct terms, and how often each is needed.
        self.distinct, self.need = np.full((len(owners), width), -1, np.int64), np.zeros((len(owners), width), np.int64)
        for k, w in enumerate(owners):
            self.terms[k, : len(w)] = w
            for j, (t, n) in enumerate(Counter(w).items()):
                self.distinct[k, j], self.need[k, j] = t, n


class Segment:
    """An index row, ready for search."""

    def __init__(self, row: dict):
        self.bases, self.sizes, ends, self.postings = (np.frombuffer(row[x], "<i4").astype(np.int64) for x in ("bases", "sizes", "ends", "postings"))
        self.number = {t: k for k, t in enumerate(row["terms"].split(b" "))} if row["terms"] else {}
        self.begins = np.concatenate([[0], ends])
        #: term and place in one number: sorted, so that a list can be asked for many places at once.
        self.keys = np.repeat(np.arange(len(self.number)), np.diff(self.begins)) << 32 | self.postings

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = terms << 32 | places
        at = np.searchsorted(self.keys, wanted)
        return (places >= 0) & (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)

    def nth(self, terms: np.ndarray, low: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The place of the n-th occurrence of a term from `low` on; beyond all places if there is none."""
        at = np.searchsorted(self.keys, terms << 32 | low) + n - 1
        return np.where(at < self.begins[terms + 1], self.postings[np.minimum(at, len(self.keys) - 1)], np.iinfo(np.int64).max)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, places, "right") - 1

    def search(self, w: Windows, slop: int = SLOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans (document, start, end in its words) of exact matches, merged; (document, window) of exact matches and of those near only."""
        cover = np.zeros(int(self.bases[-1] + self.sizes[-1]) + 2 if len(self.bases) else 2, np.int32)
        exact, near = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        number = np.array([self.number.get(t, -1) for t in w.vocabulary] + [-1], np.int64)
        used = w.terms >= 0
        whole = np.flatnonzero(((number[w.terms] >= 0) | ~used).all(axis=1)) if len(self.keys) else np.zeros(0, np.int64)
        terms, used = number[w.terms[whole]], used[whole]
        counts = np.where(used, np.diff(self.begins)[terms] if len(whole) else 0, np.iinfo(np.int64).max)
        order = np.argsort(counts, axis=1, kind="stable")
        each = np.arange(len(whole))
        n = counts[each, order[:, 0]]
        ends, first = np.cumsum(n), self.begins[terms[each, order[:, 0]]]
        for k in range(0, int(n.sum()), SLICE):
            flat = np.arange(k, min(k + SLICE, ends[-1]))
            which = np.searchsorted(ends, flat, "right")
            at = flat - ends[which] + n[which]
            place = self.postings[first[which] + at]
            before = np.where(at > 0, self.postings[first[which] + at - 1], -1)
            hit, start = self.phrases(which, place - order[which, 0], terms, used, order)
            length = w.lengths[whole[hit]]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + length, -1)
            exact.append(np.unique(np.stack([self.document(start), whole[hit]], axis=1), axis=0))
            near.append(self.close(w, whole, which, place, before, number, slop))
        found, close = np.unique(np.concatenate(exact), axis=0), np.unique(np.concatenate(near), axis=0)
        code = lambda x: x[:, 0] << 32 | x[:, 1]
        edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)]))
        start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        doc = self.document(start)
        return np.stack([doc, start - self.bases[doc], end - self.bases[doc]], axis=1) if len(doc) else np.zeros((0, 3), np.int64), found, close[~np.isin(code(close), code(found))]

    def phrases(self, which: np.ndarray, start: np.ndarray, terms: np.ndarray, used: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of windows and where they would begin, those that stand there: lists intersected from rare to frequent."""
        for rank in range(1, terms.shape[1]):
            offset = order[which, rank]
            ok = ~used[which, offset] | self.has(terms[which, offset], start + offset)
            which, start = which[ok], start[ok]
        ok = start >= 0
        return which[ok], start[ok]

    def close(self, w: Windows, whole: np.ndarray, which: np.ndarray, place: np.ndarray, before: np.ndarray, number: np.ndarray, slop: int) -> np.ndarray:
        """(document, window) where a span whose first rarest term is at `place` (the one before it at `before`) has all of the window's terms as often as it."""
        distinct, need = number[w.distinct[whole]], w.need[whole]
        doc = self.document(place)
        low, high = self.bases[doc], self.bases[doc] + self.sizes[doc]
        reach = w.lengths[whole[which]] + slop
        columns = np.flatnonzero(need.any(axis=0))
        for j in columns:
            t, k = distinct[which, j], need[which, j]
            ok = (k == 0) | (self.nth(t, np.maximum(place - reach + 1, low), 1) < np.minimum(place + reach, high))
            which, place, before, low, high, reach = (x[ok] for x in (which, place, before, low, high, reach))
        first = np.maximum(np.maximum(low, place - reach + 1), before + 1)
        m = place - first + 1
        own = np.repeat(np.arange(len(which)), m)
        start = np.arange(len(own)) - np.repeat(np.cumsum(m) - m, m) + first[own]
        for j in columns:
            t, k = distinct[which[own], j], need[which[own], j]
            ok = (k == 0) | (self.nth(t, start, k) < np.minimum(start + reach[own], high[own]))
            own, start = own[ok], start[ok]
        return np.unique(np.stack([self.document(place[own]), whole[which[own]]], axis=1), axis=0)


FOUND = "spans array<struct<document:int,start:int,end:int>>, items array<struct<document:int,item:string>>, near array<struct<document:int,n:int>>"


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    """The test items in blocks of at most BLOCK_BYTES (one item at least), one block on the driver at a time."""
    some, size = [], 0
    for r in items.selectExpr(f"coalesce(cast(`{id_col}` as string), '') i", f"cast(`{text_col}` as binary) t").where("t is not null").toLocalIterator():
        if some and size + len(r["t"]) > BLOCK_BYTES:
            yield some
            some, size = [], 0
        some.append((r["i"], bytes(r["t"])))
        size += len(r["t"]) + 64
    if some:
        yield some


def search(index: DataFrame, items: list[tuple[str, bytes]], width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """segment and what the items find in it (FOUND), for segments where they find something."""
    bounded_batches(index.sparkSession)
    windows, schema = Windows(items, width), T.StructType.fromDDL(f"segment string, {FOUND}")
    names = ("segment", "bases", "sizes", "terms", "ends", "postings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: c[k].as_py() for n, c in zip(names, batch.columns)}
                spans, exact, near = Segment(row).search(windows, slop)
                if len(spans) or len(near):
                    pairs = sorted({(d, windows.items[i]) for d, x in exact.tolist() for i in windows.owners[x]})
                    docs, n = np.unique(near[:, 0], return_counts=True)
                    found = ([dict(zip(("document", "start", "end"), x)) for x in spans.tolist()], [{"document": d, "item": i} for d, i in pairs], [{"document": d, "n": c} for d, c in zip(docs.tolist(), n.tolist())])
                    yield pa.RecordBatch.from_arrays([pa.array([row["segment"]]), *(pa.array([x], kind) for x, kind in zip(found, KINDS))], schema.fieldNames())
        give_back()

    return index.select(*names).mapInArrow(run, schema)


KINDS = [
    pa.list_(pa.struct([("document", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])),
    pa.list_(pa.struct([("document", pa.int32()), ("item", pa.string())])),
    pa.list_(pa.struct([("document", pa.int32()), ("n", pa.int32())])),
]


def matches(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row a document: id, n_words, n_hit, spans (start, end in words, end exclusive), items (sorted), n_near (windows near, not exact)."""
    index = stored(build_index(df, id_col, text_col), "index")
    found = [stored(search(index, block, width, slop), "found") for block in blocks(items, item_id, item_text)]
    segments = stored(index.select("segment", "ids", "sizes"), "segments")
    forget(index)
    if found:
        by_segment = reduce(DataFrame.union, found).groupBy("segment").agg(*(F.flatten(F.collect_list(x)).alias(x) for x in ("spans", "items", "near")))
        segments = segments.join(by_segment, "segment", "left").drop("segment")
    else:
        segments = segments.selectExpr("ids", "sizes", *(f"cast(null as {f.dataType.simpleString()}) {f.name}" for f in T.StructType.fromDDL(FOUND).fields))
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        *T.StructType.fromDDL("spans array<struct<start:int,end:int>>, items array<string>, n_near long").fields,
    ])
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(0).slice(k, 1).flatten()
                sizes = np.frombuffer(batch.column(1)[k].as_py(), "<i4")
                spans: list[list[dict]] = [[] for _ in sizes]
                names: list[set] = [set() for _ in sizes]
                near = [0] * len(sizes)
                # Blocks' spans may touch and overlap.
                for h in sorted(batch.column(2)[k].as_py() or [], key=lambda h: (h["document"], h["start"])):
                    own = spans[h["document"]]
                    if own and h["start"] <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], h["end"])
                    else:
                        own.append({"start": h["start"], "end": h["end"]})
                for f in batch.column(3)[k].as_py() or []:
                    names[f["document"]].add(f["item"])
                for c in batch.column(4)[k].as_py() or []:
                    near[c["document"]] += c["n"]
                hit = [sum(s["end"] - s["start"] for s in x) for x in spans]
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(sizes, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, pa.list_(span)),
                    pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(near, pa.int64()),
                ], schema.fieldNames())

    return segments.mapInArrow(run, schema)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
