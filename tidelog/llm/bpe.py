"""Byte-level BPE as a streaming transducer with bounded lookahead, and a streaming decoder.

The merge list alone fixes how many bytes to the right of a token's end can still
change it (`sufficient_lookahead`). The encoder keeps a window of that size and
emits tokens as soon as they end before it, so any text, even one word of many
megabytes, is encoded in constant memory. Pre-token boundaries stream likewise.

Null text is empty and gives no tokens.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, give_back, map_batches, vocabulary

#: Words kept with their tokens by a Python worker; the memory is emptied when full.
WORDS = 1 << 18
#: Characters of a text that the encoder takes at a time.
PIECE = 1 << 16
#: Fixed value of byte-level BPE: how text falls into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space by Unicode; the C0 separators aren't of it here.
SPACE = r"[\t-\r\x20\x85\xa0  -     　]"


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 letters are themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeList:
    """Vocabulary and merges of a tokenizers file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in ids.items()}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.byte_id = [0] * 256
        for i, b in self.token_bytes.items():
            if len(b) == 1:
                self.byte_id[b[0]] = i
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((ids[a], ids[b]), (r, ids[a + b]))
        self.longest = max(map(len, self.token_bytes.values()))
        self.lookahead = sufficient_lookahead([(ids[a], ids[b], ids[a + b]) for a, b in merges], self.token_bytes)


def sufficient_lookahead(merges: list[tuple[int, int, int]], token_bytes: dict[int, bytes]) -> int:
    """Bytes after a place that can decide whether a merge crosses it.

    Rule k = (u, v) crosses a place if v stands right of it when k's turn comes.
    Whether v stands there depends on v's own bytes and on whether an earlier
    rule took v, or a part of it that ends where v ends, across v's right end:
    a rule j < k whose left side is one of those parts, reaching reach(j) on.
    So reach(k) = |v| + max reach(j), and the merge list's bound is the maximum.
    """
    right: dict[int, int] = {}
    farthest: dict[int, int] = {}
    most = 0
    for u, v, made in merges:
        beyond, part = 0, v
        while True:
            beyond = max(beyond, farthest.get(part, 0))
            if part not in right:
                break
            part = right[part]
        reach = len(token_bytes[v]) + beyond
        farthest[u] = max(farthest.get(u, 0), reach)
        right.setdefault(made, v)
        most = max(most, reach)
    return most


class Encoder:
    """Turns pieces of one text after another into token ids; `finish` ends the text."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.words: dict[str, bytes] = {}
        self.window = 2 * merges.lookahead + 2 * merges.longest
        self.find = regex.compile(PATTERN.replace(r"\s+(?!\S)|\s+", rf"{SPACE}+(?!{SPACE.replace('[', '[^', 1)})|{SPACE}+").replace(r"[^\s", SPACE.replace("[", "[^", 1)[:-1]), regex.V0)
        #: The same words where all letters are Latin-1 or Latin Extended-A: the quicker library's classes agree there.
        self.find_plain = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
        self.odd = re.compile("[^\t-\r -~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ſ]")
        self.specials = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def merge(self, data: bytes) -> list[int]:
        """The tokens of a short word: always the merge of the lowest rank, leftmost first."""
        rank = self.m.rank
        ids = [self.m.byte_id[b] for b in data]
        if len(ids) > 64:
            return self.merge_heap(ids)
        while len(ids) > 1:
            best = None
            for k in range(len(ids) - 1):
                r = rank.get((ids[k], ids[k + 1]))
                if r is not None and (best is None or r[0] < best[0]):
                    best = (r[0], k, r[1])
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [best[2]]
        return ids

    def merge_heap(self, ids: list[int]) -> list[int]:
        """As merge(), in n log n for long windows."""
        rank, n = self.m.rank, len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], k, r[1], ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, made, a, b = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or j >= n or ids[k] != a or ids[j] != b:
                continue
            ids[k], alive[j], after[k] = made, False, after[j]
            if after[j] < n:
                before[after[j]] = k
                if r := rank.get((made, ids[after[j]])):
                    heapq.heappush(heap, (r[0], k, r[1], made, ids[after[j]]))
            if before[k] >= 0 and (r := rank.get((ids[before[k]], made))):
                heapq.heappush(heap, (r[0], before[k], r[1], ids[before[k]], made))
        return [x for x, here in zip(ids, alive) if here]

    def transduce(self, data: bytes) -> Iterator[int]:
        """The tokens of one word of any length: encode a window, emit what ends `lookahead` bytes before its end, go on there."""
        at = 0
        while len(data) - at > self.window:
            end = self.window - self.m.lookahead
            done = 0
            for token in self.merge(data[at : at + self.window]):
                done += len(self.m.token_bytes[token])
                if done > end:
                    break
                at += len(self.m.token_bytes[token])
                yield token
        yield from self.merge(data[at:])

    def word(self, word: str) -> bytes:
        """The word's ids as little-endian 32-bit integers, remembered if it is short."""
        data = word.encode("utf-8", "replace")
        out = np.fromiter(self.transduce(data), np.dtype("<u4")).tobytes()
        if len(data) <= 64:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = out
        return out

    def split(self, text: str) -> list[str]:
        return (self.find if self.odd.search(text) else self.find_plain).findall(text)

    def encode_words(self, words: Iterable[str]) -> bytes:
        known, word = self.words, self.word
        return b"".join([known[w] if w in known else word(w) for w in words])

    def plain(self, text: str) -> Iterator[bytes]:
        """The ids of a text without special tokens, piece by piece. A word that touches a piece's end waits for the next piece."""
        at = 0
        while len(text) - at > PIECE:
            end = at + PIECE
            # A place before a space that follows neither space nor the text's beginning is a boundary of words whatever comes.
            cut = text.rfind(" ", at + 1, end)
            while cut > at and text[cut - 1].isspace():
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:
                cut = next((k for k in range(end, len(text)) if text[k] == " " and not text[k - 1].isspace()), len(text))
            yield self.encode_words(self.split(text[at:cut]))
            at = cut
        yield self.encode_words(self.split(text[at:]))

    def pieces(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian 32-bit integers, piece by piece."""
        at = 0
        if self.specials:
            for m in self.specials.finditer(text):
                yield from self.plain(text[at : m.start()])
                yield self.m.special[m[0]].to_bytes(4, "little")
                at = m.end()
        yield from self.plain(text[at:] if at else text)

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian 32-bit integers."""
        return b"".join(self.pieces(text))


class Decoder:
    """Byte-to-text state machine: feed ids in any pieces; an unfinished character waits for its other bytes."""

    def __init__(self, merges: MergeList):
        self.bytes_of = [merges.token_bytes.get(i, b"") for i in range(max(merges.token_bytes) + 1)]
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        of = self.bytes_of
        return self.state.decode(b"".join([of[i] for i in ids]), last)

    def decode(self, packed: bytes, step: int = 1 << 14) -> Iterator[str]:
        ids = np.frombuffer(packed, "<u4")
        self.state.reset()
        for k in range(0, len(ids), step):
            yield self.feed(ids[k : k + step].tolist())
        yield self.feed((), True)


@functools.lru_cache(2)
def merge_list(path: str) -> MergeList:
    return MergeList(vocabulary(path))


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    out = Encoder(merge_list(path))
    give_back()
    return out


@functools.lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(merge_list(path))


KEPT["bpe"] = [encoder.cache_clear, decoder.cache_clear, merge_list.cache_clear]


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", n_col: str = "n_tokens") -> DataFrame:
    """df, `n_col` and `ids_col`: the ids as little-endian 32-bit integers in a binary. Null text: no ids."""
    place = df.columns.index(text_col)

    def run(batch):
        e = encoder(path)
        ids = [e.encode(x or "") for x in batch.column(place).to_pylist()]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]

    return map_batches(df, f"`{n_col}` long, `{ids_col}` binary", run, owner="bpe")


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df and `text_col`: the ids' text. Null ids: empty."""
    place = df.columns.index(ids_col)

    def run(batch):
        d = decoder(path)
        return [pa.array(["".join(d.decode(x or b"")) for x in batch.column(place).to_pylist()], pa.string())]

    return map_batches(df, f"`{text_col}` string", run, owner="bpe")


def digest_text(e: Encoder, d: Decoder, text: str) -> tuple[int, str, str, bool]:
    """(tokens, digest of their ids, digest of what they decode to, whether that is the text): ids are decoded as they come and not kept."""
    ids, back, n, at, same = hashlib.sha256(), hashlib.sha256(), 0, 0, True
    d.state.reset()
    for piece in itertools.chain(e.pieces(text), (None,)):
        if piece is not None:
            ids.update(piece)
            n += len(piece) // 4
        decoded = d.feed(() if piece is None else np.frombuffer(piece, "<u4").tolist(), piece is None)
        back.update(decoded.encode())
        same = same and text.startswith(decoded, at)
        at += len(decoded)
    return n, ids.hexdigest(), back.hexdigest(), same and at == len(text)


def token_digest(df: DataFrame, path: str, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols, n_tokens, ids_sha256, decoded_sha256 and round_trip: encode, decode the ids again, digest both. One Python step does all."""
    rows = df.select(*id_cols, F.col(text_col).alias("__text"))
    place = rows.columns.index("__text")

    def run(batch):
        e, d = encoder(path), decoder(path)
        n, ids, back, same = zip(*(digest_text(e, d, x or "") for x in batch.column(place).to_pylist()))
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())]

    return map_batches(rows, "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean", run, ("__text",), owner="bpe")
