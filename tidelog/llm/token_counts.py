"""Token counts of huge documents by overlapping chunks that are spliced where both agree.

A chunk is encoded without its left context, so its first tokens may be wrong. In
the overlap of two chunks we look for a place that is a token boundary in both and
that no piece of the vocabulary can span: every merge makes a piece of the
vocabulary, so if no piece holds the two characters side by side, no merge ever
crosses the place and both sides are encoded independently. There we splice. If an
overlap has no such place, the right chunk is taken up farther to the left, four
times as far each time. If that doesn't help within a chunk's length (one letter
repeated a million times has no such place at all), the right chunk is taken up at the
last boundary of the left one that text after it can't change any more: `lookahead`
characters before its end, a bound that follows from the vocabulary. So time grows
with the text, and memory with a chunk.

That asks for a model whose normaliser leaves texts as they are. Texts of other models
are encoded as one chunk.

Null text is empty and has no tokens. Rows with equal ids stay apart.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import KEPT, map_batches, vocabulary

#: Characters of a chunk and of the overlap of two chunks; encoded texts at a time.
CHUNK, OVERLAP, AT_ONCE = 1 << 14, 256, 64
WIDER = 4


class Model:
    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.chars = np.zeros(len(spec.pieces), np.int64)
        pairs = set()
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.BYTE:
                self.chars[i] = not 0x80 <= int(p.piece[1:-1], 16) < 0xC0
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.chars[i] = len(p.piece)
                pairs.update(p.piece[k : k + 2] for k in range(len(p.piece) - 1))
        self.pairs = frozenset(pairs)
        self.prefix = int(spec.normalizer_spec.add_dummy_prefix)
        #: Offsets are those of the text only if the normaliser changes nothing else.
        self.offsets = spec.normalizer_spec.name == "identity" and not spec.normalizer_spec.remove_extra_whitespaces
        ranked = sorted((p for p in spec.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)), key=lambda p: -p.score)
        self.lookahead = sufficient_lookahead([p.piece for p in ranked])
        #: The same model for what isn't at a text's beginning.
        spec.normalizer_spec.add_dummy_prefix = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())

    def encode(self, texts: list[str], inner: bool = False) -> list[list[int]]:
        return (self.inner if inner else self.library).encode(texts, num_threads=1) if texts else []

    def stable(self, text: str, at: int) -> bool:
        """Proof that no token spans the place: no piece has these two characters side by side."""
        return text[at - 1 : at + 1].replace(" ", "▁") not in self.pairs


def sufficient_lookahead(pieces: list[str]) -> int:
    """Characters after a place that can decide whether a merge crosses it. pieces: from the first to merge to the last.

    A merge of u and v crosses a place if v stands right of it at its turn. That depends on v's own
    characters and on whether an earlier merge took v, or a part that ends where v ends, across v's right end.
    """
    known, farthest, most = set(pieces), {}, 0
    for p in pieces:
        for k in range(1, len(p)):
            u, v = p[:k], p[k:]
            if (len(u) == 1 or u in known) and (len(v) == 1 or v in known):
                reach = len(v) + max(farthest.get(v[i:], 0) for i in range(len(v)))
                farthest[u] = max(farthest.get(u, 0), reach)
                most = max(most, reach)
    return most


class Part:
    """A chunk's place and token boundaries: bounds[k] is where its token k ends; None if the tokens don't tell."""

    def __init__(self, model: Model, text: str, start: int, end: int, ids: list[int] | None = None, inner: bool = False):
        ids = model.encode([text[start:end]], inner)[0] if ids is None else ids
        self.start, self.end, self.n = start, end, len(ids)
        ends = np.cumsum(model.chars[ids]) - (0 if inner else model.prefix) + start
        self.bounds = ends if model.offsets and len(ends) and ends[-1] == end else None


def splice(model: Model, text: str, left: Part, right: Part) -> int | None:
    """The common stable boundary nearest to the middle of the overlap."""
    if left.bounds is None or right.bounds is None:
        return None
    inside = lambda b: b[(b > right.start) & (b < left.end)]
    both = np.intersect1d(inside(left.bounds), inside(right.bounds))
    both = both[np.argsort(np.abs(both - (left.end + right.start) // 2), kind="stable")]
    return next((int(p) for p in both if model.stable(text, int(p))), None)


def spliced(model: Model, text: str, parts: list[Part], overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of the whole text and how often an overlap had to be widened."""
    total, widened, left, since = 0, 0, parts[0], None
    for right in parts[1:]:
        wide, reach, low = overlap, right.end - left.end, left.start if since is None else since
        while (cut := splice(model, text, left, right)) is None or cut <= low:
            cut, widened, wide = None, widened + 1, wide * WIDER
            if wide > reach or left.end - wide <= low:
                break
            right = Part(model, text, left.end - wide, right.end)
        if cut is None:
            settled = left.bounds[(left.bounds > low) & (left.bounds <= left.end - model.lookahead)] if left.bounds is not None else ()
            if len(settled):
                cut = int(settled[-1])
                right = Part(model, text, cut, right.end, inner=True)
            else:  # one chunk instead of two
                right = Part(model, text, low, right.end, inner=since is not None)
                left = right
                continue
        total += count(left, since, cut)
        left, since = right, cut
    return total + count(left, since, None), widened


def count(part: Part, since: int | None, until: int | None) -> int:
    first = 0 if since is None or part.start == since else int(np.searchsorted(part.bounds, since, "right"))
    last = part.n if until is None else int(np.searchsorted(part.bounds, until, "right"))
    return last - first


def count_texts(model: Model, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(tokens, chunks, widened overlaps) of each text."""
    out = []
    for k in range(0, len(texts), AT_ONCE):
        some = texts[k : k + AT_ONCE]
        spans = [[(s, min(s + chunk, len(t))) for s in range(0, max(1, len(t) - overlap), chunk - overlap)] if model.offsets else [(0, len(t))] for t in some]
        ids = iter(model.encode([t[a:b] for t, places in zip(some, spans) for a, b in places]))
        for t, places in zip(some, spans):
            if len(places) == 1:
                out.append((len(next(ids)), 1, 0))
            else:
                parts = [Part(model, t, a, b, next(ids)) for a, b in places]
                n, widened = spliced(model, t, parts, overlap)
                out.append((n, len(places), widened))
    return out


@functools.lru_cache(2)
def model(path: str) -> Model:
    return Model(vocabulary(path))


KEPT["token_counts"] = [model.cache_clear]


def token_counts(df: DataFrame, path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """df without the text, plus n_bytes, n_tokens, over_limit, n_chunks, n_widened."""
    rows = df.withColumn("n_bytes", F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"))
    place = rows.columns.index(text_col)

    def run(batch):
        found = count_texts(model(path), [x or "" for x in batch.column(place).to_pylist()])
        n, chunks, widened = zip(*found)
        return [pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(chunks, pa.int64()), pa.array(widened, pa.int64())]

    return map_batches(rows, "n_tokens long, over_limit boolean, n_chunks long, n_widened long", run, owner="token_counts").drop(text_col)
