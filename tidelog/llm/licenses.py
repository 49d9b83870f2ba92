"""Licence scan by diagonal voting.

Every rolling k-gram of a document's words is hashed and joined in Spark to the
places where the templates hold it. A gram whose hash a template has carries its words, which
must be the template's, so no vote comes from a hash alone. A hit votes for the diagonal (place in the
document minus place in the template). Votes are gathered by document, template and
diagonal; neighbouring diagonals, as inserted or missing words leave them, are
merged; a merged span counts if the template's grams that it holds, each counted once,
cover enough of the template.

Templates are short phrases, which must be whole (k = 2), and longer ones (k = 4): notices
and whole licence texts, of which NOTICE_COVER is enough. Null text is empty. Documents without a
word give zeros and nulls; rows with equal ids stay apart. Spans may overlap, and of
equal covers none is preferred: all are given.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, utf8
from .license_texts import WHOLE
from .words import WORD_TABLE, hash_words, rolling

PHRASE_K, NOTICE_K = 2, 4
#: Share of a notice's k-grams that a span must hold; diagonals at most so far apart are merged.
NOTICE_COVER, DRIFT = 0.5, 4

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Sentences of public licence notices and the labels they give.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-text": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-text": "this work is licensed under a creative commons attribution 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "warranty": "the software is provided as is without warranty of any kind express or implied",
}


@functools.lru_cache(1)
def templates() -> list[tuple[list[str], str, bool]]:
    """(words, label, whole) of every template; its place in the list is its number."""
    return [(w.split(), label, True) for w, label in PHRASES.items()] + [(w.split(), label, False) for label, w in [*NOTICES.items(), *WHOLE.items()]]


def template_grams() -> list[tuple[int, int, int, str]]:
    """gram, template, tpos, words: the templates' k-grams."""
    rows = []
    for t, (words, _, whole) in enumerate(templates()):
        k = PHRASE_K if whole else NOTICE_K
        grams = rolling(hash_words([" ".join(words).encode()], WORD_TABLE).hashes, k).view(np.int64)
        rows += [(g, t, p, " ".join(words[p : p + k])) for p, g in enumerate(grams.tolist())]
    return rows


def gram_table(spark: SparkSession) -> DataFrame:
    """gram, template, tpos, twords. A fixed, small table."""
    return spark.createDataFrame(template_grams(), "gram long, template int, tpos int, twords string")


def strings(at: np.ndarray, values: list[bytes], n: int) -> pa.Array:
    """n strings, null but for `values` at the places `at`."""
    mask, sizes = np.zeros(n, bool), np.zeros(n + 1, np.int32)
    mask[at], sizes[at + 1] = True, [len(v) for v in values]
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.cumsum(sizes, dtype=np.int32).tobytes()), pa.py_buffer(b"".join(values)), pa.py_buffer(np.packbits(mask, bitorder="little").tobytes()))


def rolled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_words and the rolling k-grams (hash, and words if a template has the hash) of every document, of both lengths."""
    known = np.unique(np.array([g for g, *_ in template_grams()], np.int64))

    def run(batch):
        texts = utf8(batch.column(1))
        words = hash_words(texts, WORD_TABLE)
        sizes = np.diff(words.first)
        out, split = [pa.array(sizes, pa.int64())], {}
        for k in (PHRASE_K, NOTICE_K):
            grams = rolling(words.hashes, k).view(np.int64)
            n = np.maximum(sizes - k + 1, 0)
            ends = np.cumsum(n)
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(owner)) - (ends - n)[owner]
            own = grams[words.first[owner] + place] if len(owner) else np.zeros(0, np.int64)
            at = np.flatnonzero(np.isin(own, known))
            said = []
            for d, p in zip(owner[at].tolist(), place[at].tolist()):
                if d not in split:
                    split[d] = texts[d].translate(WORD_TABLE).split()
                said.append(b" ".join(split[d][p : p + k]))
            items = pa.StructArray.from_arrays([pa.array(own), strings(at, said, len(own))], ["gram", "words"])
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), items))
        return out

    kind = "array<struct<gram:long,words:string>>"
    return map_batches(df.select(id_col, text_col), f"n_words long, pairs {kind}, fours {kind}", run, (text_col,))


def votes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__row, id, n_words, and the document's diagonals: array of (template, diagonal, low, high, held); low and high are places, held the template's places with a vote."""
    rows = rolled(df, id_col, text_col).withColumn("__row", F.monotonically_increasing_id())
    # Fours follow the pairs in one list, so that each document is exploded once.
    grams = rows.select("__row", id_col, "n_words", F.size("pairs").alias("__pairs"), F.posexplode_outer(F.concat("pairs", "fours")).alias("__at", "__gram")).select("*", "__gram.*").drop("__gram")
    hits = grams.join(F.broadcast(gram_table(df.sparkSession)), "gram", "left").withColumn("template", F.when(F.col("words") == F.col("twords"), F.col("template"))).where("template is not null or coalesce(__at, 0) = 0")
    pos = F.when(F.col("__at") < F.col("__pairs"), F.col("__at")).otherwise(F.col("__at") - F.col("__pairs"))
    diagonals = (
        hits.select("__row", id_col, "n_words", "template", (pos - F.col("tpos")).alias("diagonal"), pos.alias("pos"), "tpos")
        .groupBy("__row", id_col, "n_words", "template", "diagonal")
        .agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("tpos").alias("held"))
    )
    diagonal = F.when(F.col("template").isNotNull(), F.struct("template", "diagonal", "low", "high", "held"))
    return diagonals.groupBy("__row", id_col, "n_words").agg(F.array_sort(F.collect_list(diagonal)).alias("diagonals"))


def spans_of(diagonals: list[dict]) -> list[tuple[int, int, int, float]]:
    """(template, start, end, cover) of the spans that hold, in words, end exclusive. Input is sorted by template and diagonal."""
    known, out, groups = templates(), [], []
    for d in diagonals:
        last, whole = groups[-1] if groups else None, known[d["template"]][2]
        # Near diagonals of one template are near in place too. A missing word makes the later part's diagonal the smaller one, so it comes first.
        if last and not whole and last["template"] == d["template"] and d["diagonal"] - last["diagonal"] <= DRIFT:
            last |= {"diagonal": d["diagonal"], "low": min(last["low"], d["low"]), "high": max(last["high"], d["high"]), "held": last["held"] | set(d["held"])}
        else:
            groups.append(d | {"held": set(d["held"])})
    for g in groups:
        words, _, whole = known[g["template"]]
        k = PHRASE_K if whole else NOTICE_K
        cover = len(g["held"]) / (len(words) - k + 1)
        if cover >= (1 if whole else NOTICE_COVER):
            out.append((g["template"], g["low"], g["high"] + k, cover))
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, spans (template label, whole phrase or not, start, end, cover)."""
    kind = pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])

    def run(batch):
        known = templates()
        found = [[{"label": known[t][1], "phrase": known[t][2], "start": a, "end": b, "cover": c} for t, a, b, c in spans_of(x)] for x in batch.column(2).to_pylist()]
        return [pa.array(found, pa.list_(kind))]

    found = votes(df, id_col, text_col).drop("__row")
    return map_batches(found, "spans array<struct<label:string,phrase:boolean,start:long,end:long,cover:double>>", run).drop("diagonals")
