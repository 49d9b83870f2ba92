"""PII: patterns for e-mail, ip, card and phone, and information-theoretic sanitisation of what gives them away.

DataFrame functions only. The protected entities are the values that the patterns
find. For every entity c and every term t (a word besides the entities) the corpus gives
n(c), n(t) and n(c, t), the documents with c, with t and with both. What t tells of c
is the pointwise mutual information log2(p(c|t) / p(c)) with p(c) = n(c) / N, all there
is to tell the information content log2(1 / p(c)). p(c|t) is (n(c,t) + p(c)) / (n(t) + 1):
one more document with t, in which c is as likely as anywhere, so that few documents tell
less than many and entities of one document are judged too. A term whose quotient of both
reaches REMOVE is removed at all its places in the documents of that entity, at GENERALISE
it is replaced by its kind (name, number, word). Documents without an entity are never changed.

All counts are over all documents. Null text is empty: no span. Texts of any length
are read whole. Rows with equal id and text get the same spans; others stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: Kinds in their order, and what the patterns match. The look-behinds and possessive
#: repeats only keep the search linear: they rule out starts inside a run which can't match if its beginning doesn't.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this can't match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Quotients from which terms are replaced and removed.
GENERALISE, REMOVE = 0.8, 0.95
#: Numbers that are summed at once.
BLOCK = 256


def running(values: Column, step: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """What `step` makes of the numbers before each one (from 0): their sums, or else. In blocks, so that no array grows by one number at a time."""
    start = lambda first: F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    more = lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), step))
    firsts = F.aggregate(totals, start(F.lit(0)), more, lambda s: s["out"])
    placed = F.flatten(F.zip_with(blocks, firsts, lambda b, first: F.aggregate(b, start(first), more, lambda s: s["out"])))
    return F.when(F.size(values) > 0, placed).otherwise(F.array().cast("array<int>"))


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of 10."""
    turned = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(turned, lambda d, k: F.when(k % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """What the pattern alone doesn't say."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.lpad(F.right(p, F.lit(3)), 3, "0"), F.lit("999")), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def matched(kind: str, text: Column) -> Column:
    """All matches (kind, start, end, value) with their places in code points: the pieces between matches tell the places."""
    found, pieces = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)
    both = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, v: F.struct(F.length(p).alias("gap"), v.alias("value")))
    before = running(F.transform(both, lambda x: x["gap"] + F.length(x["value"])))

    def span(x: Column, at: Column) -> Column:
        start = at + x["gap"]
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"))

    placed = F.zip_with(both, before, span)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    possible = text.rlike("[0-9]") if kind == "card" else text.contains(NEEDS[kind])
    return F.when(possible & F.regexp_like(text, F.lit(PATTERNS[kind])), F.filter(placed, lambda x: holds(kind, x["value"]))).otherwise(none)


def base_spans(df: DataFrame, text_col: str = "text", out: str = "base") -> DataFrame:
    """df and the array `out` of (kind, start, end, value), by start, then kind as listed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df
    for kind in KINDS[:4]:
        rows = rows.withColumn(f"__{kind}", matched(kind, text))
    every = F.concat(*(F.col(f"__{k}") for k in KINDS[:4]))
    return rows.withColumn(out, F.array_sort(every, by_place)).drop(*(f"__{k}" for k in KINDS[:4]))


def kind_place(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def by_place(a: Column, b: Column) -> Column:
    order = lambda x: x["start"].cast("long") * 8 + kind_place(x["kind"])
    return (order(a) - order(b)).cast("int")


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


WORD = r"[\p{L}\p{N}_]+"


def entity(span: Column) -> Column:
    """The protected value as it is counted: its kind, and digits alone or lower case."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"])))


def blanked(text: Column, spans: Column) -> Column:
    """The text with spaces for its spans, so that other places don't move."""
    reached = running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

    def piece(x: Column, at: Column) -> Column:
        start, end = F.greatest(at, x["start"]), F.greatest(at, x["end"])
        return F.concat(F.substr(text, at + 1, start - at), F.repeat(F.lit(" "), end - start))

    last = F.array_max(F.transform(spans, lambda x: x["end"]))
    rest = F.substr(text, last + 1, F.length(text) - last)
    return F.when(F.size(spans) > 0, F.concat(F.array_join(F.zip_with(spans, reached, piece), ""), rest)).otherwise(text)


def words_of(text: Column) -> Column:
    """Array of (term, start, end): the text's words."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    words = F.zip_with(F.slice(F.split(text, WORD, -1), 1, F.size(found)), found, lambda p, v: F.struct(F.length(p).alias("gap"), F.length(v).alias("long"), F.lower(v).alias("term")))
    before = running(F.transform(words, lambda w: w["gap"] + w["long"]))
    return F.zip_with(words, before, lambda w, at: F.struct(w["term"].alias("term"), (at + w["gap"]).alias("start"), (at + w["gap"] + w["long"]).alias("end")))


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def private_documents(rows: DataFrame) -> DataFrame:
    """__doc, __id, __hash, n (rows with this id and text), base, __text and __bare (the text without its spans) of the documents with an entity."""
    one = rows.where(F.size("base") > 0).groupBy("__id", "__hash").agg(F.count("*").alias("n"), F.first("base").alias("base"), F.first("__text").alias("__text"))
    bare = one.select("__id", "__hash", "n", "base", "__text", blanked(F.col("__text"), F.col("base")).alias("__bare"))
    return stored(bare.withColumn("__doc", F.monotonically_increasing_id()), "pii-private")


def document_counts(hashed: DataFrame, private: DataFrame) -> DataFrame:
    """term, n_term: the documents that have the term besides their spans, of all documents.

    Counted in whole texts, then corrected for what the spans of private ones take away, or leave as a word of its own.
    """
    every = hashed.select(F.explode(terms_of(F.col("__text"))).alias("term"), F.lit(1).cast("long").alias("n"))
    both = private.select("n", terms_of(F.col("__text")).alias("whole"), terms_of(F.col("__bare")).alias("bare"))
    gone, new = (both.select(F.explode(F.array_except(x, y)).alias("term"), (F.col("n") * sign).alias("n")) for x, y, sign in (("whole", "bare", -1), ("bare", "whole", 1)))
    return every.unionByName(gone).unionByName(new).groupBy("term").agg(F.sum("n").alias("n_term"))


def told(n_both: Column, n_term: Column) -> Column:
    """What a term tells of an entity, as a part of all there is to tell."""
    prior = F.col("n_entity") / F.col("n_all")
    return 1 - F.log2((n_both + prior) / (n_term + 1)) / F.log2(prior)


def disclosed(hashed: DataFrame, private: DataFrame) -> DataFrame:
    """__doc, start, end, action: every place of a term in a document of an entity of which it tells GENERALISE or more.

    Entities that stand in the same documents are one class, so are terms: what they tell is the same, and pairs are
    counted by class. Before that go the terms that are in too many documents for any of their pairs to tell enough.
    """
    set_of = F.bit_xor(F.xxhash64("__doc"))
    entities = private.select("__doc", "n", F.explode(F.array_distinct(F.transform("base", entity))).alias("entity"))
    counted = entities.groupBy("entity").agg(F.sum("n").alias("n_entity"), set_of.alias("e_set"))
    total = hashed.agg(F.count("*").alias("n_all"))
    # One row: not a join that grows.
    entities = stored(entities.join(counted, "entity").select("__doc", "n", "n_entity", "e_set").distinct().crossJoin(F.broadcast(total)).where("n_all > n_entity"), "pii-entities")
    # With t in as many documents of c as there can be; and with t in all of them, which grows with n_entity, so that the most frequent entity bounds all.
    possible = told(F.least("n_entity", "n_term"), F.col("n_term")) >= GENERALISE - 1e-9
    ever = told(F.col("n_entity"), F.col("n_term")) >= GENERALISE - 1e-9
    most = entities.agg(F.max("n_entity").alias("n_entity"), F.max("n_all").alias("n_all"))
    # Few bytes that take long: dealt into as many parts as a shuffle has, where a scan would have as many as their bytes make.
    dealt = private.select("__doc", "__bare").repartition(int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__doc")
    places = dealt.select("__doc", F.inline(words_of(F.col("__bare"))))
    every = stored(places.groupBy("__doc", "term").agg(F.collect_list(F.struct("start", "end")).alias("places")), "pii-terms")
    rare = document_counts(hashed, private).crossJoin(F.broadcast(most)).where(ever).select("term", "n_term")
    rare = every.groupBy("term").agg(set_of.alias("t_set")).join(rare, "term")
    terms = stored(every.join(rare, "term").select("__doc", "places", "n_term", "t_set"), "pii-rare")
    pairs = stored(entities.join(terms.select("__doc", "n_term", "t_set").distinct(), "__doc").where(possible), "pii-pairs")
    forget(every, entities)
    scored = pairs.groupBy("n_entity", "e_set", "n_term", "t_set", "n_all").agg(F.sum("n").alias("n_both")).withColumn("told", told(F.col("n_both"), F.col("n_term"))).where(F.col("told") >= GENERALISE)
    action = F.when(F.col("told") >= REMOVE, F.lit("remove")).otherwise(F.lit("generalise"))
    scored = scored.select("n_entity", "e_set", "n_term", "t_set", action.alias("action"))
    hit = pairs.join(scored, ["n_entity", "e_set", "n_term", "t_set"]).groupBy("__doc", "n_term", "t_set").agg(F.max("action").alias("action"))
    return terms.join(hit, ["__doc", "n_term", "t_set"]).select("__doc", "action", F.inline("places"))


def all_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, __hash (of the text), base and extra spans (kind, start, end, value); extra ones have kind `term` and value remove or generalise."""
    hashed = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).withColumn("__text", F.coalesce("__text", F.lit(""))).withColumn("__hash", F.xxhash64("__text"))
    private = private_documents(base_spans(hashed, "__text", "base"))
    span = F.struct(F.lit("term").alias("kind"), F.col("start"), F.col("end"), F.col("action").alias("value"))
    extra = disclosed(hashed, private).groupBy("__doc").agg(F.array_sort(F.collect_list(span), by_place).alias("extra"))
    found = private.join(extra, "__doc", "left").select(F.col("__id").alias("__id2"), F.col("__hash").alias("__hash2"), "base", "extra")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    out = hashed.select("__id", "__hash").join(found, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__hash") == F.col("__hash2")), "left")
    return out.select(F.col("__id").alias(id_col), "__hash", F.coalesce("base", none).alias("base"), F.coalesce("extra", none).alias("extra"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced: base ones by their kind, terms by their kind of word or by nothing. Overlapping ones go together, as the first."""
    reached = running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    apart = F.filter(F.zip_with(spans, reached, lambda x, at: F.struct(x.alias("span"), at.alias("at"))), lambda p: p["span"]["start"] >= p["at"])

    def piece(p: Column) -> Column:
        x = p["span"]
        value = F.substr(text, x["start"] + 1, x["end"] - x["start"])
        word = F.when(value.rlike(r"^\p{N}+$"), F.lit("[NUMBER]")).when(value.rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
        new = F.when(x["kind"] != "term", F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).when(x["value"] == "remove", F.lit("")).otherwise(word)
        return F.concat(F.substr(text, p["at"] + 1, x["start"] - p["at"]), new)

    last = F.array_max(F.transform(spans, lambda x: x["end"]))
    return F.concat(F.array_join(F.transform(apart, piece), ""), F.substr(text, last + 1, F.length(text) - last))


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with its texts sanitised; rows without a span are untouched, null stays null."""
    spans = all_spans(df, id_col, text_col).where(F.size("base") > 0).select(F.col(id_col).alias("__id"), F.col("__hash"), F.array_sort(F.concat("base", "extra"), by_place).alias("__spans")).dropDuplicates(["__id", "__hash"])
    rows = df.withColumn("__h", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = rows.join(spans, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")
    new = F.when(F.col("__spans").isNotNull(), sanitised(F.col(text_col), F.col("__spans"))).otherwise(F.col(text_col))
    return out.select(*(new.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in df.columns))
