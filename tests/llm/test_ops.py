import gc
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import both, connection
from tests.llm import brute as B
from tidelog.llm.common import vocabulary
from tidelog.llm import bpe, chat, decontaminate, jaccard, language, licenses, matroska, pii, queries, token_counts, urls

LONG = "word " * 30_000
#: Nulls, empty and blank texts, ties, repeated rows, a long text, near and exact copies.
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Mail a.b@c.org or 1.2.3.4, +1 (377) 555-0271."), (4, "Mail a.b@c.org or 1.2.3.4, +1 (377) 555-0271."), (None, "no id"),
    (5, "Released under the MIT License. CC BY, cc-by; GNU General Public License"), (6, LONG), (7, "a b c"), (8, "a b c"), (9, "a@b.co@d.org 300.1.1.1 4111 1111 1111 1111 4111111111111112"),
    (10, "x" * 5000), (11, "<|endoftext|> é😀\x00 end"),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "clash", 0, "z") for i, t in rows], "doc_id long, text string, spans string, n_words int, id string")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def docs_of(sf, table="documents", key="doc_id", text="text"):
    return connection(sf).execute(f"select {key}, {text} from {table}").fetchall()


# --- 1 ---


def test_matroska_round_trip():
    rnd = random.Random(3)
    for n in (0, 1, 191, 192, 193, 200_000):
        data = matroska.padded(rnd.randbytes(n))
        media = matroska.parse(buf := matroska.mux(data))
        assert not media.error and b"".join(buf[p[7] : p[7] + p[8]] for p in media.packets) == data
        assert [place for _, _, place in media.cues] == media.clusters and [stamp for stamp, _, _ in media.cues] == [next(p[4] for p in media.packets if p[1] == k) for k in range(len(media.clusters))]


@pytest.mark.parametrize("lacing", ["xiph", "ebml", "none"])
def test_lacing_of_unequal_frames_in_unknown_sizes(lacing):
    frames = [b"a" * n for n in ([700, 3, 255, 0, 256, 9000] if lacing != "none" else [5])]
    block = matroska.size_bytes(1) + b"\x00\x05" + bytes([matroska.LACINGS.index(lacing) << 1]) + matroska.laced(frames, lacing)
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block) + matroska.number(matroska.BLOCK_DURATION, 12))
    unknown = lambda ident, body: ident.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    cluster = unknown(matroska.CLUSTER, matroska.number(matroska.CLUSTER_TIMESTAMP, 100) + group)
    media = matroska.parse(matroska.HEADER + unknown(matroska.SEGMENT, matroska.INFO_AND_TRACKS + cluster + cluster))
    assert not media.error and [p[8] for p in media.packets] == [len(f) for f in frames] * 2
    assert media.packets[0][4] == 105_000_000 and len(media.clusters) == 2


def test_broken_media_give_what_came_before():
    data = matroska.padded(random.Random(5).randbytes(250_000))
    whole = matroska.mux(data)
    packets = matroska.parse(whole).packets
    for cut in [*range(0, 400, 7), *range(400, len(whole), 9973), len(whole) - 5, len(whole) - 1]:
        media = matroska.parse(whole[:cut])
        done = [p for p in packets if p[7] + p[8] <= cut]
        blocks = {p[2] for p in packets if p[7] + p[8] > cut}
        assert media.error and media.packets == [p for p in done if p[2] not in blocks]
    assert matroska.parse(b"\x00junk").error and matroska.parse(b"").error
    astray = whole.replace(matroska.number(matroska.CUE_CLUSTER_POSITION, len(matroska.INFO_AND_TRACKS)), matroska.number(matroska.CUE_CLUSTER_POSITION, len(matroska.INFO_AND_TRACKS) + 1))
    media = matroska.parse(astray)
    assert astray != whole and "cues" in media.error and media.packets == packets


def test_media_digests_match_brute_force(spark, sf):
    frames = [(frame(spark), TEXTS), (spark.read.parquet(f"{sf}/documents.parquet"), docs_of(sf))]
    for df, texts in frames:
        rows = df.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
        got = sorted(map(repr, (tuple(r) for r in matroska.media_digest(matroska.mux_texts(rows).drop("text")).collect())))
        want = []
        for i, text in texts:
            raw = (text or "").encode()
            data = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
            media = matroska.mux(data)
            n, n_packets = len(data), len(data) // 192
            mean = sum(data) / n
            std = math.sqrt(sum((b - mean) ** 2 for b in data) / n)
            above = [b >= 96 for b in data]
            entropy = -sum(c / n * math.log2(c / n) for c in Counter(data).values())
            clusters = -(-n_packets // 1024)
            blocks = sum(-(-min(1024, n_packets - 1024 * k) // 8) for k in range(clusters))
            feature = f"mean={mean:.6f};std={std:.6f};crossings={sum(x != y for x, y in zip(above, above[1:]))};entropy={entropy:.6f};tracks=1;clusters={clusters};blocks={blocks};packets={n_packets};cues={clusters};ms={24 * n_packets}"
            want.append(repr((i, len(raw), n, hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, None)))
        assert got == sorted(want)


def test_media_columns(spark):
    media = matroska.mux_texts(frame(spark))
    packets = matroska.packet_table(media, "doc_id")
    assert packets.where("doc_id = 10").agg(F.sum("byte_length")).first()[0] == 5184
    digests = by_id(matroska.media_digest(media), "payload_sha256", "error")
    assert digests[10][0] == hashlib.sha256(b"x" * 5000 + b" " * 184).hexdigest() and digests[1] == digests[2]


# --- 2 ---


def test_pii_matches_brute_force(spark, sf):
    rows = frame(spark)
    for df, texts in ((rows, TEXTS), (spark.read.parquet(f"{sf}/documents.parquet"), docs_of(sf))):
        got = by_id(queries.pii_digest(df), "base_sha256", "n_email", "n_ip", "n_card", "n_phone")
        for i, text in texts:
            want = B.pii(text)
            assert got[i] == (B.sha(",".join(want)), *(sum(x.startswith(k) for x in want) for k in B.PII)), (i, want)


def test_terms_that_tell_an_entity_go(spark):
    told = [(k, f"Talk to Quetzal about it: who@where.org is all{k} there.") for k in range(4)]
    rows = told + [(100 + k, f"nothing of it here about is all there {k}") for k in range(60)]
    out = by_id(pii.sanitise(frame(spark, rows)), "text")
    assert all("[EMAIL]" in out[k][0] and "who@" not in out[k][0] for k in range(4))
    assert all(out[i] == (t,) for i, t in rows[4:])


@pytest.mark.parametrize("documents", [1, 2])
def test_rare_entities_have_terms(spark, documents):
    rows = [(k, f"all there is: Quetzal has who@where.org, all there {k}") for k in range(documents)]
    rows += [(100 + k, f"all there is here has nothing of it, all there {k % 3}") for k in range(60)]
    out = by_id(pii.sanitise(frame(spark, rows)), "text")
    assert all(out[k] == (f"all there is: [NAME] has [EMAIL], all there {k}",) for k in range(documents))
    assert all(out[i] == (t,) for i, t in rows[documents:])


def test_first_word_of_a_text_is_a_term(spark):
    rows = [(1, "Quetzal who@where.org"), (2, "Alice: +1 (377) 555-0271")] + [(100 + k, f"nothing here {k % 3}") for k in range(60)]
    out = by_id(pii.sanitise(frame(spark, rows)), "text")
    assert out[1] == ("[NAME] [EMAIL]",) and out[2] == ("[NAME]: [PHONE]",)


def test_terms_go_at_all_their_places(spark):
    far = "it has all there is " * 40
    rows = [(1, f"Quetzal is here: {far}who@where.org all there is. {far}Quetzal has it."), (2, f"who@where.org has it. {far}quetzal"), (3, "+1 (377) 555-0271 Quetzals it is")]
    rows += [(100 + k, f"it is here has all there {k % 3}") for k in range(60)]
    out = by_id(pii.sanitise(frame(spark, rows)), "text")
    assert out[1] == (f"[NAME] is here: {far}[EMAIL] all there is. {far}[NAME] has it.",)
    assert out[2] == (f"[EMAIL] has it. {far}[WORD]",) and out[3] == ("[PHONE] [NAME] it is",)


def terms_by_brute_force(rows):
    """{id: [(start, end, action)]}, counted pair by pair. Rows have different ids."""
    words, entities, base = {}, {}, {}
    for i, text in rows:
        found = [x.split(":") for x in B.pii(text)]
        base[i], bare = [(k, int(a), int(b)) for k, a, b in found], list(text or "")
        for _, a, b in base[i]:
            bare[a:b] = " " * (b - a)
        words[i] = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w+", "".join(bare))]
        entities[i] = {(k, re.sub("[^0-9]", "", text[a:b]) if k in ("card", "phone") else text[a:b].lower()) for k, a, b in base[i]}
    holding = lambda sets: {x: {i for i in sets if x in sets[i]} for x in set().union(*sets.values())}
    terms, owners, out = holding({i: {w for w, _, _ in x} for i, x in words.items()}), holding(entities), {}
    for i in words:
        best = {}
        for t in {w for w, _, _ in words[i]}:
            for c in entities[i]:
                p = len(owners[c]) / len(rows)
                if p < 1:
                    told = math.log2((len(owners[c] & terms[t]) + p) / (len(terms[t]) + 1) / p) / math.log2(1 / p)
                    best[t] = max(best.get(t, 0), told)
        out[i] = sorted((a, b, "remove" if best[t] >= pii.REMOVE else "generalise") for t, a, b in words[i] if best.get(t, 0) >= pii.GENERALISE)
    return out


def test_terms_match_brute_force(spark, sf):
    rnd = random.Random(4)
    rows = []
    for k in range(400):
        mails = [f"m{n}@x.org" for n in (0, 1, 2, 3, 50, 51, 52) if rnd.random() < (0.3 if n == 0 else 0.02)] + ["" if k % 9 else f"own{k}@x.org"]
        text = [f"W{rnd.randint(0, int(10 ** rnd.uniform(0.5, 4)))}" for _ in range(rnd.choice([0, 5, 40, 700]))] + [f"with{m[:2]}" for m in mails] + mails
        rnd.shuffle(text)
        rows.append((k, " ".join(text)))
    for df, texts in ((frame(spark, rows), rows), (spark.read.parquet(f"{sf}/documents.parquet"), docs_of(sf))):
        want = terms_by_brute_force(texts)
        got = {i: sorted((s["start"], s["end"], s["value"]) for s in x) for i, (x,) in by_id(pii.all_spans(df), "extra").items()}
        assert got == want and any(want.values())


# --- 3 and 9 ---


def odd_texts(n, seed, longest):
    rnd = random.Random(seed)
    pool = ["a", "b", " ", "  ", "\n", "'s", "é", "ß", "²", "一", "\u0301", "\x1c", "\x85", "\xa0", "\u200b", "\u3000", "<|endoftext|>", "<s>", "</s>", "😀", "½", "Ⅷ", "-", "12", "\r\n", "▁", "the", " and", "\x00"]
    return ["".join(rnd.choices(pool, k=rnd.randint(0, longest))) for _ in range(n)]


def test_bpe_is_the_librarys():
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary(queries.BYTE_BPE)
    library, own = tokenizers.Tokenizer.from_file(path), bpe.encoder(path)
    texts = odd_texts(1500, 5, 40) + ["a" * 20_000, "ab" * 9000, "x " * 50_000, " " * 70_000, "tion" * 5000]
    decoder = bpe.Decoder(own.m)
    for text in texts:
        ids, packed = library.encode(text, add_special_tokens=False).ids, own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert bpe.digest_text(own, decoder, text) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text)
        assert "".join(decoder.decode(packed, 3 if len(ids) < 100 else 1 << 14)) == decoded


def test_token_counts_are_the_librarys():
    model = token_counts.model(vocabulary(queries.PIECE_BPE))
    texts = odd_texts(400, 6, 300) + ["a" * 3000, " " * 3000, "the" * 900]
    want = [len(x) for x in model.encode(texts)]
    for chunk, overlap in ((60, 8), (500, 32), (1 << 14, 256)):
        assert [n for n, _, _ in token_counts.count_texts(model, texts, chunk, overlap)] == want


def test_token_counts_without_stable_boundaries():
    model = token_counts.model(vocabulary(queries.PIECE_BPE))
    rnd = random.Random(2)
    texts = ["a" * 60_000, "ab" * 30_000, " " * 50_000, "=" * 40_000, "".join(rnd.choices("abc", k=50_000)), "x" * 20_000 + " and then. " * 900 + "0" * 30_000]
    assert [n for n, _, _ in token_counts.count_texts(model, texts)] == [len(x) for x in model.encode(texts)]
    began = time.time()
    token_counts.count_texts(model, ["x" * 200_000])
    one = time.time() - began
    ((n, _, _),) = token_counts.count_texts(model, ["x" * 2_000_000])
    assert n == 1_000_000 and time.time() - began < 30 * max(one, 0.1)


def test_token_columns(spark):
    rows = frame(spark)
    assert by_id(bpe.token_digest(rows, vocabulary(queries.BYTE_BPE), ["doc_id"]), "n_tokens", "round_trip")[1] == (0, True)
    packed = bpe.encode(rows.select("doc_id", "text"), vocabulary(queries.BYTE_BPE))
    assert by_id(bpe.decode(packed, vocabulary(queries.BYTE_BPE)), "decoded") == {i: (t or "",) for i, t in TEXTS}
    counts = by_id(token_counts.token_counts(rows.select("doc_id", "text"), vocabulary(queries.PIECE_BPE)), "n_tokens", "n_bytes")
    assert counts[1] == (0, 0) and counts[6][1] == 150_000


# --- 4 ---


def test_language_held_out_accuracy(spark, sf):
    got = by_id(queries.op4_language(spark, sf), "held_out", "lang_pred")
    truth = dict(docs_of(sf, text="lang"))
    held = [got[i][1] == truth[i] for i in truth if got[i][0]]
    assert len(held) > 20 and sum(held) >= 0.97 * len(held)


def test_language_without_letters(spark):
    rows = frame(spark).withColumn("lang", F.lit("en"))
    model = language.train(rows, "text", "lang", "doc_id")
    got = by_id(language.predict(rows, model), "lang_pred", "score", "rejected")
    assert all(got[i] == ("und", 0.0, True) for i in (1, 2, 3)) and got[4][0] == "en"
    assert language.train(rows.limit(0), "text", "lang", "doc_id").languages == []


def test_all_languages_are_learned(spark):
    rows = [(k, f"{chr(0x4E00 + 7 * n) * 6} {chr(0x4E03 + 7 * n) * 6}", f"l{n}") for n in range(90) for k in range(n * 100, n * 100 + (1 if n == 89 else 2 if n > 80 else 4))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, "text", "lang", "doc_id")
    assert model.languages == sorted({r[2] for r in rows})
    got = by_id(language.predict(df, model), "lang_pred")
    right = {lang for i, _, lang in rows if got[i] == (lang,)}
    assert len(right) >= 85 and "l89" in right


def test_unlearned_language_is_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text rlike '[a-z]'")
    two = sorted(r["lang"] for r in docs.select("lang").distinct().collect() if r["lang"])[:2]
    model = language.train(docs.where(F.col("lang").isin(two)), "text", "lang", "doc_id")
    got = language.predict(docs, model).select("lang", "rejected").collect()
    known, other = [[r["rejected"] for r in got if (r["lang"] in two) == x] for x in (True, False)]
    assert len(other) > 20 and sum(other) >= 0.9 * len(other) and sum(known) <= 0.02 * len(known)


def test_scores_match_a_plain_scorer(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120").union(spark.createDataFrame([(120, "\u3053\u3093 x", None, "", 4), (121, "12", None, "", 2)], "doc_id long, text string, lang string, source string, n_chars long"))
    model = language.train(docs, "text", "lang", "doc_id")
    got = by_id(language.predict(docs, model), "lang_pred", "score", "rejected")
    rejected = 0
    for i, text in [*((r["doc_id"], r["text"]) for r in docs.collect())]:
        data = f" {(text or '').lower()} ".encode()
        grams = [int.from_bytes(data[p : p + n], "big") + (n << 40) for n in language.GRAMS for p in range(len(data) - n + 1)]
        buckets = [(g * 0x9E3779B97F4A7C15 % 2**64) >> 50 for g in grams]
        z = [sum(float(model.weights[b, k]) for b in buckets) / len(buckets) + float(model.bias[k]) for k in range(len(model.languages))]
        e = [math.exp((x - max(z)) / model.temperature) for x in z]
        best = max(range(len(z)), key=z.__getitem__)
        if any(c.isalpha() for c in text or ""):
            assert got[i][0] == model.languages[best] and got[i][1] == pytest.approx(e[best] / sum(e), abs=1e-5)
            assert got[i][2] == (max(z) - sorted(z)[-2] < model.accept) or abs(max(z) - sorted(z)[-2] - model.accept) < 1e-4
        else:
            assert got[i] == ("und", 0.0, True)
        rejected += got[i][2]
    assert rejected


# --- 5 ---


def test_contamination_matches_brute_force(spark, sf):
    items = docs_of(sf, "benchmark", "item_id")
    want = B.contamination(docs_of(sf), items)
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(queries.op5_decontaminate(spark, sf), *columns) == want


def test_contamination_in_blocks_and_odd_rows(spark, monkeypatch):
    items = [(1, "a b c"), (2, "word " * 12), (3, None), (4, ""), (None, "no id"), (5, "released under the mit license cc by cc by gnu general public")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = B.contamination(TEXTS, [(i if i is not None else "", t) for i, t in items])
    for size in (1, 1 << 20):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 200 if size == 1 else 4 << 20)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), decontaminate.digest(r["items"]), r["n_hit"] > 0) for r in decontaminate.matches(frame(spark), table).collect()}
        assert got == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one x two three"), (2, "three y two z one"), (3, "one two w w w w w w w w w three")], "doc_id long, text string")
    got = by_id(decontaminate.matches(docs, spark.createDataFrame([(1, "one two three")], "item_id long, text string"), slop=2), "n_hit", "n_near")
    assert got == {1: (0, 1), 2: (0, 1), 3: (0, 0)}


def segment_of(texts):
    """The one segment of some texts, as the index has it."""
    known, words = {}, [B.words(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    terms = np.array([known.setdefault(w, len(known)) for some in words for w in some], np.int64)
    places = np.arange(len(terms)) + np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(terms, kind="stable")
    row = {"bases": np.cumsum(sizes + 1) - sizes - 1, "sizes": sizes, "ends": np.cumsum(np.bincount(terms, minlength=len(known))), "postings": places[order]}
    return decontaminate.Segment({k: v.astype("<i4").tobytes() for k, v in row.items()} | {"terms": " ".join(known).encode()})


@pytest.mark.parametrize("at_once", [1, 7, 1 << 16])
def test_search_matches_brute_force(monkeypatch, at_once):
    monkeypatch.setattr(decontaminate, "SLICE", at_once)
    rnd = random.Random(at_once)
    for _ in range(40):
        pool = "abcdefgh"[: rnd.choice([2, 4, 8])]
        some = lambda sizes, letters: " ".join(rnd.choice(letters) for _ in range(rnd.choice(sizes)))
        texts, items = [some([0, 3, 20, 60], pool) for _ in range(5)], [some([0, 2, 5, 9], pool + rnd.choice(["", "z"])) for _ in range(4)]
        windows = decontaminate.Windows([(str(k), t.encode()) for k, t in enumerate(items)], 4)
        spans, exact, near = segment_of(texts).search(windows, 2)
        phrases = [[windows.vocabulary[t].decode() for t in row if t >= 0] for row in windows.terms.tolist()]
        want, close, hit = set(), set(), set()
        for d, text in enumerate(texts):
            words = text.split()
            for k, phrase in enumerate(phrases):
                n = len(phrase)
                starts = [p for p in range(len(words) - n + 1) if words[p : p + n] == phrase]
                want |= {(d, k)} if starts else set()
                hit |= {(d, p + j) for p in starts for j in range(n)}
                close |= {(d, k)} if any(not Counter(phrase) - Counter(words[p : p + n + 2]) for p in range(len(words))) else set()
        assert {tuple(x) for x in exact.tolist()} == want and {tuple(x) for x in near.tolist()} == close - want
        assert {(d, p) for d, a, b in spans.tolist() for p in range(a, b)} == hit


def test_search_of_four_words_ends():
    rnd = random.Random(1)
    some = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
    text, began = some(400_000), time.time()
    items = [(str(k), some(10).encode()) for k in range(60)]
    _, exact, near = segment_of([text]).search(decontaminate.Windows(items))
    assert {w for _, w in exact.tolist()} == {k for k, (_, t) in enumerate(items) if f" {t.decode()} " in f" {text} "}
    assert len(exact) + len(near) == 60 and time.time() - began < 40


# --- 6 ---


def test_groups_match_brute_force(spark, sf):
    assert by_id(queries.op6_jaccard(spark, sf), "n_shingles", "component_id") == B.groups(docs_of(sf))


@pytest.mark.parametrize("hot", [48, 1])
def test_groups_of_near_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "TILE", 16)
    rnd = random.Random(9)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(90)]
    rows = [(1000, None), (1001, ""), (1002, "a b c"), (1003, "a b c"), (1004, "a b c")]
    for k in range(70):
        words = list(base)
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(len(words))] = f"v{rnd.randint(0, 99999)}"
        rows.append((k, " ".join(words)))
    got = by_id(jaccard.similar_groups(frame(spark, rows)), "n_shingles", "component_id")
    assert got == B.groups(rows)
    kept = {r["doc_id"] for r in jaccard.one_of_each(frame(spark, rows + [(1002, "a b c")])).collect()}
    assert kept == {d for d, (n, c) in got.items() if d == c}


def test_one_of_each_with_null_and_equal_ids(spark):
    text = lambda k: " ".join(f"w{k}x{n}" for n in range(30))
    near = text(1) + " and"
    rows = [(None, text(1)), (None, near), (None, text(2)), (None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (5, text(5)), (6, text(4)), (None, text(4)), (5, "")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(frame(spark, rows)).collect()]
    first = [x for x in kept if x[1] in (text(1), near)]
    assert len(first) == 1 and first[0][0] is None
    assert sorted((x for x in kept if x not in first), key=repr) == sorted([(None, text(2)), (None, text(3)), (5, text(4)), (5, text(5)), (5, "")], key=repr)


def test_a_large_group_costs_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 64)
    rnd, real, costs = random.Random(12), jaccard.compared, []
    base = [f"w{k}" for k in range(120)]

    def counted(tiles, sets, keys, percent):
        costs[-1] += sum(r["count"] ** 2 for r in tiles.groupBy(*keys).count().collect())
        return real(tiles, sets, keys, percent)

    monkeypatch.setattr(jaccard, "compared", counted)
    for n in (500, 2000):
        rows = []
        for k in range(n):
            words = list(base)
            words[rnd.randrange(len(words))] = f"v{k}"
            rows.append((k, " ".join(words)))
        costs.append(0)
        groups = jaccard.similar_groups(frame(spark, rows))
        assert [r["component_id"] for r in groups.select("component_id").distinct().collect()] == [0]
    assert 0 < costs[1] < 6 * costs[0]  # the square would be 16 times


def test_families_of_one_group_are_told_apart(spark, monkeypatch):
    for name, value in (("HOT", 4), ("TILE", 12)):
        monkeypatch.setattr(jaccard, name, value)
    rnd = random.Random(13)
    shared = [f"s{k}" for k in range(40)]
    rows = []
    for k in range(160):
        own = [f"f{k % 5}x{j}" for j in range(30)]
        words = shared + own
        for _ in range(rnd.choice([0, 1, 2, 4])):
            words[rnd.randrange(len(words))] = f"v{rnd.randint(0, 500)}"
        rows.append((k, " ".join(words)))
    assert by_id(jaccard.similar_groups(frame(spark, rows)), "n_shingles", "component_id") == B.groups(rows)


def test_few_tokens_of_one_node_are_moved(spark):
    rnd, cells = np.random.default_rng(14), 1 << 17  # the tokens of prefixes are of few cells of the sketch
    tokens = (rnd.integers(0, 1 << 42, 60_000, np.uint64) << np.uint64(22) | rnd.integers(0, cells, 60_000, np.uint64)).view(np.int64)
    nodes = spark.createDataFrame([(k, 300 << 4 | 1, tokens[k * 100 : (k + 1) * 100].tolist()) for k in range(600)], "node long, size long, tokens array<long>")
    several = spark.createDataFrame([(t,) for t in tokens[:10_000].tolist()], "token long")
    moved = {(r["token"], r["node"], r["meta"]) for r in jaccard.repeated_tokens(nodes, several).collect()}
    assert {(t, k // 100, k % 100 << 32 | 300 << 4 | 1) for k, t in enumerate(tokens[:10_000].tolist())} <= moved
    assert len(moved) < 10_000 + 50_000 * 0.06


# --- 7 ---


def test_licenses_match_brute_force(spark, sf):
    for df in (frame(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        rows = df.select("doc_id", "text").collect()
        found = licenses.scan(df.select("doc_id", "text")).collect()
        got = sorted(((r["doc_id"], r["n_words"], sorted(s["start"] for s in r["spans"] if s["phrase"])) for r in found), key=repr)
        starts = lambda w: sorted(s for p in B.PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
        want = sorted(((i, B.phrases(t)[0], starts(B.words(t))) for i, t in rows), key=repr)
        assert got == want


def test_notices_with_inserted_missing_and_swapped_words(spark):
    notice = licenses.NOTICES["bsd-text"].split()
    at = notice.index("modification")
    inserted, missing, swapped = list(notice), [w for w in notice if w != "modification"], list(notice)
    inserted.insert(at, "any")
    swapped[2], swapped[3] = swapped[3], swapped[2]
    fragment = " ".join(notice[:4] * 12)
    texts = [" ".join(["So"] * k + x) for k in (0, 7) for x in (notice, inserted, missing, swapped)] + [fragment]
    found = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "spans")
    for k, text in enumerate(texts[:-1]):
        (span,) = found[k][0]
        words = B.words(text)
        grams = {tuple(notice[p : p + 4]) for p in range(len(notice) - 3)}
        places = [p for p in range(len(words) - 3) if tuple(words[p : p + 4]) in grams]
        assert (span["label"], span["start"], span["end"]) == ("bsd-text", places[0], places[-1] + 4)
        assert span["cover"] == pytest.approx(len(places) / len(grams)) and span["cover"] >= 0.7
    assert found[len(texts) - 1][0] == []


def licence_spans(text):
    """{(label, start, end): cover}, counted place by place."""
    words, out = B.words(text), {}
    for template, label, whole in licenses.templates():
        k = licenses.PHRASE_K if whole else licenses.NOTICE_K
        n = len(template) - k + 1
        hits = sorted((p - q, p, q) for q in range(n) for p in range(len(words) - k + 1) if words[p : p + k] == template[q : q + k])
        runs = []
        for d, p, q in hits:
            if runs and (d == runs[-1][-1][0] or not whole and d - runs[-1][-1][0] <= licenses.DRIFT):
                runs[-1].append((d, p, q))
            else:
                runs.append([(d, p, q)])
        for run in runs:
            cover = len({q for _, _, q in run}) / n
            if cover >= (1 if whole else licenses.NOTICE_COVER):
                places = [p for _, p, _ in run]
                out[(label, min(places), max(places) + k)] = cover
    return out


def test_spans_of_whole_texts_match_brute_force(spark):
    rnd = random.Random(8)
    texts = [None, "", LONG]
    for label in [*licenses.WHOLE, *licenses.NOTICES] * 2:
        words = (licenses.WHOLE.get(label) or licenses.NOTICES[label]).split()
        for _ in range(rnd.randint(0, 6)):
            k = rnd.randrange(len(words))
            words[k : k + 1] = rnd.choice([[], ["new"], [words[k], "added"], [words[k]] * 2])
        texts.append("Foreword, " + " ".join(words[: rnd.randint(len(words) // 2, len(words))]) + ". The MIT License; " + "the software " * 3)
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "spans")
    for k, text in enumerate(texts):
        assert {(s["label"], s["start"], s["end"]): pytest.approx(s["cover"]) for s in got[k][0]} == licence_spans(text)
    assert sum("MIT" in {s["label"] for s in x} for (x,) in got.values()) >= 1


def test_votes_need_the_words_not_only_their_hash(spark, monkeypatch):
    real = licenses.template_grams()
    monkeypatch.setattr(licenses, "template_grams", lambda: [(g, t, p, w if t else "other words") for g, t, p, w in real])
    found = by_id(licenses.scan(spark.createDataFrame([(1, "GNU General Public License, Apache License")], "doc_id long, text string")), "spans")
    assert [s["label"] for s in found[1][0]] == ["apache"]


# --- 8 ---


def test_urls_match_brute_force(spark, sf):
    odd = [(1, None), (2, "nothing"), (3, "http://A.COM/en/x?y"), (4, "s://example.com/en/77#z"), (5, "x://com"), (6, "://de.example.net/de/88"), (7, "http://h?://i/"), (8, "http://evil.org/es/")]
    pages = spark.createDataFrame([(i, u, None) for i, u in odd], "page_id long, url string, html string")
    for df, rows in ((pages, odd), (spark.read.parquet(f"{sf}/pages.parquet"), docs_of(sf, "pages", "page_id", "url"))):
        got = {r["page_id"]: r for r in urls.judge(df).collect()}
        for i, u in rows:
            host, path, rule, verdict = B.url(u)
            assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
            assert got[i]["verdict"] == (verdict or got[i]["verdict"])


def ranks(n, weight, seed, damping):
    """Dense personalised PageRank by solving its equation. weight[i, j]: what i sends to j."""
    out = weight.sum(axis=1, keepdims=True)
    share = np.divide(weight, out, out=np.zeros_like(weight), where=out > 0)
    return np.linalg.solve(np.eye(n) - damping * share.T, (1 - damping) * seed)


@pytest.mark.parametrize("bond, hub", [(0, 100_000), (1, 3), (4, 1)])
def test_ranks_match_dense_ones(spark, monkeypatch, bond, hub):
    monkeypatch.setattr(urls, "HUB", hub)
    rnd = random.Random(11)
    hosts = ["a.com", "www.a.com", "b.net", "x.b.net", "c.org", "x.y.c.org", "d.io", "spam.io", "e.io", "lonely.io"]
    forms = ['<a href="http://{}/x">', "<link rel=canonical href='//{}/'>", "<a href=https:\\/\\/{}\\/y>", "see https://{}?q now", 'src="//{}#t"', "<a href='HTTP://{}:'>", 'href="https:&#x2F;&#x2F;{}/">']
    rows, links = [], Counter()
    for k in range(120):
        src, path = rnd.choice(hosts[:-1]), rnd.choice(["/en/1", "/de/1", "/es/2", "/it/3"])
        to = [rnd.choice(hosts[:9]) for _ in range(rnd.randint(0, 4))]
        links.update((src, d) for d in to if d != src)
        rows.append((k, f"http://{src.upper() if k % 5 == 0 else src}{path}", "<p>" + " ".join(rnd.choice(forms[:5] + forms[6:]).format(d) for d in to) + '<a href="/own">'))
    rows += [(200, "http://lonely.io/it/", None), (201, None, "http://a.com")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), bond=bond, tolerance=1e-7).collect()}
    pages = {i: B.url(u) for i, u, _ in rows}
    above = lambda h: [".".join(h.split(".")[j:]) for j in range(h.count("."))]
    names = sorted({h for h, *_ in pages.values() if h} | {d for _, d in links} | {x for h, *_ in pages.values() for x in above(h)})
    at, n = {h: k for k, h in enumerate(names)}, len(names)
    weight = np.zeros((n, n))
    for (s, d), c in links.items():
        weight[at[s], at[d]] += c
    for low, high in {(x, y) for h, *_ in pages.values() for x, y in zip(above(h), above(h)[1:])}:
        weight[at[low], at[high]] += bond
        weight[at[high], at[low]] += bond
    seeds = {v: np.zeros(n) for v in ("allow", "block")}
    share = np.zeros(n)
    for h, _, _, v in pages.values():
        share[at[h] if h else 0] += bool(h)
        if v:
            seeds[v][at[h]] += 1
    share /= share.sum()
    trust = ranks(n, weight, seeds["allow"] / max(1, seeds["allow"].sum()), urls.DAMPING)
    distrust = ranks(n, weight.T, seeds["block"] / max(1, seeds["block"].sum()), urls.DAMPING)
    seen = set()
    for i, (h, _, _, v) in pages.items():
        t, d, s = (trust[at[h]], distrust[at[h]], share[at[h]]) if h else (0, 0, 0)
        assert got[i]["trust"] == pytest.approx(t, abs=1e-5) and got[i]["distrust"] == pytest.approx(d, abs=1e-5)
        assert got[i]["verdict"] == (v or ("block" if d > urls.FACTOR * max(t, s) else "allow"))
        seen.add((bool(v), got[i]["verdict"]))
    assert len(seen) == 4


# --- 10 ---


def test_chat_matches_sql(spark, sf):
    got, want = both(queries.op10_chat(spark, sf), queries.ORACLES["op10_chat"], sf)
    assert got == want


def test_chat_machine(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "<|end|>\n&amp;["), (2, 0, "assistant", "x"), (2, None, "user", None), (3, 0, "user", "a"), (3, 1, "user", "b"), (None, 0, None, "<|"), (4, 0, "system", "s")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(table)).collect()}
    assert [(got[i]["valid"], got[i]["first_wrong_turn"]) for i in (1, 2, 3, None, 4)] == [(True, None), (True, None), (False, 1), (False, 0), (False, None)]
    assert got[1]["loss_text"] == "<|end|>\n&amp;[" and got[1]["turns"][1]["text"] == "<|end|>\n&amp;["


# --- all ---


CLASHES = ("n_tokens", "lang_pred", "score", "rejected", "media", "ids", "label", "n_shingles", "node", "host", "verdict", "share", "segments", "formatted", "n_words", "hash", "n_bytes", "error", "base", "extra", "words", "decoded")


def clashing(df):
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES if c not in df.columns))


def every_operator(docs, pages, items, turns):
    """All operators over some tables, by name."""
    rows, byte_bpe, piece_bpe = docs.withColumn("lang", F.lit("en")), vocabulary(queries.BYTE_BPE), vocabulary(queries.PIECE_BPE)
    media = matroska.mux_texts(rows)
    return {
        "media": matroska.media_digest(media), "packets": matroska.packet_table(media, "doc_id"), "spans": pii.all_spans(docs), "sanitised": pii.sanitise(docs), "bpe": bpe.token_digest(docs, byte_bpe, ["doc_id"]),
        "decoded": bpe.decode(bpe.encode(docs, byte_bpe), byte_bpe), "language": language.predict(rows, language.train(rows, "text", "lang", "doc_id")), "contamination": decontaminate.matches(docs, items),
        "groups": jaccard.similar_groups(docs), "one": jaccard.one_of_each(docs), "licences": licenses.scan(docs), "urls": urls.judge(pages), "counts": token_counts.token_counts(docs, piece_bpe), "chat": chat.read_back(chat.formatted(turns)),
    }


def tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pages = spark.createDataFrame([(i, f"http://h{i}.org/es/" if t else None, t) for i, t in rows], "page_id long, url string, html string")
    items = spark.createDataFrame(rows[:4], "item_id long, text string")
    turns = spark.createDataFrame([(i, None if t else 1, "user" if t else None, t) for i, t in rows], "conv_id long, turn long, role string, text string")
    return docs, pages, items, turns


def test_empty_tables(spark):
    for name, df in every_operator(*tables(spark, [(1, "x")][:0])).items():
        assert df.count() == 0, name
    assert decontaminate.matches(frame(spark), tables(spark, [])[2]).count() == len(TEXTS)


def test_odd_and_repeated_rows_with_clashing_columns(spark):
    rows = [*TEXTS, *TEXTS[3:7], (None, None), (None, "x" * 300)]
    plain, odd = tables(spark, rows), [clashing(t) for t in tables(spark, rows)]
    once = {"packets", "one", "chat"}
    for (name, a), (_, b) in zip(every_operator(*plain).items(), every_operator(*odd).items()):
        shared = [c for c in a.columns if c not in ("label",) and a.columns.count(c) == 1]
        got = [sorted(map(repr, map(tuple, df.select(*shared).collect()))) for df in (a, b)]
        assert got[0] == got[1] and b.columns.count("n_tokens") <= 1, name
        assert name in once or len(got[0]) == len(rows), name


def test_very_long_texts(spark):
    said = "Mail a.b@c.org or +1 (377) 555-0271; the MIT License. "
    n = 20_000
    long = said * n
    docs = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    got = by_id(queries.pii_digest(docs), "n_email", "n_phone", "base_sha256")
    assert got[1] == (n, n, B.sha(",".join(B.pii(long))))
    found = by_id(licenses.scan(docs), "n_words", "spans")
    assert found[1][0] == len(B.words(long)) and sum(s["phrase"] for s in found[1][1]) == n
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "<|")], "conv_id long, turn long, role string, text string")
    assert [r["loss_text"] for r in chat.read_back(chat.formatted(turns)).collect()] == [long + "<|"]
    pages = spark.createDataFrame([(1, "http://a.net/it/" + "p" * 1_000_000, '<a href="//b.net/">' * 50_000)], "page_id long, url string, html string")
    assert urls.judge(pages).first()["host"] == "a.net"


def test_pipeline_matches_brute_force(spark, sf):
    import corpus_pipeline

    texts = {i: t for i, t in docs_of(sf) if t and any(c.isalpha() for c in t)}
    groups = B.groups(list(texts.items()), 5, 80)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    hit = B.contamination(list(texts.items()), docs_of(sf, "benchmark", "item_id"))
    want = {i for i in texts if not hit[i][4]}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == want and all(r["round_trip"] for r in rows)


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES[1:]])
def test_stages_begin_without_the_garbage_of_others(spark, sf, stage, monkeypatch):
    class Began(Exception):
        pass

    def held(*_, **__):
        raise Began(runtime.totalMemory())

    runtime, gateway = spark._jvm.java.lang.Runtime.getRuntime(), spark.sparkContext._gateway
    garbage = [gateway.new_array(gateway.jvm.long, 1 << 26) for _ in range(4)]
    before = runtime.totalMemory()
    del garbage
    gc.collect()
    for module, name in ((jaccard, "one_of_each"), (decontaminate, "matches"), (pii, "sanitise"), (bpe, "token_digest")):
        monkeypatch.setattr(module, name, held)
    with pytest.raises(Began) as began:
        stage(spark, queries.documents(spark, sf), sf)
    assert began.value.args[0] < before - (1 << 30)
