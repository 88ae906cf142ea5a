"""Operators on single texts and on sets of texts, against brute-force versions on small messy tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskspark.llm import bpe, fingerprint, langid, near_dedup, packing, quality, repeats, sharding
from riskspark.llm.graph import connected_components

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "ing"]) for _ in range(n))


def messy_texts():
    """NULL, empty, blank, short, long, exact and near copies, shared passages, odd characters."""
    rng = random.Random(4)
    passage = prose(rng, 40)
    base = prose(rng, 120).split()
    texts = [None, "", " ", "a", "one two three", "  double  spaces \n\n and\ttabs ", "é漢字 ñandú 12,345!? ", "x" * 5000, "<|endoftext|> is text", "123 456 %%%"]
    texts += [" ".join(base)] * 4
    for k in range(6):
        near = list(base)
        near[10 * k] = f"changed{k}"
        texts.append(" ".join(near))
    texts += [prose(rng, 30 + 5 * k) + " " + passage + " " + prose(rng, 10 + k) for k in range(8)]
    texts += [prose(rng, 12000), "ab " * 400, "ab " * 300, passage, passage[:99], passage[:100], passage[1:101]]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    """Ids in no order, with extra columns whose names operators use themselves."""
    rows = [(7 * i % 41, t, "xx", i, "k", 1.5) for i, t in enumerate(messy_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, length long, key string, rank double").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


# ---- byte-level BPE -----------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark, docs, empty):
    codec = bpe.codec(RANKS, PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, PATTERN, outputs=tuple(bpe.OUTPUTS)).collect()}
    for i, t in texts_of(docs).items():
        want = enc.encode_ordinary(t or "")
        assert got[i].ids == want and got[i].n_tokens == len(want)
        assert bytes(got[i].decoded) == (t or "").encode()
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    rng = random.Random(1)
    soup = ["".join(rng.choice("ab c\n\t é'sthe  12!?　漢\x1c\x85") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert [codec.encode(s) for s in soup] == [enc.encode_ordinary(s) for s in soup]
    for s in ("a" * 3000, "ab" * 2000, "é" * 500, "the" * 900, " " * 700):
        assert codec.encode(s) == enc.encode_ordinary(s)
    assert bpe.round_trip(empty, RANKS, PATTERN).count() == 0


def test_bpe_both_queues_agree():
    codec, rng = bpe.codec(RANKS, PATTERN), random.Random(2)
    pieces = [bytes(rng.choice(b"aabetnoi ") for _ in range(rng.randint(1, 64))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.merge_many(pieces)] == [codec.merge(p) for p in pieces]


# ---- packing ------------------------------------------------------------------------------------


def test_packing_places_every_piece(spark, docs, empty):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert added == {"<|endoftext|>": 50256}
    twice = docs.union(docs.limit(5))  # repeated rows are packed as separate documents
    rows = packing.pack_documents(twice, RANKS, PATTERN, capacity=256, added=added).toPandas()
    texts = texts_of(docs)
    counts = Counter(r.doc_id for r in twice.select("doc_id").collect())
    for doc, part in rows.groupby("doc_id"):
        ids = t.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        n = counts[doc]
        want = sorted((k, s, ln, zlib.crc32(np.array(ids[s : s + ln], "<u4").tobytes())) for k, (s, ln) in enumerate(pieces_of(len(ids), 256)) for _ in range(n))
        assert sorted(part[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, sequence in rows.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum().tolist()[:-1]] and sequence.length.sum() <= 256
    assert rows.sequence_id.nunique() <= best_fit(rows.length.tolist(), 256)
    assert packing.pack_documents(empty, RANKS, PATTERN).count() == 0


def test_piece_ids_equal_the_tokenizers_library():
    """Added tokens, long runs and odd characters, also where tiktoken's pattern engine gives up."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.PieceEncoder(RANKS, PATTERN, {"<|endoftext|>": 50256})
    rng = random.Random(11)
    soup = ["".join(rng.choice(["ab", " ", "\n", "é", "'s", "<|endoftext|>", "<|", "12", "漢", "!?"]) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    for s in [None, "", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", *messy_texts(), *soup]:
        assert encoder.encode(s).tolist() == t.encode(s or "", add_special_tokens=False).ids
    assert encoder.other is None
    blanks = " " * 1_500_000
    assert encoder.encode(blanks + "<|endoftext|>a b").tolist() == bpe.codec(RANKS, PATTERN).encode(blanks) + [50256, 64, 275]
    assert encoder.other is not None


def test_configuration_program_covers_the_histogram():
    """The fractional cover is near the program's bound (within 1 % for texts' lengths), and whole configurations hold at least 80 % of the tokens."""
    rng = np.random.default_rng(4)
    for gap, sizes in zip((0.01, 0.02, 0.02), (np.minimum(rng.lognormal(5.5, 1.1, 6000).astype(int) + 1, 2047), rng.integers(1, 2048, 9000), np.repeat(rng.integers(1, 700, 40), rng.integers(1, 400, 40)))):
        lengths, counts = np.unique(sizes, return_counts=True)
        cover, bound = packing.fractional_cover(lengths, counts.astype(float), 2048)
        held = np.zeros(len(lengths))
        for pieces, times in cover.items():
            assert sum(lengths[j] for j in pieces) <= 2048 and times > 0
            np.add.at(held, list(pieces), times)
        assert (held >= counts * (1 - 1e-6)).all()
        assert bound <= sum(cover.values()) <= (1 + gap) * bound
        rest = counts.copy()
        groups = packing.whole_configurations(cover, lengths, rest)
        assert (rest >= 0).all() and (lengths * rest).sum() <= 0.2 * (lengths * counts).sum()
        assert sum(n * sum(own) for n, own in groups) == (lengths * (counts - rest)).sum()
        plan = packing.plan_sequences(dict(zip(lengths.tolist(), counts.tolist())), 2048)
        assert sum(n for n, _ in plan) <= 1.007 * bound + 1


def pieces_of(n, capacity):
    first = n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def best_fit(items, capacity):
    """Bins of plain best-fit decreasing."""
    rooms = []
    for item in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= item]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - item)
    return len(rooms)


def fewest(items, capacity):
    """Optimal number of bins by search over small instances."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1 :])
        place(i + 1, bins + [items[i]])

    place(0, [])
    return best[0]


def test_packing_plan_is_close_to_optimal():
    rng = random.Random(3)
    for _ in range(25):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        groups = packing.plan_sequences(Counter(items), 20)
        assert Counter(x for n, own in groups for x in own for _ in range(n)) == Counter(items)
        assert all(sum(own) <= 20 for _, own in groups)
        assert sum(n for n, _ in groups) <= fewest(items, 20) + 1
    # lengths that only fit in pairs: the linear program must find the pairs
    groups = packing.plan_sequences({700: 1000, 1348: 1000, 1025: 10, 1023: 10}, 2048)
    assert sum(n for n, _ in groups) == 1010
    assert packing.plan_sequences({}, 8) == [] and packing.plan_sequences({8: 10**12}, 8) == [(10**12, [8])]


# ---- near-duplicates ----------------------------------------------------------------------------


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def components(nodes, links):
    of = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    return of


@pytest.mark.parametrize("family_docs", [near_dedup.FAMILY_DOCS, 2])
def test_near_duplicates_equal_brute_force(spark, docs, empty, family_docs):
    extra = spark.createDataFrame([(100, "One two three"), (101, "one TWO\x0bthree"), (102, "one two three"), (None, "one two three")], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(extra)
    got = near_dedup.near_duplicates(table, size=4, family_docs=family_docs).collect()
    sets = {i: shingles(t, 4) for i, t in texts_of(table).items() if i is not None}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(i, len(s), want[i], want[i] == i) for i, s in sets.items()}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("family_docs", [near_dedup.FAMILY_DOCS, 2])
def test_near_duplicates_of_rows_that_share_an_id(spark, family_docs):
    """Rows of one id with different texts are nodes of their own; repeated rows agree; a very long text keeps its links."""
    rng = random.Random(12)
    a, b, c = (prose(rng, 60) for _ in range(3))
    long = prose(rng, 30_000)
    rows = [(1, a), (1, b), (2, b + " word"), (3, a + " word"), (3, a + " word"), (5, c), (5, b + " other"), (7, c + " end"), (8, long), (9, long + " more"), (10, None), (10, "")]
    nodes = list(enumerate(rows))
    sets = {n: shingles(t, 4) for n, (_, t) in nodes}
    links = [(m, n) for m, n in combinations(sets, 2) if sets[m] and 100 * len(sets[m] & sets[n]) >= 80 * len(sets[m] | sets[n])]
    group = components(sets, links)
    least = {g: min(rows[n][0] for n in sets if group[n] == g) for g in group.values()}
    want = sorted((i, len(sets[n]), least[group[n]], least[group[n]] == i) for n, (i, _) in nodes)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=4, family_docs=family_docs)
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("family_docs", [near_dedup.FAMILY_DOCS, 2])
def test_large_loose_group(spark, family_docs):
    """Copies with random edits: many pairs miss the threshold, but chains of links hold the group."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(100)] = f"e{i}"
        rows.append((i, " ".join(own)))
    sets = {i: shingles(t, 5) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), family_docs=family_docs)
    assert {r.doc_id: r.component_id for r in got.collect()} == components(sets, links)


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150), (5, 5)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(31)}, 100: 100, 150: 100, 200: 100}


# ---- language, quality --------------------------------------------------------------------------


def test_language_edge_cases(spark, docs, empty):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("no language", None)], "text string, lang string")
    prototypes = langid.learn(train)
    assert list(prototypes) == ["en", "fr"]
    got = {r.doc_id: r for r in langid.predict(docs, prototypes).collect()}
    for i, t in texts_of(docs).items():
        letters = any(map(str.isalpha, t or ""))
        assert (got[i].lang_pred == "und") == (not letters) and 0 <= got[i].score <= 1
    assert langid.identify(["the dog", "le chien", "12 %", None], prototypes)[0] == ["en", "fr", "und", "und"]
    assert langid.identify(["the dog"], langid.learn(train.where("lang is null")))[0] == ["und"]
    assert langid.predict(empty, prototypes).count() == 0


def test_language_prototypes_and_choice_by_hand(spark, docs, monkeypatch):
    """Prototypes are the sums of all their texts' trigram vectors, a text goes to the largest cosine, score and ties included."""
    monkeypatch.setattr(langid, "FLUSH_GRAMS", 40)
    langs = ["aa", "bb", "cc"]
    rows = [(i, t, langs[i % 3] if i % 5 else None) for i, t in enumerate(messy_texts() + ["漢字 text", "ÀÉ 12 àé", "zz"])]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)

    def bundle(text):
        letters = re.sub(" +", " ", "".join(ch if ch.isalpha() else " " for ch in (text or "").lower()))
        total = np.zeros(langid.DIMENSIONS)
        grams = Counter(letters[k : k + 3] for k in range(len(letters) - 2))
        if grams:
            total = np.array(list(grams.values())) @ langid.gram_vectors(np.array([[ord(ch) for ch in g] for g in grams])).astype(float)
        return total

    want = {lang: sum(bundle(t) for _, t, own in rows if own == lang and t is not None) for lang in langs}
    got = langid.learn(table)
    assert list(got) == langs and all(np.allclose(got[lang], want[lang]) for lang in langs)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(table, got).collect()}
    for i, text, _ in rows:
        if not any(map(str.isalpha, text or "")):
            assert found[i] == (langid.UNKNOWN, 0.0)
            continue
        own = bundle(text)
        cosines = [own @ p / max(np.linalg.norm(own), 1e-9) / np.linalg.norm(p) for p in want.values()]
        assert found[i][1] == pytest.approx(max(0.0, max(cosines)), abs=1e-5)
        assert cosines[langs.index(found[i][0])] == pytest.approx(max(cosines), abs=1e-6)


def test_language_bundle_by_hand():
    """The vector of a text is the sum of its trigrams' bound vectors."""
    v, r = langid.letter_vector, np.roll
    want = sum(r(v(ord(a)), 2).astype(int) * r(v(ord(b)), 1) * v(ord(c)) for a, b, c in ("the", "he ", "e a", " at", "at "))
    grams, counts = langid.count_grams(["The, at!"])
    assert (counts[0] @ langid.gram_vectors(grams) == want).all()


def test_quality_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, "clash") for i in range(0, 41)] + [(None, 1, ""), (5, None, ""), (3, 7, "")], "doc_id long, quality int, text string")
    one = labels.where("quality = 1")
    for known in (labels, one, labels.where("false")):
        model = quality.learn(docs, known, "doc_id", "text", "quality")
        got = quality.predict(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.predict(empty, model).count() == 0
    bad, good = ["buy!! now!! " * 9 for _ in range(40)], ["a calm text about birds and trees"] * 40
    weights, bias = quality.train(bad + good, [0] * 40 + [1] * 40)
    scores = quality.Scorer(weights, bias).scores(["buy!! it now!! now!!", "birds and calm trees", "", None])
    assert scores[0] < 0.5 < scores[1] and scores[2] == scores[3]


def test_quality_training_equals_plain_loops(monkeypatch):
    """The batched gradients against one text, one feature at a time."""
    monkeypatch.setattr(quality, "EPOCHS", 2)
    monkeypatch.setattr(quality, "FEWEST_STEPS", 5)
    rng = random.Random(15)
    texts = [prose(rng, rng.randint(1, 25)) for _ in range(45)] + ["", "buy buy buy now", " "]
    labels = [int("the" in t) for t in texts]
    weights, bias = quality.train(texts, labels)

    draw = np.random.default_rng(7)
    vectors = draw.uniform(-1 / quality.DIMENSIONS, 1 / quality.DIMENSIONS, (quality.BUCKETS + 1, quality.DIMENSIONS))
    output, free = np.zeros((quality.DIMENSIONS, 2)), np.log(np.bincount(labels) / len(labels))
    each = -(-len(texts) // quality.MINIBATCH)
    epochs = max(2, -(-5 // each))
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for a in range(0, len(texts), quality.MINIBATCH):
            rows = [r for r in order[a : a + quality.MINIBATCH] if len(quality.text_features(texts[r])[0])]
            rate = quality.RATE * (1 - step / (epochs * each))
            step += 1
            d_output, d_free, d_vectors = np.zeros_like(output), np.zeros(2), {}
            for r in rows:
                ids, shares = quality.text_features(texts[r])
                mean = sum(vectors[i] * w for i, w in zip(ids, shares))
                z = mean @ output + free
                p = np.exp(z) / np.exp(z).sum()
                p[labels[r]] -= 1
                d_output += np.outer(mean, p) / len(rows)
                d_free += p / len(rows)
                for i, w in zip(ids, shares):
                    d_vectors[i] = d_vectors.get(i, 0) + w * (output @ p) / len(rows)
            output -= rate * d_output
            free -= rate * 0.1 * d_free
            for i, g in d_vectors.items():
                vectors[i] -= rate * len(rows) * g
    assert np.allclose(weights, vectors @ (output[:, 1] - output[:, 0]), atol=1e-9) and bias == pytest.approx(free[1] - free[0])


def test_quality_score_is_the_trained_network():
    """The summed word shares equal the softmax over the mean of the feature vectors."""
    rng = np.random.default_rng(0)
    weights, bias = rng.normal(size=quality.BUCKETS + 1), 0.3
    text = "one two two two, three é漢"
    ids, shares = quality.text_features(text)
    want = 1 / (1 + np.exp(-(bias + (weights[ids] * shares).sum())))
    assert quality.Scorer(weights, bias).scores([text])[0] == pytest.approx(want)


# ---- sharding -----------------------------------------------------------------------------------


def test_sharding_law(spark, docs, empty):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(3000)] + [(3000 + i, "hot " * 20) for i in range(1500)] + [(9000, None), (9000, ""), (None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(table).toPandas()
    assert len(got) == len(rows) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() - size.min() < 0.05 * size.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    have = got[got.doc_id.notna()]
    assert Counter(zip(have.doc_id.astype(int), have["size"], have.text_crc32)) == want
    text_of = dict(rows)
    groups = defaultdict(set)
    for i, s in zip(have.doc_id.astype(int), have.shard):
        groups[text_of[i]].add(s)
    assert all(len(s) == 1 for t, s in groups.items() if t and not t.startswith("hot"))
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(docs, shards=3).count() == docs.count()


# ---- fingerprints -------------------------------------------------------------------------------


def test_sharding_divides_rows_equal_in_all_columns(spark):
    """A third of all rows with one text and one id, and a third without an id: no range holds them whole, and shards stay even."""
    rng = random.Random(14)
    rows = [(7, "the same text " * 20)] * 2000 + [(None, "no id, one text " * 15)] * 2000 + [(100 + i, prose(rng, rng.randint(1, 60))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    records = sharding.sized_records(docs, "doc_id", "text").cache()
    total = records.agg(F.sum("size")).first()[0]
    ranged = sharding.with_range(records, sharding.sampled_splitters(records, 64, total))
    assert max(r["count"] for r in ranged.groupBy("range").count().collect()) < 6000 / 64 * 6
    got = sharding.shard(docs, shards=8).toPandas()
    assert len(got) == 6000 and got.groupby("shard")["size"].sum().max() - got.groupby("shard")["size"].sum().min() < total * 0.01
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_fingerprint_of_edited_texts(spark, docs, empty):
    lexicon = fingerprint.Lexicon(WORDS)
    rows = fingerprint.edited_likeness(docs, lexicon).collect()
    texts = texts_of(docs)
    ids = sorted(texts)
    assert sorted(r.doc_id for r in rows) == ids
    marks = {r.doc_id: r.fingerprint for r in rows}
    for r in rows:
        t, after = texts[r.doc_id] or "", ids[(ids.index(r.doc_id) + 1) % len(ids)]
        half = len(t) // 2
        edited = t[: len(t) - half] + (texts[after] or "")[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == lexicon.fingerprint(t) and r.edited_fingerprint == lexicon.fingerprint(edited)
        assert r.near_next == fingerprint.likeness(r.fingerprint, marks[after]) and 0 <= r.near_edited <= 1
    assert len({marks[i] for i in ids if texts[i] == texts_mode(texts)}) == 1
    assert fingerprint.edited_likeness(empty, lexicon).count() == 0
    alone = spark.createDataFrame([(3, "one of the two")], "doc_id long, text string")
    assert [(r.doc_id, r.near_next) for r in fingerprint.edited_likeness(alone, lexicon).collect()] == [(3, 1.0)]


def texts_mode(texts):
    return Counter(t for t in texts.values() if t).most_common(1)[0][0]


def test_next_document_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "DOCS_PER_RANGE", 50)
    rows = [(3 * i, f"text {i} " + "w " * (i % 7)) for i in range(400)] + [(None, "first")]
    got = fingerprint.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), fingerprint.Lexicon(["w"])).collect()
    texts = [t for _, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0])]
    want = Counter()
    for t, after in zip(texts, texts[1:] + texts[:1]):
        want[hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter(r.edited_sha256 for r in got) == want


def test_next_document_with_hot_ids(spark, monkeypatch):
    """Rows without an id, and rows of one id, are divided by their texts; every row still meets its next one."""
    monkeypatch.setattr(fingerprint, "DOCS_PER_RANGE", 50)
    monkeypatch.setattr(fingerprint, "SEARCHED", 3)
    rows = [(None, f"no id {i}") for i in range(500)] + [(7, f"one id {i}") for i in range(500)] + [(10 + i, f"text {i}") for i in range(500)] + [(9, "the same")] * 60
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed = fingerprint.ranges_with_next(table, "doc_id", "text").where("guest = 0").groupBy("range").count().collect()
    assert sum(r["count"] for r in placed) == len(rows) and max(r["count"] for r in placed) < 250
    marks = {t: h for t, h in spark.createDataFrame([(t,) for _, t in rows], "text string").distinct().select("text", F.xxhash64("text")).collect()}
    ordered = [t for _, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], marks[r[1]]))]
    want = Counter((t, hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()) for t, after in zip(ordered, ordered[1:] + ordered[:1]))
    got = fingerprint.edited_likeness(table, fingerprint.Lexicon(["no", "one", "text"])).collect()
    assert Counter(r.edited_sha256 for r in got) == Counter(h for _, h in want.elements())


def test_lexicon_band(spark):
    rows = [(i, f"common, rare{i} mid{i % 20}") for i in range(200)]
    lexicon = fingerprint.build_lexicon(spark.createDataFrame(rows, "doc_id long, text string"))
    assert lexicon.terms == sorted(f"mid{k}" for k in range(20))


def test_lexicon_band_counts_copies_once(spark, monkeypatch):
    """One text in a third of the rows, with terms that others have too; repeated and NULL ids."""
    hot = " ".join(f"mid{k}" for k in range(20))
    rows = [(i, f"common, rare{i} mid{i % 20}") for i in range(200)] + [(i % 3 or None, hot) for i in range(100)]
    rows += [(i, f"twice{i % 50}") for i in range(150)] + [(7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = Counter(t for text in {t or "" for _, t in rows} for t in fingerprint.terms_of(text))
    for few in (fingerprint.COPIED_TEXTS, 0):  # by a broadcast, by a shuffle
        monkeypatch.setattr(fingerprint, "COPIED_TEXTS", few)
        texts, n = fingerprint.with_copies(docs, "text")
        assert n == 252 and {r.term: r.n for r in fingerprint.document_frequencies(texts).collect()} == want
        assert fingerprint.build_lexicon(docs).terms == sorted(f"mid{k}" for k in range(20))


def test_texts_without_filled_parts(spark):
    """Different texts without lexicon terms, or whose terms no subset holds, aren't alike."""
    lexicon = fingerprint.Lexicon([f"w{k}" for k in range(200)])
    lexicon.prepare()
    lone = [t for t, m in zip(lexicon.terms, lexicon.member) if not m.any()]
    texts = ["alpha", "beta", "", " ", "w1 w2 w3 w4 w5 w6", *lone[:2]]
    assert len(texts) == 7
    marks = [lexicon.fingerprint(t) for t in texts]
    assert {len(m) for m in marks} == {4 * fingerprint.SUBSETS}
    for a, b in combinations(marks, 2):
        assert fingerprint.likeness(a, b) == fingerprint.likeness(b, a) == 0.0
    assert [fingerprint.likeness(m, lexicon.fingerprint(t)) for m, t in zip(marks, texts)] == [1.0] * 7
    rows = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "beta"), (4, None), (5, "")], "doc_id long, text string")
    got = fingerprint.edited_likeness(rows, fingerprint.Lexicon(["w"])).collect()
    assert {r.doc_id: r.near_next for r in got} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 1.0, 5: 0.0}


# ---- repeated passages --------------------------------------------------------------------------


def cut_by_hand(rows):
    """(n_bytes, spans, kept) by looking up every window."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - repeats.LENGTH + 1):
            w = data[k : k + repeats.LENGTH]
            if w in seen:
                gone[k : k + repeats.LENGTH] = b"\x01" * repeats.LENGTH
            seen.add(w)
        runs = [(m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(gone))]
        out[i] = (len(data), runs, bytes(a for a, g in zip(data, gone) if not g))
    return out


@pytest.mark.parametrize("hot_spans", [repeats.HOT_SPANS, 1])
def test_repeats_equal_brute_force(spark, docs, empty, hot_spans):
    rng = random.Random(6)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(40, 260))) for _ in range(12)]
    rows = [(1000 + i, rng.choice(["", "é", "xyz"]).join(rng.choice(parts) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    rows += [(2000, "z" * 500), (2001, "z" * 130), (2002, "yz" * 200), (2003, None)]
    rows += list(texts_of(docs).items())
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("bucket", F.lit(1)).repartition(4)
    got = {r.doc_id: (r.n_bytes, [(s.first, s.stop) for s in r.spans], bytes(r.kept)) for r in repeats.remove_repeats(table, hot_spans=hot_spans).collect()}
    assert got == cut_by_hand(rows)
    small = {r.doc_id: (r.n_bytes, [(s.first, s.stop) for s in r.spans], bytes(r.kept)) for r in repeats.remove_repeats(table, hot_spans=hot_spans, bucket_bytes=3_000).collect()}
    assert small == got
    assert repeats.remove_repeats(empty).count() == 0


def test_repeated_rows_and_texts(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh ") for _ in range(150)) + "é" * 10
    rows = [(1, text), (1, text), (2, "ñ" + text[30:]), (3, None), (None, text)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), as_text=True).collect()
    kept = sorted((r.doc_id or 0, r.kept) for r in got if r.doc_id != 3)
    assert kept == [(0, text), (1, ""), (1, ""), (2, "ñ")]  # a NULL id comes first
    assert [r.kept for r in got if r.doc_id == 3] == [None]


def test_prefix_intervals_by_hand():
    # suffix order with common prefixes 0 2 3 2 0 1: the tree's nodes
    got = {(a, b, p) for a, b, p, _ in repeats.prefix_intervals(np.array([0, 2, 3, 2, 0, 1]), 1)}
    assert got == {(1, 4, 2), (2, 3, 3), (5, 6, 1)}
