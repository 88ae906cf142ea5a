"""Hard negatives, conversation repair and token files, against brute-force versions on small messy tables."""

import functools
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskspark.llm import conversations, hard_negatives, token_store
from riskspark.llm.common import table
from riskspark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


# ---- hard negatives -----------------------------------------------------------------------------


def mined(rows, anchors, k=5, least=80, most=100, scale=256):
    """Every pair scored, row by row; rows are (id, vector, label)."""
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(scale * x) for x in v], label))
    out = []
    for n, (i, v, label) in enumerate(good):
        if not anchors(i):
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, lab) for m, (j, w, lab) in enumerate(good) if m != n and len(w) == len(v))
        for s, j, _ in [o for o in others if o[2] == label][:k]:
            fits = [o for o in others if o[2] != label and least * -s <= 100 * -o[0] <= most * -s]
            out += [(i, j, rank, o[1], -s, -o[0]) for rank, o in enumerate(fits[:k], 1)]
    return sorted(out)


def vectors(rng, n, dim, labels):
    return [(i, [rng.choice([rng.uniform(-0.3, 0.4), 0.25, rng.uniform(0, 0.4)]) for _ in range(dim)], rng.choice(labels)) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 8, 13])
def test_hard_negatives_equal_brute_force(spark, dim, monkeypatch):
    rng = random.Random(dim)
    rows = vectors(rng, 90, dim, [0, 0, 0, 1, 2])
    rows += [(200 + i, rows[3][1], rows[3][2]) for i in range(6)] + [(300 + i, rows[3][1], 1 + rows[3][2]) for i in range(6)]  # ties
    rows += [(7, [0.1] * dim, 0), (10, rows[10][1], 0), (10, rows[10][1], 1)]  # repeated ids and rows
    rows += [(400, None, 0), (401, [None] * dim, 0), (402, [math.nan] * dim, 1), (403, [math.inf] * dim, 1), (404, [0.2] * dim, None), (None, [0.2] * dim, 0)]
    rows += [(500 + i, [0.5] * (dim + 3), i % 2) for i in range(4)] + [(600, [], 0), (601, [], 1), (602, [], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, row string, dim int").repartition(3)
    for block, asked in ((10_000, 10_000), (11, 3)):
        monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
        monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", asked)
        monkeypatch.setattr(hard_negatives, "SCORED_AT_ONCE", 7 if block < 100 else 4096)
        monkeypatch.setattr(hard_negatives, "TABLES_AT_ONCE", 2 if block < 100 else 64)
        got = hard_negatives.mine(df, F.col("label"), F.col("vec_id") % 5 == 0)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 5 == 0)


def test_hard_negatives_empty_and_wide(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.mine(spark.createDataFrame([], schema), F.col("label"), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, [0.1], 0)], schema), F.col("label"), F.col("vec_id") % 5 == 0).count() == 0
    rng = random.Random(3)  # components of 28 bits, sums beyond 53
    rows = [(i, [float(rng.randint(-(2**19), 2**19)) for _ in range(9)], i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("label"), F.col("vec_id") % 4 == 0, least=1).collect())) == mined(rows, lambda i: i % 4 == 0, least=1)


def test_subset_sums_are_inner_products():
    rng = np.random.default_rng(5)
    a, c = rng.integers(-300, 300, (4, 19)), rng.integers(-300, 300, (50, 19))
    low, bits = int(c.min()), int(c.max() - c.min()).bit_length()
    planes = hard_negatives.pack_planes(c, low, bits)
    assert (hard_negatives.unpack_planes(planes, low, 19) == c).all()
    tables = hard_negatives.subset_sums(a, np.int32)
    assert tables[1, 0b101, 2] == a[2, 8] + a[2, 10]
    assert (hard_negatives.score_rows(planes, tables, low * a.sum(axis=1)) == c @ a.T).all()


# ---- conversation repair ------------------------------------------------------------------------

BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit) of (initial, fault) rows: every edit tried from every place, the shortest and ASCII-least kept."""
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 2:
            for role in "ua":
                if (state, role) in grammar:
                    c, a = best(i, grammar[state, role], inserted + 1)
                    found.append((3 + c, "I" + a))
        if i < len(rows):
            role, fault = rows[i]
            c, a = best(i + 1, state, 0)
            found.append((4 + c, "D" + a))
            if fault not in ("blank", "duplicate"):
                for new, cost, letter in ((role, 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
                    if (state, new) in grammar:
                        c, a = best(i + 1, grammar[state, new], 0)
                        found.append((cost + (3 if fault == "truncated" else 0) + c, letter + a))
        return min(found, default=(1 << 40, ""))

    return best(0, "", 0)


def brute_repair(table_rows):
    convs = defaultdict(list)
    for conv, turn, role, text in table_rows:
        convs[conv]
        said = [" " if x is None else x for x in (role, text)]
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 1:
            said[1] = ""
        if harm == 2:
            said[1] = re.sub("[.!?]", "", said[1])
        if harm == 4:
            said[0] = "user"
        convs[conv] += [(turn, *said)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            left = text.rstrip(BLANK)
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {t for t, *_ in rows if t is not None}
        cost, audit = cheapest(tuple((r[1][:1], f) for r, f in zip(rows, faults)))
        names, lines, at, last = {"u": "user", "a": "assistant"}, [], iter(rows), ""
        for letter in audit:
            row = next(at) if letter != "I" else (None, "", "")
            if letter in "IR":
                last = "a" if last == "u" else "u"
                lines.append(f"{names[last]}:{row[2]}")
            elif letter == "K":
                last = row[1][:1]
                lines.append(f"{row[1]}:{row[2]}")
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def messy_conversations(rng, n=150, longest=14):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system" if turn == 0 else "user", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Why?", f"Text {rng.random()}.", f"Text {rng.random()}.", "cut off", "é漢 …", " \t\n", "", None, "a.\x0b\n ", "Yes. "])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    rows += [(None, t, r, f"Null {t}.") for t, r in enumerate(["system", "user", "assistant", "user"])]
    rows += [(1, 0, "user", "Same."), (1, 0, "user", "Same."), (-5, None, None, None)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, conv string, live int"


def repaired(df, **limits):
    got = conversations.repair(conversations.damaged(df), **limits)
    return {r[0]: tuple(r)[1:] for r in got.collect()}


def test_repair_equals_brute_force(spark):
    rows = messy_conversations(random.Random(8))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    assert repaired(df) == brute_repair(rows)
    assert conversations.repair(conversations.damaged(df.limit(0))).count() == 0


def test_repair_in_blocks_equals_brute_force(spark, monkeypatch):
    """A hot conversation of hundreds of rows, cut into blocks and folded in several levels, beside short ones."""
    rng = random.Random(9)
    rows = messy_conversations(rng, 12)
    rows += [(77, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Said {t}.", f"Said {t}", "Again.", " "])) for t in range(260)]
    rows += [(None, None, rng.choice(["user", "assistant"]), f"No turn {t}.") for t in range(40)]
    rows += [(k, t, "user", "Dropped.") for k in (21, 22, 23) for t in gone(k)]  # nothing left after damage
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    monkeypatch.setattr(conversations, "BLOCK_ROWS", 5)
    monkeypatch.setattr(conversations, "FOLD", 4)
    want = brute_repair(rows)
    assert any(v[6] == "" for v in want.values()) and len(want[77][6]) > 200
    assert repaired(df, long_rows=9) == want
    assert repaired(df, long_bytes=40) == want


def gone(conv):
    return [t for t in range(400) if zlib.crc32(f"{conv}:{t}".encode()) % 20 == 0][:12]


def test_search_equals_every_path():
    """Short rows against every edit string, by cost and then ASCII order."""
    kinds = list(itertools.product("suax", (conversations.FINE, conversations.GONE, conversations.CUT)))
    names = {conversations.FINE: None, conversations.GONE: "blank", conversations.CUT: "truncated"}
    rng = random.Random(2)
    cases = [[]] + [[k] for k in kinds] + [[rng.choice(kinds) for _ in range(rng.randint(2, 9))] for _ in range(400)]
    for rows in cases:
        assert conversations.Search(rows).run() == cheapest(tuple((r, names[f]) for r, f in rows))


def test_repair_query_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in QUERIES["op12_deepening_repair"](spark, SMALL).collect()}
    assert got == brute_repair(rows)


# ---- token files --------------------------------------------------------------------------------


def test_word_encoder_equals_library():
    t = Tokenizer.from_file(WORD_FILE)
    encoder = token_store.WordEncoder(WORD_FILE)
    rng = random.Random(6)
    words = ["The", "don't", "it's,", "'s", "!'s", "can'table", "élan,", "Σίσυφος", "ΟΔΟΣ", "漢字", "J̌", "ét", "≮", "≠a", "x y", " ", "a\x1cb", "\x85", "12ab", "3.14", "…”.", "“q”", "<|endoftext|>", "a<|startoftext|>b",
             "<|STARTOFTEXT|>", "İ", "ß.", "ﬁ,", "_x_", "a_b", "½", "²", "x" * 300, "́", "é'", "q.́", "🙂.", "", "ª!", "Ⅷ,", "​", "a‍b"]
    soup = ["".join(rng.choice("ab Cé'.,!1<|>\n\t́ ΣJ̌ſKÅ٣½") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts = ["", " ", "a", *words, " ".join(words), "".join(words), *soup, "word " * 300_000, "y" * 1_500_000, "z" * 1_200_000 + " ab " + "c.d " * 9]
    got = list(encoder.encode(pa.array(texts, pa.string())))
    assert list(encoder.encode(pa.array(texts[:3000], pa.string()).slice(7))) == got[7:3000]
    assert list(encoder.encode(pa.array([], pa.string()))) == []
    for s, ids in zip(texts, got):
        assert np.frombuffer(ids, encoder.kind).tolist() == t.encode(s, add_special_tokens=False).ids, s[:60]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(token_store, "MEMO_WORDS", 50)
    monkeypatch.setattr(token_store, "BYTES_AT_ONCE", 900)
    monkeypatch.setattr(token_store, "PART_CHARS", 100)
    encoder, t = token_store.WordEncoder(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    texts = [" ".join(f"w{random.Random(k).random()}x" for k in range(a, a + 30)) for a in range(0, 300, 7)]
    assert [np.frombuffer(i, "<u2").tolist() for i in encoder.encode(pa.array([*texts, *texts]))] == 2 * [t.encode(s, add_special_tokens=False).ids for s in texts]
    assert len(encoder.memo) < 250


def test_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BATCH_BYTES", 4_000)
    t, rng = Tokenizer.from_file(WORD_FILE), random.Random(5)
    texts = [None, "", " ", "One two.", "one  TWO.", "<|endoftext|> é", "w " * 40_000] + [" ".join(rng.choice(["alpha", "beta", "Gamma,", "delta's"]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    rows = [(3 * i % 87 - 20, s, "clash") for i, s in enumerate(texts)] + [(None, "No id.", ""), (None, "No id.", ""), (5, "twice", ""), (5, "twice", "")] + [(9, "hot id", "")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    folder = str(tmp_path / "ids")
    manifest = token_store.write_documents(docs, folder, WORD_FILE, end_id=1)
    found = token_store.read_documents(manifest, folder).collect()
    key = lambda k: (k is not None, k or 0)
    found.sort(key=lambda r: r.start)
    assert [key(r.key and int(r.key)) for r in found] == sorted(key(r[0]) for r in rows)
    assert [r.start for r in found] == [0, *itertools.accumulate(len(r.ids) // 4 for r in found)][:-1]
    want = sorted((key(i), t.encode(s or "", add_special_tokens=False).ids + [1]) for i, s, _ in rows)
    assert sorted((key(r.key and int(r.key)), np.frombuffer(r.ids, "<u4").tolist()) for r in found) == want
    assert manifest.agg(F.sum("documents"), F.sum("ids")).first() == (len(rows), sum(len(w[1]) for w in want))
    some = token_store.read_documents(manifest, folder, keys=["9", "-20"]).collect()
    assert sorted((r.key, r.start, bytes(r.ids)) for r in some) == sorted((r.key, r.start, bytes(r.ids)) for r in found if r.key in ("9", "-20")) and len(some) > 60
    empty = token_store.store_and_read(docs.limit(0), WORD_FILE, 1)
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_reader_refuses_another_dictionary(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} of some") for i in range(200)], "doc_id long, text string")
    folder = tmp_path / "ids"
    manifest = token_store.write_documents(docs, str(folder), WORD_FILE, end_id=1)
    path = manifest.first().path
    (dictionary,) = folder.glob("*.dictionary")
    with open(path, "rb") as f:
        head = token_store.HEADER.unpack(f.read(token_store.HEADER.size))
    assert head[:3] == (b"TOKZ", 1, 2) and head[3].hex() == dictionary.name.split(".")[0]
    assert hashlib.sha256(dictionary.read_bytes()).hexdigest() == head[3].hex()
    dictionary.write_bytes(b"other")
    token_store._dictionary.cache_clear()
    store, _ = token_store.filesystem(str(folder))
    with pytest.raises(ValueError, match="dictionary"):
        token_store.Reader(store.open_input_file(path), str(folder))


def test_token_query_equals_library(spark):
    t = Tokenizer.from_file(WORD_FILE)
    docs = table(spark, SMALL, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    want, start = [], 0
    for r in docs:
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op13_token_store"](spark, SMALL).collect())) == want
