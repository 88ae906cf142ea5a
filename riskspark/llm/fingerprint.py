"""I-Match fingerprints with randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band: they occur in at least
``RAREST`` and at most ``COMMONEST`` of all distinct texts, so copies of a text never move a term out of
the band. Its size has a bound that doesn't depend on the number of documents: (mean number of distinct
terms per distinct text) / ``RAREST``.

A text's fingerprint has ``SUBSETS`` parts. Each part belongs to a random subset of the lexicon;
the text's distinct terms in the subset are sorted and hashed. Subsets come in several densities,
so short texts have terms in the dense ones and long texts keep some sparse ones unchanged under edits.
A part without terms is marked empty; a text without any filled part has a hash of its exact text
as its fingerprint instead. The likeness of two fingerprints is the share of equal parts among
those that aren't empty in both, at the density where it is largest.

A term is a lower-cased word between white space, without ASCII punctuation at its ends.

Defined cases: NULL text counts as empty; a fingerprint of an exact text has likeness 1 to that of an
equal text and 0 to all others; equal texts have equal fingerprints; equal fingerprints have likeness 1; documents with equal ids are
neighbours in the order of their texts' hashes; a single document is its own next one; NULL ids come first; very long
texts enter whole; repeated rows each get their result, an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import map_rows, materialize, pa_schema, worker_state

RAREST, COMMONEST = 0.001, 0.2
FEWEST_DOCS = 2  # a lexicon term occurs in so many distinct texts at least
DENSITIES = (1 / 32, 1 / 128, 1 / 512)
SUBSETS = 96  # a third of them in each density
FEWEST_PARTS = 4  # a density with fewer filled parts counts as having so many
SEED = b"lexicon"
MEMO_TERMS = 1 << 19
EMPTY = "----"
EXACT = "="  # first character of the fingerprint of an exact text
COPIED_TEXTS = 1 << 19  # more texts with copies than these are joined by a shuffle instead of a broadcast


def bare(word: str) -> str:
    return word.strip(string.punctuation)


def terms_of(text: str | None) -> set[str]:
    return {t for t in map(bare, set((text or "").lower().split())) if t}


def with_copies(docs: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """(text, copies) of every row, and the number of distinct texts; NULL counts as the empty text.

    Only digests are shuffled, and the texts stay where they are unless very many of them have copies."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    counts = materialize(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "text-copies")
    copied = counts.where("copies > 1")
    few = copied.count() <= COPIED_TEXTS
    found = texts.join(F.broadcast(copied) if few else copied, "digest", "left")
    return found.select("text", F.coalesce("copies", F.lit(1)).alias("copies")), counts.count()


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(term, n): in how many distinct texts each term occurs; counted per task before the shuffle.

    ``rows`` are (text, copies). Each row counts as one part in ``copies``, so the copies of a text count as one
    text together; rounding takes the sum back to the whole number that it stands for."""
    schema = pa_schema(rows.sparkSession, "term string, n double")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, float] = {}
        for b in batches:
            for text, copies in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                share = 1 / copies
                for term in terms_of(text):
                    total[term] = total.get(term, 0.0) + share
            if len(total) > MEMO_TERMS:
                yield counted_terms(total)
                total = {}
        yield counted_terms(total)

    def counted_terms(total: dict[str, float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], schema=schema)

    counted = rows.select("text", "copies").mapInArrow(count, "term string, n double")
    return counted.groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("n"))


def build_lexicon(docs: DataFrame, text_col: str = "text") -> Lexicon:
    """Terms inside the band, over all distinct texts; bounded as the module's docstring says."""
    rows, n = with_copies(docs, text_col)
    band = F.col("n").between(max(FEWEST_DOCS, int(np.ceil(RAREST * n))), COMMONEST * n)
    return Lexicon([r["term"] for r in document_frequencies(rows).where(band).select("term").collect()])


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=SEED).digest(), "little")


def scrambled(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lexicon:
    """Band terms with their hashes and their subsets; travels to the workers as the terms alone."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = sorted(terms)
        self.key = hashlib.blake2b("\n".join(self.terms).encode("utf-8", "surrogatepass")).hexdigest()
        self.place: dict[str, int] = {}

    def __reduce__(self):
        return lexicon_of, (self.key, self.terms)

    def prepare(self) -> None:
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.hashes = np.array([hash64(t) for t in self.terms], np.uint64)
        draws = scrambled(self.hashes[:, None] + np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        density = np.array([DENSITIES[s % len(DENSITIES)] for s in range(SUBSETS)])
        self.member = (draws >> np.uint64(11)) < (density * 2.0**53).astype(np.uint64)
        # each subset hashes a term in its own way
        self.salted = np.where(self.member, scrambled(draws ^ self.hashes[:, None]), np.uint64(0))
        self.memo: dict[str, int] = {}

    def places(self, text: str) -> np.ndarray:
        """Sorted distinct lexicon terms of a text, as numbers."""
        if not self.place and self.terms:
            self.prepare()
        if not self.terms:
            return np.zeros(0, np.int64)
        memo = self.memo
        if len(memo) > MEMO_TERMS:
            memo.clear()
        words = set(text.lower().split())
        got = set(map(memo.get, words))
        if None in got:
            for w in words.difference(memo):
                memo[w] = self.place.get(bare(w), -1)
            got = set(map(memo.__getitem__, words))
        got.discard(-1)
        return np.array(sorted(got), np.int64)

    def fingerprint(self, text: str) -> str:
        """Four hexadecimal digits a subset; ``EMPTY`` where the text has none of its terms. ``exact`` if all are empty."""
        at = self.places(text)
        if not len(at):
            return exact(text)
        # an additive hash of the sorted distinct terms
        parts = scrambled(self.salted[at].sum(axis=0)) >> np.uint64(48)
        digits = parts.astype(">u2").tobytes().hex()
        filled = self.member[at].any(axis=0)
        if filled.all():
            return digits
        if not filled.any():
            return exact(text)
        return "".join(digits[4 * s : 4 * s + 4] if f else EMPTY for s, f in enumerate(filled.tolist()))


def lexicon_of(key: str, terms: list[str]) -> Lexicon:
    """The worker's one copy of a lexicon."""
    return worker_state(f"lexicon {key}", lambda: Lexicon(terms))


def exact(text: str) -> str:
    """The fingerprint of a text without filled parts: ``EXACT`` and a hash of the text, as long as any other."""
    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    return (EXACT + digest).ljust(len(EMPTY) * SUBSETS, EMPTY[0])


def likeness(a: str, b: str) -> float:
    """Over the densities, the largest share of equal parts among those that aren't empty in both."""
    if a == b:
        return 1.0
    if EXACT in (a[0], b[0]):
        return 0.0
    x, y = (np.frombuffer(s.encode(), "S4").reshape(-1, len(DENSITIES)) for s in (a, b))
    counted = (x != EMPTY.encode()) | (y != EMPTY.encode())
    equal = ((x == y) & counted).sum(axis=0)
    return float((equal / np.maximum(counted.sum(axis=0), FEWEST_PARTS)).max())


def fingerprints(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every text."""
    kind = docs.schema[id_col].dataType.simpleString()
    pairs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_rows(pairs, lambda cols: {"id": cols["id"], "fingerprint": [lexicon.fingerprint(t) for t in cols["text"]]}, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


DOCS_PER_RANGE = 4_000
MOST_RANGES = 1 << 14
SAMPLE_PER_RANGE = 32  # sampled rows behind each boundary
SEARCHED = 128  # boundaries of a first, coarse look
NO_ID = -(1 << 63)


def ranges_with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range, guest, id, text): documents in ranges of ascending (id, hash of the text), sorted within each.

    The first document after a range also stands at its end as a guest (after the last range: the very
    first document), so every document finds its next one in its own range. One shuffle of the
    texts. Boundaries come from a bounded sample of (id, hash), so an id that many rows share, or rows
    without one, are divided by their texts; only rows equal in both stay together, and a range is read as a stream."""
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))
    keys = rows.select("id", "mark")
    n = keys.count()
    parts = max(1, min(MOST_RANGES, n // DOCS_PER_RANGE))
    cuts: list[tuple[int, int]] = []
    if parts > 1:  # at most about MOST_RANGES * SAMPLE_PER_RANGE pairs of numbers
        drawn = sorted(map(tuple, keys.sample(min(1.0, parts * SAMPLE_PER_RANGE / n), seed=11).collect()))
        cuts = sorted({drawn[i * len(drawn) // parts] for i in range(1, parts)}) if drawn else []
    # two short looks in place of one through all boundaries
    blocks = [cuts[i : i + SEARCHED] for i in range(0, len(cuts), SEARCHED)]
    search = spark.createDataFrame([([b[0] for b in blocks], blocks or [[]])], "heads array<struct<id:bigint,mark:bigint>>, blocks array<array<struct<id:bigint,mark:bigint>>>")

    def numbered(df: DataFrame) -> DataFrame:
        before = lambda c: (c["id"] < F.col("id")) | ((c["id"] == F.col("id")) & (c["mark"] < F.col("mark")))
        found = df.crossJoin(F.broadcast(search)).withColumn("_block", F.greatest(F.size(F.filter("heads", before)) - 1, F.lit(0)))  # one row
        inside = F.size(F.filter(F.get("blocks", F.col("_block")), before))
        return found.withColumn("range", (F.col("_block") * SEARCHED + inside).cast("int")).drop("heads", "blocks", "_block")

    firsts = numbered(keys).groupBy("range").agg(F.min(F.struct("id", "mark")).alias("first")).collect()  # one row a range
    firsts = sorted((r["range"], *r["first"]) for r in firsts)
    hosts = [(firsts[i - 1][0], *first) for i, (_, *first) in enumerate(firsts)]  # the first one's host is the last range
    guests = spark.createDataFrame(hosts, "host int, id long, mark long")
    placed = numbered(rows).join(F.broadcast(guests), ["id", "mark"], "left")  # at most MOST_RANGES rows
    own = F.struct(F.col("range"), F.lit(0).alias("guest"))
    visit = F.struct(F.col("host").alias("range"), F.lit(1).alias("guest"))
    placed = placed.withColumn("at", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, visit))))
    placed = placed.select("at.range", "at.guest", "id", "text", "mark").repartition("range").sortWithinPartitions("range", "guest", "id", "mark", "text")
    return placed.drop("mark")


def edited_likeness(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text's second half (floor(n / 2) code points) is replaced by as many first code points
    of the next document, or all it has."""
    ddl = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = pa_schema(docs.sparkSession, ddl)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, id, text, fingerprint) that waits for its next document
        for b in batches:
            rows = []
            for part, guest, doc, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and held[0] != part:
                    held = None
                if guest and not held:
                    continue  # a second guest: a row of an equal id
                mark = lexicon.fingerprint(text)
                if held:
                    _, was, before, own = held
                    half = len(before) // 2
                    edited = before[: len(before) - half] + text[:half]
                    changed = lexicon.fingerprint(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((was, len(before), digest, own, changed, likeness(own, changed), likeness(own, mark)))
                held = None if guest else (part, doc, text, mark)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    found = ranges_with_next(docs, id_col, text_col).mapInArrow(pairs, ddl)
    named = F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col)
    return found.select(named, *[c for c in found.columns if c != "id"])
