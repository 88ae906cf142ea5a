"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds
(multiplies) its letters' vectors, the first rotated twice and the second once; a text's vector
bundles (adds) its trigrams' vectors, and a language's prototype bundles all its training texts.
A text gets the language whose prototype has the largest cosine with the text's vector.

Training counts trigrams per language (the only rows that are shuffled) and bundles them in
Spark; the driver receives ``languages * dimensions`` numbers. Prediction is one narrow pass.

A trigram runs over lower-cased letters; every run of other characters counts as one blank.

Defined cases: NULL text, the empty text and a text without letters are ``und`` with score 0, as is
everything when no language was learned; rows with NULL text or language teach nothing; equal
cosines go to the alphabetically first language. Very long texts are counted whole; repeated rows count and are
predicted one by one, ids play no part; an empty table teaches nothing and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import groups_of, map_rows, pa_schema, worker_state

DIMENSIONS = 1024
SEED = 20_011
DOCS_AT_ONCE, CHARS_AT_ONCE = 256, 1 << 21
FLUSH_GRAMS = 1 << 18  # counts that a task holds before it passes them on
DENSE_GRAMS = 1 << 22  # trigram codes are indexed directly below, sorted above
UNKNOWN = "und"
POINTS = 0x110000


@cache
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(POINTS)), bool, POINTS)


@cache
def letter_vector(point: int) -> np.ndarray:
    return np.random.default_rng([SEED, point]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 per trigram (rows of three code points)."""
    points, at = np.unique(grams, return_inverse=True)
    letters = np.stack([letter_vector(int(p)) for p in points])
    at = at.reshape(grams.shape)
    return np.roll(letters, 2, 1)[at[:, 0]] * np.roll(letters, 1, 1)[at[:, 1]] * letters[at[:, 2]]


def count_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams (rows of three code points) of some texts, and counts as a (texts, trigrams) matrix."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    codes = np.where(letter_table()[codes], codes, 32)
    # one blank for a run of other characters, also at the texts' ends
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (owner[1:] != owner[:-1])
    codes, owner = codes[keep], owner[keep]
    seen = np.zeros(POINTS, bool)
    seen[codes] = True
    points = np.flatnonzero(seen)
    number = np.zeros(POINTS, np.int64)
    number[points] = np.arange(len(points))
    small, k = number[codes], len(points)
    whole = owner[2:] == owner[:-2]
    gram = (small[:-2] * k + small[1:-1]) * k + small[2:]
    gram, owner = gram[whole], owner[2:][whole]
    if k**3 <= DENSE_GRAMS:
        present = np.zeros(k**3, bool)
        present[gram] = True
        found = np.flatnonzero(present)
        place = np.zeros(k**3, np.int64)
        place[found] = np.arange(len(found))
        at = place[gram]
    else:
        found, at = np.unique(gram, return_inverse=True)
    counts = np.bincount(owner * len(found) + at, minlength=len(texts) * len(found)).reshape(len(texts), len(found))
    return points[np.stack([found // k**2, found // k % k, found % k], axis=1)] if k else np.zeros((0, 3), np.int64), counts


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language in ``labelled``."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    gram_schema = pa_schema(spark, "lang string, gram string, n long")

    def counts_of(total: dict[tuple[str, str], int]) -> pa.RecordBatch:
        langs, grams = zip(*total) if total else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(list(total.values()), pa.int64())], schema=gram_schema)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], int] = {}
        for b in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for i, j in groups_of(texts, DOCS_AT_ONCE, CHARS_AT_ONCE):
                    found, counts = count_grams(texts[i:j])
                    for g, n in zip(found.tolist(), counts.sum(axis=0).tolist()):
                        key = (lang, "".join(map(chr, g)))
                        total[key] = total.get(key, 0) + n
                if len(total) > FLUSH_GRAMS:
                    yield counts_of(total)
                    total = {}
        yield counts_of(total)

    counted = rows.mapInArrow(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    bundle_schema = pa_schema(spark, "lang string, d int, x double")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            langs, n = np.array(b.column("lang").to_pylist()), b.column("n").to_numpy()
            vectors = gram_vectors(np.array([[ord(c) for c in g] for g in b.column("gram").to_pylist()]))
            for lang in np.unique(langs).tolist():
                mine = langs == lang
                sums[lang] = sums.get(lang, 0) + n[mine].astype(float) @ vectors[mine]
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v)), pa.array(range(len(v)), pa.int32()), pa.array(v)], schema=bundle_schema)

    parts = counted.mapInArrow(bundle, "lang string, d int, x double").groupBy("lang", "d").agg(F.sum("x").alias("x"))
    prototypes: dict[str, np.ndarray] = {}
    for r in parts.collect():  # languages * DIMENSIONS numbers
        prototypes.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["d"]] = r["x"]
    return dict(sorted(prototypes.items()))


def identify(texts: list[str | None], prototypes: dict[str, np.ndarray]) -> tuple[list[str], list[float]]:
    """Language and score (cosine, 0 where negative) of each text."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not prototypes:
        return langs, scores
    worker_state("langid", dict)
    names = list(prototypes)
    unit = np.stack([p / (np.linalg.norm(p) or 1) for p in prototypes.values()]).astype(np.float32)
    known = [t or "" for t in texts]
    for i, j in groups_of(known, DOCS_AT_ONCE, CHARS_AT_ONCE):
        grams, counts = count_grams(known[i:j])
        if not len(grams):
            bundles = np.zeros((j - i, DIMENSIONS), np.float32)
        else:
            bundles = counts.astype(np.float32) @ gram_vectors(grams).astype(np.float32)
        cosines = bundles @ unit.T / np.maximum(np.linalg.norm(bundles, axis=1), 1e-9)[:, None]
        best = cosines.argmax(axis=1)
        for k in range(i, j):
            if any(map(str.isalpha, known[k])):
                langs[k] = names[best[k - i]]
                scores[k] = float(min(1.0, max(0.0, cosines[k - i, best[k - i]])))
    return langs, scores


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every text; no other column is read."""

    def batch(cols: dict[str, list]) -> dict[str, list]:
        langs, scores = identify(cols["text"], prototypes)
        return {"id": cols["id"], "lang_pred": langs, "score": scores}

    kind = docs.schema[id_col].dataType.simpleString()
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(pairs, batch, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
