"""Near-duplicate detection: MinHash signatures and a multi-index Hamming join.

1. Every text becomes its set of hashed word shingles and a signature of ``POSITIONS`` MinHash symbols of
   16 bits. Texts with equal sets form a class, which gets a number; only the classes go on.
2. Two signatures' distance is the number of positions that differ. The signature is split into
   ``CHUNKS`` chunks. If two signatures differ in at most ``DISTANCE`` positions, some chunk holds at most
   ``DISTANCE // CHUNKS`` = 1 of them (pigeonhole); so every chunk is indexed once for each place where its
   one error may be, with that place masked. All pairs within the distance share an index key.
   A pair at similarity 0.8 lies beyond the distance with a probability of about 2e-5.
3. Texts that share keys, directly or over other texts, form a family; all pairs within the distance lie inside
   families. A family of at most ``FAMILY_DOCS`` texts and ``FAMILY_SHINGLES`` shingles is one unit of a task:
   each text's signature is compared with those before it, and pairs within the distance that aren't yet in
   one component are confirmed on full sets. A task returns one row per text, no pairs.
4. Larger families are spread out: each text is first confirmed against one text of its keys, which joins
   most copies; then, in every key that still holds several components, texts of different components are
   compared. Keys of more than ``TILE`` texts are split into pairs of tiles. The confirmed links'
   components are the families' components.

Full sets are computed again from the texts that steps 3 and 4 need. Those texts are found by a Bloom
filter of bounded size over their classes' smallest ids, and told from other texts of such an id by their sets'
hashes, so the texts are never shuffled.

Defined cases: NULL text counts as empty; texts without words have no shingles, no links, and stand
alone; a NULL id takes no part in links; rows of one id with different texts are separate nodes, each with the
smallest id that it reaches; repeated rows get equal results; very long texts enter with all their shingles; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import groups_of, materialize, pa_schema, release_memory, worker_state
from riskspark.llm.graph import connected_components
from riskspark.llm.shingles import scrambled, shingle_sets

POSITIONS, CHUNKS, DISTANCE = 80, 16, 31
WIDTH = POSITIONS // CHUNKS
TILE = 1024
FAMILY_DOCS, FAMILY_SHINGLES = 8192, 1 << 23
CHARS_AT_ONCE = 1 << 18
FILTER_WORDS = 1 << 18  # 64-bit words of the Bloom filter at most
FILTER_HASHES = 4
FACTORS = scrambled(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One 16-bit symbol per position: the mixed minimum of the set under a multiplication."""
    return (scrambled((shingles[None, :] * FACTORS[:, None]).min(axis=1)) >> np.uint64(48)).astype("<u2")


def signed_documents(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, h1, h2, sig): set size, hash of the whole set, signature (NULL without shingles)."""
    ddl = "id long, n long, h1 long, h2 long, sig binary"
    schema = pa_schema(docs.sparkSession, ddl)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near-duplicates", dict)
        for b in batches:
            texts = b.column("text").to_pylist()
            n, h1, h2, sigs = [], [], [], []
            for i, j in groups_of(texts, len(texts), CHARS_AT_ONCE):
                for own in shingle_sets(texts[i:j], size):
                    n.append(len(own))
                    first, second = set_hashes(own)
                    h1.append(first)
                    h2.append(second)
                    sigs.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, (n, h1, h2)), pa.array(sigs, pa.binary())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(sign, ddl)


def set_hashes(own: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set."""
    mixed = scrambled(own)
    return int(mixed.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mixed * np.uint64(3), initial=np.uint64(0)).astype(np.int64))


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, id): every chunk of a signature with each of its places masked in turn."""
    schema = pa_schema(classes.sparkSession, "key long, id long")
    places = [np.delete(np.arange(WIDTH), m) for m in range(WIDTH)]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
            ids = b.column("id").to_numpy()
            for m, kept in enumerate(places):
                key = np.zeros(sigs.shape[:2], np.uint64)
                for k in kept:
                    key = key << np.uint64(16) | sigs[:, :, k]
                salt = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(m + 1)
                key = scrambled(scrambled(key) ^ salt * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(ids, CHUNKS))], schema=schema)

    return classes.select("id", "sig").mapInArrow(index, "key long, id long")


def id_filter(ids: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(bits, words) of a Bloom filter; about ten bits an id, up to ``FILTER_WORDS`` words."""
    bits = 64 * min(FILTER_WORDS, max(16, n * 10 // 64 + 1))
    places = F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits)) for k in range(FILTER_HASHES)]))
    set_bits = ids.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x"))
    words = np.zeros(bits // 64, np.int64)
    for r in set_bits.toLocalIterator():
        words[r["w"]] = r["x"]
    return bits, words


def full_sets(docs: DataFrame, needed: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles): the whole sets of ``needed`` classes (id, rep, n, h1, h2), each read from a row with the id ``rep``. Rows of one id may
    hold several texts, so a row's class is told by its set's size and hashes."""
    reps = needed.select(F.col("rep").alias("id")).distinct()
    bits, words = id_filter(reps, needed.count())
    ddl = "_rep long, _n long, _h1 long, _h2 long, shingles binary"
    schema = pa_schema(docs.sparkSession, ddl)
    probes = F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits)) for k in range(FILTER_HASHES)])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for b in batches:
            if not b.num_rows:
                continue
            p = b.column("p").flatten().to_numpy().reshape(-1, FILTER_HASHES)
            hit = (words[p >> 6] >> (p & 63) & 1).all(axis=1)
            ids = b.column("id").filter(pa.array(hit))
            texts = b.column("text").filter(pa.array(hit)).to_pylist()
            found = [(len(own), *set_hashes(own), own.tobytes()) for i, j in groups_of(texts, len(texts), CHARS_AT_ONCE) for own in shingle_sets(texts[i:j], size)]
            n, h1, h2, own = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (n, h1, h2)), pa.array(own, pa.binary())], schema=schema)

    found = rows.withColumn("p", probes).mapInArrow(sets, ddl)
    same = (F.col("rep") == F.col("_rep")) & (F.col("n") == F.col("_n")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    return needed.select("id", "rep", "n", "h1", "h2").join(found, same).select("id", "shingles").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs with 100 * intersection >= percent * union of the full sets."""
    schema = pa_schema(pairs.sparkSession, "a long, b long")
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    joined = joined.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], schema=schema).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(check, "a long, b long").distinct()


def close_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of different components within the signature distance, from (key, tiles, id, component, sig) rows."""
    tiles = F.col("tiles")
    own = F.pmod(F.xxhash64("id"), tiles).cast("int")
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    dealt = members.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "component", "sig")
    schema = pa_schema(members.sparkSession, "a long, b long")

    def compare(group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        x, y = group[0][1], group[0][2]
        ids, comps = (np.array([g[k] for g in group], np.int64) for k in (4, 5))
        sigs = np.frombuffer(b"".join(g[6] for g in group), "<u2").reshape(len(group), POSITIONS)
        side = np.array([g[3] for g in group])
        left = np.flatnonzero(side == x)
        if x == y:  # those outside the largest component against all
            values, counts = np.unique(comps, return_counts=True)
            left = np.flatnonzero(comps != values[counts.argmax()])
        right = np.flatnonzero(side == y)
        a, b = [], []
        for i in left.tolist():
            others = right[comps[right] != comps[i]]
            near = others[(sigs[others] != sigs[i]).sum(axis=1) <= DISTANCE]
            a.append(np.minimum(ids[near], ids[i]))
            b.append(np.maximum(ids[near], ids[i]))
        return np.concatenate(a or [ids[:0]]), np.concatenate(b or [ids[:0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][:3] != row[:3]:
                    out.append(compare(held))
                    held = []
                held.append(row)
            yield record(out)
        if held:
            yield record([compare(held)])

    def record(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.unique(np.stack([np.concatenate([f[k] for f in found]) for k in (0, 1)]), axis=1) if found else np.zeros((2, 0), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    ordered = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def family_components(family: list[tuple[int, np.ndarray]], percent: int) -> list[int]:
    """Component (smallest id) of each (id, shingles) of one family."""
    ids = [i for i, _ in family]
    sets = [own for _, own in family]
    sizes = np.array([len(own) for own in sets])
    sigs = np.stack([signature(own) for own in sets])
    starts = np.cumsum(sizes) - sizes
    words, place = np.unique(np.concatenate(sets), return_inverse=True)
    mark, place = np.zeros(len(words), np.int32), place.astype(np.int32)
    del words
    group = np.arange(len(ids))  # smallest position that each text is joined to
    for i in range(1, len(ids)):
        near = np.flatnonzero((sigs[:i] != sigs[i]).sum(axis=1) <= DISTANCE)
        while len(near):
            near = near[group[near] != group[i]]
            some, near = near[:256], near[256:]  # a hit spares the rest of its component
            if not len(some):
                break
            mark[place[starts[i] : starts[i] + sizes[i]]] = 1
            members = np.concatenate([place[starts[j] : starts[j] + sizes[j]] for j in some.tolist()])
            both = np.add.reduceat(mark[members], np.cumsum(sizes[some]) - sizes[some])
            mark[place[starts[i] : starts[i] + sizes[i]]] = 0
            for j in some[100 * both >= percent * (sizes[some] + sizes[i] - both)].tolist():
                if group[j] != group[i]:
                    low, high = sorted((group[i], group[j]))
                    group[group == high] = low
    smallest = {}
    for i, g in zip(ids, group.tolist()):
        smallest[g] = min(i, smallest.get(g, i))
    return [smallest[g] for g in group.tolist()]


def components_by_family(rows: DataFrame, percent: int) -> DataFrame:
    """(node, component) of (family, id, shingles) rows; each family as a whole."""
    ddl = "node long, component long"
    schema = pa_schema(rows.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        held, name = [], None

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array(family_components(held, percent), pa.int64())], schema=schema)

        for b in batches:
            for family, i, own in zip(b.column("family").to_pylist(), b.column("id").to_pylist(), b.column("shingles").to_pylist()):
                if held and family != name:
                    yield close()
                    held = []
                name = family
                held.append((i, np.frombuffer(own, np.uint64)))
        if held:
            yield close()

    return rows.select("family", "id", "shingles").repartition("family").sortWithinPartitions("family", "id").mapInArrow(run, ddl)


def components_by_keys(members: DataFrame, texts: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """(node, component) of texts in families of any size, spread over tasks by key."""
    votes = members.where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("n"))
    tried = votes.groupBy("id").agg(F.max(F.struct("n", -F.col("hub"))).alias("best")).select(F.col("id").alias("b"), (-F.col("best.col2")).alias("a"))
    first = materialize(confirmed(tried, sets, percent), f"{label}-links")
    groups = connected_components(first, f"{label}-groups")

    placed = members.join(groups, F.col("id") == F.col("node"), "left").select("key", "size", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_keys = placed.join(mixed, "key").join(texts, "id").withColumn("tiles", F.ceil(F.col("size") / F.lit(TILE)).cast("int"))
    second = materialize(confirmed(close_pairs(open_keys), sets, percent), f"{label}-more-links")
    return connected_components(first.union(second), f"{label}-components")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", label: str = "near", family_docs: int = FAMILY_DOCS
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    signed = materialize(signed_documents(docs, size, id_col, text_col), f"{label}-signed")
    linked = signed.where("id is not null and n > 0")
    # a class is a text's set; it goes by a number, as rows of one id may be of several classes
    classes = linked.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.min("sig").alias("sig"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), f"{label}-classes")
    texts = classes.select("id", "sig")
    keys = index_keys(texts)
    shared = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(keys.join(shared, "key"), f"{label}-keys")

    hubs = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    families = connected_components(hubs, f"{label}-families").select(F.col("node").alias("id"), F.col("component").alias("family"))
    families = families.join(classes.select("id", "rep", "n", "h1", "h2"), "id")
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"))
    is_small = (F.col("texts") <= family_docs) & (F.col("shingles") <= FAMILY_SHINGLES)
    families = materialize(families.join(sizes.select("family", is_small.alias("small")), "family"), f"{label}-sized")

    sets = materialize(full_sets(docs, families, size, id_col, text_col), f"{label}-sets")
    found = components_by_family(families.where("small").select("family", "id").join(sets, "id"), percent)
    large = families.where(~F.col("small")).select("id")
    if not large.isEmpty():
        found = found.union(components_by_keys(members.join(large, "id", "left_semi"), texts, sets, percent, label))

    group = classes.select("h1", "h2", "n", "rep", "id").join(found, F.col("id") == F.col("node"), "left").select("h1", "h2", "n", "rep", F.coalesce("component", "id").alias("group"))
    group = materialize(group, f"{label}-groups-of-classes")
    smallest = group.groupBy("group").agg(F.min("rep").alias("component_id"))
    named = group.join(smallest, "group").select("h1", "h2", "n", "component_id")
    whole = linked.select("h1", "h2", "n", "id").join(named, ["h1", "h2", "n"]).select("id", "n", "component_id")
    alone = signed.where("id is null or n = 0").select("id", "n", F.col("id").alias("component_id"))
    every = whole.union(alone)
    return every.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
