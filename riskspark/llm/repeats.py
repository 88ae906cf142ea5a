"""Exact removal of repeated passages: an enhanced sparse suffix array with its interval tree.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller id, or same
document and earlier place). All strings are judged on the input.

1. Each window of ``LENGTH`` bytes has an anchor: the leftmost of its ``SEED``-byte pieces with the least hash.
   Equal windows have equal anchors at the same place, and only the suffixes at anchors (3 % of all)
   are handled. Neighbouring windows of one anchor are one row: a place with the hash of all the bytes
   its windows span.
2. Rows are dealt by anchor. Of rows with equal anchors and equal spans, all but the first are
   repeats in whole. This is done per batch before the shuffle too, so a passage that very many
   documents share is sent once per batch.
3. The first rows of anchors that have several different spans are open: some of their windows may be
   repeats. Their documents give the spans' bytes, dealt by anchor. Each task sorts the suffixes at
   its anchors, takes the common prefixes of neighbours, and a stack scan gives the tree of
   common-prefix intervals. For each interval and each window that ends inside its prefix, the
   occurrences are divided by what stands left of the anchor (the test of left-extension
   diversity); each part with several occurrences is a repeat with all its occurrences, and all
   but the first of them go. Anchors with more than ``HOT_SPANS`` open rows are dealt by whole windows
   instead, with the same per-batch combination as in 2, so their work is spread.
4. Ranges are dealt by document and the bytes removed.

Texts are compressed for the two passes that bring them to their rows. A task holds one bucket's rows; there are as
many buckets as keep about ``BUCKET_BYTES`` of texts in each (the session's shuffle partitions at least), each a partition of its
own, so a task's memory doesn't grow with the input. Beside that it holds the span rows of one anchor, up to
``HOT_SPANS`` of them.

Defined cases: NULL text counts as empty and stays NULL where texts are returned; documents under
``LENGTH`` bytes lose nothing; a NULL id counts as the smallest; rows of one id with different texts are ordered
by their texts' hash; repeated rows (equal id and text) are one document, and each gets its result.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from riskspark.llm.common import materialize, pa_schema, worker_state
from riskspark.llm.shingles import PRIME, powers, scrambled

LENGTH, SEED = 100, 32
PIECES = LENGTH - SEED + 1  # anchor places in a window
BYTES_AT_ONCE = 1 << 17
BUCKET_BYTES = 4 << 20  # of texts to a bucket, on average
HOT_SPANS = 50_000
ROWS_AT_ONCE = 1 << 21  # of the expanded interval tree
NO_ID = -(1 << 63)
COVERED, CLASSES, OPEN, SPANS, WINDOWS, TEXT = range(6)  # kinds of rows
DDL = "kind int, bucket int, payload binary"
ROW_ID = ("doc", "mark", "home")  # id, hash of the text, bucket of the document
Columns = dict[str, np.ndarray]


# ---- hashes and anchors -------------------------------------------------------------------------


class Hashes:
    """Hashes of any substring of a byte array, by prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(PRIME, len(data)), out=self.sums[1:])
        self.shift = powers(pow(PRIME, -1, 1 << 64), len(data) + 1)

    def of(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return scrambled((self.sums[stop] - self.sums[first]) * self.shift[first])


def anchors(data: np.ndarray, ends: np.ndarray) -> Columns:
    """Rows (lo, hi, at, anchor, span) of some documents' bytes (``ends``: where each stops).

    Windows lo ... hi have their anchor ``at``; ``anchor`` and ``span`` are hashes."""
    n = len(data)
    if n < LENGTH:
        return {k: np.zeros(0, t) for k, t in (("lo", int), ("hi", int), ("at", int), ("anchor", np.uint64), ("span", np.uint64))}
    hashes = Hashes(data)
    value = scrambled((hashes.sums[SEED:] - hashes.sums[:-SEED]) * hashes.shift[: n - SEED + 1])
    seeds, place, width = value, np.arange(len(value), dtype=np.int32), 1
    while width < PIECES:  # least of twice as many places, leftmost among equals
        step = min(width, PIECES - width)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, value[step:], value[:-step])
        width += step
    inside = np.ones(n, bool)
    for end in ends.tolist():
        inside[max(0, end - LENGTH + 1) : end] = False
    window = np.flatnonzero(inside[: n - LENGTH + 1])
    place = place[window].astype(np.int64)
    new = np.r_[True, (np.diff(place) != 0) | (np.diff(window) != 1)] if len(window) else np.zeros(0, bool)
    lo, hi, at = window[new], window[np.r_[new[1:], True]] if len(window) else window, place[new]
    span = scrambled(hashes.of(lo, hi + LENGTH) ^ (at - lo).astype(np.uint64) << np.uint64(8) ^ (hi - lo).astype(np.uint64))
    return {"lo": lo, "hi": hi, "at": at, "anchor": seeds[at], "span": span}


def select(rows: Columns, which: np.ndarray) -> Columns:
    return {k: v[which] for k, v in rows.items()}


def joined(parts: list[Columns]) -> Columns:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


LATER, FIRST, SAME = 0, 1, 2


def occurrence(rows: Columns, keys: tuple[str, ...]) -> np.ndarray:
    """Per row: ``FIRST`` of its ``keys`` (by id, text hash, place), ``LATER``, or ``SAME`` as the first (a repeated document)."""
    by = [rows[k] for k in ("at", "mark", "doc")] + [rows[k] for k in reversed(keys)]
    order = np.lexsort(by)

    def change(names: tuple[str, ...]) -> np.ndarray:
        return np.r_[True, np.any([rows[k][order][1:] != rows[k][order][:-1] for k in names], axis=0)]

    new = change(keys)
    place = np.cumsum(change((*keys, "doc", "mark", "at")))
    heads = place[np.flatnonzero(new)][np.cumsum(new) - 1]
    state = np.empty(len(order), np.int8)
    state[order] = np.where(new, FIRST, np.where(place == heads, SAME, LATER))
    return state


def record(kind: int, bucket: int, rows: Columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([pickle.dumps(rows, 5)], pa.binary())], schema=schema)


def dealt(kind: int, rows: Columns, bucket: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One record per bucket with its rows."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket) != 0]) if len(bucket) else []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        yield record(kind, int(bucket[a]), select(rows, order[a:b]), schema)


def covered(rows: Columns, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Windows lo ... hi of each row as byte ranges for its document."""
    out = {k: rows[k] for k in ROW_ID} | {"first": rows["lo"], "stop": rows["hi"] + LENGTH}
    return dealt(COVERED, out, rows["home"], schema)


# ---- the steps ----------------------------------------------------------------------------------


def bytes_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer() or b"", np.uint8) if x.is_valid else np.zeros(0, np.uint8) for x in column]


def document_anchors(b: pa.RecordBatch) -> Columns:
    """Anchor rows of a batch of documents (places count from each document's start)."""
    ids = {k: b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ROW_ID}
    texts = bytes_of(b.column("text"))
    parts, some, size = [], [], 0

    def close() -> None:
        nonlocal some, size
        if some:
            ends = np.cumsum([len(t) for _, _, t in some])
            rows = anchors(np.concatenate([t for _, _, t in some]), ends)
            which = np.searchsorted(ends, rows["lo"], side="right")
            base = (np.array([start for _, start, _ in some]) - np.r_[0, ends[:-1]])[which]
            doc = np.array([i for i, _, _ in some])[which]
            for k in ("lo", "hi", "at"):
                rows[k] = rows[k] + base
            parts.append(rows | {k: v[doc] for k, v in ids.items()})
        some, size = [], 0

    for i, text in enumerate(texts):
        for start in range(0, max(0, len(text) - LENGTH + 1), BYTES_AT_ONCE):
            part = text[start : start + BYTES_AT_ONCE + LENGTH - 1]
            if size + len(part) > 2 * BYTES_AT_ONCE:
                close()
            some.append((i, start, part))
            size += len(part)
    close()
    return joined(parts)


def find_classes(buckets: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("repeats", dict)
        for b in batches:
            rows = document_anchors(b)
            if not rows:
                continue
            state = occurrence(rows, ("anchor", "span"))
            yield from covered(select(rows, state == LATER), schema)
            rows = select(rows, state == FIRST)
            yield from dealt(CLASSES, rows, (rows["anchor"] % np.uint64(buckets)).astype(np.int64), schema)

    return run


def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict]]:
    for b in batches:
        for kind, bucket, payload in zip(b.column("kind").to_pylist(), b.column("bucket").to_pylist(), b.column("payload")):
            yield kind, bucket, pickle.loads(payload.as_buffer())


def reduce_classes(hot_spans: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for kind, bucket, rows in payloads(batches):
            if kind == CLASSES:
                parts.append(rows)
            else:
                yield record(kind, bucket, rows, schema)
        rows = joined(parts)
        if not rows:
            return
        state = occurrence(rows, ("anchor", "span"))
        yield from covered(select(rows, state == LATER), schema)
        rows = select(rows, state == FIRST)
        rows = select(rows, np.argsort(rows["anchor"], kind="stable"))
        group = np.cumsum(np.r_[True, rows["anchor"][1:] != rows["anchor"][:-1]]) - 1
        spans = np.bincount(group)[group]
        rows["hot"] = spans > hot_spans
        rows = select(rows, spans > 1)
        yield from dealt(OPEN, rows, rows["home"], schema)

    return run


def by_document(work: Callable, schema: pa.Schema) -> Callable:
    """Run ``work(rows, texts)`` for each home bucket: its rows first, then the texts batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, parts, rows = None, [], None
        for b in batches:
            kinds, buckets = b.column("kind").to_numpy(), b.column("bucket").to_numpy()
            edge = np.flatnonzero(np.r_[True, (np.diff(buckets) != 0) | (np.diff(kinds == TEXT) != 0), True]) if len(kinds) else np.zeros(1, int)
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if buckets[i] != home:
                    home, parts, rows = buckets[i], [], None
                part = b.slice(i, j - i)
                if kinds[i] != TEXT:
                    parts += [pickle.loads(x.as_buffer()) for x in part.column("payload")]
                    continue
                if rows is None:
                    rows = joined(parts)
                    if rows:
                        rows = select(rows, np.lexsort((rows["mark"], rows["doc"])))
                yield from work(rows, part)

    return run


def rows_of(rows: Columns, doc: int, mark: int) -> slice:
    """Rows of one document, among rows sorted by (doc, mark)."""
    if not rows:
        return slice(0, 0)
    a, b = np.searchsorted(rows["doc"], doc), np.searchsorted(rows["doc"], doc, side="right")
    part = rows["mark"][a:b]
    return slice(a + int(np.searchsorted(part, mark)), a + int(np.searchsorted(part, mark, side="right")))


def unpacked(part: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    for doc, mark, packed in zip(part.column("doc").to_pylist(), part.column("mark").to_pylist(), part.column("payload").to_pylist()):
        yield doc, mark, zlib.decompress(packed)


def open_spans(buckets: int, schema: pa.Schema) -> Callable:
    """The bytes of open rows, dealt by anchor; of hot anchors, the hashes of their windows."""

    def work(rows: Columns, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spans, windows, done = [], [], set()
        for doc, mark, text in unpacked(part):
            own = rows_of(rows, doc, mark)
            if own.start == own.stop or (doc, mark) in done:  # a repeated row brings nothing new
                continue
            done.add((doc, mark))
            mine = {k: v[own] for k, v in rows.items()}
            data = np.frombuffer(text, np.uint8)
            cold = select(mine, ~mine["hot"])
            if len(cold["lo"]):
                cold["text"] = np.array([text[a : b + LENGTH] for a, b in zip(cold["lo"].tolist(), cold["hi"].tolist())], object)
                spans.append(cold)
            if mine["hot"].any():
                hot = select(mine, mine["hot"])
                times = hot["hi"] - hot["lo"] + 1
                each = {k: np.repeat(hot[k], times) for k in (*ROW_ID, "anchor", "lo", "at")}
                each["lo"] = each["lo"] + np.arange(len(each["lo"])) - np.repeat(np.cumsum(times) - times, times)
                each["left"] = each["at"] - each["lo"]
                each["at"] = each["hi"] = each["lo"]
                each["window"] = Hashes(data).of(each["lo"], each["lo"] + LENGTH)
                windows.append(each)
        if spans:
            found = joined(spans)
            yield from dealt(SPANS, found, (found["anchor"] % np.uint64(buckets)).astype(np.int64), schema)
        if windows:
            found = joined(windows)
            state = occurrence(found, ("anchor", "left", "window"))
            yield from covered(select(found, state == LATER), schema)
            found = select(found, state == FIRST)
            yield from dealt(WINDOWS, found, (found["window"] % np.uint64(buckets)).astype(np.int64), schema)

    return by_document(work, schema)


def prefix_intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Nodes (first, last, prefix, parent's prefix) of the common-prefix interval tree, by a stack scan.

    ``common[i]`` is the common prefix of suffixes i and i + 1; nodes with a prefix under ``least`` are left out."""
    nodes, stack = [], [(0, 0)]  # (prefix, first)
    for i, here in enumerate([*common.tolist(), 0]):
        first = i
        while stack[-1][0] > here:
            prefix, first = stack.pop()
            above = max(here, stack[-1][0])
            if prefix >= least:
                nodes.append((first, i, prefix, above))
        if stack[-1][0] < here:
            stack.append((here, first))
    return nodes


def repeated_windows(rows: Columns) -> Columns:
    """Windows (lo = hi) of open rows that also start earlier."""
    rows = select(rows, occurrence(rows, ("doc", "mark", "at")) == FIRST)  # one row of a repeated document
    n = len(rows["at"])
    texts = rows["text"].tolist()
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    left = rows["at"] - rows["lo"]  # bytes at hand left of the anchor
    right = sizes - left  # and from the anchor on, at most LENGTH
    # suffixes at the anchors, behind the seed; 0 stands for the end of what is at hand
    tail = np.zeros((n, LENGTH - SEED), np.uint16)
    where = np.arange(LENGTH - SEED)[None, :]
    inside = where < (right - SEED)[:, None]
    tail[inside] = data[((begin + left + SEED)[:, None] + where)[inside]].astype(np.uint16) + 1
    order = np.lexsort((tail.astype(">u2").view(f"S{2 * (LENGTH - SEED)}").ravel(), rows["anchor"]))
    same = tail[order][1:] == tail[order][:-1]
    common = SEED + np.where(same.all(axis=1), LENGTH - SEED, same.argmin(axis=1))
    common = np.minimum(common, np.minimum(right[order][1:], right[order][:-1]))
    common = np.where(rows["anchor"][order][1:] == rows["anchor"][order][:-1], common, 0)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((rows["at"], rows["mark"], rows["doc"]))] = np.arange(n)
    hashes = Hashes(data)
    found = []

    def divide(nodes: np.ndarray) -> None:
        """One row for each (member, right length) of some nodes (first, last, prefix, parent's prefix, number)."""
        times = (nodes[:, 1] - nodes[:, 0] + 1) * (nodes[:, 2] - nodes[:, 3])
        node = np.repeat(np.arange(len(nodes)), times)
        k = np.arange(len(node)) - np.repeat(np.cumsum(times) - times, times)
        members = nodes[node, 1] - nodes[node, 0] + 1
        row = order[nodes[node, 0] + k % members]
        before = LENGTH - (nodes[node, 3] + 1 + k // members)  # bytes of the window left of the anchor
        usable = before <= left[row]
        node, row, before = node[usable], row[usable], before[usable]
        if not len(node):
            return
        middle = begin[row] + left[row]
        beside = hashes.of(middle - before, middle)
        by = np.lexsort((rank[row], beside, before, node))
        node, row, before, beside = node[by], row[by], before[by], beside[by]
        again = np.r_[False, (node[1:] == node[:-1]) & (before[1:] == before[:-1]) & (beside[1:] == beside[:-1])]
        found.append(np.stack([row[again], (rows["at"][row] - before)[again]]))

    nodes = prefix_intervals(common, SEED)
    pending, size = [], 0
    for first, last, prefix, above in nodes:
        for top in range(prefix, max(above, SEED - 1), -1):  # split by right length, so that a part stays small
            pending.append((first, last, top, top - 1))
            size += last - first + 1
            if size > ROWS_AT_ONCE:
                divide(np.array(pending))
                pending, size = [], 0
    if pending:
        divide(np.array(pending))
    row, lo = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return {k: rows[k][row] for k in ROW_ID} | {"lo": lo, "hi": lo}


def merged(rows: Columns) -> Columns:
    """Neighbouring windows of one document as one row."""
    order = np.lexsort((rows["lo"], rows["mark"], rows["doc"]))
    rows = select(rows, order)
    if not len(order):
        return rows
    new = np.r_[True, (np.diff(rows["doc"]) != 0) | (np.diff(rows["mark"]) != 0) | (np.diff(rows["lo"]) > 1)]
    last = np.r_[new[1:], True]
    return {k: rows[k][new] for k in (*ROW_ID, "lo")} | {"hi": rows["hi"][last]}


def resolve_open(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, windows = [], []
        for kind, bucket, rows in payloads(batches):
            if kind == SPANS:
                spans.append(rows)
            elif kind == WINDOWS:
                windows.append(rows)
            else:
                yield record(kind, bucket, rows, schema)
        if spans:
            yield from covered(merged(repeated_windows(joined(spans))), schema)
        if windows:
            rows = joined(windows)
            yield from covered(merged(select(rows, occurrence(rows, ("anchor", "left", "window")) == LATER)), schema)

    return run


def removed_ranges(size: int, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs (first, stop)."""
    if not len(first):
        return first, stop
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(stop[order])
    new = np.r_[True, first[1:] > stop[:-1]]
    return first[new], np.minimum(stop[np.r_[new[1:], True]], size)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "repeats", as_text: bool = False, hot_spans: int = HOT_SPANS,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` but the text, then (n_bytes, spans, kept): size, removed runs, remaining bytes.

    With ``as_text`` the last is a string: a character of which only a part is left goes whole, and
    NULL texts are NULL again. A column of ``docs`` with one of these names gives way."""
    spark = docs.sparkSession
    schema = pa_schema(spark, DDL)
    weight = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weight // bucket_bytes))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    names = [c for c in docs.columns if c not in (text_col, "n_bytes", "spans", "kept")]
    others = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in names])  # never an empty struct
    rest = F.struct(F.col(text_col).isNull().alias("no_text"), others.alias("others"))
    rows = docs.select(doc.alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"), rest.alias("rest"))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("doc", "mark"), F.lit(buckets)).cast("int"))

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartitionById(buckets, F.col("bucket").cast("int"))

    classes = by_bucket(rows.select(*ROW_ID, "text").mapInArrow(find_classes(buckets, schema), DDL)).mapInArrow(reduce_classes(hot_spans, schema), DDL)
    classes = materialize(classes, f"{label}-classes")

    def beside_texts(parts: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
        """Rows of ``parts`` and compressed texts of ``source``, by home bucket, the texts last."""
        form = StructType([*StructType.fromDDL("doc long, mark long, bucket int, payload binary"), *(source.schema[c] for c in columns)])
        out = to_arrow_schema(form)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                packed = [zlib.compress(x, 1) for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("mark"), b.column("home"), pa.array(packed, pa.binary()), *(b.column(c) for c in columns)], schema=out)

        texts = source.mapInArrow(pack, form).withColumn("kind", F.lit(TEXT))
        whole = parts.unionByName(texts, allowMissingColumns=True)
        return by_bucket(whole).sortWithinPartitions("bucket", "kind")

    opened = beside_texts(classes.where(F.col("kind") == OPEN), rows.select(*ROW_ID, "text").where(F.octet_length("text") >= LENGTH), [])
    opened = by_bucket(opened.mapInArrow(open_spans(buckets, schema), DDL)).mapInArrow(resolve_open(schema), DDL)
    opened = materialize(opened, f"{label}-open")
    ranges = classes.where(F.col("kind") == COVERED).union(opened)

    kind = rows.schema["rest"].dataType
    form = StructType([StructField("rest", kind), *StructType.fromDDL(f"n_bytes long, spans array<struct<first:bigint,stop:bigint>>, kept {'string' if as_text else 'binary'}")])
    result = to_arrow_schema(form)

    def cut(found: Columns, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, spans, kept = [], [], []
        for doc, mark, text in unpacked(part):
            own = rows_of(found, doc, mark)
            a, b = removed_ranges(len(text), found["first"][own], found["stop"][own]) if own.start < own.stop else ([], [])
            sizes.append(len(text))
            spans.append([{"first": int(x), "stop": int(y)} for x, y in zip(a, b)])
            left = b"".join(text[int(x) : int(y)] for x, y in zip([0, *b], [*a, len(text)]))
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
        yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(sizes, pa.int64()), pa.array(spans, result.field("spans").type), pa.array(kept, result.field("kept").type)], schema=result)

    found = beside_texts(ranges, rows, ["rest"]).mapInArrow(by_document(cut, result), form)
    kept = F.when(~F.col("rest.no_text"), F.col("kept")).alias("kept") if as_text else F.col("kept")
    return found.select(*[F.col(f"rest.others.`{c}`").alias(c) for c in names], "n_bytes", "spans", kept)
