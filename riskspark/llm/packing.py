"""Best-fit packing of token pieces into fixed-size sequences by a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` rows) reaches the driver:

1. The configuration LP over the histogram (fewest sequences that cover every length's count) is solved by
   multiplicative weights. A round prices a length by itself times a weight that falls exponentially with the share of its
   count that is covered, and solves the unbounded knapsack over the capacity by dynamic programming. From
   that one table every length that lags gets its best configuration and takes as much of it as it lacks,
   unless another length in it would run more than ``SLACK`` ahead. Rounds go on until every length is
   covered; prices scaled by the best configuration's value bound the LP from below.
2. Configurations are taken in whole multiples, the most used first, then once more while the counts
   last: most tokens go by configurations. What is left is placed by best-fit decreasing over groups
   of equal sequences, so the work depends on the number of distinct lengths and never on the number of documents.
   Configurations that leave room or hold many short pieces may be better left to best fit: of a few such
   limits (``ROUNDINGS``) the one with the fewest sequences is taken, the widest on ties.
3. Every piece gets its dense rank among the pieces of its length. Each length is split into salted
   groups of about ``GROUP_ROWS`` rows, so that a length held by a third of all rows is ranked in
   many tasks. (length, rank) then gives the sequence and the offset: a lookup in the plan, whose
   size is bounded by the capacity.

Ids are those of the vocabulary's tokenizer: its added tokens are split off first, the rest is encoded by
the library tiktoken; where its pattern engine gives up (a run of a million blanks) the byte-pair codec of ``bpe``
takes over.

Defined cases: NULL text counts as empty; an empty document is one piece that holds the end id only;
documents with equal or NULL ids and repeated rows stay separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.bpe import BpeCodec
from riskspark.llm.common import map_rows, materialize, pa_schema, worker_state

GROUP_ROWS = 20_000  # rows ranked together
STEPS = 20  # the goal that all lengths follow grows by 1 / STEPS of their counts a round, up to the whole
SLACK = 0.01  # share of its count that a length may be covered beyond the goal
ROUNDINGS = ((1.0, 1 << 30), (0.01, 8), (0.002, 8), (0.0, 8))  # configurations that are rounded: most room left (share), most pieces
ETA = 1.0  # how fast a length loses weight with its cover


class PieceEncoder:
    """Ids of whole texts, ``added`` tokens (text to id) among them."""

    def __init__(self, rank_path: str, pattern: str, added: dict[str, int]) -> None:
        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.rank_path, self.pattern, self.added = rank_path, pattern, added
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.other: BpeCodec | None = None

    def encode(self, text: str | None) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text or "", allowed_special="all")
        except ValueError:  # the pattern engine's stack: runs of blanks too long for it
            if self.other is None:
                self.other = BpeCodec(self.rank_path, self.pattern)
            parts = re.split("(" + "|".join(map(re.escape, self.added)) + ")", text) if self.added else [text]
            return np.array([i for p in parts for i in ([self.added[p]] if p in self.added else self.other.encode(p))], np.uint32)


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Added tokens of a tokenizer file."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return {t["content"]: int(t["id"]) for t in json.load(f)["added_tokens"]}


def token_pieces(docs: DataFrame, rank_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                 added: dict[str, int] | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` ids: (id, piece, start, length, ids_crc32).

    A document is its ids and ``end_id``. A longer one is cut into full pieces after a first piece
    that takes the remainder."""
    special = dict(added or {})

    def batch(cols: dict[str, list]) -> dict[str, list]:
        encoder = worker_state(f"pieces {rank_path} {pattern} {sorted(special.items())}", lambda: PieceEncoder(rank_path, pattern, special))
        out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32")}
        for doc, text in zip(cols["id"], cols["text"]):
            view = memoryview(np.append(encoder.encode(text), np.uint32(end_id)).astype("<u4").tobytes())
            n = len(view) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                out["id"].append(doc)
                out["piece"].append(k)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(view[4 * a : 4 * b]))
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(pairs, batch, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


class PriceTable:
    """Unbounded knapsack over the capacity: ``best[c]`` is the most that prices give in c tokens. Of equal values the one
    that ends with the longest piece is taken."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, capacity: int) -> None:
        self.lengths, self.capacity = lengths.tolist(), capacity
        self.best, self.last = np.zeros(capacity + 1), [-1] * (capacity + 1)  # last: piece put in; -1 for an empty token
        usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
        for c in range(1, capacity + 1):
            self.best[c] = self.best[c - 1]
            if k := usable[c]:
                values = self.best[c - lengths[:k]] + prices[:k]
                j = k - 1 - int(values[::-1].argmax())
                if values[j] > self.best[c]:
                    self.best[c], self.last[c] = values[j], j

    def configuration(self, j: int) -> list[int]:
        """The most valuable pieces (by place) beside one of length j."""
        out, c = [j], self.capacity - self.lengths[j]
        while c > 0:
            if self.last[c] < 0:
                c -= 1
            else:
                out.append(self.last[c])
                c -= self.lengths[self.last[c]]
        return out


def fractional_cover(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[dict[tuple[int, ...], float], float]:
    """(multiplicity of each configuration, lower bound of the LP): every length is covered by its count. A length that lags keeps
    its price while the others' fall; at most ``STEPS`` rounds and two a distinct length."""
    covered, cover = np.zeros(len(lengths)), defaultdict(float)
    bound = float((lengths * counts).sum()) / capacity
    for step in range(1, STEPS + 2 * len(lengths) + 1):
        if covered.min() >= 1 - 1e-9:
            break
        goal = min(1.0, step / STEPS)
        prices = lengths * np.exp(-ETA * (covered - goal)) * (covered < goal + SLACK - 1e-9)
        table = PriceTable(lengths, prices, capacity)
        bound = max(bound, float((counts * prices).sum() / table.best[capacity]))
        for j in range(len(lengths) - 1, -1, -1):  # the longest first, while what goes with them is there
            if covered[j] >= goal - 1e-9:
                continue
            pieces = table.configuration(j)
            used, copies = np.unique(pieces, return_counts=True)
            lacking = (goal - covered[j]) * counts[j] / copies[np.searchsorted(used, j)]
            times = min(lacking, float(((goal + SLACK - covered[used]) * counts[used] / copies).min()))
            if times > 0:
                covered[used] += times * copies / counts[used]
                cover[tuple(pieces)] += times
    return dict(cover), bound


def whole_configurations(cover: dict[tuple[int, ...], float], lengths: np.ndarray, rest: np.ndarray) -> list[tuple[int, list[int]]]:
    """Groups of sequences by configurations, rounded: whole multiples, the most used first, then one more of each while the counts
    last. ``rest`` (counts) is reduced by what they hold."""
    taken: dict[tuple[int, ...], int] = defaultdict(int)
    order = sorted(cover, key=lambda c: (-cover[c], c))
    for once_more in (False, True, True):
        for pieces in order:
            used, copies = np.unique(pieces, return_counts=True)
            times = min(1 if once_more else int(cover[pieces]), int((rest[used] // copies).min()))
            if times > 0:
                rest[used] -= times * copies
                taken[pieces] += times
    return [(times, sorted((int(lengths[j]) for j in pieces), reverse=True)) for pieces, times in taken.items()]


def best_fit_rest(lengths: list[int], counts: list[int], capacity: int, open_groups: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """Place ``counts`` pieces, longest first, each into the fullest sequences with room.

    Sequences with equal content are one group (count, piece lengths); a group is split when only
    some of its sequences get a piece."""
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for count, items in open_groups:
        by_room[capacity - sum(items)].append((count, items))
    rooms = sorted(by_room)
    closed = by_room.pop(0, [])
    rooms = [r for r in rooms if r]
    for length, left in sorted(zip(lengths, counts), reverse=True):
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, odd = divmod(left, each)
                new = [(full, [length] * each)] * bool(full) + [(1, [length] * odd)] * bool(odd)
                left = 0
            else:
                room = rooms[at]
                count, items = by_room[room].pop()
                put = min(count, left)
                if put < count:
                    by_room[room].append((count - put, items))
                elif not by_room[room]:
                    del by_room[room], rooms[at]
                new = [(put, [*items, length])]
                left -= put
            for count, items in new:
                room = capacity - sum(items)
                if not room:
                    closed.append((count, items))
                    continue
                if room not in by_room:
                    insort(rooms, room)
                by_room[room].append((count, items))
    return closed + [g for groups in by_room.values() for g in groups]


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Groups (number of equal sequences, lengths of their pieces) that hold the whole histogram."""
    left = {int(k): int(v) for k, v in histogram.items() if v}
    groups = [(left.pop(capacity), [capacity])] if capacity in left else []
    if not left:
        return groups
    lengths = np.array(sorted(left), np.int64)
    rest = np.array([left[k] for k in lengths.tolist()], np.int64)
    cover, _ = fractional_cover(lengths, rest.astype(float), capacity)
    best: list[tuple[int, list[int]]] | None = None
    for waste, pieces in ROUNDINGS:
        some = {c: t for c, t in cover.items() if capacity - int(lengths[list(c)].sum()) <= waste * capacity and len(c) <= pieces}
        odd = rest.copy()
        held = whole_configurations(some, lengths, odd)
        plan = best_fit_rest(lengths.tolist(), odd.tolist(), capacity, groups + held)
        if best is None or sum(n for n, _ in plan) < sum(n for n, _ in best):
            best = plan
    return best


def plan_runs(groups: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Runs of ranks: the pieces of ``length`` from ``rank`` on go to one sequence each, at ``offset``."""
    runs, used, sequence = [], defaultdict(int), 0
    for count, items in groups:
        offset = 0
        for length in items:
            runs.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def rank_within_length(pieces: DataFrame, histogram: dict[int, int], order: list[str]) -> DataFrame:
    """Add ``rank``: dense from 0 among the rows of each length."""
    spark = pieces.sparkSession
    salts = spark.createDataFrame([(int(k), -(-int(v) // GROUP_ROWS)) for k, v in histogram.items()] or [(0, 1)], "length long, _salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64(*order), "_salts")).drop("_salts")
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_salt").orderBy(*order)
    ranked = salted.withColumn("_row", F.row_number().over(own)).join(sizes, ["length", "_salt"])
    return ranked.withColumn("rank", F.col("_base") + F.col("_row") - 1).drop("_salt", "_row", "_base")


def pack(pieces: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``token_pieces`` (read twice: pass a stored table)."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan_runs(plan_sequences(histogram, capacity))
    ranked = rank_within_length(pieces, histogram, [id_col, "piece", "start", "ids_crc32"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    out = pa_schema(pieces.sparkSession, schema)
    keys = runs["length"] << 44 | runs["rank"] if len(runs["length"]) else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(keys, b.column("length").to_numpy() << 44 | rank, side="right") - 1
            placed = [pa.array(runs["sequence"][at] + rank - runs["rank"][at]), pa.array(runs["offset"][at])]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in list(out)[:-2]] + placed, schema=out)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, rank_path: str, pattern: str, capacity: int = 2048, label: str = "pieces", added: dict[str, int] | None = None) -> DataFrame:
    """Tokenise, store the narrow piece table once, and pack it."""
    return pack(materialize(token_pieces(docs, rank_path, pattern, capacity, added=added), label), capacity)
