"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte runs. Every neighbouring pair whose joined bytes are a
vocabulary entry waits under that entry's merge rank. The queue is a two-level bitmap: a summary
word marks the blocks of 256 ranks in which anything waits, and find-first-set gives the lowest one.
Entries that an earlier merge has changed are recognised by the rank remembered per position and
skipped.

* ``merge`` (pre-tokens of more than ``LONG_BYTES``) keeps one bucket, a heap of positions, per
  rank and a second bitmap inside the block: find-first-set twice, then the leftmost position.
  n bytes take O(n log n) steps, however long the pre-token.
* ``merge_many`` lays thousands of short pre-tokens in one buffer and advances them together: each
  pre-token takes, from the lowest block, its own lowest rank and leftmost position. Pre-tokens
  don't touch, so every one sees exactly the order of ``merge``.

Texts are cut at single spaces between two non-blank characters, where no match of the split
pattern can cross, and each distinct cut is encoded once per Python worker (memos of bounded size).

Defined cases: NULL text counts as empty; the empty text has no ids and decodes to no bytes; very long texts and
pre-tokens are encoded whole; NULL and repeated ids and repeated rows stay separate rows with results of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterable
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import groups_of, map_rows, worker_state

WORD_BITS = 8  # ranks per block of the bitmap: 2 ** WORD_BITS
WORD_MASK = (1 << WORD_BITS) - 1
LONG_BYTES = 64  # longer pre-tokens are merged one by one
TOGETHER = 1 << 16  # pre-tokens merged together at most
CHARS_AT_ONCE = 1 << 22  # of the texts that are cut together (one text at least)
MEMO_CUTS, MEMO_TOKENS = 3 << 17, 1 << 17  # entries of one generation of a worker's memos
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
BLANK_AFTER, BLANK_BEFORE = re.compile(r" \s"), re.compile(r"[^\S ] ")


class Memo:
    """A bounded memo in two generations: a full one becomes the old one, whose entries return when used."""

    def __init__(self, most: int) -> None:
        self.most, self.now, self.old = most, {}, {}

    def missing(self, keys: set[str]) -> set[str]:
        """Those of some keys outside the young generation that aren't in the old one either."""
        back = self.old.keys() & keys
        self.now.update((k, self.old[k]) for k in back)
        return keys - back

    def turn(self) -> None:
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now


class BpeCodec:
    """Encoder and decoder over a rank file (base64 bytes and rank a line) and a split pattern."""

    def __init__(self, rank_path: str, pattern: str) -> None:
        with open(rank_path, "rb") as lines:
            self.ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}
        self.split = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.decimals = [str(rank) for rank in range(len(self.bytes_of))]
        self.words = [0] * ((len(self.bytes_of) >> WORD_BITS) + 1)
        pairs = {}
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                left, right = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs) or [-1], np.int64)
        self.pair_ranks = np.array([pairs.get(k, -1) for k in self.pair_keys.tolist()], np.int64)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.tokens, self.spaced = Memo(MEMO_TOKENS), Memo(MEMO_CUTS)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, -1 where it isn't in the vocabulary."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        The queue's parts are local names here: ``buckets`` (rank -> heap of positions), ``words``
        (bitmaps of non-empty buckets) and ``summary`` (bitmap of non-zero words)."""
        rank_of, n = self.ranks.get, len(piece)
        after = list(range(1, n + 2))  # start of the next run; n ends the list
        before = list(range(-1, n))
        waiting = [-1] * (n + 1)  # rank under which the pair that starts here waits
        buckets: dict[int, list[int]] = {}
        words, summary = self.words, 0
        added = [(rank_of(piece[i : i + 2]), i) for i in range(n - 1)]
        while True:
            for rank, i in added:
                if rank is None:
                    waiting[i] = -1
                elif waiting[i] != rank:
                    waiting[i] = rank
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        words[rank >> WORD_BITS] |= 1 << (rank & WORD_MASK)
                        summary |= 1 << (rank >> WORD_BITS)
            if not summary:
                break
            word = (summary & -summary).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word << WORD_BITS | low.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[word] = bits ^ low
                if bits == low:
                    summary &= summary - 1
            added = []
            if waiting[i] == rank:
                gone = after[i]
                end = after[i] = after[gone]
                waiting[gone] = waiting[i] = -1
                if end < n:
                    before[end] = i
                    added.append((rank_of(piece[i : after[end]]), i))
                if i:
                    left = before[i]
                    added.append((rank_of(piece[left:end]), left))
        ids, i = [], 0
        while i < n:
            ids.append(rank_of(piece[i : after[i]]))
            i = after[i]
        return ids

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (unsigned 32-bit bytes) of each of many short, non-empty pre-tokens."""
        if not pieces:
            return []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        ends = np.cumsum(lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        waiting = np.full(n, -1, np.int64)
        starts = np.flatnonzero(after >= 0)
        waiting[starts] = self.joined(ids[starts], ids[starts + 1])
        alive = np.ones(n, bool)
        blocks: dict[int, list[np.ndarray]] = {}
        summary = 0
        added = starts
        while True:
            added = added[waiting[added] >= 0]
            if len(added):
                block = waiting[added] >> WORD_BITS
                order = np.argsort(block, kind="stable")
                added, block = added[order], block[order]
                cuts = np.flatnonzero(np.diff(block)) + 1
                for word, part in zip(block[np.r_[0, cuts]].tolist(), np.split(added, cuts), strict=True):
                    blocks.setdefault(word, []).append(part)
                    summary |= 1 << word
            if not summary:
                break
            word = (summary & -summary).bit_length() - 1
            at = np.concatenate(blocks.pop(word))
            summary &= summary - 1
            at = at[waiting[at] >> WORD_BITS == word]  # what stays behind is stale
            if not len(at):
                added = at
                continue
            key = np.sort(owner[at] << 40 | (waiting[at] & WORD_MASK) << 32 | at)
            first = np.r_[True, np.diff(key >> 40) > 0]
            at = key & 0xFFFFFFFF
            if not first.all():
                blocks[word] = [at[~first]]
                summary |= 1 << word
            at = at[first]  # one pair of each pre-token
            gone = after[at]
            end = after[gone]
            ids[at] = waiting[at]
            alive[gone] = False
            waiting[gone] = waiting[at] = -1
            after[at] = end
            right = end >= 0
            before[end[right]] = at[right]
            waiting[at[right]] = self.joined(ids[at[right]], ids[end[right]])
            left = before[at]
            at_left = at[left >= 0]
            left = left[left >= 0]
            waiting[left] = self.joined(ids[left], ids[at_left])
            added = np.concatenate([at[right], left])
        found = ids[alive].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(owner[alive], minlength=len(pieces)))).tolist()
        return [found[a:b] for a, b in zip([0, *stops], stops)]

    def learn(self, cuts: set[str]) -> dict[str, bytes]:
        """Ids (unsigned 32-bit bytes) of each cut; new pre-tokens are merged together."""
        # a blank and ASCII letters are one match of the pattern
        found = {cut: (cut,) if (body := cut[cut[:1] == " " :]).isascii() and body.isalpha() else self.split.findall(cut) for cut in cuts}
        self.tokens.turn()
        tokens = self.tokens.now
        short = []
        for token in self.tokens.missing(set(chain.from_iterable(found.values())).difference(tokens)):
            piece = token.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(piece)
            if whole is not None:
                tokens[token] = array("I", [whole]).tobytes()
            elif len(piece) > LONG_BYTES:
                tokens[token] = array("I", self.merge(piece)).tobytes()
            else:
                short.append((token, piece))
        for i in range(0, len(short), TOGETHER):
            part = short[i : i + TOGETHER]
            tokens.update(zip((t for t, _ in part), self.merge_many([p for _, p in part])))
        return {cut: b"".join(map(tokens.__getitem__, parts)) for cut, parts in found.items()}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, each as unsigned 32-bit bytes."""
        out: list[bytes] = []
        gc.disable()  # very many short lists and no cycles
        try:
            for i, j in groups_of(texts, len(texts), CHARS_AT_ONCE):
                out += self._encode_together(texts[i:j])
        finally:
            gc.enable()
        return out

    def _encode_together(self, texts: list[str | None]) -> list[bytes]:
        cuts = []
        for text in texts:
            if not text:
                cuts.append([""])
            elif text[0] == " " or text[-1] == " " or BLANK_AFTER.search(text) or BLANK_BEFORE.search(text):
                cuts.append(SAFE_SPACE.split(text))
            else:
                cuts.append(text.split(" "))
        self.spaced.turn()
        spaced, first = self.spaced.now, [c.pop(0) for c in cuts]
        parts = [list(map(spaced.get, c)) for c in cuts]
        lacking = [i for i, p in enumerate(parts) if None in p]
        new = self.spaced.missing({cut for i in lacking for cut, ids in zip(cuts[i], parts[i]) if ids is None})
        got = self.learn({" " + cut for cut in new}.union(first))
        spaced.update((cut, got[" " + cut]) for cut in new)
        for i in lacking:
            parts[i] = map(spaced.__getitem__, cuts[i])
        return [got[head] + b"".join(rest) for head, rest in zip(first, parts)]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decimal(self, ids: Iterable[int]) -> bytes:
        """The ids in decimal, joined by one space."""
        return " ".join(map(self.decimals.__getitem__, ids)).encode()


def codec(rank_path: str, pattern: str) -> BpeCodec:
    """The worker's codec."""
    return worker_state(f"bpe {rank_path} {pattern}", lambda: BpeCodec(rank_path, pattern))


OUTPUTS = {
    "n_tokens": ("long", lambda ids, decoded, c: len(ids)),
    "ids": ("array<int>", lambda ids, decoded, c: ids),
    "decoded": ("binary", lambda ids, decoded, c: decoded),
    "ids_sha256": ("string", lambda ids, decoded, c: hashlib.sha256(c.decimal(ids)).hexdigest()),
    "decoded_sha256": ("string", lambda ids, decoded, c: hashlib.sha256(decoded).hexdigest()),
}


def round_trip(
    docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """Encode every text, decode the ids again and return ``id_col`` with the asked ``OUTPUTS``.

    One narrow pass without a shuffle; other columns of ``docs`` are not read."""

    def batch(cols: dict[str, list]) -> dict[str, list]:
        c = codec(rank_path, pattern)
        out: dict[str, list] = {"id": cols["id"], **{name: [] for name in outputs}}
        for raw in c.encode_batch(cols["text"]):
            ids = np.frombuffer(raw, "<u4").tolist()
            decoded = c.decode(ids)
            for name in outputs:
                out[name].append(OUTPUTS[name][1](ids, decoded, c))
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{name} {OUTPUTS[name][0]}" for name in outputs)])
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(pairs, batch, schema).withColumnRenamed("id", id_col)
