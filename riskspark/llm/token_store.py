"""Token ids in binary files: one zstandard frame a document, compressed with a dictionary that all share.

File format, little-endian, one file a partition of the ascending document order::

    "TOKZ", version u32, id width u32 (2 or 4 bytes), SHA-256 of the dictionary     header
    frames, one a document                                                          its ids, compressed alone
    frame offset u64, first id's place u64, key length u32, key                     index, one entry a document
    index offset u64, documents u64, ids u64, "TOKZ"                                footer

Any document is read with the index and one frame (``read_documents`` with ``keys``); small documents still
compress well, since the dictionary, trained once on serialised id arrays, holds what they have in common.
The dictionary lies beside the files under its own hash, and a reader refuses one that differs.

Texts are dealt to ranges of the document order first, so that encoding runs once, and each task encodes,
compresses and writes its range as one stream. A task writes under a name of its own and renames the file when
it is whole: a repeated task puts the same content under the same name. The driver sees one row a file. Places that count
over all documents (``start``) are the files' id counts summed in order, plus the place in the file.

Defined cases: NULL text counts as empty (the end id alone); documents are ordered by id, NULL ids first,
equal ids by their text's hash; equal rows stay separate documents, and an id that many rows share is spread
over files. A very long text is encoded in parts that end at blanks. An empty table gives no documents. Other columns are ignored.

Parameters that bound something: the dictionary is trained on ``SAMPLE_DOCS`` documents at most (those with
the least hash of id and text), the first ``SAMPLE_IDS`` ids of each; it affects sizes, never ids.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskspark.llm.common import materialize, pa_schema, worker_state
from riskspark.session import checkpoint_path

SAMPLE_DOCS = 1_000
SAMPLE_IDS = 8_192
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
MAGIC, VERSION = b"TOKZ", 1
HEADER, ENTRY, FOOTER = struct.Struct("<4sII32s"), struct.Struct("<QQI"), struct.Struct("<QQQ4s")
NO_KEY = (1 << 32) - 1  # key length of a NULL id
BATCH_BYTES = 8 << 20  # ids read at once
WHOLE_TEXTS = r"<\||[\x{0300}-\x{036f}]"  # special tokens; marks that may join an ASCII letter or mark
LETTER_MARK = "([a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af])([!-&(-/:-@\\[-`{-~])"  # Latin; not the apostrophe, which may belong to letters
MEMO_WORDS, MEMO_CHARS = 800_000, 40  # words kept in a worker at most, and the longest of them
BYTES_AT_ONCE, PART_CHARS = 8 << 20, 1 << 20  # of texts handled together, of a longer text's parts


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space and never joins across it.

    Texts of a few megabytes are taken together: ASCII letters in lower case (the tokenizer does so too), a blank put
    between a letter or digit and an ASCII mark (it cuts there in any case), then cut at blanks and numbered by distinct
    word, all by Arrow. Each distinct word's serialised ids are kept; new ones go to the library
    together, words of letters joined by blanks, their ids parted again at the ids that end a word. The
    texts' ids are then gathered by word number. Texts with special tokens or combining marks go to the library whole."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends_word = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends_word[i] = bool(suffix) and token.endswith(suffix)
        self.memo: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters: each has one word end, or else all go one by one."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return self._whole(words)
        raw, cuts = ids.tobytes(), (stops * self.kind.itemsize).tolist()
        return [raw[i:j] for i, j in zip([0, *cuts], cuts)]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; those of short ones are kept."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        known = list(map(self.memo.get, words))
        fresh = [w for w, ids in zip(words, known) if ids is None]
        if not fresh:
            return known
        letters = [w for w in fresh if w.isalpha()]
        others = [w for w in fresh if not w.isalpha()]
        found = dict(zip(letters, self._letters(letters)))
        found.update(zip(others, self._whole(others)))
        self.memo.update(found if max(map(len, fresh)) <= MEMO_CHARS else {w: i for w, i in found.items() if len(w) <= MEMO_CHARS})
        return [found[w] if ids is None else ids for w, ids in zip(words, known)]

    def _some(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of a few megabytes of texts."""
        whole = pc.match_substring_regex(texts, WHOLE_TEXTS).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(plain), LETTER_MARK, r"\1 \2"))
        numbered = pc.dictionary_encode(split.flatten())
        words = numbered.dictionary.to_pylist()
        if "" in words:  # the split leaves empty words at the ends
            self.memo[""] = b""
        ids = pa.array(self._ids_of(words), pa.large_binary()).take(numbered.indices)
        if not len(ids):
            out = [b""] * len(texts)
        else:
            place, data = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1], ids.buffers()[2]
            cuts = place[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
            raw = memoryview(data) if data is not None else memoryview(b"")
            out = [bytes(raw[i:j]) for i, j in zip(cuts, cuts[1:])]
        for i, found in zip(np.flatnonzero(whole), self._whole(texts.filter(pa.array(whole)).to_pylist()) if whole.any() else ()):
            out[i] = found
        return out

    def encode(self, texts: pa.StringArray) -> Iterator[bytes]:
        """Serialised ids of each text."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().tolist()
        first = held = 0
        for i, size in enumerate([*sizes, BYTES_AT_ONCE + 1]):
            if held + size > BYTES_AT_ONCE:
                if i > first:
                    yield from self._some(texts.slice(first, i - first))
                first, held = i, 0
                if i < len(sizes) and size > BYTES_AT_ONCE:
                    yield b"".join(ids for part in text_parts(texts[i].as_py()) for ids in self._some(pa.array([part], pa.string())))
                    first, size = i + 1, 0
            held += size


def text_parts(text: str) -> Iterator[str]:
    """A long text in parts that end at a blank, where no word and no special token goes on."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = max(text.rfind(b, at, at + PART_CHARS) for b in " \n\t")
        if cut < 0:
            cut = min([p for b in " \n\t" if (p := text.find(b, at + PART_CHARS)) >= 0], default=len(text) - 1)
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def word_encoder(tokenizer_path: str) -> WordEncoder:
    return worker_state(f"words:{tokenizer_path}", lambda: WordEncoder(tokenizer_path))


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """A dictionary of the serialised ids of a bounded sample: the documents with the least hash."""
    head = F.substring("text", 1, 8 * SAMPLE_IDS).alias("text")
    some = docs.select(F.xxhash64("key", "text").alias("draw"), head).orderBy("draw").limit(SAMPLE_DOCS).select("text")
    schema = pa_schema(docs.sparkSession, "ids binary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        most = SAMPLE_IDS * encoder.kind.itemsize
        for b in batches:
            ids = [i[:most] for i in encoder.encode(b.column("text"))]
            yield pa.RecordBatch.from_pydict({"ids": ids}, schema=schema)

    sample = [r["ids"] for r in some.mapInArrow(encode, "ids binary").collect() if r["ids"]]
    size = min(DICTIONARY_BYTES, sum(map(len, sample)) // 8)
    try:
        return zstandard.train_dictionary(size, sample, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples to train on
        return b""


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a path or URI, as tasks and driver reach it."""
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


@functools.lru_cache(maxsize=4)
def _dictionary(folder: str, digest: str) -> zstandard.ZstdCompressionDict | None:
    """The dictionary of a folder, checked against its hash; None for the empty one."""
    store, root = filesystem(folder)
    with store.open_input_stream(f"{root}/{digest}.dictionary") as f:
        raw = f.read()
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError(f"the dictionary in {folder} is not {digest}")
    return zstandard.ZstdCompressionDict(raw) if raw else None


class Writer:
    """One file of the format, written front to back; the index is kept until the end."""

    def __init__(self, out, width: int, digest: str) -> None:
        self.out, self.at, self.ids, self.index = out, HEADER.size, 0, []
        out.write(HEADER.pack(MAGIC, VERSION, width, bytes.fromhex(digest)))

    def add(self, key: str | None, frame: bytes, n_ids: int) -> None:
        raw = (key or "").encode()
        self.index.append(ENTRY.pack(self.at, self.ids, NO_KEY if key is None else len(raw)) + raw)
        self.out.write(frame)
        self.at, self.ids = self.at + len(frame), self.ids + n_ids

    def close(self) -> None:
        self.out.write(b"".join(self.index))
        self.out.write(FOOTER.pack(self.at, len(self.index), self.ids, MAGIC))


class Reader:
    """Random access to the documents of one file: ``index`` has (key, first id's place) of each."""

    def __init__(self, source, folder: str) -> None:
        self.source, size = source, source.size()
        magic, version, self.width, digest = HEADER.unpack(self._read(0, HEADER.size))
        index_at, documents, self.ids, end = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or end != MAGIC or version != VERSION:
            raise ValueError("not a whole file of token ids")
        self.context = zstandard.ZstdDecompressor(dict_data=_dictionary(folder, digest.hex()))
        raw, at = self._read(index_at, size - FOOTER.size - index_at), 0
        self.index: list[tuple[str | None, int]] = []
        self.offsets: list[int] = []
        for _ in range(documents):
            offset, first, n = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            self.index.append((None if n == NO_KEY else raw[at : at + n].decode(), first))
            self.offsets.append(offset)
            at += 0 if n == NO_KEY else n
        self.offsets.append(index_at)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def document(self, k: int) -> np.ndarray:
        """Ids of document k; only its frame is read."""
        frame = self._read(self.offsets[k], self.offsets[k + 1] - self.offsets[k])
        return np.frombuffer(self.context.decompress(frame), f"<u{self.width}")


def write_documents(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every whole text, ``end_id`` after each, in ascending id order. Returns the manifest, one row a file:
    (file, path, documents, ids, start), ``start`` being the number of ids in all files before."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    raw = train_dictionary(docs, tokenizer_path)
    digest = hashlib.sha256(raw).hexdigest()
    with store.open_output_stream(f"{root}/{digest}.dictionary") as f:
        f.write(raw)
    # equal ids are told apart by their text's hash and by the row's place, so no range holds a hot id whole
    keyed = docs.select("key", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("copy"), "text")
    order = [F.col("key").asc_nulls_first(), F.col("tie"), F.col("copy")]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("file"), F.col("key").cast("string").alias("key"), "text")
    out_ddl = "file int, path string, documents long, ids long"
    out_schema = pa_schema(spark, out_ddl)
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        encoder, shared = word_encoder(tokenizer_path), _dictionary(folder, digest)
        if shared:
            shared.precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        width, end = encoder.kind.itemsize, np.array([end_id], encoder.kind).tobytes()
        own = f"{root}/{run}-{uuid.uuid4().hex}.part"  # of this attempt of the task
        sink = writer = None
        for b in batches:
            if writer is None and b.num_rows:
                file, sink = b.column("file")[0].as_py(), store.open_output_stream(own)
                writer = Writer(sink, width, digest)
            for key, ids in zip(b.column("key").to_pylist(), encoder.encode(b.column("text"))):
                writer.add(key, compressor.compress(ids + end), len(ids) // width + 1)
        if writer is not None:
            writer.close()
            sink.close()
            path = f"{root}/{run}-{file:06d}.tokz"
            store.move(own, path)
            yield pa.RecordBatch.from_pydict({"file": [file], "path": [path], "documents": [len(writer.index)], "ids": [writer.ids]}, schema=out_schema)

    manifest = materialize(ordered.mapInArrow(write, out_ddl), "token-files")  # the files are written here, once
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, folder: str, keys: Collection[str] | None = None) -> DataFrame:
    """(key, start, ids): every document of the files, ids as little-endian unsigned 32-bit integers. With ``keys`` (ids as text), only
    these documents' frames are read."""
    spark = manifest.sparkSession
    ddl = "key string, start long, ids binary"
    schema = pa_schema(spark, ddl)
    wanted = None if keys is None else frozenset(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                with store.open_input_file(path) as source:
                    file = Reader(source, folder)
                    out: dict[str, list] = {f.name: [] for f in schema}
                    held = 0
                    for k, (key, first) in enumerate(file.index):
                        if wanted is not None and key not in wanted:
                            continue
                        ids = file.document(k).astype("<u4").tobytes()
                        out["key"].append(key)
                        out["start"].append(start + first)
                        out["ids"].append(ids)
                        held += len(ids)
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pydict(out, schema=schema)
                            out, held = {f.name: [] for f in schema}, 0
                    yield pa.RecordBatch.from_pydict(out, schema=schema)

    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files).mapInArrow(read, ddl)


def store_and_read(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from its file. ``folder`` (default: a new one in the
    shared folder) keeps the files."""
    folder = folder or checkpoint_path(docs.sparkSession, f"token-store-{uuid.uuid4().hex}")
    found = read_documents(write_documents(docs, folder, tokenizer_path, end_id, id_col, text_col), folder)
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return found.select(F.col("key").cast(docs.schema[id_col].dataType).alias(id_col), "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
