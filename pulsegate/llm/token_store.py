"""Token ids in a binary format: blocks of ids as bit or byte planes, each compressed with zstandard.

Layout of a store, a folder:

    chunks/   Parquet container, a row for each chunk of whole documents
      shard, chunk        place of the chunk; shards ascend by doc_id, chunks by place in their shard
      start               ids before the chunk in its shard
      doc_ids, lengths    the documents of the chunk, in order, and their ids (the end id included)
      width               planes of each block: the bits of the largest id, or 4 bytes
      planes, sizes       the compressed planes one after another, block by block, and their lengths
    index/    a row for each shard: ids, chunks and documents in it, and the ids before it (`base`)

A block holds `BLOCK` ids (the last of a chunk fewer). Plane k of a block holds bit k of all its ids, so
that the rarely set high bits become long runs. Spark writes the container, so a store lives on any file
system that Spark knows and a lost task leaves no half-written file behind.

Texts are shuffled once, by ranges of doc_id. Nothing grows on the driver but the index, a row for each
shard.

Defined results: null text is empty and leaves only the end id. Null doc_ids come last. Rows of equal id
stay separate, in order of their text. Other columns are ignored. An empty table gives an empty store.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegate.llm.common import NO_ID, order_id, shared_folder, text_or_empty
from pulsegate.llm.pretokens import Lexicon, at_work, codes_of, lent, room, worker_state
from pulsegate.llm.token_counts import BATCH_CHARS, in_batches, vocabulary_path

BLOCK = 1 << 16
CHUNK_IDS = 1 << 18
LEVEL = 3
# New pre-tokens that go to the library as one text.
TOGETHER = 20_000
# Arrays of eight bytes for each character go with a part; two workers of an executor hold one each.
PART_CHARS = BATCH_CHARS // 16
END = 0
CHUNK_TYPE = (
    "shard int, chunk int, start long, doc_ids array<long>, lengths array<long>, n_ids long, kind string, "
    "width int, planes binary, sizes array<int>"
)


def to_planes(ids: np.ndarray, kind: str, width: int) -> list[bytes]:
    """The planes of one block; kind: bit or byte."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(width)]
    bits = np.unpackbits(raw, axis=1, bitorder="little", count=width)
    return [x.tobytes() for x in np.packbits(bits.T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    elif n:
        bits = np.unpackbits(np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1), axis=1, bitorder="little", count=n)
        raw[:, : (len(planes) + 7) // 8] = np.packbits(bits.T, axis=1, bitorder="little")
    return raw.view("<u4").reshape(-1)


def pack(ids: np.ndarray, kind: str = "bit", block: int = BLOCK, level: int = LEVEL) -> tuple[int, bytes, list[int]]:
    """Width, compressed planes one after another, and their sizes."""
    width = 4 if kind == "byte" else max(1, int(ids.max()).bit_length() if len(ids) else 1)
    packer = zstandard.ZstdCompressor(level=level)
    parts = [packer.compress(x) for at in range(0, len(ids), block) for x in to_planes(ids[at : at + block], kind, width)]
    return width, b"".join(parts), [len(x) for x in parts]


def unpack(planes: bytes, sizes, n: int, kind: str, width: int, block: int = BLOCK) -> np.ndarray:
    reader, at, parts = zstandard.ZstdDecompressor(), 0, []
    for size in sizes:
        parts.append(reader.decompress(planes[at : at + size]))
        at += size
    blocks = [
        from_planes(parts[k * width : (k + 1) * width], min(block, n - k * block), kind)
        for k in range((n + block - 1) // block)
    ]
    return np.concatenate(blocks) if blocks else np.empty(0, np.uint32)


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The library splits a text into pre-tokens and encodes each alone; here the different pre-tokens of a
    batch go to the library, and known ones are looked up. Texts with a special string go there whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.lexicon = Lexicon()
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.at, self.length, self.known = np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after another, and how many each has.

        Pre-tokens that stay apart side by side go to the library as one text: those that start with one
        blank directly, those without white space with a line feed between. Where it sees other
        pre-tokens than were given, and for all other kinds, each goes alone.
        """
        kinds = np.fromiter((0 if w[0] == " " and w[1:] and not w[1].isspace() else 2 if w[0].isspace() else 1 for w in words), np.int8, len(words))
        counts, found = np.zeros(len(words), np.int64), {}
        for kind, between, step in ((0, "", 1), (1, "\n", 2)):
            for part in np.array_split(np.flatnonzero(kinds == kind), max(1, int((kinds == kind).sum()) // TOGETHER)):
                if not len(part):
                    continue
                text = self.library.encode(between.join([words[i] for i in part.tolist()]), add_special_tokens=False)
                of, ids = np.array(text.word_ids, np.int64), np.array(text.ids, np.uint32)
                if of.max() + 1 != step * (len(part) - 1) + 1:
                    kinds[part] = 2
                    continue
                ids, of = ids[of % step == 0], of[of % step == 0] // step
                counts[part] = np.bincount(of, minlength=len(part))
                found[kind, int(part[0])] = part, ids
        alone = np.flatnonzero(kinds == 2)
        each = [x.ids for x in self.library.encode_batch_fast([words[i] for i in alone.tolist()], add_special_tokens=False)]
        counts[alone] = np.fromiter(map(len, each), np.int64, len(each))
        found[2, 0] = alone, np.fromiter((i for x in each for i in x), np.uint32, int(counts[alone].sum()))
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for part, ids in found.values():
            sizes = counts[part]
            out[np.repeat(begin[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids
        return out, counts

    def _learn(self, fresh: list[str]) -> None:
        more, sizes = self._each(fresh)
        self.ids = room(self.ids, self.used + len(more))
        self.at, self.length = room(self.at, self.known + len(sizes)), room(self.length, self.known + len(sizes))
        self.ids[self.used : self.used + len(more)] = more
        self.at[self.known : self.known + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.length[self.known : self.known + len(sizes)] = sizes
        self.used, self.known = self.used + len(more), self.known + len(sizes)

    def _tailed(self, numbers: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
        """The numbers with that of the end id behind each text."""
        self.ids = room(self.ids, self.used + 1)
        self.ids[self.used] = end
        self.at, self.length = room(self.at, self.known + 1), room(self.length, self.known + 1)
        # Just above what is known: the next new pre-token takes the place.
        self.at[self.known], self.length[self.known] = self.used, 1
        tailed = np.full(len(numbers) + len(counts), self.known)
        tailed[np.arange(len(numbers)) + np.repeat(np.arange(len(counts)), counts)] = numbers
        return tailed

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and how many each text has; end: an id put behind each text."""
        odd = {i for i, x in enumerate(texts) if any(s in x for s in self.specials)}
        if self.lexicon.full:
            self._forget()
        joined, codes, cuts, counts = codes_of(["" if i in odd else x for i, x in enumerate(texts)])
        numbers, fresh = self.lexicon.numbers(joined, codes, cuts)
        if fresh:
            self._learn(fresh)
        if end is not None:
            numbers, counts = self._tailed(numbers, counts, end), counts + 1
        size = self.length[numbers]
        # Ragged gather: the ids of each pre-token stand together.
        total = int(size.sum())
        begin = np.cumsum(size) - size
        ids = self.ids[np.repeat(self.at[numbers] - begin, size) + np.arange(total)]
        sums = np.concatenate([[0], np.cumsum(size)])
        edges = np.cumsum(counts)
        per_text = sums[edges] - sums[edges - counts]
        if odd:
            parts = np.split(ids, np.cumsum(per_text)[:-1])
            for i, found in zip(sorted(odd), self._whole([texts[i] for i in sorted(odd)])):
                # An odd text has given its end id alone so far.
                parts[i], per_text[i] = np.concatenate([found, parts[i]]), len(found) + per_text[i]
            ids = np.concatenate(parts) if parts else ids
        return ids, per_text


def encoder(path: str) -> Encoder:
    state = worker_state()
    if ("encoder", path) not in state:
        state["encoder", path] = Encoder(path)
    return state["encoder", path]


def write_store(documents: DataFrame, path: str, vocabulary: str | None = None, kind: str = "bit", end: int = END) -> None:
    """Encodes the texts and writes them in ascending doc_id order."""
    vocabulary = vocabulary or vocabulary_path()

    @lent
    def chunks(batches):
        from pyspark import TaskContext

        shard, number, start = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush():
            nonlocal number, start
            ids = np.concatenate(held)
            width, planes, lengths = pack(ids, kind)
            row = [shard, number, start, np.concatenate(docs), np.concatenate(sizes), len(ids), kind, width, planes, lengths]
            number, start = number + 1, start + len(ids)
            held.clear(), docs.clear(), sizes.clear()
            return pd.DataFrame([row], columns=[x.split()[0] for x in CHUNK_TYPE.split(", ")])

        for batch in batches:
            texts, order = batch["text"].tolist(), batch["id"].to_numpy()
            for part in in_batches(texts, PART_CHARS):
                with at_work():
                    ids, per_text = encoder(vocabulary).encode(texts[part], end)
                held.append(ids), docs.append(order[part]), sizes.append(per_text)
                if sum(map(len, held)) >= CHUNK_IDS:
                    yield flush()
        if held:
            yield flush()

    spark = documents.sparkSession
    ranged = documents.select(order_id().alias("id"), text_or_empty().alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    ranged.mapInPandas(chunks, CHUNK_TYPE).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    stored = spark.read.parquet(f"{path}/chunks").select("shard", "n_ids", F.size("doc_ids").alias("n_docs"))
    totals = sorted(map(tuple, stored.groupBy("shard").agg(F.sum("n_ids"), F.count("*"), F.sum("n_docs")).collect()))
    rows, base = [], 0
    for shard, n_ids, n_chunks, n_docs in totals:
        rows.append((shard, n_ids, n_chunks, n_docs, base))
        base += n_ids
    index = spark.createDataFrame(rows, "shard int, n_ids long, n_chunks long, n_docs long, base long")
    index.coalesce(1).write.parquet(f"{path}/index")


def read_store(spark: SparkSession, path: str, per_document: str, reader) -> DataFrame:
    """Rows that `reader(doc_ids, starts, lengths, ids)` makes, as pandas frames of type `per_document`, of each chunk of a store."""
    index = spark.read.parquet(f"{path}/index").select("shard", "base")
    chunks = spark.read.parquet(f"{path}/chunks").join(F.broadcast(index), "shard")

    @lent
    def read(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = unpack(row.planes, row.sizes, row.n_ids, row.kind, row.width)
                lengths = np.asarray(row.lengths, np.int64)
                starts = row.base + row.start + np.cumsum(lengths) - lengths
                yield reader(np.asarray(row.doc_ids, np.int64), starts, lengths, ids)

    columns = ["base", "start", "doc_ids", "lengths", "n_ids", "kind", "width", "planes", "sizes"]
    return chunks.select(*columns).mapInPandas(read, per_document)


def checksums(doc_ids, starts, lengths, ids) -> pd.DataFrame:
    raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths) * 4
    sums = [zlib.crc32(raw[b - 4 * n : b]) for b, n in zip(ends.tolist(), lengths.tolist())]
    return pd.DataFrame({"doc_id": doc_ids, "start": starts, "n_tokens": lengths, "ids_crc32": np.array(sums, np.int64)})


def store_digest(documents: DataFrame, vocabulary: str | None = None, path: str | None = None, kind: str = "bit") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the store written at `path`."""
    spark = documents.sparkSession
    path = path or shared_folder(spark, "token-store")
    write_store(documents, path, vocabulary, kind)
    rows = read_store(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", checksums)
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
