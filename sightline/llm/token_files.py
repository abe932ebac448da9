"""Token-id files: frequency-ranked ids in a byte-aligned code with separate control bytes.

Ids are replaced by their rank in the corpus (0 = most frequent), so frequent ids take one byte.
A block file holds, in this order, a header, per-document columns, one control byte for each four
values (two bits each: bytes of the value less one) and the value bytes, low byte first. Decoding
looks the four lengths of every control byte up in a table of 256 rows and gathers the bytes with
numpy; there is no loop over values.

The folder also holds ``ranks.bin`` (rank -> id) and ``parts.bin`` (tokens before each part), so the
files can be read without the tables they came from.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

MAGIC = b"SLTOK001"
HEADER = struct.Struct("<8sIIQQQ")  # magic, part, documents, tokens, start within the part, value bytes
#: Lengths of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
BLOCK_TOKENS = 1 << 20
CACHE_ENTRIES = 2_000_000
BATCH_BYTES = 2 << 20
#: A mark after a letter or digit; no letter outside Latin or whose lower case is more than a letter (U+0130), and no mark that a combining sign could join.
POINTS = r"([a-zA-Z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([.,!?;:*#$%&)])"


# ---- the code ---------------------------------------------------------------------------------


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and value bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    extra = (values > 0xFF).astype(np.uint8)
    extra += values > 0xFFFF
    extra += values > 0xFFFFFF
    padded = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    padded[: len(values)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] <= extra[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    lengths = LENGTHS[control].ravel()[:count]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
    out = padded[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= padded[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(part: int, start: int, doc_ids: list, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    """One block file. A null doc_id is kept as a flag."""
    control, data = encode_values(ranks)
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    ids = np.array([0 if x is None else x for x in doc_ids], dtype="<i8")
    head = HEADER.pack(MAGIC, part, len(ids), len(ranks), start, len(data))
    return b"".join([head, known.tobytes(), ids.tobytes(), np.asarray(counts, dtype="<u4").tobytes(), control, data])


def unpack_block(content: bytes) -> tuple[int, int, list, np.ndarray, np.ndarray]:
    magic, part, docs, tokens, start, size = HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = HEADER.size
    known = np.frombuffer(content, np.uint8, docs, at)
    ids = np.frombuffer(content, "<i8", docs, at := at + docs)
    counts = np.frombuffer(content, "<u4", docs, at := at + 8 * docs)
    control = np.frombuffer(content, np.uint8, -(-tokens // 4), at := at + 4 * docs)
    data = np.frombuffer(content, np.uint8, size, at + len(control))
    return part, start, [int(i) if k else None for i, k in zip(ids, known)], counts, decode_values(control, data, tokens)


# ---- tokenizing -------------------------------------------------------------------------------


class ChunkEncoder:
    """Encodes texts by way of their white-space-separated chunks, keeping the ids of chunks seen.

    A batch's chunks are numbered by Arrow, each different one is looked up once, and numpy gathers
    the ids. Chunks not seen before are encoded together, set apart by a character that none of
    them holds. Exact for tokenizers whose pre-tokenizer drops white space and never looks across it
    (``splits_on_space``); with any other tokenizer each text is a chunk of its own.
    """

    MARK = "\x01"

    def __init__(self, path: str, width: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.width, self.known = Tokenizer.from_file(path), np.dtype(width), {}
        self.by_chunk, self.folds, self.points = splits_on_space(self.tokenizer), folds_case(self.tokenizer), splits_on_points(self.tokenizer)
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 and self.by_chunk else None

    def _learn(self, new: list[str]) -> None:
        plain = [c for c in new if self.MARK not in c and "<" not in c] if self.mark is not None else []
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(some)], add_special_tokens=False)[0].ids, dtype=self.width)
            ends = np.r_[np.flatnonzero(ids == self.mark), len(ids)] * self.width.itemsize
            starts, raw = np.r_[0, ends[:-1] + self.width.itemsize], ids.tobytes()
            self.known.update(zip(some, [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())], strict=True))
        for c in (c for c in new if c not in self.known):
            self.known[c] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by ``end_id``, and the number of each text's ids."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        if not self.by_chunk:
            chunks, of = texts, np.arange(len(texts) + 1)
        else:
            if self.folds:  # ASCII text that holds no special token may be folded first: fewer chunks differ
                plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
                texts = pc.if_else(plain, pc.ascii_lower(texts), texts)
            if self.points:
                texts = pc.replace_substring_regex(texts, POINTS, r"\1 \2")
            lists = pc.ascii_split_whitespace(texts)
            chunks, of = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            of = of - of[0]
        coded = chunks.dictionary_encode()
        unique = coded.dictionary.to_pylist()
        get = self.known.get
        found = [get(c) for c in unique]
        if new := [c for c, x in zip(unique, found) if x is None]:
            self._learn(new)
            found = [get(c) for c in unique]
        found.append(np.array([end_id], dtype=self.width).tobytes())
        flat = np.frombuffer(b"".join(found), dtype=self.width)
        size = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // self.width.itemsize
        begin = np.cumsum(size) - size
        words = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), of[1:], len(unique))
        sizes = size[words]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(begin[words] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        last = ends[of[1:] + np.arange(len(of) - 1)]
        return ids, np.diff(last, prepend=0)


def splits_on_space(tokenizer) -> bool:
    """Whether white space only ever separates: a text's ids are then its chunks' ids, joined."""
    probe = "Abé, it's x9ß \u0301o"
    apart = [i for c in probe.split(" ") for i in tokenizer.encode(c, add_special_tokens=False).ids]
    spaced = [tokenizer.encode(s, add_special_tokens=False).ids for s in (probe, probe.replace(" ", " \t\x0b\x0c\r\n "))]
    return all(s == apart for s in spaced) and not tokenizer.encode(" \t\x0b\x0c\r\n", add_special_tokens=False).ids


def folds_case(tokenizer) -> bool:
    import string

    return all(tokenizer.encode(c, add_special_tokens=False).ids == tokenizer.encode(c.lower(), add_special_tokens=False).ids for c in string.ascii_uppercase)


def splits_on_points(tokenizer) -> bool:
    """Whether a mark after a letter or digit begins a piece of its own, so that it may be set apart before."""
    if any(m in t.content for t in tokenizer.get_added_tokens_decoder().values() for m in ".,!?;:*#$%&)"):
        return False  # a token of its own could be cut
    pairs = ((a + b + c, a + " " + b + c) for a in "ab Z x9 is é Ÿ ß ø".split() for b in ".,!?;:*#$%&)" for c in ("", "b", "7", "..", "'s", '"', "<", "%%%"))
    return all(tokenizer.encode(x, add_special_tokens=False).ids == tokenizer.encode(y, add_special_tokens=False).ids for x, y in pairs)


@lru_cache(maxsize=4)
def chunk_encoder(path: str, width: str) -> ChunkEncoder:
    """One for each Python worker: what it has learned serves the worker's later tasks."""
    return ChunkEncoder(path, width)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to about BATCH_BYTES each: the larger they are, the fewer different chunks they have in all."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if len(batch) else []
        if sum(b.nbytes for b in held) >= BATCH_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _tokenized(path: str, end_id: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, start = chunk_encoder(path, width), TaskContext.get().partitionId(), 0
        for batch in _joined(batches):
            ids, counts = encode(pc.fill_null(batch.column("text"), ""), end_id)
            ends = np.r_[0, np.cumsum(counts)]
            offsets = (ends * ids.itemsize).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            columns = [pa.array(np.full(len(counts), part, dtype=np.int32)), pa.array(start + ends[:-1]), batch.column("doc_id"), blobs]
            yield pa.RecordBatch.from_arrays(columns, ["part", "start", "doc_id", "ids"])
            start += int(ends[-1])

    return run


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 1, width: str = "<u2") -> DataFrame:
    """part, start (tokens before it in the part), doc_id, ids: parts are ranges of doc_id in ascending order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Texts' beginnings are part of the ranges: rows of one id, or of none, are then dealt out as well.
    ranged = rows.repartitionByRange(F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    return ranged.mapInArrow(_tokenized(tokenizer_path, end_id, width), "part int, start long, doc_id long, ids binary")


# ---- files ------------------------------------------------------------------------------------


def _put(folder: str, name: str, content: bytes) -> None:
    """Write by way of a name of its own, so that a task that runs twice leaves one whole file."""
    import uuid

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(hidden := f"{root}/_{uuid.uuid4().hex}") as out:
        out.write(content)
    store.move(hidden, f"{root}/{name}")


def _counted(width: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, dtype=np.int64)
        for frame in frames:
            for ids in frame["ids"]:
                own = np.bincount(np.frombuffer(ids, dtype=width))
                if len(own) > len(total):
                    total = np.r_[total, np.zeros(len(own) - len(total), dtype=np.int64)]
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    return run


def _written(folder: str, rank_of: np.ndarray, width: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first, docs, held, size = None, 0, [], [], 0

        def flush() -> pd.DataFrame:
            counts = np.array([len(x) for x in held])
            block = pack_block(part, first, docs, counts, rank_of[np.concatenate(held)])
            _put(folder, f"part-{part:06d}-{first:016d}.tok", block)
            return pd.DataFrame({"part": [part], "n_tokens": [int(counts.sum())]})

        for frame in frames:
            ids = frame["doc_id"].astype("Int64")
            for p, s, d, raw in zip(frame["part"], frame["start"], [None if pd.isna(x) else int(x) for x in ids], frame["ids"]):
                if held and (p != part or size >= BLOCK_TOKENS):
                    yield flush()
                    docs, held, size = [], [], 0
                if not held:
                    part, first = int(p), int(s)
                docs.append(d)
                held.append(np.frombuffer(raw, dtype=width))
                size += len(held[-1])
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Write every document's ids, each document closed by ``end_id``, in ascending order of doc_id.

    Null text counts as empty and gives the end id alone; a null doc_id sorts first; equal doc_ids
    are ordered by text. An empty table gives a folder without blocks. Other columns are ignored.
    What reaches the driver is one row per id of the vocabulary and one per part.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    space = Workspace(spark, "tokenized")
    table = space.table(tokenize(docs, tokenizer_path, end_id, width), "ids")
    counts = table.select("ids").mapInPandas(_counted(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    ranked = counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(dtype=np.int64)
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, dtype="<u4")
    rank_of[ranked] = np.arange(len(ranked))
    _put(folder, "ranks.bin", MAGIC + ranked.astype("<u4").tobytes())
    parts = table.mapInPandas(_written(folder, rank_of, width), "part int, n_tokens long").groupBy("part").agg(F.sum("n_tokens").alias("n")).toPandas().sort_values("part")
    before = np.r_[0, parts["n"].to_numpy(dtype=np.int64).cumsum()[:-1]] if len(parts) else np.zeros(0)
    _put(folder, "parts.bin", MAGIC + np.c_[parts["part"].to_numpy(dtype=np.int64), before].astype("<i8").tobytes())
    space.clear()


def _side_file(spark: SparkSession, folder: str, name: str) -> bytes:
    content = bytes(spark.read.format("binaryFile").load(f"{folder}/{name}").select("content").head()[0])
    if not content.startswith(MAGIC):
        raise ValueError(f"{name} is not of this format")
    return content[len(MAGIC) :]


def _decoded(ids: np.ndarray, before: dict[int, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                part, start, doc_ids, counts, ranks = unpack_block(bytes(content))
                tokens, ends = ids[ranks], np.cumsum(counts, dtype=np.int64)
                raw, starts = tokens.astype("<u4").tobytes(), ends - counts
                yield pd.DataFrame({
                    "doc_id": pd.array(doc_ids, dtype="Int64"),
                    "start": before[part] + start + starts,
                    "n_tokens": counts.astype(np.int64),
                    "ids": [raw[4 * s : 4 * e] for s, e in zip(starts, ends)],
                })

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit little-endian), from the files alone."""
    ids = np.frombuffer(_side_file(spark, folder, "ranks.bin"), dtype="<u4")
    parts = np.frombuffer(_side_file(spark, folder, "parts.bin"), dtype="<i8").reshape(-1, 2)
    blocks = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("content")
    return blocks.mapInPandas(_decoded(ids, dict(parts.tolist())), "doc_id long, start long, n_tokens long, ids binary")


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
