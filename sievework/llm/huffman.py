"""Token ids in files of canonical length-limited Huffman codes.

Documents are dealt by ranges of doc_id, tokenized in order and kept as plain id files; global counts then give one
code table for all files (package-merge, at most ``MAX_BITS`` bits), and each id file becomes one coded file. A
coded file starts with the code lengths and holds blocks that decode on their own: a table of (doc_id, ids), a
bit offset for every ``EVERY`` ids, and the bits. The decoder walks all checkpoints of a block in step through
one table of 2**MAX_BITS entries.

Cases: a null text is empty, so it holds the end id alone; null doc_ids come first; rows that repeat a doc_id are
ordered by their text's hash; an empty table gives no files and no rows; an id outside the table is an error.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import hashing
from sievework.llm.common import drop_path, materialise, new_path, table

MAGIC = b"SWHUFF01"
TOKENIZER, END = "byte_bpe_50k.json", 2
#: Longest code, ids between checkpoints, ids in a block (or one longer document), pieces remembered by a worker, pieces encoded as one text.
MAX_BITS, EVERY, BLOCK_IDS, PIECES, TOGETHER = 18, 256, 1 << 20, 1 << 21, 128
#: Text encoded at a time.
TEXT_BYTES = 4 << 20
NULL = np.iinfo(np.int64).min


# --- codes ------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``most`` bits; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids need more than {most} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    level, kinds = leaf, [np.ones(len(leaf), bool)]
    for _ in range(most - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both, kind = np.append(leaf, pairs), np.append(np.ones(len(leaf), bool), np.zeros(len(pairs), bool))
        by = np.argsort(both, kind="stable")
        level = both[by]
        kinds.append(kind[by])
    take = 2 * len(leaf) - 2
    for kind in reversed(kinds):
        leaves = int(kind[:take].sum())
        out[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        bits = lengths[order].astype(np.uint64)
        top = np.uint64(bits[-1])
        spans = np.uint64(1) << (top - bits)
        starts = np.cumsum(spans) - spans
        codes[order] = starts >> (top - bits)
    return codes


def decode_table(lengths: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for every window of ``most`` bits; length 0 where no code fits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (most - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << most, np.uint32), np.zeros(1 << most, np.int64)
    n = int(spans.sum())
    ids[:n], bits[:n] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' bits, most significant first, and the bit offset of every EVERY-th id."""
    bits = lengths[ids].astype(np.int64)
    if len(ids) and not bits.all():
        raise ValueError("an id has no code")
    ends = np.cumsum(bits)
    starts = ends - bits
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros((total >> 6) + 2, np.uint64)
    if len(ids):
        at, room = starts >> 6, 64 - (starts & 63) - bits
        code = codes[ids]
        high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        words[at[new]] = np.add.reduceat(high, new)
        over = np.flatnonzero(room < 0)
        words[at[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) >> 3], starts[::EVERY].astype("<u8")


def unpack(data: bytes, n: int, checkpoints: np.ndarray, tables: tuple[np.ndarray, np.ndarray], most: int = MAX_BITS) -> np.ndarray:
    """The first ``n`` ids of a block; all checkpoints advance together, one id a step."""
    ids, bits = tables
    b = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    out = np.zeros((len(checkpoints), EVERY), np.uint32)
    at = checkpoints.astype(np.int64)
    last = n - (len(checkpoints) - 1) * EVERY if n else 0
    for step in range(min(EVERY, n)):
        if step == last:  # the last checkpoint has fewer ids
            at = at[:-1]
        peek = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - most)
        size = bits[peek]
        if not size.all():
            raise ValueError("bits that aren't a code")
        out[: len(at), step] = ids[peek]
        at = at + size
    return out.ravel()[:n]


# --- files ------------------------------------------------------------------------------------------------------


def write_header(out, lengths: np.ndarray) -> None:
    packed = zlib.compress(lengths.tobytes())
    out.write(MAGIC + struct.pack("<III", MAX_BITS, len(lengths), len(packed)) + packed)


def write_block(out, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> None:
    data, checkpoints = pack(ids, codes, lengths)
    out.write(struct.pack("<QQQQ", len(doc_ids), len(ids), len(checkpoints), len(data)))
    for part in (doc_ids.astype("<i8"), sizes.astype("<u8"), checkpoints):
        out.write(part.tobytes())
    out.write(data)


def _exactly(source, n: int) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise ValueError("the file is cut short")
    return data


def read_blocks(source) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, sizes, ids) of each block."""
    if _exactly(source, 8) != MAGIC:
        raise ValueError("not a coded file")
    most, vocabulary, size = struct.unpack("<III", _exactly(source, 12))
    lengths = np.frombuffer(zlib.decompress(_exactly(source, size)), np.uint8)
    if len(lengths) != vocabulary:
        raise ValueError("the code table isn't of its stated size")
    tables = decode_table(lengths, most)
    while head := source.read(32):
        docs, n, points, size = struct.unpack("<QQQQ", head)
        doc_ids, sizes, checkpoints = (np.frombuffer(_exactly(source, 8 * k), t) for k, t in ((docs, "<i8"), (docs, "<u8"), (points, "<u8")))
        yield doc_ids, sizes, unpack(_exactly(source, size), n, checkpoints, tables, most)


# --- tokenizing -------------------------------------------------------------------------------------------------


def shapes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that begin a visible character, ASCII or a Latin-1 letter, and bytes that end one."""
    shown, lead = (data > 32) & (data < 127), data == 0xC3
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1] & (data[1:] >= 0x80)
    return shown | lead, shown | tail


def piece_starts(offsets: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places where a text may be cut without changing its ids: text starts, and single spaces between two visible
    characters that are ASCII or Latin-1 letters. The tokenizer's own pattern always starts a new word there."""
    n = len(data)
    first = offsets[:-1][np.diff(offsets) > 0]
    if n < 3:
        return first
    cut = np.zeros(n, bool)
    cut[1:-1] = (data[1:-1] == 32) & ends[:-2] & begins[2:]
    cut[first[first < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of many texts; each distinct piece is encoded once and remembered under its 64-bit hash and length, with its bytes.
    What is remembered counts only where the bytes agree; texts with a piece of other bytes are encoded anew. New pieces
    that may stand side by side are encoded as running text, and the ids' byte lengths tell them apart again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.bytes = np.zeros(self.of.get_vocab_size(), np.int64)
        for token, i in self.of.get_vocab().items():  # a token has a character for each of its bytes
            self.bytes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.keys, self.rank = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.spelt, self.held = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in each piece, all ids)."""
        found = [x.ids for x in self.of.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return size, np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))

    def running(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that each start a word after the one before."""
        runs = [b"".join(pieces[a : a + TOGETHER]) for a in range(0, len(pieces), TOGETHER)]
        found = self.of.encode_batch_fast([x.decode() for x in runs], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in found]) if found else np.zeros(0, np.uint32)
        ends, wanted = np.cumsum(self.bytes[ids]), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.searchsorted(ends, wanted)
        if len(pieces) and (last[-1] != len(ids) - 1 or (ends[last] != wanted).any()):
            return self.each(pieces)
        return np.diff(last, prepend=-1), ids

    def learn(self, keys: np.ndarray, place: np.ndarray, pieces: list[bytes], joins: np.ndarray) -> None:
        order = np.argsort(~joins, kind="stable")
        n = int(joins.sum())
        together, apart = self.running([pieces[i] for i in order[:n]]), self.each([pieces[i] for i in order[n:]])
        size = np.concatenate([together[0], apart[0]])
        begin = len(self.ids) + np.cumsum(size) - size
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.arange(len(self.start), len(self.start) + len(keys))
        self.start, self.size = np.append(self.start, begin), np.append(self.size, size.astype(np.int32))
        self.ids = np.concatenate([self.ids, together[1], apart[1]])
        spelt = np.fromiter((len(pieces[i]) for i in order), np.int64, len(pieces))
        self.spelt = np.append(self.spelt, len(self.held) + np.cumsum(spelt) - spelt)
        self.held = np.concatenate([self.held, np.frombuffer(b"".join(pieces[i] for i in order), np.uint8)])
        self.rank, self.keys = np.insert(self.rank, place, rank), np.insert(self.keys, place, keys)

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in each text, all ids), end ids not included."""
        texts, n = len(offsets) - 1, len(data)
        if not n:
            return np.zeros(texts, np.int64), np.zeros(0, np.uint32)
        opens, closes = shapes(data)
        starts = piece_starts(offsets, data, opens, closes)
        ends = np.append(starts[1:], n)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(hashing.byte_values(7)[data] * hashing.powers(n), out=prefix[1:])
        key = hashing.mix((prefix[ends] - prefix[starts]) * hashing.powers(n, hashing.INVERSE)[starts] + (ends - starts).astype(np.uint64))
        distinct, at, back = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        new = np.append(self.keys, np.uint64(0))[place] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        new |= place == len(self.keys)
        if new.any():
            raw, a, b = data.tobytes(), starts[at[new]], ends[at[new]]
            joins = (data[a] == 32) & (b - a > 1) & opens[np.minimum(a + 1, n - 1)] & closes[b - 1]
            self.learn(distinct[new], place[new], [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], joins)
            place = np.searchsorted(self.keys, distinct)
        known = self.rank[place][back]
        size = self.size[known]
        total = np.cumsum(size, dtype=np.int64)
        ids = self.ids[np.repeat(self.start[known] - (total - size), size) + np.arange(int(total[-1]))]
        owner = np.searchsorted(offsets, starts, "right") - 1
        sizes = np.bincount(owner, size, texts).astype(np.int64)
        if (other := self.differing(data, starts, ends, known)).any():
            sizes, ids = self.anew(np.unique(owner[other]), offsets, data, sizes, ids)
        if len(self.keys) > PIECES or len(self.ids) > 8 * PIECES or len(self.held) > 32 * PIECES:
            self.forget()
        return sizes, ids

    def differing(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Pieces whose bytes aren't those remembered under their hash, byte by byte. A piece starts where the one before it ends."""
        at = np.repeat(self.spelt[known] - starts, ends - starts) + np.arange(starts[0], ends[-1])
        wrong = np.flatnonzero(self.held[np.minimum(at, len(self.held) - 1)] != data[starts[0] : ends[-1]]) + starts[0]
        out = np.zeros(len(starts), bool)
        out[np.searchsorted(starts, wrong, "right") - 1] = True
        return out

    def anew(self, texts: np.ndarray, offsets: np.ndarray, data: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``sizes`` and ``ids`` with those of ``texts`` replaced by the tokenizer's own for the whole text."""
        begin = np.cumsum(sizes) - sizes
        each = [ids[b : b + n] for b, n in zip(begin, sizes, strict=True)]
        for t in texts:
            each[t] = self.each([data[offsets[t] : offsets[t + 1]].tobytes()])[1]
        return np.fromiter(map(len, each), np.int64, len(each)), np.concatenate(each)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder of a file; what one task has learnt serves the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_ends(sizes: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text."""
    return sizes + 1, np.insert(ids, np.cumsum(sizes), end)


# --- stages -----------------------------------------------------------------------------------------------------


def tokenizer_stage(folder: str, path: str, end: int):
    """For mapInArrow over a range of documents in order (doc_id, text): one plain id file and its list row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        encoder, out, name = None, None, f"{uuid.uuid4().hex}.ids"
        counts, docs = np.zeros(0, np.int64), 0
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for a, offsets, data in hashing.text_chunks(batch.column("text"), TEXT_BYTES):
                if out is None:
                    encoder = encoder_of(path)
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                sizes, ids = with_ends(*encoder.encode(offsets, data), end)
                names = batch.column("doc_id").slice(a, len(sizes)).fill_null(NULL).to_numpy(zero_copy_only=False)
                seen = np.bincount(ids)
                counts = np.pad(counts, (0, max(0, len(seen) - len(counts))))
                counts[: len(seen)] += seen
                docs += len(sizes)
                packed = squeeze.compress(b"".join((names.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes())))
                out.write(struct.pack("<QQQB", len(sizes), len(ids), len(packed), 2 if ids.max() < 1 << 16 else 4) + packed)
        if out is not None:
            out.close()
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "docs": pa.array([docs], pa.int64()), "ids": pa.array([int(counts.sum())], pa.int64()),
                "counts": pa.array([[{"id": int(i), "n": int(counts[i])} for i in used]], pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())]))),
            })

    return run


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over files' counts: their sums, a row for each id that the task's files hold."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        flat = batch.column("counts").flatten()
        if len(flat):
            ids, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("id", "n"))
            total = np.pad(total, (0, max(0, int(ids.max()) + 1 - len(total))))
            np.add.at(total, ids, n)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int32()), "n": pa.array(total[used])})


def read_plain(source) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    while head := source.read(25):
        docs, n, size, width = struct.unpack("<QQQB", head)
        raw = zstandard.ZstdDecompressor().decompress(_exactly(source, size))
        yield np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "<i8", docs, 8 * docs), np.frombuffer(raw, f"<u{width}", n, 16 * docs)


def coder_stage(folder: str, lengths: np.ndarray):
    """For mapInArrow over (part, name, docs, ids): each plain file coded; the same rows with the new name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        codes = canonical(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                name, held, n = f"{uuid.uuid4().hex}.huf", [], 0
                with store.open_input_stream(f"{base}/{row['name']}", compression=None) as source, store.open_output_stream(f"{base}/{name}", compression=None) as out:
                    write_header(out, lengths)
                    for block in read_plain(source):
                        held.append(block)
                        n += len(block[2])
                        if n >= BLOCK_IDS:
                            write_block(out, *(np.concatenate(x) for x in zip(*held, strict=True)), codes, lengths)
                            held, n = [], 0
                    if held:
                        write_block(out, *(np.concatenate(x) for x in zip(*held, strict=True)), codes, lengths)
                yield pa.RecordBatch.from_pylist([row | {"name": name}], schema=batch.schema)

    return run


ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def decoder_stage(folder: str):
    """For mapInArrow over (name, docs, ids, base): a row for each document of the coded files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at, docs = row["base"], 0
                with store.open_input_stream(f"{where}/{row['name']}", compression=None, buffer_size=1 << 20) as source:
                    for names, sizes, ids in read_blocks(source):
                        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes.astype(np.int64))
                        crc = [zlib.crc32(memoryview(raw)[4 * int(b - n) : 4 * int(b)]) for b, n in zip(ends, sizes, strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(names.astype(np.int64), mask=names == NULL), pa.array(at + ends - sizes.astype(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], schema=ROWS
                        )
                        at, docs = at + int(ends[-1]), docs + len(names)
                if (at - row["base"], docs) != (row["ids"], row["docs"]):
                    raise ValueError(f"{row['name']} holds {docs} documents of {row['docs']}")

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END) -> DataFrame:
    """Code ``docs`` (doc_id, text) into files under ``folder``; returns their list (part, name, docs, ids), in the
    order of ``part``. Only listed files count: a task that ran twice leaves files that nobody reads."""
    spark = docs.sparkSession
    h = F.xxhash64("text")
    dealt = docs.select("doc_id", "text", h.alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    kind = "part int, name string, docs long, ids long"
    plain, listed = materialise(dealt.mapInArrow(tokenizer_stage(folder, tokenizer, end), f"{kind}, counts array<struct<id: int, n: long>>"), "id-files")
    per = each_file(plain.select("name", "counts")).mapInArrow(add_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary at most
    counts = np.zeros(max((r["id"] for r in per), default=-1) + 1, np.int64)
    for r in per:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    files, _ = materialise(each_file(plain.select("part", "name", "docs", "ids")).mapInArrow(coder_stage(folder, lengths), kind), "coded-files")
    for r in plain.select("name").toLocalIterator():
        drop_path(spark, f"{folder}/{r['name']}")
    drop_path(spark, listed)
    return files


def each_file(files: DataFrame) -> DataFrame:
    """The list dealt over the cluster's cores, twice as many tasks as cores."""
    return files.repartition(max(1, 2 * files.sparkSession.sparkContext.defaultParallelism), "name")


def read(files: DataFrame, folder: str) -> DataFrame:
    """A row a document: doc_id, ids before it, its ids and their checksum."""
    spark = files.sparkSession
    base, rows = 0, []
    for r in files.orderBy("part").toLocalIterator():  # one row a file
        rows.append((r["name"], r["docs"], r["ids"], base))
        base += r["ids"]
    listed = spark.createDataFrame(rows, "name string, docs long, ids long, base long")
    return each_file(listed).mapInArrow(decoder_stage(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "ids")
    return read(write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, tokenizer_path()), folder)
