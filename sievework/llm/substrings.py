"""Exact repeated substrings by a depth-limited radix sort of suffixes.

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier: in a document of smaller doc_id, or
earlier in the same one. Only the first LENGTH bytes of a suffix matter, so suffixes are ordered to that depth and
equal groups are exactly the repeated windows; the first of a group stays and the others' bytes go.

The most significant digit is taken by content: a window's digit is the smallest hash among its ``GRAM``-byte grams, so
equal windows have equal digits and neighbouring windows mostly share theirs. A run of windows with one digit
travels as one row (digit, hash of the run's bytes, document, start, windows). Runs whose digit is unique hold no
repeat, unless the gram that gives the digit occurs in them again, as in periodic text; such runs are always compared. A run equal to an earlier one is a repeat as a whole. What is left, different runs of one digit, is ordered
by further passes of eight bytes each, most significant first, dropping windows as soon as they are alone.

Equal digits, runs and windows of a hot digit are told by 64-bit hashes. A run goes on hash equality only against runs of the same
digit: with P pairs of different runs that share a digit, the odds that any byte goes wrongly are P / 2^64. Everything else is
decided by bytes.

Skew: each task first combines equal runs, so a passage that every document holds sends one row a task. A digit that
one task sees in over ``HOT`` different runs (the edges of such a passage) is dealt by its single windows, which
are combined in the same way. A digit's rows are those that its tasks kept, at most ``HOT`` for each combination in a task.

Cases: a null text is empty; texts under LENGTH bytes keep all; rows that repeat a doc_id and text don't remove
each other; rows that share a doc_id but not the text are documents of their own, none earlier than the other; null doc_ids
come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import hashing
from sievework.llm.bagminhash import node_of
from sievework.llm.common import materialise, table

LENGTH, GRAM = 100, 24
#: Windows in a run at most; rows combined in a task at a time; different runs of one digit in a task; bytes sorted at a time.
RUN, COMBINE, HOT, SORT_BYTES = 128, 1 << 20, 64, 2 << 20
U = np.uint64
#: A start is a byte's offset, with the number of the text among those of its doc_id (0 but where several differ) above so many bits.
TWIN = 36
#: Added to a run's windows if its digit's gram occurs in it again, so that the run may repeat itself.
SELF = 1 << 20
#: Kinds of rows: a digit is hot, a run to compare, bytes to remove, a run of a hot digit.
MARK, COMPARE, REMOVE, SPREAD = range(4)
FOUND = "kind int, g long, h long, node long, s long, n long"


def batch_of(kind, g, h, node, s, n) -> pa.RecordBatch:
    size = len(node)
    full = lambda x, t: np.full(size, x, t) if np.isscalar(x) else x.astype(t, copy=False)
    columns = [full(kind, np.int32), *(x.view(np.int64) if isinstance(x, np.ndarray) and x.dtype == U else full(x, np.int64) for x in (g, h, node, s, n))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kind", "g", "h", "node", "s", "n"])


def sliding(pick, x: np.ndarray, wide: int) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``wide`` neighbours, by doubling."""
    n, span = len(x) - wide + 1, 1
    while span * 2 <= wide:
        x, span = pick(x[:-span], x[span:]), span * 2
    return pick(x[:n], x[wide - span : wide - span + n])


def windows_by_digit(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows that share a digit: (digit, hash of the run's bytes, text, start in it, windows)."""
    n = len(data)
    none = np.zeros(0, U), np.zeros(0, U), *(np.zeros(0, np.int64),) * 3
    if n < length:
        return none
    prefix = np.zeros(n + 1, U)
    np.cumsum(hashing.byte_values(3)[data] * hashing.powers(n), out=prefix[1:])
    back = hashing.powers(n, hashing.INVERSE)
    grams = hashing.mix((prefix[gram:] - prefix[:-gram]) * back[: n - gram + 1])
    wide = length - gram + 1
    least = sliding(np.minimum, grams, wide)
    valid = np.zeros(n - length + 2, np.int32)
    size = np.diff(offsets)
    long = size >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, (offsets[1:] - length + 1)[long], -1)
    valid = np.cumsum(valid)[:-1]
    new = valid > 0
    new[1:] &= (least[1:] != least[:-1]) | (valid[:-1] == 0)
    new[offsets[:-1][long]] = True
    start = np.flatnonzero(new)
    if not len(start):
        return none
    count = np.add.reduceat(valid, start).astype(np.int64)
    parts = -(-count // RUN)
    start, turn = np.repeat(start, parts), np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    count = np.minimum(np.repeat(count, parts) - turn * RUN, RUN)
    start = start + turn * RUN
    # a gram is an anchor if it is the least of some window; a gram that occurs twice in a run is two anchors in a row
    edge = np.zeros(wide - 1, U)
    anchor = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), wide) == grams)
    again = np.flatnonzero((grams[anchor[1:]] == grams[anchor[:-1]]) & (anchor[1:] - anchor[:-1] < RUN + length))
    marks = np.zeros(len(start) + 1, np.int64)
    np.add.at(marks, np.searchsorted(start + count, anchor[again] - wide + 1, "right"), 1)
    np.add.at(marks, np.searchsorted(start, anchor[again + 1], "right"), -1)
    own = np.where(np.cumsum(marks)[:-1] > 0, SELF, 0)
    text = np.searchsorted(offsets, start, "right") - 1
    whole = hashing.mix((prefix[start + count + length - 1] - prefix[start]) * back[start] + count.astype(U))
    return least[start], whole, text, start - offsets[text], count + own


def elders(node: np.ndarray, s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with ``first``, the oldest row that equals them: which rows are the oldest of their document there and have
    none of another before them, and which go. Texts that share a doc_id are of one age; rows that are the same place neither stay
    twice nor go."""
    here = np.arange(len(node))
    if not (s >> TWIN).any():
        return first == here, (node != node[first]) | (s != s[first])
    same = node == node[first]
    at = np.flatnonzero(same)
    order = at[np.lexsort((s[at], s[at] >> TWIN, first[at]))]
    of, twin = first[order], s[order] >> TWIN
    new = np.append(True, (of[1:] != of[:-1]) | (twin[1:] != twin[:-1])) if len(order) else np.zeros(0, bool)
    lead = here.copy()
    lead[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return same & (lead == here), ~same | (s != s[lead])


def combine(g, h, node, s, n) -> Iterator[pa.RecordBatch]:
    """Of equal runs only the earliest goes on; later ones are removals. Digits with many runs are spread."""
    if not len(g):
        return
    order = np.lexsort((s, node, h, g))
    g, h, node, s, n = (x[order] for x in (g, h, node, s, n))
    new = np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]))
    stay, later = elders(node, s, np.flatnonzero(new)[np.cumsum(new) - 1])
    yield batch_of(REMOVE, hashing.mix(h[later] ^ node[later].astype(U)), 0, node[later], s[later], n[later] % SELF + LENGTH - 1)
    g, h, node, s, n = (x[stay] for x in (g, h, node, s, n))
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    many = np.diff(np.append(start, len(g))) > HOT
    hot = np.repeat(many, np.diff(np.append(start, len(g))))
    yield batch_of(SPREAD, hashing.mix(h[hot] ^ node[hot].astype(U)), g[hot], node[hot], s[hot], n[hot] % SELF)
    yield batch_of(MARK, g[start[many]], 0, np.zeros(int(many.sum()), np.int64), 0, 0)
    yield batch_of(COMPARE, g[~hot], h[~hot], node[~hot], s[~hot], n[~hot])


def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (node, twin, text): the runs of each text, combined within the task."""
    held, rows = [], 0
    for batch in batches:
        nodes, twins = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("node", "twin"))
        for a, offsets, data in hashing.text_chunks(batch.column("text"), 1 << 20):
            g, h, text, s, n = windows_by_digit(offsets, data)
            held.append((g, h, nodes[a + text], s + (twins[a + text] << TWIN), n))
            rows += len(g)
            if rows >= COMBINE:
                yield from combine(*map(np.concatenate, zip(*held, strict=True)))
                held, rows = [], 0
    if held:
        yield from combine(*map(np.concatenate, zip(*held, strict=True)))


def settle(kind, g, h, node, s, n) -> Iterator[pa.RecordBatch]:
    """Whole digits in order: equal runs but the earliest are removals; a digit's other runs are compared if there are several."""
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    size = np.diff(np.append(start, len(g)))
    hot = np.repeat(kind[start] == MARK, size)
    new = np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])) & (kind == COMPARE)
    runs = np.repeat(np.add.reduceat(new.astype(np.int64), start), size)
    live = kind == COMPARE
    first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    stay, goes = elders(node, s, first)
    later, stay = live & goes, live & stay
    yield batch_of(REMOVE, 0, 0, node[later], s[later], n[later] % SELF + LENGTH - 1)
    for chosen, what in ((stay & hot, SPREAD), (stay & ~hot & ((runs > 1) | (n >= SELF)), COMPARE)):
        yield batch_of(what, g[chosen], g[chosen], node[chosen], s[chosen], n[chosen] % SELF)


def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over first_pass rows sorted by (g, kind, h, node, s); a digit's rows are held together, of which
    a task of the first pass sends at most HOT."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("kind", "g", "h", "node", "s", "n")]
        done = columns[0] >= REMOVE
        if done.any():
            kind, _, h, node, s, n = (x[done] for x in columns)
            yield batch_of(kind, h, h, node, s, n)
        columns = [x[~done] for x in columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        g = columns[1]
        if not len(g):
            continue
        cut = int(np.searchsorted(g, g[-1], "left")) if g[0] != g[-1] else 0
        if cut:
            yield from settle(*(x[:cut] for x in columns))
        held = [x[cut:] for x in columns]
    if held is not None and len(held[0]):
        yield from settle(*held)


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc_id, node, twin, text): the texts compressed, so that dealing them out is cheap."""
    to = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = pa.array([to.compress(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), batch.column("twin"), packed], ["doc_id", "node", "twin", "packed"])


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (node, packed, runs): the bytes of each run to compare, under its digit; a hot digit's
    windows singly under their own hashes, equal ones of the task combined."""
    of, held, size = zstandard.ZstdDecompressor(), [], 0

    def rows(key, node, s, data, kind):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(x, np.int64)) for x in (key, node, s)] + [pa.array(data, pa.binary()), pa.array(np.full(len(node), kind, np.int32))], ["key", "node", "s", "data", "kind"]
        )

    def spread(held):
        key, node, s = (np.concatenate([x[i] for x in held]) for i in range(3))
        data = [y for x in held for y in x[3]]
        order = np.lexsort((s, node, key))
        key, node, s = key[order], node[order], s[order]
        new = np.append(True, key[1:] != key[:-1])
        stay, later = elders(node, s, np.flatnonzero(new)[np.cumsum(new) - 1])
        yield rows(hashing.mix(key[later] ^ node[later].astype(U)).view(np.int64), node[later], s[later], [b""] * int(later.sum()), REMOVE)
        yield rows(key[stay].view(np.int64), node[stay], s[stay], [data[i] for i in order[stay]], COMPARE)

    for batch in batches:
        out = [], [], [], []
        for node, packed, runs in zip(*(batch.column(k).to_pylist() for k in ("node", "packed", "runs")), strict=True):
            text = of.decompress(packed)
            for run in runs:
                s, n = run["s"], run["n"]
                data = text[s % (1 << TWIN) :][: n + LENGTH - 1]
                if run["kind"] == COMPARE:
                    for x, y in zip(out, (run["g"], node, s, data), strict=True):
                        x.append(y)
                else:
                    raw = np.frombuffer(data, np.uint8)
                    prefix = np.zeros(len(raw) + 1, U)
                    np.cumsum(hashing.byte_values(5)[raw] * hashing.powers(len(raw)), out=prefix[1:])
                    key = hashing.mix((prefix[LENGTH:] - prefix[:-LENGTH]) * hashing.powers(len(raw), hashing.INVERSE)[:n])
                    held.append((key, np.full(n, node), s + np.arange(n), [data[i : i + LENGTH] for i in range(n)]))
                    size += n
            if size >= COMBINE // 4:
                yield from spread(held)
                held, size = [], 0
        if out[0]:
            yield rows(*out, COMPARE)
    if held:
        yield from spread(held)


def repeated(group: np.ndarray, at: np.ndarray, data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For windows ``at`` of ``data`` in order of age, their groups sorted: the place of the oldest equal window of the
    same group. Passes over eight-byte digits, most significant first; a window alone in its class drops out."""
    out = np.arange(len(at))
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.zeros(len(data), U)
    for i in range(8):
        eight |= padded[i : i + len(data)].astype(U) << U(56 - 8 * i)
    live, of = np.arange(len(at)), group.astype(np.int64)
    for depth in range(0, length, 8):
        digit = eight[at[live] + depth]
        if length - depth < 8:
            digit = digit >> U(8 * (8 - length + depth))
        order = np.lexsort((digit, of))
        live, of, digit = live[order], of[order], digit[order]
        new = np.append(True, (of[1:] != of[:-1]) | (digit[1:] != digit[:-1])) if len(live) else np.zeros(0, bool)
        of = np.cumsum(new)
        alone = new & np.append(new[1:], True) if len(live) else new
        live, of = live[~alone], of[~alone]
        if not len(live):
            return out
    new = np.append(True, of[1:] != of[:-1])
    out[live] = live[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def further_passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over contexts rows sorted by (key, node, s): removals (node, s, n)."""

    def rows(node, s, n):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (node, s, n)], ["node", "s", "n"])

    def sort(keys, nodes, starts, datas):
        size = np.array([len(x) for x in datas], np.int64)
        count = size - LENGTH + 1
        row = np.repeat(np.arange(len(datas)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = (np.cumsum(size) - size)[row] + inner
        node, s = np.array(nodes, np.int64)[row], np.array(starts, np.int64)[row] + inner
        key = np.array(keys, np.int64)
        group = np.append(0, np.cumsum(key[1:] != key[:-1]))[row]
        age = np.lexsort((s, node, group))  # runs of one document may overlap those of another row of it
        oldest = repeated(group[age], at[age], np.frombuffer(b"".join(datas), np.uint8))
        node, s = node[age], s[age]
        gone = elders(node, s, oldest)[1]
        node, s = node[gone], s[gone]
        order = np.lexsort((s, node))
        node, s = node[order], s[order]
        new = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (s[1:] > s[:-1] + 1))) if len(s) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(s)) - 1 if len(s) else new
        return rows(node[new], s[new], s[last] - s[new] + LENGTH)

    keys, nodes, starts, datas, size = [], [], [], [], 0
    for batch in batches:
        key, node, s, data, kind = (batch.column(k) for k in ("key", "node", "s", "data", "kind"))
        kind = kind.to_numpy(zero_copy_only=False)
        gone = np.flatnonzero(kind == REMOVE)
        if len(gone):
            yield rows(node.take(pa.array(gone)), s.take(pa.array(gone)), np.full(len(gone), LENGTH))
        left = pa.array(np.flatnonzero(kind == COMPARE))
        for k, x, y, z in zip(*(c.take(left).to_pylist() for c in (key, node, s, data)), strict=True):
            if size >= SORT_BYTES and k != keys[-1]:
                yield sort(keys, nodes, starts, datas)
                keys, nodes, starts, datas, size = [], [], [], [], 0
            keys.append(k)
            nodes.append(x)
            starts.append(y)
            datas.append(z)
            size += len(z)
    if keys:
        yield sort(keys, nodes, starts, datas)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cutter(with_text: bool):
    """For mapInArrow over (doc_id, packed, gone): what is left of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = zstandard.ZstdDecompressor()
        for batch in batches:
            out = [], [], [], [], []
            for packed, gone in zip(batch.column("packed").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                text = of.decompress(packed)
                edge = np.zeros(len(text) + 1, np.int64)
                for x in gone or []:
                    edge[x["s"] % (1 << TWIN)] += 1
                    edge[x["s"] % (1 << TWIN) + x["n"]] -= 1
                dead = np.cumsum(edge)[:-1] > 0
                kept = np.frombuffer(text, np.uint8)[~dead].tobytes()
                spans = int(np.count_nonzero(dead & ~np.append(False, dead[:-1]))) if len(dead) else 0
                for x, y in zip(out, (len(text), int(dead.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                    x.append(y)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    return cut


#: Texts that share a doc_id with another: up to so many are broadcast.
BROADCAST_ROWS = 500_000


def with_twins(keyed: DataFrame) -> DataFrame:
    """``keyed`` (node, text) with ``twin``, the number of the text among the different ones of its node."""
    hashed = keyed.select("node", F.xxhash64("text").alias("h"))
    shared, _ = materialise(hashed.groupBy("node").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("node"), "shared-ids")
    if not shared.limit(1).count():
        return keyed.withColumn("twin", F.lit(0).cast("long"))
    numbered = hashed.join(shared, "node", "left_semi").distinct().withColumn("twin", F.row_number().over(Window.partitionBy("node").orderBy("h")).cast("long"))
    numbered, _ = materialise(numbered, "twins")
    known = F.broadcast(numbered) if numbered.count() <= BROADCAST_ROWS else numbered
    return keyed.withColumn("h", F.xxhash64("text")).join(known, ["node", "h"], "left").withColumn("twin", F.coalesce("twin", F.lit(0).cast("long"))).drop("h")


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text): its bytes, bytes and runs removed, the digest of the rest, and the
    rest itself if asked for (it need not be valid UTF-8: cuts fall between any two bytes)."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    keyed = with_twins(docs.select("doc_id", node_of(F.col("doc_id"), F.md5(raw)).alias("node"), F.coalesce("text", F.lit("")).alias("text")))
    twin = F.shiftrightunsigned("s", TWIN).alias("twin")
    runs = keyed.filter(F.octet_length("text") >= LENGTH).select("node", "twin", "text").mapInArrow(first_pass, FOUND)
    found = runs.repartition("g").sortWithinPartitions("g", "kind", "h", "node", "s").mapInArrow(second_pass, FOUND)
    found, _ = materialise(found, "runs")
    compared = F.collect_list(F.when(F.col("kind") != REMOVE, F.struct("kind", "g", "s", "n")))
    affected, _ = materialise(found.groupBy("node", twin).agg(compared.alias("runs")), "affected")
    texts, _ = materialise(keyed.select("doc_id", "node", "twin", "text").mapInArrow(squeeze, "doc_id long, node long, twin long, packed binary").join(affected, ["node", "twin"]), "texts")
    bytes_of = texts.filter(F.size("runs") > 0).select("node", "packed", "runs").mapInArrow(contexts, "key long, node long, s long, data binary, kind int")
    further = bytes_of.repartition("key").sortWithinPartitions("key", "node", "s").mapInArrow(further_passes, "node long, s long, n long")
    gone = found.filter(F.col("kind") == REMOVE).select("node", "s", "n").unionByName(further)
    gone = gone.groupBy("node", twin).agg(F.collect_list(F.struct("s", "n")).alias("gone"))
    touched = texts.select("doc_id", "node", "twin", "packed").join(gone, ["node", "twin"], "left").select("doc_id", "packed", "gone").mapInArrow(cutter(with_text), RESULT)
    bytes_ = F.encode("text", "UTF-8")
    whole = keyed.select(
        "doc_id", "node", "twin", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(bytes_, 256).alias("kept_sha256"), (bytes_ if with_text else F.lit(None).cast("binary")).alias("kept"),
    ).join(affected.select("node", "twin"), ["node", "twin"], "left_anti").drop("node", "twin")
    return whole.unionByName(touched)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
