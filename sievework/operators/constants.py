"""Constants that code hands to decoders, decoded without running anything: joined literals, chr() runs, pack of hex, and decoders
inside decoders up to ``DEPTH`` deep.

Calls, joined literals and chr() runs are token rows; each round joins the calls whose whole argument the round before has
decoded, so there are as many rounds as a chain may be deep. The decoders themselves run over Arrow batches of those rows, each
output bounded by ``MOST_OUTPUT``, which also stops a decompression bomb.

Cases: what isn't constant, can't be decoded, is empty or too long ends its chain, and the decoded part inside it is what is told;
null and empty texts give nothing.
"""

from __future__ import annotations

import binascii
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators import taint

# Fixed values that findings must agree on.
DECODERS = ("base64_decode", "gzdecode", "gzinflate", "gzuncompress", "hex2bin", "pack", "rawurldecode", "str_rot13", "strrev", "urldecode")
DEPTH, MOST_OUTPUT, LEAST_CHR = 3, 262_144, 8
WORTH = rf"(?i){'|'.join(DECODERS)}|chr\s*\("
SMALL = bytes(range(97, 123))
ROT13 = bytes.maketrans(SMALL + SMALL.upper(), SMALL[13:] + SMALL[:13] + (SMALL[13:] + SMALL[:13]).upper())
VALUE = "path string, n int, close int, value binary, chain array<string>, child int"


def literal(token: str) -> bytes:
    """The bytes of a quoted constant, given as Latin-1 text."""
    body = token[1:-1]
    if token[0] == "'":
        return re.sub(r"\\([\\'])", r"\1", body).encode("latin-1")
    plain = {"n": "\n", "t": "\t", "r": "\r", "v": "\v", "f": "\f", "a": "\a", "b": "\b"}

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        return chr(int(m[2], 8) & 255) if m[2] else plain.get(m[3], m[3])

    return re.sub(r"(?s)\\(?:x([0-9a-fA-F]{1,2})|([0-7]{1,3})|(.))", one, body).encode("latin-1")


def inflated(value: bytes, bits: int) -> bytes | None:
    work = zlib.decompressobj(bits)
    out = work.decompress(value, MOST_OUTPUT + 1)
    return out if work.eof and len(out) <= MOST_OUTPUT else None


def applied(name: str, value: bytes) -> bytes | None:
    """What a decoder makes of a value; None if it can't."""
    if len(value) > MOST_OUTPUT:
        return None
    try:
        if name == "base64_decode":
            packed = re.sub(rb"\s", b"", value)
            if not re.fullmatch(rb"[A-Za-z0-9+/]*={0,2}", packed) or (b"=" in packed and len(packed) % 4) or len(packed.rstrip(b"=")) % 4 == 1:
                return None
            out = binascii.a2b_base64(packed.rstrip(b"=") + b"=" * (-len(packed.rstrip(b"=")) % 4))
        elif name in ("gzinflate", "gzuncompress", "gzdecode"):
            out = inflated(value, {"gzinflate": -15, "gzuncompress": 15, "gzdecode": 31}[name])
        elif name in ("hex2bin", "pack"):
            out = binascii.unhexlify(value + b"0" * (len(value) % 2 if name == "pack" else 0))
        elif name in ("urldecode", "rawurldecode"):
            out = unquote_to_bytes(value.replace(b"+", b" ") if name == "urldecode" else value)
        else:
            out = {"str_rot13": lambda v: v.translate(ROT13), "strrev": lambda v: v[::-1], "": lambda v: v}[name](value)
    except (binascii.Error, zlib.error, ValueError):
        return None
    return out[:MOST_OUTPUT] if out else None


def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (path, n, close, name, parts, value, chain, child): each row's value under its decoder, those that can't be left out."""
    schema = pa.schema([("path", pa.string()), ("n", pa.int32()), ("close", pa.int32()), ("value", pa.binary()), ("chain", pa.list_(pa.string())), ("child", pa.int32())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            value = applied(r["name"], r["value"] if r["parts"] is None else b"".join(map(literal, r["parts"])))
            if value is not None:
                out.append({"path": r["path"], "n": r["n"], "close": r["close"], "value": value, "chain": [*r["chain"], *([r["name"]] if r["name"] else [])], "child": r["child"]})
        yield pa.RecordBatch.from_pylist(out, schema)


def literal_runs(tok: DataFrame) -> DataFrame:
    """(path, n, until, parts): constants and constants joined by dots; ``until`` is the token after them."""
    constant = lambda c: F.coalesce(c.rlike(r"(?s)\A'[^'\\]*+(?:\\.[^'\\]*+)*+'\z") | (c.rlike(r"(?s)\A\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"\z") & ~c.rlike(rf"(?<!\\)(?:\${taint.NAME}|\$\{{|\{{\$)")), F.lit(False))
    order = Window.partitionBy("path").orderBy("n")
    rows = tok.select("path", "n", "t", F.col("next1.n").alias("after"), constant(F.col("t")).alias("string"), constant(F.col("next1.t")).alias("before_string"), F.lag("t", 2).over(order).alias("_two"), "prev")
    joined = (F.col("prev") == ".") & constant(F.col("_two"))
    begins = F.col("string") & ~F.coalesce(joined, F.lit(False))
    dot = (F.col("t") == ".") & constant(F.col("prev")) & F.col("before_string")
    rows = rows.withColumn("run", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter(F.col("string") | dot)
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("string"), F.struct("n", "t")))), lambda x: x["t"])
    return rows.groupBy("path", "run").agg(F.min("n").alias("n"), F.max_by("after", "n").alias("until"), parts.alias("parts")).drop("run")


def chr_runs(tok: DataFrame) -> DataFrame:
    """(path, n, until, close, value): runs of chr(number) joined by dots, long enough to be a text."""
    order = Window.partitionBy("path").orderBy("n")
    at = tok.select("path", "n", "t", "next1", "next2", "next3", F.row_number().over(order).alias("i"), F.lead(F.struct("n", "t"), 4).over(order).alias("next4"))
    number = F.col("next2.t").rlike(r"\A(?:0[xX][0-9a-fA-F]+|0[bB][01]+|[0-9]+)\z")
    term = at.filter((F.lower("t") == "chr") & (F.col("next1.t") == "(") & number & (F.col("next3.t") == ")"))
    code = F.col("next2.t")
    value = F.when(code.rlike("^0[xX]"), F.conv(F.substring(code, 3, 15), 16, 10)).when(code.rlike("^0[bB]"), F.conv(F.substring(code, 3, 60), 2, 10)).when(code.rlike("^0[0-7]+$"), F.conv(F.substring(code, 1, 20), 8, 10)).otherwise(code)
    term = term.withColumns({"code": F.pmod(value.try_cast("long"), F.lit(256)), "k": F.row_number().over(order), "_open": F.lag("next4.t").over(order)})
    breaks = F.sum(F.when(F.col("_open") == ".", 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = term.withColumns({"gap": F.col("i") - 5 * F.col("k"), "breaks": breaks}).groupBy("path", "gap", "breaks")
    text = F.encode(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "code"))), lambda x: F.chr(x["code"])), ""), "ISO-8859-1")
    found = runs.agg(F.min("n").alias("n"), F.max("next3.n").alias("close"), F.max_by("next4.n", "n").alias("until"), F.count(F.lit(1)).alias("terms"), text.alias("value"))
    return found.filter(F.col("terms") >= LEAST_CHR).drop("terms", "gap", "breaks")


def decoded(files: DataFrame, text: str = "text") -> DataFrame:
    """(path, n, line, chain, payload): the outermost constants that decoders, named in their order by ``chain``, make of the code of
    files (path, text); the payload is Latin-1 text."""
    from sievework.plans.snapshots import cut

    tok = cut(taint.tokens(files, text, WORTH))
    if not tok.limit(1).count():
        return files.sparkSession.createDataFrame([], "path string, n int, line int, chain array<string>, payload string")
    name = F.lower("t")
    call = tok.filter(name.isin(*DECODERS) & (F.col("next1.t") == "(")).select("path", "n", "line", name.alias("name"), F.col("next1.n").alias("open"), F.col("next2").alias("first"), F.col("next3.t").alias("second"))
    call = call.join(tok.filter("t = '('").select("path", F.col("n").alias("open"), F.col("end").alias("close")), ["path", "open"]).filter("close IS NOT NULL")
    packed = F.col("first.t").rlike(r"(?i)\A['\"]h\*['\"]\z") & (F.col("second") == ",")
    third = tok.select("path", F.col("n").alias("_first"), F.col("next2.n").alias("_third"))
    call = call.withColumn("_first", F.col("first.n")).join(third, ["path", "_first"]).withColumn("argument", F.when(F.col("name") != "pack", F.col("first.n")).when(packed, F.col("_third")))
    call = cut(call.filter("argument IS NOT NULL").select("path", "n", "line", "name", "argument", "close"))
    none = lambda kind: F.lit(None).cast(kind)
    nothing = F.array().cast("array<string>")
    chars = cut(chr_runs(tok))
    over_literals = call.join(literal_runs(tok).withColumnRenamed("n", "argument"), ["path", "argument"]).filter("until = close").select("path", "n", "close", "name", "parts", none("binary").alias("value"), nothing.alias("chain"), none("int").alias("child"))
    over_chars = call.join(chars.select("path", F.col("n").alias("argument"), "until", "value"), ["path", "argument"]).filter("until = close").select("path", "n", "close", "name", none("array<string>").alias("parts"), "value", F.array(F.lit("chr")).alias("chain"), F.col("argument").alias("child"))
    level = cut(over_literals.unionByName(over_chars).mapInArrow(decode, VALUE))
    levels = [chars.select("path", "n", "close", "value", F.array(F.lit("chr")).alias("chain"), none("int").alias("child")), level]
    following = tok.filter("t = ')'").select("path", F.col("n").alias("inner"), F.col("next1.n").alias("until"))
    for _ in range(DEPTH - 1):
        inner = level.select("path", F.col("n").alias("argument"), F.col("close").alias("inner"), "value", "chain").join(following, ["path", "inner"])
        rows = call.join(inner, ["path", "argument"]).filter("until = close").select("path", "n", "close", "name", none("array<string>").alias("parts"), "value", "chain", F.col("argument").alias("child"))
        level = cut(rows.mapInArrow(decode, VALUE))
        levels.append(level)
    every = reduce(DataFrame.unionByName, levels)
    used = every.filter("child IS NOT NULL").select("path", F.col("child").alias("n"))
    lines = tok.select("path", "n", "line")
    return every.join(used, ["path", "n"], "left_anti").join(lines, ["path", "n"]).select("path", "n", "line", "chain", F.decode("value", "ISO-8859-1").alias("payload"))
