"""Static analysis of source text as joins and expressions: disguise, generated identifiers, decoded payloads, and (in ``taint``)
request input that reaches dangerous calls. Text is only read, never run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import entropy, let, line_of
from sievework.operators import constants, taint

# Fixed values that findings must agree on.
HEADER = r"(?i)Plugin Name\s*:"
PACKAGE = r"@package\s+WordPress\b"
LOADER = r"(?i)(include|require)(_once)?\s*\(?\s*[^;]*['\"][^'\"]*/[^'\"]+\.php['\"]"
ENCODER = r"(?i)Advanced Web Application Framework|Original size:|Encoded size:"
SILENCE = r"(?i)(@?error_reporting\s*\(\s*0\s*\)|ini_set\s*\(\s*['\"]display_errors['\"]\s*,\s*['\"]?(0|off))"
REQUEST = r"\$_(GET|POST|REQUEST|COOKIE|SERVER|FILES)\b|php://input"
PACKAGE_ORIGINS = ("uploads", "mu", "other")
HEADER_LINES, SILENCE_LINES = 20, 5
LEAST_IDENTIFIERS, HIGH_ENTROPY, SOME_GENERATED, MOST_GENERATED = 8, 3.6, 0.4, 0.7
#: Files up to this size are analysed; findings kept of each.
MOST_BYTES, MOST_FINDINGS = 524_288, 10
PAYLOAD_BYTES, PAYLOAD_CODE = 200, r"<\?php|eval\("
#: Analyzers in the order of their evidence; characters of a line kept; identifiers that a reason quotes.
ANALYZERS = ("source_sink", "entropy", "decoder", "disguise")
EXCERPT, LISTED = 160, 5


def gate(files: DataFrame) -> DataFrame:
    """php files that are not known good, have no infected match and are small enough."""
    return files.filter((F.col("kind") == "php") & ~F.col("known_good") & ~F.col("infected") & (F.col("size") < MOST_BYTES))


def located(text: Column, pattern: str, lines: int | None = None) -> Column:
    """1-based line of the first match within the first ``lines`` lines; null without one."""
    within = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n") if lines else text
    at = F.regexp_instr(within, F.lit(pattern))
    return F.when(at > 0, F.length(F.substring(within, F.lit(1), at - 1)) - F.length(F.replace(F.substring(within, F.lit(1), at - 1), F.lit("\n"), F.lit(""))) + 1)


def disguise(text: Column, origin: Column, known_good: Column) -> Column:
    """array<struct<reason,line>> of signs that a file pretends to be something else."""
    header, package = located(text, HEADER), located(text, PACKAGE)
    loader = text.rlike(LOADER)
    encoder = located(text, ENCODER, HEADER_LINES)
    silence = located(text, SILENCE, SILENCE_LINES)
    request = text.rlike(REQUEST)
    found = [
        (header.isNotNull() & (origin == "uploads"), "plugin header in an uploads file", header),
        (header.isNotNull() & (origin == "mu") & ~known_good & ~loader, "plugin header in a must-use plugin", header),
        (package.isNotNull() & origin.isin(*PACKAGE_ORIGINS), "@package WordPress outside core", package),
        (encoder.isNotNull(), "encoder header", encoder),
        (silence.isNotNull() & request, "errors silenced before request input is used", silence),
    ]
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("reason"), line.cast("int").alias("line"))) for c, r, line in found]))


def identifiers(text: Column) -> Column:
    """Distinct names of variables, functions and constants."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"\$([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\bfunction\s+&?([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))))


def generated(name: Column) -> Column:
    """A name that looks made by a program."""
    digits = F.regexp_count(name, F.lit("[0-9]+"))
    return name.rlike("^[O0Il_]{4,}$") | ((F.length(name) >= 10) & (~name.rlike("(?i)[aeiou]") | ((digits >= 3) & name.rlike("[A-Za-z]"))))


def identifier_entropy(names: Column) -> Column:
    """struct(n, entropy, generated, suspicious) of a list of names, which is read once."""

    def measured(names: Column) -> Column:
        n = F.size(names)
        average = F.when(n > 0, F.aggregate(names, F.lit(0.0), lambda acc, x: acc + entropy(x)) / n).otherwise(0.0)
        share = F.when(n > 0, F.size(F.filter(names, generated)) / n).otherwise(0.0)
        return let(F.struct(n.alias("n"), average.alias("entropy"), share.alias("generated")), lambda x: F.struct(
            x["n"].alias("n"), F.round(x["entropy"], 6).alias("entropy"), F.round(x["generated"], 6).alias("generated"),
            ((x["n"] >= LEAST_IDENTIFIERS) & (((x["entropy"] > HIGH_ENTROPY) & (x["generated"] >= SOME_GENERATED)) | (x["generated"] >= MOST_GENERATED))).alias("suspicious"),
        ))

    return let(names, measured)


def evidence(files: DataFrame, rescan=None) -> DataFrame:
    """(path, position, sig_id, category, line, excerpt, reason) of gated files (path, text, origin, known_good): all analyzers in
    their order, at most ``MOST_FINDINGS`` a file. ``rescan`` gives the named matches (path, chunk, sig_id, category) of decoded
    constants (path, chunk, text)."""
    from sievework.plans.snapshots import cut

    def shaped(rows: DataFrame, analyzer: str, category: str, line: Column, reason: Column, sig: Column | None = None) -> DataFrame:
        named = F.lit(f"heur:{analyzer}") if sig is None else sig
        kind = F.col("category") if sig is not None else F.lit(category)
        return rows.select("path", F.lit(ANALYZERS.index(analyzer)).alias("analyzer"), line.cast("int").alias("line"), "n", kind.alias("category"), named.alias("sig_id"), reason.alias("reason"))

    files, text = cut(files.select("path", "text", "origin", "known_good")), F.col("text")
    hits = taint.findings(files)
    found = shaped(hits, "source_sink", "backdoor", F.col("line"), F.col("reason"))
    names = files.select("path", "text", identifiers(text).alias("names")).filter(identifier_entropy(F.col("names"))["suspicious"])
    names = names.select("path", "text", F.lit(0).alias("n"), F.filter("names", generated).alias("made"))
    listed = F.concat(F.lit("obfuscated identifiers: $"), F.array_join(F.slice("made", 1, LISTED), ", $"), F.when(F.size("made") > LISTED, " …").otherwise(""))
    found = found.unionByName(shaped(names, "entropy", "obfuscation", line_of(text, F.instr(text, F.get("made", F.lit(0)))), listed))
    plain = cut(constants.decoded(files))
    chain = F.array_join("chain", "→")
    if rescan is not None and plain.limit(1).count():
        again = rescan(plain.select("path", F.col("n").alias("chunk"), F.col("payload").alias("text"))).select("path", F.col("chunk").alias("n"), "sig_id", "category").distinct()
        found = found.unionByName(shaped(again.join(plain, ["path", "n"]), "decoder", "", F.col("line"), F.concat("sig_id", F.lit(" matched after "), chain, F.lit(" decoding")), F.col("sig_id")))
    code_in = plain.filter((F.length("payload") >= PAYLOAD_BYTES) & F.col("payload").rlike(PAYLOAD_CODE))
    found = found.unionByName(shaped(code_in, "decoder", "obfuscation", F.col("line"), F.concat(F.lit("decoded PHP payload via "), chain)))
    signs = files.select("path", F.posexplode(disguise(text, F.col("origin"), F.col("known_good"))).alias("n", "d"))
    found = found.unionByName(shaped(signs, "disguise", "dropper", F.col("d.line"), F.col("d.reason")))
    order = Window.partitionBy("path").orderBy("analyzer", "line", "n", "sig_id", "reason")
    found = found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= MOST_FINDINGS).join(files.select("path", "text"), "path")
    shown = F.substring(F.trim(F.coalesce(F.get(F.split("text", "\n"), F.col("line") - 1), F.lit(""))), 1, EXCERPT)
    return found.select("path", "position", "sig_id", "category", "line", shown.alias("excerpt"), "reason")
