"""Rule packs: small tables of hash, literal, regular-expression and table-row rules with one version."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = ("infected", "suspicious", "info")
ENCODED = ("sig_tier", "regex_flags", "literal_word_counts", "literal_pure")
VECTORS = ("regex_offsets", "regex_sigs", "regex_lits", "regex_lit_offsets", "literal_offsets", "wordless_literals")


class PackError(ValueError):
    """A pack that can't be used."""


@dataclass
class Pack:
    """Rules as Python rows. ``signatures``: (sig, sig_id, name, category, tier). ``literals``: (position, lit, sig, target, text).
    ``regexes``: (position, sig, pattern, first_chunk_only, needed literals, targets). ``hashes``: (kind, hex, sig).
    ``row_rules``: (target, sig, pattern, like). ``allow``: md5, or md5, an O and the size. ``texts``: (lit, text) of the literals that only
    regular expressions need."""

    version: int
    signatures: list[tuple] = field(default_factory=list)
    literals: list[tuple] = field(default_factory=list)
    regexes: list[tuple] = field(default_factory=list)
    hashes: list[tuple] = field(default_factory=list)
    row_rules: list[tuple] = field(default_factory=list)
    allow: list[str] = field(default_factory=list)
    texts: list[tuple] = field(default_factory=list)
    words: list[tuple] = field(default_factory=list)
    pure: list[int] = field(default_factory=list)
    always: list[int] = field(default_factory=list)

    def needed(self) -> list[tuple]:
        """The regular expressions without the literals that always count as present."""
        return [(*r[:4], [x for x in r[4] if x not in self.always], r[5]) for r in self.regexes]

    def literal_texts(self) -> list[tuple]:
        """(lit, text) of every literal that a rule names."""
        return sorted({(lit, text) for _, lit, _, _, text in self.literals} | {tuple(x) for x in self.texts})

    def unread(self) -> list[str]:
        """Patterns that can't be read here; a scan leaves them out and counts them."""
        return readings([r[2] for r in self.regexes] + [r[2] for r in self.row_rules])[2]

    def rule_keys(self) -> dict[str, list[str]]:
        """A key of each literal rule and regular expression, in order: two packs have the same rule if they have its key."""
        ids, texts = {s[0]: s[1] for s in self.signatures}, dict(self.literal_texts())
        key = lambda *x: hashlib.sha256(json.dumps(x).encode()).hexdigest()
        return {
            "literal": [key("literal", ids.get(sig), target, text) for _, _, sig, target, text in self.literals],
            "regex": [key("regex", ids.get(sig), p, bool(first), sorted(targets), sorted(texts.get(x, "") for x in lits)) for _, sig, p, first, lits, targets in self.regexes],
        }

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The rules as tables."""
        return {
            "signature": spark.createDataFrame(self.signatures, "sig int, sig_id string, name string, category string, tier string"),
            "literal": spark.createDataFrame(self.literals, "position int, lit int, sig int, target string, text string"),
            "text": spark.createDataFrame(self.literal_texts(), "lit int, text string"),
            "regex": spark.createDataFrame(self.regexes, "position int, sig int, pattern string, first_only boolean, lits array<int>, targets array<string>"),
            "hash": spark.createDataFrame(self.hashes, "kind string, hex string, sig int"),
            "row_rule": spark.createDataFrame(self.row_rules, "target string, sig int, pattern string, like string"),
            "allow": spark.createDataFrame([(x,) for x in self.allow], "key string"),
        }


def _vector(text: str) -> list[int]:
    raw = base64.b64decode(text)
    if len(raw) % 4:
        raise PackError("a vector isn't of whole numbers")
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def load_pack(path: str, meta_path: str | None = None, sha256: str | None = None, version: int | None = None) -> Pack:
    """Read and check a pack file and its names. Text blobs are cut by byte offsets; patterns are /body/flags."""
    raw = open(path, "rb").read()
    if sha256 and hashlib.sha256(raw).hexdigest() != sha256:
        raise PackError("the checksum differs")
    try:
        data = json.loads(raw)
    except ValueError as e:
        raise PackError(f"not JSON: {e}") from e
    if missing := [k for k in ("version", "sig_tier", "regex_patterns", "literal_strings", "targets", "plain_literals", "hash", "db", "allowlist", *VECTORS) if k not in data]:
        raise PackError(f"missing {missing}")
    if version is not None and data["version"] != version:
        raise PackError(f"version {data['version']} isn't {version}")
    v = {k: _vector(data[k]) for k in VECTORS}
    cut = lambda blob, offsets: [blob.encode("latin-1", "surrogateescape")[a:b] if blob.isascii() else blob.encode()[a:b] for a, b in zip(offsets, offsets[1:])]
    texts = [x.decode("latin-1") for x in cut(data["literal_strings"], v["literal_offsets"])]
    patterns = [x.decode("latin-1") for x in cut(data["regex_patterns"], v["regex_offsets"])]
    flags, tiers = base64.b64decode(data["regex_flags"]) if "regex_flags" in data else bytes(len(patterns)), base64.b64decode(data["sig_tier"])
    targets: dict[int, list[str]] = {}
    for name, at in data["targets"].items():
        for i in _vector(at):
            targets.setdefault(i, []).append(name)
    meta = json.load(open(meta_path)) if meta_path else {}
    names = lambda k, i: meta[k][i] if k in meta else ""
    bits = base64.b64decode(data.get("literal_pure") or "")
    pure = [i for i, bit in enumerate(bits) if bit == 1]
    wordless = set(v["wordless_literals"])
    words = [(word, lit) for word, at in (data.get("words") or {}).items() for lit in _vector(at)]
    return Pack(
        version=int(data["version"]),
        signatures=[(i, names("ids", i) or f"sig:{i}", names("names", i), names("categories", i), TIERS[t - 1]) for i, t in enumerate(tiers)],
        literals=[(i, lit, sig, target, texts[lit]) for i, (lit, sig, target) in enumerate(data["plain_literals"])],
        regexes=[(i, v["regex_sigs"][i], p, bool(flags[i]), v["regex_lits"][v["regex_lit_offsets"][i] : v["regex_lit_offsets"][i + 1]], sorted(targets.get(i, []))) for i, p in enumerate(patterns)],
        hashes=[(kind, hex_, sig) for kind, of in data["hash"].items() for hex_, sig in of.items()],
        row_rules=[(target, *rule) for target, rules in data["db"].items() for rule in rules],
        allow=list(data["allowlist"]),
        texts=list(enumerate(texts)),
        words=words,
        pure=[x for x in pure if x not in wordless],
        always=[x for x in pure if x in wordless],
    )


def java_pattern(pattern: str) -> str | None:
    """A delimited pattern as a Java one if it means the same there, else None: no nested quantified groups, no
    constructs that Java rejects or reads otherwise."""
    body, flags = split_pattern(pattern)
    if re.search(r"\\[KRXGCQEzZAhHvV]|\(\?[R&P0-9(|#>]|\[\[|\[:|\[[^\]\\]*\[|&&|[*+}]\+", body):
        return None
    plain = re.sub(r"\((?:\?:)?[^()*+|{]*\)", "", re.sub(r"\\.", "x", body))  # without escapes and groups of single steps
    if re.search(r"\)[*+{]", plain):  # Java recurses once a turn of such a group, and long texts exhaust its stack
        return None
    if set(flags) - set("ims"):
        return None
    return f"(?d{''.join(sorted(set(flags)))}){body}"


def split_pattern(pattern: str) -> tuple[str, str]:
    """Body and flags of /body/flags."""
    pairs = {"(": ")", "{": "}", "[": "]", "<": ">"}
    if not pattern or pattern[0].isalnum() or pattern[0] == "\\":
        return pattern, ""
    end = pattern.rfind(pairs.get(pattern[0], pattern[0]))
    if end <= 0:
        raise PackError(f"pattern {pattern[:40]!r} has no end")
    return pattern[1:end], pattern[end + 1 :]


#: POSIX classes and escapes of byte sets as the body of a Python class.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7f", "blank": r"\t ", "cntrl": r"\x00-\x1f\x7f", "digit": "0-9", "graph": r"\x21-\x7e", "lower": "a-z", "print": r"\x20-\x7e",
    "punct": r"\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e", "space": r"\t-\r ", "upper": "A-Z", "word": r"\w", "xdigit": "0-9A-Fa-f",
}
SETS = {"h": r"\t \xa0", "v": r"\n\x0b\f\r\x85", "N": r"\n"}
ANCHORS = {"z": r"\Z", "Z": r"(?=\n?\Z)", "A": r"\A", "G": r"\A", "R": r"(?>\r\n|[\n\x0b\f\r\x85])", "K": "(?P<kept_from>)", "e": r"\x1b"}
UNREADABLE = re.compile(r"\(\?(?:R|P>|&|[+-]?\d|\(DEFINE|\([^)\d])|\(\*|\\[XCpP]|\\g(?:\{-|<|')")


def outside(body: str) -> str:
    """A class body for the bytes that the class ``body`` lacks."""
    has = re.compile(f"[{body}]".encode("latin-1"))
    return "".join(f"\\x{i:02x}" for i in range(256) if not has.match(bytes([i])))


def class_part(body: str, i: int) -> tuple[str, int]:
    """The class that starts at ``body[i]`` in Python's terms, and where it ends."""
    out, i = "[", i + 1
    if body[i : i + 1] == "^":
        out, i = "[^", i + 1
    if body[i : i + 1] == "]":
        out, i = out + r"\]", i + 1
    while i < len(body) and body[i] != "]":
        if m := re.compile(r"\[:(\^?)(\w+):\]").match(body, i):
            part = POSIX[m[2]]
            out, i = out + (outside(part) if m[1] else part), m.end()
        elif body.startswith(r"\Q", i):
            end = body.find(r"\E", i)
            end = len(body) if end < 0 else end
            out, i = out + re.escape(body[i + 2 : end]), end + 2
        elif body[i] == "\\":
            c = body[i + 1 : i + 2]
            if m := re.compile(r"\\x\{([0-9a-fA-F]{1,2})\}").match(body, i):
                out, i = out + f"\\x{int(m[1], 16):02x}", m.end()
                continue
            out += SETS[c] if c in "hv" else outside(SETS[c.lower()]) if c in "HV" else r"\x1b" if c == "e" else "" if c == "E" else "\\" + c
            i += 2
        else:
            out, i = out + ("\\" if body[i] in "[&~|" else "") + body[i], i + 1
    if i >= len(body):
        raise PackError(f"class {body[:40]!r} has no end")
    return out + "]", i + 1


def python_pattern(body: str, flags: str = "") -> str:
    """A pattern's body in Python's terms; raises PackError for what Python can't express: recursion, calls, verbs, properties."""
    if UNREADABLE.search(re.sub(r"\\Q.*?(\\E|$)", "", body.replace(r"\\\\", "  "), flags=re.S)) or set(flags) - set("imsxADSUXu"):
        raise PackError(f"pattern {body[:40]!r} can't be read")
    numbered = re.search(r"\\[1-9]|\\g|\(\?\(\d", body)
    out, i, scopes = "", 0, [[]]
    while i < len(body):
        c = body[i]
        if c == "\\":
            nxt = body[i + 1 : i + 2]
            if nxt == "Q":
                end = body.find(r"\E", i)
                end = len(body) if end < 0 else end
                out, i = out + re.escape(body[i + 2 : end]), end + 2
            elif m := re.compile(r"\\x\{([0-9a-fA-F]{1,6})\}").match(body, i):
                if int(m[1], 16) > 255 and "u" not in flags:
                    raise PackError(f"pattern {body[:40]!r} can't be read")
                out, i = out + re.escape(chr(int(m[1], 16))), m.end()
            elif m := re.compile(r"\\g\{?(\d+)\}?").match(body, i):
                out, i = out + f"(?:\\{m[1]})", m.end()
            elif m := re.compile(r"\\(?:k[<{']|g\{)(\w+)[>}']").match(body, i):
                out, i = out + f"(?P={m[1]})", m.end()
            else:
                out += f"[{SETS[nxt]}]" if nxt in ("h", "v") else f"[^{SETS[nxt.lower() if nxt != 'N' else nxt]}]" if nxt in ("H", "V", "N") else "" if nxt == "E" else ANCHORS.get(nxt, "\\" + nxt)
                i += 2
        elif c == "[":
            part, i = class_part(body, i)
            out += part
        elif c == "(":
            if m := re.compile(r"\(\?([imsxJUn]*)(?:-([imsx]+))?\)").match(body, i):  # holds to the end of the group, over its alternatives too
                on = "".join(x for x in m[1] if x in "imsx")
                scopes[-1].append(f"(?{on}{'-' + m[2] if m[2] else ''}:" if on or m[2] else "(?:")
                out, i = out + scopes[-1][-1], m.end()
                continue
            scopes.append([])
            if body.startswith("(?|", i):
                if numbered:
                    raise PackError(f"pattern {body[:40]!r} can't be read")
                out, i = out + "(?:", i + 3
            elif m := re.compile(r"\(\?(?:<(\w+)>|'(\w+)')").match(body, i):
                out, i = out + f"(?P<{m[1] or m[2]}>", m.end()
            else:
                out, i = out + "(", i + 1
        elif c == "|":
            out, i = out + ")" * len(scopes[-1]) + "|" + "".join(scopes[-1]), i + 1
        elif c == ")":
            out, i = out + ")" * (len(scopes.pop()) + 1), i + 1
            if not scopes:
                raise PackError(f"pattern {body[:40]!r} can't be read")
        elif c == "$" and "D" in flags and "m" not in flags:
            out, i = out + r"\Z", i + 1
        else:
            out, i = out + c, i + 1
    out += ")" * len(scopes[0])
    return rf"\A(?:{out})" if "A" in flags else out


def byte_pattern(pattern: str):
    """A delimited pattern compiled over bytes, or over text if it has the flag u. Raises PackError if it can't be."""
    body, flags = split_pattern(pattern)
    bits = 0
    for f in flags:
        bits |= {"i": re.I, "m": re.M, "s": re.S, "x": re.X}.get(f, 0)
    try:
        read = python_pattern(body, flags)
        return re.compile(read, bits) if "u" in flags else re.compile(read.encode("latin-1"), bits)
    except (re.error, KeyError, UnicodeEncodeError, OverflowError, IndexError) as e:
        raise PackError(f"pattern {pattern[:40]!r} can't be read: {e}") from e


def first_match(pattern, data: bytes) -> int:
    """1-based place of the first match in bytes, 0 without one, -1 where the search fails."""
    try:
        if isinstance(pattern.pattern, bytes):
            m = pattern.search(data)
            return 0 if m is None else m.start("kept_from" if "kept_from" in pattern.groupindex else 0) + 1
        text = data.decode()
        m = pattern.search(text)
        return 0 if m is None else len(text[: m.start("kept_from" if "kept_from" in pattern.groupindex else 0)].encode()) + 1
    except (RecursionError, MemoryError, UnicodeDecodeError):
        return -1


def readings(patterns: list[str]) -> tuple[dict[str, str], set[str], list[str]]:
    """How patterns are read: those that mean the same in Java, by their Java form; those for the byte matcher; and those that
    nothing here can read, which a scan leaves out and counts."""
    java, other, unread = {}, set(), []
    for p in dict.fromkeys(patterns):
        try:
            byte_pattern(p)
        except PackError:
            unread.append(p)
            continue
        if read := java_pattern(p):
            java[p] = read
        else:
            other.add(p)
    return java, other, unread


def new_signatures(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signatures of ``new`` whose id ``old`` lacks."""
    return new.join(old.select("sig_id"), "sig_id", "left_anti")
