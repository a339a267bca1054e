"""A sequential scan of one file at a time over its bytes: what the engine's joins and windows must agree with."""

from __future__ import annotations

import re

from sievework.sources.files import CHUNK, OVERLAP
from sievework.sources.pack import Pack, PackError, byte_pattern, first_match

QUOTA = 10


class Sequential:
    """One file at a time."""

    def __init__(self, pack: Pack, chunk: int = CHUNK, overlap: int = OVERLAP, quota: int = QUOTA):
        self.chunk, self.stride, self.overlap, self.quota = chunk, chunk - overlap, overlap, quota
        self.tier = {s[0]: s[4] for s in pack.signatures}
        self.regexes = []
        for p, sig, pattern, first, lits, targets in pack.regexes:
            try:
                self.regexes.append((p, sig, byte_pattern(pattern), first, set(lits), set(targets)))
            except PackError:
                pass
        self.literals = [(p, sig, target, text.encode("latin-1").lower(), lit) for p, lit, sig, target, text in pack.literals]
        self.texts = {lit: text.encode("latin-1").lower() for lit, text in pack.literal_texts()}
        self.words, self.pure, self.always = {}, set(pack.pure), set(pack.always)
        for word, lit in pack.words:
            self.words.setdefault(lit, set()).add(word.encode())

    def present(self, low: bytes) -> set[int]:
        """Literals that count as present for the regular expressions."""
        tokens = set(re.findall(rb"[a-z0-9_]+", low))
        return self.always | {lit for lit, text in self.texts.items() if self.words.get(lit, set()) <= tokens and (text in low or (lit in self.pure and lit in self.words))}

    def scan(self, content: bytes, targets: set[str], hash_infected: int = 0) -> list[tuple]:
        """((layer, chunk, position, sig, offset, line), ...)."""
        out, infected = [], hash_infected
        last: dict[int, int] = {}
        line_base = 0
        for index, offset in enumerate(range(0, max(1, len(content) - self.overlap if len(content) > self.chunk else 1), self.stride)):
            data = content[offset : offset + self.chunk]
            low, now = data.lower(), {}

            def add(layer, position, sig, at, data=data, index=index, offset=offset, now=now):
                if index and at < self.overlap and last.get(sig, -1) >= offset:
                    return False
                now[sig] = max(now.get(sig, -1), offset + at)
                out.append((layer, index, position, sig, offset + at, line_base + data.count(b"\n", 0, at) + 1))
                return True

            present = self.present(low)
            for position, sig, target, text, lit in self.literals:
                if target in targets and text in low and add(1, position, sig, low.find(text)):
                    infected += self.tier[sig] == "infected"
            limit, mine = max(1, self.quota - infected), 0
            for position, sig, pattern, first, lits, of in self.regexes:
                if (first and index) or not of & targets or not lits <= present or (infected + mine and self.tier[sig] == "suspicious"):
                    continue
                at = first_match(pattern, data)
                if at > 0 and add(2, position, sig, at - 1) and self.tier[sig] == "infected":
                    mine += 1
                    if mine >= limit:
                        break
            infected += mine
            if infected >= self.quota:
                break
            last = now
            line_base += data.count(b"\n", 0, self.stride)
        return out


def excerpt(content: bytes, at: int) -> str:
    start = max(0, at - 80)
    return "".join(chr(c) if c in (9, 10) or 32 <= c < 127 else "?" for c in content[start : start + 240])


def scan_all(files: dict[str, bytes], targets: dict[str, set[str]], pack: Pack, hash_infected: dict[str, int] | None = None) -> list[tuple]:
    """(path, layer, position, sig, pos, line, excerpt) of every match of every file."""
    of = Sequential(pack)
    return sorted(
        (path, layer, position, sig, at + 1, line, excerpt(content, at))
        for path, content in files.items() for layer, _, position, sig, at, line in of.scan(content, targets[path], (hash_infected or {}).get(path, 0))
    )
