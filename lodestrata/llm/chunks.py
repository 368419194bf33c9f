"""Cutting a text where a byte-level pre-tokenizer always cuts: before a space between two other
non-space characters. No match of its pattern goes over such a place, so the chunks can be worked on
one by one, each distinct chunk once."""

from __future__ import annotations

import re

_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Bytes that a dictionary entry takes besides its texts, about.
_ENTRY = 170


class Kept:
    """Values by text in about `most` bytes, in two generations: when the present one has half of that, it
    becomes the one before, and what that still held is dropped. What is asked for joins the present one."""

    def __init__(self, most: int):
        self.found, self.before, self.most, self.size = {}, {}, most, 0

    def put(self, key: str, value) -> None:
        self.found[key] = value
        self.size += _ENTRY + len(key) + len(value)
        if 2 * self.size > self.most:
            self.before, self.found, self.size = self.found, {}, 0

    def older(self, key: str):
        value = self.before.get(key)
        if value is not None:
            self.put(key, value)
        return value


class Chunks:
    """of(text) gives what make(chunk) returned for each chunk of the text, in order. Results are kept
    in `most` bytes: the first chunk of a text, and the others, which follow a space that is not in
    their key."""

    def __init__(self, make, most: int = 128 << 20):
        self.make, self.first, self.rest = make, Kept(most // 8), Kept(most - most // 8)

    def _get(self, known: Kept, chunks: list, lead: str) -> list:
        out, missing, k = list(map(known.found.get, chunks)), [], -1
        try:
            while True:
                k = out.index(None, k + 1)
                missing.append(k)
        except ValueError:
            pass
        if missing:
            made = {c: known.older(c) for c in dict.fromkeys([chunks[k] for k in missing])}
            new = [c for c, v in made.items() if v is None]
            if any(not c or c[0].isspace() or c[-1].isspace() for c in new):
                return []
            values = self.make([lead + c for c in new]) if new else ()
            for c, v in zip(new, values):
                made[c] = v
                known.put(c, v)
            for k in missing:
                out[k] = made[chunks[k]]
        return out

    def of(self, text: str) -> list:
        if not text:
            return []
        head, *tail = text.split(" ")
        a = self._get(self.first, [head], "")
        b = self._get(self.rest, tail, " ") if a else []
        if len(b) == len(tail) and a:
            return a + b
        return self.make(_CUT.split(text))
