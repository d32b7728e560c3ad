"""Splitting text into pre-tokens exactly as the byte-level tokenizer libraries do."""

from __future__ import annotations

import regex

#: Characters that the `regex` module classes as the tokenizer libraries do, whatever the Unicode version.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*+\Z")


class _Classes(dict):
    """Stand-ins of one character for the characters whose class may depend on the Unicode version: the class is asked
    of the tokenizer library itself. None of the stand-ins is named by a pattern's literals."""

    def __init__(self):
        import tiktoken

        ranks = {bytes([i]): i for i in range(256)}
        self.ask = [(tiktoken.Encoding("class", pat_str=p, mergeable_ranks=ranks, special_tokens={}), to) for p, to in ((r"\p{L}", "Z"), (r"\p{N}", "1"), (r"\s", "\t"))]

    def __missing__(self, code: int) -> str:
        char = chr(code)
        to = char if code < 128 else next((to for e, to in self.ask if e.encode_ordinary(char)), "!")
        self[code] = to
        return to


class Splitter:
    """Pre-tokens of a text by a pattern over \\p{L}, \\p{N} and \\s."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        self.classes: _Classes | None = None

    def pieces(self, text: str):
        """All pieces in order; an iterator, so that a very long text needs no list of them."""
        if _PLAIN.match(text):
            return (m[0] for m in self.pattern.finditer(text)) if len(text) > 1 << 20 else self.pattern.findall(text)
        self.classes = self.classes or _Classes()
        return (text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.classes)))
