"""Splitting texts into chunks, and the test of a chunk's worth.

A chunk has at most a given number of characters. Cuts fall at the strongest boundary that lies within
reach: runs of line ends (the longer ones first, as far as ``LINE_ENDS`` of them), the end of a sentence, a
blank, the end of a grapheme (a letter and its marks, an emoji and what joins it), or, where one grapheme alone is longer, between any
two characters. Of boundaries of one strength the last within reach is taken. Blanks around a chunk are cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends in a run that are told apart; more count like so many.
LINE_ENDS = 4
#: From strong to weak: what ends a piece of text, and the blanks behind it, at whose end the next piece begins.
_LEVELS = [regex.compile(rf"()[^\S\n]*(?:\n[^\S\n]*){{{n},}}") for n in range(LINE_ENDS, 0, -1)] + [regex.compile(r"""([.!?…]["')\]]*)\s+"""), regex.compile(r"()\s+"), regex.compile(r"(\X)")]

#: Bytes of the shortest chunk, marks counted against letters, marks that spoil a chunk.
MIN_BYTES, LETTERS_A_MARK = 40, 3
MARKUP = r"[<>/\\]"
SPOILERS = ("<EOS>", "<pad>", "<unk>")


def _cut(text: str, at: int, stop: int) -> tuple[int, int]:
    """End of the chunk that begins at a place, `stop` at most, and where to look for the next one."""
    for level in _LEVELS:
        found = None
        for m in level.finditer(text, at, min(len(text), stop + 1)):
            if m.end(1) > stop:
                break
            if m.end(1) > at:  # the blanks of a boundary may stand beyond the limit, as they are cut off
                found = m.end(1), m.end()
        if found:
            return found
    return stop, stop


def chunks(text: str, size: int) -> list[str]:
    """The text in chunks of at most `size` characters; nothing but blanks is lost."""
    if size < 1:
        raise ValueError("a chunk has at least one character")
    out, at, end = [], 0, len(text.rstrip())
    while True:
        while at < end and text[at].isspace():
            at += 1
        if at >= end:
            return out
        if end - at <= size:
            out.append(text[at:end])
            return out
        stop, after = _cut(text, at, at + size)
        out.append(text[at:stop].rstrip())
        at = after


def chunk_column(text: Column, size: int) -> Column:
    """The chunks of a text column as an array, by an Arrow-batched function."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: chunks(t, size) if t is not None else [])

    return split(text)


#: The characters of the Unicode property White_Space.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without blanks of any script at either end."""
    return F.btrim(text, F.lit(_BLANKS))


def is_valid_chunk(text: Column) -> Column:
    """Whether a chunk is long enough, mostly letters and free of model marks; built-in functions only."""

    def valid(t: Column) -> Column:
        marks = F.length(t) - F.length(F.translate(t, "<>/\\", ""))
        # Texts without such marks need no count of their letters.
        ok = (F.octet_length(t) >= MIN_BYTES) & F.when(marks == 0, F.lit(True)).otherwise(marks <= F.floor(F.regexp_count(t, F.lit(r"\p{IsAlphabetic}")) / LETTERS_A_MARK))
        for mark in SPOILERS:
            ok = ok & ~F.contains(t, F.lit(mark))
        return ok

    # Inside an array of one, the text is trimmed once and not for each use.
    return F.element_at(F.transform(F.array(trimmed(text)), valid), 1)
