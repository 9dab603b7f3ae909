"""Token counts under a unigram vocabulary, without making tokens.

An Aho-Corasick automaton of all pieces finds every match in a segment; dynamic programming over its
places carries the best score and the number of pieces of the path that has it. No ids, no
backtracking. A segment is a blank-marked word as the Metaspace splitting makes them; each distinct
one is counted once and kept in a memo of bounded size.

The rules are those of the tokenizers library's Unigram model, ties included: of paths of equal score
to a place, the one whose last piece is longest wins. A character that is no piece costs the least
score of the vocabulary less 10; a run of such characters is one unknown piece, or with byte
fallback as many pieces as it has bytes.

Defined results. Null and empty texts have 0 tokens. Equal texts have equal counts. A text without blanks is one
segment, whose tables are a window of fixed size. Null and repeated doc_ids are kept as they are, an
empty table makes no rows, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm._shared import arrow_batches

#: Fixed by the library: the mark of a word's start, and the penalty of an unknown character.
MARK, PENALTY = "▁", 10.0
#: Segments that a worker remembers, characters of those that it does, and the vocabulary file of the query.
MEMO, MEMO_CHARS, VOCABULARY = 400_000, 32, "piece_bpe_32k.model"
#: Places of a segment whose results are kept at once, besides those that a piece can reach back to.
WINDOW = 4096


class Counter:
    """Counts the pieces of the best path through each segment."""

    def __init__(self, vocabulary: Sequence[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.fallback = byte_fallback and all(f"<0x{b:02X}>" in {p for p, _ in vocabulary} for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.reach = max((len(p) for p, _ in vocabulary), default=1)
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        self.memo: dict[str, tuple[int, int]] = {}

    def segment(self, s: str) -> tuple[int, int]:
        """(pieces, unknown characters) of one segment; holds a window of its places only."""
        best, pieces, missing, open_run, base = [0.0], [0], [0], [False], 0
        single, unknown, most = self.single, self.unknown, WINDOW + 2 * self.reach
        matches = iter(self.automaton.iter(s))
        coming = next(matches, None)
        for end, char in enumerate(s):
            top, of = -math.inf, -1
            while coming is not None and coming[0] == end:  # the longest first, as failure links go from long to short
                length, score = coming[1]
                at = end + 1 - length - base
                value = score + best[at]
                if value > top:
                    top, of = value, at
                coming = next(matches, None)
            if char not in single and (of < 0 or unknown + best[-1] > top):
                pieces.append(pieces[-1] + (len(char.encode("utf-8", "surrogatepass")) if self.fallback else not open_run[-1]))
                missing.append(missing[-1] + 1)
                best.append(unknown + best[-1])
                open_run.append(True)
            else:
                pieces.append(pieces[of] + 1)
                missing.append(missing[of])
                best.append(top)
                open_run.append(False)
            if len(best) > most:
                for table in (best, pieces, missing, open_run):
                    del table[: WINDOW + self.reach]
                base += WINDOW + self.reach
        return pieces[-1], missing[-1]

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, unknown characters) of a text."""
        if not text:
            return 0, 0
        text = text.replace(" ", MARK)
        words = (text[1:] if text[0] == MARK else text).split(MARK)
        memo, total, missing = self.memo, 0, 0
        for w in words:
            got = memo.get(w)
            if got is None:
                if len(memo) >= MEMO:
                    memo.clear()
                got = self.segment(MARK + w)
                if len(w) <= MEMO_CHARS:
                    memo[w] = got
            total += got[0]
            missing += got[1]
        return total, missing


def zipf_vocabulary(name: str = VOCABULARY) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file with log probabilities that fall with their rank by Zipf's law.

    The public file holds merge ranks and no probabilities; this rule makes a unigram vocabulary of it
    without training.
    """
    import sentencepiece

    if not os.path.isabs(name):
        import public_tokenizers

        name = str(public_tokenizers.path(name))
    model = sentencepiece.SentencePieceProcessor(model_file=name)
    total = math.log(sum(1 / (i + 10) for i in range(model.get_piece_size())))
    return [(model.id_to_piece(i), -math.log(i + 10) - total) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def counter(name: str) -> Counter:
    return Counter(zipf_vocabulary(name), True)


def counts(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_chars, n_tokens, n_unknown (characters that are no piece)."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(vocabulary)
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            got = [known.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["doc_id", "n_chars", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, n_unknown long")
