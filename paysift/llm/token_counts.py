"""Count-only Viterbi: pieces of the best unigram segmentation, without building it.

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at a position;
dynamic programming carries the best score and, with it, the number of pieces. Tie rules are
those of the Unigram model of the tokenizers library: starts are tried in order and only a
strictly better score replaces a path, so of paths with equal scores the one whose last piece
is longest wins; a character without a piece of its own may be taken as unknown at
``least score - 10``, and with byte fallback it counts as its UTF-8 bytes.

Scores add up in double precision. A text is counted run by run (spaces and the word after
them; a line feed where no longer piece holds one), which is exact since no piece crosses such
a cut. Counts of runs are remembered in a table of at most ``REMEMBER`` entries per task.

Defined cases: null and empty text have 0 tokens; a run of any length is walked once, holding
two numbers per character; null doc_id and repeated rows are counted as they come; an empty
table gives an empty result; columns beyond doc_id and text are ignored. The model file's
pieces and scores are taken as a unigram vocabulary also when the file was trained for BPE.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepiece_model import BYTE, NORMAL, SPACE, Model, read_model

REMEMBER = 300_000
UNKNOWN_PENALTY = 10.0  # fixed value of the tie rules
_NONE = (float("-inf"), 0)


class Counter(dict):
    """Run of text -> number of pieces; filled as runs are met."""

    def __init__(self, model: Model):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        least, self.single = 0.0, set()
        for piece, score, kind in model.pieces:
            if kind == NORMAL and piece:
                self.automaton.add_word(piece, (len(piece), score))
                least = min(least, score)
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = least - UNKNOWN_PENALTY
        self.bytes = model.byte_fallback and sum(kind == BYTE for _, _, kind in model.pieces) == 256
        self.prefix = SPACE if model.add_dummy_prefix else ""
        line = "" if any("\n" in p and len(p) > 1 for p, _, kind in model.pieces if kind == NORMAL) else "\n"
        self.runs = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + ("|\n" if line else "") if model.splits_at_space() else r"(?s).+")

    def __missing__(self, run: str) -> int:
        n = len(run)
        best, count = [0.0] + [_NONE[0]] * n, [0] * (n + 1)
        fused = [False] * (n + 1)  # whether the best path ends in an unknown character
        end, here = 0, []
        for last, found in [*self.automaton.iter(run), (n, None)]:
            while end <= last and end < n and (end < last or found is None):
                self._settle(run, end, here, best, count, fused)
                here, end = [], end + 1
            here.append(found)
        self[run] = count[n]
        return count[n]

    def _settle(self, run: str, end: int, found: list, best: list, count: list, fused: list) -> None:
        """The best path that ends behind the character at ``end``; longer pieces come first."""
        to = end + 1
        for size, score in sorted(found, reverse=True):
            path = best[to - size] + score
            if path > best[to]:
                best[to], count[to], fused[to] = path, count[to - size] + 1, False
        char = run[end]
        if char not in self.single:
            path = best[end] + self.unknown
            if path > best[to]:
                best[to], fused[to] = path, True
                pieces = len(char.encode("utf-8", "surrogatepass")) if self.bytes else int(not fused[end])
                count[to] = count[end] + pieces

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        if len(self) > REMEMBER:
            self.clear()
        return sum(map(self.__getitem__, self.runs.findall(self.prefix + text.replace(" ", SPACE))))


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(read_model(path))
        for batch in batches:
            texts = batch.column("text")
            n = np.fromiter((counter.tokens(x.as_py() or "") for x in texts), np.int64, len(texts))
            chars = np.fromiter((len(x.as_py() or "") for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(chars)], names=["doc_id", "n_tokens", "n_chars"])

    return run


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, n_chars of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _run(model_path), "doc_id long, n_tokens long, n_chars long")
