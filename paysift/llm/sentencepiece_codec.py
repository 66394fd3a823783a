"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed and rebuilt as a ``tokenizers`` pipeline: normaliser (character
map, extra white space, dummy prefix, space marker), a cut before every run of space markers
(exact, as no piece crosses it), the piece scores as a Unigram model or, for a BPE file, as
merges in the order in which the scores allow them, byte fallback, and the inverse as decoder.
A text is taken as runs (spaces and the word behind them; line feeds, which no longer piece
holds, stand alone), which is exact for the same reason. The distinct runs of a batch that the
worker has not met yet are encoded on several threads, joined by line feeds, and held against
the sentencepiece library (``parity``); a table of at most ``REMEMBER`` runs keeps the results.
Every document's joined ids are decoded, and ``round_trip`` holds this text against the
document's. Models whose normaliser looks across words (a character map, extra white space) or
that have no byte fallback take the whole text as one run.

Ties between merges of one score go to the leftmost pair; since merging proceeds from the left
there, the pair with the longer left side is the leftmost one.

Defined cases: null and empty text have no ids and decode to the empty text; a text whose
decoding differs from it (a literal space marker) has ``round_trip`` false; repeated rows and
null doc_id are encoded as they come; an empty table gives an empty result; columns beyond
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .marks import KEPT, trimmed
from .sentencepiece_model import BPE, BYTE, NORMAL, SPACE, UNIGRAM, Model, read_model
from .words import parts

REMEMBER = 500_000
LONG_RUN = 256  # longer runs aren't remembered
BATCH_CHARS = 2_000_000
JOINED = 200  # runs that are encoded in one string


def _merges(model: Model) -> list[tuple[str, str]]:
    score = {p: s for p, s, kind in model.pieces if kind == NORMAL}
    made = [(-s, -k, p[:k], p[k:]) for p, s in score.items() for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
    return [(left, right) for _, _, left, right in sorted(made)]


def build(model: Model, first: bool = True):
    """The tokenizer of ``model``; ``first``: for the beginning of a text (with dummy prefix)."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind not in (UNIGRAM, BPE) or any(kind not in (1, 2, 3, 6) for _, _, kind in model.pieces):
        raise ValueError("only Unigram and BPE models without user-defined pieces can be rebuilt")
    if not model.escape_whitespaces:
        raise ValueError("models that keep white space unmarked can't be rebuilt")
    unk = model.pieces[model.unk_id][0]
    if model.kind == UNIGRAM:
        # Control and byte pieces never match text: no text path prefers this score.
        low = min(s for _, s, kind in model.pieces if kind == NORMAL)
        vocab = [(p, s if kind == NORMAL else low - 1e6) for p, s, kind in model.pieces]
        tok = Tokenizer(models.Unigram(vocab, model.unk_id, model.byte_fallback))
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        tok = Tokenizer(models.BPE(vocab, _merges(model), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(first, False), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix and first:
        steps.append(normalizers.Prepend(SPACE))
    tok.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    if model.splits_at_space():
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    tok.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(),
                                     *([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])])
    return tok


class Codec:
    """Encoder and decoder of one model file; made once in each Python worker."""

    def __init__(self, path: str, threads: int = 2):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        model = read_model(path)
        line = [k for k, (piece, _, kind) in enumerate(model.pieces) if kind == BYTE and piece == "<0x0A>"]
        self.by_run = bool(line) and model.byte_fallback and model.splits_at_space() and not (
            model.charsmap or model.remove_extra_whitespaces or any("\n" in p for p, _, kind in model.pieces if kind == NORMAL))
        self.threads = threads
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokenizer = build(model, first=not self.by_run)
        self.runs = re.compile(f"[ {SPACE}]*[^ {SPACE}\n]+|[ {SPACE}]+|\n" if self.by_run else r"(?s).+")
        # Before a text stands the dummy prefix.
        self.lead = " " if self.by_run and model.add_dummy_prefix else ""
        self.line = line[0] if line else -1
        self.ids: dict[str, bytes] = {}  # little-endian 32-bit integers
        self.wrong: set[str] = set()  # runs whose ids the library doesn't give

    def _learn_texts(self, texts: list[str]) -> None:
        """Whole texts as runs."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        for text, own, other in zip(texts, ids, self.reference.encode(texts, num_threads=self.threads), strict=True):
            self._keep(text, np.array(own, dtype="<i4").tobytes(), own == other)

    def _learn(self, runs: list[str]) -> None:
        """Each string holds ``JOINED`` runs behind a line feed each, so that a run's ids lie
        between two ids of the line feed."""
        parts = [runs[k:k + JOINED] for k in range(0, len(runs), JOINED)]
        joined = ["\n" + "\n".join(part) for part in parts]
        ids = [np.array(e.ids, dtype="<i4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        for part, own, other in zip(parts, ids, self.reference.encode(joined, num_threads=self.threads), strict=True):
            other = np.array(other, dtype="<i4")[len(self.lead):]  # the dummy prefix stands alone before the line feed
            good = np.array_equal(own, other)
            mine, theirs = self._between(own), self._between(other)
            for k, run in enumerate(part):
                self._keep(run, mine[k], good or (k < len(theirs) and mine[k] == theirs[k]))

    def _between(self, ids: np.ndarray) -> list[bytes]:
        cut, raw = [*np.flatnonzero(ids == self.line).tolist(), len(ids)], ids.tobytes()
        return [raw[4 * a + 4:4 * b] for a, b in zip(cut, cut[1:], strict=False)]

    def _keep(self, run: str, ids: bytes, good: bool) -> None:
        self.ids[run] = ids
        if not good:
            self.wrong.add(run)

    def decode(self, ids: list[bytes]) -> list[str]:
        """The texts of whole documents' ids."""
        return self.tokenizer.decode_batch([np.frombuffer(x, dtype="<i4").tolist() for x in ids], skip_special_tokens=False)

    def encode(self, texts: list[str]) -> list[tuple[bytes, str, bool]]:
        """(ids, decoded text, parity) of each text."""
        if len(self.ids) > REMEMBER:
            self.ids, self.wrong = {}, set()
        if self.by_run and not self.ids:
            self.ids = {"\n": np.array([self.line], dtype="<i4").tobytes()}
            self.wrong = set()
        split = [self.runs.findall(self.lead + t) if t else [] for t in texts]
        new = list(set().union(*split).difference(self.ids))
        if new:
            (self._learn if self.by_run else self._learn_texts)(new)
        ids = [b"".join(map(self.ids.__getitem__, runs)) for runs in split]
        out = [(own, back, not self.wrong or self.wrong.isdisjoint(runs)) for own, back, runs in zip(ids, self.decode(ids), split, strict=True)]
        for run in new:
            if len(run) > LONG_RUN:
                del self.ids[run]
                self.wrong.discard(run)
        return out

    def expected(self, texts: list[str]) -> list[np.ndarray]:
        """What the sentencepiece library gives for whole texts."""
        return [np.array(x, dtype=np.int32) for x in self.reference.encode(texts, num_threads=self.threads)]


@lru_cache(maxsize=2)
def codec_of(path: str, threads: int) -> Codec:
    """One codec for all tasks of a worker, with the runs that it has met."""
    return Codec(path, threads)


KEPT["sentencepiece"] = codec_of


def _batches(texts: list[str], size: int = BATCH_CHARS) -> Iterator[slice]:
    begin = total = 0
    for k, text in enumerate(texts):
        if total and total + len(text) > size:
            yield slice(begin, k)
            begin, total = k, 0
        total += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def _run(path: str, threads: int, full: bool, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, threads)
        for batch in (part for whole in batches for part in parts(whole, "text")):
            names, texts = batch.column("doc_id"), batch.column("text")
            for part in _batches([x.as_py() or "" for x in texts]):
                own = [x.as_py() or "" for x in texts[part.start:part.stop]]
                made = codec.encode(own)
                n = np.array([len(ids) // 4 for ids, _, _ in made], dtype=np.int64)
                columns = [
                    names[part.start:part.stop], pa.array(n),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _, _ in made]),
                    pa.array([text == back for text, (_, back, _) in zip(own, made, strict=True)], pa.bool_()),
                    pa.array([good for _, _, good in made], pa.bool_()),
                ]
                labels = ["doc_id", "n_tokens", "ids_sha256", "round_trip", "parity"]
                if full:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids for ids, _, _ in made), dtype="<i4"))),
                                pa.array([back for _, back, _ in made], pa.string())]
                    labels += ["input_ids", "decoded"]
                columns += [batch.column(f"carried_{c}")[part.start:part.stop] for c in carry]
                labels += [f"carried_{c}" for c in carry]
                yield pa.RecordBatch.from_arrays(columns, names=labels)

    return run


def encode_documents(docs: DataFrame, model_path: str, threads: int = 2, full: bool = True, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (hex digest of the ids as little-endian 32-bit integers),
    round_trip, parity and, unless ``full`` is false, input_ids and the decoded text; then the
    columns of ``docs`` named in ``carry``."""
    carry = carry or []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *(F.col(c).alias(f"carried_{c}") for c in carry))
    schema = "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean"
    if full:
        schema += ", input_ids array<int>, decoded string"
    kinds = dict(rows.dtypes)
    schema += "".join(f", `carried_{c}` {kinds[f'carried_{c}']}" for c in carry)
    out = rows.mapInArrow(trimmed(_run(model_path, threads, full, carry), keep="sentencepiece"), schema)
    return out.withColumnsRenamed({f"carried_{c}": c for c in carry})
