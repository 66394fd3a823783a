"""Byte-level BPE encoding and decoding on the tokenizers library.

A rank file (base64 token and rank a line) becomes a ``tokenizers`` BPE model: every byte stands
for one printable character, each token's merge is the pair of lower-ranked tokens that merging
its bytes ends in, and the pattern's matches are encoded separately, a match that is a token
itself at once. This gives tiktoken's ids where each token of more than one byte is reached by
merges of lower rank only, which is checked when the file is read.

Offsets come from the ids: token lengths add up to byte places, and the text's byte-to-character
map turns these into code points. A token that holds a part of a character spans the whole of it.
Decoding reverses the byte table. A character whose bytes lie in several tokens appears when its
last byte does; bytes that are no character (ids cut inside one) become U+FFFD in the text and
stay as they are in the bytes.

With PATTERN, the distinct matches of a batch that the worker hasn't met yet are encoded by the
library, and a table of at most ``REMEMBER`` matches keeps their ids. The matches are found by the
``regex`` module in texts whose characters it files as the library does; the others, and every
text of another pattern, go through the library whole. Texts longer than ``PART`` characters are
cut where PATTERN ends a match in any case: behind a letter, before white space, a digit or a
mark. A single longer match stays whole.

Defined cases: null and empty text have no ids and decode to empty; null ids decode to empty; an
id that the file doesn't hold is an error; repeated rows and null doc_id are encoded as they
come; an empty table gives an empty result; columns beyond doc_id and text (input_ids) are
ignored.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the published pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PART = 1 << 18
BATCH_CHARS = 1 << 20
REMEMBER = 1_000_000
LONG_MATCH = 64  # longer matches aren't remembered
_CUT = re.compile(r"(?<=[A-Za-zぁ-ゖァ-ヺ一-龥가-힣])"
                  r"(?=[\s0-9!-/:-@、。！，？])")


def byte_table() -> dict[int, str]:
    """The character of each byte: itself where it is printable, else the next one from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file) if token}


def _merge(ranks: dict[bytes, int], token: bytes) -> tuple[bytes, bytes]:
    """The two tokens that merging ``token`` by lower ranks than its own ends in."""
    parts, limit = [token[k:k + 1] for k in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, k = min((ranks.get(a + b, limit), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= limit:
            raise ValueError(f"token {limit} isn't reached by merges of lower rank")
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    if any(p not in ranks or ranks[p] >= limit for p in parts):
        raise ValueError(f"token {limit} isn't made of tokens of lower rank")
    return parts[0], parts[1]


def build(ranks: dict[bytes, int], pattern: str | None = PATTERN):
    """The ``tokenizers`` pipeline of a rank file; without a pattern, a text is one match."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_table()
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"no token for the bytes {missing}")

    def chars(token: bytes) -> str:
        return "".join(map(table.__getitem__, token))

    merges = [tuple(map(chars, _merge(ranks, t))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    tok = Tokenizer(models.BPE({chars(t): rank for t, rank in ranks.items()}, merges, ignore_merges=True))
    steps = [pre_tokenizers.Split(Regex(pattern), "isolated")] if pattern else []
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        *steps, pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
    return tok


def _is_text(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


def _covered(split, text: str) -> set[int]:
    return {k for _, (a, b) in split.pre_tokenize_str(text) for k in range(a, b)}


@lru_cache(maxsize=1)
def _matcher():
    """PATTERN for the ``regex`` module, and for every code point whether it files it unlike the
    library."""
    import regex
    from tokenizers import Regex, pre_tokenizers

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, odd = "".join(map(chr, points)), set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        other = r"\S" if kind == r"\s" else kind.replace("p", "P")
        library = _covered(pre_tokenizers.Split(Regex(f"{other}+"), "removed"), text)
        odd |= library ^ {k for m in regex.finditer(f"{kind}+", text) for k in range(*m.span())}
    table = np.zeros(0x110000, dtype=bool)
    table[[points[k] for k in odd]] = True
    return regex.compile(PATTERN), table


def has_odd(text: str) -> bool:
    return not text.isascii() and bool(_matcher()[1][np.frombuffer(text.encode("utf-32-le"), dtype="<u4")].any())


def parts_of(text: str, size: int = PART) -> list[str]:
    """``text`` in parts of about ``size`` characters, cut between two matches of PATTERN."""
    parts, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        parts.append(text[at:cut.start()])
        at = cut.start()
    return [*parts, text[at:]] if at < len(text) else parts


class Codec:
    """Encoder and decoder of one rank file; made once in each Python worker."""

    def __init__(self, path: str, pattern: str = PATTERN, threads: int = 2):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        ranks = read_ranks(path)
        self.tokenizer = build(ranks, pattern)
        self.by_match = pattern == PATTERN
        self.single = build(ranks, None) if self.by_match else None
        back = {c: b for b, c in byte_table().items()}
        self.tokens = {k: bytes(map(back.__getitem__, token)) for token, k in self.tokenizer.get_vocab().items()}
        # Matches that are tokens, the common words; the table of the others starts from them.
        self.own = {t.decode(): array("i", [k]).tobytes() for k, t in self.tokens.items() if _is_text(t)}
        self.ids = dict(self.own)
        self.lengths = np.zeros(max(self.tokens) + 1, dtype=np.int64)
        self.lengths[list(self.tokens)] = [len(t) for t in self.tokens.values()]

    def _by_library(self, tokenizer, texts: list[str]) -> list[bytes]:
        out = []
        for part in _batches(texts):
            out += [array("i", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts[part], add_special_tokens=False)]
        return out

    def _by_matches(self, texts: list[str]) -> list[bytes]:
        """The ids of parts without odd characters."""
        if len(self.ids) > REMEMBER:
            self.ids = dict(self.own)
        matches = _matcher()[0]
        split = [matches.findall(t) for t in texts]
        new = list(set().union(*split).difference(self.ids))
        self.ids.update(zip(new, self._by_library(self.single, new), strict=True))
        out = [b"".join(map(self.ids.__getitem__, found)) for found in split]
        for match in new:
            if len(match) > LONG_MATCH:
                del self.ids[match]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [parts_of(t) if self.by_match else [t] for t in texts]
        parts = [p for ps in cut for p in ps]
        plain = [self.by_match and not has_odd(p) for p in parts]
        table = iter(self._by_matches([p for p, x in zip(parts, plain, strict=True) if x]))
        whole = iter(self._by_library(self.tokenizer, [p for p, x in zip(parts, plain, strict=True) if not x]))
        made = iter([next(table if x else whole) for x in plain])
        return [np.frombuffer(b"".join([next(made) for _ in ps]), dtype=np.int32) for ps in cut]

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """First and last code point (exclusive) of each token, and how many tokens begin or end
        inside a character."""
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        ends = np.cumsum(self.lengths[ids])
        begins = ends - self.lengths[ids]
        heads = np.r_[(raw & 0xC0) != 0x80, True]  # bytes that begin a character, and the end
        place = np.cumsum(heads) - 1
        split = ~heads[begins] | ~heads[ends]
        return place[begins].astype(np.int32), (place[ends - 1] + 1).astype(np.int32), int(split.sum())

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def pieces(self, ids: list[int]) -> list[str]:
        """What each token adds to the text; a character counts for the token of its last byte."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        return [decoder.decode(self.tokens[k], final=n == len(ids) - 1) for n, k in enumerate(ids)]


@lru_cache(maxsize=2)
def codec_of(path: str, pattern: str, threads: int) -> Codec:
    return Codec(path, pattern, threads)


def _batches(texts: list[str]) -> Iterator[slice]:
    begin = total = 0
    for k, text in enumerate(texts):
        if total and total + len(text) > BATCH_CHARS:
            yield slice(begin, k)
            begin, total = k, 0
        total += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]), pa.int32()))


def _encode(path: str, pattern: str, threads: int, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern, threads)
        for batch in batches:
            every = [x.as_py() or "" for x in batch.column("text")]
            for part in _batches(every):
                texts = every[part]
                ids = codec.encode(texts)
                places = [codec.offsets(t, k) for t, k in zip(texts, ids, strict=True)]
                columns = [batch.column("doc_id")[part.start:part.stop], _lists(ids), pa.array([p[2] for p in places], pa.int64())]
                names = ["doc_id", "input_ids", "n_split"]
                if offsets:
                    columns += [_lists([p[0] for p in places]), _lists([p[1] for p in places])]
                    names += ["token_start", "token_end"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, threads: int = 2, offsets: bool = True) -> DataFrame:
    """doc_id, input_ids, n_split (tokens that begin or end inside a character) and, unless
    ``offsets`` is false, token_start and token_end (code points, end exclusive)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, input_ids array<int>, n_split long"
    if offsets:
        schema += ", token_start array<int>, token_end array<int>"
    return rows.mapInArrow(_encode(ranks_path, pattern, threads, offsets), schema)


def _decode(path: str, pattern: str, threads: int, text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, pattern, threads)
        for batch in batches:
            lists = pc.fill_null(batch.column("input_ids"), [])
            for k in range(0, len(lists), 256):
                part = lists[k:k + 256]
                flat, ends = part.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.list_value_length(part).to_pylist()])
                made = [codec.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
                columns = [c[k:k + 256] for c in batch.columns] + [pa.array(made, pa.binary())]
                names = [*batch.schema.names, "decoded"]
                if text:
                    columns.append(pa.array([m.decode("utf-8", "replace") for m in made], pa.string()))
                    names.append("decoded_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str = PATTERN, threads: int = 2, text: bool = True) -> DataFrame:
    """The columns of ``encode_documents`` (input_ids is enough), decoded (bytes) and, unless
    ``text`` is false, decoded_text."""
    names = [c for c in ("doc_id", "input_ids", "n_split", "token_start", "token_end") if c in encoded.columns]
    rows = encoded.select(*names)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", decoded binary" + ", decoded_text string" * text
    return rows.mapInArrow(_decode(ranks_path, pattern, threads, text), schema)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids, comma-joined), decoded_sha256 and n_split."""
    return decoded.select(
        "doc_id", F.size("input_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("input_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")
