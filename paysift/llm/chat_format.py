"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, in order of turn:

    user        [INST]text[/INST]
    assistant   <s>text</s>
    other       [ROLE]role[/ROLE]text[END]

Control strings inside a text or a role are escaped by one more backslash after their first
character (``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), which unescaping
takes away again; no escaped text holds a control string. The rendered string is encoded once,
with offsets. Control strings are special tokens, so no token crosses the border of a turn.
The loss mask covers the tokens of assistant texts: sorted text spans meet the sorted token
offsets by binary search.

Defined cases: null text is empty; null role is the empty role; turns come in order of
(turn, role, text), nulls first, so ties and repeated rows have one order; a null conv_id is a
conversation of its own; an empty table gives an empty result; further columns are ignored.
A conversation is one output row, so its rows meet in one task by design.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[END]"]
_ESCAPE = re.compile(r"\[(\\*)(?=/?(?:INST|ROLE)\]|END\])|<(\\*)(?=/?s>)")
_UNESCAPE = re.compile(r"\[\\(?=\\*(?:/?(?:INST|ROLE)\]|END\]))|<\\(?=\\*/?s>)")
_MARK = re.compile("|".join(re.escape(c) for c in CONTROL))

SCHEMA = ("conv_id long, formatted string, input_ids array<int>, token_start array<int>, token_end array<int>, "
          "loss_mask array<byte>")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation, and the (start, end) of each assistant text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        text = escape(text)
        if role == "user":
            before, after = "[INST]", "[/INST]"
        elif role == "assistant":
            before, after = "<s>", "</s>"
            spans.append((at + len(before), at + len(before) + len(text)))
        else:
            before, after = f"[ROLE]{escape(role)}[/ROLE]", "[END]"
        parts += [before, text, after]
        at += len(before) + len(text) + len(after)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    turns, role, at = [], "", 0
    for m in _MARK.finditer(formatted):
        inner, mark = unescape(formatted[at:m.start()]), m[0]
        if mark == "[/ROLE]":
            role = inner
        elif mark == "[/INST]":
            turns.append(("user", inner))
        elif mark == "</s>":
            turns.append(("assistant", inner))
        elif mark == "[END]":
            turns.append((role, inner))
        at = m.end()
    return turns


def masked_texts(formatted: str, start, end, mask) -> list[str]:
    """Texts under the mask: the union of the masked tokens' spans, one text a span, unescaped."""
    on = np.asarray(mask, dtype=bool)
    s, e = np.asarray(start, dtype=np.int64)[on], np.asarray(end, dtype=np.int64)[on]
    if not len(s):
        return []
    reach = np.maximum.accumulate(e)
    new = np.flatnonzero(np.r_[True, s[1:] > reach[:-1]])
    return [unescape(formatted[a:b]) for a, b in zip(s[new], reach[np.r_[new[1:] - 1, len(s) - 1]], strict=True)]


def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    tok.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROL])
    return tok


def _mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    mask = np.zeros(len(starts), np.int8)
    for a, b in spans:
        mask[np.searchsorted(starts, a, "left"):np.searchsorted(starts, b, "left")] = 1
    return mask


def _encode(path: str, batch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k:k + batch]
                made = [render([(t["role"] or "", t["text"] or "") for t in turns]) for turns in part["turns"]]
                rows = []
                for (text, spans), enc in zip(made, tok.encode_batch([m[0] for m in made], add_special_tokens=False), strict=True):
                    off = np.array(enc.offsets, dtype=np.int32).reshape(-1, 2)
                    rows.append((text, enc.ids, off[:, 0], off[:, 1], _mask(off[:, 0], off[:, 1], spans)))
                out = pd.DataFrame(rows, columns=["formatted", "input_ids", "token_start", "token_end", "loss_mask"])
                out.insert(0, "conv_id", part["conv_id"].to_numpy())
                yield out

    return run


def format_conversations(conversations: DataFrame, tokenizer_path: str, batch: int = 64) -> DataFrame:
    """conv_id, formatted, input_ids, token offsets and loss mask of every conversation."""
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text"))).alias("turns"))
    return whole.mapInPandas(_encode(tokenizer_path, batch), SCHEMA)


def _read_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for conv, text, start, end, mask in frame[["conv_id", "formatted", "token_start", "token_end", "loss_mask"]].itertuples(index=False):
            turns = parse(text)
            loss = masked_texts(text, start, end, mask)
            rows.append((
                conv, len(turns),
                hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest(),
                sum(map(len, loss)), hashlib.sha256("".join(loss).encode("utf-8", "surrogatepass")).hexdigest(),
                len(text), len(mask), int(np.sum(mask)),
            ))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                          "formatted_chars", "n_tokens", "n_loss_tokens"]).astype({"conv_id": "Int64"})


def digests(formatted: DataFrame) -> DataFrame:
    """Digests that are read back from the formatted strings, token offsets and masks."""
    return formatted.mapInPandas(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                    "formatted_chars long, n_tokens long, n_loss_tokens long")
