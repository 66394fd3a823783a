"""Reader of SentencePiece model files (the protobuf wire format, the fields that are used)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

# Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, type
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @property
    def unk_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def splits_at_space(self) -> bool:
        """Whether no piece has a space marker behind another character, so that a text can be
        cut before every run of spaces without any effect on its pieces."""
        return not any(SPACE in p.lstrip(SPACE) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(raw, at)
        else:
            if wire == 2:
                size, at = _varint(raw, at)
            else:
                size = {1: 8, 5: 4}[wire]
            value, at = raw[at:at + size], at + size
        yield key >> 3, value


def read_model(path: str) -> Model:
    with open(path, "rb") as file:
        raw = file.read()
    model = Model()
    for number, value in _fields(raw):
        if number == 1:  # a piece: 1 text, 2 score, 3 type
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            model.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
        elif number == 2:  # trainer: 3 model type, 35 byte fallback
            own = dict(_fields(value))
            model.kind, model.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
        elif number == 3:  # normalizer: 2 character map, 3 dummy prefix, 4 extra white space, 5 escape
            own = dict(_fields(value))
            model.charsmap = own.get(2, b"")
            model.add_dummy_prefix = bool(own.get(3, 1))
            model.remove_extra_whitespaces = bool(own.get(4, 1))
            model.escape_whitespaces = bool(own.get(5, 1))
    return model
