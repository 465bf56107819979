"""A unigram view of a public sentencepiece vocabulary, shared by token counts and sampling.

The vocabulary file is read on the driver and its pieces are sent to the executors: their number
is fixed by the file (32,000 here), so the broadcast is bounded. A BPE file only ranks its pieces;
the log-probability of rank r is taken by the Zipf-Mandelbrot rule -log(r + 2.7), normalised, and
the 256 byte pieces share the rank after the last. Nothing is trained.

Text is prefixed by one space and cut before each space and line feed; no piece spans a cut, so
units are independent. A space is piece character U+2581; a literal U+2581 in the text goes to
byte pieces, so decoding is exact.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

FOLDER, FILE = "/opt/tokenizers", "piece_bpe_32k.model"
MODEL = f"{FOLDER}/{FILE}"
SPACE = "▁"
_LITERAL = 0x110000  # stands for a U+2581 of the text itself: no piece has this character
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 18


@lru_cache(maxsize=2)
def load(model: str = MODEL) -> dict:
    """``pieces``: piece string to (id, log-probability); ``bytes``: ids of the byte pieces by
    value; ``byte_lp``; ``longest``: characters of the longest piece; ``names``: piece by id."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    rank, names, byte_ids = {}, [], {}
    for i in range(p.get_piece_size()):
        name = p.id_to_piece(i)
        names.append(name)
        if p.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
        elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.get_score(i) < -1e8 or SPACE in name[1:] or "\n" in name):
            rank[name] = i, -p.get_score(i)
    if len(byte_ids) != 256:
        raise ValueError("the vocabulary needs byte pieces, so that any text has a segmentation")
    last = max(r for _, r in rank.values()) + 1
    total = math.log(sum(1 / (r + 2.7) for _, r in rank.values()) + 256 / (last + 2.7))
    return {
        "pieces": {k: (i, -math.log(r + 2.7) - total) for k, (i, r) in rank.items()},
        "bytes": [byte_ids[b] for b in range(256)],
        "byte_lp": -math.log(last + 2.7) - total,
        "longest": max(map(len, rank)),
        "names": names,
    }


def model_path(spark) -> str:
    """The vocabulary file in the folder that the setting ``spindrift.tokenizers`` names."""
    return f"{spark.conf.get('spindrift.tokenizers', FOLDER)}/{FILE}"


def units(text: str) -> list[str]:
    """`` text`` cut before each space and line feed."""
    if "\1" in text:
        return _slow_units(text)  # the mark used below is in the text
    return (" " + text).replace(" ", "\1 ").replace("\n", "\1\n")[1:].split("\1")


def _slow_units(text: str) -> list[str]:
    out = [" "]
    for c in text:
        if c in " \n":
            out.append(c)
        else:
            out[-1] += c
    return out


def code_points(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Piece characters of ``joined`` units as their code points plus 1, so that none is 0, and
    the UTF-8 bytes of each text character."""
    raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    size = 1 + (raw >= 0x80).astype(np.int64) + (raw >= 0x800) + (raw >= 0x10000)
    return np.where(raw == 0x20, 0x2581, np.where(raw == 0x2581, _LITERAL, raw)).astype(np.uint64) + np.uint64(1), size


class Lexicon:
    """Pieces and their beginnings by the polynomial hash of their characters, looked up for whole
    arrays at once. ``more`` tells of a row whether a longer piece begins with it; a beginning that
    is no piece has the log-probability -inf."""

    def __init__(self, model: dict):
        self.longest, self.byte_lp, self.byte_ids = model["longest"], model["byte_lp"], np.array(model["bytes"])
        self.scores = {k: v for k, v in model["pieces"].items()}
        begun = {name[:n] for name in self.scores for n in range(1, len(name))}
        names = [*self.scores, *sorted(begun - self.scores.keys())]
        keys = np.zeros(len(names), np.uint64)
        for row, name in enumerate(names):
            h = 0
            for c in name:
                h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            keys[row] = h
        if len(np.unique(keys)) != len(keys):
            raise ValueError("pieces collide")
        self.keys = np.append(keys, np.uint64(0))  # the last row stands for no piece
        no_piece = [(-1, -np.inf)] * (len(names) - len(self.scores) + 1)
        self.lp = np.array([lp for _, lp in [*self.scores.values(), *no_piece]])
        self.ids = np.array([i for i, _ in [*self.scores.values(), *no_piece]], np.int32)
        self.more = np.array([name in begun for name in names] + [False])
        self.slots = np.full(1 << _SLOTS, len(keys), np.int32)
        self.probes, row, slot = 0, np.arange(len(keys)), self._slot(keys)
        while len(row):
            free = self.slots[slot] == len(keys)
            row_free, slot_free = row[free], slot[free]
            self.slots[slot_free] = row_free
            placed = np.zeros(len(row), bool)
            placed[free] = self.slots[slot_free] == row_free
            row, slot = row[~placed], (slot[~placed] + 1) & (1 << _SLOTS) - 1
            self.probes += 1

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * _BASE >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows of the pieces with hashes ``h``; the row after the last where there is none."""
        none = len(self.keys) - 1
        slot = self._slot(h)
        row = self.slots[slot]
        miss = np.flatnonzero((self.keys[row] != h) & (row != none))
        for _ in range(self.probes):
            if not len(miss):
                break
            slot[miss] = (slot[miss] + 1) & (1 << _SLOTS) - 1
            row[miss] = self.slots[slot[miss]]
            miss = miss[(self.keys[row[miss]] != h[miss]) & (row[miss] != none)]
        row[miss] = none
        return row


def decode(ids: list[int], names: list[str], byte_of: dict[int, int]) -> str:
    """The text whose segmentation ``ids`` are."""
    out = bytearray()
    for i in ids:
        out += bytes([byte_of[i]]) if i in byte_of else names[i].replace(SPACE, " ").encode()
    return out.decode()[1:]
