"""Fixed features of text passages: hashed byte trigrams and word statistics, with numpy only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Words in a passage, and bytes of text that are worked on at a time.
WORDS, WINDOW = 64, 1 << 20
BINS = 256
_SPACES = b"\x20\x09\x0A\x0B\x0C\x0D"
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_CLASSES = [
    np.array([chr(b) in letters for b in range(256)])
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>{}[]~^=_\\/@+", "!?", ".,;:'\"()-", "\n")
] + [np.arange(256) >= 128]
WIDTH = BINS + len(_CLASSES) + 4
_POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64))


def windows(text: bytes) -> Iterator[bytes]:
    """Pieces of at most about ``WINDOW`` bytes, cut behind white space where there is some."""
    start = 0
    while len(text) - start > WINDOW:
        cut = max(text.rfind(white, start, start + WINDOW) for white in (b" ", b"\n"))
        cut = cut + 1 if cut > start else start + WINDOW
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode(pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the pieces, and how many each piece has.

    A passage is ``WORDS`` words in a row, with the white space behind each but the piece's last; each
    piece starts a new one.  Every piece is followed by the same two bytes, which no passage counts, so
    that a passage's features do not depend on what comes next.
    """
    bare = [piece.strip(_SPACES) for piece in pieces]
    data = np.frombuffer(b"".join([piece + b"\n\n" for piece in bare]), np.uint8)
    lengths = np.array([len(piece) + 2 for piece in bare])
    begins = np.cumsum(lengths) - lengths
    counted = np.ones(len(data), bool)
    counted[begins + lengths - 2] = counted[begins + lengths - 1] = False
    white = _WHITE[data]
    heads = ~white
    heads[1:] &= white[:-1]
    starts = np.flatnonzero(heads)
    if not len(starts):
        return np.zeros((0, WIDTH), np.float32), np.zeros(len(pieces), np.int64)
    before = np.searchsorted(starts, begins)
    words = np.diff(np.append(before, len(starts)))
    counts = -(-words // WORDS)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    piece = np.repeat(np.arange(len(pieces)), words)
    passage = first[piece] + (np.arange(len(starts)) - before[piece]) // WORDS
    total = int(counts.sum())
    ends = np.append(starts[1:], len(data))
    of = np.repeat(passage, ends - starts)  # the passage of each byte from the first word on
    data, white, counted = data[starts[0]:], white[starts[0]:], counted[starts[0]:].astype(np.float32)

    wide = data.astype(np.uint32)
    grams = np.full(len(data), 0x20, np.uint32)
    grams[:-2] = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    bins = (grams * np.uint32(2654435761)) >> np.uint32(24)
    features = np.zeros((total, WIDTH), np.float32)
    features[:, :BINS] = np.bincount(of * BINS + bins, counted, total * BINS).reshape(total, BINS)
    size = np.bincount(of, counted, total).astype(np.float32)
    features[:, :BINS] = np.sqrt(features[:, :BINS] / size[:, None])
    for n, members in enumerate(_CLASSES):
        features[:, BINS + n] = np.bincount(of, members[data] * counted, total) / size

    place = np.arange(len(data)) - np.repeat(starts - starts[0], ends - starts)
    letters = np.where(white, 0, data).astype(np.uint64) + np.uint64(1)
    letters[white] = 0
    prints = np.add.reduceat(letters * _POWERS[place & 255], starts - starts[0])
    held = np.bincount(passage, minlength=total).astype(np.float32)
    order = np.lexsort((prints, passage))
    new = np.ones(len(order), bool)
    new[1:] = (prints[order][1:] != prints[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    same = np.zeros(len(prints))
    same[1:] = (prints[1:] == prints[:-1]) & (passage[1:] == passage[:-1])
    at = BINS + len(_CLASSES)
    features[:, at] = np.bincount(passage[order], new, minlength=total) / held
    features[:, at + 1] = np.bincount(passage, same, minlength=total) / held
    features[:, at + 2] = size / held / 16
    features[:, at + 3] = held / WORDS
    return features, counts
