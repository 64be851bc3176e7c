"""Token ids of whole texts by the tokenizers library, for short and for huge texts."""

from __future__ import annotations

import os
import re
import sys
from array import array
from itertools import filterfalse
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts of more characters are encoded in overlapping chunks of about this size.
CHUNK = 32_768
OVERLAP = 1_024
#: Bytes of texts that are encoded together.
CUT_BYTES = 4 << 20
#: Distinct pieces a worker remembers: at most twice as many, the ones it met last.
REMEMBERED = 400_000
#: Pieces that are given to the tokenizer in one text.
TOGETHER = 200

# A space is a stable boundary when nothing a tokenizer does on one side depends on the other.
# "dropped": the tokenizer splits at white space and drops it, so every space is one.
# "leading": byte-level splitting puts one space before a word, so a single space between two
# visible characters starts a token, whatever stands further left.
BOUNDARIES = {
    "dropped": re.compile(" "),
    "leading": re.compile(r"(?<=[!-~\w]) (?=[!-~\w])"),
}
# Kinds of bytes, as flags; all others are 0.
LETTER, MARK, LINE, BLANK, VISIBLE, WIDE = 1, 2, 4, 8, 16, 32


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F] = VISIBLE
    for first, last in ("az", "AZ"):
        kinds[ord(first) : ord(last) + 1] |= LETTER
    kinds[[ord(c) for c in ".,;:!?"]] |= MARK
    kinds[ord("\n")], kinds[ord(" ")], kinds[0x80:] = LINE, BLANK, WIDE
    return kinds


KINDS = _kinds()


def _spaces_part_words(text: str) -> bool:
    """Whether every space stands alone between visible characters, so that all are boundaries.

    Blanks and line ends are the only white space that is looked at in detail; any other, and
    characters that are not printable, give False.
    """
    return not (
        text[:1] == " "
        or text[-1:] == " "
        or "  " in text
        or " \n" in text
        or "\n " in text
        or not text.replace("\n", "").isprintable()
    )


class NoBoundary(Exception):
    """The overlap of two chunks has no stable boundary on which both agree."""


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if os.sep not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Tokenizer.from_file(path)


class Pieces(dict):
    """Ids of pieces of text; a generation that is full is kept for one more."""

    def __init__(self, tokenizer, leading: bool):
        super().__init__()
        self.tokenizer, self.leading = tokenizer, leading
        self.last: dict[str, bytes] = {}
        vocabulary = tokenizer.get_vocab()
        self.blank_first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank_first[[k for t, k in vocabulary.items() if t.startswith("\u0120")]] = True

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces; those not known are learnt."""
        held = list(map(self.get, pieces))
        missing = [k for k, ids in enumerate(held) if ids is None]
        if missing:
            new = list(map(pieces.__getitem__, missing))
            self.learn(new)
            for k, ids in zip(missing, map(self.__getitem__, new), strict=True):
                held[k] = ids
        return held

    def learn(self, new: list[str]) -> None:
        """Look up different pieces not known; those of the last generation come back on the way."""
        if self.last:
            known = [p for p in new if p in self.last]
            self.update(zip(known, map(self.last.__getitem__, known), strict=True))
            new = list(filterfalse(self.__contains__, new))
        words, others = [], []
        for piece in new:
            # Visible characters after one blank, so it is the only blank of the piece.
            one = self.leading and piece[0] == " " and piece.isprintable() and piece.count(" ") == 1
            (words if one and len(piece) > 1 else others).append(piece)
        self._encode(words, together=True)
        self._encode(others, together=False)

    def turn(self) -> None:
        """Begin a new generation when this one is full."""
        if len(self) > REMEMBERED:
            self.last = dict(self)
            self.clear()

    def _encode(self, pieces: list[str], together: bool) -> None:
        """Add the ids of each piece; ``together`` gives many to the tokenizer in one text.

        Such a text is cut where a token begins with a blank, once for each piece.
        """
        for start in range(0, len(pieces), TOGETHER):
            some = pieces[start : start + TOGETHER]
            if together:
                whole = self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)
                ids = np.array(whole[0].ids, "<u4")
                begin = np.flatnonzero(self.blank_first[ids])
                if len(begin) == len(some):
                    raw, at = ids.tobytes(), (4 * begin).tolist()
                    ends = [*at[1:], len(raw)]
                    self.update((p, raw[s:e]) for p, s, e in zip(some, at, ends, strict=True))
                    continue
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.update((p, array("I", e.ids).tobytes()) for p, e in zip(some, found, strict=True))


class Encoder:
    """Encodes texts; ``boundary`` names where the tokenizer's tokens never join.

    A text of up to ``chunk`` characters is cut at its stable boundaries, and each distinct piece is
    given to the tokenizer once. A longer text is encoded in overlapping chunks.
    """

    def __init__(
        self, path: str, boundary: str, chunk: int = CHUNK, overlap: int = OVERLAP
    ):
        self.tokenizer = load(path)
        self.boundary = BOUNDARIES[boundary]
        self.leading = boundary == "leading"
        self.chunk, self.overlap = chunk, overlap
        self.pieces = Pieces(self.tokenizer, self.leading)
        self.widened = 0

    @staticmethod
    def shared(path: str, boundary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Encoder:
        """The encoder of this worker process, so that later tasks in it know its pieces."""
        state = sys.modules.setdefault("_token_encoders", ModuleType("_token_encoders"))
        held = state.__dict__.setdefault("encoders", {})
        key = path, boundary, chunk, overlap
        if key not in held:
            held[key] = Encoder(*key)
        return held[key]

    def rest(self) -> None:
        """Give up what is only kept for speed, between tasks."""
        self.pieces.last = {}
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        self.pieces.turn()
        long = [k for k, text in enumerate(texts) if len(text) > self.chunk]
        found = self._cut_up([t if len(t) <= self.chunk else "" for t in texts] if long else texts)
        for k in long:
            found[k] = self.spliced(texts[k]).astype("<u4").tobytes()
        return found

    def _cut_up(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, piece by piece.

        Each different piece is looked up once, and the ids are gathered by place.
        """
        column = pa.array(texts, pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1] if texts else [0]
        if not offsets[-1]:
            return [b""] * len(texts)
        body = column.buffers()[2]
        raw = np.frombuffer(body, np.uint8)[: offsets[-1]]
        cut = self._places(raw, texts, np.diff(offsets))
        cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
        starts = np.flatnonzero(cut)
        pieces = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, len(raw))), body
        )
        coded = pieces.dictionary_encode()
        # Several times as fast as to_pylist, which makes a scalar of each.
        held = self.pieces.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        n = sizes[which]
        ends = np.concatenate(([0], np.cumsum(n)))
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], n) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(held), "<u4")[places].tobytes()
        at = (4 * ends[np.searchsorted(starts, offsets)]).tolist()
        return [ids[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]

    def _places(self, raw: np.ndarray, texts: list[str], sizes: np.ndarray) -> np.ndarray:
        """Whether tokens part before each byte: at stable boundaries, and at some places more.

        Those are between an ASCII letter and a mark, and around a single line end between ASCII
        letters or marks, so that words with and without a comma are one piece. ASCII letters next
        to them keep clear of all that a tokenizer composes or lowers first. Bytes of neighbouring
        texts may meet; what is cut there is a place where tokens part at a text's end as well.
        """
        kinds = np.zeros(len(raw) + 3, np.uint8)
        kinds[2:-1] = KINDS[raw]
        second, left, here, right = kinds[:-3], kinds[1:-2], kinds[2:-1], kinds[3:]
        blank = here == BLANK
        if self.leading:
            plain = np.array([_spaces_part_words(t) for t in texts], bool)
            stable = np.repeat(np.where(plain, VISIBLE | WIDE, VISIBLE).astype(np.uint8), sizes)
            blank &= ((left & stable) != 0) & ((right & stable) != 0)
        cut = blank | (((left & LETTER) != 0) & ((here & MARK) != 0))
        cut |= (here == LINE) & ((left & (LETTER | MARK)) != 0) & ((right & LETTER) != 0)
        cut |= (left == LINE) & ((here & LETTER) != 0) & ((second & VISIBLE) != 0)
        return cut

    def _tokens(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the places in the whole text (from, to) of the tokens of a chunk."""
        found = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        places = np.array(found.offsets, np.int64).reshape(-1, 2) + start
        return np.array(found.ids, np.uint32), places

    def spliced(self, text: str) -> np.ndarray:
        """Ids of a text by overlapping chunks.

        Two neighbours are joined at a stable boundary in their overlap: no token of either crosses
        it, and both have the same tokens in the same places between the boundaries before and after
        it. Without one the overlap is doubled, and at last the chunk.
        """
        parts, start, size, overlap = [], 0, self.chunk, self.overlap
        ids, places = self._tokens(text, start, start + size)
        end = start + size
        while end < len(text):
            begin = max(start, end - overlap)
            after = min(begin + max(size, 2 * overlap), len(text))
            next_ids, next_places = self._tokens(text, begin, after)
            try:
                at = self._common(text, begin, end, (ids, places), (next_ids, next_places))
            except NoBoundary:
                self.widened += 1
                if begin > start:
                    overlap *= 2
                else:  # the next chunk holds the whole of this one
                    ids, places, end, size = next_ids, next_places, after, 2 * size
                continue
            parts.append(ids[places[:, 1] <= at])
            keep = next_places[:, 0] >= at
            ids, places = next_ids[keep], next_places[keep]
            start, end, size, overlap = at, after, self.chunk, self.overlap
        return np.concatenate([*parts, ids])

    def _common(self, text: str, begin: int, end: int, left: tuple, right: tuple) -> int:
        stable = [m.start() for m in self.boundary.finditer(text, begin, end)]
        middle = len(stable) // 2
        for k in sorted(range(1, len(stable) - 1), key=lambda k: abs(k - middle)):
            before, at, after = stable[k - 1 : k + 2]
            if all(
                not ((p[:, 0] < b) & (p[:, 1] > b)).any()
                for _, p in (left, right)
                for b in (before, at, after)
            ):
                inside = [
                    (i[w], p[w])
                    for i, p in (left, right)
                    for w in [(p[:, 0] >= before) & (p[:, 1] <= after)]
                ]
                if np.array_equal(inside[0][0], inside[1][0]) and np.array_equal(
                    inside[0][1], inside[1][1]
                ):
                    return at
        raise NoBoundary
