"""Tokenizer files applied inside tasks."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache
from itertools import accumulate

import numpy as np

#: Pieces of text whose ids are remembered in a Python worker, at most; about 200 bytes each.
REMEMBERED = 300_000
#: Characters of text whose pieces are looked up at once, and of new pieces encoded in one call.
SLICE, CALL = 1_000_000, 200_000
#: Rows whose ids a task holds at once.
ROWS = 2000

# Places where a tokenizer's own splitting always cuts, so pieces can be encoded one by one:
#: byte-level BPE with a space in front of words: a space that a non-space follows, and runs of spaces.
SPACED = r" ?\S+|\s+(?!\S)|\s+"
#: How byte-level vocabularies write a space.
SPACE_BYTE = "\u0120"
#: BPE that drops white space.
WORDS = r"\S+"
#: Characters that Python takes for white space and the tokenizers don't, and the beginning of special tokens.
_UNSAFE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: White space besides spaces and line ends, and pairs of those two.
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n" and c not in _UNSAFE]
_PAIRS = ("  ", "\n\n", " \n", "\n ")


class Encoder:
    """Ids of whole texts, the same as from one call of the tokenizer for each text.

    The tokenizers cut a text at white space before they merge bytes. Distinct pieces are
    encoded once and remembered; texts where the cut could differ are encoded whole. New
    pieces go to the tokenizer many at a time. Those with one space, in front, go one after
    the other: only a piece's first token begins with a space. Others go with a special token
    between them: it splits there first, and no piece can yield that token's id. Equal texts
    of a call are cut once.
    """

    def __init__(self, path: str, pieces: str | None, remembered: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = re.compile(pieces) if pieces else None
        self.split = pieces
        self.remembered = remembered or REMEMBERED
        self.known: dict[str, bytes] = {}
        self.separator = next((t for t in ("<|endoftext|>",) if self.tokenizer.token_to_id(t) is not None), None)
        self.mark = self.tokenizer.token_to_id(self.separator) if self.separator else None
        #: Ids of tokens that begin with a space, where a space in front belongs to its piece.
        self.spaced = None
        if pieces == SPACED:
            vocab = self.tokenizer.get_vocab()
            self.spaced = np.zeros(max(vocab.values()) + 1, bool)
            self.spaced[[k for t, k in vocab.items() if t.startswith(SPACE_BYTE)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null and empty texts have none."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text; pieces that are new are gathered over a slice of the texts."""
        out: list[bytes] = []
        held: list[list[str] | bytes] = []
        size = 0
        distinct = dict.fromkeys(texts)
        for text in distinct:
            if not text:
                held.append(b"")
            elif self.pieces is None or self.separator is None or any(c in text for c in _UNSAFE):
                held.append(self._ids(text).tobytes())
            else:
                held.append(self._cut(text))
                size += len(text)
            if size > SLICE:
                out += self._joined(held)
                held, size = [], 0
        out += self._joined(held)
        return [*map(dict(zip(distinct, out)).__getitem__, texts)] if len(distinct) < len(texts) else out

    def _cut(self, text: str) -> list[str]:
        """All matches of the pieces' pattern; by plain splits where no two white-space characters stand together."""
        if self.split == WORDS:
            return text.split()
        if self.split == SPACED and not any(c in text for c in _OTHER) and not any(c in text for c in _PAIRS) and text[0] not in " \n" and text[-1] not in " \n":
            return text.replace(" ", "\x1c ").replace("\n", "\x1c\n\x1c").split("\x1c")
        return self.pieces.findall(text)

    def _joined(self, held: list[list[str] | bytes]) -> list[bytes]:
        known = self.known
        new = [x for x in set().union(*(p for p in held if not isinstance(p, bytes))) if x not in known]
        self._learn(new)
        get = known.__getitem__
        out = [p if isinstance(p, bytes) else b"".join(map(get, p)) for p in held]
        # The pieces met first are mostly the frequent ones: when full, later ones are forgotten again.
        for x in new[max(0, self.remembered - len(known) + len(new)) :]:
            del known[x]
        return out

    def _learn(self, new: list[str]) -> None:
        spaced = [x for x in new if x[0] == " " and not x.isspace()] if self.spaced is not None else []
        rest = [x for x in new if x[0] != " " or x.isspace()] if spaced else new
        for part in _calls(spaced):
            ids = self._ids("".join(part))
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(part):
                self._remember(part, ids, starts, np.append(starts[1:], len(ids)))
            else:
                rest = rest + part
        for part in _calls(rest):
            ids = self._ids(self.separator.join(part))
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            self._remember(part, ids, np.append(0, ends[:-1] + 1), ends)

    def _remember(self, part: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = ids.tobytes()
        cells = map(raw.__getitem__, map(slice, (4 * starts).tolist(), (4 * ends).tolist()))
        self.known.update(zip(part, cells, strict=True))


def _calls(pieces: list[str]):
    """Runs of pieces with some CALL characters each."""
    ends = list(accumulate(map(len, pieces)))
    start = 0
    while start < len(pieces):
        end = bisect_left(ends, (ends[start - 1] if start else 0) + CALL, start) + 1
        yield pieces[start:end]
        start = end


def parts(batches):
    """Batches of at most ROWS rows: what is held of texts and ids at once stays small."""
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            yield batch.slice(start, ROWS)


@cache
def encoder(path: str, pieces: str | None, remembered: int | None = None) -> Encoder:
    """One encoder per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor share its cores
    return Encoder(path, pieces, remembered)
