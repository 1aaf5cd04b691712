"""Token ids of whole texts by a public tokenizer file, many times faster than text by text.

The tokenizer's own pre-tokenizer cuts a text into pieces that never influence each other, and the
same pieces come again and again.  Texts are cut the same way here, each distinct piece is encoded
once per Python worker by the tokenizers library, and its ids are joined from memory.
"""

from __future__ import annotations

import contextlib
import re
import threading

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
# Pieces remembered per worker; the memory is emptied when full, which never changes a result.
REMEMBERED = 1_500_000

# Character classes of the tokenizer's splitting pattern inside Latin-1; other texts take ROUGH.
_SPACE = "\t-\r \x85\xa0"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile(f" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_SPACE}{_LETTER}{_NUMBER}]+| ?[{_NUMBER}]+"
                   f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
# All white space of the pattern.  Cuts only where any text is cut, so a piece may hold several words' parts.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ROUGH = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)}


def _in_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Ids as the library gives them for ``encode(text, add_special_tokens=False)``."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        letters = _byte_letters()
        self.letters = str.maketrans({chr(b): c for b, c in letters.items()})
        self.between = letters[0]  # the letter of byte 0 stands between pieces
        self.between_id = self.whole.token_to_id(self.between)
        self.by_piece = Tokenizer(self.whole.model)
        self.by_piece.pre_tokenizer = pre_tokenizers.Split(self.between, "isolated")
        self.memory: dict[str, bytes] = {}

    def _learn(self, pieces: list[str], rough: set[str]) -> None:
        plain = [p for p in pieces if p not in rough and "\x00" not in p]
        if plain:
            joined = "\x00".join(plain).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.by_piece.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.between_id)
            starts, ends = np.concatenate(([0], cuts + 1)) * 4, np.append(cuts, len(ids)) * 4
            data = ids.tobytes()
            self.memory.update(zip(plain, map(data.__getitem__, map(slice, starts.tolist(), ends.tolist()))))
        rest = [p for p in pieces if p in rough or "\x00" in p]
        for p, e in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False)):
            self.memory[p] = np.array(e.ids, dtype="<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers; null counts as empty."""
        out: list[bytes] = []
        chunk, size = [], 0
        for text in texts:
            chunk.append(text or "")
            size += len(chunk[-1])
            if size > 1 << 16:
                out += self._encode(chunk)
                chunk, size = [], 0
        return out + self._encode(chunk)

    def _encode(self, texts: list[str]) -> list[bytes]:
        flat: list[str] = []
        ends, special, rough = [], {}, set()
        for k, text in enumerate(texts):
            if any(x in text for x in self.specials):
                special[k] = self._whole(text)
            elif text.isascii() or _in_latin(text):
                flat += LATIN.findall(text)
            else:
                pieces = ROUGH.findall(text)
                rough.update(pieces)
                flat += pieces
            ends.append(len(flat))
        ids = list(map(self.memory.get, flat))
        missing, at = [], -1
        with contextlib.suppress(ValueError):
            while True:
                at = ids.index(None, at + 1)
                missing.append(at)
        if missing:
            new = list({flat[at] for at in missing})
            if len(self.memory) + len(new) > REMEMBERED:
                self.memory.clear()
            self._learn(new, rough)
            for at in missing:
                ids[at] = self.memory[flat[at]]
        return [special[k] if k in special else b"".join(ids[a:b]) for k, (a, b) in enumerate(zip([0, *ends], ends))]


_ENCODERS: dict[str, Encoder] = {}
_LOCK = threading.Lock()


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """This worker's encoder, kept between tasks."""
    with _LOCK:
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = Encoder(vocabulary)
        return _ENCODERS[vocabulary]
