"""Token ids of whole texts by the tokenizers library, with repeated stretches of text encoded once per task."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

#: Cuts that always fall between two pre-tokens of a byte-level BPE, so that the stretches between them can be encoded
#: by themselves, and one that occurs again need not be encoded again: before an ASCII white space that follows another
#: character (white space only starts a pre-token or continues a run of white space), and between Latin letters and
#: ASCII punctuation after them.
_SPACE, _MARK, _LETTER = r"[ \t\n\r\x0b\x0c]", r"[!-/:-@\[-`{-~]", "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
_STRETCH = re.compile(rf"{_SPACE}*{_LETTER}+(?={_SPACE}|{_MARK}|\Z)|{_SPACE}*{_MARK}+(?={_SPACE}|\Z)|{_SPACE}*[^ \t\n\r\x0b\x0c]+|{_SPACE}+")
#: A stretch that is one pre-token: the model takes it as it is, in the alphabet that byte-level BPE gives to bytes.
_ONE = re.compile(rf" ?{_LETTER}+\Z")
#: Other white space may join a run over such a cut; texts with any are encoded in one go.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Stretches a task remembers; beyond that it starts afresh. Results don't depend on it.
REMEMBERED = 800_000
#: Longer stretches are rare and not worth remembering.
LONGEST_REMEMBERED = 64


def default_tokenizer() -> str:
    """Path of the public byte-level BPE vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[int, str]:
    """The character for each byte: printable ones stand for themselves, the others take code points from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _pre_token(self, text: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text, null as empty; the same as encoding each text whole."""
        split = [None if _OTHER_SPACE.search(t or "") else _STRETCH.findall(t or "") for t in texts]
        new = set().union(*(s for s in split if s)).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*(s for s in split if s))
        once = self.known
        long = [s for s in new if len(s) > LONGEST_REMEMBERED]
        short = list(new.difference(long))
        one = [s for s in short if _ONE.match(s)]
        once.update((s, self._pre_token(s)) for s in one)
        short = list(set(short).difference(one))
        once.update(zip(short, self._encode(short)))
        extra = dict(zip(long, self._encode(long)))
        out = []
        for text, stretches in zip(texts, split):
            if stretches is None:
                out.append(self._encode([text])[0])
            elif extra:
                out.append(b"".join([extra[s] if s in extra else once[s] for s in stretches]))
            else:
                out.append(b"".join([once[s] for s in stretches]))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(path)
