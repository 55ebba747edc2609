"""Token ids of whole texts with the tokenizers library, by a bounded memory of units already encoded.

Byte-level BPE cuts a text into words before it looks at them: at runs of letters, digits, white space or other
characters, a single space going with what follows. So where a lone space stands between two characters that
aren't white space, a token starts whatever the words are; likewise on both sides of a lone newline, and
before a full stop or comma that follows a letter or digit and comes before a letter, digit or white space. A
text is cut at such places, each unit is encoded once by the library, and a text's ids are its units' ids one
after another. Texts in which a stop or comma touches other signs are cut at spaces only; those in which
spaces touch other white space are encoded whole, and so are texts that hold one of the vocabulary's added tokens (such as
"<|endoftext|>", which the library turns into its one id). All this rests on how the words are found, so it is
done only where the tokenizer's file says so (byte-level BPE without normaliser or prefix space); with any other file all
texts are encoded whole.
"""

from __future__ import annotations

import array
import json
import os
import re
from itertools import chain

import numpy as np

#: Units kept, how many of these in the first, small memory that stays in the processor's cache, and the longest unit
#: that is kept. Frequent units come early, so a full memory stays as it is; it starts anew where too few hit it.
MAX_UNITS, FIRST_UNITS, MAX_UNIT, LEAST_HITS = 700_000, 20_000, 48, 0.75

_SPACES = re.compile(r"\s | \s")
_SIGNS = re.compile(r"(?:\A|[\W_])[.,]|[.,](?:[^\w\s]|_)|\s\n|\n\s|\A\n|\n\Z")


def _kind(b: int) -> int:
    """0 letters and digits, 1 stop and comma, 2 space, 3 newline, 4 other ASCII signs, 5 bytes that need a closer look.
    Bytes of the block under C3 are Latin letters but for the times and division signs, 97 and B7."""
    if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b == 0xC3 or (0x80 <= b < 0xC0 and b not in (0x97, 0xB7)):
        return 0
    if b < 0x80:
        return {46: 1, 44: 1, 32: 2, 10: 3}.get(b, 4 if 33 <= b < 127 else 5)
    return 5


_KINDS = bytes(map(_kind, range(256)))
#: Neighbours (8 times the first's kind plus the second's) beside which some cut may not hold.
_PAIRS = {(2, 1), (3, 1), (1, 1), (4, 1), (1, 4), (3, 3), (2, 3), (3, 2), (2, 2)} | {p for k in range(6) for p in ((5, k), (k, 5))}
_BAD = bytes((b >> 3, b & 7) in _PAIRS for b in range(256))


def _visible() -> dict[int, int]:
    """Byte-level vocabularies write a byte as a character: itself where that can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    unseen = [b for b in range(256) if b not in set(seen)]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(unseen)}


_VISIBLE = _visible()


#: The words byte-level BPE looks at, for texts of ASCII and the Latin letters under C3, with no white space but spaces and
#: newlines.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^ \n{_LETTER}0-9]+|[ \n]+(?![^ \n])|[ \n]+")


def _how(text: str) -> int:
    """0: all cuts hold; 1: those at spaces do; 2: none; 3: the text is plain enough to find all words at once."""
    kinds = text.encode().translate(_KINDS)
    k = np.frombuffer(kinds, np.uint8)
    if kinds[:1] not in (b"\1", b"\3", b"\5") and kinds[-1:] != b"\3" and b"\1" not in ((k[:-1] << 3) | k[1:]).tobytes().translate(_BAD):
        return 0
    if b"\5" not in kinds:
        return 3
    if _SPACES.search(text):
        return 2
    return 1 if "\0" in text or _SIGNS.search(text) else 0


def cuttable(spec: dict) -> bool:
    """Whether a tokenizer's file finds words in the way that the cuts rely on."""
    words, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    byte_level = words.get("type") == "ByteLevel" and not words.get("add_prefix_space", True) and words.get("use_regex", True)
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token", "byte_fallback", "ignore_merges"))
    return byte_level and plain and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))


class Encoder:
    """Ids as little-endian integers of width bytes, 2 where the vocabulary allows."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cuts = cuttable(spec)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        #: Finds an added token; None where there are none.
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.width = 2 if self.tokenizer.get_vocab_size() < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self._code = "H" if self.width == 2 else "I"
        self.model = self.tokenizer.model
        self.first: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        code, make = self._code, array.array
        return [make(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: list[str]) -> dict[str, bytes]:
        """A unit of letters, with or without a space before them, is one word to the library, so its model can be
        asked at once; others go the whole way."""
        code, make, tokenize = self._code, array.array, self.model.tokenize
        out, other = {}, []
        for u in units:
            if self.cuts and (u.isalpha() or (u[:1] == " " and u[1:].isalpha())):
                out[u] = make(code, [t.id for t in tokenize(u.encode().decode("latin-1").translate(_VISIBLE))]).tobytes()
            else:
                other.append(u)
        for at in range(0, len(other), 1 << 15):
            some = other[at : at + (1 << 15)]
            out.update(zip(some, self._encode(some), strict=True))
        return out

    def _cut(self, text: str) -> list[str]:
        how = 2 if not self.cuts or (self.added and self.added.search(text)) else _how(text)
        if how == 0:
            return text.replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        if how == 3:
            return _WORDS.findall(text)
        if how == 1:
            first, *rest = text.split(" ")
            return [first, *(" " + r for r in rest)]
        return [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids."""
        cut = [self._cut(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        ids: list[bytes | None] = list(map(self.first.get, flat))
        rest = [i for i, x in enumerate(ids) if x is None]
        more = list(map(self.units.get, [flat[i] for i in rest]))
        gone = [i for i, x in zip(rest, more, strict=True) if x is None]
        for i, x in zip(rest, more, strict=True):
            ids[i] = x
        new = list({flat[i] for i in gone})
        if len(self.units) >= MAX_UNITS and len(gone) > (1 - LEAST_HITS) * len(flat):
            self.first.clear()
            self.units.clear()
        made = self._encode_units(new)
        for i in gone:
            ids[i] = made[flat[i]]
        if len(self.units) < MAX_UNITS:
            into = self.first if len(self.first) < FIRST_UNITS else self.units
            into.update((u, x) for u, x in made.items() if len(u) <= MAX_UNIT)
        out, at = [], 0
        for c in cut:
            out.append(b"".join(ids[at : at + len(c)]))
            at += len(c)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
