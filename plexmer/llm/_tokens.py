"""Token ids of whole texts, by chunks that no pre-tokenizer rule crosses.

Byte-pair merges never leave a pre-token, and pre-tokens never join text on both
sides of a split made here, so each distinct chunk is encoded once per worker and
its ids are remembered as packed little-endian 32-bit integers.  Texts with white
space outside ASCII, or with the string of an added token (which cuts a text before any rule),
are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from ._common import kept

#: Distinct chunks remembered by a worker (about 80 MB); then it starts afresh.
REMEMBERED = 500_000
_WIDE_SPACE = re.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
#: A space belongs to the word after it; of other white space the last character before a word stands alone.
_BYTE_CHUNKS = re.compile(rb"[ ]?[^ \t-\r]+|[ \t-\r]+(?=[ ][^ \t-\r])|[ \t-\r]+(?=[\t-\r][^ \t-\r])|[ \t-\r]+")


def default_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A word of Latin letters followed by ASCII punctuation without apostrophes: two pre-tokens, whatever the rules.
_WORD_MARK = re.compile(rb"(\x20?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for code points from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in prints else next(others)) for b in range(256)}


class _Memory(dict):
    """Chunk -> packed ids; a word and the punctuation after it are looked up apart, so few distinct pieces are encoded.

    A word is remembered once, under its own (lowered) bytes; other spellings of it are added when the word is met again.
    """

    def __init__(self, encode: Callable[[str], bytes], encode_one: Callable[[bytes], bytes], lower: bool) -> None:
        self.encode, self.encode_one, self.lower, self.marks = encode, encode_one, lower, {}
        self.most = REMEMBERED

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if chunk.isalpha():  # ASCII letters alone
            word, mark = chunk.lower() if self.lower else chunk, b""
        elif found := _WORD_MARK.fullmatch(chunk):
            word, mark = found.groups()
            if self.lower:
                word = word.decode().lower().encode()
        else:
            self[chunk] = ids = self.encode(chunk.decode())
            return ids
        ids = self.get(word)
        if ids is None:
            self[word] = ids = self.encode_one(word)
            return ids + self.mark(mark) if mark else ids
        self[chunk] = ids = ids + self.mark(mark) if mark else ids
        return ids

    def mark(self, mark: bytes) -> bytes:
        ids = self.marks.get(mark)
        if ids is None:
            if len(self.marks) >= self.most // 4:
                self.marks.clear()
            ids = self.marks[mark] = self.encode_one(mark)
        return ids


class Encoder:
    """Text -> packed ids.  `kind` is "word" (white space is dropped, letters are lowered) or "byte" (every byte counts)."""

    def __init__(self, path: str, kind: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.ids = tokenizer.get_vocab_size()
        self.whole = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # a single pre-token needs the merges alone
        model, letters = tokenizer.model, _byte_letters()
        packed, space = [i.to_bytes(4, "little") for i in range(1 + max(tokenizer.get_vocab().values()))], letters[32]

        def one(piece: bytes) -> bytes:
            # ASCII pieces are letters and marks, which stand for themselves, and a space before them
            text = piece.decode().replace(" ", space) if piece.isascii() else piece.decode("latin-1").translate(letters)
            return b"".join([packed[t.id] for t in model.tokenize(text)])

        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) if added else "(?!)", re.I)
        self.memory = _Memory(self.whole, one, kind == "word")
        self.split = bytes.split if kind == "word" else _BYTE_CHUNKS.findall

    def __call__(self, text: str) -> bytes:
        if _WIDE_SPACE.search(text) or self.special.search(text):
            return self.whole(text)
        return b"".join(map(self.memory.__getitem__, self.split(text.encode())))


def encoder(path: str, kind: str) -> Encoder:
    """One encoder a worker process, until it runs another operator's tasks."""
    return kept((path, kind), lambda: Encoder(path, kind))
