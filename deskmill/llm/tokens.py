"""Token ids of whole texts, for vocabularies whose tokens never span a blank.

A text is cut at its blanks, and every distinct piece is encoded once per worker;
so most of a text costs one table look-up per word. That is exact for tokenizers
that drop white space before they split into words, which is checked when the
tokenizer is opened.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np

# Distinct pieces held per worker; beyond that the table starts anew.
HELD = 1_000_000
# Marks that may follow a word.
MARKS = ".,;:!?%$*&#"
# Words of Latin letters: each is its own normal form but for case, and one pre-token.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCodes(dict):
    """Blank-free pieces to their ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        # Byte-level vocabularies spell bytes that do not print as characters from 256 on.
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in prints]
        self.spelling = {b: chr(256 + i) for i, b in enumerate(rest)}
        probe = "ab 12,c\n\td. The,!! Größe été ÀÉ"
        pieces = [i for p in probe.split() for i in self.ids(p)]
        split = self.ids("The") + self.ids(",!!")
        plain = [i for w in ("Größe", "été", "ÀÉ") for i in self.word_ids(w)]
        if pieces != self.ids(probe) or self.ids("The,!!") != split or plain != self.ids("Größe été ÀÉ"):
            raise ValueError(f"{path}: not a vocabulary of words that white space ends")

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word_ids(self, word: str) -> list[int]:
        """The ids of a word of ``PLAIN`` letters, by the model alone: nothing is left to
        normalise or to split."""
        word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.spelling)
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces not held yet.

        A word of letters and the marks after it are encoded apart, as the tokenizer
        splits them anyway; so a word is encoded once, whatever mark follows it.
        """
        if len(self) > HELD:
            self.clear()
        new = [p for p in pieces if p not in self]
        split = {}
        for p in new:
            word = p.rstrip(MARKS)
            if word != p and word.isalpha():
                split[p] = (word, p[len(word) :])
        whole = {p for p in new if p not in split}
        whole.update(x for pair in split.values() for x in pair if x not in self)
        tokenize = self.word_ids
        plain = {p for p in whole if PLAIN.fullmatch(p)}
        self.update((p, struct.pack(f"<{len(f)}I", *f)) for p, f in ((p, tokenize(p)) for p in plain))
        self._encode(list(whole - plain))
        self.update((p, self[word] + self[marks]) for p, (word, marks) in split.items())

    def _encode(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.update((p, np.array(f.ids, "<u4").tobytes()) for p, f in zip(part, found))


def held_codes(path: str, plain_specials: bool = False) -> PieceCodes:
    """The codes of this worker process, which outlive a task: functions travel to workers by
    value, so what is kept for the next task hangs on the tokenizer library's module."""
    import tokenizers

    held = vars(tokenizers).setdefault("_piece_codes", {})
    key = (path, plain_specials)
    if key not in held:
        held[key] = PieceCodes(path, plain_specials)
    return held[key]


def encoder(
    path: str, end_id: int, plain_specials: bool = False
) -> Callable[[Sequence[str]], Iterator[bytes]]:
    """A function from texts to the ids of each and ``end_id``, as bytes.

    Only blank, tab and the line ends are cut at: characters that every notion of
    white space includes. Others stay inside a piece, where the tokenizer sees them.
    """
    codes = held_codes(path, plain_specials)
    end = np.array([end_id], "<u4").tobytes()

    def encode(texts: Sequence[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 64):
            # Chained replacements of single characters are far faster than a table.
            parts = [
                t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                for t in texts[at : at + 64]
            ]
            codes.learn(set().union(*parts))
            for part in parts:
                yield b"".join(map(codes.__getitem__, part)) + end

    return encode
