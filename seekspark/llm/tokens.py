"""Token ids of many texts by a public tokenizer, one library call per new word instead of per text."""

from __future__ import annotations

import os
import re
from array import array
from unicodedata import is_normalized

import numpy as np

#: Words whose ids are remembered, per Python worker and generation. It bounds memory and changes no result.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
#: How the tokenizer's own pattern divides lower-cased text of the first 256 code points: letters, single numbers, marks.
PARTS = re.compile(
    r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'(?:s|t|re|ve|m|ll|d)"
    r"|[^\x20\t-\r\x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Closing marks that follow a letter are a part of their own.
TAIL = ".,;:!?)]}|&$#*%\""


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer file at `path` as text; by default the 49k word vocabulary of the installed public files."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def words_of(text: str) -> list[str]:
    """Parts of a text whose ids, in a row, are the text's ids.

    The tokenizer drops white space, lower-cases and splits into letters, single numbers and other marks. Text of the first
    256 code points has no other normal form, keeps within them in lower case and can be divided fully. Other texts are
    divided at spaces, tabs and line ends, over which neither parts nor normal forms reach, and before closing marks behind
    a letter. Special tokens stand in words of their own kind.
    """
    if "<|" not in text and _is_latin(text):
        return PARTS.findall(text.lower())
    out = []
    for word in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
        if "<|" in word:
            out.append(word)
        elif word.isascii():
            out += PARTS.findall(word.lower())
        else:
            core = word.rstrip(TAIL)
            if len(core) < len(word) and core[-1].lower().isalpha():
                out += (core, word[len(core):])
            else:
                out.append(word)
    return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class _Remembered(dict):
    """word -> ids as bytes. Words that are missing are looked up among the older ones or encoded."""

    def __init__(self, tokenizer, kind: np.dtype) -> None:
        super().__init__()
        self.tokenizer, self.model, self.code, self.older = tokenizer, tokenizer.model, "H" if kind.itemsize == 2 else "I", {}
        self.letters = byte_letters()

    def __missing__(self, word: str) -> bytes:
        made = self.older.get(word)
        if made is None:
            lowered = word.lower()
            if word.isascii() and word.isprintable() and "<|" not in word:
                ids = [t.id for t in self.model.tokenize(lowered)]
            elif word.isalpha() and lowered.isalpha() and max(word) < "\u0250" and is_normalized("NFC", word):
                ids = [t.id for t in self.model.tokenize("".join([self.letters[b] for b in lowered.encode()]))]
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            made = array(self.code, ids).tobytes()
        if len(word) <= LONGEST_REMEMBERED:
            self[word] = made
        return made

    def age(self) -> None:
        """Forgets the words not asked for since the last time, once there are many."""
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()


class WordTokenizer:
    """ids(texts) equals the library's ids of the whole texts, for the word vocabulary, which drops white space.

    Parts of printable ASCII, and letters up to U+024F in normal form, are what the library's first steps leave them as, so
    they go to its merge model directly; everything else passes through the whole library.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.type = np.dtype("=u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "=u4")
        self.known = _Remembered(self.tokenizer, self.type)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as numbers of `type`."""
        out = [b"".join(map(self.known.__getitem__, words_of(text))) for text in texts]
        self.known.age()
        return out


_made: dict[int, WordTokenizer] = {}


def word_tokenizer(definition: str) -> WordTokenizer:
    """One tokenizer per worker and definition."""
    key = hash(definition)
    if key not in _made:
        _made[key] = WordTokenizer(definition)
    return _made[key]
