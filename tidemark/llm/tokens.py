"""Token ids of whole texts by a public tokenizer, with a bounded memory of words already encoded."""

from __future__ import annotations

from array import array

VOCABULARY = "word_bpe_49k.json"
END = 1
#: So many different words are remembered by a Python worker (about 60 MB).
MEMORY = 300_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """Words and their ids. A word that isn't there is looked up among the older ones, then encoded.

    Once there are MEMORY / 2 the words become the older ones, so frequent words stay.
    """

    def __init__(self, tokenizer):
        super().__init__({"": b""})
        self.tokenizer, self.old = tokenizer, {}
        self.tokenize = tokenizer.model.tokenize
        self.marks = {m: self.whole(m) for m in ",."}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.learn(word)
        if len(self) >= MEMORY // 2:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def learn(self, word: str) -> bytes:
        """A word of plain lower-case letters is one unit of the tokenizer's pattern, so its model can be asked
        directly; a comma or full stop behind it is a unit of its own. All else goes through the whole tokenizer."""
        if word.isalpha():
            if word.isascii():
                if word.islower():
                    return array("I", [t.id for t in self.tokenize(word)]).tobytes()
            elif max(word) < "\u0250" and word == word.lower():
                unit = word.encode().decode("latin-1").translate(_BYTES)
                return array("I", [t.id for t in self.tokenize(unit)]).tobytes()
        elif word and word[-1] in self.marks and word[:-1].isalpha() and max(word) < "\u0250" and word == word.lower():
            return self[word[:-1]] + self.marks[word[-1]]
        return self.whole(word)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    This tokenizer drops white space and its pattern never looks across it, so the ids of a
    text are those of its words one after another. Words are encoded by the library once
    and looked up afterwards.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text followed by END; a null text counts as empty."""
        end, ids = array("I", [END]).tobytes(), self.words.__getitem__
        return [b"".join(map(ids, _fold(text or ""))) + end for text in texts]


#: Byte-level alphabets write a byte without a visible Latin-1 character as the next code point from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTES = {b: 256 + i for i, b in enumerate(_HIDDEN)}


def _fold(text: str) -> list[str]:
    """Words between blanks and line ends.

    Texts of Latin-1 characters go to lower case first, as the tokenizer does anyway, but for
    those that may hold a special token, which it looks for in the text as it is.
    """
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return text.replace("\n", " ").split(" ")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
