"""Token ids of whole texts with a vocabulary file of the ``tokenizers`` library.

Byte-level vocabularies split a text before a single space or newline between
two non-space characters, and before a comma or full stop after a letter or
digit, whatever the rest of the text: their pattern starts a new word at such
a place and no word reaches over it.  Encoding the
pieces between those places one by one gives the ids of the whole text, and a
piece seen before needs no second encoding.  In most texts all spaces,
newlines, commas and full stops are such places, and no pattern is needed to
find the pieces.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

from .worker import turn_to

#: a word of a byte-level vocabulary always starts here
SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=[^\W_])(?=[.,])")
#: a piece up to the next such place; first the common forms, which need no test at each of their characters
PIECE = re.compile(r"[ \n]?[^\W_]+(?=[.,]|[ \n]\S|\Z)|[.,](?=[ \n]\S)|(?s:.+?)(?:" + SAFE.pattern + r"|\Z)")
#: a comma or full stop that is no such place
LOOSE = re.compile(r"[.,](?<![^\W_][.,])")
#: code points of the parts of a text that holds some that are no such place
PART = 256
#: words of a vocabulary that drops white space end here
WHITE = re.compile(r"[ \t-\r]")
#: code points of a text held in pieces at one time
SLICE = 1 << 20
#: pieces kept with their ids in a worker: so many new ones, and as many from before
MEMO = 500_000

_LOADED: dict[str, object] = {}
_MODELS: dict[str, Callable] = {}
_SPECIAL: dict[str, list[str]] = {}
_IDS: dict[tuple[str, bool], Memo] = {}
#: Latin letters with ASCII marks after them, but for the apostrophe, which can begin a piece with letters in it
LATIN = re.compile("([A-Za-z\xaa-\u024f]+)([!-&(-/:-@\\[-`{-~]{0,3})")
_TAILS: dict[tuple[str, str], bytes] = {}
_SIGNS: dict[int, str] = {}
_NEWLINE: dict[str, bool] = {}


def tokenizer(vocabulary: str):
    """The tokenizer of a file path, or of a file name that ``public_tokenizers`` knows."""
    if vocabulary not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        path = vocabulary
        if not os.path.exists(path):
            import public_tokenizers
            path = public_tokenizers.path(vocabulary)
        _LOADED[vocabulary] = Tokenizer.from_file(str(path))
    return _LOADED[vocabulary]


def slices(text: str, size: int = SLICE, cut: re.Pattern = SAFE) -> Iterator[str]:
    """Cut a text at safe places, each slice at least ``size`` long but the last."""
    at = 0
    while len(text) - at > size:
        place = cut.search(text, at + size)
        if place is None:
            break
        yield text[at:place.start()]
        at = place.start()
    yield text[at:]


def even(text: str) -> bool:
    """Whether a text can be cut before each of its spaces, newlines, commas and full stops."""
    flat = text.replace("\n", " ")
    # of white space, the space alone is printable
    return flat.isprintable() and "  " not in flat and flat[-1:] != " " and not LOOSE.search(text, 1)


def pieces(text: str) -> list[str]:
    """The pieces of a text between the places where a word always starts; some may be empty."""
    if even(text):
        marked = text.replace(" ", "\0 ").replace("\n", "\0\n").replace(",", "\0,").replace(".", "\0.")
        return marked.split("\0")
    if len(text) <= 2 * PART:
        return PIECE.findall(text)
    return [p for part in slices(text, PART) for p in (pieces(part) if len(part) <= 2 * PART else PIECE.findall(part))]


def model_ids(string: str, vocabulary: str) -> bytes:
    """The ids of a string that normalisation and splitting leave whole."""
    model = _MODELS.get(vocabulary)
    if model is None:
        model = _MODELS[vocabulary] = tokenizer(vocabulary).model.tokenize
    return array("I", [x.id for x in model(string)]).tobytes()


def special(vocabulary: str) -> list[str]:
    """The special strings of a vocabulary."""
    if vocabulary not in _SPECIAL:
        _SPECIAL[vocabulary] = [a.content for a in tokenizer(vocabulary).get_added_tokens_decoder().values()]
    return _SPECIAL[vocabulary]


def piece_ids(piece: str, vocabulary: str) -> bytes:
    """The ids of a piece by itself, by the library's own steps; with a special string in it, all of its encoding."""
    t = tokenizer(vocabulary)
    if any(a in piece for a in special(vocabulary)):
        return array("I", t.encode(piece, add_special_tokens=False).ids).tobytes()
    whole = t.normalizer.normalize_str(piece) if t.normalizer else piece
    return b"".join(model_ids(part, vocabulary) for part, _ in t.pre_tokenizer.pre_tokenize_str(whole))


def byte_signs() -> dict[int, str]:
    """How byte-level steps write each Latin character, for ``str.translate``."""
    if not _SIGNS:
        from tokenizers.pre_tokenizers import ByteLevel
        step = ByteLevel(add_prefix_space=False, use_regex=False)
        _SIGNS.update((c, step.pre_tokenize_str(chr(c))[0][0]) for c in (0x20, *range(0x41, 0x250)))
    return _SIGNS


def word_piece_ids(word: bytes, vocabulary: str) -> bytes:
    """``piece_ids`` for a vocabulary of words.

    Latin letters go to the model alone, in lower case: there they are one
    piece, in the normal form already.  Up to three marks after them are a
    piece of their own.
    """
    if word.isalpha():                          # of bytes: ASCII letters only
        return model_ids(word.decode().lower(), vocabulary)
    text = word.decode()
    found = LATIN.fullmatch(text)
    letters = found[1].lower() if found else ""
    if not letters.isalpha():
        return piece_ids(text, vocabulary)
    return model_ids(letters.translate(byte_signs()), vocabulary) + marks_ids(found[2], vocabulary)


def marks_ids(marks: str, vocabulary: str) -> bytes:
    """The ids of a newline, or of up to three marks after letters, each of which is encoded once."""
    if (vocabulary, marks) not in _TAILS:
        _TAILS[vocabulary, marks] = piece_ids(marks, vocabulary)
    return _TAILS[vocabulary, marks]


def newline_alone(vocabulary: str) -> bool:
    """Whether a newline and the letters after it are two words of a vocabulary."""
    if vocabulary not in _NEWLINE:
        _NEWLINE[vocabulary] = len(tokenizer(vocabulary).pre_tokenizer.pre_tokenize_str("\na")) == 2
    return _NEWLINE[vocabulary]


def byte_piece_ids(piece: str, vocabulary: str) -> bytes:
    """``piece_ids`` for a byte-level vocabulary.

    Latin letters, with a space before them or not, go to the model alone.
    Up to three marks after them are a word of their own, and so is a newline
    before them where the vocabulary parts the two.
    """
    first, signs = piece[:1], byte_signs()
    letters = piece[1:] if first == " " or first == "\n" else piece
    if first != "\n" and letters.isascii() and letters.isalpha():
        return model_ids(signs[0x20] + letters if first == " " else letters, vocabulary)
    found = LATIN.fullmatch(letters)
    if not found or not found[1].isalpha() or any(a in piece for a in special(vocabulary)):
        return piece_ids(piece, vocabulary)
    head = b""
    if first == "\n":
        if not newline_alone(vocabulary):
            return piece_ids(piece, vocabulary)
        head, first = marks_ids("\n", vocabulary), ""
    word = found[1].translate(signs)
    ids = model_ids(signs[0x20] + word if first == " " else word, vocabulary)
    return head + ids + (marks_ids(found[2], vocabulary) if found[2] else b"")


class Memo(dict):
    """The ids of pieces (words as bytes, for a vocabulary of words).

    A lookup finds or makes them.  When ``MEMO`` pieces are held they become
    the old ones, which are looked at before a piece is encoded again.
    """

    def __init__(self, vocabulary: str, words: bool):
        self.vocabulary, self.encode, self.old = vocabulary, word_piece_ids if words else byte_piece_ids, {}

    def __missing__(self, piece) -> bytes:
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece, self.vocabulary)
        self[piece] = ids
        return ids


def memo(vocabulary: str, words: bool) -> Memo:
    turn_to(_IDS)
    if (vocabulary, words) not in _IDS:
        _IDS[vocabulary, words] = Memo(vocabulary, words)
    return _IDS[vocabulary, words]


def byte_level_ids(text: str, vocabulary: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit numbers, no special tokens added."""
    ids = memo(vocabulary, False).__getitem__
    return b"".join(b"".join(map(ids, pieces(part))) for part in slices(text))


def word_ids(text: str, vocabulary: str) -> bytes:
    """As ``byte_level_ids``, for a vocabulary of words: word by word between ASCII white space.

    Such a vocabulary drops white space: its pattern matches none, its
    normalisation (NFC, runs of white space, lower case of single characters)
    joins nothing across it, and no special string holds any.
    """
    ids = memo(vocabulary, True).__getitem__
    return b"".join(b"".join(map(ids, part.encode().split())) for part in slices(text, cut=WHITE))
