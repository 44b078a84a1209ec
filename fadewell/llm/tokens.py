"""Whole texts to token ids with a public byte-level BPE vocabulary.

The vocabulary's pattern never lets a token reach over the place between a character that is not white
space and one that is. A text is therefore cut there, each distinct piece is encoded once per worker, and
the ids are joined; they are the ids of the whole text. Texts with white space beyond ASCII are encoded
in one go, because there the tokenizer's and Python's ideas of white space differ, and so are texts that
hold an added token (the end mark) literally: the tokenizer gives it its own id, as it does for whole texts.

Most pieces are plain: ASCII or Latin letters after one space or line break. New ones go to the library's BPE
model in long strings, without the tokenizer's alignment of every byte. There no merge reaches over a place
where the pattern cuts, because no token of the vocabulary does (`_direct` looks); all others go through
the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import KEPT_TABLES, give_back, keep_only

PIECES_KEPT = 100_000  # a worker's table of encoded pieces starts anew beyond it; of the one before, pieces met again stay
_PIECES = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_OTHER_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACES = frozenset("\t\n\v\f\r ")
_RUN = 4000  # pieces encoded in one call
_GROUP_CHARS = 1_000_000  # of texts whose distinct pieces are looked up at once
_MODEL_RUN = 50  # plain pieces in one call of the model
_LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"  # letters in every version of Unicode
_PLAIN = re.compile(rf"\n?[!-&(-~{_LATIN}]+").fullmatch  # keys; an apostrophe may begin a word of its own
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_WORD_ENDS = frozenset(c for c in map(chr, range(48, 0x250)) if re.match(f"[0-9{_LATIN}]", c))
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that the vocabulary writes as themselves
_AS_SHOWN = {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - _SHOWN))}
_ALL_SHOWN = "".join(_AS_SHOWN.get(b, chr(b)) for b in range(256))
_AS_BYTE = {ord(c): b for b, c in _AS_SHOWN.items()}
#: tokens that plain pieces in a row cannot have, and those inside one word of the pattern; a byte above 127 belongs to a letter
_NEVER = re.compile(rb"[^\n !-&(-~\x80-\xbf\xc3-\xc9]|[ \n]{2}").search
_INSIDE = re.compile(rb" ?(?:[A-Za-z\x80-\xff]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|[ \n]").fullmatch


def _spaced(text: str) -> str | None:
    """Keys of the pieces, joined by spaces, but the first is " " and the key; None where white space is not single spaces and line breaks."""
    if "\n\n" in text or "\t" in text or "\r" in text or "\v" in text or "\f" in text or text[0] in _SPACES or text[-1] in _SPACES:
        return None
    spaced = text.replace("\n", " \n")
    return None if "  " in spaced else spaced


def _keys(text: str) -> list[str]:
    """Pieces as keys: "x" is " x", " x" is "x" at the start of a text, all else stands for itself."""
    keys = [p[1:] if p[0] == " " and len(p) > 1 and p[1] not in _SPACES else p for p in _PIECES.findall(text)]
    if text[0] not in _SPACES:
        keys[0] = " " + keys[0]
    return keys


def _piece(key: str) -> str:
    if key[0] == " " and len(key) > 1 and key[1] not in _SPACES:
        return key[1:]
    return key if key[0] in _SPACES else " " + key


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: tokens that the tokenizer finds before its pattern cuts the text, such as an end mark written out
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # byte-level: one character for each byte
        self.model = self.tokenizer.model
        self.direct = self._direct()
        self.kept: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def forget(self) -> None:
        self.kept, self.former, self.marks = {}, {}, {}
        give_back()

    def _direct(self) -> bool:
        """Whether the model alone gives plain pieces the ids that the tokenizer gives them."""
        from tokenizers.pre_tokenizers import ByteLevel

        cut = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or not isinstance(cut, ByteLevel) or cut.add_prefix_space or not cut.use_regex:
            return False
        tokens = (t.translate(_AS_BYTE).encode("latin-1", "replace") for t in self.tokenizer.get_vocab(with_added_tokens=False))
        return all(_INSIDE(t) or _NEVER(t) for t in tokens)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[str]) -> None:
        again = self.former.keys() & keys
        for k in again:
            self.kept[k] = self.former[k]
        new = [k for k in keys if k not in again] if again else keys
        plain = [k for k in new if _PLAIN(k)] if self.direct else []
        if plain:
            self._learn_plain(plain)
        if len(plain) < len(new):
            self._learn_joined([k for k in new if k not in self.kept])

    def _learn_plain(self, keys: list[str]) -> None:
        """Keys of _PLAIN: many at a time to the model, cut by the byte lengths of the tokens."""
        pieces = [k if k[0] == "\n" else " " + k for k in keys]
        found: list[int] = []
        for at in range(0, len(pieces), _MODEL_RUN):
            text = charmap_decode("".join(pieces[at : at + _MODEL_RUN]).encode(), "strict", _ALL_SHOWN)[0]
            found += [t.id for t in self.model.tokenize(text)]
        ids = np.array(found, "<u4")
        ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in pieces])
        cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, "right") * 4
        raw, start = ids.tobytes(), 0
        for k, end in zip(keys, cuts.tolist()):
            self.kept[k] = raw[start:end]
            start = end

    def _learn_joined(self, keys: list[str]) -> None:
        """Pieces of white space and then other text are encoded as one text, which is cut by the byte
        lengths of its tokens; that costs far less than one call each."""
        pieces = [_piece(k) for k in keys]
        run = [i for i, p in enumerate(pieces) if p[0] in _SPACES and p[-1] not in _SPACES]
        for at in range(0, len(run), _RUN):
            part = [pieces[i] for i in run[at : at + _RUN]]
            raw = self._whole(["".join(part)])[0]
            ends = np.cumsum([len(p.encode("utf-8", "replace")) for p in part])
            cuts = np.searchsorted(np.cumsum(self.bytes_of[np.frombuffer(raw, "<u4")]), ends, "right") * 4
            start = 0
            for i, end in zip(run[at : at + _RUN], cuts.tolist()):
                self.kept[keys[i]] = raw[start:end]
                start = end
        inside = set(run)
        rest = [i for i in range(len(pieces)) if i not in inside]
        for i, ids in zip(rest, self._whole([pieces[i] for i in rest])):
            self.kept[keys[i]] = ids

    def _uncut(self, text: str) -> bool:
        """Texts that may have a token across a cut: other white space, or an added token written out."""
        return (not text.isascii() and _OTHER_SPACE.search(text) is not None) or any(a in text for a in self.added)

    def _found(self, keys: list[str]) -> list[bytes]:
        """Ids of each key. Only stems are kept: marks after a letter or digit are a word of their own."""
        if len(self.kept) > PIECES_KEPT:
            self.kept, self.former, self.marks = {}, self.kept, {}
        found = list(map(self.kept.get, keys))
        if None not in found:
            return found
        missing = [i for i, v in enumerate(found) if v is None]
        stems = [keys[i] for i in missing]
        if self.direct:
            stems = [s if (s := k.rstrip(_MARKS)) and s[-1] in _WORD_ENDS else k for k in stems]
        new = {s for s in stems if s not in self.kept}
        if new:
            self._learn(list(new))
        for i, stem in zip(missing, stems):
            marks = keys[i][len(stem) :]
            if marks and marks not in self.marks:
                self.marks[marks] = np.array([t.id for t in self.model.tokenize(marks)], "<u4").tobytes()
            found[i] = self.kept[stem] + self.marks[marks] if marks else self.kept[stem]
        return found

    def _ids_spaced(self, texts: list[str]) -> list[bytes]:
        """Texts of _spaced: Arrow cuts them, and each distinct key of all is looked up once."""
        firsts, _, rests = zip(*(t.partition(" ") for t in texts))
        words = pc.split_pattern(pa.array([r or None for r in rests], pa.large_string()), " ")
        coded = pc.dictionary_encode(words.values)
        found = np.array([*self._found(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), None], object)[:-1]
        found = found[coded.indices.to_numpy()].tolist()
        ends = words.offsets.to_pylist()
        starts = self._found([" " + f for f in firsts])
        return [first + b"".join(found[a:b]) for first, a, b in zip(starts, ends, ends[1:])]

    def ids(self, texts: list[str | None], group: int = 250) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null: none."""
        at = 0
        while at < len(texts):
            part: list[str | None] = []
            chars = 0
            while at < len(texts) and len(part) < group and chars < _GROUP_CHARS:
                part.append(texts[at])
                chars, at = chars + len(texts[at] or ""), at + 1
            cut = [bool(t) and not self._uncut(t) for t in part]
            spaced = [_spaced(t) if c else None for t, c in zip(part, cut)]
            usual = [s for s in spaced if s is not None]
            rows = iter(self._ids_spaced(usual) if usual else [])
            for t, c, s in zip(part, cut, spaced):
                if s is not None:
                    yield next(rows)
                elif c:
                    yield b"".join(self._found(_keys(t)))
                else:
                    yield self._whole([t])[0] if t else b""


_ENCODERS: dict[str, Encoder] = {}
KEPT_TABLES.append(_ENCODERS)


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    keep_only(_ENCODERS)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
