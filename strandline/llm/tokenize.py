"""Token ids of whole texts from the public tokenizer files, with a bounded cache of word pieces.

Both vocabularies cut a text into words by a fixed pattern before they merge, so a word's ids don't depend on its neighbours. For a
text made only of the characters in PLAIN (ASCII and Latin letters, spaces, line feeds; there the pattern's classes are plain
sets), words are cut here, looked up, and only new ones are given to the tokenizer, many at a time. Any other text is given to
it whole, and so is one that contains an added token, such as <|endoftext|>, which the library makes one id. Either way the ids are the library's own; tests compare both ways.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import compress, count, repeat
from operator import is_

import numpy as np

PLAIN = re.compile(r"[ \n!-~¡-įı-ſ]*")
#: Chunks kept per worker; then the cache starts anew. About 100 MB; twice as many where chunks keep their case and space.
CACHE = 500_000
_loaded: dict[tuple[str, bool], TextEncoder] = {}


def _class(kind: str) -> str:
    """The plain characters of a general category."""
    return "".join(c for c in map(chr, range(0x30, 0x180)) if unicodedata.category(c)[0] == kind)


_L, _N = _class("L"), _class("N")
#: The vocabularies' own word patterns (fixed values) over the plain characters.
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACED_WORDS = re.compile(rf"{_ENDINGS}| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
BARE_WORDS = re.compile(rf"{_ENDINGS}|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: Letters alone, in a list of chunks joined by marks.
_SPACED, _BARE = re.compile(rf"(?<![^\0]) [{_L}]+(?![^\0])"), re.compile(rf"(?<![^\0])[{_L}]+(?![^\0])")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TextEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    ``keeps_space``: white space is part of the ids, and a word's first id holds its leading space; otherwise texts are
    lower-cased, white space is dropped, and a word's last id marks its end.
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        self.words, self.simple = (SPACED_WORDS, _SPACED) if keeps_space else (BARE_WORDS, _BARE)
        self.cache: dict[str, bytes] = {}
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: In any case of letters: the library may look for an added token after it has lower-cased the text.
        self.added = re.compile("|".join(added) or r"(?!)", re.IGNORECASE)
        names = self.tokenizer.get_vocab()
        #: The line feed's own id, which no word has.
        self.line = names.get("Ċ") if keeps_space else None
        self.edge = np.zeros(max(names.values()) + 1, bool)
        self.edge[[i for name, i in names.items() if (name.startswith("Ġ") if keeps_space else name.endswith("</w>"))]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _chunks(self, text: str) -> list[str]:
        if not self.keeps_space:
            return text.lower().split()
        parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        if not parts[0]:
            del parts[0]
        if " " not in parts and "\n" not in parts:
            return parts
        out, run = [], ""
        for part in parts:  # white space that stands alone goes with what follows it
            if part == " " or part == "\n":
                run += part
            else:
                out.append(run + part)
                run = ""
        return [*out, run] if run else out

    def _learn(self, chunks: set[str]) -> None:
        """Puts the chunks, none of which is known, and the words in them into the cache."""
        simple = self.simple.findall("\0".join(chunks))
        cut = {c: self.words.findall(c) for c in chunks.difference(simple)}
        new = set().union(*cut.values()).difference(self.cache, simple)
        simple += self.simple.findall("\0".join(new))
        if simple:  # as one text: the marks tell the words apart
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(simple) if self.keeps_space else " ".join(simple)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.edge[ids]) * 4
            if len(at) != len(simple):
                raise AssertionError("words and marks differ")
            bounds = [*at.tolist(), 4 * len(ids)] if self.keeps_space else [0, *(at + 4).tolist()]
            data = ids.tobytes()
            self.cache.update(zip(simple, [data[a:b] for a, b in zip(bounds, bounds[1:])]))
        others = [w for w in new if w not in self.cache]
        if self.line is not None:  # likewise, a line each; white space alone would join the line feeds
            lines = [w for w in others if not w.isspace()]
            others = [w for w in others if w.isspace()]
            if lines:
                ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(ids == self.line) * 4
                if len(ends) != len(lines) - 1:
                    raise AssertionError("words and lines differ")
                data = ids.tobytes()
                self.cache.update(zip(lines, [data[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(data)])]))
        self.cache.update(zip(others, self._library(others) if others else []))
        cache = self.cache
        for c, words in cut.items():
            if len(words) != 1:
                cache[c] = b"".join([cache[w] for w in words])

    def _most(self) -> int:
        return 2 * CACHE if self.keeps_space else CACHE

    def _plain(self, chunks: list[str]) -> bytes:
        cache = self.cache
        try:
            return b"".join(map(cache.__getitem__, chunks))
        except KeyError:
            new = set(chunks).difference(cache)
            if len(cache) + len(new) > self._most():
                cache.clear()
                if len(new) > self._most() // 2:  # more than is kept: in stretches
                    return b"".join([self._plain(chunks[i : i + self._most() // 2]) for i in range(0, len(chunks), self._most() // 2)])
                new = set(chunks)
            self._learn(new)
            return b"".join([cache[c] for c in chunks])

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [PLAIN.fullmatch(t) is not None and self.added.search(t) is None for t in texts]
        chunks = [self._chunks(t) if p else [] for t, p in zip(texts, plain)]
        get, missing = self.cache.get, set()
        found = [list(map(get, own)) for own in chunks]  # one look at the large cache for each chunk
        short = [list(compress(count(), map(is_, ids, repeat(None)))) for ids in found]
        for own, places in zip(chunks, short):
            missing.update([own[j] for j in places])
        rest = [i for i, p in enumerate(plain) if not p]
        whole = dict(zip(rest, self._library([texts[i] for i in rest]) if rest else []))
        if len(self.cache) + len(missing) > self._most():
            self.cache.clear()
            return [self._plain(own) if p else whole[i] for i, (own, p) in enumerate(zip(chunks, plain))]
        if missing:
            self._learn(missing)
        cache = self.cache
        for own, ids, places in zip(chunks, found, short):
            for j in places:
                ids[j] = cache[own[j]]
        return [b"".join(ids) if p else whole[i] for i, (ids, p) in enumerate(zip(found, plain))]


def encoder(path: str, keeps_space: bool) -> TextEncoder:
    """One encoder per Python worker and file."""
    if (path, keeps_space) not in _loaded:
        _loaded[path, keeps_space] = TextEncoder(path, keeps_space)
    return _loaded[path, keeps_space]
