"""Token ids of whole texts, with a bounded table of words per Python worker.

Both tokenizers used here never let a token reach from a non-space over a
following space, so a text's ids are the ids of its space-led chunks in a row.
Chunks repeat, whole texts seldom do: each worker encodes a chunk once and
keeps its ids. Texts with unusual spaces or controls, where libraries could
disagree about what a space is, and texts that hold the name of an added token,
which the tokenizer gives that token's id, go to the tokenizer itself. Long texts
are encoded slice by slice, cut at a space between ASCII letters or digits: no
token of either tokenizer reaches over such a place.
"""

from __future__ import annotations

import os
import re

import numpy as np

from fidelmill.llm.wordtable import Flat, Words, plain_words, runs, spaced_words

#: Spaces beyond ASCII's, and controls that Python alone counts as space.
ODD = re.compile("[\x00\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")

#: Characters of a slice of a long text, about, and where it may be cut.
SLICE = 1 << 18
CUT = re.compile("[A-Za-z0-9] (?=[A-Za-z0-9])")

_encoders: dict[tuple[str, str], "Encoder"] = {}


def slices(text: str) -> list[str]:
    """A text in pieces whose ids in a row are the text's."""
    out, at = [], 0
    while len(text) - at > SLICE:
        found = CUT.search(text, at + SLICE)
        if not found:
            break
        out.append(text[at : found.end() - 1])
        at = found.end() - 1
    return [*out, text[at:]] if at else [text]


class Encoder:
    """``encode(texts)`` gives the ids of each text as an array of unsigned 32-bit integers: those of the library's own ``encode``.

    ``chunks`` is "byte" for a byte-level BPE whose chunks keep their leading
    space, or "word" for one that drops space and case. New chunks are encoded
    together, apart by a separator whose single id marks where each ends.
    """

    def __init__(self, path: str, chunks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([ODD.pattern, *(f"(?i:{a})" for a in added)]))
        self.by_byte = chunks == "byte"
        self.between = "\n" if self.by_byte else " \x00 "
        (self.mark,) = self._ids(self.between)
        self.words = Words(spaced_words if self.by_byte else plain_words, self._learn, self._forget)
        self._forget()

    def _forget(self) -> None:
        self.ids, self.start = Flat("<u4"), Flat(np.int64)
        self.start.extend(np.zeros(1, np.int64))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self._ids(text), "<u4")

    def _learn(self, new: list[bytes]) -> None:
        """Keeps the ids of new chunks, in their order."""
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            odd = [w.isspace() for w in some]
            ids = self.whole(self.between.join("x" if o else w.decode() for w, o in zip(some, odd)))
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(some) - 1:  # the separator's id occurs in a chunk
                each = [self.whole(w.decode()) for w in some]
                self.ids.extend(np.concatenate(each))
                sizes = np.array([len(x) for x in each])
            else:
                sizes = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
                kept = np.ones(len(ids), bool)
                kept[cuts] = False
                ids = ids[kept]
                if any(odd):
                    each = np.split(ids, np.cumsum(sizes)[:-1])
                    each = [self.whole(w.decode()) if o else x for w, o, x in zip(some, odd, each)]
                    ids, sizes = np.concatenate(each), np.array([len(x) for x in each])
                self.ids.extend(ids)
            self.start.extend(self.start.data[self.start.n - 1] + np.cumsum(sizes))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if all(len(t) <= SLICE for t in texts):
            return self._encode(texts)
        parts = [slices(t) for t in texts]
        upto = np.cumsum([0, *map(len, parts)]).tolist()
        got = self._encode([s for p in parts for s in p])
        return [np.concatenate(got[a:b]) if b - a > 1 else got[a] for a, b in zip(upto, upto[1:])]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = {i: self.whole(t) for i, t in enumerate(texts) if self.odd.search(t)}
        raw = [b"" if i in odd else t.encode() for i, t in enumerate(texts)]
        if not self.by_byte:
            raw = [r.lower() for r in raw]
        out: list[np.ndarray] = []
        for a, b in runs(raw):
            entry, begin = self.words.entries(raw[a:b])
            start = self.start.data[entry]
            size = self.start.data[entry + 1] - start
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = self.ids.data[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
            out += np.split(ids, upto[begin[1:-1]])
        return [odd.get(i, x) for i, x in enumerate(out)]


def encoder(path: str, chunks: str) -> Encoder:
    """The worker's encoder for a tokenizer file; ``chunks`` is "byte" or "word"."""
    if (path, chunks) not in _encoders:
        _encoders[path, chunks] = Encoder(path, chunks)
    return _encoders[path, chunks]


def vocabulary_size(path: str) -> int:
    """Ids of a tokenizer file, added tokens included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
