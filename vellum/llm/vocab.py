"""Byte-level BPE ids, one library call for each distinct word instead of one for each text.

The vocabulary's pre-tokeniser never joins what stands on the two sides of the point between a
character that is not white space and white space after it.  So the ids of a text are those of its
pieces "white space, then other characters", in order, and a piece that was met before isn't encoded again.
An added token in a text, such as '<|endoftext|>', is one id, as the library gives it; it must hold and strip no white space.
Known pieces and their ids are columns, and looking up a portion's distinct pieces is one Arrow call.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode's White_Space, as the pre-tokeniser's \\s has it.
WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of pieces and ids kept by a Python worker; beyond it those go that weren't met for longest.
CACHE = 24 << 20
#: Bytes of text encoded at once, where texts are shorter: the more, the fewer pieces are looked up.
PORTION = 4 << 20
#: Pieces that make one text for the library.
JOINED = 256
#: Texts that have other white space than single spaces and line ends between words, or a character that marks pieces.
_ODD = f"\\A[ \\n]|[ \\n]\\z|[ \\n][ \\n]|[\\x00-\\x09\\x0b-\\x1f{WS[4:]}]"


class _Known:
    """Keys that were met, and their ids."""

    def __init__(self, ask):
        self.ask, self.now = ask, 0
        self.keys = pa.array([], pa.string())
        self.ids, self.starts, self.lengths, self.met = np.zeros(0, np.uint32), *(np.zeros(0, np.int32) for _ in range(3))

    def find(self, keys: pa.Array) -> np.ndarray:
        """Places of distinct keys, which are learned if they are new."""
        at = pc.index_in(keys, value_set=self.keys)
        place = at.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        if at.null_count:
            new = keys.filter(at.is_null())
            ids, lengths = self.ask(new.to_pylist())
            place[place < 0] = np.arange(len(self.keys), len(self.keys) + len(new), dtype=np.int32)
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths, dtype=np.int32) - lengths))
            self.lengths, self.ids = np.concatenate((self.lengths, lengths)), np.concatenate((self.ids, ids))
            self.keys, self.met = pa.concat_arrays([self.keys, new]), np.concatenate((self.met, np.zeros(len(new), np.int32)))
        self.now += 1
        self.met[place] = self.now
        return place

    def forget(self) -> None:
        """Keep the half that was met last, or nothing if that is too much as well."""
        if self.keys.nbytes + self.ids.nbytes <= CACHE:
            return
        kept = np.sort(np.argsort(self.met, kind="stable")[len(self.met) // 2 :])
        many = self.lengths[kept]
        starts = np.cumsum(many, dtype=np.int32) - many
        self.ids = self.ids[np.repeat(self.starts[kept] - starts, many) + np.arange(int(many.sum()))]
        self.keys, self.starts, self.lengths, self.met = self.keys.take(pa.array(kept)), starts, many, self.met[kept]
        if self.keys.nbytes + self.ids.nbytes > CACHE:
            self.__init__(self.ask)


class Encoder:
    """``ids(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if any(a.lstrip or a.rstrip or re.search(f"[{WS}]", a.content) for a in self.tokenizer.get_added_tokens_decoder().values()):
            raise RuntimeError("an added token of the vocabulary reaches across white space")
        # a piece that starts with a space or line end starts with a token that does, and no other token of it does
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for token, i in vocabulary.items() if token[0] in "\u0120\u010a"]] = True
        self.usual, self.other = _Known(self._ask_usual), _Known(self._ask)

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, and how many each has, from the library."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _ask_usual(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Keys are told apart by their first character: \\1 before a text's first word, a line end, or else a space that is left out."""
        first = np.fromiter((k[:1] == "\1" for k in keys), bool, len(keys))
        joined = [k if k[:1] == "\n" else " " + k for k in keys if k[:1] != "\1"]
        ids, lengths = self._ask(["".join(joined[a : a + JOINED]) for a in range(0, len(joined), JOINED)])
        starts = np.flatnonzero(self.starts[ids])
        if len(starts) != len(joined):
            raise RuntimeError("the vocabulary's pre-tokeniser joins words with the space after them")
        alone, alone_lengths = self._ask([k[1:] for k in keys if k[:1] == "\1"])
        out = np.zeros(len(keys), np.int32)
        out[first], out[~first] = alone_lengths, np.diff(starts, append=len(ids))
        owner, every = np.repeat(first, out), np.zeros(len(ids) + len(alone), np.uint32)
        every[owner], every[~owner] = alone, ids
        return every, out

    def ids(self, texts) -> list[bytes]:
        """Of a list or Arrow array of strings; null is empty."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.string()).fill_null("")
        out: list[bytes] = []
        for part in _portions(column):
            kind = np.where(pc.match_substring_regex(part, _ODD).to_numpy(zero_copy_only=False), np.where(pc.match_substring(part, "\1").to_numpy(zero_copy_only=False), 2, 1), 0)
            ways = (self._usual, self._unusual, self._marked)
            found = [iter(way(part.filter(pa.array(kind == k))) if (kind == k).any() else ()) for k, way in enumerate(ways)]
            out += [next(found[k]) for k in kind.tolist()]
        return out

    def _usual(self, texts: pa.Array) -> list[bytes]:
        """Texts with one space or line end between words: each word, with what is before it, is a piece."""
        marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\1"), texts, pa.scalar("")), "\n", " \n")
        return _joined(pc.split_pattern(marked, " "), self.usual)

    def _unusual(self, texts: pa.Array) -> list[bytes]:
        return _joined(pc.split_pattern(pc.replace_substring_regex(texts, f"([^{WS}])([{WS}])", "\\1\1\\2"), "\1"), self.other)

    def _marked(self, texts: pa.Array) -> list[bytes]:
        """Texts that have the character which would mark their pieces."""
        ids, lengths = self._ask(texts.to_pylist())
        return _cut(ids, np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))))


def _joined(cut: pa.ListArray, known: _Known) -> list[bytes]:
    """The ids of each text from those of its pieces."""
    every = cut.flatten().dictionary_encode()
    place = known.find(every.dictionary)[every.indices.to_numpy()]
    many = known.lengths[place]
    ends = np.cumsum(many, dtype=np.int32)  # a portion has far fewer than 2^31 ids, but for one text of gigabytes
    source = np.repeat(known.starts[place] - (ends - many), many)
    source += np.arange(len(source), dtype=np.int32)
    out = _cut(known.ids[source], np.concatenate(([0], ends))[cut.offsets.to_numpy()])
    known.forget()
    return out


def _cut(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    flat, bounds = ids.astype("<u4", copy=False).tobytes(), (bounds * 4).tolist()
    return [flat[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]


def _portions(column: pa.Array):
    """Slices of about PORTION bytes."""
    sizes = np.cumsum(pc.binary_length(column).to_numpy()) if len(column) else np.zeros(0, np.int64)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PORTION, side="right")))
        yield column.slice(at, end - at)
        at = end


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    return Encoder(path)


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
