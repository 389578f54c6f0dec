"""Token ids of ``word_bpe_49k.json``, with the work done once per distinct piece of text.

The tokenizer never joins characters across white space, so a text's ids are those of its
chunks between blanks one after the other, and a chunk's ids can be remembered. The memory
(``Memory``) is bounded: two generations of ``limit`` chunks, the older one dropped when the newer is
full. ``ChunkIds`` keeps words in one numpy store instead, and starts anew above its limit.
"""

from __future__ import annotations

import gc
import json
import os
from collections.abc import Callable
from itertools import chain, pairwise
from typing import Any

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

DEFAULT_PATH = public_tokenizers.path("word_bpe_49k.json")
# The tokenizer's own split of a chunk, and its special strings (fixed values).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
# Python and its regular expressions take these four for white space; the tokenizer doesn't.
NOT_BLANK = regex.compile("[\x1c-\x1f]")
# Below this code point, but for one letter, lower-casing keeps the length, is the same in
# every library, and no normal form changes anything.
SIMPLE_BELOW, NOT_SIMPLE = "ɐ", "İ"
# A word of simple letters and the ASCII marks that follow it: two pieces at most.
PLAIN = (
    "^(?P<word>[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)"
    r"(?P<marks>[!-/:-@\[-`{-~]*)$"
)


def is_simple(chunk: str) -> bool:
    if chunk.isascii():
        return "<|" not in chunk and not NOT_BLANK.search(chunk)
    return max(chunk) < SIMPLE_BELOW and NOT_SIMPLE not in chunk and "<|" not in chunk and not NOT_BLANK.search(chunk)


def split_simple(chunk: str) -> list[str]:
    """Pieces of a simple chunk. Below the limit ``isalpha`` is the same as being a letter."""
    low = chunk.lower()
    if low.isalpha():
        return [low]
    if low[:-1].isalpha() and not low[-1].isalnum() and not low[-1].isspace():
        return [low[:-1], low[-1]]
    return PIECES.findall(low)


class Memory:
    """Values of chunks; ``compute`` gets the unknown ones of many texts at once."""

    def __init__(self, compute: Callable[[list[str]], list[Any]], limit: int = 400_000):
        self.compute, self.limit = compute, limit
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def learn(self, wanted: set[str], compute: Callable[[list[str]], list[Any]] | None = None) -> dict[str, Any]:
        """A mapping that has at least the wanted chunks, until the next call."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        unknown = []
        for c in wanted.difference(self.young):
            known = self.old.get(c)
            if known is None:
                unknown.append(c)
            else:
                self.young[c] = known
        if unknown:
            self.young.update(zip(unknown, (compute or self.compute)(unknown)))
        return self.young


class Store:
    """Id sequences by name. Names are one Arrow array and ids one growing numpy array, so a name
    takes little beside its own bytes; a dictionary of strings takes about five times as much."""

    def __init__(self) -> None:
        self.names = pa.array([""], pa.large_string())
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def rows(self, names: pa.Array) -> np.ndarray:
        """Numbers of names, -1 for unknown ones. Arrow hashes all known names in every call."""
        found = pc.fill_null(pc.index_in(names, value_set=self.names), -1)
        return found.to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> dict[str, int]:
        """The sequences of new names, which lie in ``ids`` one after the other, and their numbers."""
        first, n = len(self.names), len(names)
        self.names = pa.concat_arrays([self.names, pa.array(names, pa.large_string())])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + n] = lengths
        self.used += len(ids)
        return dict(zip(names, range(first, first + n)))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of ``rows`` one after the other, and where each one ends."""
        each = self.lengths[rows]
        ends = np.cumsum(each)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat(self.starts[rows] - ends + each, each)
        return self.flat[at], ends


class ChunkIds:
    """Ids of whole texts as little-endian unsigned 32-bit integers. Chunks are remembered, up to
    about ``limit``; then the memory starts anew."""

    def __init__(self, path: str = DEFAULT_PATH, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        # The memory holds strings only, which are in no cycles; looking for some takes long.
        gc.set_threshold(200_000, 100, 100)
        self.tokenizer = Tokenizer.from_file(path)
        # The same model for pieces, which are normalized and split already. Many go into one text,
        # between spaces, for a call costs more than a piece.
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, BYTES]}
        parts |= {"normalizer": None, "pre_tokenizer": split, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(parts))
        vocabulary = self.model.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit = limit
        self.known = Store()

    def _whole(self, strings: list[str]) -> dict[str, int]:
        """Ids of chunks, each by a call of the tokenizer."""
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        ids = [e.ids for e in found]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return self.known.add(strings, np.fromiter(chain.from_iterable(ids), np.uint32, lengths.sum()), lengths)

    def _pieces(self, strings: list[str]) -> dict[str, int]:
        """Ids of pieces without blanks; the last id of a piece ends a word, and no other does."""
        joined = [" ".join(strings[a : a + 256]) for a in range(0, len(strings), 256)]
        found = self.model.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *[np.array(e.ids, np.uint32) for e in found]])
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(strings):
            raise ValueError("the vocabulary doesn't mark word ends")
        return self.known.add(strings, ids, np.diff(ends, prepend=0))

    def _learn(self, pieces: list[str], odd: list[str]) -> list[int]:
        """Numbers of unknown pieces and, after them, of unknown chunks that are no plain words: these
        are split by the tokenizer's pattern, or given to it whole."""
        split = {c: split_simple(c) for c in odd if is_simple(c)}
        new = set(pieces)
        parts = [p for p in set(chain.from_iterable(split.values())) if p not in new]
        at = dict(zip(parts, self.known.rows(pa.array(parts, pa.large_string())).tolist()))
        at |= self._pieces([*new, *[p for p in parts if at[p] < 0]])
        at |= self._whole([c for c in odd if c not in split and c not in at])
        # A chunk that is a piece of its own is known by now.
        some = {c: ps for c, ps in split.items() if c not in at}
        rows = np.array([at[p] for p in chain.from_iterable(some.values())], np.int64)
        ids, ends = self.known.gather(rows)
        counts = np.cumsum(np.fromiter(map(len, some.values()), np.int64, len(some)))
        at |= self.known.add(list(some), ids, np.diff(np.concatenate([[0], ends])[counts], prepend=0))
        return [at[c] for c in chain(pieces, odd)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. Arrow splits the texts, numbers the different chunks and takes
        plain words apart, so that Python looks only at the different words of a slice."""
        if len(self.known.names) > self.limit:
            self.known = Store()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        numbered = lists.flatten().dictionary_encode()
        plain = pc.extract_regex(numbered.dictionary, PLAIN)
        words = pc.utf8_lower(pc.struct_field(plain, "word")).dictionary_encode()
        marks = pc.struct_field(plain, "marks").dictionary_encode()
        odd = pc.is_null(words.indices)
        names = [words.dictionary, marks.dictionary, numbered.dictionary.filter(odd)]
        n_pieces = len(names[0]) + len(names[1])
        names = pa.concat_arrays(names)
        found = self.known.rows(names)
        new = np.flatnonzero(found < 0)
        if len(new):
            unknown = names.take(pa.array(new)).to_pylist()
            n_new = int(np.searchsorted(new, n_pieces))
            found[new] = self._learn(unknown[:n_new], unknown[n_new:])

        # Each chunk is two items: its word (or the whole odd chunk) and its marks (or nothing).
        items = np.zeros((len(odd), 2), np.int64)
        is_odd = odd.to_numpy(zero_copy_only=False)
        items[~is_odd, 0] = found[words.indices.drop_null().to_numpy()]
        items[~is_odd, 1] = found[marks.indices.drop_null().to_numpy() + len(words.dictionary)]
        items[is_odd, 0] = found[n_pieces:]
        tokens, ends = self.known.gather(items[numbered.indices.to_numpy()].ravel())
        tokens, ends = tokens.tobytes(), np.concatenate([[0], ends])
        upto = [0, *(4 * ends[2 * np.cumsum(pc.list_value_length(lists).to_numpy())]).tolist()]
        return [tokens[a:b] for a, b in pairwise(upto)]
