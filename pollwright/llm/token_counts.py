"""Exact token counts at every prefix, by dynamic programming over byte-pair tokens.

The encoding of a string's prefix is the encoding of a shorter prefix plus one last token, and
a sequence of tokens is an encoding exactly when each two neighbours are. So the count at a
position is one more than the count where its last token starts, and the last token is the
longest vocabulary entry ending there that agrees with the token before it. One pass over a
piece therefore answers every truncation of it.

In this vocabulary a piece's last token carries an end mark. Each position hence has two
states: inside a piece (no mark), and as the end of the truncated text (marked).
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwright.llm.common import per_process, slices
from pollwright.llm.word_bpe import DEFAULT_PATH, NOT_BLANK, PIECES, SPECIALS, Memory, is_simple, regex

SCHEMA = "doc_id bigint, n_chars bigint, n_bytes bigint, n_tokens bigint, steps binary"
NORMAL = regex.compile(f"({'|'.join(map(regex.escape, SPECIALS))})")
# What the tokenizer takes for white space.
BLANK_RUN = regex.compile(r"([\p{White_Space}]+)")


class PrefixCounts:
    """Counts of all prefixes of a piece, a chunk or a text, as steps from prefix to prefix."""

    def __init__(self, path: str = DEFAULT_PATH, limit: int = 300_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        self.to_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        end, self.id = model["end_of_word_suffix"], model["vocab"]
        merges = [tuple(m) for m in model["merges"]]
        self.rank = {(self.id[a], self.id[b]): r for r, (a, b) in enumerate(merges)}
        # A token made by a merge: its rank and its two halves.
        self.made = {self.id[a + b]: (r, self.id[a], self.id[b]) for r, (a, b) in enumerate(merges)}
        self.text = {i: t for t, i in self.id.items()}
        self.end = end
        # Vocabulary as trees over reversed token texts; the token itself stands under key 0.
        self.inner: dict = {}
        self.final: dict = {}
        for token, i in self.id.items():
            node, plain = (self.final, token[: -len(end)]) if token.endswith(end) else (self.inner, token)
            for letter in reversed(plain):
                node = node.setdefault(letter, {})
            node[0] = i
        self.agreed: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}
        self.spines: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.pieces = Memory(lambda many: [self._piece(p) for p in many], limit)
        self.chunks = Memory(self._chunks, limit)

    def _merged(self, symbols: list[int]) -> list[int]:
        """Plain byte-pair merging of a short string."""
        while len(symbols) > 1:
            best = min(pairwise(symbols), key=lambda p: self.rank.get(p, len(self.rank)))
            if best not in self.rank:
                break
            joined = self.id[self.text[best[0]] + self.text[best[1]]]
            out, i = [], 0
            while i < len(symbols):
                if tuple(symbols[i : i + 2]) == best:
                    out.append(joined)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _is_sound(self, token: int) -> bool:
        """Whether the token is the encoding of its own text."""
        found = self.sound.get(token)
        if found is None:
            text = self.text[token]
            marked = text.endswith(self.end)
            letters = list(text[: -len(self.end)] if marked else text)
            if marked:
                letters[-1] += self.end
            found = self.sound[token] = self._merged([self.id[x] for x in letters]) == [token]
        return found

    def _spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The symbols at one edge of a token while it is merged, each with the rank of the
        merge that takes it in."""
        found = self.spines.get((token, right))
        if found is None:
            found, until, t = [], float("inf"), token
            while True:
                found.append((t, until))
                if t not in self.made:
                    break
                until, first, second = self.made[t]
                t = second if right else first
            self.spines[token, right] = found
        return found

    def _agree(self, before: int, token: int) -> bool:
        """Whether the two tokens (``before`` may be -1 for none) are the encoding of their own
        text: no merge across their border comes up while its two symbols stand there. Of equal
        merges the left one goes first."""
        if not self._is_sound(token):
            return False
        if before < 0:
            return True
        for x, x_until in self._spine(before, True):
            for y, y_until in self._spine(token, False):
                r = self.rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def _last_token(self, tree: dict, text: str, end: int, last: list[int]) -> tuple[int, int]:
        """The last token of the encoding of ``text[:end]`` and where it starts."""
        found, node, at = [], tree, end
        while at:
            node = node.get(text[at - 1])
            if node is None:
                break
            at -= 1
            if 0 in node:
                found.append((node[0], at))
        for token, start in reversed(found):
            key = (last[start] + 1) << 20 | token
            ok = self.agreed.get(key)
            if ok is None:
                if len(self.agreed) > 1_000_000:
                    self.agreed.clear()
                ok = self.agreed[key] = self._agree(last[start], token)
            if ok:
                return token, start
        raise ValueError(f"no encoding of {text[:end]!r}")

    def _piece(self, piece: str) -> bytes:
        """One signed step per code point of a piece that no white space or boundary splits."""
        if piece.isascii() and piece.isprintable():
            text, ends = piece, range(1, len(piece) + 1)
        else:
            text = self.to_bytes(piece)[0][0]
            ends = set(accumulate(len(c.encode()) for c in piece))
        last, count = [-1], [0]
        steps, previous = [], 0
        for i in range(1, len(text) + 1):
            token, start = self._last_token(self.inner, text, i, last)
            last.append(token)
            count.append(count[start] + 1)
            if i in ends:
                now = count[self._last_token(self.final, text, i, last)[1]] + 1
                steps.append(now - previous)
                previous = now
        return array("b", steps).tobytes()

    def _plain(self, text: str) -> bytes:
        """Steps of a normalized chunk without special strings."""
        pieces = PIECES.findall(text)
        steps = self.pieces.learn({p for p in pieces if not self._is_short_form(p)})
        return b"".join([self._short_form(p) if self._is_short_form(p) else steps[p] for p in pieces])

    @staticmethod
    def _is_short_form(piece: str) -> bool:
        return piece[0] == "'" and piece[-1] != "'" and len(piece) < 4 and piece[1:].isalpha()

    def _short_form(self, piece: str) -> bytes:
        """``'re`` is one piece, but its prefix ``'r`` is two."""
        whole = np.frombuffer(self._piece(piece), np.int8).sum()
        cut = np.frombuffer(self._piece("'") + self._piece(piece[1:-1]) if len(piece) > 2 else self._piece("'"), np.int8)
        return np.array([*cut, whole - cut.sum()], np.int8).tobytes()

    def _with_specials(self, raw: str) -> bytes:
        """A special string counts one when it is whole; cut short, it is ordinary text."""
        out, plain = b"", ""
        for part in NORMAL.split(raw):
            if part in SPECIALS:
                ordinary = np.frombuffer(self._plain(plain), np.int8)
                partial = np.frombuffer(self._plain(plain + part[:-1]), np.int8)
                total = int(ordinary.sum()) + 1
                out += np.array([*partial, total - int(partial.sum())], np.int8).tobytes()
                plain = ""
            else:
                plain = self.normalize(part)
        return out + self._plain(plain)

    def _chunks(self, many: list[str]) -> list[bytes]:
        split = {c: PIECES.findall(c.lower()) for c in many if is_simple(c) and "'" not in c}
        steps = self.pieces.learn(set().union(*split.values()))
        return [b"".join([steps[p] for p in split[c]]) if c in split else self._with_specials(c) for c in many]

    def steps(self, texts: list[str]) -> list[bytes]:
        """For each text one signed byte per code point: how the count changes there."""
        # Split at single blanks where that is all there is; odd blanks take the second form.
        parts = [t.split() for t in texts]
        single = [
            sum(map(len, c)) + max(0, len(c) - 1) == len(t) and not NOT_BLANK.search(t) for t, c in zip(texts, parts)
        ]
        parts = [c if s else BLANK_RUN.split(t) for t, c, s in zip(texts, parts, single)]
        known = self.chunks.learn(set().union(*[c if s else c[::2] for c, s in zip(parts, single)]))
        return [
            b"\0".join(map(known.__getitem__, c))
            if s
            else b"".join([bytes(len(p)) if i % 2 else known[p] for i, p in enumerate(c)])
            for c, s in zip(parts, single)
        ]


def prefix_token_counts(docs: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """Per document the exact token count of every prefix: ``doc_id, n_chars, n_bytes, n_tokens,
    steps``. ``steps`` has one signed byte per code point of the text (of its normal form, where
    composing or lower-casing changes the length); the count of a prefix is the sum of its steps.

    Null text counts as empty (no steps, no tokens); null ids and repeated rows pass through,
    one row out for each row in; other columns are not read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = per_process(("counts", path), lambda: PrefixCounts(path))
        for part in slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            steps = counts.steps(texts)
            yield pa.record_batch(
                {
                    "doc_id": part.column(0),
                    "n_chars": pa.array(map(len, texts), pa.int64()),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array([int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps], pa.int64()),
                    "steps": pa.array(steps, pa.binary()),
                }
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def tokens_at(steps: Column, position: Column) -> Column:
    """Tokens of the text cut after ``position`` code points."""

    @F.pandas_udf("bigint")
    def at(s, p):
        import pandas as pd

        return pd.Series([None if a is None else int(np.frombuffer(a, np.int8)[: max(0, b)].sum(dtype=np.int64)) for a, b in zip(s, p)])

    return at(steps, position)


def longest_prefix(steps: Column, budget: Column) -> Column:
    """Code points of the longest prefix that costs at most ``budget`` tokens."""

    @F.pandas_udf("bigint")
    def longest(s, b):
        import pandas as pd

        def one(a: bytes, most: int) -> int:
            counts = np.cumsum(np.frombuffer(a, np.int8), dtype=np.int64)
            fits = np.flatnonzero(counts <= most)
            return int(fits[-1]) + 1 if len(fits) else 0

        return pd.Series([None if a is None else one(a, m) for a, m in zip(s, b)])

    return longest(steps, budget)
