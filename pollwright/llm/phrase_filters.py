"""Phrase collocations counted with quotient filters.

Words that are frequent enough get numbers. An n-gram is packed into one integer, the number of the
gram of its first words beside the number of its last word, and the integer is permuted invertibly. The
upper bits of the permuted number, the quotient, say where in a filter it belongs, and a filter keeps
all the other bits, the remainder, so a filter loses nothing: sorted remainders by quotient, with counts.
Every block of text makes such filters, one for each shard of quotients; a shard merges the sorted
filters of all blocks, keeps the grams that are frequent enough and tells the blocks their numbers.
A longer gram is counted only where both its shorter parts are frequent.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pollwright.llm.common import cut, slices
from pollwright.session import discard, scratch_path

U = np.uint64
BLOCK_TOKENS = 1 << 20
ROW_TOKENS = 1 << 16
SHARD_GRAMS = 1 << 21
BREAK = b"."
# A-Z lower-cased, the marks that end a piece as one of them, a tab as a space.
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz.......... "
)


class Permutation:
    """An invertible scrambling of the numbers below ``2^bits``."""

    def __init__(self, bits: int):
        if bits > 64:
            raise ValueError("more than 64 bits for a packed gram")
        self.bits, self.half = bits, U(bits // 2 + 1)
        self.mask = U((1 << bits) - 1)
        factors = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
        self.factors = [U(f & int(self.mask)) for f in factors]
        self.inverses = [U(pow(f, -1, 1 << 64) & int(self.mask)) for f in factors]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for f in self.factors:
            x = ((x ^ (x >> self.half)) * f) & self.mask
        return x ^ (x >> self.half)

    def back(self, x: np.ndarray) -> np.ndarray:
        # Shifting by more than half of the bits twice leaves nothing, so that step undoes itself.
        x = x ^ (x >> self.half)
        for f in reversed(self.inverses):
            x = (x * f) & self.mask
            x = x ^ (x >> self.half)
        return x


def pack_filter(values: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of rising ``values`` below ``2^bits``: for each quotient as many
    ones as it has remainders and a zero, the remainders in whole bytes, and counts of one byte
    with the larger ones apart."""
    n = len(values)
    q = min(bits, max(0, n.bit_length() - 1))
    r = bits - q
    held = np.bincount((values >> U(r)).astype(np.int64) if r < 64 else np.zeros(n, np.int64), minlength=1 << q)
    runs = np.ones(n + len(held), bool)
    runs[np.cumsum(held) + np.arange(len(held))] = False
    remainders = (values & U((1 << r) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, : -(-r // 8)]
    large = counts[counts >= 255].astype("<u8")
    head = struct.pack("<QBBQ", n, q, r, len(large))
    return head + np.packbits(runs).tobytes() + remainders.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def unpack_filter(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The values, rising, and their counts."""
    n, q, r, n_large = struct.unpack_from("<QBBQ", data)
    at = struct.calcsize("<QBBQ")
    size = n + (1 << q)
    runs = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool)
    at += -(-size // 8)
    quotient = (np.cumsum(~runs)[runs]).astype(np.uint64)
    width = -(-r // 8)
    remainders = np.zeros((n, 8), np.uint8)
    remainders[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", n_large, at + n).astype(np.int64)
    values = remainders.view("<u8").ravel()
    return (values | (quotient << U(r)) if r < 64 else values), counts


def merge_filters(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The values of all filters, rising, their total counts, and for each entry of the filters one
    after the other the position of its value and the number of its filter."""
    parts = [unpack_filter(f) for f in filters]
    values, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(values, kind="stable")
    first = np.diff(values[order], prepend=~values[order][:1]) != 0
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(first) - 1
    source = np.repeat(np.arange(len(parts)), [len(v) for v, _ in parts])
    return values[order][first], np.add.reduceat(counts[order], np.flatnonzero(first)), place, source


_TEXT = "block bigint, lang string, kind int, seq int, tokens binary, word string, local int, n bigint"
TOKENS, WORD = 0, 1


def word_blocks(docs: DataFrame) -> DataFrame:
    """The texts as blocks of one language each. TOKENS rows: the words as 32-bit numbers that hold
    in the block, 0 between pieces, in rows of 65,536. WORD rows: a word, its number and how often
    the block has it. A text lies in one block; a block ends after about a million words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        known: dict[str, dict[bytes, int]] = {}
        held: dict[str, list[np.ndarray]] = {}
        names = [c.split()[0] for c in _TEXT.split(", ")]

        def block(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            tokens, words = np.concatenate(held.pop(lang)), known.pop(lang)
            counts = np.bincount(tokens, minlength=len(words))

            def rows(size: int, **columns) -> pa.RecordBatch:
                fixed = {"block": pa.array(np.full(size, made)), "lang": pa.array([lang] * size)}
                kinds = {"kind": pa.int32(), "seq": pa.int32(), "tokens": pa.binary(), "word": pa.string(), "local": pa.int32(), "n": pa.int64()}
                found = {c: pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in kinds.items()}
                return pa.record_batch([(fixed | found)[c] for c in names], names=names)

            for i, a in enumerate(range(0, len(tokens), ROW_TOKENS)):
                yield rows(1, kind=[TOKENS], seq=[i], tokens=[tokens[a : a + ROW_TOKENS].tobytes()])
            text = pa.array(list(words), pa.binary()).cast(pa.string())
            for a in range(1, len(words), 8192):
                b = min(a + 8192, len(words))
                yield rows(b - a, kind=[WORD] * (b - a), word=text.slice(a, b - a), local=np.arange(a, b), n=counts[a:b])
            made += 1

        for part in slices(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text.encode())
            for lang, some in by_lang.items():
                words = BREAK.join(some).translate(_TABLE).replace(BREAK, b" . ").split()
                if not words:
                    continue
                coded = pa.array(words, pa.binary()).dictionary_encode()
                numbers = known.setdefault(lang, {BREAK: 0})
                local = np.array([numbers.setdefault(w, len(numbers)) for w in coded.dictionary.to_pylist()], np.int32)
                parts = held.setdefault(lang, [])
                parts += [np.zeros(1, np.int32), local[coded.indices.to_numpy()]]
                if sum(map(len, parts)) >= BLOCK_TOKENS:
                    yield from block(lang)
        for lang in sorted(held):
            yield from block(lang)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, _TEXT)


_STEP = "block bigint, kind int, shard bigint, words binary, grams binary"
STATE, MAP, REPLY, FILTER = 2, 3, 4, 5


def _wide(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def block_step(rows: pa.Table, level: int, longest: int, word_bits: int, here: int, there: int, shards: int) -> list[dict]:
    """One block: the numbers of its grams of ``level`` words, from the shards' replies, and the
    filters of the next longer grams. ``here`` and ``there`` are the bits of a packed gram of this
    and the next level; ``shards`` is the number of bits that name a shard of the next level."""
    block = rows.column("block")[0].as_py()
    kinds = np.array(rows.column("kind").to_pylist())
    words, grams, shard = (rows.column(c).to_pylist() for c in ("words", "grams", "shard"))
    if (kinds == TOKENS).any():
        local = sorted((shard[i], words[i]) for i in np.flatnonzero(kinds == TOKENS))
        tokens = np.concatenate([np.frombuffer(w, "<i4") for _, w in local])
        known = np.zeros(int(tokens.max(initial=0)) + 1, np.int64)
        for i in np.flatnonzero(kinds == MAP):
            known[np.frombuffer(words[i], "<i8")] = np.frombuffer(grams[i], "<i8")
        word = known[tokens]
        gram, have = word, 1
    else:
        (i,) = np.flatnonzero(kinds == STATE)
        word, gram = np.frombuffer(words[i], "<i8"), np.frombuffer(grams[i], "<i8")
        have = level - 1

    def packed(have: int) -> tuple[np.ndarray, np.ndarray]:
        """Where grams of one word more can start, and their packed form."""
        at = np.flatnonzero((gram[:-1] > 0) & (gram[1:] > 0))
        at = at[at + have < len(word)]
        return at, (gram[at].astype(np.uint64) << U(word_bits)) | word[at + have].astype(np.uint64)

    if level > 1:
        at, key = packed(have)
        value = Permutation(here)(key)
        replies = np.flatnonzero(kinds == REPLY)
        frequent = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(words[i], "<u8") for i in replies]])
        number = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(grams[i], "<i8") + shard[i] for i in replies]])
        order = np.argsort(frequent)
        frequent, number = frequent[order], number[order]
        found = np.searchsorted(frequent, value)
        found[found == len(frequent)] = 0
        hit = frequent[found] == value if len(frequent) else np.zeros(len(value), bool)
        longer = np.zeros(len(word), np.int64)
        longer[at[hit]] = number[found[hit]]
        # What no longer gram can touch goes. After a gram all its words stay, so neighbours of
        # a gram are its real neighbours.
        stay = np.zeros(len(word) + 1, np.int64)
        np.add.at(stay, at[hit], 1)
        np.add.at(stay, np.minimum(at[hit] + level, len(word)), -1)
        stay = np.cumsum(stay[:-1]) > 0
        word, gram = word[stay], longer[stay]

    out = []
    if level < longest and len(word):
        if level > 1:
            out.append({"block": block, "kind": STATE, "words": _wide(word), "grams": _wide(gram)})
        _, key = packed(level)
        value, count = np.unique(Permutation(there)(key), return_counts=True)
        if len(value):
            low = there - shards
            part = (value >> U(low)).astype(np.int64) if shards else np.zeros(len(value), np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                inside = value[a:b] & U((1 << low) - 1)
                out.append({"block": block, "kind": FILTER, "shard": int(part[a]), "grams": pack_filter(inside, count[a:b], low)})
    return out


_MERGED = "shard bigint, block bigint, place bigint, prefix bigint, word bigint, a bigint, words binary, grams binary"


def merge_shard(rows: pa.Table, least: int, bits: int, shards: int, word_bits: int) -> pa.Table:
    """A shard's frequent grams (``place`` is their number in the shard, from 1), and a reply to each
    block: which of its permuted grams are frequent, and their places."""
    shard = rows.column("shard")[0].as_py()
    blocks = rows.column("block").to_pylist()
    values, totals, place, source = merge_filters(rows.column("grams").to_pylist())
    values = values | U(shard << (bits - shards))
    frequent = totals >= least
    number = np.cumsum(frequent)
    key = Permutation(bits).back(values[frequent])
    n = len(key)
    hit = frequent[place]
    place, source = place[hit], source[hit]
    cuts = np.flatnonzero(np.diff(source, prepend=-1, append=-1))
    replies = [(blocks[source[a]], values[place[a:b]].astype("<u8").tobytes(), _wide(number[place[a:b]])) for a, b in zip(cuts[:-1], cuts[1:])]
    to, asked, answer = zip(*replies) if replies else ((), (), ())
    m = len(replies)
    columns = {
        "shard": pa.array([shard] * (n + m), pa.int64()),
        "block": pa.array([None] * n + list(to), pa.int64()),
        "place": pa.array(list(range(1, n + 1)) + [None] * m, pa.int64()),
        "prefix": pa.concat_arrays([pa.array((key >> U(word_bits)).astype(np.int64)), pa.nulls(m, pa.int64())]),
        "word": pa.concat_arrays([pa.array((key & U((1 << word_bits) - 1)).astype(np.int64)), pa.nulls(m, pa.int64())]),
        "a": pa.concat_arrays([pa.array(totals[frequent]), pa.nulls(m, pa.int64())]),
        "words": pa.array([None] * n + list(asked), pa.binary()),
        "grams": pa.array([None] * n + list(answer), pa.binary()),
    }
    return pa.table(columns)


def _stepping(*args: int) -> Callable[[pa.Table], pa.Table]:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _STEP.split(", ")])
    return lambda rows: pa.Table.from_pylist(block_step(rows, *args), schema=schema)


def _merging(*args: int) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: merge_shard(rows, *args)


class Scratch:
    """Compressed tables in the shared folder, until they are dropped together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(scratch_path(self.spark, name))
        df.write.option("compression", "zstd").parquet(self.paths[-1])
        return self.spark.read.parquet(self.paths[-1])

    def drop(self) -> None:
        for path in self.paths:
            discard(self.spark, path)


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """``lang, k, phrase, a`` of all phrases of one to ``longest`` words that occur at least ``least``
    times in their language, and ``lang, n``, all word occurrences."""
    scratch = Scratch(docs.sparkSession)
    text = scratch.table(word_blocks(docs), "phrases-text")
    counts = text.where(F.col("kind") == WORD).select("block", "lang", "word", "local", "n")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    # All rows of a word, one a block, meet in one part, which finds the word's total and its number in
    # the part beside them: nothing is joined, whose rows would grow with the words that become frequent.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_word, in_part = Window.partitionBy("lang", "word"), Window.partitionBy("part").orderBy("lang", "word")
    often = counts.repartition(parts, "lang", "word").withColumn("a", F.sum("n").over(of_word)).where(F.col("a") >= least)
    often = often.withColumn("part", F.spark_partition_id()).withColumn("place", F.dense_rank().over(in_part))
    often = scratch.table(often, "phrases-words")
    # Numbers of all parts one after the other; there is one row a part.
    starts, size, present = {}, 0, 0
    for part, held, occurring in often.groupBy("part").agg(F.max("place"), F.sum("n")).collect():
        starts[part], size, present = size, size + held, present + occurring
    start = F.lit([starts.get(part, 0) for part in range(max(starts, default=0) + 1)])
    often = often.withColumn("id", F.col("place") + F.get(start, F.col("part")).cast("bigint"))
    words = cut(often.groupBy("lang", "word", "id").agg(F.first("a").alias("a")))
    phrases = words.select("id", "lang", F.lit(1).alias("k"), F.col("word").alias("phrase"), "a")
    every = [phrases]
    none = F.lit(None)

    def packed_pairs(rows: pa.Table) -> pa.Table:
        return pa.table(
            {
                "block": rows.column("block").slice(0, 1),
                "words": pa.array([rows.column("local").to_numpy().astype("<i8").tobytes()], pa.binary()),
                "grams": pa.array([rows.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()),
            }
        )

    numbered = often.select("block", "local", "id").groupBy("block").applyInArrow(packed_pairs, "block bigint, words binary, grams binary")
    empty = [none.cast("bigint").alias("shard"), none.cast("binary").alias("grams")]
    mapped = scratch.table(numbered, "phrases-map").select("block", F.lit(MAP).alias("kind"), empty[0], "words", "grams")
    tokens = text.where(F.col("kind") == TOKENS).select(
        "block", "kind", F.col("seq").cast("bigint").alias("shard"), F.col("tokens").alias("words"), empty[1]
    )
    state = tokens.unionByName(mapped)
    word_bits, here = int(size).bit_length(), 0
    for level in range(1, longest):
        if not size:
            break
        there = word_bits + int(size).bit_length()
        shards = min(there, max(0, (int(present) // SHARD_GRAMS).bit_length()))
        step = _stepping(level, longest, word_bits, here, there, shards)
        done = state.groupBy("block").applyInArrow(step, _STEP)
        if level > 1:
            # Read twice: by the shards, and as the state of the blocks.
            done = scratch.table(done, f"phrases-{level}")
            state = done.where(F.col("kind") == STATE)
        filters = done.where(F.col("kind") == FILTER).select("shard", "block", "grams")
        merge = _merging(least, there, shards, word_bits)
        met = scratch.table(filters.groupBy("shard").applyInArrow(merge, _MERGED), f"phrases-merged-{level}")
        grams = met.where(F.col("place").isNotNull()).select("shard", "place", "prefix", "word", "a")
        # Numbers of all shards one after the other; there is one row a shard.
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        offsets = grams.groupBy("shard").agg(F.max("place").alias("of_shard"))
        offsets = cut(offsets.select("shard", F.coalesce(F.sum("of_shard").over(before), F.lit(0)).alias("offset")))
        grams = grams.join(offsets, "shard").select((F.col("place") + F.col("offset")).alias("id"), "prefix", "word", "a")
        last = words.select(F.col("id").alias("word"), F.col("word").alias("last"))
        shorter = phrases.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("start"))
        phrases = cut(
            grams.join(last, "word")
            .join(shorter, "prefix")
            .select("id", "lang", F.lit(level + 1).alias("k"), F.concat_ws(" ", "start", "last").alias("phrase"), "a")
        )
        every.append(phrases)
        size, present = phrases.agg(F.count("*"), F.sum("a")).first()
        replies = met.where(F.col("block").isNotNull()).join(offsets, "shard")
        replies = replies.select("block", F.lit(REPLY).alias("kind"), F.col("offset").alias("shard"), "words", "grams")
        state = state.unionByName(replies)
        here = there
    found = every[0]
    for more in every[1:]:
        found = found.unionByName(more)
    found, totals = cut(found.select("lang", "k", "phrase", "a")), cut(totals)
    scratch.drop()
    return found, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: per language the ``top`` phrases of 2 to ``longest``
    words by score, then by count, then in byte order.

    A phrase (A-Z lower-cased, words between blanks, never over one of ``.,;:!?`` or a line end) is
    a candidate if it occurs ``a >= least`` times. Cut after its first k words it scores
    floor(1000 a n / (l r)), where l and r count its parts and n all words of the language; the cut
    with the lowest score counts, the first one on ties. Candidates inside a longer one that occurs as
    often are dropped. Null text is empty, null language is ``und``; repeated rows count like
    others; other columns are not read; an empty table gives no rows.
    """
    phrases, totals = frequent_phrases(docs, least, longest)
    candidates = phrases.where("k > 1").withColumn("w", F.split("phrase", " "))
    # A longer candidate as frequent as one inside it implies one that is longer by one word.
    longer = candidates.where("k > 2")
    inner = F.array(
        F.array_join(F.slice("w", F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("k") - 1), " ")
    )
    covered = longer.select("lang", "a", F.explode(inner).alias("phrase")).distinct()
    left = candidates.join(covered, ["lang", "phrase", "a"], "left_anti")
    cuts = left.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang",
        "phrase",
        "a",
        "cut",
        F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"),
    )
    one = phrases.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    two = phrases.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    counted = cuts.join(one, ["lang", "first"]).join(two, ["lang", "rest"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")}
    above, below = (F.lit(1000).cast("decimal(4,0)") * wide["a"]) * wide["n"], wide["l"] * wide["r"]
    # Whole numbers: what is left over goes first, so the quotient is exact.
    scored = counted.withColumns({"above": above.cast("decimal(38,0)"), "below": below.cast("decimal(38,0)")}).withColumn(
        "score", F.expr("above div below")
    )
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    rows = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language can have any share of the candidates: the best of each part, then the best of those.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
