"""LM scoring: an interpolated modified Kneser-Ney model of n-grams of words, counted in Spark.

Training: each task counts the longest grams of its texts and sends them, packed, to shards by hash
ranges of their context and of their last word, so that a frequent context is dealt over many. A
shard's task merges its parts and writes sorted hash arrays to the shared folder; its counts of each
context's followers go on to the contexts' shards, which add them up, and the numbers of distinct
predecessors of the grams of one word less to theirs, down to the words. Nothing is gathered on the
driver but a few sums a shard.

Scoring: workers map the shards' files into memory (pages are shared and read as needed) and look
sorted batches of hashes up. The default order is two: of three words the counts alone are several
times the size of the input text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import hashed_words, mix, remainder, shared_dir, slices, small_batches, tidied
from tracelake.llm.packed import ROWS, Shards, batches_of, by_shard, dealt, find, pack, put, ranges, runs, shard_bits, unpack

#: Tokens counted at once: larger parts merge more pairs before the shuffle. Text bytes read and scored at once.
PART_TOKENS = 4_000_000
SCORED_BYTES = 6 << 20
#: Word hashes have 56 bits: seven bytes in the shuffle.
_WORD_BITS = 56
_HASH = np.uint64(64 - _WORD_BITS)
#: The token that ends a text and the context that starts it; no word hashes to them but by chance.
END, START = np.uint64(1), np.uint64(2)


# --- shards in the shared folder ---------------------------------------------

#: Grams of two words and more: key; grams counted over 254 times and their counts; the counts in a byte.
GRAM_TYPES = ("<u8", "<u8", "<i8", "u1")
#: Contexts: hash, total, and how many followers were counted once, twice and more often.
CONTEXT_TYPES = ("<u8", "<i8", "<i8", "<i8", "<i8")
#: Words: hash, count, distinct predecessors.
WORD_TYPES = ("<u8", "<i8", "<i8")


# --- counting -----------------------------------------------------------------


def follower_bits(bits: int) -> int:
    """How many of a shard's bits are the follower's: a context's followers are dealt over as many shards, so that a frequent one is no task's alone."""
    return min(8, bits // 2)


def placed(context: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """56 bits of the context with those of the follower behind the shard's part of them: grams in this order are shards in order, and contexts within."""
    f = follower_bits(bits)
    low = np.uint64(_WORD_BITS - (bits - f))
    return (context >> low << low + np.uint64(f)) | (mix(word) >> np.uint64(64 - f) << low) | (context & (np.uint64(1) << low) - np.uint64(1))


def gram_key(context: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """64-bit key of a gram whose top bits are its shard's, so that keys in order are shards in order."""
    shard = placed(context, word, bits) >> np.uint64(_WORD_BITS + follower_bits(bits) - bits)
    return shard << np.uint64(64 - bits) | (mix(context * np.uint64(0x9E3779B97F4A7C15) ^ mix(word)) >> np.uint64(bits))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in order, each with its end, and where each text begins (one more)."""
    words, first = hashed_words(texts)
    n = len(texts)
    begin = first + np.arange(n + 1)
    out = np.empty(len(words) + n, np.uint64)
    out[begin[1:] - 1] = END
    inner = np.ones(len(out), bool)
    inner[begin[1:] - 1] = False
    out[inner] = words >> _HASH
    return out, begin


def contexts(token: np.ndarray, begin: np.ndarray, order: int = 2) -> list[np.ndarray]:
    """The hashes of the 1, 2, ..., order - 1 words before each token; before a text stand start marks."""
    out, before = [], token
    for _ in range(order - 1):
        moved = np.empty_like(before)
        moved[1:] = before[:-1]
        moved[begin[:-1]] = START
        before = moved
        out.append(before if not out else mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) ^ mix(before)) >> _HASH)
    return out


def _seven(a: np.ndarray) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _from_seven(b: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(b) // 7, 8), np.uint8)
    wide[:, :7] = b.reshape(-1, 7)
    return wide.view("<u8")[:, 0]


def _parts(chain: list[np.ndarray], word: np.ndarray, raw: np.ndarray, n: np.ndarray | None, bits: int) -> Iterator[tuple[int, bytes]]:
    """Distinct grams as placed() orders them, packed by shard: contexts (chain[0]) once, with the shorter ones that end them (the rest of the chain) and their number of grams; words in seven bytes; counts, and numbers of predecessors if they are others."""
    for s, x in ranges(placed(chain[0], word, bits), bits, _WORD_BITS + follower_bits(bits)):
        heads, grams = runs((chain[0][x],), np.ones(len(word[x]), np.int64))
        seven = [np.frombuffer(_seven(c[x][heads]), np.uint8) for c in chain] + [np.frombuffer(_seven(word[x]), np.uint8)]
        counts = [raw[x].astype("<u4"), grams.astype("<u4")] if n is None else [raw[x].astype("<i8"), n[x].astype("<u4"), grams.astype("<u4")]
        yield s, _GRAMS + pack(*counts, *seven)


def _merged(parts: list[bytes], length: int, counted: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The grams of a shard's parts, each once: chain, word, count and, unless they are the same, number of predecessors."""
    got = []
    for p in parts:
        types = ["<u4", "<u4"] if counted else ["<i8", "<u4", "<u4"]
        columns = unpack(np.frombuffer(p, np.uint8)[8:], *types, *["u1"] * (length + 1))
        *numbers, grams = columns[: len(types)]
        seven = columns[len(types) :]
        got.append([*(np.repeat(_from_seven(c), grams) for c in seven[:-1]), _from_seven(seven[-1]), *(c.astype(np.int64) for c in numbers)])
    columns = [np.concatenate(c) for c in zip(*got)]
    order = np.lexsort((columns[length], columns[0]))
    columns = [c[order] for c in columns]
    at, raw = runs((columns[0], columns[length]), columns[length + 1])
    n = raw if counted else np.add.reduceat(columns[length + 2], at)
    return [c[at] for c in columns[:length]], columns[length][at], raw, n


def _of_counts(n: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4."""
    return [int(np.count_nonzero(n == k)) for k in (1, 2, 3, 4)]


def _gram_shard(folder: str, level: int, top: bool, shard: int, bits: int, parts: list[bytes]) -> Iterator[tuple[int, bytes, list[int]]]:
    """Writes a shard of grams of `level` words; gives its contexts' counts by their shards, the grams of one word less, with their predecessors, by theirs, and the sums of this one."""
    chain, w, raw, n = _merged(parts, level - 1, top)
    c = chain[0]
    heads, total = runs((c,), n)
    kinds = [np.add.reduceat((n == k) if k < 3 else (n >= 3), heads, dtype=np.int64).astype("<u4") for k in (1, 2, 3)]
    for s, x in ranges(c[heads], bits, _WORD_BITS):
        yield s, _CONTEXTS + pack(total[x], *(k[x] for k in kinds), np.frombuffer(_seven(c[heads][x]), np.uint8)), []
    key = gram_key(c, w, bits)
    order = np.argsort(key)
    many = order[n[order] >= 255]
    put(folder, f"grams{level}-{shard}", pack(key[order], key[many], n[many], np.minimum(n[order], 255).astype(np.uint8)))
    yield shard, b"", [level, *_of_counts(n)]
    order = np.argsort(w, kind="stable") if level == 2 else np.lexsort((w, placed(chain[1], w, bits)))
    by = (w[order],) if level == 2 else (chain[1][order], w[order])
    at, raw = runs(by, raw[order])
    _, before = runs(by, np.ones(len(order), np.int64))
    w = w[order][at]
    if level > 2:
        for s, data in _parts([x[order][at] for x in chain[1:]], w, raw, before, bits):
            yield s, data, []
        return
    for s, x in ranges(w, bits, _WORD_BITS):
        yield s, _GRAMS + pack(raw[x], before[x].astype("<u4"), np.frombuffer(_seven(w[x]), np.uint8)), []


def _context_shard(folder: str, level: int, shard: int, parts: list[bytes]) -> list[int]:
    """Writes the contexts of a shard, their counts added up over the shards of their followers."""
    got = [unpack(np.frombuffer(p, np.uint8)[8:], "<i8", "<u4", "<u4", "<u4", "u1") for p in parts]
    c = np.concatenate([_from_seven(g[4]) for g in got])
    order = np.argsort(c, kind="stable")
    at, _ = runs((c[order],), np.ones(len(c), np.int64))
    sums = [np.add.reduceat(np.concatenate([g[k] for g in got]).astype(np.int64)[order], at) for k in range(4)]
    put(folder, f"contexts{level}-{shard}", pack(c[order][at], *sums))
    return [-level]


#: What a part holds, in its first eight bytes, so that what follows is aligned.
_GRAMS, _CONTEXTS = b"grams\0\0\0", b"contexts"


class Model(NamedTuple):
    folder: str
    bits: int
    order: int
    n_tokens: int
    n_types: int
    n_pairs: int
    gram_discounts: tuple[tuple[float, float, float], ...]  # of two words, three, ...
    word_discounts: tuple[float, float, float]
    word_backoff: float  # share of the uniform distribution
    written: tuple[frozenset[int], ...]  # shards that have a file: words, grams of two words, ...
    contexts: tuple[frozenset[int], ...]  # and contexts of grams of two words, ...


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many n-grams were seen once to four times; half a count each where those are too few to tell."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def train(docs: DataFrame, text: str = "text", shards: int | None = None, order: int = 2) -> Model:
    """Counts every row of docs (null texts as empty) and writes the model to the shared folder.

    shards: a power of two, by default at least spark.sql.shuffle.partitions. order: words of the
    longest grams, 2 or more; each word more multiplies what is shuffled and stored. Grams of fewer
    words are counted by their distinct predecessors, start marks among them.
    """
    if order < 2:
        raise ValueError("order is at least 2")
    spark = docs.sparkSession
    small_batches(spark)
    bits = shard_bits(spark, shards)
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, size = [], 0
            for batch in batches:
                for part in slices(batch, "text", SCORED_BYTES):
                    token, begin = tokens(part.column("text").to_pylist())
                    held.append((*contexts(token, begin, order)[::-1], token))
                    size += len(token) * (order - 1)
                    if size >= PART_TOKENS:
                        yield from packed(held)
                        held, size = [], 0
            if held:
                yield from packed(held)

        def packed(held: list):
            *chain, w = (np.concatenate(c) for c in zip(*held))
            by = np.lexsort((w, placed(chain[0], w, bits)))
            at, n = runs((chain[0][by], w[by]), np.ones(len(w), np.int64))
            for shard, data in _parts([c[by][at] for c in chain], w[by][at], n, None, bits):
                yield shard, data, []

        yield from batches_of(rows())

    def grams(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for shard, parts, sums in by_shard(batches):
                    for x in sums:
                        yield shard, b"", x
                    if own := [p for p in parts if p[:8] == _CONTEXTS]:
                        yield shard, b"", _context_shard(folder, level + 1, shard, own)
                    if own := [p for p in parts if p[:8] == _GRAMS]:
                        yield from _gram_shard(folder, level, level == order, shard, bits, own)

            yield from batches_of(rows())

        return run

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for shard, parts, sums in by_shard(batches):
                for x in sums:
                    yield shard, b"", x
                if own := [p for p in parts if p[:8] == _CONTEXTS]:
                    yield shard, b"", _context_shard(folder, 2, shard, own)
                parts = [p for p in parts if p[:8] == _GRAMS]
                if not parts:
                    continue
                got = [unpack(np.frombuffer(p, np.uint8)[8:], "<i8", "<u4", "u1") for p in parts]
                raw, before, w = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.int64), np.concatenate([_from_seven(g[2]) for g in got])
                order = np.argsort(w, kind="stable")
                at, raw = runs((w[order],), raw[order])
                _, before = runs((w[order],), before[order])
                put(folder, f"words-{shard}", pack(w[order][at], raw, before))
                yield shard, b"", [1, *_of_counts(before), len(at), int(raw.sum()), int(before.sum())]

        yield from batches_of(rows())

    stage = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(tidied(count), ROWS)
    for level in range(order, 1, -1):
        stage = dealt(stage, bits).mapInArrow(tidied(grams(level)), ROWS)
    rows = dealt(stage, bits).mapInArrow(tidied(words), ROWS).select("shard", "sums").collect()
    of = lambda level: [r for r in rows if r["sums"][0] == level]
    total = lambda level, size: [sum(x) for x in zip([0] * size, *(r["sums"][1:] for r in of(level)))]
    *of_words, n_types, n_tokens, n_pairs = total(1, 7)
    word_d = discounts(*of_words)
    n1, n2 = of_words[:2]
    mass = word_d[0] * n1 + word_d[1] * n2 + word_d[2] * (n_types - n1 - n2)
    files = lambda level: frozenset(r["shard"] for r in of(level))
    levels = range(2, order + 1)
    return Model(folder, bits, order, n_tokens, n_types, n_pairs, tuple(discounts(*total(level, 4)) for level in levels), word_d, mass / n_pairs if n_pairs else 1.0, tuple(map(files, (1, *levels))), tuple(files(-level) for level in levels))


# --- scoring --------------------------------------------------------------------


class Files:
    """The mapped files of a model, opened as they are needed."""

    def __init__(self, model: Model):
        self.model = model
        self.words = Shards(model.folder, "words", model.written[0], *WORD_TYPES)
        self.grams = [Shards(model.folder, f"grams{k}", w, *GRAM_TYPES) for k, w in enumerate(model.written[1:], 2)]
        self.contexts = [Shards(model.folder, f"contexts{k}", w, *CONTEXT_TYPES) for k, w in enumerate(model.contexts, 2)]

    def _each(self, shards: Shards, keys: np.ndarray, top: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
        """Parts of sorted keys with their shards."""
        for s, part in ranges(keys, self.model.bits, top):
            if (shard := shards[s]) is not None:
                yield part, shard

    def gram_counts(self, level: int, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for part, shard in self._each(self.grams[level - 2], keys, 64):
            hit, at = find(shard[0], keys[part])
            n = shard[3][at].astype(np.int64)
            if (many := n == 255).any():
                n[many] = shard[2][np.searchsorted(shard[1], keys[part][hit][many])]
            out[part][hit] = n
        return out

    def context_stats(self, level: int, contexts: np.ndarray) -> np.ndarray:
        """total, n1, n2, n3+ of each sorted context of grams of `level` words; zeros if it was not seen."""
        out = np.zeros((4, len(contexts)), np.int64)
        for part, shard in self._each(self.contexts[level - 2], contexts, _WORD_BITS):
            hit, at = find(shard[0], contexts[part])
            for k in range(4):
                out[k, part][hit] = shard[1 + k][at]
        return out

    def word_stats(self, words: np.ndarray) -> np.ndarray:
        """count and distinct predecessors of each sorted word."""
        out = np.zeros((2, len(words)), np.int64)
        for part, shard in self._each(self.words, words, _WORD_BITS):
            hit, at = find(shard[0], words[part])
            out[0, part][hit], out[1, part][hit] = shard[1][at], shard[2][at]
        return out


def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


def score_texts(files: Files, texts: list[str]) -> dict:
    """n_tokens, n_known, base_score and score of each text."""
    m = files.model
    token, begin = tokens(texts)
    types, word_at = np.unique(token, return_inverse=True)
    raw, preceding = files.word_stats(types)
    p = ((preceding - _discount(preceding, m.word_discounts)) / max(m.n_pairs, 1) + m.word_backoff / (m.n_types + 1))[word_at]
    for level, (context, d) in enumerate(zip(contexts(token, begin, m.order), m.gram_discounts), 2):
        known, at = np.unique(context, return_inverse=True)
        stats = files.context_stats(level, known)
        total = np.maximum(stats[0], 1)
        backoff = np.where(stats[0] > 0, sum(x * k for x, k in zip(d, stats[1:])) / total, 1.0)
        keys, gram_at = np.unique(gram_key(context, token, m.bits), return_inverse=True)
        n = files.gram_counts(level, keys)
        p = (n - _discount(n, d))[gram_at] / total[at] + backoff[at] * p
    base = np.log10((raw + 1) / (m.n_tokens + m.n_types + 1))[word_at]
    sums = lambda x: np.add.reduceat(x, begin[:-1])  # noqa: E731  no text is without its end
    return {"n_tokens": np.diff(begin), "n_known": sums((raw > 0).astype(np.int64)[word_at]), "base_score": sums(base), "score": sums(np.log10(p))}


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """One row per row of docs with SCHEMA. A null or empty text is its end alone; a null id is never held out; repeated rows get equal scores; extra columns are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = to_arrow_schema(out)
        files = Files(model)
        for batch in batches:
            for part in slices(batch, "text", SCORED_BYTES):
                got = score_texts(files, part.column("text").to_pylist())
                got |= {"train_tokens": np.full(part.num_rows, model.n_tokens), "perplexity": 10 ** np.minimum(-got["score"] / got["n_tokens"], 300)}
                yield pa.RecordBatch.from_arrays([part.column(f.name) if f.name in ("doc_id", "held_out") else pa.array(got[f.name], f.type) for f in to], schema=to)

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (remainder(doc_id, folds) == fold).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return picked.mapInArrow(tidied(run), out)


def train_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, order: int = 2) -> DataFrame:
    """Learns from the rows that are not held out and scores all."""
    return score(docs, train(docs.filter(remainder(doc_id, folds) != fold), text, order=order), doc_id, text, folds, fold)
