"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

The encoding of a word is the one chain of tokens in which every adjacent pair is stable: encoding
the two tokens' text gives the same two tokens. So the last token of each prefix follows from the
last tokens of shorter prefixes, one symbol at a time, and a later token can start no further back than
the longest token of the merge list. Once the chains of all prefixes within that reach agree on a
token, it is final and is emitted. How long that can take is the sufficient lookahead, computed from
the merge list's chains of merges; the window grows to it where chains disagree, and no further, so a
run of any length comes as a stream and needs memory for the lookahead only. Decoding goes token by
token through a byte-to-text state machine.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from tracelake.llm.common import map_texts, slices, small_batches, tidied

END = "</w>"
#: Words and runs of more characters are encoded anew each time.
KEPT_CHARS = 64
#: Ids that the decoder turns into text at once.
DECODED_AT_ONCE = 8192
#: Words that an encoder remembers (some 250 MB with runs and pairs); beyond it starts anew. An encoder
#: that goes with its task, where memory is short, remembers an eighth of it.
CACHED_WORDS, CACHED_BY_TASK = 600_000, 75_000

#: White space of the normaliser's `\s`.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = regex.compile(rf"[^{_SPACES}]+")
#: Characters at which str.split() parts words but the normaliser does not.
_ODD = regex.compile("[\x1c-\x1f]")
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACES}\p{{L}}\p{{N}}]+")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100 in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder:
    """A word-end BPE vocabulary with its transducer. Text is NFC, white space parts words, letters are lower case; special tokens are found in the raw text."""

    def __init__(self, path: str, words: int = CACHED_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._chars = byte_chars()
        self._stable: dict[str, dict[str, bool]] = {}  # by the first token of a pair
        self._pairs, self._most_pairs = 0, words * 5 // 3
        self._words = _Bounded(lambda word: np.fromiter(self.word_ids(word), "<u4").tobytes(), words)
        self._runs = _Bounded(lambda part: tuple(self.run_ids(part)), words * 5 // 6)
        #: The merge that makes each token, and the longest token in symbols: a later token starts no further back.
        self._made = {a + b: (a, b) for a, b in reversed(self.rank)}
        self._simple = len(self._made) == len(self.rank)
        symbols = {t: self._symbols(t) for t in self._made}
        self.longest = max(map(len, symbols.values()), default=1)
        self.by_prefix: dict[str, bool] = {}  # every prefix of a token, in whole symbols -> whether it is a token that its own text gives
        for t, s in symbols.items():
            for k in range(2, len(s)):
                self.by_prefix.setdefault("".join(s[:k]), False)
            if t in self.vocab and self._merge(s) == [t]:
                self.by_prefix[t] = True

    @staticmethod
    def _symbols(token: str) -> list[str]:
        if token.endswith(END) and token != END:
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain merging of a bounded run, lowest rank first, leftmost first: used to tell stable pairs."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _apart(self, a: str, b: str) -> bool:
        """Whether merging never crosses the border of a and b. Undoes the later of the two tokens' merges step by step: at each step the symbols next to the border must not have merged by then."""
        if not self._simple:
            return self._merge(self._symbols(a) + self._symbols(b)) == [a, b]
        rank, made, never = self.rank, self._made, 1 << 60
        age = lambda t: rank[made[t]] if t in made else -1
        limit = never  # merges across the border count only if they come before this
        while True:
            crossing = rank.get((a, b), never)
            if crossing < limit:
                return False
            old_a, old_b = age(a), age(b)
            if old_a < 0 and old_b < 0:
                return True
            # At one rank the place further left merges first: undoing b's merge leaves its own rank open to the border.
            if old_a > old_b:
                limit, a = old_a, made[a][1]
            else:
                limit, b = old_b + 1, made[b][0]

    def stable(self, a: str, b: str) -> bool:
        """Whether a and b stay apart when they follow one another; nothing before b is always apart."""
        after = self._after(a)
        if (found := after.get(b)) is None:
            self._pairs += 1
            found = after[b] = not a or self._apart(a, b)
        return found

    def _after(self, a: str) -> dict[str, bool]:
        """What is known of a's followers."""
        if self._pairs >= self._most_pairs:
            self._stable.clear()
            self._pairs = 0
        if (after := self._stable.get(a)) is None:
            after = self._stable[a] = {}
        return after

    @cached_property
    def lookahead(self) -> int:
        """The sufficient lookahead: symbols behind a token after which nothing changes it.

        What comes later can change a merge (u, v) next to it. Whether that merge takes place tells,
        further left, only merges of later rank: those whose second part begins where u begins, so is
        a beginning of u or begins with it. Each step so goes left by one first part and on to a
        later rank; the longest such chain of merges, and the longest token once more for the one that
        is still open, bound how far a change goes. Merges are taken from the last rank to the first, with the reach of
        second parts kept in a trie: at its end for beginnings of u, and over all below for those that begin with u.
        """
        follow: list[dict[str, int]] = [{}]
        ends, below, most = [0], [0], 0
        for u, v in reversed(self.rank):
            node, reach = 0, 0
            for c in self._symbols(u):
                node = follow[node].get(c, -1)
                if node < 0:
                    break
                reach = max(reach, ends[node])
            first = self._symbols(u)
            reach = len(first) + max(reach, below[node] if node >= 0 else 0)
            most = max(most, reach)
            path = [0]
            for c in self._symbols(v):
                if (step := follow[path[-1]].get(c)) is None:
                    step = follow[path[-1]][c] = len(follow)
                    follow.append({})
                    ends.append(0)
                    below.append(0)
                path.append(step)
            ends[path[-1]] = max(ends[path[-1]], reach)
            for step in path:
                below[step] = max(below[step], reach)
        return most + self.longest

    def transduce(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one run of symbols (the last has END), each as soon as it is stable. State: the symbols whose tokens are not out yet, and the last token of the prefix that ends at each."""
        prefix, stable, longest = self.by_prefix.get, self.stable, self.longest
        source, ended = iter(symbols), False
        window: list[str] = []
        last: list[str | None] = [""]
        begin = [0]  # of each prefix's last token, counted from the run's start
        first = here = 0  # the window's start in the run; how many of its symbols are done
        due = 3 * longest  # symbols done after which chains are compared
        while True:
            if not ended and len(window) < here + longest:
                some = list(islice(source, 4 * longest))
                ended = not some
                window += some
                last += [None] * len(some)
                begin += [0] * len(some)
            n = len(window)
            if here == n:
                break
            before = last[here]
            known = self._after(before).get
            text, end = window[here], here
            token: bool | None = True
            while True:
                end += 1
                if token and last[end] is None:
                    ok = known(text)
                    if ok or (ok is None and stable(before, text)):
                        last[end], begin[end] = text, first + here
                if end == n:
                    break
                text += window[end]
                token = prefix(text)
                if token is None:
                    break
            here += 1
            if here >= due and here < n:
                done, keep = self._agreed(last, begin, first, first + here)
                if done:
                    yield from done
                    first, here = first + keep, here - keep
                    del window[:keep], last[:keep], begin[:keep]
                    last[0] = done[-1]
                    due = max(here + longest, 3 * longest)
                else:  # not before the window has grown by a half, but as soon as the lookahead suffices
                    due = here + max(longest, here // 2)
                    if here < self.lookahead + longest < due:
                        due = self.lookahead + longest
        chain, at = [], first + len(window)
        while at > first:
            chain.append(last[at - first])
            at = begin[at - first]
        yield from reversed(chain)

    def _agreed(self, last: list, begin: list, first: int, place: int) -> tuple[list[str], int]:
        """Tokens on which the chains of all prefixes that a later token can follow agree, and their symbols."""
        chains = []
        for at in range(max(first + 1, place - self.longest), place + 1):
            chain = []
            while at > first:
                chain.append((last[at - first], begin[at - first]))
                at = chain[-1][1]
            chains.append(chain[::-1])
        n = 0
        while all(len(c) > n + 1 for c in chains) and len({c[n] for c in chains}) == 1:
            n += 1
        return [t for t, _ in chains[0][:n]], chains[0][n][1] - first

    def word_ids(self, word: str) -> Iterator[int]:
        """Ids of a run without white space, as they come."""
        word = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        for m in _WORD.finditer(word):
            part = m[0]
            yield from self._runs[part] if len(part) <= KEPT_CHARS else self.run_ids(part)

    def run_ids(self, part: str) -> Iterator[int]:
        """Ids of one run that the pre-tokenizer found, as they come."""
        return map(self.vocab.__getitem__, self.transduce(self._bytes(part)))

    def _bytes(self, part: str) -> Iterator[str]:
        """The symbols of a run, a piece of it at a time; the last one ends the word."""
        held = None
        for k in range(0, len(part), 65536):
            for b in part[k : k + 65536].encode("utf-8", "surrogatepass"):
                if held is not None:
                    yield held
                held = self._chars[b]
        if held is not None:
            yield held + END

    def _plain(self, text: str) -> bytes:
        words = text.split() if not _ODD.search(text) else _SPLIT.findall(text)
        return b"".join(map(self._words.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self._special is None or not self._special.search(text):
            got = self._plain(text)
        else:
            parts, at = [], 0
            for m in self._special.finditer(text):
                parts += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
                at = m.end()
            got = b"".join([*parts, self._plain(text[at:])])
        return np.frombuffer(got, "<u4")

    @cached_property
    def spelled(self) -> list[bytes]:
        """Every token as it is spelled in the vocabulary, in UTF-8."""
        return [t.encode("utf-8", "surrogatepass") for t in self.tokens]

    @cached_property
    def readable(self) -> list[bytes]:
        """The bytes that every token stands for; a word end gives a space, special tokens stand as they are."""
        byte, special = {c: b for b, c in enumerate(self._chars)}, set(self.special.values())

        def of(token: str) -> bytes:
            body = token.removesuffix(END)
            return bytes(byte[c] for c in body) + b" " * (body != token)

        return [self.spelled[i] if i in special else of(t) for i, t in enumerate(self.tokens)]

    def decode(self, ids: Iterable[int], spelled: bool = False) -> Iterator[str]:
        """The text of ids, piece by piece: readable, or as a tokenizer without a decoder gives it, tokens parted by spaces."""
        machine = Decoder(self.spelled, b" ") if spelled else Decoder(self.readable)
        ids = iter(ids)
        while some := list(islice(ids, DECODED_AT_ONCE)):
            yield machine.feed(some)
        yield machine.end()


class Decoder:
    """An incremental byte-to-text machine. Ids come in parts of any size and text leaves as soon as its bytes are whole; the state is an unfinished character's bytes, three at most, and whether a separator is due. Bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, table: list[bytes], separator: bytes = b""):
        self.table, self.separator = table, separator
        self.machine, self.began = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = self.separator.join(map(self.table.__getitem__, ids))
        data = self.separator + data if self.began else data
        self.began = True
        return self.machine.decode(data)

    def end(self) -> str:
        self.began = False
        return self.machine.decode(b"", True)


class _Bounded(dict):
    """Results by word, made when they are missed; it starts anew when it is full, and long words are not kept."""

    def __init__(self, make: Callable[[str], object], most: int):
        self.make, self.most = make, most

    def __missing__(self, word: str):
        got = self.make(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = got
        return got


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded_sha256 string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_LOADED: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """A worker's encoder for the vocabulary file, kept for later tasks."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _sha256(pieces: Iterable[str]) -> str:
    """Digest of a text that comes piece by piece."""
    total = hashlib.sha256()
    for p in pieces:
        total.update(p.encode())
    return total.hexdigest()


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digest of the readable text decoded from them, of every row.

    A null text is empty and has no tokens; repeated rows get equal results; extra columns are left
    out; an empty table gives an empty one. An encoder goes with its task, so that a worker does not
    hold one through a pipeline's other stages.
    """

    def work(encoder: Encoder, ids: list, texts: list) -> dict:
        got = [encoder.encode(t) for t in texts]
        return {"doc_id": ids, "n_tokens": [len(g) for g in got], "ids": [g.tobytes() for g in got], "decoded_sha256": [_sha256(encoder.decode(g.tolist())) for g in got]}

    return map_texts(docs, work, SCHEMA, doc_id, text, prepare=lambda: Encoder(path, CACHED_BY_TASK))


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """tokens with `text` in place of ids (little-endian unsigned 32-bit): the readable text, null where the ids are null, empty where there are none.

    All other columns stay; repeated rows get equal texts; an empty table gives an empty one.
    """
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    small_batches(tokens.sparkSession)
    at = tokens.columns.index(ids)
    fields = [StructField("text", StringType()) if f.name == ids else f for f in tokens.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, 0)
        for batch in batches:
            for part in slices(batch, ids):
                made = [None if x is None else "".join(encoder.decode(np.frombuffer(x, "<u4").tolist())) for x in part.column(at).to_pylist()]
                yield part.set_column(at, "text", pa.array(made, pa.string()))

    return tokens.mapInArrow(tidied(run), StructType(fields))


def digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, tokens parted by spaces, as it leaves the machine.

    A null or empty text has no tokens and the digests of nothing; repeated rows get equal results;
    extra columns are left out; an empty table gives an empty one.
    """

    def work(encoder: Encoder, ids: list, texts: list) -> dict:
        out: dict[str, list] = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in texts:
            got = encoder.encode(t)
            out["n_tokens"].append(len(got))
            out["ids_sha256"].append(hashlib.sha256(got.tobytes()).hexdigest())
            out["decoded_sha256"].append(_sha256(encoder.decode(got.tolist(), spelled=True)))
        return out

    return map_texts(docs, work, DIGEST, doc_id, text, prepare=lambda: _encoder(path))
