"""Similarity of vectors and of texts: cosine natively, BLEU and ROUGE by their published definitions in one Arrow UDF."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SCORES = ("bleu1", "bleu2", "bleu4", "rouge1", "rouge2", "rougeL")
#: Tokens of the pairs that are counted together; a longer pair goes alone.
TOGETHER = 120_000
#: Added to a zero numerator, as smoothing method 1 does.
EPSILON = 0.1


def cosine(a: Column, b: Column) -> Column:
    """M1: cosine of two arrays, 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*(tokens[k:] for k in range(n))))


def bleus(reference: list[str], hypothesis: list[str], orders: tuple[int, ...]) -> list[float]:
    """M2: sentence BLEU of one reference with uniform weights up to each order; 0 without a common word or with an empty side. Each order's grams are counted once."""
    hits = [sum((_grams(hypothesis, k) & _grams(reference, k)).values()) for k in range(1, max(orders) + 1)]
    return _bleus(hits, len(reference), len(hypothesis), orders)


def _bleus(hits: list[int], reference: int, hypothesis: int, orders: tuple[int, ...]) -> list[float]:
    """BLEU of each order from the common grams of orders 1, 2, ... and both lengths."""
    if not reference or not hypothesis or not hits[0]:
        return [0.0] * len(orders)
    logs = [math.log((hit or EPSILON) / max(1, hypothesis - k)) for k, hit in enumerate(hits)]
    brevity = 1.0 if hypothesis > reference else math.exp(1 - reference / hypothesis)
    return [brevity * math.exp(sum(x / n for x in logs[:n])) for n in orders]


def common_grams(words: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Grams that each pair of texts has in common, as often as both have them: a row a pair, a column for each order up to most. Given are the numbers of the words of all references, then of all hypotheses, and each text's number of words.

    All pairs are counted together, by sorting. A gram can only be common where both grams within it, a word shorter, are; the others drop out before the next order."""
    n = len(sizes) // 2
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(len(words))
    is_own = place >= sizes[:n].sum()
    pair = np.repeat(np.tile(np.arange(n), 2), sizes)
    key = pair * (words.max(initial=0) + 1) + words
    out = np.zeros((n, most), np.int64)
    for k in range(most):
        found, gram = np.unique(key, return_inverse=True)
        own = np.bincount(gram[is_own[place]], minlength=len(found))
        both = np.minimum(own, np.bincount(gram, minlength=len(found)) - own)
        pair_of = np.empty(len(found), np.int64)
        pair_of[gram] = pair[place]
        out[:, k] = np.bincount(pair_of, both, minlength=n)  # sums of whole numbers, exact in doubles
        kept = both[gram] > 0
        place, gram = place[kept], gram[kept]
        follows = (place[1:] == place[:-1] + 1) & (place[:-1] + k + 2 <= ends[place[:-1]])
        key = gram[:-1][follows] * len(found) + gram[1:][follows]
        place = place[:-1][follows]
    return out


def bleu(reference: list[str], hypothesis: list[str], n: int) -> float:
    """M2 of one order."""
    return bleus(reference, hypothesis, (n,))[0]


_VOWEL_THEN_CONSONANT = re.compile(r"(?s)[aeiou](?=[^aeiou])")


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences, that is of places where a consonant follows a vowel."""
    if "y" not in stem:
        return len(_VOWEL_THEN_CONSONANT.findall(stem))
    vowel, n = False, 0
    for i, c in enumerate(stem):
        was, vowel = vowel, c in "aeiou" or (c == "y" and i > 0 and not vowel)
        n += was and not vowel
    return n


def _is_vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _is_vowel(w, i - 1))


def _has_vowel(w: str) -> bool:
    return any(_is_vowel(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    if len(w) == 2:  # an extension: so short words keep their e
        return _is_vowel(w, 0) and not _is_vowel(w, 1)
    return len(w) >= 3 and not _is_vowel(w, len(w) - 1) and _is_vowel(w, len(w) - 2) and not _is_vowel(w, len(w) - 3) and w[-1] not in "wxy"


def _rules(text: str) -> dict[str, str]:
    """Suffixes, the longest first, and what takes their place."""
    return dict(sorted(((old, new) for old, _, new in (r.partition(":") for r in text.split())), key=lambda r: -len(r[0])))


def _suffix(w: str, rules: dict[str, str]) -> str | None:
    """The longest suffix among the rules."""
    return next(filter(w.endswith, rules), None)


# The suffix rules of Porter's published algorithm, steps 2 to 4, with the extensions in common use, and the words that go by none.
_STEP2 = _rules("ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble fulli:ful alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble")
_STEP3 = _rules("icate:ic ative: alize:al iciti:ic ical:ic ful: ness:")
_STEP4 = _rules("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize")

#: The letters that a suffix of any step ends with; other words stay whole.
_LAST = frozenset("sdgye" + "".join(r[-1] for r in (*_STEP2, *_STEP3, *_STEP4)))
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


def _step2(w: str) -> str:
    """Suffixes of step 2; alli gives way first, as often as it is there, and logi keeps its l with the stem."""
    while w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _replaced(w, _STEP2)


def _replaced(w: str, rules: dict[str, str]) -> str:
    old = _suffix(w, rules)
    if old is None:
        return w
    stem = w[: len(w) - len(old)]
    return stem + rules[old] if _measure(stem) > 0 else w


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """Porter's stemmer with the extensions that scorers of summaries use: irregular words, short -ies and -ied, y after consonants."""
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2 or w[-1] not in _LAST:
        return w
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and not _is_vowel(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and len(w) > 2 and not _is_vowel(w, len(w) - 2):
        w = w[:-1] + "i"
    w = _replaced(_step2(w), _STEP3)
    end = _suffix(w, _STEP4)
    if end:
        s = w[: len(w) - len(end)]
        if _measure(s) > 1 and (end != "ion" or s.endswith(("s", "t"))):
            w = s
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def rouge_tokens(text: str) -> list[str]:
    """Lower-case ASCII letters and digits; words longer than three characters are stemmed."""
    return [stem(w) if len(w) > 3 else w for w in re.findall(r"[a-z0-9]+", text.lower())]


def _f(hit: int, a: int, b: int) -> float:
    return 2 * hit / (a + b) if hit else 0.0


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits: a word's places in a are one integer. A common start and end count as they are, and words of one side only drop out."""
    n = min(len(a), len(b))
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), n)
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), n)
    end = min(end, n - start)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    both = set(a) & set(b)
    a, b = [w for w in a if w in both], [w for w in b if w in both]
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = row & places[w]
        row = ((row + m) | (row - m)) & full
    return start + end + len(a) - row.bit_count()


def rouge(reference: str, hypothesis: str) -> tuple[float, float, float]:
    """M3: F-measures of ROUGE-1, ROUGE-2 and ROUGE-L; 0 with a blank side."""
    a, b = rouge_tokens(reference), rouge_tokens(hypothesis)
    one, two = (sum((_grams(a, n) & _grams(b, n)).values()) for n in (1, 2))
    return _f(one, len(a), len(b)), _f(two, max(len(a) - 1, 0), max(len(b) - 1, 0)), _f(lcs(a, b), len(a), len(b))


_ASCII_WORDS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def _plain(text: str) -> str:
    """Lower-case ASCII letters and digits, as in rouge_tokens, with spaces for all else."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_ASCII_WORDS).decode("ascii")


def _numbered(texts: list[str], alike: Callable[[str], str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A number for each white-space token of the texts in turn, the same for equal ones or, with alike, for those that it makes equal; and the tokens of each text."""
    split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    flat = split.flatten()
    said = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # a text's ends may give empty ones
    sizes = np.bincount(np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))[said], minlength=len(texts))
    coded = flat.dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False)[said].astype(np.int64)
    if alike:
        given: dict[str, int] = {}
        words = np.array([given.setdefault(alike(w), len(given)) for w in coded.dictionary.to_numpy(zero_copy_only=False)], np.int64)[words]
    return words, sizes


def _stemmed(w: str) -> str:
    return stem(w) if len(w) > 3 else w


def _together(pairs: Iterable[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    """Runs of pairs with about TOGETHER tokens, by a guess of 6 characters each."""
    run, size = [], 0
    for r, h in pairs:
        n = (len(r) + len(h)) // 6
        if run and size + n > TOGETHER:
            yield run
            run, size = [], 0
        run.append((r, h))
        size += n
    if run:
        yield run


def _bleu_columns(pairs: list[tuple[str, str]]) -> dict[str, list[float]]:
    words, sizes = _numbered([p[side] for side in (0, 1) for p in pairs])
    rows = [_bleus(hits, a, b, (1, 2, 4)) for hits, a, b in zip(common_grams(words, sizes, 4).tolist(), *sizes.reshape(2, -1).tolist())]
    return dict(zip(("bleu1", "bleu2", "bleu4"), map(list, zip(*rows))))


def _rouge_columns(pairs: list[tuple[str, str]], longest: bool) -> dict[str, list[float]]:
    words, sizes = _numbered([_plain(p[side]) for side in (0, 1) for p in pairs], _stemmed)
    (one, two), (a, b) = common_grams(words, sizes, 2).T.tolist(), sizes.reshape(2, -1).tolist()
    out = {"rouge1": [*map(_f, one, a, b)], "rouge2": [_f(h, max(x - 1, 0), max(y - 1, 0)) for h, x, y in zip(two, a, b)]}
    if longest:
        texts = [t.tolist() for t in np.split(words, np.cumsum(sizes)[:-1])]
        out["rougeL"] = [_f(lcs(x, y), len(x), len(y)) for x, y in zip(texts, texts[len(pairs) :])]
    return out


def bleu_rouge(reference: Column, hypothesis: Column, scores: tuple[str, ...] = SCORES) -> Column:
    """Struct of the named scores, both families' by default; null texts count as ''. What is not named is not computed."""

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for references, hypotheses in batches:
            parts = [pd.DataFrame(columns=list(scores), dtype=float)]
            for pairs in _together(zip(references.fillna(""), hypotheses.fillna(""))):
                found = _bleu_columns(pairs) if any(x.startswith("bleu") for x in scores) else {}
                if any(x.startswith("rouge") for x in scores):
                    found |= _rouge_columns(pairs, "rougeL" in scores)
                parts.append(pd.DataFrame({x: found[x] for x in scores}, dtype=float))
            yield pd.concat(parts[len(parts) > 1 :], ignore_index=True)

    return F.pandas_udf(score, ", ".join(f"{x} double" for x in scores))(reference, hypothesis)
