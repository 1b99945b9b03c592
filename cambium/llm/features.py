"""Features of texts and of their passages, computed on whole Arrow batches, and bounded samples of labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.llm.common import SPREAD, bit_sums, distinct, held_out, mixed, prefix, ranged, text_bytes, words_of

#: Words in a passage.
PASSAGE = 64
#: Statistics of a passage, and of a whole text.
N_STATS, N_TEXT = 14, 4
#: Columns of projected words.
N_WORDS = 64
BUCKETS = 1 << 20

_UPPER, _DIGIT, _MARK, _SYMBOL, _HIGH, _LETTER = 1, 2, 3, 4, 5, 6
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 128:
        _CLASS[_b] = _HIGH
    elif _c.isupper():
        _CLASS[_b] = _UPPER
    elif _c.isdigit():
        _CLASS[_b] = _DIGIT
    elif _c.isalpha():
        _CLASS[_b] = _LETTER
    elif _c in ".,;:'\"?()-":
        _CLASS[_b] = _MARK
    elif _c.isprintable() and _c != " ":
        _CLASS[_b] = _SYMBOL
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.isin(_CLASS, (0, _MARK, _SYMBOL))
#: Three counts in one integer, 21 bits each, for one sum over the bytes of a passage.
_COUNTED = [sum(((np.arange(256) == c) if k < 0 else (_CLASS == k)).astype(np.uint64) << np.uint64(21 * i) for i, (k, c) in enumerate(three)) for three in (((_UPPER, 0), (_DIGIT, 0), (_MARK, 0)), ((_SYMBOL, 0), (_HIGH, 0), (-1, 10)))]


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring edges, empty ranges being 0."""
    run = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=run[1:])
    return np.diff(run[edges])


def _distinct(group: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes in each of n groups."""
    codes = distinct(mixed(hashes) >> np.uint64(24) | group.astype(np.uint64) << np.uint64(40))
    return np.bincount((codes >> np.uint64(40)).astype(np.int64), minlength=n)


@dataclass
class Passages:
    """stats: a row for each passage; first: index of each text's first passage (n + 1); words: of each text."""

    stats: np.ndarray
    first: np.ndarray
    words: np.ndarray


def passages(array: pa.Array, projected: bool = False) -> Passages:
    """Statistics of every passage of every text; a text without words has one passage of zeros.

    projected: N_WORDS more columns, the hashed lower-case words of the passage, projected: each word adds 1 or -1 to each
    column by a bit of its hash, and the sum is over the root of their number.
    """
    buf, offsets = text_bytes(array)
    starts, ends, first_word = words_of(buf, offsets)
    n_words = np.diff(first_word)
    low = _LOWER[buf] if projected else buf
    many = np.maximum(1, -(-n_words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(n_words)), many)
    nth = np.arange(first[-1]) - first[text]
    lead = np.minimum(first_word[text] + nth * PASSAGE, first_word[text + 1])
    edges = np.append(lead, len(starts))
    padded = np.append(starts, len(buf))
    bytes_at = np.where(nth == 0, offsets[text], padded[lead])
    span = np.append(bytes_at, len(buf))
    size, words = np.maximum(np.diff(span), 1), np.maximum(np.diff(edges), 1)
    counts = []
    for lookup in _COUNTED:
        run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(lookup[buf], out=run[1:])
        both = np.diff(run[span])
        counts += [(both >> np.uint64(21 * i) & np.uint64((1 << 21) - 1)).astype(np.int64) for i in range(3)]
    lengths = ends - starts
    mean = _sums(lengths, edges) / words
    square = _sums(lengths * lengths, edges) / words
    sums = prefix(SPREAD[buf])
    hashes = ranged(sums, starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first_word[:-1][n_words > 0]] = False
    last = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    group = np.repeat(np.arange(len(lead)), np.diff(edges))
    unlike_words = _distinct(group, hashes, len(lead))
    stats = np.stack(
        [
            np.log1p(np.diff(edges)), mean, np.sqrt(np.maximum(square - mean * mean, 0)),
            *(c / size for c in counts[:5]),
            counts[5] / words, _sums(same, edges) / words, unlike_words / words,
            _sums(np.isin(last, (33, 46, 63)), edges) / words, _sums(lengths <= 3, edges) / words,
            _sums((lengths == 1) & (_CLASS[last] == _SYMBOL), edges) / words,
        ],
        axis=1,
    )
    whole = _distinct(np.repeat(np.arange(len(n_words)), n_words), hashes, len(n_words)) / np.maximum(n_words, 1)
    cuts = np.flatnonzero(buf == 10)
    line_at = distinct(np.concatenate([offsets[:-1], cuts + 1]))
    line_at = line_at[line_at < len(buf)]
    line_end = np.append(line_at[1:], len(buf))
    owner = np.searchsorted(offsets, line_at, side="right") - 1
    lines = np.bincount(owner, minlength=len(n_words))[: len(n_words)]
    unlike = _distinct(owner, ranged(sums, line_at, line_end), len(n_words)) if len(line_at) else np.zeros(len(n_words))
    of_text = np.stack([np.log1p(n_words), whole, np.log1p(lines), unlike / np.maximum(lines, 1)], axis=1)
    if not projected:
        return Passages(np.hstack([stats, of_text[text]]), first, n_words)
    more, some = np.zeros((len(lead), N_WORDS)), np.diff(edges) > 0
    if some.any():
        count = np.diff(edges)[some][:, None]
        more[some] = (2 * bit_sums(mixed(ranged(prefix(SPREAD[low]), starts, ends)), lead[some]) - count) / np.sqrt(count)
    return Passages(np.hstack([stats, of_text[text], more]), first, n_words)


def bag(array: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs, distinct: hashed lower-case words of letters and digits, and their first five bytes.

    wanted: a number for each bucket, below 0 if it isn't wanted; pairs then carry that number.
    """
    buf, offsets = text_bytes(array)
    low = _LOWER[buf]
    starts, ends, first = words_of(low, offsets, _BREAK)
    sums = prefix(SPREAD[low])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    longer = ends - starts > 5
    word = ranged(sums, starts, ends) >> np.uint64(44)
    head = mixed(ranged(sums, starts[longer], starts[longer] + 5)) >> np.uint64(44)
    bucket, owner = np.concatenate([word, head]).astype(np.int64), np.concatenate([text, text[longer]])
    if wanted is not None:
        bucket = wanted[bucket]
        owner, bucket = owner[bucket >= 0], bucket[bucket >= 0]
    codes = distinct(owner * BUCKETS + bucket)
    return codes // BUCKETS, codes % BUCKETS


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, wanted: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """About `rows` labelled documents at most (doc_id, text, the wanted labels) that aren't held out, by a hash of the id.

    Repeated labels of a document count once (the smallest of each); rows with a null id, text or wanted label don't
    count. The sampled labels are broadcast: there are at most about `rows` of them, whatever the input.
    """
    each = labels.where(~held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.min(n).alias(n) for n in wanted]).dropna(subset=list(wanted))
    total = each.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) / float(1 << 24)
    picked = each.where(draw < F.lit(min(1.0, rows / max(total, 1))))
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
