"""Quality rules: repeated substrings of a text, found by suffix array.

The words of many texts form one symbol sequence with a unique separator after
each text.  Prefix doubling sorts its suffixes (only suffixes that still tie are
sorted again), the saved ranks of each doubling give the longest common prefix
of neighbouring suffixes, and the deepest LCP interval that holds a suffix is as
deep as the larger of its two neighbours' values.  That depth is the longest
maximal repeat starting there, so the union of the spans ``[p, p + depth)`` is
the union of all occurrences of all maximal repeats.

All work is inside a row: nothing is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from roamlens.llm.common import Words, text_chunks, utf8

#: Verdict: a repeated passage counts from so many words, such passages may cover
#: so much of the text, and the longest may have so many words.
MIN_REPEAT_WORDS = 8
MAX_COVERED = 0.2
MAX_LONGEST = 50

BASE_WINDOW = 5  # fixed by the rule n_repeat_words
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def longest_repeats(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each word position, the length in words of the longest substring that
    starts there and occurs again in the same text (0: none)."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    # Symbols: dense numbers of (text, word), then one separator for each text.
    keyed = hashes ^ (doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    _, sym = np.unique(keyed, return_inverse=True)
    at = np.arange(n) + doc  # separators shift later texts by one
    seq = np.empty(n + n_docs, np.int64)
    is_word = np.zeros(n + n_docs, bool)
    is_word[at] = True
    seq[at] = sym
    seq[~is_word] = n + np.arange(n_docs)
    # Rank of a suffix: the first place of its group of ties in sorted order.
    order = np.argsort(seq, kind="stable")
    s = seq[order]
    head = np.concatenate(([True], s[1:] != s[:-1]))
    start = np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
    rank = np.empty(len(s), np.int64)
    rank[order] = start
    levels, k = [rank], 1
    tied = np.concatenate((head[1:] == False, [False])) | ~head  # noqa: E712
    active = order[tied]
    while len(active):
        k1, k2 = rank[active], rank[active + k]  # equal k-prefixes hold no separator
        o = np.lexsort((k2, k1))
        active, k1, k2 = active[o], k1[o], k2[o]
        outer = np.concatenate(([True], k1[1:] != k1[:-1]))
        head = outer | np.concatenate(([True], k2[1:] != k2[:-1]))
        i = np.arange(len(active))
        first_outer = np.maximum.accumulate(np.where(outer, i, 0))
        first = np.maximum.accumulate(np.where(head, i, 0))
        rank = rank.copy()
        rank[active] = k1 + (first - first_outer)
        levels.append(rank)
        tied = np.concatenate((~head[1:], [False])) | ~head
        active, k = active[tied], 2 * k
    sa = np.empty(len(rank), np.int64)
    sa[rank] = np.arange(len(rank))
    a, b = sa[:-1], sa[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[near].copy(), b[near].copy()
    lcp = np.zeros(len(near), np.int64)
    last = len(rank) - 1
    for level in range(len(levels) - 1, -1, -1):
        r = levels[level]
        same = r[np.minimum(a, last)] == r[np.minimum(b, last)]
        step = same * (1 << level)
        a, b, lcp = a + step, b + step, lcp + step
    depth = np.zeros(len(rank), np.int64)
    np.maximum.at(depth, sa[near], lcp)
    np.maximum.at(depth, sa[near + 1], lcp)
    return depth[at]


def covered(depth: np.ndarray, doc: np.ndarray, n_docs: int, least: int) -> np.ndarray:
    """Words of each text in the union of the repeats of ``least`` words or more."""
    n = len(depth)
    p = np.flatnonzero(depth >= least)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, p, 1)
    np.add.at(delta, p + depth[p], -1)
    return np.bincount(doc[np.cumsum(delta[:-1]) > 0], minlength=n_docs)


def text_rules(texts: list[bytes], min_repeat: int, max_covered: float, max_longest: int) -> dict[str, np.ndarray]:
    """The counts and the verdict of whole texts, in one pass over their words."""
    w, n = Words(texts), len(texts)
    words = np.bincount(w.doc, minlength=n)
    depth = longest_repeats(w.hash, w.doc, n)
    repeat_words = covered(depth, w.doc, n, BASE_WINDOW)
    in_spans = covered(depth, w.doc, n, min_repeat)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.doc, depth)
    per_doc = lambda x: np.add.reduceat(x, w.doc_start[:-1]) if n else x[:0]
    is_char = (w.data & 0xC0) != 0x80
    in_word = np.zeros(len(w.data) + 1, np.int8)
    in_word[w.start] += 1
    in_word[w.end] -= 1
    chars = per_doc((is_char & (np.cumsum(in_word[:-1]) > 0)).astype(np.int64))
    symbols = per_doc(_SYMBOLS[w.data].astype(np.int64))
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        dup[i] = len(lines) - len(set(lines))
    failed = (words < 10) | (100 * repeat_words > 20 * words)
    fraction = in_spans / np.maximum(words, 1)
    kept = ~failed & (fraction <= max_covered) & (longest <= max_longest)
    return {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup,
            "n_repeat_words": repeat_words, "base_failed": failed, "kept": kept,
            "n_covered_words": in_spans, "covered_fraction": fraction, "longest_repeat_words": longest}


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, n_covered_words long, covered_fraction double, "
          "longest_repeat_words long")


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     min_repeat: int = MIN_REPEAT_WORDS, max_covered: float = MAX_COVERED,
                     max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per row of ``docs``: its id, the counts, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails; a null id is returned as it is;
    repeated rows give repeated results; other columns are not read."""
    import pyarrow as pa

    def batches(it):
        for b in it:
            ids, texts = b.column(0), utf8(b.column(1))
            for at, part in text_chunks(texts):
                cols = text_rules(part, min_repeat, max_covered, max_longest)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), *[pa.array(v) for v in cols.values()]], ["id", *cols])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = src.mapInArrow(batches, f"id {src.schema[0].dataType.simpleString()}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)
