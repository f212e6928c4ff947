"""Passages of evaluation items inside documents, found by winnowing.

Of every window of WORDS - GRAM + 1 successive hashes of GRAM words the least one (the last of equal ones) is
kept with its place. Two texts that share WORDS successive words share such a window, hence a kept hash at the
same place of the passage, so no shared passage of that length is missed. Hits are extended word by word.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import salted_join, small_or_not
from ..session import materialize
from .lookalike import HOMOGLYPHS, LIMIT, canonical_array, slices, to_points

#: Words in a row that make a leak.
WORDS = 10
#: Words in a hashed gram.
GRAM = 5
#: Log2 of the words of the filter of the items' hashes that the documents' workers get: 2**21 words of 64 bits, 16 MB, however
#: many hashes there are.
FILTER = 21
#: A tag or comment of markup, and a character reference.
TAG = r"<(?:[/!?]?[A-Za-z][^<>]*|!--[^<>]*--)>"
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _caseless(ch: str) -> str:
    """A letter of the consistent form without its case. Case and look go together: a small letter is taken for the Latin one
    that it looks like, or else that its capital looks like (as the consistent form has made the capital Latin already)."""
    low = ch.lower()
    low = chr(HOMOGLYPHS.get(ord(low), ord(low))).lower() if len(low) == 1 else ch
    up = low.upper()
    return chr(HOMOGLYPHS[ord(up)]).lower() if len(up) == 1 and ord(up) in HOMOGLYPHS else low


@functools.cache
def _letters() -> np.ndarray:
    """By code point: 0 for what stands between words, else a number shared by all that are the same letter without its case."""
    out = np.zeros(LIMIT, np.uint64)
    for c in (*range(0xD800), *range(0xE000, 0x32000)):
        ch = chr(c)
        if ch.isalnum():
            low = _caseless(ch)
            out[c] = ord(low) if len(low) == 1 else c
    return np.where(out > 0, mixed(out + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), np.uint64(0))


def _plain(texts: pa.Array) -> pa.Array:
    """Texts in the consistent form, without markup and with character references resolved."""
    form = canonical_array(texts)
    form = pc.replace_substring_regex(form, TAG, " ")
    has = pc.match_substring_regex(form, REFERENCE)
    if pc.any(has).as_py():
        form = pa.array([html.unescape(t) if h else t for t, h in zip(form.to_pylist(), has.to_pylist(), strict=True)], pa.large_string())
        form = canonical_array(form)
    return form


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a string array, and the row of each.

    A word is a longest run of letters and digits. Case, punctuation, spacing, markup and characters that look
    alike don't matter. A null text has no word.
    """
    cp, offsets = to_points(_plain(texts))
    if not len(cp):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    letter = _letters()[cp]
    inside = letter > 0
    first = np.zeros(len(cp) + 1, bool)
    first[offsets] = True
    begins = np.flatnonzero(inside & (first[:-1] | ~np.append(False, inside[:-1])))
    if not len(begins):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    begun = np.zeros(len(cp), np.int64)
    begun[begins] = 1
    place = np.arange(len(cp)) - begins[np.maximum(np.cumsum(begun) - 1, 0)]
    values = np.where(inside, mixed(letter + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), np.uint64(0))
    hashes = mixed(np.add.reduceat(values, begins))
    return hashes, np.searchsorted(offsets, begins, "right") - 1


def winnowed(words: np.ndarray, rows: np.ndarray, gram: int = GRAM, least: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Kept gram hashes and the index of each one's first word; rows of fewer than least words keep none."""
    span = least - gram + 1
    if len(words) < least:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for i in range(gram):
        grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - gram + 1 + i])
    windows = np.lib.stride_tricks.sliding_window_view(grams, span)[:, ::-1]
    whole = rows[: len(windows)] == rows[least - 1 :][: len(windows)]
    at = np.flatnonzero(whole)
    kept = np.unique(at + span - 1 - windows[at].argmin(axis=1))
    return grams[kept], kept


def _neighbourhoods(words: np.ndarray, rows: np.ndarray, at: np.ndarray, gram: int, least: int, outside: int) -> np.ndarray:
    """For each place the words from least - gram before its gram to as many behind it; outside its row a filler."""
    where = at[:, None] + np.arange(gram - least, least)
    inside = (where >= 0) & (where < len(words))
    where = np.clip(where, 0, max(0, len(words) - 1))
    inside &= rows[where] == rows[at][:, None]
    return np.where(inside, words[where].view(np.int64), outside)


def _filter(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash, in the word of its first FILTER bits at the place of its last six. Words are made by an aggregate;
    no more than 2**FILTER of them exist."""
    word, bit = F.shiftrightunsigned("hash", 64 - FILTER), F.expr("shiftleft(1L, cast(hash & 63 AS int))")
    found = hashes.select(word.cast("int").alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << FILTER, np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return out


def fingerprints(df: DataFrame, key: str, text: str, outside: int, gram: int = GRAM, least: int = WORDS, among: np.ndarray | None = None) -> DataFrame:
    """(key, hash, around) of the kept hashes of df's texts; with a filter, only of those whose bit is set.

    around: the hashes of the words of which a passage of least words through the gram can consist.
    """
    sc = df.sparkSession.sparkContext
    wanted = None if among is None else sc.broadcast(among)
    sent = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = T.StructType([T.StructField(key, sent.schema["k"].dataType), T.StructField("hash", T.LongType()), T.StructField("around", T.ArrayType(T.LongType()))])
    width = 2 * least - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, 1)):
            words, rows = words_of(b.column(1))
            hashes, at = winnowed(words, rows, gram, least)
            if wanted is not None and len(hashes):
                here = (wanted.value[hashes >> np.uint64(64 - FILTER)] >> (hashes & np.uint64(63))) & np.uint64(1) > 0
                hashes, at = hashes[here], at[here]
            for i in range(0, len(at), 50_000):
                part = at[i : i + 50_000]
                around = _neighbourhoods(words, rows, part, gram, least, outside)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, around.size + 1, width, dtype=np.int32)), pa.array(around.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[part])), pa.array(hashes[i : i + 50_000].view(np.int64)), lists], [key, "hash", "around"])

    return sent.mapInArrow(run, schema)


def _shares(a: Column, b: Column, gram: int, least: int) -> Column:
    """Whether least successive words are equal in both neighbourhoods."""
    same = F.zip_with(a, b, lambda x, y: x == y)
    tries = [F.forall(F.slice(same, i + 1, least), lambda x: x) for i in range(least - gram + 1)]
    out = tries[0]
    for t in tries[1:]:
        out = out | t
    return out


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", gram: int = GRAM, least: int = WORDS) -> DataFrame:
    """(doc_key, item_key), once for every document that holds at least least successive words of an item's text.

    Null texts, texts of fewer words and rows with a null key give nothing; repeated rows change nothing. A filter of
    fixed size, made of the items' hashes, lets the workers drop most other hashes of documents at once; the rest meets
    the items' in a join that cuts hot hashes on either side. Every document is read whole, once.
    """
    theirs = materialize(fingerprints(items, item_key, text, -2, gram, least).distinct())
    ours = fingerprints(docs, doc_key, text, -1, gram, least, _filter(theirs.select("hash"))).withColumnRenamed("around", "__a")
    theirs = theirs.withColumnRenamed("around", "__b")
    small = small_or_not(theirs)
    met = ours.join(small, "hash") if small is not theirs else salted_join(materialize(ours), theirs, ["hash"])
    return met.filter(_shares(F.col("__a"), F.col("__b"), gram, least)).select(doc_key, item_key).distinct()
