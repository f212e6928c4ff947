"""One form for texts that look the same.

The text column of an Arrow batch is read as one array of code points. Lookup tables replace every code
point (width forms, look-alike letters, blanks, characters without a look), expansion offsets make room for
those that stand for several, marks are put into canonical order and composed for the whole batch at once.
No Python string is made for a row.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import salted_join, skew_join
from ..session import materialize

# Letters of other alphabets and letter blocks that are drawn like a Latin letter, then that letter.
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺονρϲϳ", "ABEZHIKMNOPTYXCMovpcj")
CYRILLIC = ("АВЕЅІЈКМНОРСТХҮԌԚԜаеорсухѕіјѵһԁԛԝӏ", "ABESIJKMHOPCTXYGQWaeopcyxsijvhdqwl")
ARMENIAN = ("ՏՍՕհոսօցզ", "SUOhnuogq")
CHEROKEE = ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᏔᏃᎡᏀᎳᎥ", "ABCDEHJKLMPSTVWZRGWi")
COPTIC = ("ⲀⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲌⲟⲣⲥⲭ", "ABHIKMNOPCTYXZopcx")
LISU = ("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU")
IPA = ("ɡɑᴄᴏᴜᴠᴡᴢꜱ", "gacouvwzs")
# Letters of other alphabets and blocks that are drawn like each other but like no Latin letter, then the Cyrillic one.
NO_LATIN = ("ΓΠΦΨᎱⲄⲠⲪⲮᴦᴨᴫκᴋĸʙᴍʜᴛ", "ГПФѰГГПФѰгплккквмнт")
HOMOGLYPHS = {ord(a): ord(b) for x, y in (GREEK, CYRILLIC, ARMENIAN, CHEROKEE, COPTIC, LISU, IPA, NO_LATIN) for a, b in zip(x, y, strict=True)}

# Code points without a look that are not of the category Cf, as ranges.
UNSEEN = ((0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180D), (0x180F, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
# Code points of the category Cf that are drawn.
SEEN_CF = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
# Code points that end a line, besides CR and LF.
LINE_ENDS = (0x0B, 0x0C, 0x85, 0x2028, 0x2029)

#: Compatibility decompositions that change neither size, place nor frame of what is drawn.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")
LIMIT = 0x110000
#: Bytes of text whose code points are worked on at once.
SLICE = 1 << 21
L0, V0, T0, S0 = 0x1100, 0x1161, 0x11A7, 0xAC00
LN, VN, TN = 19, 21, 28


class Tables(NamedTuple):
    """By code point: how many code points stand for it, the first of them, where they start in pool, its class."""

    length: np.ndarray
    first: np.ndarray
    start: np.ndarray
    pool: np.ndarray
    ccc: np.ndarray
    pair: np.ndarray
    joined: np.ndarray


def _stands_for(c: int) -> list[int]:
    ch = chr(c)
    if c in LINE_ENDS:
        return [10]
    cat = unicodedata.category(ch)
    if any(a <= c <= b for a, b in UNSEEN) or cat == "Cf" and c not in SEEN_CF:
        return []
    if cat == "Zs":
        return [32]
    if c in HOMOGLYPHS:
        return [HOMOGLYPHS[c]]
    tag, _, rest = unicodedata.decomposition(ch).rpartition("> ")
    parts = [int(x, 16) for x in rest.split()]
    if not parts:
        return [c]
    if tag:
        same = tag + ">" in SAME_LOOK or c == 0xB5 or c != 0x17F and tag == "<compat" and all(x < 128 and chr(x).isalpha() for x in parts)
        if not same:
            return [c]
    return [y for x in parts for y in _stands_for(x)]


@functools.cache
def tables() -> Tables:
    """The lookup tables, from the rules above and the Unicode data of this Python."""
    length, first = np.ones(LIMIT, np.uint8), np.arange(LIMIT, dtype=np.uint32)
    start, ccc = np.zeros(LIMIT, np.int32), np.zeros(LIMIT, np.uint8)
    pool: list[int] = []
    pairs: dict[int, int] = {}
    same = {*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000), *range(S0, 0xE000)}
    for c in [*(x for x in range(0xE000) if x not in same), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]:
        to = _stands_for(c)
        length[c] = len(to)
        if to != [c]:
            first[c] = to[0] if to else 0
            if len(to) > 1:
                start[c] = len(pool)
                pool += to
        ccc[c] = unicodedata.combining(chr(c))
        d = unicodedata.decomposition(chr(c))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(c)) == chr(c):
            a, b = (int(x, 16) for x in d.split())
            pairs[a << 21 | b] = c
    keys = np.array(sorted(pairs), np.int64)
    return Tables(length, first, start, np.array(pool, np.uint32), ccc, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32))


def _compose(a: np.ndarray, b: np.ndarray, t: Tables) -> np.ndarray:
    """The code point that a and b compose to, element by element; 0 if none."""
    a64, b64 = a.astype(np.int64), b.astype(np.int64)
    key = a64 << 21 | b64
    at = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
    out = np.where(t.pair[at] == key, t.joined[at], 0).astype(np.uint32)
    lead, vowel, tail, syl = a64 - L0, b64 - V0, b64 - T0, a64 - S0
    lv = (lead >= 0) & (lead < LN) & (vowel >= 0) & (vowel < VN)
    lvt = (syl >= 0) & (syl < LN * VN * TN) & (syl % TN == 0) & (tail > 0) & (tail < TN)
    out[lv] = (S0 + (lead * VN + vowel) * TN)[lv]
    out[lvt] = (a64 + tail)[lvt]
    return out


def _marks_joined(cp: np.ndarray, is_start: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Code points with marks composed onto their bases, and which to keep. Marks are in canonical order."""
    ccc = t.ccc[cp]
    keep = np.ones(len(cp), bool)
    base = np.flatnonzero((ccc == 0) & np.append((ccc[1:] > 0) & ~is_start[1:], False))
    if not len(base):
        return cp, keep
    cp, last, step = cp.copy(), np.zeros(len(base), np.uint8), 1
    while len(base):  # step by step along the marks of all bases at once; a base leaves when its marks end
        at = base + step
        inside = at < len(cp)
        inside[inside] = (ccc[at[inside]] > 0) & ~is_start[at[inside]]
        base, last, at = base[inside], last[inside], at[inside]
        got = _compose(cp[base], cp[at], t)
        ok = (got > 0) & ((last == 0) | (last < ccc[at]))
        cp[base[ok]] = got[ok]
        keep[at[ok]] = False
        last = np.where(ok, last, ccc[at])
        step += 1
    return cp, keep


def _bases_joined(cp: np.ndarray, is_start: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """As _marks_joined, for neighbours that are both bases (Hangul and a few Indic vowels)."""
    keep = np.ones(len(cp), bool)
    if len(cp) < 2 or int(cp.max()) < 0x0900:
        return cp, keep
    got = _compose(cp[:-1], cp[1:], t)
    ok = (got > 0) & (t.ccc[cp[1:]] == 0) & (t.ccc[cp[:-1]] == 0) & ~is_start[1:]
    if ok.any():
        ok &= ~np.append(False, ok[:-1])  # of overlapping pairs the left one goes first
        cp = cp.copy()
        cp[:-1][ok] = got[ok]
        keep[1:][ok] = False
    return cp, keep


def _kept(cp: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return cp[keep], np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))[offsets]


def _starts(n: int, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(n + 1, bool)
    out[offsets] = True
    return out[:n]


def canonical_points(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of many texts and where each begins (one more at the end), both in the consistent form."""
    t = tables()
    if not len(cp) or int(cp.max()) < 128 and not ((cp < 32) & (cp != 9) & (cp != 10) | (cp == 127)).any():
        return cp, offsets
    cr = cp == 13
    if cr.any():
        first = _starts(len(cp), offsets)
        before_lf = cr & np.append((cp[1:] == 10) & ~first[1:], False)
        cp = np.where(cr, np.uint32(10), cp)
        cp, offsets = _kept(cp, offsets, ~before_lf)
    lens = t.length[cp]
    if (lens != 1).any():
        ends = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
        src = np.repeat(np.arange(len(cp)), lens)
        out = t.first[cp[src]]
        many = lens[src] > 1
        out[many] = t.pool[(t.start[cp[src]] + np.arange(len(src)) - ends[src])[many]]
        cp, offsets = out, ends[offsets]
    else:
        cp = t.first[cp]
    ccc = t.ccc[cp]
    first = _starts(len(cp), offsets)
    if ccc.any():
        if len(cp) > 1 and ((ccc[:-1] > ccc[1:]) & (ccc[1:] > 0) & ~first[1:]).any():
            segment = np.cumsum((ccc == 0) | first)
            marks = np.flatnonzero(ccc > 0)
            cp = cp.copy()
            cp[marks] = cp[marks[np.lexsort((ccc[marks], segment[marks]))]]
        cp, keep = _marks_joined(cp, first, t)
        cp, offsets = _kept(cp, offsets, keep)
    while True:  # a Hangul syllable takes two rounds; marks behind a joined base take another
        first = _starts(len(cp), offsets)
        cp, keep = _bases_joined(cp, first, t)
        if keep.all():
            return cp, offsets
        cp, offsets = _kept(cp, offsets, keep)
        cp, keep = _marks_joined(cp, _starts(len(cp), offsets), t)
        cp, offsets = _kept(cp, offsets, keep)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts in a column take about limit bytes together, or of one longer text."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield batch.slice(a, z - a)


def to_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array, and where each row begins in them; a null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    byte_at = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8)
    raw = memoryview(data)[byte_at[0] : byte_at[-1]] if data is not None else memoryview(b"")
    head = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80
    cp = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), "<u4")
    return cp, np.concatenate(([0], np.cumsum(head, dtype=np.int64)))[byte_at - byte_at[0]]


def from_points(cp: np.ndarray, offsets: np.ndarray, nulls: pa.Array | None = None) -> pa.Array:
    """The string array of code points; rows at which nulls is true are null."""
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    byte_at = np.concatenate(([0], np.cumsum(width)))[offsets]
    data = np.ascontiguousarray(cp, "<u4").tobytes().decode("utf-32-le").encode()
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(byte_at.tobytes()), pa.py_buffer(data))
    if nulls is not None and nulls.true_count:
        out = pa.compute.if_else(nulls, pa.scalar(None, pa.large_string()), out)
    return out


def canonical_array(texts: pa.Array) -> pa.Array:
    """texts in the consistent form; nulls stay null."""
    return from_points(*canonical_points(*to_points(texts)), texts.is_null())


def canonical_text(df: DataFrame, text: str = "text", out: str = "canonical", keep: list[str] | None = None) -> DataFrame:
    """df's columns keep (all by default) and out, the consistent form of text.

    Two texts get equal forms if they look the same: width forms, kinds of blanks and line ends, composed or
    separate marks, characters without a look and look-alike letters don't matter; case, accents, digits,
    punctuation, line breaks and the number of blanks do. Null stays null, an empty text or one of characters
    without a look becomes empty. Texts of any length are taken whole. A column named out is replaced.
    """
    keep = [c for c in keep or df.columns if c != out]
    sent = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*(sent.schema[c] for c in keep), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in slices(b, b.num_columns - 1):
                form = canonical_array(x.column(x.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*x.columns[:-1], form.cast(pa.string())], [*keep, out])

    return sent.mapInArrow(run, schema)


def _members(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, r, c): the key, the text's digest and its form's digest of each row that has a key and a visible character."""
    forms = canonical_text(df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL").select("k", F.unhex(F.md5("t")).alias("r"), "t"), "t", "f", ["k", "r"])
    return forms.filter(F.col("f").rlike(r"\S")).select("k", "r", F.unhex(F.md5("f")).alias("c"))


def lookalike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_texts, n_rows) of every row of df with a visible text: class_id is the least key of the rows that
    look the same, which have n_texts different texts. Rows without a visible text or key are left out.

    Counts are combined within tasks before they are shuffled, and a class of any size meets its one row of counts.
    """
    members = materialize(_members(df, key, text))
    texts = members.groupBy("c", "r").agg(F.min("k").alias("k"), F.count("*").alias("n"))
    classes = texts.groupBy("c").agg(F.min("k").alias("class_id"), F.count("*").alias("n_texts"), F.sum("n").alias("n_rows"))
    return skew_join(members.select("c", F.col("k").alias(key)), materialize(classes), ["c"]).select(key, "class_id", "n_texts", "n_rows")


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (a, b), a < b, of df's keys whose texts look the same but differ.

    Equal texts make one class; classes of one form are paired, and only then do their members meet, so
    copies of one text never meet each other. Null texts and texts without a visible character are in no
    pair; a row with a null key is left out, a repeated row counts once.
    """
    members = materialize(_members(df, key, text))
    classes = members.select("c", "r").distinct()
    several = classes.groupBy("c").count().filter("count > 1").select("c")
    classes = materialize(classes.join(several, "c", "left_semi"))
    members = materialize(members.join(classes.select("r"), "r", "left_semi").select("r", "k").distinct())
    pairs = materialize(salted_join(classes.withColumnRenamed("r", "r1"), classes.withColumnRenamed("r", "r2"), ["c"]).filter("r1 < r2").select("r1", "r2"))
    ours, theirs = members.withColumnsRenamed({"r": "r1", "k": "k1"}), members.withColumnsRenamed({"r": "r2", "k": "k2"})
    half = materialize(salted_join(ours, pairs, ["r1"]).select("r2", "k1"))
    out = salted_join(half, theirs, ["r2"]).filter("k1 <> k2")
    return out.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).distinct()
