"""Problems 6, 7 and 8."""

from __future__ import annotations

import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphmill import scale
from graphmill.llm import bpe, leaks, lookalike

DIRTY = [None, "", " ", "\n\t ", "it's 12 tests​  <|endoftext|>", "x" * 5000, "naïve façade 日本語 🕸️ \x00\x1c", "a" * 3 + " " * 40 + "b", "don't  DON'T\r\n\r\n", "é́́" * 30]


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rnd = random.Random(2)
    texts = DIRTY + ["".join(chr(rnd.choice([32, 97, 98, 101, 0x20AC, 0x416, 0x4E2D, 0x1F600, 10, 48, 39])) for _ in range(rnd.randrange(300))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in bpe.token_ids(df.unionByName(df.limit(3))).collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert got[0] == got[1] == []
    assert bpe.token_ids(df.limit(0)).count() == 0


@given(st.binary(max_size=40))
def test_ids_decode_to_the_piece(piece):
    ranks = bpe.read_ranks(bpe.vocabulary_path())
    tokens = {v: k for k, v in ranks.items()}
    assert b"".join(tokens[i] for i in bpe.encode_piece(piece, ranks)) == piece


def one(text):
    return lookalike.canonical_array(pa.array([text])).to_pylist()[0]


@given(st.lists(st.text(st.characters(blacklist_categories=("Cs", "Cc", "Cf", "Zs", "Zl", "Zp"), max_codepoint=0x2FFF)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_composition_is_canonical(texts):
    marked = [unicodedata.normalize("NFD", t) for t in texts]
    a, b = (lookalike.canonical_array(pa.array(x, pa.string())).to_pylist() for x in (texts, marked))
    assert a == b and lookalike.canonical_array(pa.array(a, pa.string())).to_pylist() == a
    plain = [t for t in texts if not any(ord(c) in lookalike.HOMOGLYPHS or unicodedata.decomposition(c).startswith("<") or lookalike._stands_for(ord(c)) == [] for c in unicodedata.normalize("NFD", t))]
    assert lookalike.canonical_array(pa.array(plain, pa.string())).to_pylist() == [unicodedata.normalize("NFC", t) for t in plain]


def test_same_look():
    same = [("ｆｕｌｌ　１", "full 1"), ("раypаl", "paypal"), ("é", "é"), ("a​b­c", "abc"), ("ﬁn", "fin"), ("x y", "x y"), ("a\r\nb", "a\nb"), ("ﾃﾞ", "デ"), ("하", "하"), ("각", "각"), ("K", "K"), ("ё", "ë"), ("q̣̇", "q̣̇"), ("e​́", "é")]
    for a, b in same:
        assert one(a) == one(b), (a, b)
    for a, b in [("a", "A"), ("e", "é"), ("1", "2"), ("a b", "a  b"), ("a.", "a"), ("a\nb", "a b"), ("x²", "x2"), ("①", "1"), ("ß", "ss")]:
        assert one(a) != one(b), (a, b)


def test_pairs(spark, monkeypatch):
    rows = [(1, "abc"), (2, "abc"), (3, "аbc"), (4, "ａbc"), (5, None), (6, ""), (7, "​"), (8, " "), (9, " "), (10, "Abc"), (None, "abc​"), (3, "аbc"), (12, "z" * 100_000), (11, "z" * 100_000 + "‍")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, f string")
    got = sorted(map(tuple, lookalike.lookalike_pairs(df).collect()))
    assert got == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (11, 12)]
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0
    monkeypatch.setattr(scale, "HOT_ROWS", 2)
    assert sorted(map(tuple, lookalike.lookalike_pairs(df).collect())) == got
    assert [r.canonical for r in lookalike.canonical_text(df.filter("doc_id IN (3, 5, 7)"), keep=["doc_id"]).distinct().orderBy("doc_id").collect()] == ["abc", None, ""]


def test_alike_without_a_latin_twin(spark):
    for a, b in [("Π", "П"), ("Γ", "Г"), ("Φ", "Ф"), ("Ψ", "Ѱ"), ("Ꮁ", "Г"), ("Ⲡ", "П"), ("ᴨ", "п"), ("Γ\u0301", "Ѓ")]:
        assert one(a) == one(b), (a, b)
    for a, b in [("Ꭱ", "R"), ("Ꮃ", "W"), ("Ⲙ", "M"), ("ꓪ", "W"), ("ᴄ", "с"), ("κ", "к"), ("ᴍ", "м"), ("ꓰ\u0301", "É")]:
        assert one(a) == one(b), (a, b)
    for a, b in [("Π", "π"), ("π", "п"), ("Л", "Λ"), ("Π", "Γ"), ("ᴀ", "A"), ("в", "В"), ("κ", "Κ")]:
        assert one(a) != one(b), (a, b)
    df = spark.createDataFrame([(1, "После запуска"), (2, "Πосле запуска"), (3, "после запуска")], "doc_id long, text string")
    assert list(map(tuple, lookalike.lookalike_pairs(df).collect())) == [(1, 2)]
    # Words ignore case too, in either alphabet and across both.
    words = [leaks.words_of(pa.array([t]))[0].tolist() for t in ("После Фото Где", "Πосле Φото Γде", "после фото где")]
    assert words[0] == words[1] == words[2]
    words = [leaks.words_of(pa.array([t]))[0].tolist() for t in ("Προς φορ γης ψ", "προς Φορ Γης Ψ")]
    assert words[0] == words[1]


def test_words_have_no_case():
    for a, b in [("Когда Теперь Ветка Мы Ночь", "когда теперь ветка мы ночь"), ("КОГДА ТЕПЕРЬ", "Koгда ТEпepь"), ("ΤΗΣ ΜΕΤΑΒΑΣΕΙΣ ΚΑΙ ΟΧΙ".replace("Σ", "Γ"), "τηγ μεταβαγειγ και οχι"), ("Ёж", "ёЖ")]:
        x, y = (leaks.words_of(pa.array([t]))[0].tolist() for t in (a, b))
        assert x == y, (a, b)
    x, y = (leaks.words_of(pa.array([t]))[0].tolist() for t in ("мой", "мои"))
    assert x != y


def test_classes(spark, monkeypatch):
    rows = [(1, "abc"), (2, "abc"), (3, "аbc"), (4, "Abc"), (5, None), (6, "\u200b"), (None, "abc"), (3, "аbc"), (9, "z" * 50_000)]
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, class_id int")
    want = [(1, 1, 2, 4), (2, 1, 2, 4), (3, 1, 2, 4), (3, 1, 2, 4), (4, 4, 1, 1), (9, 9, 1, 1)]
    assert sorted(map(tuple, lookalike.lookalike_classes(df).collect())) == want
    assert lookalike.lookalike_classes(df.limit(0)).count() == 0
    monkeypatch.setattr(scale, "HOT_ROWS", 2)
    assert sorted(map(tuple, lookalike.lookalike_classes(df).collect())) == want


def runs_of(words, n=10):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def disguised(rnd, words):
    out = []
    for w in words:
        w = rnd.choice([w, w.upper(), w.replace("a", "а"), f"<b>{w}</b>", f"*{w}*", "".join(c + "​" for c in w), f"{w},\n", f"&quot;{w}&quot;"])
        out.append(w)
    return rnd.choice([" ", "\n", "  "]).join(out)


def test_leaks_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(9)
    pool = ["tree", "arc", "node", "a", "the", "gate", "77", "façade", "b2", "is"] + [f"w{i}" for i in range(60)]
    items = [(i, [rnd.choice(pool) for _ in range(rnd.randrange(5, 40))]) for i in range(20)]
    docs = []
    for i in range(150):
        _, words = rnd.choice(items)
        n = rnd.randrange(0, len(words) + 1)
        at = rnd.randrange(0, len(words) - n + 1)
        docs.append((i, [rnd.choice(pool) for _ in range(rnd.randrange(12))] + words[at : at + n] + [rnd.choice(pool) for _ in range(rnd.randrange(12))]))
    docs += [(900, ["tree"] * 30), (901, [])]
    items += [(50, ["tree"] * 12), (51, items[0][1])]
    want = {(d, i) for d, a in docs for i, b in items if runs_of(a) & runs_of(b)}
    assert len(want) > 30
    d = spark.createDataFrame([(k, disguised(rnd, w), 1) for k, w in docs] + [(902, None, 1), (None, " ".join(items[3][1]), 1)], "doc_id long, text string, hash int")
    e = spark.createDataFrame([(k, " ".join(w), None) for k, w in items] + [(60, None, None)], "item_id long, text string, answer string")
    got = leaks.leaked_items(d.unionByName(d), e).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(leaks, "FILTER", 2)  # all bits set: nothing is dropped before the join
    assert {tuple(r) for r in leaks.leaked_items(d, e).collect()} == want
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(scale.small_or_not, "__defaults__", (3,))
    assert {tuple(r) for r in leaks.leaked_items(d, e).collect()} == want
    monkeypatch.setattr(scale, "HOT_ROWS", 10)
    assert {tuple(r) for r in leaks.leaked_items(d, e).collect()} == want
    assert leaks.leaked_items(d.limit(0), e).count() == leaks.leaked_items(d, e.limit(0)).count() == 0
