"""Phrase mining against a plain version, with good, bad and no proposals, and long texts in windows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from blockloom.llm import bitmaps, collocations, encoding

SCHEMA = "doc_id long, text string, lang string, source string, word string, count string, words string, hash string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def counted(rows):
    found = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall("[^\x20\x09]+", piece)
            for n in range(1, 5):
                found["und" if lang is None else lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    return found


def plain(rows, least, top):
    result = []
    for lang, counts in counted(rows).items():
        total = sum(c for g, c in counts.items() if len(g) == 1)
        often = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
        scored = []
        for g, a in often.items():
            score, k = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
            holders = [c for h, c in often.items() if len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h)))]
            if not any(100 * c >= 80 * a for c in holders):
                scored.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, total, -score))
    return sorted(result)


def _rows():
    rng = random.Random(11)
    words = "the of a New york city stock Exchange über 漢字 it's x\x01y　z it b c d e f g h".split(" ")
    fixed = ["New York stock exchange", "over the top of it", "b c d e f", "漢字 x\x01y　z"]
    texts = [None, "", " \t\n", "one", "the  of\tthe of", "A a A a A a a a a a"]
    for _ in range(120):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(1, 80))]
        texts.append("".join(p + rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b"]) for p in parts))
    made = [(i, t, ["en", "en", "en", None, "é", ""][i % 6], "s", "w", "c", "ws", "h") for i, t in enumerate(texts)]
    return [*made, made[8], made[8], (None, texts[9], "en", None, None, None, None, None), (None, texts[10], None, "", "", "", "", "")]


@pytest.mark.parametrize("top", [2000, 7])
def test_equals_plain_version(spark, top):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = collocations.collocations(docs, min_count=12, top=top).collect()
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r[c] for c in names) for r in found) == plain(rows, 12, top)
    assert collocations.collocations(docs.where("false")).count() == 0


@pytest.mark.parametrize("sample_of, sample_min", [(4, 255), (1000, 1), (1, 12)])
def test_border_failures_are_followed_up(spark, sample_of, sample_min):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    found, words = collocations.frequent_phrases(docs, 10, sample_of, sample_min)
    name = {(r["lang"], r["hash"]): r["word"] for r in words.collect()}
    got = sorted((r["lang"], tuple(name[r["lang"], h] for h in r["words"]), r["count"]) for r in found.collect())
    assert got == sorted((lang, g, c) for lang, counts in counted(rows).items() for g, c in counts.items() if c >= 10)


def test_equal_hashes_of_words_are_noticed(spark, monkeypatch):
    def weak(word, salt):
        from pyspark.sql import functions as F
        return F.lit(7).cast("long") if salt == "0" else F.xxhash64(F.concat(F.lit(salt), word))
    monkeypatch.setattr(collocations, "word_hash", weak)
    docs = spark.createDataFrame(_rows(), SCHEMA)
    assert len(collocations.collocations(docs, min_count=12).collect()) == len(plain(_rows(), 12, 2000))


@pytest.mark.parametrize("size", [30, 200, 1 << 22])
def test_windows_of_long_texts(monkeypatch, size):
    monkeypatch.setattr(collocations, "SLICE_BYTES", size)
    monkeypatch.setattr(encoding.text_slices, "__defaults__", (size,))
    rows = [r for r in _rows() if r[1] is not None]
    rows.append((1, " ".join(r[1] for r in rows) + "x" * 500 + " y z", "en"))
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] or "und" for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    every = np.full(1 << bitmaps.BITS - 6, ~np.uint64(0))
    got, want = Counter(), Counter()
    names = {}
    for lang, words, _, own in ((a, b, c, e) for a, b, c, _, e in collocations._scan(iter([batch]))):
        names.update(zip(collocations._hashes(words, "0").tolist(), words))
    for lang, words, _, counts in collocations._phrases(iter([batch]), "0", (2, 3, 4), every, None):
        for g, c in zip(words.tolist(), counts.tolist()):
            got[lang, tuple(names[w].decode() for w in g)] += c
    for lang, counts in counted([(r[0], r[1], r[2] or "und") for r in rows]).items():
        want.update({(lang, g): c for g, c in counts.items() if len(g) > 1})
    assert got == want


def test_chance_members_of_a_full_bitmap_lose_no_phrase():
    """An earlier pass that was not given ``a b`` never reached ``a b c``, even if its bitmap held that by chance."""
    words = collocations._hashes([b"a", b"b", b"c", b"d"], "0")
    first = collocations._first("en", words)
    triples = [collocations._longer(collocations._longer(first[i:i + 1], words[i + 1:i + 2]), words[i + 2:i + 3]) for i in (0, 1)]
    old, every = bitmaps.empty(), np.full(1 << bitmaps.BITS - 6, ~np.uint64(0))
    bitmaps.put(old, bitmaps.cells(np.concatenate([first, *triples])))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["a b c d"])], ["lang", "text"])
    found = {tuple(w.shape): c.tolist() for _, w, _, c in collocations._phrases(iter([batch]), "0", (2, 3, 4), every, old)}
    assert found == {(0, 2): [], (2, 3): [1, 1], (1, 4): [1]}
