"""Shares, distances and overused terms against a plain version; skybands against their definition."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from blockloom.llm import divergence, encoding

SCHEMA = "doc_id long, text string, lang string, source string, term string, p string, v string, part string"


def plain(rows, least, top):
    docs, counts = defaultdict(set), defaultdict(Counter)
    for i, (_, text, lang, source, *_) in enumerate(rows):
        lang, source = lang or "", source or ""
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        counts[lang, source].update(terms)
        for t in terms:
            docs[lang, t].add(i)
    result = []
    for lang in {a for a, _ in counts}:
        kept = [t for (a, t), d in docs.items() if a == lang and len(d) >= least]
        groups = {s: c for (a, s), c in counts.items() if a == lang}

        def shares(count):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10 ** 9 * (count[t] + 5) // total for t in kept}

        q = shares(sum(groups.values(), Counter()))
        p = {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                result += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return sorted(result)


def _rows():
    rng = random.Random(13)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "Xyzé漢"] + ["it's", "A1b", "x_y", "漢字", "Ω"]
    rows = [(0, None, None, None), (1, "", "", ""), (2, "12 34 _", "fr", "only"), (3, "x", "fr", "other")]
    for i in range(300):
        lang = rng.choice(["en", "en", "en", "de", None])
        source = rng.choice(["hot", "hot", "hot", "s1", "s2", None, "é\0x"])
        own = words[3:][:25] if source == "hot" else words
        rows.append((i % 40 or None, " ".join(rng.choices(own, k=rng.randint(0, 60))), lang, source))
    rows = [(*r, "t", "p", "v", "part") for r in rows]
    return [*rows, rows[9], rows[9]]


@pytest.mark.parametrize("block, bucket, part", [(256, 2048, 2048), (2, 5, 3)])
def test_equals_plain_version(spark, monkeypatch, block, bucket, part):
    for name, value in (("BLOCK_SOURCES", block), ("BUCKET_TERMS", bucket), ("PART_TERMS", part), ("LEAST_DOCS", 8)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(divergence.shares, "__defaults__", (8,))
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = divergence.divergence(docs, top=6)
    assert found.dtypes[-2:] == [("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, 8, 6)


def test_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_skyband_is_complete():
    rng = random.Random(2)
    for k in (1, 2, 5):
        for _ in range(60):
            terms = [f"{rng.randint(0, 500)}" for _ in range(rng.randint(0, 80))]
            terms = list(dict.fromkeys(terms))
            counts = np.array([rng.randint(1, 9) for _ in terms], np.int64)
            langs = counts + np.array([rng.randint(0, 9) for _ in terms], np.int64)
            want = {i for i in range(len(terms)) if sum(
                counts[j] >= counts[i] and langs[j] <= langs[i] and terms[j] < terms[i] for j in range(len(terms))) < k}
            assert set(divergence.skyband(terms, counts, langs, k).tolist()) == want


@pytest.mark.parametrize("size", [20, 300])
def test_windows_of_long_texts(monkeypatch, size):
    text = " ".join(r[1] or "" for r in _rows()) + "é" * 200
    monkeypatch.setattr(divergence, "SLICE_BYTES", size)
    terms, counts = divergence._long(pa.array([text]))
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    assert dict(zip(terms.to_pylist(), counts.tolist())) == Counter(re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered))
    monkeypatch.setattr(encoding.text_slices, "__defaults__", (size,))
    texts = pa.array([text, "a", "", "b " * 30, "c"])
    parts = list(encoding.text_slices(texts))
    assert pa.concat_arrays(parts) == texts and len(parts[0]) == 1
