"""Packing: every id in one piece, little padding, the greedy choice, against the tokenizers library."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from blockloom.llm import encoding, packing, queries

SCHEMA = "doc_id long, text string, sequence_id string, offset string, cell string, ids string"


def _texts():
    rng = random.Random(12)
    words = "alpha Beta gamma, delta. the of and über 漢字 😀 x1 it's a\nb c\n\nd  e e　f <|endoftext|> …. ÷. é.".split(" ")
    return [None, "", " ", "\n", "word " * 9000, "x" * 3000] + [" ".join(rng.choices(words, k=rng.randint(1, 900))) for _ in range(60)]


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    made = [(i, t, "a", "b", "c", "d") for i, t in enumerate(texts)]
    return [*made, made[9], made[9], (None, "no id", None, None, None, None), (-5, texts[10], "", "", "", "")]


def test_pieces_hold_every_id_once(spark, rows):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = packing.packed(docs, queries.TOKENIZER, cell_tokens=6000).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want[doc_id, tuple(ids)] += 1
    # Pieces of equal documents cannot be told apart, so the ids of each place are counted.
    places, got = Counter(), Counter()
    for (doc_id, ids), n in want.items():
        places.update({(doc_id, at, token): n for at, token in enumerate(ids)})
    used, at = defaultdict(int), defaultdict(list)
    for r in found:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got.update((r["doc_id"], r["start"] + i, token) for i, token in enumerate(r["ids"]))
        used[r["sequence_id"]] += r["length"]
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == places
    assert sorted(used) == list(range(len(used))) and max(used.values()) <= 1024
    for parts in at.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
    total = sum(used.values())
    assert len(used) * 1024 - total < 1024 * (total // 6000 + 2)
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in found if r["start"] == 0) == Counter(
        {(d, len(ids)): n for (d, ids), n in want.items()})


def test_sequences_are_padded(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    placed = packing.packed(docs, queries.TOKENIZER, length=64, cell_tokens=4096)
    for r in packing.sequences(placed, length=64, pad_id=7).collect():
        n = r["n_ids"]
        assert len(r["input_ids"]) == (n if n & (n - 1) == 0 else 64) and set(r["input_ids"][n:]) <= {7}
        assert sum(p["length"] for p in r["parts"]) == n
    assert packing.packed(docs.where("false"), queries.TOKENIZER).count() == 0


def test_lowest_cost_with_room_is_chosen():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randint(1, 31) for _ in range(rng.randint(1, 40))]
        n = -(-sum(sizes) // 32)
        used, costs, want = [0] * n, [0] * n, []
        waiting = sorted((-s, i, 0) for i, s in enumerate(sizes))
        while waiting:
            s, i, begin = waiting.pop(0)
            room = [b for b in range(n) if used[b] - s <= 32]
            take = -s
            if room:
                to = min(room, key=lambda b: (costs[b], b))
            else:
                to = min(range(n), key=lambda b: (used[b], b))
                take = 32 - used[to]
                waiting = sorted([*waiting, (s + take, i, begin + take)])
            want.append((i, begin, take, to, used[to]))
            used[to] += take
            costs[to] += take * (packing.LINEAR + take)
        assert list(zip(*(x.tolist() for x in packing.assign(np.array(sizes), 32)))) == want


@pytest.mark.parametrize("size", [40, 1 << 22])
def test_encoder_equals_the_library(monkeypatch, size):
    monkeypatch.setattr(encoding.segments, "__defaults__", (size,))
    monkeypatch.setattr(encoding.slices, "__defaults__", (size,))
    rng = random.Random(size)
    letters = list("ab cd  é\n\t.,'s 1２ 　 \u0085\x1c\x01😀漢—’×÷. ") + ["<|endoftext|>"]
    weights = [10] * (len(letters) - 1) + [1]
    texts = ["".join(rng.choices(letters, weights, k=rng.randint(0, 80))) for _ in range(3000)]
    encoder = encoding.Encoder(queries.TOKENIZER)
    ids, counts = encoder.encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(queries.TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
