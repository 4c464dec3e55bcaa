import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from webloom.llm import pack as P

PATH = P.default_tokenizer()
TOK = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOK.encode(text or "", add_special_tokens=False).ids, P.END_ID]


def check(rows, texts, window=P.WINDOW):
    """Every id in exactly one piece, sequences gapless and within the window. Returns the padding, the last sequences aside."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids, at = np.array(ids_of(text), "<u4"), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    pads = []
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        pads.append(window - at)
    assert sorted(by_seq) == list(range(len(by_seq)))
    return sum(sorted(pads)[:-2])


def test_all_documents_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(P.pack(docs, PATH).collect(), texts) == 0


def test_edge_rows(spark):
    odd = ["", None, "a", "x" * 9000, "word " * 30000, " \n\t  ", "<|endoftext|> \x1c\x85﻿", "字" * 3000, "é́ ½ ٣ can't WE'LL  two  \r\n"]
    rows = [(i, t, "n/a") for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    assert check(P.pack(df, PATH).collect(), {i: t for i, t, _ in rows}) == 0
    assert P.pack(df.limit(0), PATH).count() == 0
    twice = P.pack(df.union(df), PATH).collect()
    assert sum(r.length for r in twice) == 2 * sum(len(ids_of(t)) for t in odd)
    assert P.pack(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), PATH).first().doc_id is None


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    rnd = random.Random(seed)
    counts = np.array([0] + [rnd.choice([0, 0, 1, 7, rnd.randrange(400)]) for _ in range(32)])
    if seed == 4:
        counts = np.array([0] + [0] * 19 + [501] + [0] * 12)  # one length that doesn't divide the window
    tail = rnd.randrange(20_000)
    plan = P.Plan(counts, tail)
    filled = defaultdict(list)
    for c in range(1, 33):
        for k in range(counts[c]):
            parts = plan.place(c, k)
            assert sum(n for _, n, _, _ in parts) == c
            for _, n, s, o in parts:
                filled[s].append((o, n * plan.unit))
    for before, n, s, o in plan.cut_tail(0, tail):
        filled[s].append((o, n))
    short = 0
    for s, spans in filled.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= plan.window
        short += at < plan.window
    assert sorted(filled) == list(range(plan.sequences)) and short <= 2


def test_nnls_fits_a_histogram_that_combinations_make():
    combos = P.combinations(16, 3)
    a = np.zeros((16, len(combos)))
    for j, c in enumerate(combos):
        for k in c:
            a[k - 1, j] += 1
    rng = np.random.default_rng(1)
    b = a @ rng.integers(0, 50, len(combos))
    x = P.nnls(a, b)
    assert (x >= 0).all() and np.abs(a @ x - b).max() < 1e-6


def test_crc_joined():
    data = bytes(range(256)) * 5
    assert P.crc_joined([zlib.crc32(data[i : i + 256]) for i in range(0, 1280, 256)], 256) == zlib.crc32(data)


def test_encoder_equals_the_tokenizer():
    rnd, enc = random.Random(7), P.Encoder(PATH, keep=50)
    plain = list("ab cdE'lsvtrem \t\n\r\x0b\x0c\x00\x1c\x7f.,!?12_-<|>")
    for _ in range(400):
        t = "".join(rnd.choices(plain, k=rnd.randrange(60)))
        assert np.frombuffer(enc(t), "<u4").tolist() == TOK.encode(t, add_special_tokens=False).ids, repr(t)
    alphabet = list("ab cdE'lsv  \n\t.,!?12½²٣é字ß́  　\x1f\x85_-")
    for _ in range(400):
        t = "".join(rnd.choices(alphabet, k=rnd.randrange(60)))
        assert np.frombuffer(enc(t), "<u4").tolist() == TOK.encode(t, add_special_tokens=False).ids, repr(t)
