"""The near stage against the exact similarity of all pairs."""

import random

import corpus_pipeline as P

from webloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def test_edited_copies_go_and_clean_documents_stay(spark, tmp_path):
    rnd, texts = random.Random(4), []
    for _ in range(30):
        w = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(120, 300))]
        texts.append(" ".join(w))
        for edits in (2, 3, 30):
            v = list(w)
            for i in rnd.sample(range(len(v)), edits):
                v[i] = f"new{rnd.randrange(3000)}"
            texts.append(" ".join(v))
    texts += ["", "a b c"]
    sets = [shingles(t) for t in texts]
    fps = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    far = 0
    for i in range(len(texts)):
        for j in range(i):
            bits = (fps[i] ^ fps[j]).bit_count()
            if bits <= 3 or similarity(sets[i], sets[j]) >= 0.8:
                far += bits > 3
                a, b = sorted((top(i), top(j)))
                root[b] = a
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id for r in P.dedup_near(spark, docs, str(tmp_path)).collect()}
    assert far > 20
    assert got == {i for i in range(len(texts)) if top(i) == i}
    assert len(got) < simhash.one_of_each(docs).count()
