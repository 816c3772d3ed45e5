"""Pages that share a frame: many in one bucket, few or none of them similar enough."""

import random

from lexspark.llm import near_dedup


def _pages(n, own, rnd):
    frame = [f"f{i}" for i in range(100)]
    texts = {i: " ".join(frame + [f"p{i}x{k}" for k in range(own)]) for i in range(n)}
    for i in range(0, n, 40):  # and a near copy of some, with one word of their own changed
        w = texts[i].split()
        w[100 + rnd.randrange(own)] = "changed"
        texts[n + i] = " ".join(w)
    return texts


def test_frames_are_not_linked_but_their_near_copies_are(spark):
    texts = _pages(400, 20, random.Random(1))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, k=2).collect()}
    assert got == {i: i - 400 if i >= 400 else i for i in texts}


def test_several_texts_of_one_document(spark):
    texts = list(_pages(60, 20, random.Random(2)).items())
    texts += [(d, t + " more") for d, t in texts[::5]]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, k=2).collect()}
    assert got == {i: i - 60 if i >= 60 else i for i, _ in texts}
