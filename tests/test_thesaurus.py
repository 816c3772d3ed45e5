"""Aliases in many queries, against contains()."""

import random

import pytest

from lexspark.operators import thesaurus


def _plain(queries, aliases):
    kinds = {k: i for i, k in enumerate(thesaurus.KINDS, 1)}
    out = []
    for q, t in queries:
        found = {}
        for c, key, norm, _, _, _ in aliases:
            if t and norm and (norm == t or len(norm) >= 3 and norm in t):
                found[c] = max(found.get(c, (0, key))[0], 2 if norm == t else 1), key
        top = sorted(found, key=lambda c: (-found[c][0], found[c][1], c))[:5]
        rows = []
        for c in sorted(top):
            own = sorted((kinds.get(kind, 5), lang, norm, raw) for a, _, norm, raw, kind, lang in aliases if a == c and norm != t)[:8]
            rows += [(q, c, raw, norm, i) for i, (_, _, norm, raw) in enumerate(own, 1)]
        out += rows[:12]
    return sorted(out)


@pytest.mark.parametrize("most", [thesaurus.BLOCK, 3])
def test_terms_of_all_queries(spark, monkeypatch, most):
    monkeypatch.setattr(thesaurus.named, "__defaults__", ("normalized", most))
    rnd = random.Random(3)
    words = ["ab", "abc", "bcd", "abcd", "x", "data", "protection", "dataprotection", "right", "日本法"]
    aliases = [(c, f"k{c % 4}", "".join(rnd.sample(words, rnd.randint(1, 2))), f"raw {c} {i}", rnd.choice((*thesaurus.KINDS, "other", None)), f"l{i}") for c in range(9) for i in range(11)]
    aliases = list({(a[0], a[2], a[4], a[5]): a for a in aliases}.values()) + [(20, "k0", "", "empty", "preferred", "en")]
    queries = [(i, "".join(rnd.choices(words, k=rnd.randint(0, 5)))) for i in range(60)] + [(100, None), (101, ""), (102, "ab"), (103, "x")]
    df = spark.createDataFrame(queries, "query_id long, normalized string").repartition(3)
    names = spark.createDataFrame(aliases, "concept_id long, stable_key string, normalized string, raw string, kind string, language string")
    assert sorted(map(tuple, thesaurus.alias_terms(df, names).collect())) == _plain(queries, aliases)


def test_empty(spark):
    names = spark.createDataFrame([], "concept_id long, stable_key string, normalized string, raw string, kind string, language string")
    assert thesaurus.alias_terms(spark.createDataFrame([(1, "abc")], "query_id long, normalized string"), names).collect() == []
