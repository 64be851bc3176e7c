import math
import random
import re
from collections import Counter

import pytest

from geoquarry.llm import lexical

from .conftest import rows_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranks(docs, items, top):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    found = []
    for item, text in set(items):
        scores = []
        for (doc, held), n in zip(counted, sizes, strict=True):
            score = 0
            for term in terms(text):
                if held[term]:
                    df = sum(term in c for _, c in counted)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    m = 100 - 25 + 25 * n * n_docs // n_terms
                    score += w * (10**9 * held[term] // (1000 * held[term] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        found += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top], 1)]
    return found


def tables():
    chance = random.Random(8)
    words = ["the", "of", "É", "a1", "Zoo", "日本", *(f"w{k}" for k in range(60))]
    odds = [30, 20, 9, 5, 5, 3, *(60 / (k + 1) for k in range(60))]
    docs = [(k, ", ".join(chance.choices(words, odds, k=chance.randint(1, 60)))) for k in range(300)]
    docs += [(k + 1000, docs[0][1]) for k in range(40)] + [docs[3]] * 3
    docs += [(None, docs[5][1]), (None, None), (7, None), (8, ""), (9, " .-"), (2000, "zoo " * 5000)]
    chance.shuffle(docs)
    items = [(k, " ".join(chance.choices(words, odds, k=k + 1))) for k in range(14)]
    items += [items[2], (5, "zoo"), (None, "é É w3"), (20, None), (21, "."), (22, "nothing of this kind")]
    return docs, items


@pytest.mark.parametrize(("shard", "stretch", "short"), [(2048, 512, 8), (50, 16, 3), (64, 64, 1), (90, 7, 10**6)])
def test_ranks_equal_brute_force(spark, make, monkeypatch, shard, stretch, short):
    """Shards, stretches and the border of short lists change nothing; nor do blocks of items."""
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "STRETCH", stretch)
    monkeypatch.setattr(lexical, "SHORT", short)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 2 * shard)
    monkeypatch.setattr("geoquarry.llm.batches.CUT_BYTES", 3000)
    docs, items = tables()
    found = lexical.rank_documents(make(docs).repartition(3), spark.createDataFrame(items, "item_id long, text string"), 6)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(rows_of(found), key=str) == sorted(plain_ranks(docs, items, 6), key=str)


def test_skipping_leaves_documents_out():
    """Once the best are known, a document in frequent lists alone is not looked at."""
    import numpy as np

    n = 4000
    row = {
        "sizes": np.full(n, 50, np.int32), "terms": np.array([0, 1], np.int32),
        "starts": np.array([0, n, n + 400], np.int32),
        "docs": np.concatenate((np.arange(n), np.arange(400))).astype(np.int32),
        "counts": np.ones(n + 400, np.int32), "doc_ids": np.arange(n).astype(object),
    }
    shard = lexical.Shard(row, np.array([10, 4000]), n, 50 * n)
    best, offered = lexical.Best(20), []
    offer = best.offer
    best.offer = lambda ids, scores: (offered.append(len(ids)), offer(ids, scores))
    lexical.search(shard, [(0, 1), (1, 1)], best)
    assert best.ids.tolist() == list(range(20))
    assert offered == [lexical.STRETCH]
