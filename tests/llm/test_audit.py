import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from geoquarry.llm import filter_audit

from .conftest import rows_of


def plain_audit(docs, labels):
    least = {}
    for doc, text, _ in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for doc, text, lang in docs:
        text = text or ""
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc is not None and doc > least[text],
        }
        parts.setdefault(lang or "", []).append((doc, {f for f, v in fails.items() if v}))
    out = []
    for part, found in parts.items():
        orders = ["".join(o) for o in permutations("ABCDE")]
        shares = dict.fromkeys("ABCDE", 0)
        for order in orders:
            for _, fails in found:
                if fails:
                    shares[min(fails, key=order.index)] += 1
        for order in orders:
            for step, f in enumerate(order, 1):
                lost = [d for d, fails in found if f in fails and not fails & set(order[: step - 1])]
                out.append(
                    (
                        part, order, step,
                        sum(not fails & set(order[:step]) for _, fails in found),
                        len(lost),
                        sum(f in fails and bool(fails & set(order[: step - 1])) for _, fails in found),
                        sum(fails == {f} for _, fails in found),
                        sum(d in good for d in lost),
                        sum(d in bad for d in lost),
                        shares[f],
                    )
                )
    return out


def rows():
    chance = random.Random(6)
    docs = []
    for k in range(160):
        words = [chance.choice("abcdefghij") + str(chance.randint(0, chance.choice([9, 90]))) for _ in range(chance.choice([30, 199, 200, 260]))]
        text = chance.choice([" ", "\n", "\x0b ", "\t"]).join(words)
        text = text.title() if chance.random() < 0.3 else text
        text += chance.choice(["", "", " #", "|", "É\x85x"])
        docs.append((k, text, chance.choice(["en", "de", None, ""])))
    docs += [(k + 500, docs[k % 7][1], "en") for k in range(60)] + [docs[3], docs[3], (3, docs[4][1], "fr")]
    docs += [(None, docs[9][1], "en"), (None, None, None), (900, None, "fr"), (901, "", "fr"), (902, "A" * 9, "x"), (903, " \n", "x")]
    labels = [(k, chance.choice([0, 1, None]), chance.choice([0, 1, None])) for k in range(0, 600, 2)]
    labels += [labels[0], (4, 1, 1), (4, 0, 0), (None, 1, 1)]
    chance.shuffle(docs)
    return docs, labels


@pytest.mark.parametrize("shard", [2048, 9])
def test_audit_equals_brute_force(spark, make, monkeypatch, shard):
    monkeypatch.setattr(filter_audit, "SHARD_DOCS", shard)
    docs, labels = rows()
    found = filter_audit.audit(
        make(docs, "doc_id long, text string, lang string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )
    assert sorted(rows_of(found)) == sorted(plain_audit(docs, labels))


def test_matrix_has_one_code_a_word(make, monkeypatch):
    """Shards of different tasks give a word the same code, and no other word has it."""
    monkeypatch.setattr(filter_audit, "SHARD_DOCS", 7)
    chance = random.Random(1)
    rows = [(k, " ".join(f"w{chance.randint(0, 60)}" for _ in range(k % 40)), "x") for k in range(90)]
    docs = make(rows, "doc_id long, text string, part string").repartition(4)
    texts, codes, cells = {k: t for k, t, _ in rows}, {}, {}
    for r in filter_audit.matrix(docs).collect():
        indptr, counts = (np.frombuffer(r[c], "<i4") for c in ("indptr", "counts"))
        columns = np.frombuffer(r["columns"], "<i8")
        for k, doc in enumerate(r["doc_ids"]):
            for c, n in zip(columns[indptr[k] : indptr[k + 1]].tolist(), counts[indptr[k] : indptr[k + 1]].tolist()):
                cells[doc, c] = n
    for doc, text in texts.items():
        words = Counter(text.split())
        mine = {c: n for (d, c), n in cells.items() if d == doc}
        assert sorted(mine.values()) == sorted(words.values())
        for c in mine:
            codes[c] = codes.get(c, set(words)) & set(words)
    assert len(codes) == len({w for t in texts.values() for w in t.split()})
    assert all(codes.values())


def test_matrix_counts_words(make):
    docs = make([(1, "a b a", "x"), (2, "b c", "x"), (3, None, "x")], "doc_id long, text string, lang string")
    found = rows_of(filter_audit.document_flags(docs).select("doc_id", "n_words", "n_distinct"))
    assert sorted(found) == [(1, 3, 2), (2, 2, 2), (3, 0, 0)]
