import hashlib
import random

import pytest

from geoquarry.llm import patricia

from .conftest import rows_of


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()


def plain_groups(rows, largest):
    groups = {}
    for doc, text in rows:
        groups.setdefault(lowered(text), []).append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        first = True
        for doc in ids:
            out.append((doc, keep, len(ids), doc == keep and first, hashlib.sha256(text).hexdigest()))
            first = first and doc != keep
    return out


@pytest.mark.parametrize("limit", [800, 64 << 20])
@pytest.mark.parametrize("largest", [True, False])
def test_trie_holds_all_texts_and_spills_subtrees(largest, limit):
    chance = random.Random(2)
    trie, given, out = patricia.Trie(largest), {}, {}
    for k in range(900):
        text = bytes(chance.choices(b"ab", k=chance.randint(0, 9))) + b"x" * chance.choice([0, 0, 40])
        given.setdefault(text, []).append(k)
        trie.insert(text, [False, k, k, 1, k])
        while trie.size > limit:
            prefix, found = trie.spill()
            for t, owner in found:
                assert t.startswith(prefix)
                out.setdefault(t, []).append(owner)
    for t, owner in trie.walk(trie.root):
        out.setdefault(t, []).append(owner)
    assert set(out) == set(given)
    best = max if largest else min
    for t, owners in out.items():
        assert best(o[1] for o in owners) == best(given[t])
        assert sum(o[3] for o in owners) == len(given[t])
    assert all(len(o) == 1 for o in out.values()) or limit == 800


def rows():
    chance = random.Random(4)
    bases = ["".join(chance.choices("abcdefg éß\n", k=chance.randint(1, 80))) for _ in range(60)]
    found = [(k, chance.choice([str, str.upper, str.title])(chance.choice(bases))) for k in range(500)]
    found += [(k, f"alone {k}") for k in range(500, 600)] + [(k, "Hot text") for k in range(700, 1400)]
    found += [(700, "hot text"), (1399, "HOT TEXT"), (1399, "hot TEXT"), (None, "hot text"), (None, "İ"), (None, "İ"), (3, "i̇")]
    found += [(8, None), (9, ""), (None, None), (10, "long " * 9000), (11, "LONG " * 9000), (12, "long " * 9000 + "é"), (12, "alone 500 ")]
    chance.shuffle(found)
    return found


@pytest.mark.parametrize(("limit", "salts", "largest"), [(64 << 20, 64, True), (64 << 20, 3, False), (1500, 5, True)])
def test_groups_equal_brute_force(make, limit, salts, largest):
    """One copy of a text leaves a task; with small tries subtrees are spilled over several rounds."""
    docs = make(rows()).repartition(5)
    found = patricia.exact_groups(docs, largest, limit, salts)
    assert sorted(rows_of(found), key=str) == sorted(plain_groups(rows(), largest), key=str)


def test_equal_keys_do_not_decide():
    """Texts of one length and hash are told apart by their bytes."""
    some = [(1, "abc"), (2, "abd"), (3, "Abc"), (4, "xyz"), (5, "ab")]
    trie = patricia.Trie(True)
    owners = [trie.insert(lowered(t), [False, d, d, 1, d]) for d, t in some]
    assert [o[4] for o in owners] == [1, 2, 1, 4, 5]
    assert (owners[0][1], owners[0][3]) == (3, 2)
