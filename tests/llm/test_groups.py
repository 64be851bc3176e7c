import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

from geoquarry.llm import components, decontaminate, keys, license_scan, line_dedup, mix, simhash, suite
from geoquarry.llm.batches import gram_hashes, word_hashes

from .conftest import rows_of


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["many", "none"])
def test_components(spark, shape):
    """Random links, a path and a star around the largest node, all apart."""
    chance = random.Random(7)
    links = {
        "many": [
            *((chance.randrange(120) - 60, chance.randrange(120) - 60) for _ in range(70)),
            *((200 + k, 201 + k) for k in chance.sample(range(24), 24)),
            *((399, 300 + k) for k in range(50)),
        ],
        "none": [],
    }[shape]
    rows = [*links, *links[:5], (None, 3), (4, None)]
    found = rows_of(components.components(spark.createDataFrame(rows, "a long, b long")))
    nodes = {n for link in links for n in link}
    assert sorted(found) == sorted(roots(nodes, links).items())


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(
    "text", ["", " \n", "One", "Two words", "Ä B\tc ÄÖ", "a b c d", "x y z x y z x y z q", "é\x85w v\x1cu t"]
)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_masks_cover_all_differences():
    chance = random.Random(1)
    for bits in (list(range(64)), sorted(chance.sample(range(64), 30)), [3, 9, 40, 41]):
        masks = simhash.covering_masks(bits)
        for _ in range(3000):
            apart = chance.sample(bits, chance.randint(1, min(3, len(bits))))
            changed = sum(1 << b for b in apart)
            assert any(not m & changed for m in masks)


@pytest.mark.parametrize("bucket", [25, 8192])
def test_links_join_what_all_pairs_would(spark, bucket):
    """A dense cloud of fingerprints, with buckets split again or compared at once."""
    chance = random.Random(5)
    centres = [chance.getrandbits(64) for _ in range(6)]
    values = {0, *centres}
    for c in centres[:3]:
        values |= {c ^ sum(1 << b for b in chance.sample(range(14), chance.randint(1, 4))) for _ in range(40)}
    values = sorted(values)
    near = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]
    signed = {v: simhash._signed(v) for v in values}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    links = rows_of(simhash.covering_links(df, bucket=bucket))
    assert roots(signed.values(), links) == roots(
        signed.values(), [(signed[a], signed[b]) for a, b in near]
    )
    assert len(links) <= 16 * 15 * len(values)


def test_groups_of_documents(spark, sf):
    found = suite.op8_simhash_dedup(spark, sf).toPandas()
    texts = dict(pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id", "text"]).values)
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    ids = sorted(prints)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    expected = roots(ids, near)
    assert dict(zip(found.doc_id, found.component_id, strict=True)) == expected
    assert all(prints[d] == int(f, 16) for d, f in zip(found.doc_id, found.fingerprint, strict=True))
    assert len(set(expected.values())) < len(ids)


def test_groups_with_nulls_and_repeats(make):
    rows = [(5, "a b c d"), (3, "A b c d"), (3, "A b c d"), (None, "a b c d"), (9, None), (None, ""), (8, " "), (None, "only null here now")]
    found = rows_of(simhash.near_groups(make(rows)).select("doc_id", "component_id"))
    expected = [(5, 3), (3, 3), (3, 3), (None, 3), (9, 8), (None, 8), (8, 8), (None, None)]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_one_of_each_group_stays(make):
    rows = [
        (5, "a b c d", 1), (3, "A b c d", 2), (3, "A b c d", 2), (3, "a B c d", 3), (None, "a b c d", 4),
        (9, None, 5), (8, " ", None), (7, "something else is here", 7), (7, "and here is another one", 8),
    ]
    docs = make(rows, "doc_id long, text string, fp int")
    found = rows_of(simhash.keep_one(docs))
    assert len(found) == 5
    assert {r[0] for r in found} == {3, None, 8, 7}
    assert len([r for r in found if r[0] == 7]) == 2
    assert simhash.keep_one(docs).columns == docs.columns


def plain_local(part, passage):
    table = np.zeros((len(part) + 1, len(passage) + 1), int)
    for i, a in enumerate(part, 1):
        for j, b in enumerate(passage, 1):
            table[i, j] = max(
                0,
                table[i - 1, j - 1] + (2 if a == b else -1),
                table[i - 1, j] - 1,
                table[i, j - 1] - 1,
            )
    return table.max()


def test_alignment_scores():
    chance = np.random.default_rng(2)
    parts, passages = [], []
    for _ in range(60):
        part = chance.integers(1, 9, chance.integers(1, 14)).astype(np.uint64)
        passage = chance.integers(1, 9, chance.integers(1, 25)).astype(np.uint64)
        if chance.random() < 0.5:
            passage = np.concatenate((passage, np.delete(part, len(part) // 2), passage[:3]))
        parts.append(part)
        passages.append(passage)
    found = decontaminate.align(parts, passages)
    for part, passage, (score, first, last) in zip(parts, passages, found.tolist(), strict=True):
        assert score == plain_local(part.tolist(), passage.tolist())
        if score:
            assert plain_local(part.tolist(), passage[first:last].tolist()) == score


def filler(chance, n):
    return " ".join("".join(chance.choices("abcdefgh", k=4)) for _ in range(n))


def test_edited_copies_are_found(spark, make):
    chance = random.Random(4)
    items = [(k, filler(chance, 30 if k else 700)) for k in range(8)] + [(20, "ab cd"), (21, None), (None, "x")]
    rows, expected = [], set()
    for k, text in items[:8]:
        words = text.split()
        rows.append((10 + k, f"{filler(chance, 90)} {text.upper()}, {filler(chance, 50)}"))
        for j in range(0, len(words), 7):
            words[j] = "edited"
        rows.append((30 + k, f"{filler(chance, 60)} {' '.join(words)} {filler(chance, 40)}"))
        expected |= {(10 + k, k), (30 + k, k)}
        rows.append((50 + k, filler(chance, 20) + " " + " ".join(words[:6]) + " " + filler(chance, 20)))
    rows += [(90, None), (91, ""), (None, items[3][1]), (99, items[2][1]), (99, items[2][1])]
    expected |= {(None, 3), (99, 2)}
    documents, tests = make(rows), spark.createDataFrame(items, "item_id long, text string")
    leaks = decontaminate.find_leaks(documents, tests)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.collect()} == expected
    assert leaks.count() == len(expected)
    whole = [r for r in leaks.collect() if r["doc_id"] == 11]
    assert whole[0]["share"] == 1.0
    text = dict(rows)[11].lower()
    assert text[whole[0]["start"] : whole[0]["end"]] == items[1][1]
    kept = decontaminate.keep_clean(documents, tests)
    assert {r[0] for r in rows_of(kept)} == {50 + k for k in range(8)} | {90, 91}


@pytest.mark.parametrize("intact_too", [False, True])
def test_copies_with_many_edits_are_found(spark, make, intact_too):
    """Edits at every 4th to 6th word and at random, held against alignments of whole documents."""
    chance = random.Random(11)
    items = [(k, filler(chance, n)) for k, n in enumerate((15, 22, 31, 40))]
    rows = []
    for _, text in items:
        for step in (4, 5, 6):
            for first in range(step):
                words = text.split()
                words[first::step] = ["edited"] * len(words[first::step])
                rows.append(" ".join(words))
        for _ in range(12):
            words = []
            for w in text.split():
                edit = chance.choice("swdi") if chance.random() < 0.25 else ""
                words += {"s": ["other"], "w": [w], "d": [], "i": [*["put", "in"] * chance.randint(1, 2), w]}.get(edit, [w])
            rows.append(" ".join(words))
        rows.append(" ".join(w for k, v in enumerate(text.split()) for w in ([v] if k < 3 or k % 2 else ["put", v])))
    rows = [(k, f"{filler(chance, 9)} {r} {filler(chance, 9)}") for k, r in enumerate(rows)]
    if intact_too:
        rows += [(1000 + k, text) for k, text in items]
    expected = set()
    for doc, text in rows:
        words = text.split()
        grams = set(zip(words, words[1:], words[2:]))
        for item, wanted in items:
            part = wanted.split()
            if grams & set(zip(part, part[1:], part[2:])) and plain_local(part, words) >= 0.6 * 2 * len(part):
                expected.add((doc, item))
    found = decontaminate.find_leaks(make(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == expected
    assert 100 < len(expected) < len(rows)


def test_blocks_of_items_change_nothing(spark, make, monkeypatch):
    chance = random.Random(9)
    items = spark.createDataFrame([(k, filler(chance, 25)) for k in range(12)], "item_id long, text string")
    rows = [(r["item_id"], f"{filler(chance, 30)} {r['text']} {filler(chance, 5)}") for r in items.collect()]
    once = sorted(rows_of(decontaminate.find_leaks(make(rows), items)))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    assert sorted(rows_of(decontaminate.find_leaks(make(rows), items))) == once
    assert len(once) == 12


def test_given_leaks(spark, sf):
    docs, items = (pd.read_parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = {
        (d, i)
        for d, text in zip(docs.doc_id, docs.text, strict=True)
        for i, item in zip(items.item_id, items.text, strict=True)
        if item in text
    }
    found = {(r["doc_id"], r["item_id"]) for r in suite.op1_decontaminate(spark, sf).collect()}
    assert expected
    assert expected <= found
    assert len(found - expected) <= 2


def plain_licenses(text, templates):
    """Best containment over all stretches of twice a template's length."""
    import pyarrow as pa

    def grams(value):
        words, _, _, rows = word_hashes(pa.array([value]))
        found, whole = gram_hashes(words, rows, 5)
        return found[whole]

    own = grams(text or "")
    found = {}
    for name, template in templates.items():
        wanted = set(grams(template).tolist())
        reach = 2 * (len(wanted) + 4)
        best = max(
            (len(wanted & set(own[k : k + reach].tolist())) / len(wanted) for k in range(len(own))), default=0
        )
        if best >= 0.8:
            found[name] = best
    return found


def test_licenses(make):
    chance = random.Random(6)
    templates = license_scan.TEMPLATES
    rows = [(k, f"{filler(chance, 40 + 9 * k)}\n{t}\n{filler(chance, 30)}") for k, t in enumerate(templates.values())]
    worn = templates["MIT-text"].replace("publish", "print").replace("copies", "issues")
    rows += [(100, filler(chance, 200)), (101, None), (102, ""), (None, templates["MIT"]), (103, worn), (104, "Released under the")]
    found = rows_of(license_scan.scan_licenses(make(rows)))
    by_doc = {}
    for doc, name, share, start, end in found:
        by_doc.setdefault(doc, {})[name] = (share, start, end)
    names = list(templates)
    for doc, text in rows:
        plain = plain_licenses(text, templates)
        mine = by_doc.get(doc, {})
        assert set(mine) <= set(plain)
        assert bool(mine) == bool(plain)
        if doc is not None and doc < len(names):
            assert mine[names[doc]][0] == 1.0
            inside = text.lower()[mine[names[doc]][1] : mine[names[doc]][2]]
            assert templates[names[doc]].lower().rstrip(".:").endswith(inside[-20:])
    assert set(by_doc[103]) == {"MIT-text"}
    assert license_scan.band_odds() > 0.9999


def test_every_place_of_a_license(make):
    chance = random.Random(8)
    templates = license_scan.TEMPLATES
    header, short, mit, text = (templates[n] for n in ("Apache-2.0-header", "Apache-2.0", "MIT", "MIT-text"))
    edited = header.replace("governing", "ruling").replace("compliance", "accordance")
    gap = filler(chance, 60)
    half = text.split(" including ")
    rows = [
        (0, f"{gap} {edited} {gap}"),
        (1, f"{mit} {gap} {mit}"),
        (2, f"{mit} {mit}\n{mit}"),
        (3, f"{edited}\n{gap}\n{short}"),
        (4, f"{short} {gap} {edited}"),
        (5, f"{gap} including {half[1]} {half[0]} {gap}"),
        (6, f"{edited} {header}"),
        (7, f"{mit} {header} {mit}"),
    ]
    found = {}
    for doc, name, share, start, end in sorted(rows_of(license_scan.scan_licenses(make(rows))), key=lambda r: (r[0], r[3])):
        assert 0.8 <= share <= 1.0 and start < end
        found.setdefault(doc, []).append(name)
    assert found == {
        0: ["Apache-2.0-header"],
        1: ["MIT", "MIT"],
        2: ["MIT", "MIT", "MIT"],
        3: ["Apache-2.0-header", "Apache-2.0"],
        4: ["Apache-2.0", "Apache-2.0-header"],
        5: ["MIT-text"],
        6: ["Apache-2.0-header", "Apache-2.0-header"],
        7: ["MIT", "Apache-2.0-header", "MIT"],
    }


def test_template_that_repeats_itself(make):
    template = "one two three four five six one two three four five seven eight nine"
    rows = [(1, f"a b c {template} d e f {template}"), (2, "one two three four five " * 3)]
    found = rows_of(license_scan.scan_licenses(make(rows), {"own": template}))
    assert [(r[0], r[1], r[2]) for r in found] == [(1, "own", 1.0), (1, "own", 1.0)]


def test_given_licenses(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    found = suite.op2_license_scan(spark, sf).toPandas()
    for name in ("MIT", "GPL-3.0", "Apache-2.0", "CC-BY-NC-4.0"):
        holders = set(docs.doc_id[docs.text.str.contains(license_scan.TEMPLATES[name], regex=False)])
        assert set(found.doc_id[found.license == name]) == holders


def plain_runs(rows, least):
    """Lines within a run of whole lines with enough words that occurred earlier, by definition."""
    unique = sorted({(d is None, d or 0, key, text or "") for d, key, text in rows})
    lines = [[ln.strip() for ln in u[3].split("\n") if ln.strip()] for u in unique]
    gone = [set() for _ in unique]
    for b, own in enumerate(lines):
        for end in range(len(own) + 1):
            for start in range(end):
                if sum(len(ln.split()) for ln in own[start:end]) < least:
                    continue
                size = end - start
                if any(
                    lines[a][k : k + size] == own[start:end] and (a, k) < (b, start)
                    for a in range(b + 1)
                    for k in range(len(lines[a]) - size + 1)
                ):
                    gone[b] |= set(range(start, end))
    return {u: g for u, g in zip(unique, gone, strict=True)}


@pytest.mark.parametrize("seed", range(2))
def test_repeated_runs(make, seed):
    chance = random.Random(seed)
    pool = [filler(chance, chance.randint(1, 5)) for _ in range(6)]
    rows = [
        (chance.choice([*range(12), None]), "\n".join(chance.choices([*pool, "", " x "], k=chance.randint(0, 9))))
        for _ in range(30)
    ]
    rows += rows[:3] + [(4, None)]
    docs = make(rows, "doc_id long, text string").selectExpr("*", "'c' AS n_removed", "1 AS runs")
    keyed = docs.selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS key", "text")
    expected = plain_runs(rows_of(keyed), 8)
    found = rows_of(line_dedup.remove_runs(docs, 8).selectExpr("doc_id", "text", "n_lines", "n_removed"))
    wanted = []
    for doc, key, text in rows_of(keyed):
        gone = expected[doc is None, doc or 0, key, text or ""]
        real, kept = -1, []
        for line in (text or "").split("\n"):
            real += bool(line.strip())
            if not line.strip() or real not in gone:
                kept.append(line)
        wanted.append((doc, "\n".join(kept) if gone else text, real + 1, len(gone)))
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert any(w[3] for w in wanted)


def plain_targets(sizes, share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, target, full = share * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: most * sizes[s] for s in full}
        target |= {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = {s for s in open_ if target[s] > most * sizes[s] + 1e-9}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    chance = random.Random(seed)
    sizes = {f"s{chance.randrange(1000)}": chance.choice([0, 1, 10, 100, 5000, 90000]) for _ in range(9)}
    sizes[None] = 40
    sizes["é"], sizes["Z"] = 70, 3
    found = mix.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    expected = plain_targets(sizes)
    for row in found.collect():
        assert row["target"] == pytest.approx(expected[row["source"]], abs=1e-6)


def test_mix(spark, sf, make, tmp_path):
    found = suite.op10_mix_sources(spark, "/root/testdata/sf0.01").toPandas()
    assert (found.taken <= 2 * found["size"]).all()
    by_source = found.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert abs(by_source.taken.sum() / by_source.target.sum() - 1) < 0.05
    again = suite.op10_mix_sources(spark, "/root/testdata/sf0.01").toPandas()
    assert found.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    rows = [(1, "a b\x85c\td", "x", 0), (1, "a b", "x", 1), (2, None, None, 2), (None, "q", None, 3), (None, None, "y", 4)] * 2
    docs = make(rows, "doc_id long, text string, source string, size long")
    plan = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in mix.plan_mix(docs).collect()}
    assert mix.plan_mix(docs).count() == 10
    mixed = mix.mix(docs)
    assert mixed.columns == docs.columns
    counts = {}
    for doc, text, source, _ in rows_of(mixed):
        counts[doc, source, len((text or "").split(" "))] = 1
    assert mixed.count() == 2 * sum(plan.values())


@pytest.mark.parametrize("largest", [1 << 26, 64])
def test_filter_parts_rows_without_a_partner(spark, monkeypatch, largest):
    """No row with a partner is parted from it, and a full filter only keeps more rows."""
    monkeypatch.setattr(keys, "LARGEST", largest)
    rows = spark.createDataFrame([(k, f"f{k}") for k in range(3000)] + [(None, "n")], "k long, f string")
    hashes = spark.range(0, 3000, 7).select(F.xxhash64("id").alias("hash"))
    apart, near = keys.parted(rows, F.xxhash64("d.k"), hashes)
    assert apart.columns == near.columns == rows.columns
    far, close = ([r["k"] for r in x.collect()] for x in (apart, near))
    assert len(far) + len(close) == 3001
    assert set(range(0, 3000, 7)) <= set(close)
    assert len(close) < 700 if largest > 64 else len(close) > 700


def test_common_openings_stay_whole_and_bounded(make):
    """Many items with one opening: its places are passages of all, and leaks are those of plain alignment."""
    chance = random.Random(12)
    opening = "which of the following"
    items = [(k, f"{opening} {filler(chance, 12)}") for k in range(300)]
    busy = " ".join(f"{opening} {filler(chance, 25)}" for _ in range(40))
    worn = items[7][1].split()
    worn[6], worn[11] = "other", "words"
    rows = [(1, busy), (2, f"{busy} {items[5][1]} {busy}"), (3, " ".join(worn)), (4, f"{items[9][1]} {items[9][1]}")]
    found = rows_of(decontaminate.find_leaks(make(rows), make(items, "item_id long, text string")))
    assert {(r[0], r[2]) for r in found} == {(2, 5), (3, 7), (4, 9)}
    assert {r[0]: r[3] for r in found}[2] == 1.0
    hashes = {k: word_hashes(pa.array([t]))[0] for k, t in [*rows, (-5, items[5][1])]}
    score, first, last = decontaminate.align([hashes[-5]], [hashes[2]])[0]
    assert score == 2 * len(hashes[-5]) and last - first == len(hashes[-5])
