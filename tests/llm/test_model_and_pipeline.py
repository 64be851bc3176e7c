import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from geoquarry.llm import (
    decontaminate,
    filter_audit,
    lexical,
    license_scan,
    line_dedup,
    mix,
    patricia,
    quality_model,
    quality_rules,
    secret_scan,
    simhash,
    suite,
    token_codes,
    token_counts,
)

from .conftest import rows_of
from .test_groups import plain_fingerprint, roots

ORDER = 3


def plain_model(texts, order=ORDER):
    """Interpolated modified Kneser-Ney by its formulas, with dictionaries."""
    pad = chr(quality_model.PAD)
    counts = {order: Counter()}
    for text in texts:
        padded = pad * (order - 1) + text
        counts[order].update(padded[k : k + order] for k in range(len(text)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    vocabulary = len(counts[1]) + 1
    cuts = {}
    for n, table in counts.items():
        of = Counter(table.values())
        n1, n2, n3, n4 = (of[k] for k in (1, 2, 3, 4))
        if min(n1, n2, n3):
            y = n1 / (n1 + 2 * n2)
            raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
            cuts[n] = [min(max(d, 0.1), k + 0.9) for k, d in enumerate(raw)]
        else:
            cuts[n] = [0.5, 1.0, 1.5]
    totals = {n: defaultdict(int) for n in counts}
    left = {n: defaultdict(float) for n in counts}
    for n, table in counts.items():
        for gram, c in table.items():
            totals[n][gram[:-1]] += c
            left[n][gram[:-1]] += cuts[n][min(c, 3) - 1]

    def p(context, char, n):
        if n == 0:
            return 1 / vocabulary
        context = context[len(context) - n + 1 :]
        lower = p(context, char, n - 1)
        total = totals[n].get(context)
        if not total:
            return lower
        c = counts[n].get(context + char, 0)
        own = c - cuts[n][min(c, 3) - 1] if c else 0
        return (own + left[n][context] * lower) / total

    return lambda context, char: p(context, char, order)


TRUSTED = ["the cat sat on the mat. " * 3, "a dog ran after the cat, and the cat ran.", "ein Hund läuft über die Straße. é", "aaa bbb"]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(t,) for t in TRUSTED], "text string")
    return quality_model.train(quality_model.count_grams(docs, ORDER), ORDER)


def test_perplexity_is_that_of_the_formulas(spark, model, make):
    p = plain_model(TRUSTED)
    pad = chr(quality_model.PAD)
    texts = [*TRUSTED, "the dog sat", "zzz ☃ unseen ☃", "x", ""]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(99, None, None)]
    found = quality_model.score(make(rows, "doc_id long, text string, lang string"), model, ORDER)
    for row in found.collect():
        text = texts[row["doc_id"]] if row["doc_id"] < 99 else ""
        assert row["n_chars"] == len(text)
        if not text:
            assert row["perplexity"] is None
            continue
        padded = pad * (ORDER - 1) + text
        logs = [math.log(p(padded[k : k + ORDER - 1], padded[k + ORDER - 1])) for k in range(len(text))]
        assert row["perplexity"] == pytest.approx(math.exp(-np.mean(logs)), rel=1e-4)


def test_probabilities_of_a_context_add_up():
    p = plain_model(TRUSTED)
    chars = sorted({c for t in TRUSTED for c in t})
    for context in ("th", "at", "zz"):
        assert sum(p(context, c) for c in chars) + p(context, "☃") == pytest.approx(1.0)


def test_shards_change_nothing(model, make, monkeypatch):
    rows = [(k, t, "en") for k, t in enumerate([*TRUSTED, "the ☃ dog", "☃☃", ""])] + [(0, TRUSTED[0], "en"), (None, None, None)]
    docs = make(rows, "doc_id long, text string, lang string")
    once = sorted(rows_of(quality_model.score(docs, model, ORDER)), key=str)
    monkeypatch.setattr(quality_model, "SHARD_ROWS", 150)
    again = sorted(rows_of(quality_model.score(docs, model, ORDER)), key=str)
    assert len(once) == len(again) == len(rows)
    for a, b in zip(once, again, strict=True):
        assert a[:3] == b[:3]
        assert a[3] == b[3] or a[3] == pytest.approx(b[3])


LARGER = "/root/testdata/sf0.01"


def test_classifier_on_labels(spark):
    sf = LARGER
    found = suite.op7_quality_classifier(spark, sf).toPandas()
    assert len(found) == len(pd.read_parquet(f"{sf}/documents.parquet"))
    labels = pd.read_parquet(f"{sf}/labels.parquet").merge(found, on="doc_id")
    assert labels[labels.quality == 1].kept.mean() > 0.95
    assert labels[labels.quality == 0].kept.mean() < 0.25


def test_held_out_documents(spark):
    """The model is fitted without every third labelled document and judged on these."""
    sf = LARGER
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_model.classify(docs, labels.where("doc_id % 3 != 0")).toPandas()
    held = pd.read_parquet(f"{sf}/labels.parquet").query("doc_id % 3 == 0").merge(found, on="doc_id")
    assert ((held.quality == 1) == held.kept).mean() > 0.9


def test_classifier_without_trusted_text(spark, make):
    docs = make([(1, "some text", "en"), (2, None, None), (None, "x", "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: (r["kept"], r["low"]) for r in quality_model.classify(docs, labels).collect()}
    assert found == {1: (True, None), 2: (False, None), None: (True, None)}


# --- all operators: empty tables, nulls everywhere, columns of clashing names ---------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, n_words int, copies string, spans int, kept string, gone_id string, gone_key int, run_id int, run_key string, run_spans string, row int"
ITEMS = "item_id long, text string, doc_id string, key int"
LABELS = "doc_id long, quality int, toxic int, lang string, kept int"

OPERATORS = {
    "leaks": lambda d, i, la: decontaminate.find_leaks(d, i),
    "without_leaks": lambda d, i, la: decontaminate.keep_clean(d, i),
    "licenses": lambda d, i, la: license_scan.scan_licenses(d),
    "secrets": lambda d, i, la: secret_scan.scan_secrets(d),
    "codes": lambda d, i, la: token_codes.read_tokens(token_codes.write_tokens(d, "byte_bpe_50k.json")),
    "counts": lambda d, i, la: token_counts.count_tokens(d, "word_bpe_49k.json"),
    "lines": lambda d, i, la: quality_rules.clean_lines(d),
    "clean": lambda d, i, la: quality_rules.keep_clean(d),
    "perplexity": lambda d, i, la: quality_model.classify(d, la),
    "groups": lambda d, i, la: simhash.near_groups(d),
    "one_each": lambda d, i, la: simhash.keep_one(d),
    "runs": lambda d, i, la: line_dedup.remove_runs(d),
    "plan": lambda d, i, la: mix.plan_mix(d),
    "mix": lambda d, i, la: mix.mix(d),
    "audit": lambda d, i, la: filter_audit.audit(d, la),
    "flags": lambda d, i, la: filter_audit.document_flags(d),
    "exact": lambda d, i, la: patricia.exact_groups(d),
    "ranked": lambda d, i, la: lexical.rank_documents(d, i),
}
ROW_EACH = {"secrets", "codes", "counts", "lines", "perplexity", "groups", "runs", "plan", "exact", "flags"}
COLUMNS_OF_DOCS = {"without_leaks", "clean", "one_each", "mix"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(spark, make, name):
    empty = [make([], s) for s in (DOCS, ITEMS, LABELS)]
    assert rows_of(OPERATORS[name](*empty)) == []


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nulls_repeats_and_clashing_columns(make, name):
    long = "One sentence follows the next. " * 4000
    some = [
        (1, "A text of some words in a line.", "en", "s", 3, "k", "f", 1, "c", 2, "t", "g", 4, 5, "r", "s", 6),
        (2, "", "de", *[None] * 14),
        (3, long, None, "s", 1, "k", "f", 1, "c", 2, "t", "g", 4, 5, "r", "s", 6),
    ]
    none = [None] * 17
    rows = [*some, some[0], tuple(none), (None, some[0][1], *none[2:]), (4, *none[1:]), tuple(none)]
    docs = make(rows, DOCS)
    items = make([(1, "nothing like this is in there", "x", 1), (None, None, None, None), (2, "", None, None)], ITEMS)
    labels = make([(1, 1, 0, "x", 1), (None, None, None, None, None), (3, None, None, None, None), (1, 1, None, None, 1)], LABELS)
    found = OPERATORS[name](docs, items, labels)
    out = rows_of(found)
    if name in ROW_EACH:
        assert len(out) == len(rows)
    if name in COLUMNS_OF_DOCS:
        assert found.columns == docs.columns


@pytest.mark.parametrize("name", sorted(suite.ORACLES))
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = suite.QUERIES[name](spark, sf)
    expected = con.execute(suite.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    order = sorted(found.columns)
    a = found.toPandas()[order].sort_values(order, ignore_index=True)
    b = expected[order].sort_values(order, ignore_index=True)
    for c in order:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c])
        else:
            assert a[c].tolist() == b[c].tolist()


# --- the pipeline -----------------------------------------------------------------------------


def test_pipeline_stages_do_what_brute_force_does(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], sf).write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
    before, clean, single, apart, mixed = (f.toPandas() for f in frames[:5])
    for frame in (clean, single, apart, mixed):
        assert list(frame.columns) == docs.columns

    judged = {d: quality_rules.judge(t) for d, t in zip(before.doc_id, before.text, strict=True)}
    assert dict(zip(clean.doc_id, clean.text, strict=True)) == {d: j[0] for d, j in judged.items() if j[-1]}

    prints = {d: plain_fingerprint(t) for d, t in zip(clean.doc_id, clean.text, strict=True)}
    ids = sorted(prints)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert set(single.doc_id) == set(roots(ids, near).values())
    assert len(single) < len(clean)

    items = pd.read_parquet(f"{sf}/benchmark.parquet").text
    held = {d for d, t in zip(single.doc_id, single.text, strict=True) if any(i in t for i in items)}
    assert held
    assert set(apart.doc_id) <= set(single.doc_id) - held
    assert len(single) - len(apart) <= len(held) + 2

    plan = {r["doc_id"]: r["copies"] for r in mix.plan_mix(frames[3]).collect()}
    assert Counter(mixed.doc_id) == Counter({d: n for d, n in plan.items() if n})

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    expected = []
    for doc, text in sorted(zip(mixed.doc_id, mixed.text, strict=True)):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(rows_of(frames[5]), key=lambda r: r[1]) == expected


def test_run_is_the_stages(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    last = found.orderBy(F.desc("start")).first()
    assert found.agg(F.sum("n_tokens")).first()[0] == last["start"] + last["n_tokens"]
