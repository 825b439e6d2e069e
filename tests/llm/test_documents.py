"""Quality rules, near-duplicates, repeated lines and benchmark passages against plain versions."""

import itertools
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from liasse.llm import decontamination, line_dedup, near_dedup, quality_rules  # noqa: E402

VOCABULARY = [a + b + c for a in ("th", "er", "on", "an", "re") for b in ("ing", "ed", "ly", "ou") for c in ("", "st", "nd", "ble")]


def prose(rng, n, per_line=12):
    w = [rng.choice(VOCABULARY) for _ in range(n)]
    return "\n".join(" ".join(w[i:i + per_line]) for i in range(0, n, per_line))


def changed(rng, text, k):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), k):
        w[i] = "Changed" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(25)]
    passage = prose(rng, 70)
    out = list(base)
    out += [changed(rng, base[i % 4], k) for i, k in enumerate([1, 1, 2, 2, 3, 3, 4, 4] * 3)]  # groups, some linked only through others
    out += [base[0]] * 5 + [base[7].upper()]
    out += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(6)]
    out += [None, "", " \t\n", "one two", "One  TWO", "a b c d e", "word " * 5000, "### $$$ %%% " * 40, "\n".join(["same line here of words"] * 30)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, documents):
    return spark.createDataFrame([(i, t, "x", i) for i, t in documents], "doc_id long, text string, bucket string, node long")


def test_quality_figures(docs, documents):
    rows = {r[0]: tuple(r)[1:] for r in quality_rules.quality_figures(docs).collect()}
    assert rows == {i: plain.quality(t) for i, t in documents}


def test_quality_order_does_not_change_what_stays(docs, documents):
    kept = {r.doc_id for r in quality_rules.apply_rules(docs).collect()}
    assert kept == {i for i, t in documents if plain.quality(t)[-1]}
    assert quality_rules.apply_rules(docs).columns == docs.columns
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0
    one = quality_rules.ordered_rules(docs, (quality_rules.EXTRA_RULES[3], quality_rules.SHORT))
    assert {r.name for r in one} == {"word_length", "short"}


def test_near_duplicates(docs, documents):
    rows = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in rows} == plain.components(documents)
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(plain.shingles(t)) for i, t in documents}
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_repeated_and_null_ids(spark):
    text = " ".join(map(str, range(40)))
    rows = [(3, text), (3, text), (None, text + " 40"), (None, "other words"), (5, text + " 41")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 3), (3, 3), (3, 3), (5, 3)]
    kept = near_dedup.kept_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text[:5]) for r in kept) == [(0, "other"), (3, text[:5])]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 500))
    both = near_dedup.registers(np.concatenate([a, b]))
    assert (both == np.maximum(near_dedup.registers(a), near_dedup.registers(b))).all()
    errors = []
    for share in (0.2, 0.5, 0.85, 0.95):
        x = rng.integers(0, 2**63, 1000).astype(np.uint64)
        y = np.concatenate([x[:int(2000 * share / (1 + share))], rng.integers(0, 2**63, 1000 - int(2000 * share / (1 + share))).astype(np.uint64)])
        e = near_dedup.estimate(near_dedup.registers(x)[None], near_dedup.registers(y)[None], np.array([1000]), np.array([1000]))[0]
        errors.append(abs(e - share))
    assert max(errors) < 0.16


def test_large_bucket_in_chunks(spark, monkeypatch):
    rng = random.Random(8)
    base = [str(rng.randrange(10**6)) for _ in range(80)]
    texts = []
    for _ in range(60):
        w = list(base)
        for p in rng.sample(range(80), rng.choice([0, 1, 1, 2, 6])):
            w[p] = str(rng.randrange(10**6))
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    monkeypatch.setattr(near_dedup, "CHUNK", 7)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == plain.components(rows)


def near_misses(n):
    """Texts of 400 words, each with some words of its own, so that any two have 78 to 85 % of their shingles in common."""
    rng = random.Random(11)
    base = [str(rng.randrange(10**6)) for _ in range(400)]
    texts = []
    for i in range(n):
        w = list(base)
        for p in rng.sample(range(400), 8):
            w[p] = f"own{i}x{p}"
        texts.append(" ".join(w))
    return list(enumerate(texts))


def test_near_misses_cost_rows_not_pairs(spark, monkeypatch):
    rows, sizes = near_misses(150), []
    picked = near_dedup._candidates
    def counting(*given):
        found = picked(*given)
        sizes.append(found.count())
        return found
    monkeypatch.setattr(near_dedup, "_candidates", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == plain.components(rows)
    assert sum(sizes) < 150 * near_dedup.bands_for(85)  # of 11,175 pairs
    monkeypatch.setattr(near_dedup, "SLICE_ITEMS", 1000)  # slices of few leaders, members read in parts
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == plain.components(rows)


def test_line_dedup(docs, documents):
    found = {r.row.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    want = plain.without_repeated_lines(documents)
    assert found == {i: want.get(i, (None, 0, 0)) for i, _ in documents}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_hands_workers_only_texts_that_lose_lines(spark, monkeypatch):
    run = "\n".join(f"ligne {i} " + "mot " * 6 for i in range(9))
    rows = [(1, run + "\nfin"), (2, run + "\nautre"), (3, "seul\n"), (4, ""), (5, None), (6, "a\n\nb")]
    seen, inner = spark.sparkContext.accumulator(0), line_dedup._without

    @F.udf("string")
    def counted(text):
        if text is not None:
            seen.add(1)
        return text

    monkeypatch.setattr(line_dedup, "_without", lambda whole, runs: inner(counted(whole), runs))
    found = {r.row.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (run + "\nfin", 10, 0), 2: ("autre", 10, 9), 3: ("seul\n", 2, 0), 4: ("", 1, 0), 5: (None, 0, 0), 6: ("a\n\nb", 3, 0)}
    assert seen.value == 1


def test_line_dedup_runs_of_short_lines(spark):
    rng = random.Random(2)
    run = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(12):
        head = [f"h{rng.randrange(9)}" for _ in range(rng.randrange(6))]
        rows.append((i, "\n".join(head + run[rng.randrange(5):60 - rng.randrange(5)] + [""] * rng.randrange(3) + head)))
    rows.append((12, "\n".join(["again and again"] * 80)))
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.row.doc_id: (r.text, r.n_lines, r.n_removed) for r in found} == plain.without_repeated_lines(rows)


def test_masks_lose_nothing():
    for width in range(decontamination.LEAST_TOKENS, decontamination.WINDOW + 1):
        places = [{o + d for d in m} for m in decontamination.MASKS for o in range(width - max(m))]
        for gone in itertools.combinations(range(width), int(width * decontamination.SUBSTITUTED)):
            assert any(not p & set(gone) for p in places)


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choice(VOCABULARY) + str(rng.randrange(40)) for _ in range(n))) for k, n in enumerate([8, 11, 15, 20, 33, 60, 5])]
    items += [(7, None), (8, ""), (9, items[4][1])]
    rows = []
    for i in range(60):
        item = items[i % 6][1].split(" ")
        for p in rng.sample(range(len(item)), min(len(item), rng.randrange(5))):
            item[p] = "zz"
        cut = item[rng.randrange(3):] if i % 3 == 0 else item
        rows.append((i, prose(rng, 20) + " " + ", ".join(cut).upper() + ". " + prose(rng, 20)))
    rows += [(60, None), (61, ""), (62, prose(rng, 300)), (63, (items[5][1] + " ") * 30)]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, key long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.passages(docs, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, k) for i, t in rows for k, x in items if plain.holds(t, x)}
    left = decontamination.drop_contaminated(docs, found)
    assert {r.doc_id for r in left.collect()} == {i for i, t in rows if not any(plain.holds(t, x) for _, x in items)}
    assert left.columns == docs.columns
    assert decontamination.passages(docs.limit(0), bench).count() == 0 == decontamination.passages(docs, bench.limit(0)).count()


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, prose(rng, 25)) for k in range(6)]
    docs = spark.createDataFrame([(k, prose(rng, 30) + " " + t) for k, t in items], "doc_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_SEEDS", 100)
    found = decontamination.passages(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k) for k in range(6)}


def test_decontamination_by_items_without_an_id(spark):
    rng = random.Random(16)
    items = [(None, prose(rng, 25)), (None, prose(rng, 12)), (3, prose(rng, 25))]
    rows = [(k, prose(rng, 20) + " " + t + " " + prose(rng, 20)) for k, (_, t) in enumerate(items)] + [(9, prose(rng, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.passages(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(0, None), (1, None), (2, 3)}
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, found).collect()] == [9]


def test_decontamination_searches_once(spark):
    rng = random.Random(18)
    items = [(k, prose(rng, 25)) for k in range(3)]
    docs = spark.createDataFrame([(k, prose(rng, 20) + " " + t) for k, t in items] + [(9, prose(rng, 60))], "doc_id long, text string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(agreeing):
        seen.add(1)
        return True

    found = decontamination.passages(docs, spark.createDataFrame(items, "item_id long, text string")).where(counted("agreeing"))
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, found).collect()] == [9]
    assert seen.value == 3
