"""The pipeline's stages against plain versions, each on what the one before kept."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))
import plain  # noqa: E402

import corpus_pipeline  # noqa: E402

WORDS = [a + b for a in ("thing", "stone", "river", "cloud", "paper", "light") for b in ("", "s", "ed", "ing", "er", "ful", "ish", "wise")]


def prose(rng, n):
    w = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n)]
    return "\n".join(" ".join(w[i:i + 20]) for i in range(0, n, 20))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("tables")
    items = [prose(rng, 30).replace("\n", " ") for _ in range(4)]
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randrange(60, 200)) for _ in range(20)]
    texts += [texts[0], texts[1], prose(rng, 40) + "\n" + passage, passage + "\n" + prose(rng, 60)]
    near = prose(rng, 120).replace("\n", " ")
    texts += [near, near + " more", near.replace("thing", "thing", 1) + " and more words"]
    texts += [prose(rng, 60) + " " + items[0] + " " + prose(rng, 40), prose(rng, 50) + "\n" + items[1].upper()]
    texts += ["too short", None, "", "### " * 100, "word " * 100]
    docs = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), [(i, t) for i, t, *_ in docs], items


def test_stages(spark, tables):
    import sentencepiece

    folder, docs, items = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    kept = [(i, t) for i, t in docs if plain.quality(t)[-1]]
    lines = plain.without_repeated_lines(kept)
    kept = [(i, lines[i][0]) for i, _ in kept if lines[i][2] == 0 or plain.words(lines[i][0])]
    smallest = plain.components(kept)
    kept = [(i, t) for i, t in kept if smallest[i] == i]
    assert any(plain.holds(t, x) for _, t in kept for x in items)
    kept = {i: t for i, t in kept if not any(plain.holds(t, x) for x in items)}
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECES)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.text for r in rows} == kept and len(rows) == len(kept) < len(docs)
    assert all(r.ids == library.encode(r.text) and r.n_tokens == len(r.ids) and r.n_chars == len(r.text) for r in rows)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert corpus_pipeline.encode_pieces(spark, docs, folder).count() == 0


def test_near_duplicates_from_80_percent(spark):
    rng = random.Random(21)
    rows = []
    for k in range(12):
        w = [f"w{k}x{i}" for i in range(104)]  # 100 shingles
        rows.append((2 * k, " ".join(w)))
        gone = 10 + k % 3  # of 100 shingles, at the end
        rows.append((2 * k + 1, " ".join(w[:104 - gone] + [f"new{rng.randrange(10**9)}" for _ in range(gone)])))
    sets = [plain.shingles(t) for _, t in rows]
    alike = {round(len(a & b) / len(a | b), 2) for a, b in zip(sets[::2], sets[1::2])}
    assert alike == {0.82, 0.8, 0.79}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    smallest = plain.components(rows, 80)
    assert left == {i for i, _ in rows if smallest[i] == i} and len(left) == 16
    assert len(set(plain.components(rows).values())) == 24


def test_lines_are_deleted_by_one_worker_a_task(spark):
    rng = random.Random(33)
    run = prose(rng, 60)
    docs = spark.createDataFrame([(0, run), (1, run), (2, prose(rng, 20) + "\n" + run), (3, prose(rng, 30))], "doc_id long, text string")
    left = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted(r.doc_id for r in left.collect()) == [0, 2, 3]
