"""Page sources against plain loops."""

import random

import pytest

from liasse.sources import pages as src, sinks


def plain_names(names):
    """One file after the other."""
    taken, out = set(), []
    for name in names:
        stem, dot, extension = name.rpartition(".")
        stem, extension = (stem, dot + extension) if dot and stem else (name, "")
        chosen, n = name, 2
        while chosen in taken:
            chosen, n = f"{stem}_{n}{extension}", n + 1
        taken.add(chosen)
        out.append(chosen)
    return out


@pytest.mark.parametrize("folded", [4096, 2])
def test_lowest_free_suffix_equals_the_loop(spark, monkeypatch, folded):
    monkeypatch.setattr(src, "FOLDED", folded)
    rng = random.Random(folded)
    pool = ["a.pdf", "a_2.pdf", "a_3.pdf", "a_4.pdf", "a_6.pdf", "a_2_2.pdf", "a_2_3.pdf", "a_2_2_2.pdf", "a_10.pdf", "a_1.pdf", "a_02.pdf", "b", "b_2", ".pdf", ".pdf_2", "x.y_2",
            "x.y", "_2.pdf", "a_2.", "c\nd.pdf", "c\nd_2.pdf", "s_20310101123456789012345.pdf", "s.pdf"]
    cases = {f"c{i}": [rng.choice(pool[:rng.choice((3, 7, 10, len(pool)))]) for _ in range(rng.randrange(1, 45))] for i in range(40)}
    rows = [(c, i, n) for c, names in cases.items() for i, n in enumerate(names)]
    found = src.disambiguate(spark.createDataFrame(rows, "dossier_id string, rang int, nom string").repartition(4)).collect()
    assert {(r.dossier_id, r.rang): r.nom_final for r in found} == {(c, i): x for c, names in cases.items() for i, x in enumerate(plain_names(names))}
    assert len(found) == len(rows)


def test_names_without_repeats_and_no_names(spark):
    files = spark.createDataFrame([("A", 0, "a.pdf"), ("A", 1, "a_2.pdf"), ("B", 0, "a.pdf")], "dossier_id string, rang int, nom string")
    assert {r.nom_final for r in src.disambiguate(files).collect()} == {"a.pdf", "a_2.pdf"}
    assert src.disambiguate(files.limit(0)).count() == 0


def test_replaced_rows_keep_nothing_of_the_old_ones(spark, tmp_path):
    current = spark.createDataFrame([("A", 1, "old", "x"), ("A", None, "kept", "y"), ("B", 1, "other", "z")], "dossier_id string, k int, texte string, reste string")
    updates = spark.createDataFrame([("A", 1, "first", "p", 1), ("A", 1, "new", None, 2), ("C", None, "c", None, 1)], "dossier_id string, k int, texte string, reste string, n int")
    expected = [("A", None, "kept", "y"), ("A", 1, "new", None), ("B", 1, "other", "z"), ("C", None, "c", None)]
    order = lambda rows: sorted((tuple(r)[:4] for r in rows), key=str)
    assert order(src.replace_rows(current, updates, ["dossier_id", "k"], "n").collect()) == sorted(expected, key=str)
    path = str(tmp_path / "table")
    sinks.write_replacing(current, path, ["dossier_id", "k"], buckets=3)
    for _ in range(2):  # a run that is repeated changes nothing
        sinks.write_replacing(updates, path, ["dossier_id", "k"], buckets=3, order="n")
        assert order(spark.read.parquet(path).select("dossier_id", "k", "texte", "reste").collect()) == sorted(expected, key=str)


def test_forced_ingest_starts_the_case_again(spark):
    columns = "dossier_id string, fichier_source string, page_fichier int, texte string, rang_fichier int"
    old = src.number_pages(spark.createDataFrame([("A", "a.pdf", 1, "x", 1), ("A", "a.pdf", 2, "y", 1), ("B", "b.pdf", 1, "z", 1)], columns),
                           spark.createDataFrame([], "dossier_id string, numero_global int"))
    old = src.pages_with_marks(old)
    batch = spark.createDataFrame([("A", "a.pdf", 1, "x2", 1), ("A", "c.pdf", 1, "w", 2)], columns)
    rows = lambda df: sorted(tuple(r) for r in df.select("dossier_id", "fichier_source", "page_fichier", "numero_global", "texte").collect())
    assert rows(src.ingest_files(batch, old)) == [("A", "a.pdf", 1, 1, "x"), ("A", "a.pdf", 2, 2, "y"), ("A", "c.pdf", 1, 3, "w"), ("B", "b.pdf", 1, 1, "z")]
    assert rows(src.ingest_files(batch, old, force=True)) == [("A", "a.pdf", 1, 1, "x2"), ("A", "c.pdf", 1, 2, "w"), ("B", "b.pdf", 1, 1, "z")]
