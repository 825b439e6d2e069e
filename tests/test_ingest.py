"""Incremental ingest: keyed states, parts of files, replays."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from liasse.schemas import PAGES
from liasse.sources import pages as src
from liasse.streaming import ingest

COLUMNS = "dossier_id string, fichier_source string, page_fichier int, texte string, ocr_applique boolean"


class Folder:
    """One place with incoming files, pages, quotations and results."""

    def __init__(self, spark, existing=None):
        self.spark, self.root, self.existing = spark, tempfile.mkdtemp(prefix="ingest-"), existing

    def send(self, *rows):
        frame = self.spark.createDataFrame([(*r, False) if len(r) == 4 else r for r in rows], COLUMNS)
        src.conform(frame, PAGES).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def quote(self, *rows):
        self.spark.createDataFrame(rows, "dossier_id string, id int, page int, citation string").write.mode("append").parquet(f"{self.root}/quotes")

    def run(self, quotes=True, **options):
        r = self.root
        ingest.ingest_stream(self.spark, f"{r}/in", f"{r}/pages", f"{r}/quotes" if quotes else None, f"{r}/out", f"{r}/ck", self.existing, **options).awaitTermination()

    def landed(self, *columns):
        return [tuple(x) for x in self.spark.read.parquet(f"{self.root}/pages").orderBy("dossier_id", "numero_global").select("numero_global", *columns).collect()]

    def verified(self):
        return sorted((x["id"], x["methode_verif"]) for x in self.spark.read.parquet(f"{self.root}/out").collect())


def test_ranges_against_sets():
    rng = random.Random(1)
    for _ in range(300):
        old, new = (np.array(sorted(rng.sample(range(30), rng.randrange(20))), np.int64) for _ in range(2))
        starts, ends = ingest.ranges(old)
        assert [x for s, e in zip(starts, ends) for x in range(s, e + 1)] == old.tolist()
        fresh = ingest.outside(new, starts, ends)
        assert set(fresh.tolist()) == set(new.tolist()) - set(old.tolist())
        both = ingest.joined(*(np.concatenate(x) for x in zip((starts, ends), ingest.ranges(fresh))))
        assert [x.tolist() for x in both] == [x.tolist() for x in ingest.ranges(np.union1d(old, fresh))]


def test_each_page_lands_once_after_the_pages_there_are(spark):
    old = src.conform(spark.createDataFrame([("A", "old.pdf", 1, "Ancienne page", False), ("A", "old.pdf", 2, "x", False)], COLUMNS).withColumn(
        "numero_global", F.col("page_fichier") + 6), PAGES)
    at = Folder(spark, old)
    at.send(("A", "new.pdf", 1, "Cote D7\nLe témoin parle."), ("A", "old.pdf", 1, "Ancienne page"), ("B", "b.pdf", 3, "seule"), ("A", "new.pdf", None, "sans numéro"))
    at.quote(("A", 1, 9, "le témoin parle."), ("A", 2, 9, "inventé"))
    for _ in range(2):
        at.run()
    assert at.landed("fichier_source", "cote_detectee") == [(9, "new.pdf", "D7"), (1, "b.pdf", None)]
    assert at.verified() == [(1, "exacte"), (2, "rejetee")]


def test_parts_of_a_file_and_a_failed_batch(spark, monkeypatch):
    at = Folder(spark)
    at.quote(*[("A", k, k, f"page {k}") for k in (1, 2, 3)])
    at.send(("A", "new.pdf", 1, "Page 1"))
    at.run()
    at.send(("A", "new.pdf", 2, "Page 2"), ("A", "new.pdf", 1, "Page 1 encore"), ("A", "zzz.pdf", 1, "Page 3"))
    with monkeypatch.context() as m:
        m.setattr(ingest, "verify", lambda *a: 1 / 0)
        with pytest.raises(Exception):
            at.run()
    at.run()
    assert at.landed("fichier_source", "page_fichier", "texte") == [(1, "new.pdf", 1, "Page 1"), (2, "new.pdf", 2, "Page 2"), (3, "zzz.pdf", 1, "Page 3")]
    assert at.verified() == [(1, "exacte"), (2, "exacte"), (3, "exacte")]


def test_random_arrivals_number_like_a_loop(spark):
    rng = random.Random(4)
    at, numbers, last = Folder(spark), {}, {}
    for _ in range(3):
        sent = sorted({(rng.choice("AB"), rng.choice(("f.pdf", "é.pdf", "Z.pdf")), rng.randrange(1, 15)) for _ in range(25)})
        at.send(*[(*s, f"{s}") for s in sent], *[(*s, f"{s}") for s in sent[:3]])
        at.run(quotes=False, max_files=1)
        for s in sorted(sent, key=lambda s: (s[0], s[1].encode(), s[2])):
            if s not in numbers:
                last[s[0]] = numbers[s] = last.get(s[0], 0) + 1
    found = at.landed("dossier_id", "fichier_source", "page_fichier")
    assert sorted(found) == sorted((n, *s) for s, n in numbers.items())
