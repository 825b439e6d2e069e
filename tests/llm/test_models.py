"""Sharding, revisits, pieces, URL verdicts and the two language models."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from liasse.llm import perplexity, pieces, sharding, toxicity, url_filters, warc_revisits  # noqa: E402

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_shards(spark):
    rows = [(i, None if i % 50 == 0 else "text é " * (i % 9), {"k": i}) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot map<string,long>")
    found = sharding.into_shards(docs, 16, bucket_bytes=2000).collect()
    assert sorted(r.record.doc_id for r in found) == list(range(500))
    assert {r.record.slot["k"] for r in found} == set(range(500))
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(counts[s]))
    order = [r.record.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(500))[0, 1]) < 0.2
    assert sharding.into_shards(docs.limit(0), 16).count() == 0


def test_shards_repeated_rows_do_not_fill_one_bucket(spark):
    docs = spark.range(2000).select(F.lit(1).alias("doc_id"), F.lit("the same text").alias("text"), F.col("id").alias("bucket"))
    rows, counts = sharding.scatter(docs, "doc_id", "text", 1, 1000, 28_000)
    assert counts.agg(F.max("bytes")).first()[0] < 4000
    found = sharding.into_shards(docs, 3, bucket_bytes=1000).collect()
    assert len({r.record.bucket for r in found}) == 2000


def test_shards_written(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    sharding.write_shards(sharding.into_shards(docs, 4), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 4


def test_canonical_urls(spark):
    urls = ["http://WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#top", "https://example.com/a/b?a=1&b=2", None, "", "example.com", "http://x.org/?ref=y"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(warc_revisits.canonical_url(F.col("url"))).collect()]
    assert got == ["example.com/a/b?a=1&b=2"] * 2 + ["", "", "example.com", "x.org"]


def test_revisits(spark):
    rng = random.Random(3)
    rows, responses = [], []
    for i in range(300):
        url = rng.choice(["http://a.org/x", "http://a.org/x/", "http://b.org", None, ""])
        kind = rng.choice(["response", "revisit"])
        etag = rng.choice(["1", "2", None])
        at = rng.randrange(40)
        rows.append((i, url, at, kind, etag, None, None, {"date": str(i), "x": str(i), "content-length": str(i)}, "extra"))
        if kind == "response":
            responses.append((i, (url or "").rstrip("/"), at, etag))
    records = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, headers map<string,string>, full string")
    found = {r.record_id: r for r in warc_revisits.resolve_revisits(records, block_seconds=7).collect()}
    assert set(found) == {r[0] for r in rows if r[3] == "revisit"}
    for i, r in found.items():
        _, url, at, _, etag, *_ = rows[i]
        earlier = [x for x in responses if url and x[1] == url.rstrip("/") and x[2] < at]
        want = max(earlier, key=lambda x: (x[2], x[0]), default=None)
        assert r.response_id == (want and want[0])
        status = "missing" if not want else "unverified" if not (etag and want[3]) else "resolved" if etag == want[3] else "mismatch"
        assert r.status == status
        if status in ("resolved", "unverified"):
            assert r.headers == {"date": str(i), "x": str(want[0]), "content-length": str(want[0])}
    assert warc_revisits.resolve_revisits(records.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    return pieces.load(MODEL)


TEXTS = ["", " ", "a  b   c ", "Hello world", "é日本😀x\n\n\tz", "the " * 50, "x" * 300, "▁▁a", "don't WON'T 123,456", "Ünïcödé", "thth erst ing"] + [
    " ".join(random.Random(k).choice(["thing", "Station", "über", "naïve", "ing", "ed", "10", "A1b2"]) + random.Random(k * 7).choice([".", ",", ""]) for _ in range(9)) for k in range(60)]


def test_pieces_equal_the_library(spark, model):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids string")
    coded = pieces.encode(docs, model)
    rows = {r.doc_id: r for r in pieces.decode(coded, model).collect()}
    for i, t in enumerate(TEXTS):
        assert rows[i].ids == library.encode(t), t
        assert rows[i].decoded == library.decode(rows[i].ids)
    assert rows[len(TEXTS)].ids is None and rows[len(TEXTS)].decoded is None
    assert pieces.encode(docs.limit(0), model).count() == 0


def test_unigram_models_equal_the_library(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto
    m = proto.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    rng = random.Random(1)
    for p in m.pieces:
        if p.type == proto.ModelProto.SentencePiece.NORMAL:
            p.score = -rng.uniform(5, 15)
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.load(str(path))
    for t in TEXTS:
        flat, ends = pieces.encode_batch(own, [t], pieces.Encoded())
        assert flat.tolist() == library.encode(t), t


def test_url_rules_and_parts(spark):
    urls = ["http://A.Org/x?q", "http://example.org/es/1", "https://sub.example.org/en/12#f", "http://example.org/en/2", "ftp://x.com/fr/", "http://x.com/de/a",
            "http://notorg/", "http://myexample.org/es/", "no scheme org/", None, "", "http://org", "a://b://c/d"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select(
        "page_id", url_filters.host(F.col("url")).alias("host"), url_filters.path(F.col("url")).alias("path"))
    rule, says = url_filters.listed(F.col("host"), F.col("path"))
    got = {r.page_id: tuple(r)[1:] for r in rows.select("page_id", "host", "path", rule.alias("rule"), says.alias("says")).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow")
    assert got[1] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("sub.example.org", "/en/12", "example.org/en/1", "block")
    assert got[3][2:] == ("org/", "allow") and got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6][2:] == (None, None) and got[7][2:] == ("org/", "allow")
    assert got[8] == got[9] == got[10] == ("", "", None, None)
    assert got[11] == ("org", "", None, None) and got[12] == ("b:", "//c/d", None, None)


def test_url_verdicts(spark):
    good = [f"http://{a}{b}.example.net/{c}/{i}" for a in ("river", "stone") for b in ("side", "field") for c in ("news", "maps") for i in range(20)]
    bad = [f"http://{h}.example.net/play/{i}" for h in ("casinoroyal", "cheap-pills", "royalbets") for i in range(8)]
    text = "<p>river stone side field news maps royal play casino field of stones</p><script>var pills</script>" * 5
    rows = [(i, u, text) for i, u in enumerate(good + bad + ["http://royal-play.example.net/play/1"])] + [(-1, None, None), (-2, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r for r in url_filters.judge_urls(pages).collect()}
    assert all(found[i].verdict == "allow" for i in range(len(good)))
    assert all(found[i].verdict == "block" for i in range(len(good), len(good) + len(bad) + 1))  # the last has no listed word
    assert found[-1].verdict == found[-2].verdict == "allow" and found[-1].host == ""
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_segmentation_is_the_best(spark):
    counts = {"the": 50, "rapist": 2, "therapist": 5, "her": 20, "apist": 1}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.name: r.words for r in url_filters.segment(spark.createDataFrame([("therapist",), ("theher",), ("zzthe",), ("q",)], "name string"), table).collect()}
    assert got == {"therapist": ["therapist"], "theher": ["the", "her"], "zzthe": ["z", "z", "the"], "q": ["q"]}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    ordinary, insults = [f"w{i}" for i in range(60)], ["vile", "rotten", "awful"]
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = [rng.choice(insults) if bad and rng.random() < 0.06 else rng.choice(ordinary) for _ in range(rng.randrange(30, 120))]
        docs.append((i, " ".join(text).title(), "x"))
        labels.append((i, int(not bad), int(bad)))
    docs += [(1000, None, "x"), (1001, "", "x"), (None, "vile rotten", "x"), (5, docs[5][1], "x")]
    labels += [(None, 1, 1), (2000, None, None), (5, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 604 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert len(held) > 150 and right / len(held) > 0.9
    assert {r.difference for r in rows if r.doc_id in (1000, 1001)} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_by_joins_is_the_same(spark, labelled):
    docs, labels = labelled
    key = lambda rows: sorted((r.doc_id or -1, round(r.score, 5), r.n_words) for r in rows)
    assert key(toxicity.score(docs, labels).collect()) == key(toxicity.score(docs, labels, most_sent=0).collect())


def test_kneser_ney_values(spark):
    rng = random.Random(11)
    trusted = ["".join(rng.choice("abcd ") for _ in range(60)) for _ in range(30)]
    texts = ["".join(rng.choice("abcdef ") for _ in range(40)) for _ in range(10)] + ["", "é"]
    for given in (trusted, []):
        rows = spark.createDataFrame([(t, True) for t in given] + [(t, False) for t in texts], "text string, trusted boolean")
        grams = perplexity.gram_counts(rows, 3)
        values = {r.hash: r.value for r in perplexity.gram_values(grams, 3).collect()}
        want = plain.kneser_ney(given, texts, 3, perplexity.START)
        names = {r.gram: r.hash for r in grams.collect()}
        assert set(names) == set(want)
        assert max(abs(values[names[g]] - want[g]) for g in want) < 1e-9


def test_perplexity_by_blocks_is_the_same(spark, labelled):
    docs, labels = labelled
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    key = lambda rows: sorted((r.doc_id or -1, round(r.perplexity or 0, 9), r.kept) for r in rows)
    sent = key(perplexity.judge(docs, labels).collect())
    assert sent == key(perplexity.judge(docs, labels, most_sent=0).collect())
    assert len(sent) == 604 and (1000, 0, True) in sent
    assert perplexity.judge(docs.limit(0), labels).count() == 0
    assert all(r.kept for r in perplexity.judge(docs, labels.limit(0)).collect())


def test_one_mislabelled_row_sets_no_threshold(spark):
    # 100 trusted rows of one language, 61 of another; one of each is mislabelled.
    rows = [("en", 4 + i / 100) for i in range(99)] + [("fr", 4 + i / 100) for i in range(60)] + [("en", 50.0), ("fr", 60.0)]
    scored = spark.createDataFrame([(*r, True) for r in rows] + [("en", 99.0, False)], "lang string, perplexity double, trusted boolean")
    by_lang, overall = perplexity.thresholds(scored)
    assert {r.lang: r.most for r in by_lang.collect()} == {"en": 4.98}
    few = scored.where("perplexity < 60")
    assert overall == 50.0 and perplexity.thresholds(few)[1] == 4.98
