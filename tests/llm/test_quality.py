import random
import zlib

from tidemark.llm import quality


def _tables(spark, n=600):
    random.seed(6)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = [random.choice(["river", "meadow", "the", "quiet", "stone", "walks", "and", "evening"]) for _ in range(60)]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "x"))
        labels.append((i, int(good)))
    rows += [(n, None, "x"), (n + 1, "", "x"), (n + 2, "the quiet river " * 5000, "x"), (None, "stone", "x")]
    labels += [(1, 0), (None, 1), (2, None), (2, 1), (5, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_columns(spark):
    docs, labels = _tables(spark)
    model = quality.fit(docs, labels)
    rows = quality.score_documents(docs, model).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 80
    right = sum((r.predicted == 1) == (r.doc_id % 4 != 0) for r in held)
    assert right / len(held) > 0.97
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert by_id[600].score == by_id[601].score and by_id[602].predicted == 1


def test_held_out_labels_are_never_used(spark):
    docs, labels = _tables(spark, 200)
    flipped = labels.selectExpr(
        "doc_id", "IF(crc32(cast(doc_id AS string)) % 5 = 0, 1 - quality, quality) AS quality"
    )
    assert quality.fit(docs, labels) == quality.fit(docs, flipped)


def test_missing_labels_and_rows(spark):
    docs, labels = _tables(spark, 50)
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.5}
    one = quality.fit(docs, labels.filter("quality = 1"))
    assert all(0 < r.score <= 1 for r in quality.score_documents(docs, one).collect())
    assert quality.score_documents(docs.limit(0), none).count() == 0
