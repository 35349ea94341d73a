"""Every stage of the pipeline on odd rows, clashing columns and empty tables."""

import pytest

import corpus_pipeline

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(20_000))
ITEM = "the quick brown fox jumps over the lazy dog near the old river bank at dawn today"
LINE = "this line of words stands in several documents and is not worth keeping"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, make):
    at = str(tmp_path_factory.mktemp("tables"))
    labels = [(i, i % 2, 0) for i in range(1, 40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def rows(make, spark, folder, tmp_path_factory):
    unlike = lambda k: " ".join(f"z{k}q{j * j % 101}" for j in range(30))
    data = [
        (1, None), (2, ""), (3, " \n "), (4, f"{unlike(4)}\n{LINE}"), (5, f"{unlike(5)}\n{LINE}"), (6, f"{unlike(6)}\n{LINE}"), (6, f"{unlike(6)}\n{LINE}"), (None, f"{unlike(7)}\n{LINE}"),
        (None, unlike(4)), (None, None), (8, f"{unlike(8)} {ITEM} {unlike(9)}"), (None, f"{unlike(10)} {ITEM}"), (11, LONG), (12, LONG), (13, f"{unlike(13)}\n{LINE}"), (13, "another text of the same number " + unlike(14)),
    ]
    at = str(tmp_path_factory.mktemp("rows")) + "/documents.parquet"
    make(data).repartition(3).write.parquet(at)  # a table, as stages get
    return spark.read.parquet(at)


def stage(spark, name, docs, folder):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, folder)


def texts(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "") for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, make, folder, name):
    assert stage(spark, name, make([]), folder).count() == 0


def test_quality(spark, rows, folder):
    got = stage(spark, "quality rules", rows, folder)
    assert got.columns == rows.columns and set(texts(got)) <= set(texts(rows)) and got.filter("text is null or trim(text) = ''").count() == 0


def test_lines(spark, rows, folder):
    got = stage(spark, "line dedup", rows, folder)
    assert got.columns == rows.columns and got.count() == rows.count()
    holders = [r for r in got.collect() if LINE in (r["text"] or "")]
    assert [r["doc_id"] for r in holders] == [4]  # the least doc_id; a repeated row is a document too, and none without doc_id is first
    assert got.filter("n_chars <> length(text)").count() == 0 and got.filter("text is null").count() == 2


def test_near_dedup(spark, rows, folder):
    got = stage(spark, "SimHash near-dedup", rows, folder)
    assert got.columns == rows.columns
    left = texts(got)
    # blank ones are equal, so are the repeated rows and the long ones; of the rows without doc_id the blank one goes
    assert [x[1] for x in left if not x[0]] == [1, 4, 5, 6, 8, 11, 13, 13] and len(left) == 11


def test_decontamination(spark, rows, folder):
    got = stage(spark, "benchmark decontamination", rows, folder)
    assert got.columns == rows.columns and got.count() == rows.count() - 2 and not any(ITEM in x[3] for x in texts(got))


def test_tokens(spark, rows, folder):
    got = stage(spark, "byte-level BPE", rows, folder)
    assert got.count() == rows.count() and got.filter("n_tokens = 0").count() == 3
