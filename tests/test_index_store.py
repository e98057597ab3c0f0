"""An index of segments against an index built at once."""

import pytest

from neartag.operators.index import build_index
from neartag.plans import search
from neartag.sources import index_store as store

ROWS = [("train", i, f"word{i % 7} word{i % 5} common " + "again " * (i % 3), f"t{i}") for i in range(40)] + [("test", 3, "word1 other", "x")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "corpus string, id long, text string, tags string")


def tables(index):
    stats = sorted(map(tuple, index.term_stats.select("term", "df", "ttf", "max_tf", "min_len").collect()))
    docs = sorted((r.corpus, r.id, r.tags, r.doc_len, tuple(map(tuple, r.terms))) for r in index.docs.collect())
    return docs, stats, index.corpus_stats.select("n_docs", "sum_ttf", "avgdl").first()


def test_appends_equal_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "index")
    assert store.append_segment(frame(spark, ROWS[:10]), path) == 1
    old = store.read_segments(spark, path)
    before = tables(old)
    # Known ids are refused even with another text.
    assert store.append_segment(frame(spark, ROWS[5:30] + [("train", 2, "changed", "")]), path) == 2
    assert store.append_segment(frame(spark, ROWS[5:30]), path) == 2
    assert store.append_segment(frame(spark, ROWS), path) == 3
    expected = tables(build_index(frame(spark, ROWS)))
    assert tables(store.read_segments(spark, path)) == expected
    # Readers of the first version see what they saw.
    assert tables(old) == before == tables(store.read_segments(spark, path, 1))
    assert store.merge_segments(spark, path) == 4
    assert len(store.segments_of(spark, path, 4)) == 1 and tables(store.read_segments(spark, path)) == expected
    assert store.merge_segments(spark, path) == 4


def test_an_unpublished_append_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "index")
    store.append_segment(frame(spark, ROWS[:5]), path)
    store.write_segment(build_index(frame(spark, ROWS[5:9])).docs, path)  # cut off before it was published
    assert store.read_segments(spark, path).n_docs == 5
    assert store.append_segment(frame(spark, ROWS[5:9]), path) == 2
    assert store.read_segments(spark, path).n_docs == 9
    with pytest.raises(RuntimeError):
        store.publish(spark, path, 2, [])
    assert store.latest_version(spark, path) == 2


def test_search_in_segments(spark, tmp_path):
    path = str(tmp_path / "index")
    for part in (ROWS[:20], ROWS[20:]):
        store.append_segment(frame(spark, part), path)
    asked = spark.createDataFrame([(1, "word3 common"), (2, "again other")], "query_id long, text string")
    found = search.find_neighbors(asked, store.read_segments(spark, path), 4)
    expected = search.knn_join(asked, build_index(frame(spark, ROWS)), 4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_the_query_searches_the_merged_segment(spark, tmp_path, monkeypatch):
    from checks import queries

    docs = [(i, f"title {i}\nword{i % 7} common", "de", "web", 20) for i in range(12)]
    made = {"documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
            "labels": ([(1, 1, 0)], "doc_id long, quality int, toxic int"),
            "benchmark": ([(1, "word1 common")], "item_id long, text string")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    asked = []
    monkeypatch.setattr(queries.search, "find_neighbors", lambda rows, index, **_: asked.append(index))
    queries.QUERIES["segmented_index_search"](spark, str(tmp_path))
    segments = {name.rsplit("/docs/", 1)[0] for name in asked[0].docs.inputFiles()}
    assert len(segments) == 1 and asked[0].docs.count() == 13


def test_no_index(spark, tmp_path):
    with pytest.raises(ValueError):
        store.read_segments(spark, str(tmp_path))
    assert store.append_segment(frame(spark, []), str(tmp_path)) == 0
