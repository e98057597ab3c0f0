"""Language ID, WARC derivatives, quality model, sharding and the pipeline."""

import html
import json
import random
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from neartag.llm import langid, quality, shards, warc
from neartag.llm.queries import QUERIES, vocabulary
from neartag.plans.staging import Staging

from .helpers import WORDS, documents, nothing, odd_documents, prose
from .test_similarity import brute_leaks, brute_near
from .test_text_operators import brute_lines

tokenizers = pytest.importorskip("tokenizers")

SMALL = "/root/testdata/sf0.001"


# --- language ----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def two_languages(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 80, lang), lang) for i in range(120) for lang in [["en", "de"][i % 2]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_digits_and_number_signs_are_no_letters(spark, two_languages):
    model = langid.fit(two_languages, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(documents(spark, ["½ ² Ⅷ", "②③ 100", None, "", "the of"]), model).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model


def test_language_by_compression(two_languages):
    train, test = two_languages.filter("doc_id < 60"), two_languages.filter("doc_id >= 60")
    model = langid.fit(train, F.lit(True))
    assert sorted(model) == ["de", "en"] and all(len(v) <= langid.DICTIONARY_BYTES for v in model.values())
    joined = langid.predict(test, model).join(test.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 and not r.rejected for r in joined)


def test_language_uses_only_what_it_may(two_languages):
    model = langid.fit(two_languages, F.col("doc_id") % 2 == 0)
    assert list(model) == ["en"]
    text = two_languages.limit(1).withColumn("lang", F.lit("de"))
    assert langid.predict(text, model).first().lang_pred == "en"


def test_language_of_long_texts():
    rng = random.Random(16)
    names = {lang: ["".join(rng.choices(letters, k=rng.randrange(3, 9))) for _ in range(4000)]
             for lang, letters in (("en", "abcdefghijklmn"), ("de", "klmnopqrstuvwxyzß"))}
    model = tuple((lang, langid.prepared(" ".join(rng.choices(names[lang], k=12_000)))[:langid.DICTIONARY_BYTES]) for lang in ("de", "en"))
    judge = langid.Compressors(model, langid.LEVEL).judge
    short, long = (" ".join(rng.choices(names["en"], k=k)) for k in (4_000, 1_200_000))
    assert len(long) > 7_000_000
    (lang, _, margin), (long_lang, _, long_margin) = judge(short), judge(long)
    assert lang == long_lang == "en" and margin > langid.MARGIN
    assert long_margin > 0.8 * margin
    data = langid.prepared(long)
    pieces = langid.pieces_of(data)
    assert b"".join(pieces) == data and max(map(len, pieces)) <= langid.PIECE_BYTES and langid.pieces_of(b"") == [b""]


def test_language_odd(spark, two_languages):
    model = langid.fit(two_languages, F.lit(True))
    got = langid.predict(odd_documents(spark), model).collect()
    assert len(got) == odd_documents(spark).count()
    assert {(r.lang_pred, r.score, r.rejected) for r in got if r.doc_id in (0, 1, 2, 6)} == {("und", 0.0, True)}
    mixed = documents(spark, [" ".join(a + " " + b for a, b in zip(WORDS["en"], WORDS["de"])) * 20])
    assert langid.predict(mixed, model, margin=0.5).first().rejected
    none = langid.fit(nothing(spark), F.lit(True))
    assert none == {} and langid.predict(two_languages.limit(1), none).first().lang_pred == "und"
    assert langid.predict(nothing(spark), model).count() == 0


# --- WARC --------------------------------------------------------------------------------

class Reader(HTMLParser):
    """The same text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        self.parts.append("\n" if tag in warc.BLOCKS else "")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skip:
            self.skip -= 1
        self.parts.append("\n" if tag in warc.BLOCKS else "")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(" ".join(data.replace("\n", " ").split(" ")))

    def text(self):
        lines = (" ".join(x.split()) for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x)


def test_text_equals_the_standard_parser(spark):
    for row in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        reader = Reader()
        reader.feed(row.html)
        reader.close()
        assert warc.plain_text(row.html) == reader.text()


def test_derived_records_are_linked():
    page = "<html><head><title>A &amp; B</title></head><body><p>One<br>two <a href='/x?a=1&amp;b'>link</a><script>no</script></body>"
    data = warc.response_of(7, "http://e.org/p", page)
    made = warc.derive(data)
    source, conversion, metadata = warc.parse(data), warc.parse(made.conversion), warc.parse(made.metadata)
    assert conversion.get("WARC-Refers-To") == metadata.get("WARC-Refers-To") == source.get("WARC-Record-ID")
    assert conversion.get("WARC-Target-URI") == "http://e.org/p" and conversion.get("WARC-Date") == source.get("WARC-Date")
    assert conversion.block.decode() == "A & B\nOne\ntwo link"
    assert conversion.get("WARC-Block-Digest") == warc.digest(conversion.block)
    about = json.loads(metadata.block)
    assert about["source"]["headers"] == [list(h) for h in source.headers]
    assert about["source"]["payload-digest"] == warc.digest(page.encode()) == source.get("WARC-Payload-Digest")
    assert about["conversion"]["id"] == conversion.get("WARC-Record-ID") and about["html"] == {"title": "A & B", "links": ["http://e.org/x?a=1&b"]}
    assert warc.derive(data) == made  # a retry makes the same records


def test_records_of_others():
    head = b"WARC/1.0\r\nWARC-Type: response\r\nX-Long: a\r\n b\r\nContent-Length: "
    block = b"HTTP/1.0 200\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>caf\xe9"
    made = warc.derive(head + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    assert made.text == "café" and ["X-Long", "a b"] in json.loads(warc.parse(made.metadata).block)["source"]["headers"]
    for bad in (b"", b"WARC/1.0\r\n\r\n", head + b"9999\r\n\r\n" + block, b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.derive(bad)
    assert warc.plain_text("<p" * 50000) == html.unescape("<p" * 50000)


def test_warc_odd(spark):
    rows = [(1, None, None, 1), (2, "u", "", 1), (2, "u", "", 1), (None, "u\nv", "<p>x" + "y" * 100000, 1), (3, "http://[bad", "<a href='z'>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record int")
    got = warc.derivatives(warc.responses(pages)).collect()
    assert len(got) == 5 and all(r.error is None for r in got)
    assert len({r.response_id for r in got}) == 4
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "page_id long, record binary")
    assert all(r.error and r.conversion is None for r in warc.derivatives(bad).collect())
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


# --- quality -----------------------------------------------------------------------------

def test_additive_model_learns_shapes_and_pairs():
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (6000, len(quality.FEATURES)))
    y = ((np.abs(x[:, 0]) < 0.8) & (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = quality.fit(x[:4000], y[:4000])
    right = ((model.scores(x[4000:]) >= 0.5) == y[4000:]).mean()
    assert {(1, 2)} <= {(i, j) for i, j, _ in model.pairs}
    one_shape = quality.fit(x[:4000], (np.abs(x[:4000, 0]) < 0.5).astype(float))
    assert ((one_shape.scores(x[4000:]) >= 0.5) == (np.abs(x[4000:, 0]) < 0.5)).mean() > 0.9
    assert right > 0.85


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    model = quality.fit(x, (x[:, 0] + x[:, 3] > 0).astype(float), rounds=10, pair_rounds=5)
    for row, got in zip(x[:40], model.scores(x[:40])):
        bins = [int((e <= v).sum()) for e, v in zip(model.edges, row)]
        total = model.bias + sum(t[b] for t, b in zip(model.tables, bins))
        total += sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for i, j, t in model.pairs)
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op9_quality"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(rows[r.doc_id].held_out for r in held) and sum(r.held_out for r in rows.values()) < len(rows)
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in held]) >= 0.95


def test_quality_odd(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0), (6, 0, 0), (None, 1, 0), (4, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_documents(docs, labels, F.lit(True))
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = quality.fit_documents(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(nothing(spark), model).count() == 0


# --- shards ------------------------------------------------------------------------------

def check_shards(docs, n):
    got = shards.shard_documents(docs, n, Staging(docs.sparkSession)).collect()
    rows = docs.select("doc_id", "text").collect()
    expected = sorted(((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == expected
    by = {}
    for r in got:
        assert 0 <= r.shard < n
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        in_order = [r.doc_id for r in sorted(part, key=lambda r: r.slot)]
        assert in_order == sorted(in_order, key=lambda i: (i is not None, i or 0))
    return by


def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(10)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(1500)]
    texts += [texts[0]] * 900 + [texts[i % 40 + 1] for i in range(200)]
    by = check_shards(documents(spark, texts), 7)
    sizes = [sum(r["size"] for r in part) for part in by.values()]
    assert len(by) == 7 and max(sizes) <= 1.02 * np.mean(sizes) and min(sizes) >= 0.98 * np.mean(sizes)
    shards_of = {}
    for shard, part in by.items():
        for r in part:
            shards_of.setdefault(r.text_crc32, set()).add(shard)
    # A cut may go through one group of copies; the large group fills several shards.
    assert sum(len(s) > 1 for s in shards_of.values()) <= 6


def test_shards_odd(spark):
    check_shards(odd_documents(spark), 3)
    assert check_shards(nothing(spark), 24) == {}
    same = check_shards(documents(spark, [(None, "same")] * 50 + [(1, "same")] * 50), 4)
    assert sum(map(len, same.values())) == 100
    assert set(check_shards(documents(spark, ["a", "b", "c"]), 1)) == {0}


# --- pipeline ----------------------------------------------------------------------------

def test_stages_return_the_columns_of_documents(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "BPE tokens":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert stage(spark, nothing(spark), SMALL).count() == 0
        assert out.count() <= docs.count()


def test_each_stage_drops_what_it_should(spark):
    rng = random.Random(2)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    base = prose(rng, 400)
    near = base.split()
    near[7] = "changed"
    line = "a line that many of the documents have in common"
    rows = [(0, base), (1, base), (2, " ".join(near)), (3, prose(rng, 50) + " " + item + " " + prose(rng, 50)), (4, "123 456")]
    rows += [(i, f"{prose(rng, 90)}\n{line}\n{prose(rng, 90)}") for i in range(10, 20)]
    docs = documents(spark, rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Staging(spark).write(stage(spark, docs, SMALL), "stage")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["language ID"]) == {i for i, _ in rows} - {4}
    assert [i for i, t in kept["line dedup"].items() if line in t] == [19]
    assert set(kept["near-dedup"]) == {0, 3, *range(10, 20)}
    assert set(kept["decontamination"]) == {0, *range(10, 20)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 11


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    judge = langid.Compressors(tuple(sorted(langid.fit(docs, F.lit(True)).items())), langid.LEVEL).judge
    judged = {i: judge(t) for i, t in rows}
    rows = [(i, t) for i, t in rows if judged[i][0] != langid.UNKNOWN and judged[i][2] >= langid.MARGIN]
    rows = [(i, t) for i, t, _, _ in brute_lines(rows)]
    root = brute_near(rows, 4, 4)[1]
    rows = [(i, t) for i, t in rows if root[i] == i]
    items = [(r.item_id, r.text, None) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute_leaks(rows, items)}
    library = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    expected = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows if i not in leaked}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert len(got) == len(expected) and {r.doc_id: r.ids for r in got} == expected
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert 0.6 * docs.count() < len(got) < docs.count()
