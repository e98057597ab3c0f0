import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from neartag.functions import text
from neartag.functions.html import split_page
from neartag.functions.stem import stem
from neartag.functions.tags import parse_tags
from neartag.operators import prepare, tokens


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("x")).first().x


@pytest.mark.parametrize("tags, expected", [
    ("", [""]), ("   ", []), (" a b", ["", "a", "b"]), ("a b  ", ["a", "b"]),
    ("a  b\t\tc", ["a", "b", "c"]), ("a b a", ["a", "b"]),
])
def test_parse_tags(spark, tags, expected):
    assert one(spark, parse_tags(F.col("s")), tags) == expected


def test_standard_analyzer(spark):
    got = one(spark, text.standard(F.col("s")), "The Quick-brown fox, and Été 42! " + "x" * 256)
    assert got == ["quick", "brown", "fox", "été", "42", "x" * 256]
    capped = one(spark, text.drop_tokens(text.standard(F.col("s")), max_length=255), "fox " + "x" * 256)
    assert capped == ["fox"]  # a cap is opt-in
    assert one(spark, text.standard(F.col("s")), None) == []


def test_url_and_email_tokens(spark):
    got = one(spark, text.url_email(F.col("s")), "See http://Example.com/a?b=1, or mail Me.You@x-y.org. www.z.net/")
    assert got == ["see", "http://example.com/a?b=1", "mail", "me.you@x-y.org", "www.z.net/"]


def test_porter_analyzer_order(spark):
    # Stop words go before stemming: "being" is no stop word though its stem "be" is one.
    got = one(spark, text.url_email_porter(F.col("s")), "being the hopping ponies")
    assert got == ["be", "hop", "poni"]


def test_analyzer_choice(spark):
    text.register_analyzer("letters", lambda c: text.pattern_tokens(c, "[a-z]"))
    assert one(spark, text.get_analyzer("letters")(F.col("s")), "a1B") == ["a", "b"]
    with pytest.raises(ValueError):
        text.get_analyzer("nothing")


# Pairs from the published description of the algorithm.
@pytest.mark.parametrize("word, expected", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("caress", "caress"), ("cats", "cat"),
    ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"),
    ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"),
    ("tanned", "tan"), ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"),
    ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"),
    ("rational", "ration"), ("valenci", "valenc"), ("digitizer", "digit"), ("radicalli", "radic"),
    ("vietnamization", "vietnam"), ("predication", "predic"), ("operator", "oper"), ("feudalism", "feudal"),
    ("decisiveness", "decis"), ("hopefulness", "hope"), ("callousness", "callous"), ("formaliti", "formal"),
    ("sensitiviti", "sensit"), ("sensibiliti", "sensibl"), ("triplicate", "triplic"), ("formative", "form"),
    ("electriciti", "electr"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"),
    ("allowance", "allow"), ("inference", "infer"), ("airliner", "airlin"), ("adjustable", "adjust"),
    ("replacement", "replac"), ("adjustment", "adjust"), ("dependent", "depend"), ("adoption", "adopt"),
    ("communism", "commun"), ("activate", "activ"), ("effective", "effect"), ("bowdlerize", "bowdler"),
    ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
    ("generalizations", "gener"), ("oscillators", "oscil"), ("is", "is"),
])
def test_porter(word, expected):
    assert stem(word) == expected


def test_page_parts():
    page = "<p>Tom &amp; <a href='x'>link <code>in()</code></a><code>a<code>b</code></code>" \
           "<!-- <a>no</a> --><p>open<script>var t='<a>no</a>';</script>"
    body, code, links = split_page(page)
    assert body == "Tom & link openvar t='<a>no</a>';"
    assert code == "in()\nab\nb"
    assert links == "link "
    assert split_page(None) == ("", "", "")
    # An open code element ends with the element around it.
    assert split_page("<p><code>x</p>y") == ("y", "x", "")


def test_open_elements_take_linear_time():
    body, code, links = split_page("<ul>" + "<li>x<a href=u>y" * 200_000 + "<code>c")
    assert (len(body), code, links.count("y")) == (400_000, "c", 200_000)


def test_clean_html_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "t", "<b>x</b><code>y</code>", "a b")], "id long, title string, body string, tags string")
    row = prepare.clean_html(df).first()
    assert row.asDict() == {"id": 1, "title": "t", "tags": "a b", "body": "x", "code": "y", "links": ""}


def test_html_tag_counts(spark):
    df = spark.createDataFrame([("<P>a<p>b<br><!-- <i> --><script>'<b>'</script><style><u></style><SCRIPT>open <em>",)], "body string")
    got = {r.tag: r.n for r in prepare.html_tag_counts(df).collect()}
    assert got == {"p": 2, "br": 1, "script": 2, "style": 1}


def test_tag_counts(spark):
    df = spark.createDataFrame([("a  b",), ("a",), ("",)], "tags string")
    assert [(r.n, r.tag) for r in prepare.tag_counts(df).collect()] == [(1, "b"), (2, "a")]
    kept = {r.tag: r.n for r in prepare.tag_counts(df, keep_empty=True).collect()}
    assert kept == {"": 2, "b": 1, "a": 2}


def test_concat_is_null_if_any_part_is(spark):
    df = spark.createDataFrame([("t", "b", "c", "l"), ("t", None, "c", "l")],
                               "title string, body string, code string, links string")
    assert [r.x for r in df.select(prepare.concat_fields().alias("x")).collect()] == ["t b c l", None]


def test_rows_are_numbered_whatever_the_keys(spark):
    # Three close keys, many negative ones and a far one: ranges are cut at quantiles.
    keys = list(range(-500, 500, 7)) + [10 ** 12, 10 ** 12 + 1, 10 ** 12 + 2]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "id long").repartition(5)
    got = {r.id: r.row_number for r in prepare.number_rows(df, "id").collect()}
    assert got == {k: i for i, k in enumerate(keys)}
    slices = {r.id: r.slice_id for r in prepare.slice_rows(df, 10).collect()}
    assert slices == {k: i // 10 for i, k in enumerate(keys)}
    assert prepare.slice_rows(df.filter("id > 10000000000000"), 10).count() == 0


def test_take_first(spark):
    df = spark.range(100).repartition(4)
    assert sorted(r.id for r in prepare.take_first(df, 7).collect()) == list(range(7))
    assert prepare.take_first(df, 0).count() == 100
    named = spark.range(10_050).select(F.format_string("n%06d", "id").alias("name"))
    for n in (10_000, 10_001):
        got = [r.name for r in prepare.take_first(named, n, "name").collect()]
        assert sorted(got) == [f"n{i:06d}" for i in range(n)]


def test_first_by_id(spark):
    df = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (2, 5, "only")], "id long, row long, tags string")
    got = {r.id: r.tags for r in prepare.first_by_id(df, ["row"]).collect()}
    assert got == {1: "early", 2: "only"}


def test_token_tables(spark):
    df = spark.createDataFrame([(1, "Zebra apple zebra the banana"), (2, None), (3, "")], "id long, text string")
    got = tokens.tokenize(df)
    assert [(r.pos, r.term) for r in got.orderBy("pos").collect()] == [
        (0, "zebra"), (1, "apple"), (2, "zebra"), (3, "banana")]
    assert tokens.max_token_length(got, 5).count() == 3
    words = spark.createDataFrame([("zebra",), ("zebra",)], "term string")
    assert tokens.remove_stop_words(got, words).count() == 2
    assert tokens.remove_stop_words(got, ["apple"]).count() == 3
    assert tokens.remove_stop_words(got, []).count() == 4
    counts = tokens.count_terms(df, text.standard(F.col("text")), ("id",))
    assert {(r.id, r.term, r.tf) for r in counts.collect()} == {(1, "apple", 1), (1, "banana", 1), (1, "zebra", 2)}


def test_word_bag_adds_fields(spark):
    df = spark.createDataFrame([(1, "x y", "y z")], "id long, title string, body string")
    assert {r.term: r.n for r in tokens.word_bag(df).collect()} == {"x": 1, "y": 2, "z": 1}


def test_stop_words_from_a_file(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("apple\nkiwi\n")
    words = spark.read.text(str(tmp_path / "stop.txt")).withColumnRenamed("value", "term")
    df = spark.createDataFrame([(1, "apple pear")], "id long, text string")
    assert [r.term for r in tokens.remove_stop_words(tokens.tokenize(df), words).collect()] == ["pear"]


def test_pages_are_split_few_at_a_time():
    """A batch of wide pages is not held as Python strings and parts at once; other columns pass unchanged."""
    page = "<p>" + "words " * 500 + "</p><code>x</code>"
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, 3000)]), pa.array([None] + [page] * 2999)], ["id", "body"])
    made, sizes, peak = [], [], 0
    tracemalloc.start()
    for piece in prepare.split_pages(batch, ["id"], "body"):
        sizes.append(piece.num_rows)
        made.append(piece["id"])
        if piece.num_rows > 1:
            assert (piece["body"][1].as_py(), piece["code"][1].as_py()) == ("words " * 500, "x")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(sizes) == prepare.PAGES and sum(sizes) == 3000
    assert pa.concat_arrays(made).to_pylist() == [None, *range(1, 3000)]
    assert peak < 4 << 20
