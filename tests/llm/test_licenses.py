"""Licence scans against plain string search and an edit-distance table."""

import random
import re

import pytest

from neartag.llm import licenses
from neartag.llm.licenses import BASE, NOTICES, scan_text

from .helpers import documents, nothing, odd_documents, prose


def fewest_edits(text, notice):
    """Least edit distance of the notice to any substring, by the full table."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for char in text:
        above = row
        row = [0]
        for i, want in enumerate(notice, 1):
            row.append(min(above[i] + 1, row[-1] + 1, above[i - 1] + (char != want)))
        best = min(best, row[-1])
    return best


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    starts, labels = [], set()
    for phrase, label in BASE:
        own = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(own)] == own]
        starts += at
        labels |= {label} if at else set()
    plain = " ".join(words)
    found = {n.text: d for n in NOTICES if (d := fewest_edits(f" {plain} ", n.text)) <= n.errors}
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), labels, found


def damaged(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        text = text[:at] + ("" if kind == 0 else rng.choice("abcxyz")) + text[at + (kind != 1):]
    return text


def examples():
    rng = random.Random(4)
    texts = [None, "", " \n", "MIT License", "mit license mit license", "The Apache-License!", "xmit license", "mit licenses", "général public license"]
    for notice in NOTICES:
        for edits in range(notice.errors + 3):
            line = damaged(rng, notice.text, edits)
            if rng.random() < 0.5:
                line = line.replace(" ", rng.choice(["\n# ", "  ", " * ", ", "]))
            texts.append(f"{prose(rng, 20)} {line.title()} {prose(rng, 20)}")
    texts.append(" ".join(damaged(rng, n.text, n.errors) for n in NOTICES))
    return texts


def test_places_equal_brute_force(spark):
    texts = examples()
    got = {r.doc_id: r for r in licenses.scan(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n_words, n_base, first, last, base, notices = brute(text)
        row = got[i]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (n_words, n_base, first, last)
        least = {}
        for s in row.spans:
            least[s.notice] = min(s.edits, least.get(s.notice, 99))
        assert least == notices, text
        labels = base | {n.label for n in NOTICES if n.text in notices}
        assert (row.base_labels, row.labels) == (",".join(sorted(base)), ",".join(sorted(labels)))
        assert 0 <= row.score <= 1 and (row.score > 0) == bool(labels) and (row.score == 1 or not base)


def test_spans_point_into_the_text():
    text = "Über\n// Released  under the\n// M1T License. And on"
    found = scan_text(text)
    assert found["labels"] == "mit" and found["n_base"] == 0
    [span] = found["spans"]
    assert text[span["start"]:span["end"]] == "Released  under the\n// M1T License" and span["edits"] == 1
    assert (span["first_word"], span["last_word"]) == (1, 5)
    assert span["score"] == found["score"] == pytest.approx(2 / 3)


def test_repeated_notices_and_long_texts():
    line = "Released under the MIT License."
    found = scan_text(f"{line}\n" * 3000)
    assert found["n_base"] == 3000 and len(found["spans"]) == 3000
    assert (found["first_word"], found["last_word"]) == (3, 3 + 2999 * 5)
    assert scan_text("license " * 200_000)["labels"] == ""


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count() and {r.labels for r in got} == {""}
    assert all((r.n_base, r.first_word, r.score, r.spans) == (0, None, 0.0, []) for r in got)
    assert licenses.scan(nothing(spark)).count() == 0
