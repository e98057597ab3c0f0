"""Language ID and sharding against plain versions of their methods."""

import random
import zlib

import regex
import xxhash
import zstandard

from neartag.llm import queries, shards
from neartag.plans.staging import Staging
from tests.llm.helpers import documents, prose
from tests.llm.test_models_and_files import SMALL


def signed_hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def plain_languages(rows):
    """doc_id -> language, score: dictionaries of 64 middles of 4,096 characters, pieces of at most 32 KB."""
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    letters = regex.compile(r"\p{L}")
    prepare = lambda t: f" {t.lower()} ".replace("\n", " ").encode()
    taught = {}
    for i, text, lang in rows:
        if not held(i) and lang is not None and text and letters.search(text):
            taught.setdefault(lang, []).append((signed_hash(str(i)), signed_hash(text), text))
    packers = []
    for lang, found in sorted(taught.items()):
        parts = []
        for _, _, text in sorted(found)[:64]:
            low = max(1, int((len(text) - 4096) / 2))
            part = prepare(text[low - 1:low - 1 + 4096])
            if part not in parts:
                parts.append(part)
        setting = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=False, write_checksum=False, write_dict_id=False)
        words = zstandard.ZstdCompressionDict(b" ".join(parts)[:65536], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=setting)
        packers.append((lang, zstandard.ZstdCompressor(dict_data=words, compression_params=setting)))
    out = {}
    for i, text, _ in rows:
        if not text or not letters.search(text):
            out[i] = ("und", 0.0)
            continue
        data = prepare(text)
        n = -(-len(data) // 32768)
        cuts = [len(data) * j // n for j in range(n + 1)]
        sizes = sorted((sum(len(p.compress(data[a:b])) for a, b in zip(cuts, cuts[1:])), lang) for lang, p in packers)
        out[i] = (sizes[0][1], min(1.0, 0.5 + (sizes[1][0] / sizes[0][0] - 1) * 5))
    return out


def test_languages_equal_the_plain_version(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert len({i for i, _, _ in rows}) == len(rows)
    got = queries.op7_language(spark, SMALL).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in got} == plain_languages(rows) and len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    told = {i: lang for i, _, lang in rows}
    judged = [r for r in got if r.held_out and told[r.doc_id] is not None]
    assert sum(r.lang_pred == told[r.doc_id] for r in judged) >= 0.9 * len(judged)


def check_tree(rows, first, n, slack):
    """The shards from ``first`` on split their rows as a k-d tree does, node by node."""
    if n == 1:
        assert {r["shard"] for r in rows} <= {first}
        return
    left = n // 2
    if rows:
        widths = [max(r[d] for r in rows) - min(r[d] for r in rows) for d in ("d0", "d1", "d2")]
        axis = f"d{widths.index(max(widths))}"
        ordered = sorted(rows, key=lambda r: (r[axis], r["text_hash"], r["doc_id"]))
        sides = [r["shard"] >= first + left for r in ordered]
        assert sides == sorted(sides)  # one cut in the order of the widest dimension
        taken = sum(r["size"] for r in ordered if r["shard"] < first + left)
        goal = sum(r["size"] for r in rows) * left / n
        assert abs(taken - goal) <= max(slack, max(r["size"] for r in rows) / 2 + 1)
    check_tree([r for r in rows if r["shard"] < first + left], first, left, slack)
    check_tree([r for r in rows if r["shard"] >= first + left], first + left, n - left, slack)


def check_shards(docs, n):
    dimensions = ["d0", "d1", "d2"]
    points = {r.doc_id: r.asDict() for r in shards.scaled(shards.sized(docs), dimensions).collect()}
    placed = {r.doc_id: r.shard for r in shards.shard_documents(docs, n, Staging(docs.sparkSession)).collect()}
    assert placed.keys() == points.keys()
    rows = [points[i] | {"shard": shard} for i, shard in placed.items()]
    check_tree(rows, 0, n, shards.TOLERANCE * sum(r["size"] for r in rows) / n)


def test_shards_are_leaves_of_a_kd_tree(spark):
    check_shards(spark.read.parquet(f"{SMALL}/documents.parquet"), 24)


def test_shards_of_copies_and_uneven_texts(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.choice((3, 30, 300))) for _ in range(150)] + ["the same text"] * 120 + ["", "x" * 40000]
    check_shards(documents(spark, texts), 7)
