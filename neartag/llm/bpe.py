"""BPE encoding and decoding with a published vocabulary file (operator 2).

A word becomes a doubly linked list of symbols.  A priority queue holds the merges that
apply to neighbours, lowest rank first and leftmost on ties.  A popped merge whose symbols
have meanwhile changed is stale and skipped.  Decoding concatenates vocabulary strings, with
one space between them when the file names no decoder.

Null texts count as empty: no ids and an empty decoded text.  Rows are independent, so
repeated rows and ids, null ids and extra columns need no rule; a text of any length is
encoded whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from neartag.llm.common import Memo, id_and_text, slices


# Latin letters up to U+017F: in normal form, letters for every engine, in either case.
LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
SPACES = "\t-\r "
OTHER = re.compile(f"[^\\x00-\\x7f{LATIN}]")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def merge_symbols(ids: list[int], merges: dict[int, int], size: int) -> list[int]:
    """Apply merges to a list of ids, in place.

    ``merges`` maps left * size + right to rank * size + new id.  An entry of the queue is
    that number times the length, plus the position of the left symbol.
    """
    n = len(ids)
    pairs = [merges.get(left * size + right) for left, right in zip(ids, ids[1:])]
    queue = [merge * n + i for i, merge in enumerate(pairs) if merge is not None]
    if not queue:
        return ids
    heapq.heapify(queue)
    pop, push, get = heapq.heappop, heapq.heappush, merges.get
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while queue:
        merge, i = divmod(pop(queue), n)
        j = after[i]
        if ids[i] < 0 or j >= n or get(ids[i] * size + ids[j]) != merge:
            continue  # stale: a symbol has changed or is gone (-1)
        new = merge % size
        ids[i], ids[j] = new, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            found = get(new * size + ids[k])
            if found is not None:
                push(queue, found * n + i)
        k = before[i]
        if k >= 0:
            found = get(ids[k] * size + new)
            if found is not None:
                push(queue, found * n + k)
    return [x for x in ids if x >= 0]


def latin_pattern(split: str) -> re.Pattern:
    """The word pattern for text of ASCII and Latin letters only, for the faster engine."""
    names = {
        r"[^\s\p{L}\p{N}]": f"[^{SPACES}{LATIN}0-9]", r"[\p{L}]": f"[{LATIN}]", r"[\p{N}]": "[0-9]",
        r"\p{L}": f"[{LATIN}]", r"\p{N}": "[0-9]", r"\s": f"[{SPACES}]", r"\S": f"[^{SPACES}]"}
    for name, letters in names.items():
        split = split.replace(name, letters)
    return re.compile(split)


@dataclass
class Bpe:
    """Encoder and decoder of one vocabulary file whose words end in a suffix."""

    tokens: dict[int, str]
    ids: dict[str, int]
    merges: dict[int, int]
    size: int
    suffix: str
    special: dict[str, int]
    pattern: regex.Pattern
    latin: re.Pattern
    chunks: Memo = field(init=False)
    words: Memo = field(init=False)

    def __post_init__(self) -> None:
        letters = byte_letters()
        self.inner = [self.ids[letters[b]] for b in range(256)]
        self.final = [self.ids[letters[b] + self.suffix] for b in range(256)]
        self.numbers = {i: str(i) for i in self.tokens}
        # Two levels: "Word," and "word" share the work on their letters.
        self.words = Memo(self.encode_word, 400_000)
        self.chunks = Memo(self.encode_chunk, 200_000)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    @staticmethod
    def load(path: str) -> Bpe:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ids = dict(model["vocab"])
        tokens = {i: t for t, i in ids.items()} | {i: t for t, i in special.items()}
        size = max(tokens) + 1
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merges[ids[left] * size + ids[right]] = rank * size + ids[left + right]
        split = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # White space is the Unicode property, as in the library's own pattern engine.
        return Bpe(tokens, ids, merges, size, model["end_of_word_suffix"] or "", special,
                   regex.compile(split.replace(r"\s", r"\p{White_Space}")), latin_pattern(split))

    def encode_word(self, word: str) -> list[int]:
        letters = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in letters]
        symbols[-1] = self.final[letters[-1]]
        return merge_symbols(symbols, self.merges, self.size)

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a text without U+0020, at which no word and no normal form can join."""
        if OTHER.search(chunk) is None:
            found = self.latin.findall(chunk.lower())
        else:
            text = unicodedata.normalize("NFC", chunk)
            # Lower case letter by letter: a final sigma has no form of its own.
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
            found = self.pattern.findall(text)
        return tuple(chain.from_iterable(map(self.words.__getitem__, found)))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        start = 0
        for found in self.cut.finditer(text) if "<" in text else ():
            out += self.encode_plain(text[start:found.start()])
            out.append(self.special[found.group()])
            start = found.end()
        return out + self.encode_plain(text[start:] if start else text)

    def encode_plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.chunks.__getitem__, text.split(" "))))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """One vocabulary per Python worker and path."""
    return Bpe.load(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of every row of documents (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches):
            ids = [bpe.encode(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(map(len, ids), pa.int64()), pa.array(ids, schema.field("ids").type)], schema=schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array((bpe.decode(x or []) for x in batch["ids"].to_pylist()), pa.string())],
                ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Encode and decode every text in one pass over the rows.

    doc_id, n_tokens, ids (only ``with_ids``), ids_sha256 and decoded_sha256: digests of the
    decimal ids joined by a space and of the decoded text.
    """
    fields = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()),
              "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    if not with_ids:
        del fields["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches):
            counts, lists, of_ids, of_text = [], [], [], []
            for text in batch["text"]:
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                if with_ids:
                    lists.append(ids)
                of_ids.append(hashlib.sha256(" ".join(map(bpe.numbers.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            columns = {"doc_id": batch["doc_id"], "n_tokens": counts, "ids": lists, "ids_sha256": of_ids,
                       "decoded_sha256": of_text}
            yield pa.RecordBatch.from_arrays(
                [columns[k] if k == "doc_id" else pa.array(columns[k], t) for k, t in fields.items()], list(fields))

    schema = ", ".join(f"{k} {'array<int>' if k == 'ids' else 'string' if k.endswith('256') else 'long'}" for k in fields)
    return id_and_text(docs).mapInArrow(run, schema)
