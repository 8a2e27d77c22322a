"""Encoding of a corpus with a public byte-level BPE; long texts in parallel, joined by tree concatenation."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: how this vocabulary's words are split before encoding.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of an unsplit run that are encoded at once, and of a text that one task takes.
RUN, SPREAD = 16, 4_000_000


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_run(enc: tiktoken.Encoding, raw: bytes) -> list[int]:
    """Ids of bytes that the pattern doesn't split."""
    return enc._encode_single_piece(raw) if raw else []


def join_ids(enc: tiktoken.Encoding, left: list[int], right: list[int], window: int = 4) -> list[int]:
    """The ids of one unsplit run from those of its two parts.

    Re-encodes a window around the join and widens it until both edges agree: an id sequence is the encoding of its
    bytes exactly if each two neighbours encode to themselves, and inside the parts and the window they do already.
    """
    if not left or not right:
        return left + right
    while True:
        k, m = min(window, len(left)), min(window, len(right))
        middle = encode_run(enc, enc.decode_bytes(left[-k:]) + enc.decode_bytes(right[:m]))
        fits_left = k == len(left) or _neighbours(enc, left[-k - 1], middle[0])
        fits_right = m == len(right) or _neighbours(enc, middle[-1], right[m])
        if fits_left and fits_right:
            return left[: len(left) - k] + middle + right[m:]
        window *= 2


def _neighbours(enc: tiktoken.Encoding, a: int, b: int) -> bool:
    return encode_run(enc, enc.decode_bytes([a]) + enc.decode_bytes([b])) == [a, b]


def join_tree(enc: tiktoken.Encoding, parts: list[list[int]]) -> list[int]:
    while len(parts) > 1:
        parts = [join_ids(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def segments(text: str, run: int, size: int) -> Iterator[tuple[bool, bool, str]]:
    """(is part of an unsplit run, continues the run before, text): pieces of about `size` characters.

    Runs of more than `run` characters that the pattern doesn't split stand alone, cut anywhere each `size`. The rest is
    cut after a word and before the next one, where the pattern can't see across.
    """
    start = end = last = 0
    for m in regex.finditer(PATTERN, text):
        if m.end() - m.start() > run:
            # white space before a word is split with regard to it: its last piece stands alone
            apart = last if m.start() and text[m.start() - 1].isspace() else m.start()
            yield from ((False, False, text[a:b]) for a, b in ((start, max(start, apart)), (max(start, apart), m.start())) if a < b)
            for at in range(m.start(), m.end(), size):
                yield True, at > m.start(), text[at : min(at + size, m.end())]
            start = m.end()
        elif m.start() - start >= size and end == m.start() and not text[m.start() - 1].isspace():
            yield False, False, text[start : m.start()]
            start = m.start()
        last, end = m.start(), m.end()
    if start < len(text):
        yield False, False, text[start:]


_SPACES = re.compile(r"\s{%d,}" % (RUN + 1))


def _may_be_long(text: str, run: int) -> bool:
    """Whether some unsplit run may have more than `run` characters: no word between spaces is shorter than a run inside it."""
    return max(map(len, text.split()), default=0) >= run or len(text) - len(text.strip()) > run or bool((_SPACES if run == RUN else re.compile(r"\s{%d,}" % (run + 1))).search(text))


def encode_unsplit(enc: tiktoken.Encoding, text: str, run: int) -> list[int]:
    """Ids of a run that the pattern doesn't split: pieces of `run` characters encoded apart, then joined as a tree."""
    return join_tree(enc, [encode_run(enc, text[at : at + run].encode()) for at in range(0, len(text), run)])


def encode_text(enc: tiktoken.Encoding, text: str | None, run: int = RUN) -> list[int]:
    """Ids of one text; null and empty give none. Runs of more than `run` characters are encoded by tree concatenation."""
    if not text:
        return []
    if not _may_be_long(text, run):
        return enc.encode_ordinary(text)
    out: list[int] = []
    for unsplit, _, part in segments(text, run, len(text)):
        out += encode_unsplit(enc, part, run) if unsplit else enc.encode_ordinary(part)
    return out


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str, run: int = RUN, spread: int = SPREAD) -> DataFrame:
    """(key, ids array<int>): one row per row of `docs`; null and empty texts give an empty list.

    No special tokens: text that spells one is ordinary text. Every unsplit run of more than `run` characters (in
    scripts without spaces nearly every clause) is encoded in pieces and joined by the tree. Rows stay where they are;
    only a text of more than `spread` characters, too much for one task, is cut into pieces of that size that other
    tasks encode the same way, joined by the same tree. Ids are the same at any `run` and `spread`. Repeated rows give
    repeated results.
    """
    key_type = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    is_long = F.coalesce(F.length("text") > spread, F.lit(False))

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids = pa.array([encode_text(enc, t, run) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids], ["key", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column("text").to_pylist()):
                for no, (unsplit, more, part) in enumerate(segments(t, spread, spread)):
                    kept = [batch.column(c).slice(i, 1) for c in ("key", "mark", "copies")]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([no], pa.int32()), pa.array([unsplit]), pa.array([more]), pa.array([part])], ["key", "mark", "copies", "no", "unsplit", "more", "part"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids = [encode_unsplit(enc, p, run) if u else encode_text(enc, p, run) for u, p in zip(batch.column("unsplit").to_pylist(), batch.column("part").to_pylist(), strict=True)]
            keep = ["key", "mark", "copies", "no", "more"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids = [_assemble(enc, [(p["more"], p["ids"]) for p in parts]) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), pa.array(ids, pa.list_(pa.int32()))], ["key", "copies", "ids"])

    whole = base.where(~is_long).mapInArrow(here, f"key {key_type}, ids array<int>")
    long = base.where(is_long).groupBy("key", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("mark", F.xxhash64("text"))
    cols = f"key {key_type}, mark long, copies long, no int, "
    pieces = long.select("key", "mark", "copies", "text").mapInArrow(split, cols + "unsplit boolean, more boolean, part string").repartition("key", "mark", "no")
    parts = pieces.mapInArrow(encode, cols + "more boolean, ids array<int>").groupBy("key", "mark", "copies").agg(F.sort_array(F.collect_list(F.struct("no", "more", "ids"))).alias("parts"))
    joined = parts.select("key", "copies", "parts").mapInArrow(assemble, f"key {key_type}, copies long, ids array<int>")
    joined = joined.select("key", "ids", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n")).drop("_n")
    return whole.unionByName(joined).withColumnRenamed("key", key)


def _assemble(enc: tiktoken.Encoding, parts: list[tuple[bool, list[int]]]) -> list[int]:
    """Ids of a text from those of its segments: parts of one run are joined as a tree, others follow each other."""
    out: list[int] = []
    k = 0
    while k < len(parts):
        stop = k + 1
        while stop < len(parts) and parts[stop][0]:
            stop += 1
        out += join_tree(enc, [list(ids) for _, ids in parts[k:stop]])
        k = stop
    return out
