"""Evaluation texts leaking into training text: SimHash of content-chosen windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from courtspark.session import stored

#: A run of this many characters in common is a leak.
RUN = 60
#: Characters of a fingerprinted window and of its shingles; of RUN characters the window that starts at the least anchor hash is taken.
WINDOW, SHINGLE, ANCHOR = 40, 5, 12
STARTS = RUN - WINDOW + 1
#: Fingerprints within this Hamming distance are found for certain: they agree in one of RADIUS + 1 blocks of 16 bits.
RADIUS, BLOCKS, BLOCK_BITS = 3, 4, 16
SIMILAR = 0.8
#: Item characters that are indexed and sent out at once; more items make more passes over the corpus.
ITEM_CHARS = 4_000_000
_CHUNK, _GAP = 300_000, 2 * RUN
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@cache
def _letters_and_digits() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), dtype=bool, count=0x110000)


def reduced(text: str | None) -> np.ndarray:
    """Code points of the text case-folded, decomposed (NFKD) and reduced to letters and digits."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    folded = text.lower() if text.isascii() else unicodedata.normalize("NFKD", text.casefold())
    codes = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes[_letters_and_digits()[codes]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k codes from each position on."""
    h = np.zeros(len(codes) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(h)]
    return _mixed(h)


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + width] for every i, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


@cache
def _spread() -> np.ndarray:
    """Byte -> its 8 bits in 8 lanes of a 64-bit word."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return (bits.astype(np.uint64) << (8 * np.arange(8)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)


def window_fingerprints(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, 64-bit SimHashes) of the windows chosen by content.

    Of each STARTS neighbouring starts the one with the least anchor hash is chosen, all of them on a tie. A run of RUN
    characters has exactly STARTS whole windows, so two texts that share one choose a window in common.
    """
    if len(codes) < RUN:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    codes = codes.astype(np.uint64)
    anchor = _grams(codes, ANCHOR)[: len(codes) - WINDOW + 1]
    least = _sliding(anchor, STARTS, np.minimum)
    edge = np.zeros(STARTS - 1, dtype=np.uint64)
    reach = _sliding(np.concatenate([edge, least, edge]), STARTS, np.maximum)
    starts = np.flatnonzero(reach[: len(anchor)] == anchor)
    shingles = _grams(codes, SHINGLE)
    n = WINDOW - SHINGLE + 1
    table, prints = _spread(), np.zeros(len(starts), dtype=np.uint64)
    for byte in range(8):
        lanes = np.zeros(len(shingles) + 1, dtype=np.uint64)
        np.cumsum(table[(shingles >> np.uint64(8 * byte)).astype(np.uint8)], out=lanes[1:])  # lanes may overflow, their differences don't
        counts = lanes[starts + n] - lanes[starts]
        for bit in range(8):
            set_ = ((counts >> np.uint64(8 * bit)) & np.uint64(255)) > n // 2
            prints |= set_.astype(np.uint64) << np.uint64(8 * byte + bit)
    return starts.astype(np.int64), prints


@dataclass
class ItemIndex:
    """Windows of the items by each block of their fingerprints (offsets into a list of windows)."""

    ids: list
    codes: np.ndarray
    prints: np.ndarray
    place: np.ndarray
    owner: np.ndarray
    lists: list[np.ndarray]
    offsets: list[np.ndarray]

    @classmethod
    def of(cls, items: list[tuple[object, str]]) -> ItemIndex:
        gap = np.full(RUN, 0xFFFFFFFE, dtype=np.uint32)
        parts, places, owners, prints, at = [gap], [], [], [], RUN
        for no, (_, text) in enumerate(items):
            codes = reduced(text)
            starts, marks = window_fingerprints(codes)
            parts += [codes, gap]
            places.append(starts + at)
            owners.append(np.full(len(starts), no))
            prints.append(marks)
            at += len(codes) + RUN
        marks = np.concatenate(prints) if prints else np.empty(0, dtype=np.uint64)
        lists, offsets = [], []
        for b in range(BLOCKS):
            value = _block(marks, b)
            lists.append(np.argsort(value, kind="stable"))
            offsets.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << BLOCK_BITS))]))
        none = np.empty(0, dtype=np.int64)
        return cls([i for i, _ in items], np.concatenate([*parts, np.full(WINDOW, 0xFFFFFFFE, dtype=np.uint32)]), marks, np.concatenate([none, *places]), np.concatenate([none, *owners]), lists, offsets)

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into prints, item window) of all pairs within RADIUS, each once."""
        asks, wins = [], []
        for b in range(BLOCKS):
            value = _block(prints, b)
            first, count = self.offsets[b][value], self.offsets[b][value + 1] - self.offsets[b][value]
            ask = np.repeat(np.arange(len(prints)), count)
            within = np.arange(len(ask)) - np.repeat(np.cumsum(count) - count, count)
            win = self.lists[b][np.repeat(first, count) + within]
            differ = prints[ask] ^ self.prints[win]
            near = np.bitwise_count(differ) <= RADIUS
            for earlier in range(b):  # found by an earlier block already
                near &= _block(differ, earlier) != 0
            asks.append(ask[near])
            wins.append(win[near])
        return np.concatenate(asks), np.concatenate(wins)


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    return ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


def shingle_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity by row of the shingles of two [rows, WINDOW] code arrays; a shingle weighs as often as it occurs."""
    rows, n = len(a), WINDOW - SHINGLE + 1
    row = np.repeat(np.arange(rows, dtype=np.uint64), n)
    keyed = []
    for x in (a, b):
        h = np.zeros((rows, n), dtype=np.uint64)
        for i in range(SHINGLE):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[:, i : i + n].astype(np.uint64)
        keyed.append(np.unique(_mixed(h.ravel()) ^ (row * _M2 + _M1), return_index=True, return_counts=True))
    (ka, ia, ca), (kb, _, cb) = keyed
    _, at, bt = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    shared = np.bincount(ia[at] // n, weights=np.minimum(ca[at], cb[bt]), minlength=rows)
    return shared / (2 * n - shared)


def leaks_in(codes: np.ndarray, base: np.ndarray, index: ItemIndex) -> tuple[np.ndarray, np.ndarray]:
    """(text number, item number) for texts laid end to end, RUN gap codes before and after each; base is the text number by position."""
    starts, prints = window_fingerprints(codes)
    starts, prints = starts[codes[starts] != 0xFFFFFFFF], prints[codes[starts] != 0xFFFFFFFF]
    distinct, inverse = np.unique(prints, return_inverse=True)
    ask, win = index.within_radius(distinct)
    none = np.empty(0, dtype=np.int64)
    if not len(ask):
        return none, none
    order = np.argsort(inverse, kind="stable")
    first = np.searchsorted(inverse[order], np.arange(len(distinct)))
    count = np.bincount(inverse, minlength=len(distinct))[ask]
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place, win = starts[order[np.repeat(first[ask], count) + k]], np.repeat(win, count)
    text, item, shift = base[place], index.owner[win], place - index.place[win]
    key = np.lexsort((shift, item, text))
    text, item, shift, place, win = text[key], item[key], shift[key], place[key], win[key]
    out_text, out_item = [none], [none]
    for lo in range(0, len(place), 50_000):
        p, q = place[lo : lo + 50_000], index.place[win[lo : lo + 50_000]]
        reach = np.arange(-RUN, WINDOW + RUN)
        mine, theirs = codes[np.clip(p[:, None] + reach, 0, len(codes) - 1)], index.codes[np.clip(q[:, None] + reach, 0, len(index.codes) - 1)]
        alike = shingle_similarity(mine[:, RUN : RUN + WINDOW], theirs[:, RUN : RUN + WINDOW]) >= SIMILAR
        same = mine == theirs
        run, most = np.zeros(len(p), dtype=np.int16), np.zeros(len(p), dtype=np.int16)
        for c in range(same.shape[1]):
            run = (run + 1) * same[:, c]
            most = np.maximum(most, run)
        leak = alike & (most >= RUN)
        out_text.append(text[lo : lo + 50_000][leak])
        out_item.append(item[lo : lo + 50_000][leak])
    return np.concatenate(out_text), np.concatenate(out_item)


def _laid(texts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gap = np.full(RUN, 0xFFFFFFFF, dtype=np.uint32)
    parts, base = [gap], [np.zeros(RUN, dtype=np.int64)]
    for no, codes in texts:
        parts += [codes, gap]
        base.append(np.full(len(codes) + RUN, no))
    return np.concatenate(parts), np.concatenate(base)


def leaked_numbers(texts: Iterator[str | None], index: ItemIndex) -> tuple[np.ndarray, np.ndarray]:
    """(text number, item number), each pair once, working through about _CHUNK characters at a time; long texts in overlapping parts."""
    found: list[np.ndarray] = []
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def settle() -> None:
        text, item = leaks_in(*_laid(held), index)
        if len(text):
            found.append(np.unique(np.stack([text, item], axis=1), axis=0))

    for no, text in enumerate(texts):
        codes = reduced(text)
        if len(codes) < RUN:
            continue
        for at in range(0, max(1, len(codes) - _GAP), _CHUNK - _GAP):
            held.append((no, codes[at : at + _CHUNK]))
            size += len(held[-1][1])
            if size >= _CHUNK:
                settle()
                held, size = [], 0
    if held:
        settle()
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=np.int64)
    return pairs[:, 0], pairs[:, 1]


def leaked_passages(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(doc_key, item_key), each once: document and item share a run of at least RUN reduced characters.

    Null, empty and shorter texts share nothing; repeated rows count once; keys may be of any type. Documents are never
    shuffled, exploded or gathered: a task reads its rows and returns pairs. Every shared run is found (windows are
    chosen alike in both texts, equal fingerprints agree in all blocks); candidates within the radius that are no such
    run fall to the exact check.
    """

    def search(texts: Iterator[str | None], index: ItemIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, item = leaked_numbers(texts, index)
        return text, item, np.ones(len(text))

    found = _in_passes(docs, doc_key, doc_text, items, item_key, item_text, item_chars, ItemIndex.of, search)
    return found.select("key", "item").distinct().select(F.col("key").alias(doc_key), F.col("item").alias(item_key))


def _in_passes(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, item_chars: int, build: Callable, search: Callable) -> DataFrame:
    """(key, item, value) that `search` finds in each text with the index of each block of items.

    The items are the stated query set. They are read as a stream in blocks of at most `item_chars` characters (or one
    item), each sent out as an index of that bounded size. Several blocks are worked through one after another: a pass
    is written to the shared folder and its index given up before the next one is built, so driver and executors hold
    one at a time.
    """
    spark = docs.sparkSession
    kinds = [df.schema[c].dataType for df, c in ((docs, doc_key), (items, item_key))]
    arrow = to_arrow_type(kinds[1])
    source = docs.select(F.col(doc_key).alias("key"), F.col(doc_text).alias("text")).where("key is not null and text is not null")

    def one(block: list[tuple[object, str]]) -> tuple[DataFrame, object]:
        sent = spark.sparkContext.broadcast(build(block))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = pa.array(sent.value.ids, arrow)
            for batch in batches:
                text, item, value = search((t.as_py() for t in batch.column("text")), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(text, pa.int64())), ids.take(pa.array(item, pa.int64())), pa.array(value, pa.float64())], ["key", "item", "value"])

        return source.mapInArrow(run, f"key {kinds[0].simpleString()}, item {kinds[1].simpleString()}, value double"), sent

    wanted = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(item_key, item_text).distinct()
    done: list[DataFrame] = []
    block, size = [], 0
    for key, text in wanted.toLocalIterator():
        if block and size + len(text) > item_chars:
            found, sent = one(block)
            done.append(stored(found))
            sent.destroy()
            block, size = [], 0
        block.append((key, text))
        size += len(text)
    last, _ = one(block)
    return reduce(DataFrame.unionByName, [*done, last])


# --- whole items, altered ---------------------------------------------------------------------------------------------

#: Fingerprints of item-sized windows within this distance are found for certain: they differ by at most WIDE // BLOCKS bits in one of the blocks.
WIDE = 15
#: Item lengths are told apart by steps of this ratio; windows start at every STRIDE-th part of their length.
STEP, STRIDE = 1.15, 8
#: Items and texts of fewer reduced characters are left to the search for runs.
LEAST = 100


def _lanes(codes: np.ndarray) -> list[np.ndarray]:
    """16 running sums of the bits of all shingle hashes, four 16-bit lanes each (they may overflow, differences of up to 65,535 don't)."""
    shingles = _grams(codes.astype(np.uint64), SHINGLE)
    spread = ((np.arange(16)[:, None] >> np.arange(4)) & 1).astype(np.uint64)
    table = (spread << (16 * np.arange(4)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    out = []
    for nibble in range(16):
        lane = np.zeros(len(shingles) + 1, dtype=np.uint64)
        np.cumsum(table[((shingles >> np.uint64(4 * nibble)) & np.uint64(15)).astype(np.int64)], out=lane[1:])
        out.append(lane)
    return out


def _prints(lanes: list[np.ndarray], starts: np.ndarray, length: int) -> np.ndarray:
    n = length - SHINGLE + 1
    prints = np.zeros(len(starts), dtype=np.uint64)
    for nibble, lane in enumerate(lanes):
        counts = lane[starts + n] - lane[starts]
        for bit in range(4):
            prints |= (((counts >> np.uint64(16 * bit)) & np.uint64(0xFFFF)) * np.uint64(2) > n).astype(np.uint64) << np.uint64(4 * nibble + bit)
    return prints


@cache
def _near_blocks() -> np.ndarray:
    """All 16-bit masks of at most WIDE // BLOCKS bits."""
    masks = np.arange(1 << BLOCK_BITS)
    return masks[np.bitwise_count(masks.astype(np.uint64)) <= WIDE // BLOCKS]


@dataclass
class WholeIndex:
    """Items by the class of their length, and within a class by every block value within reach of their fingerprint's block."""

    ids: list
    shingles: list[tuple[np.ndarray, np.ndarray]]
    lengths: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]

    @classmethod
    def of(cls, items: list[tuple[object, str]]) -> WholeIndex:
        codes = [reduced(text) for _, text in items]
        lengths = np.array([len(c) for c in codes], dtype=np.int64)
        at = np.array([_size_class(n) if n >= LEAST else -1 for n in lengths], dtype=np.int64)
        classes = {}
        for c in sorted(set(at[at >= 0].tolist())):
            member = np.flatnonzero(at == c)
            prints = np.concatenate([_prints(_lanes(codes[k]), np.zeros(1, dtype=np.int64), len(codes[k])) for k in member])
            near, lists, offsets = _near_blocks(), [], []
            for b in range(BLOCKS):
                value = (_block(prints, b)[:, None] ^ near).ravel()
                lists.append(np.repeat(np.arange(len(member)), len(near))[np.argsort(value, kind="stable")])
                offsets.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << BLOCK_BITS))]))
            classes[c] = member, prints, lists, offsets
        return cls([i for i, _ in items], [_weighted(c) if len(c) >= LEAST else None for c in codes], lengths, classes)


def _size_class(n: int) -> int:
    """The greatest power of STEP that isn't above n."""
    k = int(np.log(n) / np.log(STEP))
    return int(STEP**k)


def _weighted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(_grams(codes.astype(np.uint64), SHINGLE), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][x], b[1][y]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def altered_numbers(texts: Iterator[str | None], index: WholeIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, item number, greatest similarity) of texts with a window alike to a whole item, working through about _CHUNK characters at a time."""
    out: dict[tuple[int, int], float] = {}
    held: list[tuple[int, np.ndarray]] = []
    size, beyond = 0, 2 * int(index.lengths.max(initial=0))
    for no, text in enumerate(texts):
        codes = reduced(text)
        for at in range(0, len(codes), _CHUNK):  # long texts in parts that overlap by more than any item
            part = codes[at : at + _CHUNK + beyond]
            if len(part) >= LEAST:
                held.append((no, part))
                size += len(part)
            if size >= _CHUNK:
                _alike(held, index, out)
                held, size = [], 0
    if held:
        _alike(held, index, out)
    keys = sorted(out)
    return np.array([k for k, _ in keys], dtype=np.int64), np.array([i for _, i in keys], dtype=np.int64), np.array([out[k] for k in keys])


def _alike(texts: list[tuple[int, np.ndarray]], index: WholeIndex, out: dict[tuple[int, int], float]) -> None:
    codes = np.concatenate([c for _, c in texts])
    length = np.array([len(c) for _, c in texts])
    base = np.cumsum(length) - length
    lanes = _lanes(codes)
    for size, (member, prints, lists, offsets) in index.classes.items():
        step = size // STRIDE
        many = np.maximum(0, (length - size) // step + 1)
        of = np.repeat(np.arange(len(texts)), many)
        starts = base[of] + (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * step
        if not len(starts):
            continue
        asked = _prints(lanes, starts, size)
        hits: set[tuple[int, int]] = set()
        for b in range(BLOCKS):
            value = _block(asked, b)
            first, count = offsets[b][value], offsets[b][value + 1] - offsets[b][value]
            ask = np.repeat(np.arange(len(asked)), count)
            win = lists[b][np.repeat(first, count) + np.arange(len(ask)) - np.repeat(np.cumsum(count) - count, count)]
            near = np.bitwise_count(asked[ask] ^ prints[win]) <= WIDE
            hits.update(zip(ask[near].tolist(), win[near].tolist(), strict=True))
        for a, w in hits:
            item, text = int(member[w]), int(of[a])
            window = codes[starts[a] : min(starts[a] + index.lengths[item], base[text] + length[text])]
            same = weighted_jaccard(_weighted(window), index.shingles[item])
            key = texts[text][0], item
            if same >= SIMILAR and same > out.get(key, 0.0):
                out[key] = same


def altered_passages(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, item_chars: int = ITEM_CHARS // 20) -> DataFrame:
    """(doc_key, item_key, similarity): documents that hold a whole item, altered as it may be here and there.

    Windows of the item's size, laid over a document at every eighth of it, whose weighted character shingles are at
    least SIMILAR to the item's; the greatest similarity counts. Candidates are windows whose SimHash lies within WIDE
    bits of the item's, all of which are found. A window that is that similar may still have a fingerprint further off:
    recall is measured by a test. Items and texts under LEAST reduced characters have no rows, nor have null ones;
    repeated rows count once.
    """
    found = _in_passes(docs, doc_key, doc_text, items, item_key, item_text, item_chars, WholeIndex.of, altered_numbers)
    return found.groupBy("key", "item").agg(F.round(F.max("value"), 6).alias("similarity")).select(F.col("key").alias(doc_key), F.col("item").alias(item_key), "similarity")
