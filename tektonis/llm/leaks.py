"""Documents that hold a passage of a held-out test item, whole or in part, with small alterations.

Texts are reduced to letters and digits in one form. Item-sized windows (a quarter of the item, so that a stretch of half of it holds many) are embedded by random walks: at each step a window yields the character under its pointer, and a random bit of step and character moves the pointer. Two windows at a small edit distance walk in step nearly always, so their embeddings differ in few places. Samples of places of several independent embeddings are the keys of a locality-sensitive hash. The keys of the items are a table of their own; every window of every document is looked up in a bitmap of them, and what is in it is joined with the table. Pairs that share a key are checked by the density of common q-grams and by an exact alignment.

The corpus is read once, however many items there are. Only the bitmap goes to the workers: it has at most 2 ** `map_bits` bits, and beyond the number of keys that fill it well more windows pass it and are sorted out by the join. Documents without a window in the bitmap go no further.

Neither the hash nor the density is a bound that loses nothing: the hash misses a stretch in which nearly every window is altered, and a density of 0.6 is what an alteration of one word in eight leaves if words have three characters or more on average. Recall is measured in the tests and in the README.

Defined results
    null, blank text                 no leak
    items below 48 characters        shorter windows, of 6 or 8 characters, and q-grams of 4
    items below 6 characters         only as a whole
    item that occurs in the corpus many times   every such document is reported
    copies of a document             each is reported
    very long text                   all its windows, in one pass; each dense part is aligned by itself
    repeated rows                    one result
    empty documents or items         empty result with the same columns
    extra columns                    ignored
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tektonis.runtime import cut, python_partitions, spread, too_big

WINDOWS = (24, 32, 48, 64, 96)
SHORT = (1, 2, 3, 4, 5, 6, 8, 12, 16)  # windows of items for which those are too long
WHOLE = 6  # shorter items are found only as a whole
PACE = 1.6  # steps of a walk per character of its window: the pointer stays inside
_UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ø": "oe", "å": "a", "æ": "ae", "œ": "oe"})
_TOKENS = re.compile(r"[^\W_]+")
_FOLD = 0x9E3779B1


def normal_form(text: str) -> tuple[str, list[int]]:
    """(letters and digits of a text in one form, places where a word begins); in scripts without spaces every character begins one."""
    s = unicodedata.normalize("NFKC", text).casefold()
    s = unicodedata.normalize("NFC", s).translate(_UMLAUTS)
    s = "".join(c for c in s if unicodedata.category(c) != "Cf") if re.search(r"[­​-‏⁠-⁤﻿]", s) else s
    parts = _TOKENS.findall(s)
    starts, at = [], 0
    for p in parts:
        if len(p) > 3 and ord(max(p)) > 0x0DFF:
            starts += range(at, at + len(p))
        else:
            starts.append(at)
        at += len(p)
    return "".join(parts), starts


def codes(s: str) -> np.ndarray:
    """Characters as 32-bit numbers."""
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)


def window_size(n: int) -> int:
    """The window of an item of n characters: a quarter of it, the next lower size there is, but six characters at least."""
    if n < WHOLE:
        return n
    return max((w for w in (*SHORT, *WINDOWS) if w <= n // 4), default=WHOLE) if n >= 4 * WHOLE else WHOLE


class Walks:
    """Random walks and samples; equal for equal parameters, so that every worker has the same ones."""

    def __init__(self, embeddings: int = 2, tables: int = 4, sample: float = 0.28, seed: int = 20240611):
        rng = np.random.default_rng(seed)
        self.steps = int(WINDOWS[-1] * PACE)
        self.bits = rng.integers(0, 2, size=(embeddings, self.steps, 256), dtype=np.int32)
        self.tables: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # (embedding, window, places, multipliers)
        for w in (*WINDOWS, *SHORT):
            steps = max(1, int(w * PACE))
            for e in range(embeddings):
                for _ in range(tables):
                    k = min(steps, max(10, min(26, int(steps * sample))))
                    self.tables.append((e, w, np.sort(rng.choice(steps, size=k, replace=False)), rng.integers(1, 2**63, size=k, dtype=np.uint64) | np.uint64(1)))
        self.embeddings = embeddings

    def keys(self, chars: np.ndarray, starts: np.ndarray, room: np.ndarray, windows=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(table, rows of starts, keys): for every table the keys of the windows that fit into their text."""
        sym = ((chars * np.uint32(_FOLD)) >> np.uint32(24)).astype(np.uint8)
        sym = np.concatenate([sym, np.zeros(self.steps + 1, np.uint8)])
        for e in range(self.embeddings):
            at = starts.astype(np.int64).copy()
            walk = np.empty((self.steps, len(starts)), np.uint8)
            for j in range(self.steps):
                c = sym[at]
                walk[j] = c
                at += self.bits[e, j][c]
            scaled = walk.astype(np.uint64) + np.uint64(1)
            for t, (emb, w, places, mult) in enumerate(self.tables):
                if emb != e or (windows is not None and w not in windows):
                    continue
                fits = room >= w
                if not fits.any():
                    continue
                key = np.full(len(starts), (t + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
                for p, m in zip(places, mult):
                    key += scaled[p] * m
                    key ^= key >> np.uint64(29)
                rows = np.flatnonzero(fits)
                key = key[rows]
                yield t, rows, key


def gram_size(n: int) -> int:
    """The length of the q-grams that an item of n characters is checked by."""
    return 6 if n >= 2 * WINDOWS[0] else 4


def gram_hashes(chars: np.ndarray, q: int = 6) -> np.ndarray:
    """A hash of every run of q characters."""
    if len(chars) < q:
        return np.array([], np.uint64)
    out = np.zeros(len(chars) - q + 1, np.uint64)
    for i in range(q):
        out = out * np.uint64(1_000_003) + chars[i : len(chars) - q + 1 + i].astype(np.uint64)
    return out


def dense(hits: np.ndarray, width: int, least: float) -> np.ndarray:
    """Where stretches of `width` q-grams begin of which the share `least` is met.

    A stretch of which a word in eight is altered keeps more: each altered word of six characters breaks eleven of its q-grams at most."""
    width = max(1, min(width, len(hits)))
    sums = np.concatenate([[0], np.cumsum(hits)])
    return np.flatnonzero(sums[width:] - sums[:-width] >= least * width)


def local_alignment(item: str, doc: str, penalty: int = 4) -> tuple[int, int, list[tuple[int, bool]]]:
    """(first, end, edits) of the item's part in the best local alignment, where an edit costs as much as `penalty` equal characters earn. An edit is its place in the item and whether it inserts."""
    a, b = codes(item), codes(doc)
    n, m = len(a), len(b)
    cols = np.arange(m + 1, dtype=np.int32) * penalty
    score = np.zeros((n + 1, m + 1), np.int32)
    for i in range(1, n + 1):
        prev = score[i - 1]
        step = np.where(b == a[i - 1], 1, -penalty).astype(np.int32)
        row = np.empty(m + 1, np.int32)
        row[0] = 0
        np.maximum(prev[:-1] + step, prev[1:] - penalty, out=row[1:])
        np.maximum(row, 0, out=row)
        # gaps in the item: the best start to the left, less its distance
        score[i] = np.maximum.accumulate(row + cols) - cols
    i, j = divmod(int(score.argmax()), m + 1)
    end, edits = i, []
    while i and j and score[i, j] > 0:
        s = score[i, j]
        if a[i - 1] == b[j - 1] and s == score[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
        elif s == score[i - 1, j - 1] - penalty:
            i, j = i - 1, j - 1
            edits.append((i, False))
        elif s == score[i - 1, j] - penalty:
            i -= 1
            edits.append((i, False))
        elif s == score[i, j - 1] - penalty:
            j -= 1
            edits.append((i, True))
        else:
            break
    return i, end, edits


def altered_pairs(places: list[int]) -> int:
    """How many words of two characters the edits take: two edits side by side alter one word."""
    n, at, room = 0, None, 0
    for p in sorted(places):
        if room and p - at <= 1:
            room -= 1
        else:
            n, at, room = n + 1, p, 1
    return n


def leaked(item: str, starts: list[int], doc: str, share: float = 0.5, altered: float = 0.13) -> bool:
    """Whether the document holds at least `share` of the item's characters in one stretch of which at most the share `altered` of the words is altered.

    What is inserted between two words, such as a list mark, alters none. In scripts without spaces two characters count as a word."""
    first, end, edits = local_alignment(item, doc)
    if end - first < share * len(item) - 1:
        return False
    begins = np.array(starts)
    of = lambda i: int(np.searchsorted(begins, i, "right")) - 1
    words = {of(i) for i, inserts in edits if not (inserts and i in set(starts))}
    n = of(end - 1) - of(first) + 1
    if n * 2.5 > end - first:  # characters rather than words
        return altered_pairs([i for i, _ in edits]) <= max(1, altered / 2 * (end - first))
    return len(words) <= max(1, altered * n)


@lru_cache(4096)
def _item_grams(item: str, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The q-grams of an item, in order and sorted."""
    g = gram_hashes(codes(item), q)
    return g, np.sort(g)


@lru_cache(8)  # pairs come in order of their documents
def _doc_grams(doc: str, q: int) -> tuple[np.ndarray, np.ndarray]:
    d = gram_hashes(codes(doc), q)
    return d, np.unique(d)


def dense_parts(item: str, doc: str, least: float = 0.6) -> Iterator[str]:
    """The parts of a document in which a stretch of half the item can lie, by the share of q-grams in common; one that goes on and on is given in overlapping pieces."""
    q = gram_size(len(item))
    (g, own), (d, mine) = _item_grams(item, q), _doc_grams(doc, q)
    if not len(g) or not len(d):
        if item in doc:
            yield item
        return
    half = len(item) // 2
    width = max(1, half - q)
    if q < 6:  # one edit of two characters breaks so many of the few q-grams of a short stretch
        least = max(0.2, 1 - (q + 1) / max(1, half - q + 1))
    at = np.searchsorted(mine, g)
    at[at == len(mine)] = 0
    if not len(dense(mine[at] == g, width, least)):
        return
    at = np.searchsorted(own, d)
    at[at == len(own)] = 0
    where = dense(own[at] == d, width, least)
    if not len(where):
        return
    reach = len(item) + q
    breaks = np.flatnonzero(np.diff(where) > reach)
    for first, last in zip(np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(where) - 1]])):
        a, b = max(0, int(where[first]) - reach), int(where[last]) + 2 * reach
        step = 4 * reach
        for x in range(a, max(a + 1, b - 2 * reach), step):
            yield doc[x : min(b, x + step + 2 * reach)]


def holds(item: str, starts: list[int], doc: str, share: float = 0.5, altered: float = 0.13) -> bool:
    """Whether a document in one form holds a stretch of an item (see leaked)."""
    if len(item) < WHOLE:
        return item in doc
    return any(leaked(item, starts, part, share, altered) for part in dense_parts(item, doc))


def item_forms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, form, starts, window) of the items that have any letter or digit."""
    held = items.select(F.col(item).cast("bigint").alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()

    def form(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(i, *normal_form(t)) for i, t in zip(pdf["item"], pdf["text"])]
            yield pd.DataFrame([(i, s, f, window_size(len(s))) for i, s, f in got if s], columns=["item", "form", "starts", "window"])

    return held.mapInPandas(form, "item bigint, form string, starts array<int>, window int")


def item_keys(forms: DataFrame) -> DataFrame:
    """(item, k): the keys of the windows of each item."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walks = Walks()
        for pdf in batches:
            items, found = [np.array([], np.int64)], [np.array([], np.uint64)]
            for i, s, first, w in zip(pdf["item"], pdf["form"], pdf["starts"], pdf["window"]):
                at = np.asarray(first, np.int64)
                at = at[len(s) - at >= w]
                for _, rows, key in walks.keys(codes(s), at, np.full(len(at), w), {w}) if len(at) else ():
                    items.append(np.full(len(rows), i))
                    found.append(key)
            yield pd.DataFrame({"item": np.concatenate(items), "k": np.concatenate(found).view(np.int64)})

    return forms.mapInPandas(keys, "item bigint, k bigint").distinct()


def key_bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Two bits for every key, or-ed together where the keys are; what comes to the driver are at most 2 ** (bits - 6) words."""
    mask = (1 << bits) - 1
    places = keys.select(F.explode(F.array(F.col("k").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("k", 32).bitwiseAND(F.lit(mask)))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("v")).toArrow()
    out = np.zeros(1 << max(0, bits - 6), np.uint64)
    out[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    return out


def _in_bitmap(bitmap: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)

    def has(p: np.ndarray) -> np.ndarray:
        return (bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0

    seen = has(keys & mask)
    seen[seen] = has((keys[seen] >> np.uint64(32)) & mask)
    return seen


def _marked(texts: list[str], bitmap: np.ndarray, bits: int, walks: Walks, windows: set[int]) -> list[tuple[str, np.ndarray]]:
    """(form, its keys that are in the bitmap) of each text."""
    forms, chars, starts, room, owner, base = [], [], [], [], [], 0
    for n, text in enumerate(texts):
        s, first = normal_form(text)
        forms.append(s)
        if s:
            f = np.array(first, np.int64)
            chars.append(codes(s))
            starts.append(f + base)
            room.append(len(s) - f)
            owner.append(np.full(len(f), n))
            base += len(s)
    who, what = [np.array([], np.int64)], [np.array([], np.uint64)]
    if starts:
        own = np.concatenate(owner)
        for _, rows, key in walks.keys(np.concatenate(chars), np.concatenate(starts), np.concatenate(room), windows):
            hit = _in_bitmap(bitmap, bits, key)
            who.append(own[rows[hit]])
            what.append(key[hit])
    o, k = np.concatenate(who), np.concatenate(what)
    order = np.argsort(o, kind="stable")
    cuts = np.searchsorted(o[order], np.arange(len(texts) + 1))
    return [(s, np.unique(k[order][a:b])) for s, a, b in zip(forms, cuts, cuts[1:])]


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = 0.5, altered: float = 0.13, map_bits: int = 27, send_limit: int = 2_000_000) -> DataFrame:
    """(key, item), one row for each document and item of which it holds a stretch.

    The items' keys, and their texts, are broadcast up to `send_limit` rows; beyond, they are joined by a shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()), "key")
    forms = cut(item_forms(items, item, item_text))
    keys = cut(item_keys(forms.repartition(python_partitions(docs.sparkSession), "item")))
    bits = min(map_bits, max(16, (16 * keys.count()).bit_length()))
    bitmap = docs.sparkSession.sparkContext.broadcast(key_bitmap(keys, bits))
    windows = {r.window for r in forms.select("window").distinct().collect()}  # at most one for each window size

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walks = Walks()
        for pdf in batches:
            chunk, size = [], 0
            ends = [*range(1, len(pdf) + 1)]
            for end, k, t in zip(ends, pdf["key"], pdf["text"]):
                chunk.append((k, t))
                size += len(t)
                if size > 400_000 or end == len(pdf):
                    got = _marked([t for _, t in chunk], bitmap.value, bits, walks, windows)
                    out = [(k, s, ks.view(np.int64)) for (k, _), (s, ks) in zip(chunk, got) if len(ks)]
                    yield pd.DataFrame(out, columns=["key", "form", "ks"])
                    chunk, size = [], 0

    near = rows.mapInPandas(look, f"key {kind}, form string, ks array<bigint>")
    near = cut(near.withColumn("doc", F.xxhash64("key", "form")))
    few = lambda df: df if too_big(df, send_limit) else F.broadcast(df)
    pairs = near.select("doc", F.explode("ks").alias("k")).distinct().join(few(keys), "k").select("doc", "item").distinct()
    both = pairs.join(near.select("doc", "key", F.col("form").alias("text")).distinct(), "doc").join(few(forms.drop("window")), "item")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [holds(s, list(f), t, share, altered) for s, f, t in zip(pdf["form"], pdf["starts"], pdf["text"])]
            yield pdf.loc[np.array(ok, bool), ["key", "item"]]

    found = both.select("key", "item", "text", "form", "starts").mapInPandas(verify, f"key {kind}, item bigint")
    return found.distinct().select(F.col("key").alias(key), F.col("item").alias(item))
