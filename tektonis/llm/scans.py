"""Repair of text read from scanned pages: running headers, page numbers, words broken over line ends, misread characters.

The lexicon is the corpus itself: every word with its frequency, and every pair of neighbouring words. A symmetric-delete index (each word, and its forms with one character for two that are confused, under its prefix with two characters left out and its length) joins rare words with frequent ones; a weighted edit distance, in which the usual confusions of a reader of scans and those that the corpus shows cost little, measures the candidates; the neighbours' counts choose between them.

All counts are distributed sums over all pages. Words are matched as distinct words, never per occurrence, so a hot word costs no more than a rare one, and repairs are joined back to their places.

Defined results
    null, empty and blank texts     no fault
    JSON object or array            no fault; what merely begins like one is a text
    a single line                   no header and no page number: the value itself may be a number
    null page header                the titles of the scan's other pages serve; without any, only repeated headings are found
    null printed page               page numbers only where dressed as such
    very long text                  one linear pass; no length limit
    ties between candidates         the more frequent word, then the first in code point order
    repeated rows                   one result
    empty table                     empty result with the same columns
    extra columns                   ignored
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tektonis.runtime import cut, python_partitions, too_big

# Characters that a reader of scans takes for one another, as (what is written, what is read).
CONFUSIONS = (
    ("m", "rn"), ("n", "ri"), ("w", "vv"), ("d", "cl"), ("h", "li"), ("u", "ii"), ("ü", "ii"), ("ü", "u"), ("ö", "o"), ("ä", "a"),
    ("e", "c"), ("c", "e"), ("h", "b"), ("b", "h"), ("t", "l"), ("l", "t"), ("i", "l"), ("l", "i"), ("l", "1"), ("i", "1"), ("I", "l"), ("l", "I"),
    ("a", "o"), ("o", "a"), ("u", "n"), ("n", "u"), ("f", "t"), ("t", "f"), ("r", "n"), ("n", "r"), ("s", "5"), ("S", "5"), ("5", "S"), ("O", "0"), ("o", "0"), ("0", "O"), ("0", "o"),
    ("B", "8"), ("8", "B"), ("2", "Z"), ("Z", "2"), ("1", "l"), ("1", "I"), ("6", "b"), ("g", "q"), ("q", "g"), ("ß", "B"), ("ß", "b"), ("G", "6"), ("D", "0"), ("g", "9"), ("rn", "m"), ("ri", "n"), ("vv", "w"), ("cl", "d"), ("li", "h"),
    ("E", "F"), ("F", "E"), ("C", "G"), ("G", "C"), ("K", "R"), ("y", "v"), ("v", "y"), ("i", "j"), ("s", "a"), ("in", "m"), ("m", "in"), ("ni", "m"), ("m", "ni"), ("fi", "h"), ("k", "lc"), ("K", "lC"),
)
CHEAP = 0.4
_COST = {(a, b): CHEAP for a, b in CONFUSIONS}
_AS_DIGIT = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "|": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "B": "8", "b": "6", "g": "9", "q": "9"})

HYPHENS = "-‐‑¬­–"
_BREAK = re.compile(rf"([^\W\d_][\w'’./]*(?:-[\w]+)*?)[{HYPHENS}]\s*$")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'„“”‚‘’«»‹›()[]{}<>.,;:!?…*•_|=~"
# Words that stand before a page number, and between it and the number of pages.
PAGE_WORDS, OF_WORDS = ("Seite", "Blatt", "Page", "Sheet", "Bl", "Pag", "S", "p"), ("von", "of", "aus")
_PAGE = re.compile(r"^[\W_]*(?:(?P<word>\w{1,7})\b\.?\s+|(?P<tight>[^\W\d_]{1,5})\.?\s*)?(?P<n>[\dOoIlZSBz|]{1,5})(?P<of>\s*(?:/|\b(?P<between>\w{2,4})\b)\s*[\dOoIlZSBz|]{1,5})?[\W_]*$")
_SECTION = re.compile(r"^\s*(?P<sec>[\dlIOoSZB]{1,2}(?:[.,][\dlIOoSZB]{1,2}){1,3})\.?\s+(?P<title>\S.*)$")
_NUMBER_STARTS = frozenset("0123456789lIOoSZB([-–—_|")
_CONJUNCTIONS = {"und", "oder", "bis", "sowie", "bzw", "bzw.", "als", "noch", "and", "or", "to"}


def is_word(w: str) -> bool:
    return any(c.isalpha() for c in w)


def weighted_distance(read: str, meant: str, limit: float = 2.2, costs: dict[tuple[str, str], float] = _COST) -> float:
    """Edit distance from a read word to the word meant; confusions cost little, also those of one character with two. `limit` + 1 where it is above the limit."""
    n, m = len(read), len(meant)
    big = limit + 1
    if abs(n - m) > 3:
        return big
    d = [[big] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    before = 0.0
    for i in range(n + 1):
        row = d[i]
        best = big
        for j in range(max(0, i - 4), min(m, i + 4) + 1):
            at = row[j]
            if i and j and read[i - 1] == meant[j - 1] and d[i - 1][j - 1] < at:
                at = d[i - 1][j - 1]
            if i and j:
                c = d[i - 1][j - 1] + costs.get((meant[j - 1], read[i - 1]), 1.0)
                at = c if c < at else at
            if i and d[i - 1][j] + 1 < at:
                at = d[i - 1][j] + 1
            if j and row[j - 1] + 1 < at:
                at = row[j - 1] + 1
            if i > 1 and j and (c := costs.get((meant[j - 1], read[i - 2 : i]))) is not None and d[i - 2][j - 1] + c < at:
                at = d[i - 2][j - 1] + c
            if i and j > 1 and (c := costs.get((meant[j - 2 : j], read[i - 1]))) is not None and d[i - 1][j - 2] + c < at:
                at = d[i - 1][j - 2] + c
            row[j] = at
            best = at if at < best else best
        if best > limit and before > limit:
            return big  # a confusion reaches back two characters, no farther
        before = best
    return min(d[n][m], big)


def _means(word: str, known: tuple[str, ...]) -> bool:
    """Whether a word is one of the known ones, or a misreading of one of three characters or more."""
    forms = [f for k in known for f in (k, k.lower(), k.upper())]
    return word in forms or any(len(f) > 2 and abs(len(word) - len(f)) <= 2 and weighted_distance(word, f, 1.0) <= 0.9 for f in forms)


def is_record(value: str) -> bool:
    """Whether a value is a JSON object or array rather than scanned text."""
    if value.lstrip()[:1] not in ("{", "["):
        return False
    try:
        return isinstance(json.loads(value), dict | list)
    except (ValueError, RecursionError):
        return False


def header_key(line: str) -> str:
    """A line without figures, marks, case and spacing, with look-alikes folded: equal for all prints of a running header."""
    s = line.lower().replace("8", "b").replace("0", "o").replace("1", "l").replace("5", "s")
    s = re.sub(r"[^a-zäöüß]+", "", s)
    for a, b in (("rn", "m"), ("ri", "n"), ("vv", "w"), ("i", "l"), ("t", "l"), ("c", "e"), ("b", "h"), ("o", "a"), ("f", "l"), ("u", "n"), ("ß", "ss")):
        s = s.replace(a, b)
    return s


def _strip_page(line: str, page: int | None) -> str:
    """A header line without the page number at its beginning or end."""
    s = line.strip()
    if page is not None:
        for m in (re.match(r"^\W*([\dOoIlZSB|]{1,5})\b\W*\s", s), re.search(r"\s\W*([\dOoIlZSB|]{1,5})\W*$", s)):
            if m and m[1].translate(_AS_DIGIT) == str(page):
                s = (s[: m.start()] + " " + s[m.end() :]).strip()
    return s


def page_number(line: str, page: int | None) -> bool:
    """Whether a line holds the page number and nothing else."""
    m = _PAGE.match(line)
    word = m and (m["word"] or m["tight"])
    if not m or not any(c.isdigit() for c in m["n"]) and not word or word and not _means(word, PAGE_WORDS) or m["between"] and not _means(m["between"], OF_WORDS):
        return False
    n = m["n"].translate(_AS_DIGIT)
    if page is not None:
        return n == str(page) and (word is not None or m["of"] is not None or not re.search(r"[,%°]", line))
    return word is not None or m["of"] is not None or bool(re.match(r"^\s*[-–—_\[(]", line))


def classify(lines: list[str], titles: tuple[str, ...], page: int | None, known: frozenset[str] | set[str]) -> list[str]:
    """'header', 'page_no', 'blank' or 'text' for each line of a value."""
    out = []
    keys = [header_key(t) for t in titles if t and len(t) > 3]
    for line in lines:
        if not line.strip():
            out.append("blank")
            continue
        if len(lines) > 1 and page_number(line, page):
            out.append("page_no")
            continue
        kind = "text"
        if len(lines) > 1:
            core = _strip_page(line, page)
            key = header_key(core)
            m = _SECTION.match(core)
            if any(key and k and (key == k or len(key) > 5 and abs(len(key) - len(k)) < 3 and _near(key, k)) for k in keys) or m and header_key(m["title"]) in known:
                kind = "header"
        out.append(kind)
    return out


def _near(a: str, b: str) -> bool:
    """Whether two header keys differ in no more than a tenth of their characters, two at least."""
    limit = max(2, len(a) // 10)
    cuts = [len(a) * i // (limit + 1) for i in range(limit + 2)]
    if not any(a[i:j] in b for i, j in zip(cuts, cuts[1:])):
        return False  # so many edits leave one of these pieces whole
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        if min(cur) > limit:
            return False
        prev = cur
    return prev[-1] <= limit


def words_of(lines: list[str], kinds: list[str]) -> list[tuple[str, int, bool, bool, str]]:
    """(word, line from 1, broken, kept hyphen possible, second half) of the text lines; a word broken over a line end comes once, at its first half."""
    out: list[tuple[str, int, bool, bool, str]] = []
    carry: tuple[str, int] | None = None
    for n, (line, kind) in enumerate(zip(lines, kinds), 1):
        if kind == "blank":
            continue
        if kind != "text":
            continue
        tokens = _TOKEN.findall(line)
        if carry and tokens:
            head, at = carry
            second = tokens[0].strip(_EDGE)
            first = head.lstrip(_EDGE)
            if second.lower() in _CONJUNCTIONS or not second[:1].isalpha():
                out.append((first + "-", at, False, False, ""))
            else:
                out.append((first, at, True, second[:1].isupper(), second))
                tokens = tokens[1:]
        elif carry:
            continue
        carry = None
        m = _BREAK.search(line) if tokens and tokens[-1][-1] in HYPHENS else None
        # a hyphen alone, after a space, is a dash
        if m and (tokens[-1].rstrip(HYPHENS) or len(tokens) > 1):
            last = tokens[-1] if tokens[-1].rstrip(HYPHENS) else tokens[-2]
            if tokens[-1].rstrip(HYPHENS) and tokens[-1] != tokens[-1].rstrip(HYPHENS):
                carry = (last.rstrip(HYPHENS), n)
                tokens = tokens[:-1]
        out += [(w, n, False, False, "") for w in (t.strip(_EDGE) for t in tokens) if w]
    if carry:
        out.append((carry[0].lstrip(_EDGE), carry[1], False, False, ""))
    return out


# --- numbers and codes ----------------------------------------------------------------------------------------------

# Words that a figure stands before.
_COUNTED = {"mm", "cm", "m", "km", "°C", "%", "Monaten", "Monate", "Tage", "Tagen", "Lagen", "m²", "W/(m²K)"}
_NUMERIC = re.compile(r"^[\dOoIlZSB]+(?:[.,/][\dOoIlZSB]+)*$")
_CODE = re.compile(r"^([A-Z0-9]{1,3})-([\dOoIlZSB]+)$")


def repaired_number(w: str, after: str = "") -> str | None:
    """A figure with its misread digits put right; None if the word is no figure or has none. A figure without any digit left is known by the unit after it."""
    m = _CODE.match(w)
    if m and any(c.isdigit() for c in m[2]) and len(m[2]) > 1:
        head = m[1].translate(str.maketrans("0158", "OISB"))
        got = f"{head}-{m[2].translate(_AS_DIGIT)}"
        return got if got != w else None
    if _NUMERIC.match(w) and (any(c.isdigit() for c in w) or after in _COUNTED) and not w.isdigit():
        got = w.translate(_AS_DIGIT)
        return got if got != w else None
    return None


# words of digits and look-alikes with a letter among them
_FIGURE = re.compile(r"^(?=.*[A-Za-z])([A-Z0-9]{1,3}-)?[0-9OoIlZSB.,/]+$")


# --- Spark ----------------------------------------------------------------------------------------------------------


# confusions of one character with two, as (what is read, one character in its place)
_FOLDS = tuple(dict.fromkeys((b, a) for a, b in CONFUSIONS if len(b) == 2)) + tuple(dict.fromkeys((a, b) for a, b in CONFUSIONS if len(a) == 2 and (b, a) not in CONFUSIONS))


def folded(word: str, skip: str = "") -> str:
    """The word with one character for each two that may stand for it."""
    for two, one in _FOLDS:
        if two != skip and two in word:
            word = word.replace(two, one)
    return word


def forms(word: str) -> set[str]:
    """The word as it is, folded, and folded but for one kind of pair, which may stand in it by chance."""
    return {word, folded(word), *(folded(word, two) for two, _ in _FOLDS if two in word)}


def deletes(word: str, reach: int = 2, prefix: int = 7) -> set[str]:
    """Keys of a word: the prefixes of its forms with `reach` characters left out, and the forms' lengths.

    Two forms of the same length that differ in up to `reach` characters share a key; confusions of one character with two are folded, so they change no length."""
    out = set()
    for form in forms(word):
        level = {form[:prefix]}
        for _ in range(min(reach, len(form) - 1)):
            level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= {f"{len(form)}:{w}" for w in level}
    return out


def values(boxes: DataFrame, key: str = "box_id", text: str = "properties", scan: str = "scan_id") -> DataFrame:
    """(key, prop, value, titles, page), one row per text; redelivered rows count once. The titles are those of all page headers of the scan."""
    titles = F.array_compact(F.array(*[F.col(f"page_header.{a}.title") for a in ("main_section", "subseries")]))
    rows = boxes.select(F.col(key).alias("key"), F.col(scan).alias("scan"), titles.alias("own"), F.col("printed_page").alias("page"), F.explode(F.col(text)).alias("prop", "value"))
    rows = rows.where(F.col("value").isNotNull() & (F.trim("value") != "")).distinct()
    # a scan is one book: its main titles are few, and distinct before they are gathered
    books = boxes.select(F.col(scan).alias("scan"), F.col("page_header.main_section.title").alias("title")).where(F.col("scan").isNotNull() & F.col("title").isNotNull()).distinct()
    books = books.groupBy("scan").agg(F.sort_array(F.collect_set("title")).alias("titles"))
    rows = rows.join(books, "scan", "left")
    return rows.select("key", "prop", "value", F.array_union(F.coalesce("titles", F.array().cast("array<string>")), F.coalesce("own", F.array().cast("array<string>"))).alias("titles"), "page")


def section_titles(rows: DataFrame, least: int = 5) -> DataFrame:
    """(title): keys of numbered lines that stand alone in many values, `least` at least: running headers that the page header doesn't name."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: Counter = Counter()
            for value, page in zip(pdf["value"], pdf["page"]):
                lines = value.split("\n")
                if len(lines) > 1:
                    seen = set()
                    for line in lines:
                        if line.lstrip()[:1] not in _NUMBER_STARTS:
                            continue
                        m = _SECTION.match(_strip_page(line, None if page is None or page != page else int(page)))
                        if m and not re.search(r"[.,;:!?]\s*$", m["title"]) and not m["title"][0].islower():
                            seen.add(header_key(m["title"]))
                    got.update(k for k in seen if len(k) > 4)
            yield pd.DataFrame(list(got.items()), columns=["title", "n"])

    return rows.select("value", "page").mapInPandas(find, "title string, n bigint").groupBy("title").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("title")


def _own_titles(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows with the headings among their own numbered lines in the column `heads`."""
    kind = rows.schema["key"].dataType.simpleString()

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, prop, value, page in zip(pdf["key"], pdf["prop"], pdf["value"], pdf["page"]):
                for line in value.split("\n"):
                    m = _SECTION.match(_strip_page(line, None if page is None or page != page else int(page)))
                    if m:
                        out.append((k, prop, header_key(m["title"])))
            yield pd.DataFrame(out, columns=["key", "prop", "title"])

    own = rows.select("key", "prop", "value", "page").mapInPandas(lines, f"key {kind}, prop string, title string").distinct()
    own = own.join(heads, "title").groupBy("key", "prop").agg(F.collect_set("title").alias("heads"))
    return rows.join(own, ["key", "prop"], "left")


def _parsed(pdf: pd.DataFrame, known: frozenset[str]) -> Iterator[tuple]:
    """(key, prop, kinds of the lines, words) of each scanned text of a batch."""
    heads = pdf["heads"] if "heads" in pdf else [None] * len(pdf)
    for key, prop, value, titles, page, own in zip(pdf["key"], pdf["prop"], pdf["value"], pdf["titles"], pdf["page"], heads):
        if is_record(value):
            continue
        lines = value.split("\n")
        kinds = classify(lines, tuple(titles if titles is not None else ()), None if page is None or page != page else int(page), known if own is None else frozenset(own))
        yield key, prop, kinds, words_of(lines, kinds)


def count_words(rows: DataFrame, known: frozenset[str]) -> DataFrame:
    """(word, first, second, n): how often each word occurs, unbroken (first is '') or broken into two parts; summed per batch before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: Counter = Counter()
            for _, _, _, words in _parsed(pdf, known):
                got.update((w + s if broken else w, w if broken else "", s) for w, _, broken, _, s in words)
            yield pd.DataFrame([(*k, n) for k, n in got.items()], columns=["word", "first", "second", "n"])

    return rows.mapInPandas(count, "word string, first string, second string, n bigint").groupBy("word", "first", "second").agg(F.sum("n").alias("n"))


def _read_words(rows: DataFrame, known: frozenset[str], wanted: frozenset[str] | None) -> DataFrame:
    """(key, prop, line_no, kind, word, before, after, first, second): header and page lines, broken words, and the words that are wanted or may be figures; all words where `wanted` is None."""
    kind_of_key = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind_of_key}, prop string, line_no bigint, kind string, word string, before string, after string, first string, second string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, prop, kinds, words in _parsed(pdf, known):
                out += [(key, prop, i, k, "", "", "", "", "") for i, k in enumerate(kinds, 1) if k in ("header", "page_no")]
                plain = [w + s if broken else w for w, _, broken, _, s in words]
                for i, (w, n, broken, _, second) in enumerate(words):
                    if broken or wanted is None or w in wanted or _FIGURE.match(w):
                        before, after = plain[i - 1] if i else "", plain[i + 1] if i + 1 < len(words) else ""
                        out.append((key, prop, n, "hyphen" if broken else "word", plain[i], before, after, w if broken else "", second))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInPandas(read, schema)


def neighbour_counts(rows: DataFrame, known: frozenset[str], meant: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((before, meant, left_n), (after, meant, right_n)) for the words of `meant`: how often they stand beside each neighbour."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: Counter = Counter()
            for _, _, _, words in _parsed(pdf, known):
                plain = [w + s if broken else w for w, _, broken, _, s in words]
                got.update((side, x, w) for side, xs, ws in ((0, plain, plain[1:]), (1, plain[1:], plain)) for x, w in zip(xs, ws))
            yield pd.DataFrame([(*k, n) for k, n in got.items()], columns=["side", "x", "meant", "n"])

    got = rows.mapInPandas(pairs, "side int, x string, meant string, n bigint").join(meant.select("meant").distinct(), "meant").groupBy("side", "x", "meant").agg(F.sum("n").alias("n"))
    got = cut(got)
    side = lambda k, x, n: got.where(F.col("side") == k).select(F.col("x").alias(x), "meant", F.col("n").alias(n))
    return side(0, "before", "left_n"), side(1, "after", "right_n")


def _change(read: str, meant: str) -> tuple[str, str] | None:
    """(what is written, what is read) where two words differ in one place inside, by one or two characters for one; None if they differ otherwise, or at their ends, where words are inflected."""
    a = 0
    while a < min(len(read), len(meant)) and read[a] == meant[a]:
        a += 1
    z = 0
    while z < min(len(read), len(meant)) - a and read[-1 - z] == meant[-1 - z]:
        z += 1
    got = (meant[a : len(meant) - z], read[a : len(read) - z])
    if a < 1 or z < 2 or tuple(map(len, got)) not in ((1, 1), (1, 2), (2, 1)):
        return None
    return got


def learned_costs(pairs: DataFrame, good: DataFrame, least: float = 10.0, rate: float = 0.02, rounds: int = 2, most: int = 500) -> dict[tuple[str, str], float]:
    """Costs of the confusions that the corpus itself shows, beside the fixed ones.

    Rare words and frequent ones that differ in one place inside are taken for misread ones. A rare word may have several explanations, so in turns each explanation gets its share by the rates of its confusion, and each confusion its rate: how many explained words there are for every frequent word that it could have befallen. Confusions of `least` words and a `rate` are kept, `most` at most, the commonest first; the cost falls with the rate. What comes to the driver are these."""

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(w, m, *c) for w, m in zip(pdf["word"], pdf["meant"]) if (c := _change(w, m)) and c not in _COST]
            yield pd.DataFrame(out, columns=["word", "meant", "a", "b"])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: Counter = Counter()
            for w in pdf["word"]:
                got.update({w[i : i + k] for k in (1, 2) for i in range(1, len(w) - 1 - k)})
            yield pd.DataFrame(list(got.items()), columns=["a", "has"])

    told = cut(pairs.select("word", "meant").mapInPandas(aligned, "word string, meant string, a string, b string"))
    has = cut(good.select("word").mapInPandas(parts, "a string, has bigint").groupBy("a").agg(F.sum("has").alias("has")))
    rates = None
    for _ in range(rounds):
        weighed = told.withColumn("p", F.lit(1.0)) if rates is None else told.join(rates.select("a", "b", F.col("rate").alias("p")), ["a", "b"])
        whole = weighed.groupBy("word").agg(F.sum("p").alias("all"))
        shares = weighed.join(whole, "word").groupBy("a", "b").agg(F.sum(F.col("p") / F.col("all")).alias("n"))
        rates = cut(shares.join(has, "a").select("a", "b", "n", (F.col("n") / F.col("has")).alias("rate")))
    kept = rates.where((F.col("n") >= least) & (F.col("rate") >= rate)).orderBy(F.desc("n"), "a", "b").limit(most).collect()
    return {(r.a, r.b): max(CHEAP, min(0.85, -CHEAP * math.log10(r.rate))) for r in kept}


def candidates(lex: DataFrame, queries: DataFrame, frequent: int = 5, ratio: float = 12.0, learn: bool = True) -> DataFrame:
    """(word, meant, cost, meant_n, n): for each query word the frequent words within reach by confusions.

    `queries` has word and n. A candidate occurs at least `frequent` times, and `ratio` times as often as the query word. Confusions are the fixed ones and, with `learn`, those of learned_costs."""
    parts = python_partitions(lex.sparkSession)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(w, n, k) for w, n in zip(pdf["word"], pdf["n"]) for k in deletes(w)]
            yield pd.DataFrame(out, columns=["word", "n", "k"])

    good = lex.where((F.col("n") >= frequent) & (F.length("word") > 1) & F.col("word").rlike(r"^[^0-9]*$"))
    # so many partitions, or the few bytes of the words would be one task
    left = queries.repartition(parts, "word").mapInPandas(keys, "word string, n bigint, k string").select("word", "n", F.xxhash64("k").alias("k"))
    right = good.repartition(parts, "word").mapInPandas(keys, "word string, n bigint, k string").select(F.col("word").alias("meant"), F.col("n").alias("meant_n"), F.xxhash64("k").alias("k"))
    near = F.abs(F.length("word") - F.length("meant")) <= 2
    pairs = left.join(right, "k").where((F.col("word") != F.col("meant")) & near & (F.col("meant_n") >= F.col("n") * ratio)).select("word", "n", "meant", "meant_n").distinct()
    pairs = cut(pairs.repartition(parts, "word"))  # as above: few bytes, much work
    costs = _COST | (learned_costs(pairs, good) if learn else {})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cost = [weighted_distance(a, b, 1.0, costs) for a, b in zip(pdf["word"], pdf["meant"])]
            yield pdf.assign(cost=cost)[lambda x: x["cost"] <= 0.9]

    return pairs.mapInPandas(measure, "word string, n bigint, meant string, meant_n bigint, cost double")


def faults(boxes: DataFrame, key: str = "box_id", text: str = "properties", title_limit: int = 100_000, word_limit: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """((key, prop, value, ...), (key, prop, line_no, kind, word, repaired)): the texts, and one row per fault with the word as it was read; of a broken word with its parts joined.

    Words are counted and matched as distinct words; the texts are parsed again to find the places of the misread ones, so that words are never written out or shuffled per place. Up to `word_limit` misread words go to the workers; beyond, all places are joined."""
    # the join with the scans' titles left the rows by scan, of which one may be hot
    rows = values(boxes, key, text)
    rows = cut(rows.repartition(python_partitions(rows.sparkSession), "key", "prop"))
    heads = cut(section_titles(rows))
    known = frozenset(r.title for r in heads.limit(title_limit).collect())
    if too_big(heads, title_limit):
        # more headings than may be sent to every worker: each value gets those of its own lines that are headings
        rows, known = cut(_own_titles(rows, heads)), frozenset()
    counts = cut(count_words(rows, known))
    lex = counts.where("first = ''").select("word", "n")

    # broken words: with or without the hyphen, whichever the corpus knows
    forms = counts.where("first <> ''").select("first", "second", "word").withColumn("kept", F.concat("first", F.lit("-"), "second"))
    known_n = lambda name: lex.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"))
    forms = forms.join(known_n("word"), "word", "left").join(known_n("kept"), "kept", "left").na.fill(0, ["word_n", "kept_n"])
    keep = F.when(F.col("kept_n") != F.col("word_n"), F.col("kept_n") > F.col("word_n")).otherwise(F.col("second").rlike(r"^\p{Lu}"))
    joined, joined_n = F.when(keep, F.col("kept")).otherwise(F.col("word")), F.when(keep, F.col("kept_n")).otherwise(F.col("word_n"))
    forms = cut(forms.select("first", "second", joined.alias("joined"), joined_n.alias("joined_n")))

    # words to look up: those of the text, and joined ones
    asked = lex.unionByName(forms.select(F.col("joined").alias("word"), F.greatest("joined_n", F.lit(1)).alias("n"))).groupBy("word").agg(F.max("n").alias("n"))
    cands = cut(candidates(lex, asked.where((F.length("word") > 1) & F.col("word").rlike(r"\p{L}"))))
    least = cands.groupBy("word").agg(F.min("cost").alias("least"))
    cands = cands.join(least, "word").where(F.col("cost") <= F.col("least") + 0.45)
    ways = cands.groupBy("word").agg(F.count("*").alias("ways"), F.max_by("meant", F.struct("meant_n", "meant")).alias("only"))
    ways = cut(ways)

    wanted = None if too_big(ways, word_limit) else frozenset(r.word for r in ways.select("word").collect())  # at most word_limit
    words = cut(_read_words(rows, known, wanted))
    lines = words.where(F.col("kind").isin("header", "page_no")).select("key", "prop", "line_no", "kind", F.lit("").alias("word"), F.lit("").alias("repaired"))
    plain = words.where(F.col("kind") == "word").select("key", "prop", "line_no", "word", "before", "after")
    broken = words.where(F.col("kind") == "hyphen").join(forms.select("first", "second", "joined"), ["first", "second"])
    broken = broken.select("key", "prop", "line_no", F.col("joined").alias("word"), "before", "after")
    places = plain.withColumn("of", F.lit("char")).unionByName(broken.withColumn("of", F.lit("hyphen")))
    fixed = places.join(ways.where("ways = 1").select("word", F.col("only").alias("meant")), "word").select("key", "prop", "line_no", "of", "word", "meant")

    many = ways.where("ways > 1").select("word")
    if not many.isEmpty():
        # context: how often each candidate stands beside the neighbours in the whole corpus
        open_ = cut(cands.join(many, "word").select("word", "meant", "meant_n", "cost"))
        left_n, right_n = neighbour_counts(rows, known, open_)
        unsure = places.join(open_, "word").join(left_n, ["before", "meant"], "left").join(right_n, ["after", "meant"], "left").na.fill(0, ["left_n", "right_n"])
        score = F.log1p("left_n") + F.log1p("right_n") + 0.5 * F.log1p("meant_n") - 6.0 * F.col("cost")
        choice = unsure.groupBy("key", "prop", "line_no", "of", "word", "before", "after").agg(F.max_by("meant", F.struct(score, F.col("meant_n"), F.col("meant"))).alias("meant"))
        fixed = fixed.unionByName(choice.select("key", "prop", "line_no", "of", "word", "meant"))

    chars = fixed.where("of = 'char'").select("key", "prop", "line_no", F.lit("char").alias("kind"), "word", F.col("meant").alias("repaired"))
    whole = fixed.where("of = 'hyphen'").select("key", "prop", "line_no", "word", "meant").distinct()
    hyph = broken.select("key", "prop", "line_no", "word").distinct().join(whole, ["key", "prop", "line_no", "word"], "left")
    hyph = hyph.select("key", "prop", "line_no", F.lit("hyphen").alias("kind"), "word", F.coalesce("meant", "word").alias("repaired"))

    @F.pandas_udf("string")
    def number(w: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([repaired_number(a, b) for a, b in zip(w, after)], dtype=object)

    figures = plain.where(F.col("word").rlike(_FIGURE.pattern))
    figures = figures.withColumn("repaired", number("word", "after")).where(F.col("repaired").isNotNull())
    digits = figures.select("key", "prop", "line_no", F.lit("char").alias("kind"), "word", "repaired")
    return rows, lines.unionByName(hyph).unionByName(chars).unionByName(digits)


def repair(boxes: DataFrame, key: str = "box_id", text: str = "properties", title_limit: int = 100_000, word_limit: int = 1_000_000) -> DataFrame:
    """(key, prop, line_no, kind, repaired), one row per fault."""
    found = faults(boxes, key, text, title_limit, word_limit)[1]
    return found.select("key", "prop", "line_no", "kind", "repaired").distinct().withColumnRenamed("key", key)


def repaired_text(value: str, found: list[tuple[int, str, str, str]]) -> list[str]:
    """The paragraphs of a text less its faults (line_no, kind, word, repaired): its lines made continuous, without headers and page numbers, words whole and put right."""
    drop = {n for n, kind, _, _ in found if kind in ("header", "page_no")}
    chars = {(n, w): r for n, kind, w, r in found if kind == "char"}
    hyphens = {n: r for n, kind, _, r in found if kind == "hyphen"}
    out: list[list[str]] = [[]]
    joined = ""
    for n, line in enumerate(value.split("\n"), 1):
        if n in drop:
            continue
        if not line.strip():
            if out[-1] and not joined:
                out.append([])
            continue
        tokens = _TOKEN.findall(line)
        if joined:  # this line begins with the second half of a word
            tail = tokens[0][len(tokens[0].rstrip(_EDGE)) :]
            out[-1][-1] += tail
            tokens = tokens[1:]
            joined = ""
        for i, t in enumerate(tokens):
            core = t.strip(_EDGE)
            if i == len(tokens) - 1 and n in hyphens:
                head = t[: len(t) - len(t.lstrip(_EDGE))]
                out[-1].append(head + hyphens[n])
                joined = hyphens[n]
            elif core and (n, core) in chars:
                a = t.find(core)
                out[-1].append(t[:a] + chars[n, core] + t[a + len(core) :])
            else:
                out[-1].append(t)
    return [" ".join(p) for p in out if p]


def paragraphs(boxes: DataFrame, key: str = "box_id", text: str = "properties") -> DataFrame:
    """(key, prop, paragraph_no, text): the repaired texts as continuous paragraphs. JSON objects stay as they are; a text of nothing but headers and page numbers has none."""
    rows, found = faults(boxes, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    # what is gathered are the faults of one text
    by_text = found.distinct().groupBy(F.col("key").alias("_k"), F.col("prop").alias("_p")).agg(F.collect_list(F.struct("line_no", "kind", "word", "repaired")).alias("found"))
    both = rows.select("key", "prop", "value").join(by_text, F.col("key").eqNullSafe(F.col("_k")) & (F.col("prop") == F.col("_p")), "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, prop, value, got in zip(pdf["key"], pdf["prop"], pdf["value"], pdf["found"]):
                of = [(x["line_no"], x["kind"], x["word"], x["repaired"]) for x in got] if got is not None else []
                out += [(k, prop, i, p) for i, p in enumerate([value] if is_record(value) else repaired_text(value, of), 1)]
            yield pd.DataFrame(out, columns=["key", "prop", "paragraph_no", "text"])

    return both.select("key", "prop", "value", "found").mapInPandas(write, f"key {kind}, prop string, paragraph_no bigint, text string").withColumnRenamed("key", key)
