"""Sentences of documents in many languages and scripts.

Abbreviations, collocations across a period and frequent sentence starters are learned without labels, per language, by log-likelihood ratios over all documents; then every possible end of a sentence is classified by these statistics and by what surrounds it (quotes, brackets, list marks, line ends).

Counting runs in two steps (partial sums in the Python workers, then one aggregation keyed by language and word), so a language that holds most documents is no single task. The learned model holds only words that pass the thresholds. Up to `model_limit` rows it is sent to the workers; beyond, the part of it that a document needs, in all languages, is joined to the document, with the same result.

Defined results
    null, blank text            no sentence
    no terminator at all        the whole line is one sentence
    text cut off                its rest is a sentence
    very long text              split in one linear pass; no length limit
    unknown or null language    found from the text's script and function words; the column is not used
    repeated documents          each its own sentences
    empty table                 empty result with the same columns
    extra columns               ignored
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tektonis.runtime import cut, spread, too_big

# Function words that tell the languages of the Latin script apart.
FUNCTION_WORDS = {
    "en": "the of and was is in at with for by to on that which from as were",
    "de": "der die das und ist in den von mit aus wurde eine einer im nicht auf für zu bei des",
    "fr": "le la les de des et est en du un une dans sur pour que au qu pas par",
    "es": "el la los las de del y es en un una que con por se para al como",
}
_FUNCTION = {w: [lang for lang, ws in FUNCTION_WORDS.items() if w in ws.split()] for ws in FUNCTION_WORDS.values() for w in ws.split()}
_SCRIPTS = {k: re.compile(f"[{v}]+") for k, v in {"th": "\u0e00-\u0e7f", "ja": "\u3040-\u30ff", "zh": "\u4e00-\u9fff\u3400-\u4dbf", "hi": "\u0900-\u097f", "ar": "\u0600-\u06ff", "el": "\u0370-\u03ff\u1f00-\u1fff", "ru": "\u0400-\u04ff"}.items()}
_ASCII = re.compile(r"[\x00-\x7f]+")
_LETTERS = re.compile(r"[A-Za-z]+")
_DIGIT = re.compile(r"\d")

TERMINATORS = ".!?…。！？．｡؟۔।॥‼⁇⁈⁉"
CLOSERS = "\"'”’»›)]}」』）】〉》｣＂“‘«"
_END = re.compile(r"[.!?…。！？．｡؟۔।॥‼⁇⁈⁉]+|[;;](?=[\s»\"”)\]]|$)")
_WORD = re.compile(r"[^\s\"„“”«»‹›()\[\]{}「」『』（）]+")
_BULLET = re.compile(r"[-*•‣▪●◦–—·]\s+")
_NUMBERED = re.compile(r"(?:\(\s*(\d{1,3}|[a-zA-Z])\s*\)|(\d{1,3}|[a-z])\)|\[(\d{1,3})\])\s+")
_DOTTED = re.compile(r"(\d{1,3})\.\s+")
_THAI_UNIT = re.compile(r"(?:ซม|มม|กม|ตร\.?ม|ลบ\.?ม|ม|กก|นิ้ว|เมตร|เซนติเมตร|มิลลิเมตร|องศา|เปอร์เซ็นต์)(?:[.\s]|$)")
# Verbs that report speech where no space or comma tells so.
_REPORTS = re.compile(r"写道|说道|说|问道|问|答道|答|表示|指出|写着|记录|记载|补充|喊道|回忆|写|说明|报告")


def language(text: str) -> str:
    """The main language of a text: its script, and for the Latin script its function words."""
    rest = "" if text.isascii() else _ASCII.sub("", text)
    seen = Counter(la=len(text) - len(_LETTERS.sub("", text)))
    for k, pattern in _SCRIPTS.items():
        if rest and (n := len(rest) - len(pattern.sub("", rest))):
            seen[k] = n
    if seen["ja"] * 8 > seen["zh"] + seen["ja"] and seen["ja"] + seen["zh"] > 0 and seen["ja"] + seen["zh"] >= seen["la"] * 0.3:
        return "ja"
    other = [(n * (3 if k in ("zh", "th") else 1), k) for k, n in seen.items() if k not in ("la", "ja")]
    if other and max(other)[0] >= seen["la"]:
        return max(other)[1]
    votes: Counter = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        for lang in _FUNCTION.get(w, ()):
            votes[lang] += 1 / len(_FUNCTION[w])
    return max(sorted(votes), key=votes.__getitem__) if votes else "en"


def _type(word: str) -> str:
    """A word as it is counted: lower case, figures and codes made alike, without trailing marks."""
    w = word.strip(",;:!?…").lower()
    if _DIGIT.search(w):
        return ("##" if re.fullmatch(r"[\d.,]*\d", w.rstrip(".")) else "##x") + "." * (w[-1] == ".")
    return w.lstrip("'’¿¡*-–")


# --- line structure -------------------------------------------------------------------------------------------------


def _lines(text: str) -> list[tuple[int, int, int]]:
    """(start, end without trailing space, end) of the lines that are not blank."""
    out, at = [], 0
    for m in re.finditer(r"\r\n|[\r\n\x0b\x0c\x85  ]|$", text):
        a, b = at, m.start()
        at = m.end()
        body = text[a:b]
        if body.strip():
            out.append((a + len(body) - len(body.lstrip()), a + len(body.rstrip()), b))
        if m.end() == len(text) and not m.group():
            break
    return out


def _mark(text: str, a: int) -> re.Match | None:
    return _BULLET.match(text, a) or _NUMBERED.match(text, a)


def segments(text: str) -> list[tuple[int, int]]:
    """Spans between line ends that end a sentence: around blank lines, headings and list entries.

    A line end inside a wrapped paragraph ends nothing: such lines are about as long as the longest."""
    lines = _lines(text)
    if not lines:
        return []
    width = max(b - a for a, b, _ in lines)
    numbers = [_DOTTED.match(text, a) for a, _, _ in lines]
    dotted: set[int] = set()
    want = 1
    for i, m in enumerate(numbers):
        if m and int(m[1]) == want and (want > 1 or any(x and int(x[1]) == 2 for x in numbers[i + 1 :]) or i == 0):
            dotted.add(i)
            want += 1
    out, start = [], lines[0][0]
    for i, (a, b, _) in enumerate(lines[:-1]):
        c = lines[i + 1][0]
        gap = text[b:c]
        blank = len(re.findall(r"\r\n|[\r\n\x0b\x0c\x85\u2028\u2029]", gap)) > 1
        word = re.match(r"\S+", text[c:]).group()
        goes_on = text[b - 1] in ",،、，-–(" or word[0] in "%,;:)]»”…" or word.startswith((".", "!", "?"))
        hard = blank or not goes_on and (_mark(text, c) is not None or i + 1 in dotted)
        if not hard and not goes_on and not _lower(word):
            first = 1 if unicodedata.east_asian_width(word[0]) in "WF" else len(word)
            fits = b - a + 1 + first <= width
            hard = width < 45 or (fits and b - a < 0.72 * width)
        if hard:
            out.append((start, b))
            start = c
    out.append((start, lines[-1][1]))
    return out


# --- counting -------------------------------------------------------------------------------------------------------


def counts(text: str) -> tuple[str, Counter]:
    """(language, counts) of one text. Keys: ('w', type), ('u', type) with a capital, ('h', type) ending in a period, ('i', type) ending in a period that something other than a beginning follows, ('s', type) after a sure end, ('c', type, next type) across a period."""
    lang, out = language(text), Counter()
    for a, b in segments(text):
        before, sure = "", True
        for m in _WORD.finditer(text, a, b):
            raw = m.group()
            t = _type(raw)
            if not t:
                continue
            word = t.rstrip(".")
            period = t.endswith(".") and not t.endswith("..")
            if word:
                out["w", word] += 1
                out["h", word] += period
                out["u", word] += raw.lstrip("'’¿¡*-–")[:1].isupper()
                if period and (raw[-1] != "." or _continues(text, m.end(), b)):
                    out["i", word] += 1
            if before:
                out["c", before, word] += 1
            if sure and word and not word.startswith("##") and not _lower(raw.lstrip("'’¿¡*-–")):
                out["s", word] += 1
            tail = text[m.end() : m.end() + 3].strip()[:1]
            sure = raw[-1] in "!?。！？؟।" or (period and len(word) > 5 and "." not in word and word.isalpha())
            before = word if period else ""
            if tail and tail in CLOSERS and period:
                before, sure = "", True
    return lang, out


def _lower(word: str) -> bool:
    """Whether a word is in lower case throughout its beginning; one like pH is not."""
    return word[:1].islower() and word[:3].lower() == word[:3]


def _continues(text: str, i: int, b: int) -> bool:
    """Whether a lower-case word, a figure or a comma follows a period."""
    while i < b and text[i].isspace():
        i += 1
    return i < b and (text[i] in ",;:" or text[i].isdigit() or _lower(text[i : i + 3]))


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sums: dict[str, Counter] = defaultdict(Counter)
        for text in pdf["text"]:
            if text and text.strip():
                lang, got = counts(text)
                sums[lang].update(got)
        rows = []
        for lang, got in sums.items():
            for k, n in got.items():
                if n:
                    rows.append((lang, k[0], k[1], k[2] if k[0] == "c" else "", n))
        yield pd.DataFrame(rows, columns=["lang", "kind", "word", "next", "n"])


def _llr(k1: str, n1: str, k2: str, n2: str) -> str:
    """Dunning's ratio, as SQL, of k1 of n1 against k2 of n2; negative where the first rate is the lower one."""

    def ll(k: str, n: str, p: str) -> str:
        return f"({k} * ln(greatest({p}, 1e-12)) + ({n} - {k}) * ln(greatest(1 - {p}, 1e-12)))"

    p1, p2, p = f"({k1} / {n1})", f"({k2} / greatest({n2}, 1))", f"(({k1} + {k2}) / ({n1} + {n2}))"
    return f"(CASE WHEN {p1} > {p2} THEN 2 ELSE -2 END * ({ll(k1, n1, p1)} + {ll(k2, n2, p2)} - {ll(k1, n1, p)} - {ll(k2, n2, p)}))"


def learn(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lang, kind, word, next): abbreviations 'a', sentence starters 's' and collocations 'c' across a period."""
    raw = spread(docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull()), factor=1).mapInPandas(_count_batches, "lang string, kind string, word string, next string, n bigint")
    got = cut(raw.groupBy("lang", "kind", "word", "next").agg(F.sum("n").cast("double").alias("n")))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0.0))
    words = got.where("kind IN ('w', 'h', 'i', 'u')").groupBy("lang", "word").agg(of("w").alias("n"), of("h").alias("hits"), of("i").alias("goes_on"), of("u").alias("upper"))
    total = words.groupBy("lang").agg(F.sum("hits").alias("all_hits"), F.sum("n").alias("all_n"))  # one row a language
    words = words.join(F.broadcast(total), "lang")
    starts = got.where("kind = 's'").groupBy("lang").agg(F.sum("n").alias("all_starts"))
    pairs = got.where("kind = 'c'").groupBy("lang", "word").agg(F.sum("n").alias("word_n"))

    # Punkt's weights: shorter words, inner periods and few uses without a period speak for an abbreviation
    length = "greatest(length(replace(word, '.', '')), 1)"
    score = f"{_llr('hits', 'n', 'all_hits - hits', 'all_n - n')} * exp(-{length}) * (length(word) - length(replace(word, '.', '')) + 1) * pow({length}, -(n - hits))"
    ratio = _llr("hits", "n", "all_hits - hits", "all_n - n")
    # a word that ends sentences only is no abbreviation, however often a period follows it
    abbr = words.where("hits >= 2 AND goes_on >= 2 AND goes_on >= 0.02 * hits AND word NOT LIKE '##%'").where(F.expr(f"{score} >= 0.3 OR ({ratio} > 10 AND hits >= 0.9 * n AND {length} <= 6)"))
    abbr = abbr.select("lang", F.lit("a").alias("kind"), "word", F.lit("").alias("next"))

    s = got.where("kind = 's'").select("lang", "word", F.col("n").alias("starts"))
    s = s.join(words.select("lang", "word", "n", "upper", "all_n"), ["lang", "word"]).join(F.broadcast(starts), "lang")
    starter = s.where("starts >= 2").where(F.expr(f"{_llr('starts', 'n', 'greatest(all_starts - starts, 0)', 'greatest(all_n - n, 1)')} > 10 AND starts / n > 0.15 OR starts >= 5 AND upper < 0.9 * n AND starts >= 0.4 * upper"))
    starter = starter.select("lang", F.lit("s").alias("kind"), "word", F.lit("").alias("next"))

    c = got.where("kind = 'c'").select("lang", "word", "next", F.col("n").alias("both"))
    c = c.where("both >= 3").join(pairs, ["lang", "word"]).join(words.select("lang", F.col("word").alias("next"), F.col("n").alias("next_n"), "all_n"), ["lang", "next"])
    colloc = c.where(F.expr(f"{_llr('both', 'word_n', 'greatest(next_n - both, 0)', 'greatest(all_n - word_n, 1)')} > 7.88 AND both / next_n > 0.3"))
    return abbr.unionByName(starter).unionByName(colloc.select("lang", F.lit("c").alias("kind"), "word", "next"))


class Model:
    """The learned words of one language."""

    def __init__(self, rows=()):
        self.abbr = {w for k, w, _ in rows if k == "a"}
        self.start = {w for k, w, _ in rows if k == "s"}
        self.pair = {(w, x) for k, w, x in rows if k == "c"}


# --- classification -------------------------------------------------------------------------------------------------

_LEADING = "¿¡'‘‚—–-•"  # may stand before the first letter of a sentence, as part of the word
_OPEN = {"„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》"}


def _quoted(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans from an opening quote or bracket to the mark that closes it; marks without a partner open nothing."""
    spans, stack = [], []
    for i in range(a, b):
        c = text[i]
        if stack and (c in stack[-1][1] or (c in "\"＂”" and stack[-1][1] in ("”", "\"", "＂"))):
            spans.append((stack.pop()[0], i + 1))
        elif c in _OPEN:
            if c in "([" or not stack or stack[-1][1] != _OPEN[c]:
                stack.append((i, _OPEN[c]))
        elif c == "“":
            stack.append((i, "”"))
        elif c == "»" and not stack:
            stack.append((i, "«"))
        elif c in "\"＂" and not (i and text[i - 1].isdigit() and not any(x[1] == c for x in stack) and (i + 1 >= b or text[i + 1] in " ,.;)")):
            stack.append((i, c))
        elif len(stack) > 1 and any(c in x[1] for x in stack):
            while c not in stack[-1][1]:
                stack.pop()
            spans.append((stack.pop()[0], i + 1))
    return spans


def _before(text: str, a: int, i: int) -> str:
    """The word that ends at place i of a segment that begins at a."""
    k = i
    while k > a and not text[k - 1].isspace() and text[k - 1] not in "\"„“«»(（「『[":
        k -= 1
    return text[k:i]


def lookups(text: str) -> set[str]:
    """Every word that the models may be asked for when a text is split: words as they begin a sentence, and words before a period."""
    out = set()
    for a, b in segments(text):
        out |= {_type(m.group().lstrip(_LEADING)).rstrip(".") for m in _WORD.finditer(text, a, b)}
        out |= {_type(_before(text, a, m.start())) for m in _END.finditer(text, a, b) if m.group()[0] == "."}
    return out - {""}


def _starts_sentence(text: str, i: int, b: int) -> tuple[bool, str]:
    """(whether what follows looks like a beginning rather than a continuation, the type of its first word)."""
    j = i
    while j < b and (text[j] in "\"„“”«»‹›(（「『[" + _LEADING or text[j].isspace()):
        j += 1
    m = _WORD.match(text, j, b)
    word = m.group() if m else ""
    t = _type(word).rstrip(".")
    return bool(word) and not _lower(word), t


def split_segment(text: str, a: int, b: int, models: dict[str, Model], lang: str) -> list[tuple[int, int]]:
    out, start, model = [], a, models.get(lang) or Model()
    spans = _quoted(text, a, b)
    covers = sorted(spans)
    thai = re.search(r"[\u0e00-\u0e7f]", text[a:b]) is not None
    m = _BULLET.match(text, a) or _NUMBERED.match(text, a) or _DOTTED.match(text, a)
    body = m.end() if m and m.end() < b else a

    def close(e: int) -> None:
        nonlocal start
        s = start
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if e > s:
            out.append((s, e))
        start = e

    def inside(i: int, e: int) -> tuple[int, int] | None:
        """The outermost span that holds place i and goes on after e."""
        for x, y in covers:
            if x > i:
                return None
            if x <= i and y > e and y > i + 1:
                return x, y
        return None

    def spaces(frm: int, to: int) -> Iterator[int]:
        """Thai: a space ends a sentence unless a figure and its unit stand around it."""
        for g in re.finditer(r"\s+", text[frm:to]):
            i, j = frm + g.start(), frm + g.end()
            if j < to and i > body and not inside(i, j):
                yield i

    ends: list[tuple[int, int, str]] = [(x.start(), x.end(), x.group()) for x in _END.finditer(text, body, b)]
    if thai:
        ends += [(i, i, " ") for i in spaces(body, b)]
        ends.sort()
    for i, e, mark in ends:
        if i < start:
            continue
        if mark in ";;" and (lang != "el" and not re.search(r"[Ͱ-Ͽ]\s*$", text[max(a, i - 3) : i])):
            continue
        if mark == " ":
            j = i
            while j < b and text[j].isspace():
                j += 1
            if text[j].isdigit() or _THAI_UNIT.match(text, j, b) and text[i - 1].isdigit() or text[j] in ",)]%»”":
                continue
            after_thai, before_thai = "\u0e00" <= text[j] <= "\u0e7f", bool(re.search(r"[\u0e00-\u0e7f][\W\d]*$", text[max(start, i - 12) : i]))
            if not (after_thai and (before_thai or text[i - 1] in CLOSERS + TERMINATORS) or before_thai and (text[j].isupper() or text[j] in "\"„“«")):
                continue
            close(i)
            continue
        # closing quotes and brackets belong to the sentence
        f, quote = e, False
        while True:
            j = f
            while j < b and text[j].isspace() and j - f < 3:
                j += 1
            if j < b and text[j] in "»›" and any(y == j + 1 and x < i for x, y in spans):
                f, quote = j + 1, True
            elif f < b and text[f] in CLOSERS and any(y == f + 1 and x < i for x, y in spans):
                quote = quote or text[f] not in ")]）】"
                f += 1
            elif f < b and f > e and text[f] in ".。":
                f += 1
            else:
                break
        if f < b and text[f] in ",，、;:；：":
            continue
        if inside(i, f):
            continue
        if f >= b:
            close(b)
            continue
        wide = any(c in "。！？｡．" for c in mark)
        space = text[f].isspace()
        j = f
        while j < b and text[j].isspace():
            j += 1
        if wide:
            if quote:
                if text[f] in "とっ的" or text[f] in "—-":
                    continue
                opened = max(x for x, y in spans if y <= f and x < i)
                if not text[start:opened].strip():
                    stop = re.search(r"[。！？!?\n]", text[f:b])
                    clause = text[f : f + stop.start()] if stop else text[f:b]
                    clause = re.split(r"[，,]", clause)[0] + (re.split(r"[，,]", clause) + [""])[1]
                    if _REPORTS.search(clause):
                        continue
            close(f)
            continue
        if "।" in mark or "॥" in mark:
            close(f)
            continue
        if mark.startswith("…") or mark.startswith(".."):
            begins, _ = _starts_sentence(text, j, b)
            cased = text[j : j + 1].lower() != text[j : j + 1].upper()
            if space and begins and cased and not text[max(a, i - 1) : i].isspace():
                close(f)
            continue
        if not space:
            if f > e and quote and text[f : f + 1].isupper():
                close(f)
            elif "؟" in mark or (mark[-1] in "!?" and ord(text[f]) > 0x2E80):
                close(f)
            elif mark == "." and ord(text[f]) > 0x2E80 and f > e:
                close(f)
            continue
        begins, following = _starts_sentence(text, j, b)
        if mark[0] in "!?؟;;":
            if begins and not (quote and text[j] in "—–" and _type((_WORD.search(text, j + 1, b) or re.match("", "")).group())[:1].islower()):
                close(f)
            continue
        if "\u0900" <= text[i - 1] <= "\u0963":
            continue  # Devanagari ends sentences with a danda; its periods abbreviate
        # a period: look at the word before it
        if quote:
            if begins:
                close(f)
            continue
        raw = _before(text, a, i)
        word = _type(raw)
        opener = text[j] in "\"„«“¿¡「『‹"
        word_is_short = len(raw) <= 6
        here = models.get(language(text[max(start, i - 200) : i + 80]), model) if word_is_short else model
        there = models.get(language(text[j : j + 80]), model) if word_is_short or raw[-1:].isdigit() else model
        starters = model.start | here.start | there.start if following in here.start or following in there.start else model.start
        if raw and raw[-1].isdigit() and re.fullmatch(r"\d{1,3}", raw):
            # an ordinal, or a figure that ends the sentence
            if ("##", following) in model.pair and following not in starters:
                continue
            if here is models.get("de") and int(raw) <= 100 and not opener and following not in starters and not text[j].isdigit() and f == e:
                continue
        elif re.fullmatch(r"[^\W\d_]", raw) and raw.lower() != raw.upper() and f == e and not opener and (following not in starters or not begins):
            continue
        elif word in model.abbr or word in here.abbr:
            if text[j].isdigit() or not begins or (word, following) in model.pair | here.pair and following not in starters:
                continue
            if not opener and f == e and following not in starters:
                continue
        if text[j].islower() and not begins:
            continue
        close(f)
    close(b)
    return out


def sentences(text: str | None, models: dict[str, Model]) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text."""
    if not text or not text.strip():
        return []
    lang = language(text)
    out = []
    for a, b in segments(text):
        out += split_segment(text, a, b, models, lang)
    return out


def split_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", model: DataFrame | None = None, model_limit: int = 200_000) -> DataFrame:
    """(key, sent_no, start_char, end_char), one row per sentence; places are Unicode characters of the text."""
    model = cut(model if model is not None else learn(docs, text))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, sent_no bigint, start_char bigint, end_char bigint"
    rows = docs.select(F.col(key), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def emit(key_value, spans) -> Iterator[tuple]:
        return ((key_value, n, a, b) for n, (a, b) in enumerate(spans, 1))

    if not too_big(model, model_limit):
        grouped: dict[str, list] = defaultdict(list)
        for lang, *rest in model.collect():  # at most model_limit rows
            grouped[lang].append(tuple(rest))
        models = {lang: Model(r) for lang, r in grouped.items()}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([r for k, t in zip(pdf[key], pdf["text"]) for r in emit(k, sentences(t, models))], columns=[key, "sent_no", "start_char", "end_char"])

        return spread(rows, key).mapInPandas(run, schema)

    def used(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, w) for k, t in zip(pdf[key], pdf["text"]) for w in lookups(t)], columns=[key, "word"])

    # a word is looked up in the main language of its text and in that around it, so it brings its rules of all languages;
    # a language without any of them must be known too, since only one that was never learned gives way to the main language
    learned = [r.lang for r in model.select("lang").distinct().collect()]  # one row a language
    words = spread(rows, key).mapInPandas(used, f"`{key}` {kind}, word string").distinct()
    own = words.join(model, "word").groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("lang", "kind", "word", "next")).alias("model"))

    def run_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t, m in zip(pdf[key], pdf["text"], pdf["model"]):
                rules: dict[str, list] = {lang: [] for lang in learned}
                for x in m if m is not None else ():
                    rules[x["lang"]].append((x["kind"], x["word"], x["next"]))
                out += emit(k, sentences(t, {lang: Model(r) for lang, r in rules.items()}))
            yield pd.DataFrame(out, columns=[key, "sent_no", "start_char", "end_char"])

    return rows.join(own, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").mapInPandas(run_own, schema)


