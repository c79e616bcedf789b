"""Several values packed in one field: infer the delimiters of each source, split, and give one row per value with its position.

Two passes over the texts. The first counts, for every source and every candidate delimiter, how often the delimiter occurs outside quotes, whether it cuts a text into a consistent number of pieces and whether the pieces are of a regular type (a whole phrase, not a torn bracket or a bare number). The counts are partial sums, so a source that holds a third of all rows costs no more than others. The second pass splits every text at the delimiters that won for its source.

Defined results
    null or blank text           no row
    null source                  a source of its own
    text without any delimiter   one row, pos 1
    empty pieces                 dropped and not counted
    very long text               split in one linear pass; no length limit
    repeated rows                one result (rows are taken once)
    empty table                  empty result with the same columns
    extra columns                ignored, whatever their names
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tektonis.runtime import cut, spread, too_big

# Pairs of quotation marks by their opening mark.
QUOTES = {'"': '"', "'": "'", "„": "“”\"", "“": "”", "«": "»", "‚": "‘’'", "‹": "›", "»": "«", "‘": "’", "`": "`´"}
# The delimiters that may part values.
CANDIDATES = ("newline", "tab", "pipe", "semicolon", "bullet", "double_slash", "comma", "slash", "plus", "ampersand", "word_or")
_QUOTE = re.compile("[" + re.escape("".join(QUOTES)) + "]")

_CUT = re.compile(
    r"(?P<newline>\r\n|\r|\n)|(?P<tab>\t)|(?P<pipe>\|)|(?P<semicolon>;)|(?P<bullet>[•‣▪●◦·])|(?P<double_slash>(?<![:\w])//)"
    r"|(?P<comma>(?<!\d),|,(?!\d))|(?P<slash>(?<=\s)/(?=\s))|(?P<plus>(?<=\s)\+(?=\s))|(?P<ampersand>(?<=\s)&(?=\s))"
    r"|(?P<word_or>(?<=\s)(?:or|oder|OR|ODER|Or|Oder)(?=\s))"
)
_MARK = re.compile(r"(?:(?<=\s)|^)(?:\((\d{1,3})\)|(\d{1,3})[\])](?=\s)|(\d{1,3})\.(?=\s+\D))\s*")
_LEAD = re.compile(r"^(?:[-*•‣▪●◦·–—+]\s+|\(?(?:\d{1,3}|[a-z])[\])]\s+|\d{1,3}\.\s+(?=\D))")
_LETTER = re.compile(r"[^\W\d_]")


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Spans of quoted values: a quotation mark opens where a value may begin and closes where one may end.

    A doubled mark inside stands for the mark itself; an apostrophe inside a word opens nothing."""
    spans, i, n, fresh = [], 0, len(text), True
    if not _QUOTE.search(text):
        return spans
    while i < n:
        c = text[i]
        if fresh and c in QUOTES:
            close, j = QUOTES[c], i + 1
            while j < n:
                if text[j] == "\\" and j + 1 < n:
                    j += 2
                    continue
                if text[j] in close:
                    if text[j] == c and j + 1 < n and text[j + 1] == c:
                        j += 2
                        continue
                    rest = text[j + 1 : j + 3].lstrip(" ")
                    if text[j] != "'" or not rest or not rest[0].isalnum() or text[j + 1].isspace():
                        break
                j += 1
            if j < n:
                spans.append((i, j + 1))
                i, fresh = j + 1, False
                continue
        if c.isspace():
            m = re.compile(r"\s+(?:or|oder)(?=\s)", re.I).match(text, i)
            if m:
                i, fresh = m.end(), True
                continue
            fresh = fresh or c in "\r\n\t"
        else:
            # after a delimiter, bullet or list mark a value begins
            fresh = c in ",;|/+&•[(*" or (c in ")].-" and _LEAD.match(text[text.rfind("\n", 0, i) + 1 : i + 1].lstrip() + " ") is not None) or (c in ")]" and bool(re.search(r"(?:^|\s)\(?\d{1,3}[\])]$", text[max(0, i - 6) : i + 1])))
        i += 1
    return spans


def _masked(text: str) -> str:
    """The text with quoted values blanked by a letter of no meaning, at equal length."""
    out = list(text)
    for a, b in quoted_spans(text):
        out[a:b] = "\x00" * (b - a)
    return "".join(out)


def _numbering(masked: str) -> list[tuple[int, int]]:
    """List marks such as (1), 2) or 3], if they count up from 1."""
    found, want = [], 1
    for m in _MARK.finditer(masked):
        if int(next(g for g in m.groups() if g)) == want:
            found.append(m.span())
            want += 1
    return found


def _listed(text: str) -> list[str] | None:
    """The members of a text that is a bracketed list of quoted strings."""
    if text[:1] == "[" and text[-1:] == "]":
        try:
            got = json.loads(text)
        except ValueError:
            inner = text[1:-1].strip()
            if inner[:1] not in QUOTES:
                return None
            return split_packed(inner, frozenset(CANDIDATES))
        if isinstance(got, list):
            return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in got if x is not None]
    return None


def bare(piece: str) -> str:
    """A piece without surrounding space, bullets, numbering and enclosing quotes."""
    s = piece.strip()
    m = _LEAD.match(s)
    if m:
        s = s[m.end() :].strip()
    if len(s) > 1 and s[0] in QUOTES and s[-1] in QUOTES[s[0]]:
        inner = s[1:-1]
        if s[0] in "\"'`":
            inner = inner.replace(s[0] * 2, s[0]).replace("\\" + s[0], s[0])
        elif "\\" in inner:
            inner = re.sub(r"\\([\"'])", r"\1", inner)
        s = inner.strip()
    return "" if s in {"-", "*", "•", "–", "—"} else s


def split_packed(text: str | None, active: frozenset[str], masked: str | None = None) -> list[str]:
    """The values of one text, in order, split at the active delimiters; `masked` is the stripped text with its quoted values blanked, if that is known."""
    if text is None or not text.strip():
        return []
    text = text.strip().lstrip("﻿").strip()
    if (got := _listed(text)) is not None:
        return [x for x in (bare(y) if y[:1] in QUOTES else y.strip() for y in got) if x]
    masked = masked if masked is not None and len(masked) == len(text) else _masked(text)
    cuts = [m.span() for m in _CUT.finditer(masked) if m.lastgroup in active] + _numbering(masked)
    out, at = [], 0
    for a, b in sorted(cuts):
        if a >= at:
            out.append(text[at:a])
        at = max(at, b)
    out.append(text[at:])
    return [x for x in map(bare, out) if x]


def _regular(piece: str) -> bool:
    """Whether a piece could be a whole value: it has a letter, and brackets and quotes are closed in it."""
    return bool(_LETTER.search(piece)) and piece.count("(") == piece.count(")") and piece.count('"') % 2 == 0


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sums: dict[tuple, list[float]] = {}
        for source, text in zip(pdf["source"], pdf["text"]):
            if text is None or not text.strip():
                continue
            masked = _masked(text.strip())
            for name in {m.lastgroup for m in _CUT.finditer(masked)}:
                pieces = split_packed(text, frozenset([name]), masked)
                row = sums.setdefault((source, name), [0, 0, 0, 0, 0])
                n = len(pieces)
                row[0] += 1
                row[1] += n
                row[2] += n * n
                row[3] += sum(map(_regular, pieces)) / n if n else 0
                row[4] += n > 1
        yield pd.DataFrame([(*k, *map(float, v)) for k, v in sums.items()], columns=["source", "delimiter", "n", "pieces", "squares", "regular", "cuts"])


def delimiter_scores(df: DataFrame, text: str, source: str | Column, prior: float = 20.0) -> DataFrame:
    """(source, delimiter, n, consistency, regularity, score) of every candidate delimiter of every source.

    Consistency is the share of texts with the delimiter that it really cuts, damped by the spread of the piece counts; regularity the share of pieces of regular type. A source with few texts is pulled towards the delimiter's score over all sources with the weight of `prior` texts."""
    src = F.col(source) if isinstance(source, str) else source
    raw = df.select(src.cast("string").alias("source"), F.col(text).alias("text"))
    part = raw.mapInPandas(_profile, "source string, delimiter string, n double, pieces double, squares double, regular double, cuts double")
    # the sums are used twice, and are small beside the texts
    per = cut(part.groupBy("source", "delimiter").agg(*[F.sum(c).alias(c) for c in ("n", "pieces", "squares", "regular", "cuts")]))
    whole = per.groupBy("delimiter").agg(*[F.sum(c).alias("all_" + c) for c in ("n", "regular", "cuts")])
    mean = F.col("pieces") / F.col("n")
    spread_ = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))) / mean
    smooth = lambda c: (F.col(c) + prior * F.col("all_" + c) / F.col("all_n")) / (F.col("n") + prior)
    return (
        per.join(F.broadcast(whole), "delimiter")  # one row per candidate delimiter, at most len(CANDIDATES)
        .select("source", "delimiter", "n", (smooth("cuts") / (1 + spread_ * 0.25)).alias("consistency"), smooth("regular").alias("regularity"))
        .withColumn("score", F.col("consistency") * F.col("regularity"))
    )


def explode_packed(df: DataFrame, key: str, text: str, source: str | Column, threshold: float = 0.35, send_limit: int = 100_000) -> DataFrame:
    """(key, pos, item), one row per value packed in `text`; pos counts from 1.

    A delimiter splits the texts of a source unless its score there stays below `threshold`. Only the delimiters that a source must not use are brought to its texts: in a broadcast up to `send_limit` sources that have any, by a join beyond."""
    src = (F.col(source) if isinstance(source, str) else source).cast("string")
    rows = df.select(F.col(key).alias("key"), src.alias("source"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.trim("text") != ""))
    rows = spread(rows, "key").distinct()
    unfit = delimiter_scores(rows, "text", "source").where(F.col("score") < threshold)
    unfit = cut(unfit.groupBy(F.col("source").alias("of")).agg(F.sort_array(F.collect_set("delimiter")).alias("unfit")))  # at most len(CANDIDATES) names a source
    joined = rows.join(unfit if too_big(unfit, send_limit) else F.broadcast(unfit), F.col("source").eqNullSafe(F.col("of")), "left").select("key", "text", "unfit")
    kind = df.schema[key].dataType.simpleString()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = frozenset(CANDIDATES)
        for pdf in batches:
            out = []
            for k, t, u in zip(pdf["key"], pdf["text"], pdf["unfit"]):
                out += [(k, i, x) for i, x in enumerate(split_packed(t, every if u is None else every.difference(u)), 1)]
            yield pd.DataFrame(out, columns=["key", "pos", "item"])

    return joined.mapInPandas(pieces, f"key {kind}, pos bigint, item string").distinct().select(F.col("key").alias(key), "pos", "item")
