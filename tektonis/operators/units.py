"""Quantities recorded in different units, converted to a common one.

Conversions are the edges of a graph, each an affine function. The shortest composition from every unit to the canonical unit of its dimension is computed once, every further edge is checked against these compositions (a cycle must come back to the identity), and the result is a small table that quantities are equi-joined with on their source unit.

Defined results
    null or blank text                 no quantity
    null, zero and negative figures    no case
    unknown unit                       no case (an inner join)
    ranges, sums and pairs             each figure is a quantity of its own
    inch fractions                     one figure, also as one character (1½)
    number words                       English, and German ones below a thousand; halves and quarters
    thousands                          1,200 mm is 1200 mm, as 1.200 mm; in units above the millimetre three figures behind a mark are decimals
    areas, rates, densities, angles    none: the unit must end where the word ends
    very long text                     one linear pass, no limit
    repeated rows                      one result
    empty table                        empty result with the same columns
    extra columns                      ignored
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Conversion edges (from, to, factor, offset): to = factor * from + offset.
EDGES = (
    ("mm", "um", "1000", "0"),
    ("cm", "mm", "10", "0"),
    ("dm", "cm", "10", "0"),
    ("m", "dm", "10", "0"),
    ("m", "mm", "1000", "0"),
    ("km", "m", "1000", "0"),
    ("in", "mm", "25.4", "0"),
    ("in", "cm", "2.54", "0"),
    ("ft", "in", "12", "0"),
    ("yd", "ft", "3", "0"),
    ("degF", "degC", "5/9", "-160/9"),
    ("K", "degC", "1", "-273.15"),
)
# Spellings of the length units.
SPELLINGS = {
    "um": "um µm μm micron microns micrometre micrometres micrometer micrometers mikrometer",
    "mm": "mm millimetre millimetres millimeter millimeters millimetern",
    "cm": "cm centimetre centimetres centimeter centimeters zentimeter zentimetern",
    "dm": "dm decimetre decimetres decimeter decimeters dezimeter dezimetern",
    "m": "m metre metres meter meters metern",
    "km": "km kilometre kilometres kilometer kilometers",
    "in": 'in inch inches zoll " ″ ”',
    "ft": "ft foot feet fuß fuss",
    "yd": "yd yard yards",
}
# Number words.
WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
WORDS |= {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}

SCALES = {"hundred": 100, "thousand": 1000}
PARTS = {"half": "0.5", "quarter": "0.25", "halb": "0.5", "halbe": "0.5", "halber": "0.5", "halben": "0.5", "halbes": "0.5", "viertel": "0.25"}
# German number words up to twelve and the tens; the others are made of them by rule.
GERMAN = {w: i for i, w in enumerate("null ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf".split())}
GERMAN_TENS = {w: 10 * i for i, w in enumerate("zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split(), 2)}
GERMAN_TEENS = {f"{w}zehn": 10 + i for i, w in enumerate("drei vier fünf sech sieb acht neun".split(), 3)}
_VULGAR = {c: unicodedata.normalize("NFKC", c).replace("\u2044", "/") for c in "¼½¾⅓⅔⅛⅜⅝⅞"}

ALIAS = {s: u for u, names in SPELLINGS.items() for s in names.split()}
_UNIT = "|".join(sorted((re.escape(s) for s in ALIAS if s.isalpha()), key=len, reverse=True))
_of = lambda words: "|".join(sorted(words, key=len, reverse=True))
_WORD = _of(WORDS)
_ENGLISH = rf"(?:{_WORD})(?:(?:[\s-]+|\s+and\s+)(?:{_WORD}|hundred|thousand))*(?:\s+and\s+a\s+half)?|hundred|thousand"
_ONES = _of(w for w in GERMAN if w != "null")
_BELOW = rf"(?:(?:{_ONES})und(?:{_of(GERMAN_TENS)})|{_of(GERMAN_TENS)}|{_of(GERMAN_TEENS)}|{_of(w for w in GERMAN if w not in ('null', 'ein'))})"
_DEUTSCH = rf"(?:(?:{_ONES})?hundert(?:und)?{_BELOW}|(?:{_ONES})?hundert|{_BELOW})"
_FRACTION = "".join(_VULGAR)
# thousands are parted by a mark, or by a narrow or fixed space; whether a mark of three figures is one depends on the unit
_NUM = (
    rf"(?:\d+\s+\d+/\d+|\d+/\d+|\d*\s?[{_FRACTION}]|\d{{1,3}}(?:[.,'’\u00a0\u202f]\d{{3}})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,]\d+)?"
    rf"|\b(?:{_of(PARTS)})(?:\s+of)?(?:\s+an?)?\b|\b(?:{_ENGLISH})\b|\b{_DEUTSCH}\b)"
)
_QUANTITY = re.compile(
    rf"(?<![\w.,])(?P<nums>{_NUM}(?:\s*(?:[-–—+/×x]|\bto\b|\band\b|\bor\b|\bbis\b|\bund\b|\boder\b)\s*{_NUM})*)[\s-]*"
    rf"(?:(?P<unit>{_UNIT})(?![\w²³^])(?!\s*/\s*[a-z(])(?!\.\w)|(?P<mark>[\"″”]))",
    re.I,
)
_ONE = re.compile(_NUM, re.I)


def compositions(edges=EDGES, canonical: tuple[str, ...] = ("um", "degC")) -> dict[str, tuple[str, Fraction, Fraction]]:
    """unit -> (canonical unit, factor, offset) along a shortest path; ValueError if the edges contradict each other."""
    graph: dict[str, list[tuple[str, Fraction, Fraction]]] = {}
    for a, b, k, d in edges:
        k, d = Fraction(k), Fraction(d)
        graph.setdefault(b, []).append((a, k, d))
        graph.setdefault(a, []).append((b, 1 / k, -d / k))
    out: dict[str, tuple[str, Fraction, Fraction]] = {}
    for root in canonical:
        out[root] = (root, Fraction(1), Fraction(0))
        queue = deque([root])
        while queue:
            at = queue.popleft()
            _, k0, d0 = out[at]
            for other, k, d in graph.get(at, []):
                # at = k * other + d
                got = (root, k0 * k, k0 * d + d0)
                if other not in out:
                    out[other] = got
                    queue.append(other)
                elif out[other] != got:
                    raise ValueError(f"conversions of {other} contradict each other: {out[other]} and {got}")
    return out


def conversion_table(spark: SparkSession) -> DataFrame:
    """(unit, canonical, factor, offset), one row per unit; its size is that of the fixed graph."""
    rows = [(u, c, Decimal(k.numerator) / Decimal(k.denominator), Decimal(d.numerator) / Decimal(d.denominator)) for u, (c, k, d) in compositions().items()]
    rows = [(u, c, k.quantize(Decimal("1e-9")), d.quantize(Decimal("1e-9"))) for u, c, k, d in rows]
    return spark.createDataFrame(rows, "unit string, canonical string, factor decimal(24,9), offset decimal(24,9)")


def _german(word: str) -> int | None:
    """The value of a German number word below a thousand."""
    head, hundred, rest = word.rpartition("hundert")
    value = 100 * GERMAN.get(head or "ein", 1) if hundred else 0
    rest = rest.removeprefix("und") if hundred else rest
    for table in (GERMAN, GERMAN_TEENS, GERMAN_TENS):
        if rest in table:
            return value + table[rest]
    one, _, ten = rest.partition("und")
    if one in GERMAN and ten in GERMAN_TENS:
        return value + GERMAN[one] + GERMAN_TENS[ten]
    return value if hundred and not rest else None


def _in_words(words: list[str]) -> Decimal | None:
    """The value of English number words: each scale multiplies what stands before it."""
    total = below = Decimal(0)
    for w in words:
        if w in SCALES:
            below = (below or 1) * SCALES[w]
            total, below = (total + below, Decimal(0)) if w == "thousand" else (total, below)
        else:
            below += Decimal(PARTS[w]) if w in PARTS else WORDS[w]
    return total + below


def number(text: str, unit: str | None = None) -> Decimal | None:
    """The value of a figure: digits with point or comma, a plain or mixed fraction, or number words.

    Three figures behind a single mark are thousands in units as small as a millimetre (1,200 mm), decimals in others (6.125 in)."""
    s = text.strip().lower()
    for c, plain in _VULGAR.items():
        s = s.replace(c, f" {plain}")
    s = s.strip()
    if s[:1].isdigit():
        m = re.fullmatch(r"(?:(\d+)\s+)?(\d+)/(\d+)", s)
        if m:
            return Decimal(m[1] or 0) + Decimal(m[2]) / Decimal(m[3]) if int(m[3]) else None
        m = re.fullmatch(r"([1-9]\d{0,2})((?:[.,'’\u00a0\u202f]\d{3})+)(?:[.,](\d+))?", s)
        if m and (unit in ("mm", "um") or m[2][0] not in ".," or len(m[2]) > 4 or m[3]):
            return Decimal(re.sub(r"\D", "", m[1] + m[2]) + "." + (m[3] or "0")).normalize() + 0
        return Decimal(s.replace(",", ".")) if re.fullmatch(r"\d+(?:[.,]\d+)?", s) else None
    words = [w for w in re.split(r"[\s-]+", s) if w in WORDS or w in SCALES or w in PARTS]
    return _in_words(words) if words else None if (value := _german(s)) is None else Decimal(value)


def quantities(text: str | None) -> list[tuple[Decimal, str]]:
    """(figure, unit) of the lengths in a text, in their order; figures that share a unit are listed one by one."""
    out: list[tuple[Decimal, str]] = []
    for m in _QUANTITY.finditer(text or ""):
        unit = "in" if m["mark"] else ALIAS[m["unit"].lower()]
        figures: list[str] = []
        for f in _ONE.finditer(m["nums"]):
            s = f.group()
            frac = re.fullmatch(r"(?:(\d+)\s+)?(\d+)/(\d+)", s)
            if frac and not (unit in ("in", "ft") and int(frac[2]) < int(frac[3]) and int(frac[3]) in (2, 4, 8, 16, 32, 64)):
                figures += [x for x in re.split(r"[\s/]+", s) if x]
            else:
                figures.append(s)
        out += [(v, unit) for v in (number(f, unit) for f in figures) if v is not None]
    return out


_NOTE_WORD = re.compile(r"[^\W\d_]+|[\"″]")


def noted_unit(note: str | None) -> str | None:
    """The unit that a remark names. `in` is the preposition unless it ends the remark."""
    words = [w.lower() for w in _NOTE_WORD.findall(note or "")]
    named = [ALIAS[w] for i, w in enumerate(words) if w in ALIAS and (w != "in" or i == len(words) - 1)]
    return named[-1] if named else None


def thickness(text: str | None, figure: float | None, note: str | None, stated: str | None) -> tuple[str, str] | None:
    """(figure, unit) of a layer: its own text if set; else its figure in the unit of the remark, else in the unit in which the state's text gives the same figure, else in cm."""
    if text is not None and text.strip():
        got = quantities(text)
        if got:
            return (str(got[0][0]), got[0][1]) if got[0][0] > 0 else None
        m = re.fullmatch(rf"\D*?({_NUM})\s*", text.strip(), re.I)
        if not m:
            return None
        unit = noted_unit(note) or "cm"
        value = number(m[1], unit)
        return (str(value), unit) if value is not None and value > 0 and "-" not in text[: m.start(1)] else None
    if figure is None or figure != figure or figure <= 0:
        return None
    value = Decimal(repr(float(figure)))
    unit = noted_unit(note) or next((u for v, u in quantities(stated) if v == value), "cm")
    return str(value), unit


def to_common(found: DataFrame, canonical: str = "um", out: str = "um") -> DataFrame:
    """Figures (column `figure`, text) in their unit (column `unit`) as whole canonical units, by an equi-join on the unit.

    The conversion table has one row per unit of the fixed graph, so it is broadcast."""
    table = conversion_table(found.sparkSession).where(F.col("canonical") == canonical)
    value = F.col("figure").try_cast("decimal(20,9)") * F.col("factor") + F.col("offset")
    return found.join(F.broadcast(table), "unit").withColumn(out, F.round(value, 0).cast("bigint")).drop("figure", "unit", "canonical", "factor", "offset")


def text_quantities(df: DataFrame, text: str) -> DataFrame:
    """All columns of df but `text`, with mention_no, figure and unit: one row per length in the text."""
    keep = [c for c in df.columns if c != text]
    rows = df.where(F.col(text).isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text) + ", mention_no bigint, figure string, unit string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, heads = [], list(zip(*(pdf[c] for c in keep)))
            for head, t in zip(heads, pdf[text]):
                out += [(*head, i, str(v), u) for i, (v, u) in enumerate(quantities(t), 1) if v > 0]
            yield pd.DataFrame(out, columns=[*keep, "mention_no", "figure", "unit"])

    return rows.mapInPandas(read, schema)


def layer_quantities(df: DataFrame) -> DataFrame:
    """(…, figure, unit) of rows with thickness_text, thickness_cm, unit_note and english; rows without a thickness are left out."""
    keep = [c for c in df.columns if c not in ("thickness_text", "thickness_cm", "unit_note", "english")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep) + ", figure string, unit string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, tuple[str, str] | None] = {}
        for pdf in batches:
            out = []
            for head, case in zip(zip(*(pdf[c] for c in keep)), zip(pdf["thickness_text"], pdf["thickness_cm"].astype(object), pdf["unit_note"], pdf["english"])):
                case = tuple(None if isinstance(x, float) and x != x else x for x in case)
                if case not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[case] = thickness(*case)
                if known[case]:
                    out.append((*head, *known[case]))
            yield pd.DataFrame(out, columns=[*keep, "figure", "unit"])

    return df.mapInPandas(read, schema)
