"""Freely typed values to the entries of a reference list.

Token-level repair: the distinct tokens of the distinct values are joined to the tokens of the reference names by edit distance, through keys that every pair within reach shares (an edit, also a swap, touches two pieces of a name's token at most, so of one piece more than twice the distance one occurs unchanged, nearly in place). Then soft TF-IDF over the repaired tokens ranks whole entries. A value written as one word, or with its spaces in wrong places, is also taken as a single token and matched with the names written as one word.

Everything runs on distinct values and tokens; the result is joined back to the rows, so a value that fills a third of all rows is matched once.

Defined results
    null value                  no row
    blank value, only fillers   ref_id 0
    no entry near enough        ref_id 0
    ties                        the entry with the lower ref_id
    very long value or token    as any other; keys are made only for the lengths that reference tokens have
    null or blank synonym       ignored; one of an unknown entry too
    repeated rows               one result
    empty values or reference   empty result, or ref_id 0 for every value
    extra columns               ignored
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tektonis.llm.terms import FILLERS, WEAK
from tektonis.runtime import cut, python_partitions, spread

_IRI = re.compile(r"^[<\"'\s]*(?:https?://)?(?:www\.)?[\w-]+(?:\.[\w-]+)+/\S*$", re.I)
_PREFIX = re.compile(r"^\s*(?:[a-z]{0,10}:(?=\S)|(?:fn|function|cat|category|kind|type|class|mat|material)\s*[=:]\s*)", re.I)
_LATER = re.compile(r"[.;]*\s*\b(?:usual|advanced|üblich|erweitert)\s*:.*$", re.I | re.S)
_QUANTITY = re.compile(r"\(?\b(?:d\s*=\s*)?(?:\d+\s+)?\d+(?:[.,/]\d+)?\s*(?:mm|cm|dm|m|in|inch|inches|zoll|\")(?![\w²³])\.?(?:\s+(?:of\s+)?(?:insulation|dämmung|boards?))?\)?|\bwith\s+insulation\b|\[\d+\]|\(\d+\)", re.I)
_CAMEL = re.compile(r"(?<=[a-zäöüß])(?=[A-ZÄÖÜ])|(?<=[A-Z])(?=[A-Z][a-z])")
_LOOKS = str.maketrans({"0": "o", "1": "l", "3": "e", "5": "s", "8": "b", "$": "s", "|": "l"})


def fold(text: str) -> str:
    """Lower case, umlauts written out, other accents dropped."""
    s = unicodedata.normalize("NFKC", text).casefold()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = s.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def tokens(value: str) -> list[str]:
    """The tokens of a value that say what is meant: no IRI parts, quantities, remarks and fillers."""
    s = unicodedata.normalize("NFKC", value).strip().strip("<>\"'„“”«»").strip()
    if _IRI.match(s):
        parts = [p for p in re.split(r"[#/]", s) if p.strip()]
        s = parts[-1] if parts else ""
    s = _PREFIX.sub("", s)
    s = _LATER.sub("", s)
    s = _QUANTITY.sub(" ", s)
    letters = [c for c in s if c.isalpha()]
    if letters and not all(c.isupper() for c in letters):
        s = _CAMEL.sub(" ", s)
    s = " ".join(w.translate(_LOOKS) if any(c.isalpha() for c in w) else w for w in re.split(r"[\s_]+", fold(s)))
    for phrase in FILLERS:
        s = re.sub(rf"(?<![a-z]){phrase}(?![a-z])", " ", s)
    return re.findall(r"[^\W\d_]+", s)


def reach(length: int) -> int:
    """The edits allowed to a reference token of this length."""
    return 0 if length < 3 else 1 if length < 6 else 2 if length < 10 else 3


def osa(a: str, b: str, limit: int) -> int:
    """Edit distance with neighbouring characters swapped as one edit; limit + 1 if above."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, cur[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            cur.append(v)
        if min(cur) > limit:
            return limit + 1
        two, one = one, cur
    return min(one[-1], limit + 1)


def _pieces(length: int, parts: int) -> list[tuple[int, int]]:
    """Places of the pieces of a token, as even as can be."""
    cuts = [length * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def reference_keys(token: str) -> set[str]:
    """Keys of a reference token: its pieces, and its beginnings for abbreviated forms."""
    n, t = len(token), reach(len(token))
    out = {f"{n}:{i}:{token[a:b]}" for i, (a, b) in enumerate(_pieces(n, 2 * t + 1)) if b > a}
    return out | {f"p:{token[:k]}" for k in range(3, n)}


def query_keys(token: str, lengths: frozenset[int] | None = None) -> set[str]:
    """Keys of a typed token: each piece that a reference token within reach could share with it. `lengths` are those of the reference tokens, if they are known."""
    n = len(token)
    if lengths is not None and n > max(lengths, default=0) + 3:
        return set()
    out = {f"p:{token}"} if n > 2 else set()
    for length in range(max(1, n - 3), n + 4):
        t = reach(length)
        if abs(length - n) > t or lengths is not None and length not in lengths:
            continue
        for i, (a, b) in enumerate(_pieces(length, 2 * t + 1)):
            out |= {f"{length}:{i}:{token[s : s + b - a]}" for s in range(max(0, a - t), min(n - (b - a), a + t) + 1)}
    return out


def similarity(typed: str, meant: str) -> float:
    """1 for equal tokens, less for edits, 0.9 for a beginning of three characters or more; 0 out of reach."""
    if typed == meant:
        return 1.0
    t = reach(len(meant))
    d = osa(typed, meant, t)
    sim = 1 - d / max(len(meant), len(typed)) if d <= t else 0.0
    return max(sim, 0.9) if len(typed) > 2 and meant.startswith(typed) else sim


_DOCS = "kind string, {id} {type}, form string, token string, place int, weak boolean"


def _documents(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(kind, id, form, token, place): the tokens of a text, and the text written as one word."""
    kind = df.schema[id_column].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, i, s in zip(pdf["kind"], pdf[id_column], pdf["text"]):
                got = tokens(s) if s else []
                out += [(k, i, "words", t, n, t in WEAK) for n, t in enumerate(got)]
                strong = [t for t in got if t not in WEAK]
                out += [(k, i, f"whole{n}", "".join(x), 0, False) for n, x in enumerate((got, strong)) if x and (not n or x != got)]
            yield pd.DataFrame(out, columns=["kind", id_column, "form", "token", "place", "weak"])

    return df.select("kind", id_column, F.col(text).alias("text")).mapInPandas(read, _DOCS.format(id=f"`{id_column}`", type=kind))


def reference_names(reference: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(kind, ref_id, name): labels, local names and, if they are given as (kind, local_name, name), synonyms."""
    own = reference.select("kind", "ref_id", F.explode(F.array_compact(F.array("local_name", "label_en", "label_de"))).alias("name"))
    if synonyms is not None:
        named = synonyms.select("kind", "local_name", "name").where("name IS NOT NULL AND trim(name) <> ''")
        own = own.unionByName(named.join(reference.select("kind", "local_name", "ref_id"), ["kind", "local_name"]).select("kind", "ref_id", "name"))
    # umlauts are also typed, or lost, as their base letters
    bare = own.withColumn("name", F.translate("name", "äöüÄÖÜ", "aouAOU"))
    return own.unionByName(bare).distinct()


def match_values(values: DataFrame, names: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(kind, value, ref_id, score) of distinct (kind, value); values without an entry near enough are left out."""
    names = names.withColumn("name_id", F.xxhash64("kind", "ref_id", "name"))
    whole = F.when(F.col("form").startswith("whole"), "whole").otherwise(F.col("form"))
    ref = cut(_documents(names.withColumnRenamed("name", "text"), "name_id", "text").withColumn("name_doc", F.xxhash64("name_id", "form")).withColumn("form", whole).drop("weak").distinct())
    docs = cut(_documents(spread(values.select("kind", "value")), "value", "value").withColumn("doc", F.col("form")).withColumn("form", whole).distinct())

    # inverse document frequencies over the names of a kind
    total = ref.where("form = 'words'").groupBy("kind").agg(F.countDistinct("name_id").alias("names"))  # one row a kind
    idf = ref.groupBy("kind", "form", "token").agg(F.countDistinct("name_id").alias("df")).join(total, "kind")
    idf = idf.select("kind", "form", "token", F.log(1 + F.col("names") / F.col("df")).alias("idf"), F.log(1 + F.col("names")).alias("most"))
    weighted = ref.join(idf, ["kind", "form", "token"])
    norms = weighted.groupBy("kind", "name_doc", "name_id", "form").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))

    # distinct tokens within reach of each other
    def keyed(make):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([(k, f, t, x) for k, f, t in zip(pdf["kind"], pdf["form"], pdf["token"]) for x in make(t)], columns=["kind", "form", "token", "key"])

        return run

    schema = "kind string, form string, token string, key string"
    lengths = frozenset(r.n for r in ref.select(F.length("token").alias("n")).distinct().collect())  # one row for each length
    # so many partitions, or the few bytes of the tokens would be one task
    left = docs.select("kind", "form", "token").distinct().repartition(python_partitions(docs.sparkSession), "token").mapInPandas(keyed(partial(query_keys, lengths=lengths)), schema).withColumn("key", F.xxhash64("key"))
    right = ref.select("kind", "form", "token").distinct().mapInPandas(keyed(reference_keys), schema).select("kind", "form", F.col("token").alias("meant"), F.xxhash64("key").alias("key"))
    pairs = left.join(right, ["kind", "form", "key"]).select("kind", "form", "token", "meant").distinct().repartition(python_partitions(docs.sparkSession), "token")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sim = [similarity(a, b) if f == "words" or not b.startswith(a) else max(0.0, 1 - osa(a, b, reach(len(b))) / len(b)) if osa(a, b, reach(len(b))) <= reach(len(b)) else 0.0 for f, a, b in zip(pdf["form"], pdf["token"], pdf["meant"])]
            yield pdf.assign(sim=sim)[lambda x: x["sim"] > 0.55]

    near = pairs.mapInPandas(measure, "kind string, form string, token string, meant string, sim double")

    # soft TF-IDF: each token of the value counts with its best partner in the name
    hits = docs.join(near, ["kind", "form", "token"]).join(weighted.select("kind", "form", F.col("token").alias("meant"), "name_doc", "idf").distinct(), ["kind", "form", "meant"])
    best = hits.groupBy("kind", "value", "doc", "form", "name_doc", "place", "weak").agg(F.max(F.struct("sim", "idf")).alias("b"))
    sums = best.groupBy("kind", "value", "doc", "form", "name_doc").agg(F.sum(F.col("b.sim") * F.col("b.idf") * F.col("b.idf")).alias("dot"), F.sum(F.col("b.idf") * F.col("b.idf")).alias("square"), F.count_if(~F.col("weak")).alias("met"))
    size = docs.groupBy("kind", "value", "doc").agg(F.count_if(~F.col("weak")).alias("size"))
    most = idf.groupBy("kind").agg(F.max("most").alias("most"))  # one row a kind
    scored = sums.where("met > 0").join(size, ["kind", "value", "doc"]).join(norms, ["kind", "name_doc", "form"]).join(most, "kind")
    # tokens without a partner weigh as much as the rarest
    scored = scored.withColumn("score", F.col("dot") / (F.col("norm") * F.sqrt(F.col("square") + (F.col("size") - F.col("met")) * F.col("most") * F.col("most"))))
    scored = scored.join(names.select("name_id", "ref_id"), "name_id").where(F.col("score") >= threshold)
    top = scored.groupBy("kind", "value").agg(F.max(F.struct(F.round("score", 6).alias("score"), (-F.col("ref_id")).alias("neg"))).alias("top"))
    return top.select("kind", "value", (-F.col("top.neg")).alias("ref_id"), F.col("top.score").alias("score"))


def map_to_reference(rows: DataFrame, reference: DataFrame, threshold: float = 0.7, synonyms: DataFrame | None = None) -> DataFrame:
    """The rows (with columns kind and value) with ref_id added; 0 where no entry of the kind is meant.

    `synonyms` is a thesaurus (kind, local_name, name) of further names; without one an entry is found by its own names alone."""
    values = cut(rows.select("kind", "value").where(F.col("value").isNotNull()).distinct())
    found = match_values(values, reference_names(reference, synonyms), threshold).select("kind", "value", "ref_id")
    return rows.where(F.col("value").isNotNull()).join(found, ["kind", "value"], "left").na.fill(0, ["ref_id"])
