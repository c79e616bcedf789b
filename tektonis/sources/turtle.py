"""Turtle and N-Triples to triple DataFrames, and back.

A Turtle file is one unit of parsing (prefixes and nested nodes reach across lines), so files are the unit of parallelism: one file per row, parsed in the Python workers. N-Triples is read line by line without leaving the JVM."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tektonis.operators.triples import RDF_TYPE, SCHEMA

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<kw>@prefix\b|@base\b|(?i:prefix|base)(?=\s+[\w<:-]))|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)|(?P<num>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\.?\d+(?:[eE][+-]?\d+)?)(?![\w:]))"""
    r"""|(?P<bnode>_:[\w.-]*[\w-])|(?P<name>[\w-]*(?:\.[\w-]+)*:(?:[\w:%-]|\\.|\.(?=[\w:%-]))*)|(?P<bool>true\b|false\b)|(?P<a>a(?=[\s<_\[]))|(?P<punct>[.;,\[\]()])""",
    re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(s: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), s)


class TurtleError(ValueError):
    pass


def parse_turtle(text: str, source: str = "") -> list[tuple]:
    """The triples of a Turtle document; blank nodes get names that are unique to the source. TurtleError where the text is no Turtle."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"no token at {text[at : at + 40]!r}")
        at = m.end()
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m.group()))
    salt = hashlib.md5(source.encode()).hexdigest()[:10]
    prefixes: dict[str, str] = {}
    base, out, fresh, i = "", [], 0, 0

    def blank(label: str | None = None) -> tuple:
        nonlocal fresh
        if label is None:
            fresh += 1
            label = f"b{fresh}"
        return f"_:{salt}_{label}", "bnode", None, None

    def iri(tok: str) -> str:
        return _unescape(tok[1:-1]) if ":" in tok else base + _unescape(tok[1:-1])

    def expand(name: str) -> str:
        p, _, local = name.partition(":")
        if p not in prefixes:
            raise TurtleError(f"prefix {p!r} is not declared")
        return prefixes[p] + re.sub(r"\\(.)", r"\1", local)

    def take(kind: str | None = None, value: str | None = None) -> str:
        nonlocal i
        if i >= len(tokens) or (kind and tokens[i][0] != kind) or (value and tokens[i][1] != value):
            raise TurtleError(f"{value or kind or 'a token'} expected, {tokens[i][1] if i < len(tokens) else 'end'!r} found")
        i += 1
        return tokens[i - 1][1]

    def peek(value: str) -> bool:
        return i < len(tokens) and tokens[i][0] == "punct" and tokens[i][1] == value

    def node() -> tuple:
        """(text, kind, language, datatype) of the next term; nested nodes add their triples."""
        nonlocal i
        if i >= len(tokens):
            raise TurtleError("a term expected, end found")
        kind, tok = tokens[i]
        i += 1
        if kind == "iri":
            return iri(tok), "iri", None, None
        if kind == "name":
            return expand(tok), "iri", None, None
        if kind == "bnode":
            return blank("x" + tok[2:])
        if kind in ("str", "long"):
            body = _unescape(tok[3:-3] if kind == "long" else tok[1:-1])
            if i < len(tokens) and tokens[i][0] == "lang":
                return body, "literal", take()[1:], None
            if i < len(tokens) and tokens[i][0] == "dt":
                take()
                return body, "literal", None, node()[0]
            return body, "literal", None, None
        if kind == "num":
            dt = "double" if "e" in tok.lower() else "decimal" if "." in tok else "integer"
            return tok, "literal", None, XSD + dt
        if kind == "bool":
            return tok, "literal", None, XSD + "boolean"
        if kind == "punct" and tok == "[":
            me = blank()
            if not peek("]"):
                properties(me)
            take("punct", "]")
            return me
        if kind == "punct" and tok == "(":
            items = []
            while not peek(")"):
                items.append(node())
            take("punct", ")")
            rest: tuple = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                cell = blank()
                out.append((cell[0], RDF + "first", *item))
                out.append((cell[0], RDF + "rest", *rest))
                rest = cell
            return rest
        raise TurtleError(f"a term expected, {tok!r} found")

    def properties(subject: tuple) -> None:
        nonlocal i
        while True:
            kind, tok = tokens[i] if i < len(tokens) else ("end", "")
            if kind == "a":
                i += 1
                p = RDF_TYPE
            elif kind in ("iri", "name"):
                p = node()[0]
            else:
                return
            while True:
                out.append((subject[0], p, *node()))
                if not peek(","):
                    break
                take()
            if not peek(";"):
                return
            while peek(";"):
                take()

    while i < len(tokens):
        kind, tok = tokens[i]
        if kind == "kw":
            i += 1
            if tok.lower().lstrip("@") == "prefix":
                name = take("name")[:-1]
                prefixes[name] = iri(take("iri"))
            else:
                base = iri(take("iri"))
            if tok[0] == "@":
                take("punct", ".")
            continue
        properties(node())
        take("punct", ".")
    return out


def read_turtle(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The set of triples of all files; blank nodes of different files stay different."""
    files = spark.read.text(paths, wholetext=True).withColumn("path", F.input_file_name())

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [t for text, path in zip(pdf["value"], pdf["path"]) for t in parse_turtle(text, path)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.mapInPandas(parse, SCHEMA).distinct()


_NT_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"[^"\\]*+(?:\\.[^"\\]*+)*+")(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?\s*\.\s*$'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples, line by line in the JVM, escapes undone; lines that are no triple are those of ntriples_rejects."""
    pattern = _NT_LINE
    part = lambda n: F.regexp_extract("value", pattern, n)
    plain = lambda c: F.from_json(F.concat(F.lit('["'), F.replace(c, F.lit("\\'"), F.lit("'")), F.lit('"]')), "array<string>", {"allowUnquotedControlChars": "true"})[0]
    term = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.regexp_replace(c, r'^[<"]|[>"]$', ""))
    o = part(3)
    kind = F.when(F.startswith(o, F.lit("<")), "iri").when(F.startswith(o, F.lit('"')), "literal").otherwise("bnode")
    rows = spark.read.text(path).where(F.rlike("value", F.lit(pattern)))

    @F.pandas_udf("string")
    def rare(values: pd.Series) -> pd.Series:
        return values.map(_unescape)

    # the escapes of JSON, but for those of eight figures
    body = term(o)
    far = F.contains(o, F.lit("\\U"))
    short = rows.where(~far).withColumn("_o", F.when(F.contains(o, F.lit("\\")), plain(body)).otherwise(body))
    rows = short.unionByName(rows.where(far).withColumn("_o", rare(body)))
    return rows.select(term(part(1)).alias("s"), part(2).alias("p"), F.col("_o").alias("o"), kind.alias("o_kind"), F.nullif(part(4), F.lit("")).alias("o_lang"), F.nullif(part(5), F.lit("")).alias("o_dt")).distinct()


def ntriples_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of N-Triples that are neither a triple, a comment nor blank."""
    return spark.read.text(path).where(~F.rlike("value", F.lit(_NT_LINE)) & ~F.rlike("value", F.lit(r"^\s*(#.*)?$")))


def turtle_lines(g: DataFrame) -> DataFrame:
    """(s, value): the statement of each subject, its properties and objects in code point order."""
    iri = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit('"'))
    literal = F.concat(quoted, F.coalesce(F.concat(F.lit("@"), "o_lang"), F.lit("")), F.coalesce(F.concat(F.lit("^^<"), "o_dt", F.lit(">")), F.lit("")))
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(iri(F.col("o")))
    pairs = g.select("s", F.concat(iri(F.col("p")), F.lit(" "), obj).alias("po")).distinct()
    return pairs.groupBy("s").agg(F.concat(iri(F.first("s")), F.lit(" "), F.array_join(F.sort_array(F.collect_list("po")), " ;\n    "), F.lit(" .")).alias("value"))


def write_turtle(g: DataFrame, path: str) -> None:
    """A folder of Turtle parts; every statement is whole, so each part is a document."""
    turtle_lines(g).select("value").write.mode("overwrite").text(path)
