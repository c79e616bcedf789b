"""Checks over graphs: range audit, shapes compiled to joins and counts, comparison with gold structures, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tektonis.operators.triples import RDF_TYPE, match

ISSUE = ("kind", "s", "o")


def _issues(df: DataFrame, kind: str) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), "s", "o")


def range_audit(g: DataFrame, functions: DataFrame, anchors: DataFrame, types: DataFrame, fn_p: str, cat_p: str, typ_p: str, layer_class: str) -> DataFrame:
    """(kind, s, o): functions outside the vocabulary, categories that are no anchor, categories on a layer, types without an anchor (orphan if known, else invalid).

    Vocabularies are the right sides of anti joins; Catalyst sends them to the workers where they are small."""
    of = lambda p: match(g, p=p).select("s", "o").distinct()
    iri = lambda t, c="iri": t.select(F.col(c).alias("o")).distinct()
    layers = match(g, p=RDF_TYPE, o=layer_class).select("s").distinct()
    loose = of(typ_p).join(iri(anchors), "o", "left_anti")
    known = iri(types)
    parts = [
        _issues(of(fn_p).join(iri(functions), "o", "left_anti"), "function_range"),
        _issues(of(cat_p).join(iri(anchors, "anchor"), "o", "left_anti"), "category_range"),
        _issues(of(cat_p).join(layers, "s", "left_semi"), "category_on_layer"),
        _issues(loose.join(known, "o", "left_semi"), "type_orphan"),
        _issues(loose.join(known, "o", "left_anti"), "type_invalid"),
    ]
    return reduce(DataFrame.unionByName, parts)


def cardinality(g: DataFrame, target: str, p: str, least: int | None = None, most: int | None = None, severity: str = "violation") -> DataFrame:
    """(severity, focus, message) of instances of a class with too few or too many values of a property."""
    focus = match(g, p=RDF_TYPE, o=target).select(F.col("s").alias("focus")).distinct()
    n = match(g, p=p).groupBy(F.col("s").alias("focus")).agg(F.countDistinct("o").alias("n"))
    counted = focus.join(n, "focus", "left").na.fill(0, ["n"])
    bad = F.lit(False)
    if least is not None:
        bad = bad | (F.col("n") < least)
    if most is not None:
        bad = bad | (F.col("n") > most)
    return counted.where(bad).select(F.lit(severity).alias("severity"), "focus", F.concat(F.lit(f"{p}: "), F.col("n").cast("string"), F.lit(" values")).alias("message"))


def object_class(g: DataFrame, p: str, cls: str, severity: str = "violation") -> DataFrame:
    """Values of a property that are no instance of a class."""
    typed = match(g, p=RDF_TYPE, o=cls).select(F.col("s").alias("o")).distinct()
    return match(g, p=p).select("s", "o").distinct().join(typed, "o", "left_anti").select(F.lit(severity).alias("severity"), F.col("s").alias("focus"), F.concat(F.lit(f"{p}: no {cls}: "), "o").alias("message"))


def none_of(g: DataFrame, target: str, classes: list[str], severity: str = "warning") -> DataFrame:
    """Instances of a class that have none of some further classes."""
    has = g.where((F.col("p") == RDF_TYPE) & F.col("o").isin(*classes)).select("s").distinct()
    return match(g, p=RDF_TYPE, o=target).select("s").distinct().join(has, "s", "left_anti").select(F.lit(severity).alias("severity"), F.col("s").alias("focus"), F.lit("no topology").alias("message"))


def mixed_types(g: DataFrame, classes: list[str]) -> DataFrame:
    """Subjects with more than one of some classes, by one aggregation in place of a self-join."""
    got = g.where((F.col("p") == RDF_TYPE) & F.col("o").isin(*classes)).groupBy("s").agg(F.sort_array(F.collect_set("o")).alias("found")).where(F.size("found") > 1)
    return got.select(F.lit("violation").alias("severity"), F.col("s").alias("focus"), F.array_join("found", ", ").alias("message"))


def forbidden_with(g: DataFrame, p: str, o: str, other: str) -> DataFrame:
    """Subjects with a value that must not also have another property."""
    return match(g, p=p, o=o).select("s").distinct().join(match(g, p=other).select("s").distinct(), "s", "left_semi").select(F.lit("violation").alias("severity"), F.col("s").alias("focus"), F.lit(f"has {other}").alias("message"))


def either_property(g: DataFrame, nodes: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Nodes that lack every property of some group."""
    every = [p for ps in groups for p in ps]
    flags = g.where(F.col("p").isin(*every)).groupBy("s").agg(*[F.max(F.col("p").isin(*ps)).alias(f"g{i}") for i, ps in enumerate(groups)])
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"g{i}"), F.lit(False)) for i in range(len(groups))])
    return nodes.select("s").distinct().join(flags, "s", "left").where(~ok).select(F.lit("violation").alias("severity"), F.col("s").alias("focus"), F.lit("value or unit is missing").alias("message"))


def ordered_report(rows: DataFrame) -> DataFrame:
    """Violations first, then by focus."""
    return rows.orderBy(F.expr("severity <> 'violation'"), F.coalesce("focus", F.lit("")), "message")


def severity_of(result: Column, constraint: Column) -> Column:
    """A warning of the result or the constraint wins, else the result's own, else a violation."""
    return F.when((result == "warning") | (constraint == "warning"), "warning").otherwise(F.coalesce(result, F.lit("violation")))


def signature(layers: DataFrame, element: str, layer_set: str, fields: list[str]) -> DataFrame:
    """(element, signature): the nested, sorted structure of an element, blind to names and order; layer sets are a bag."""
    key = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("-")) for f in fields])
    sets = layers.select(element, layer_set, key.alias("k")).groupBy(element, layer_set).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("k")), ";"), F.lit("]")).alias("s"))
    return sets.groupBy(element).agg(F.array_join(F.sort_array(F.collect_list("s")), "").alias("signature"))


def positional_diff(predicted: DataFrame, gold: DataFrame, key: str, value: str) -> DataFrame:
    """(key, place, predicted, gold) where the sorted values of two tables differ."""
    w = Window.partitionBy(key).orderBy(value)
    put = lambda df, name: df.select(key, F.col(value).alias(name), F.row_number().over(w).alias("place"))
    both = put(predicted, "predicted").join(put(gold, "gold"), [key, "place"], "full_outer")
    return both.where(~F.col("predicted").eqNullSafe(F.col("gold")))


def reused(links: DataFrame, owner: str, member: str) -> DataFrame:
    """(member, owners): members of more than one owner."""
    return links.groupBy(member).agg(F.countDistinct(owner).alias("owners")).where("owners > 1")


def validity_pct(bad: Column, slots: Column) -> Column:
    """100 less the percentage of bad slots, to one decimal, half to even, not below 0; without slots 100 if nothing is bad, else 0."""
    return F.when(slots == 0, F.when(bad == 0, 100.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.bround(100.0 * (1 - bad / slots), 1)))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def file_audit(issues: DataFrame, shapes: DataFrame, files: DataFrame) -> DataFrame:
    """(path, issues, violations, warnings, conforms) of every file; issues and shape results have the path of the file they come from. A file conforms without a violation."""
    i = issues.groupBy("path").agg(F.count("*").alias("issues"))
    s = shapes.groupBy("path").agg(F.count_if(F.col("severity") == "violation").alias("violations"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = files.select("path").distinct().join(i, "path", "left").join(s, "path", "left").na.fill(0, ["issues", "violations", "warnings"])
    return out.withColumn("conforms", F.col("violations") == 0)


def gold_score(cases: DataFrame, predicted: DataFrame, gold: DataFrame, key: str = "id", signature: str = "signature") -> DataFrame:
    """(key, score): 100 for an equal signature or a case without gold, 0 for another, null for a gold case without output."""
    p = predicted.select(key, F.col(signature).alias("_p"))
    g = gold.select(key, F.col(signature).alias("_g"))
    j = cases.select(key).distinct().join(p, key, "left").join(g, key, "left")
    return j.select(key, F.when(F.col("_g").isNull(), 100.0).when(F.col("_p").isNull(), None).when(F.col("_p") == F.col("_g"), 100.0).otherwise(0.0).alias("score"))
