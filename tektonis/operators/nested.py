"""Deeply nested records to related flat tables that keep parent-child links.

Every record is parsed into path-value-ordinal triples: one row for every scalar, with the path of the object it belongs to, that object's repeated ancestor and its place among its siblings. Paths are grouped by their repeated ancestor, and each group is pivoted into one table whose rows name their parent. Repeated are the members of every array that holds objects, wherever one is found, and the entries of objects used as maps, which a layout names since nothing in JSON tells them from others. All other fields belong to the record.

Defined results
    null, blank or broken JSON        no triples (a record that ends early gives none at all)
    JSON in a string in JSON          unwrapped, at any depth; a byte-order mark is dropped
    several records in one payload    taken together; each has a row of its own in the group `record`
    scalars outside any record        fields of the one node `payload`
    null or empty objects             no node
    map in list layout                the entry's `name` is its key; an entry without one is keyed by its 1-based place
    bare value in place of an object  a node with the one field `value`, where the path is declared as such; in a map, a field of the map's owner
    null values                       no triple
    repeated rows                     one result
    empty table                       empty result with the same columns
    extra columns                     ignored
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tektonis.runtime import spread

TRIPLE = "grp string, parent_node string, node string, ordinal bigint, field string, value string"

#: The layout of a building payload: where records may be found, and which objects are maps or single children.
BUILDING = {
    "roots": ("building", "elements"),
    "single": {("building", "heat_supply_system"): "heat"},
    "maps": {"elements": "elements/*", "elements/*/states": "elements/*/*"},
}
ROOT, PAYLOAD = "record", "payload"  # the groups of a record's own fields, and of what stands beside the records


def unwrap(text: str | None):
    """The value of a JSON text that may itself be a JSON string; None if it is broken or incomplete."""
    while isinstance(text, str):  # each turn undoes one level of quoting, so the text gets shorter
        try:
            text = json.loads(text.strip().lstrip("\ufeff"))
        except (ValueError, RecursionError):
            return None
    return text


def records(value, roots: tuple[str, ...]) -> Iterator[dict]:
    """The objects with one of the root keys, at the outermost level where there are any."""
    stack = [value]
    while stack:
        at = stack.pop()
        if isinstance(at, str) and at.lstrip()[:1] in ("{", "["):
            at = unwrap(at)
        if isinstance(at, dict):
            if any(k in at for k in roots):
                yield at
            else:
                stack += list(at.values())[::-1]
        elif isinstance(at, list):
            stack += at[::-1]


def _text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _keyed(value) -> Iterator[tuple[str, object, int, str]]:
    """(key, entry, place, path) of a map, or of a list used as one."""
    if isinstance(value, dict):
        yield from ((str(k), v, i, f".{k}") for i, (k, v) in enumerate(value.items(), 1))
    elif isinstance(value, list):
        for i, v in enumerate(value, 1):
            named = isinstance(v, dict) and v.get("name") is not None
            yield str(v["name"]) if named else str(i), v, i, f"[{i}]"


class _Triples:
    """The triples of one payload: each scalar goes to the object, among those that repeat, which it stands in."""

    def __init__(self, layout: dict):
        self.layout, self.out = layout, []
        self.single = {".".join(path): grp for path, grp in layout["single"].items()}

    def node(self, grp: str, parent: str, node: str, ordinal: int, value) -> None:
        """An object with its scalars; one without any has one row with a null field."""
        n = len(self.out)
        own = (grp, parent, node, ordinal)
        if isinstance(value, dict):
            for k, v in value.items():
                self.field(own, str(k), v)
        else:
            self.field(own, "value", value)
        if not any(t[:4] == own for t in self.out[n:]):
            self.out.insert(n, (*own, None, None))

    def field(self, own: tuple, path: str, value) -> None:
        grp, _, node, _ = own
        if isinstance(value, dict | list) and (place := f"{grp}/{path}".lstrip("/").removeprefix(ROOT + "/")) in self.layout["maps"]:
            self.entries(own, path, value, self.layout["maps"][place])
        elif grp == ROOT and path in self.single and value not in (None, {}, []) and not (isinstance(value, str) and not value.strip()):
            name = self.single[path]
            self.node(name, "", name, 1, value)
        elif isinstance(value, dict):
            for k, v in value.items():
                self.field(own, f"{path}.{k}", v)
        elif isinstance(value, list) and any(isinstance(x, dict | list) for x in value):
            at = path if grp == ROOT else f"{node}/{path}"
            for i, x in enumerate(value, 1):
                if x is not None:
                    self.node(f"{grp}/{path}/*", node, f"{at}/{i}", i, x)
        elif isinstance(value, list):
            for i, x in enumerate(value, 1):
                self.field(own, f"{path}[{i}]", x)
        elif value is not None:
            self.out.append((*own, path, _text(value)))

    def entries(self, own: tuple, path: str, value, grp: str) -> None:
        """The entries of a map are nodes; what is no object stays a field of the map's owner."""
        base = f"{path}" if own[0] == ROOT else own[2]
        parent = "" if own[0] == ROOT else own[2]
        for key, entry, i, at in _keyed(value):
            listed = isinstance(value, list)
            if isinstance(entry, dict) and len(entry) > (listed and entry.get("name") is not None):
                self.node(grp, parent, f"{base}/{key}", i, entry)
            else:
                self.field(own, path + at, entry)

    def payload(self, value, path: str = "", count: list[int] | None = None) -> None:
        """Records wherever they are wrapped; what stands beside them are fields of the payload."""
        count = count if count is not None else [0]
        if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
            value = got if (got := unwrap(value)) is not None else value
        if isinstance(value, dict) and any(k in value for k in self.layout["roots"]):
            count[0] += 1
            self.node(ROOT, "", f"{ROOT}/{count[0]}", count[0], value)
        elif isinstance(value, dict):
            for k, v in value.items():
                self.payload(v, f"{path}.{k}" if path else str(k), count)
        elif isinstance(value, list):
            for i, v in enumerate(value, 1):
                self.payload(v, f"{path}[{i}]", count)
        elif value is not None:
            self.out.append((PAYLOAD, "", PAYLOAD, 1, path or "value", _text(value)))


def record_triples(payload: str | None, layout: dict = BUILDING, every: bool = False) -> list[tuple]:
    """(grp, parent_node, node, ordinal, field, value) of one payload, one for every scalar of the groups that the layout names, with `every` for every scalar there is; a node without scalars has one row with a null field."""
    got = _Triples(layout)
    got.payload(unwrap(payload))
    if every:
        return got.out
    named = set(groups(layout))
    return [t for t in got.out if t[0] in named]


def groups(layout: dict = BUILDING) -> list[str]:
    """The groups that a layout names; the others are found in the data."""
    return [*layout["single"].values(), *layout["maps"].values()]


def triples(df: DataFrame, key: str, payload: str, layout: dict = BUILDING, every: bool = False) -> DataFrame:
    """(key, grp, parent_node, node, ordinal, field, value), one row per scalar of every record (see record_triples)."""
    rows = spread(df.select(F.col(key).alias("key"), F.col(payload).alias("payload")).where(F.col("payload").isNotNull()), "key").distinct()
    kind = df.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", *(x.split()[0] for x in TRIPLE.split(", "))]
        for pdf in batches:
            yield pd.DataFrame([(k, *t) for k, p in zip(pdf["key"], pdf["payload"]) for t in record_triples(p, layout, every)], columns=names)

    return rows.mapInPandas(parse, f"key {kind}, {TRIPLE}").withColumnRenamed("key", key)


def unwrapped(df: DataFrame, key: str, payload: str, roots: tuple[str, ...] = BUILDING["roots"]) -> DataFrame:
    """(key, record), one row with plain JSON for every record of a payload; a readable object without any of the roots is its own record."""
    rows = spread(df.select(F.col(key).alias("key"), F.col(payload).alias("payload")).where(F.col("payload").isNotNull()), "key").distinct()
    kind = df.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, p in zip(pdf["key"], pdf["payload"]):
                value = unwrap(p)
                found = list(records(value, roots)) or ([value] if isinstance(value, dict) else [])
                out += [(k, json.dumps(r)) for r in found]
            yield pd.DataFrame(out, columns=["key", "record"])

    return rows.mapInPandas(parse, f"key {kind}, record string").withColumnRenamed("key", key)


def nodes(found: DataFrame, key: str) -> DataFrame:
    """(key, parent_node, node), one row per object."""
    return found.select(key, "parent_node", "node").distinct()


def pivot_group(found: DataFrame, key: str, grp: str, fields: list[str]) -> DataFrame:
    """The flat table of one group: key, parent_node, node, ordinal and one column per field.

    The fields are given, so no pass over the data is needed to learn them; a field that occurs twice in an object keeps its last value in sort order."""
    cols = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    return found.where(F.col("grp") == grp).groupBy(key, "parent_node", "node", "ordinal").agg(*cols)


def _fields(item: Column, kind: DataType, skip: str | None, path: str = "") -> list[tuple[str, Column]]:
    """Field paths and values, as strings, of a member: structs are walked, other arrays and maps are JSON texts."""
    if isinstance(kind, StructType):
        return [x for f in kind.fields if path or f.name != skip for x in _fields(item[f.name], f.dataType, skip, f"{path}.{f.name}" if path else f.name)]
    return [(path or "value", F.to_json(item) if isinstance(kind, (ArrayType, MapType)) else item.cast("string"))]


def array_triples(df: DataFrame, key: str, column: str, levels: list[tuple[str, str]]) -> DataFrame:
    """(key, grp, parent_node, node, ordinal, field, value) for arrays nested in arrays, without leaving the JVM; a member without scalars has one row with a null field.

    `levels` lists, from the outside in, the field that holds the array (the first is `column` itself) and the name its members get in a node path; a group is that path with stars for the places. Every member counts, also a null one; null and empty arrays give none."""
    rows = df.select(F.col(key), F.col(column).alias("_at"))
    out = None
    parent: Column = F.lit("")
    grp = ""
    for depth, (field, name) in enumerate(levels):
        arr = F.col("_at") if depth == 0 else F.col("_item")[field]
        base = rows.select(key, parent.alias("parent_node"), F.posexplode(arr).alias("_i", "_item"))
        node = F.concat_ws("/", *([] if depth == 0 else ["parent_node"]), F.lit(name), (F.col("_i") + 1).cast("string"))
        rows = base.withColumn("node", node)
        grp = f"{grp}/{name}/*".lstrip("/")
        below = levels[depth + 1][0] if depth + 1 < len(levels) else None
        pairs = [F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in _fields(F.col("_item"), rows.schema["_item"].dataType, below)]
        none = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")))
        found = F.filter(F.array(*pairs), lambda x: x["value"].isNotNull()) if pairs else none
        ordinal = (F.col("_i") + 1).cast("bigint")
        flat = rows.select(key, F.lit(grp).alias("grp"), "parent_node", "node", ordinal.alias("ordinal"), F.explode(F.when(F.size(found) > 0, found).otherwise(none)).alias("_t"))
        flat = flat.select(key, "grp", "parent_node", "node", "ordinal", "_t.field", "_t.value")
        out = flat if out is None else out.unionByName(flat)
        parent = F.col("node")
    return out


def array_nodes(df: DataFrame, key: str, column: str, levels: list[tuple[str, str]]) -> DataFrame:
    """(key, parent_node, node), one row per member of the arrays that `levels` names (see array_triples)."""
    return nodes(array_triples(df, key, column, levels), key)
