"""Document-style queries compiled to DataFrame calls: filters, projections, sorts, pages, pipelines."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.storage import cut

_COMPARE = {
    "$eq": lambda c, v: c.isNull() if v is None else c == v,
    "$ne": lambda c, v: c.isNotNull() if v is None else c.isNull() | (c != v),
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: c.isNull() | ~c.isin(list(v)),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
    "$regex": lambda c, v: c.rlike(v),
}


def _path(name: str, schema: T.StructType | None) -> tuple[Column, T.DataType | None]:
    """The values at a dotted path and their type; through arrays of documents the path gives an array of what each has."""
    c, kind = F.col(name), None
    if schema is not None:
        first, *rest = name.split(".")
        if name in schema.names:
            return c, schema[name].dataType
        if first in schema.names:
            c, kind = F.col(first), schema[first].dataType
            for field in rest:
                c, kind = _inner(c, kind, field)
    return c, kind


def _inner(c: Column, kind: T.DataType, field: str) -> tuple[Column, T.DataType]:
    if isinstance(kind, T.StructType) and field in kind.names:
        return c[field], kind[field].dataType
    if isinstance(kind, T.ArrayType):
        if field.isdigit():
            return F.get(c, int(field)), kind.elementType
        _, below = _inner(c, kind.elementType, field)
        each = F.transform(c, lambda x: _inner(x, kind.elementType, field)[0])
        return (F.flatten(each), below) if isinstance(below, T.ArrayType) else (each, T.ArrayType(below))
    raise ValueError(f"no field {field} in {kind.simpleString()}")


def _holds(c: Column, kind: T.DataType | None, op: str, v: Any) -> Column:
    """Whether a value, or any item of an array, compares so; those that say what must not be hold where no item is it."""
    if op == "$elemMatch":
        if not isinstance(kind, T.ArrayType):
            raise ValueError("$elemMatch is for arrays")
        plain = all(k.startswith("$") for k in v)
        inside = lambda x: _all(_holds(x, kind.elementType, k, w) for k, w in v.items()) if plain else _within(x, kind.elementType, v)
        return F.coalesce(F.exists(c, lambda x: F.coalesce(inside(x), F.lit(False))), F.lit(False))
    if op == "$size":
        return c.isNotNull() & (F.size(c) == v)
    if op == "$all":
        return _all(_holds(c, kind, "$eq", w) for w in v)
    if op not in _COMPARE:
        raise ValueError(f"unknown operator {op}")
    if isinstance(kind, T.ArrayType) and op != "$exists" and v is not None:
        if isinstance(v, list) and op in ("$eq", "$ne"):
            return _COMPARE[op](c, F.array(*map(F.lit, v)))
        if op in ("$ne", "$nin"):
            return ~_holds(c, kind, "$eq" if op == "$ne" else "$in", v)
        return F.coalesce(F.exists(c, lambda x: F.coalesce(_holds(x, kind.elementType, op, v), F.lit(False))), F.lit(False))
    return _COMPARE[op](c, v)


def _within(x: Column, kind: T.DataType, spec: dict[str, Any]) -> Column:
    """A filter document about one item."""
    parts = []
    for field, want in spec.items():
        c, own = x, kind
        for step in field.split("."):
            c, own = _inner(c, own, step)
        parts += [_holds(c, own, op, v) for op, v in (want.items() if isinstance(want, dict) else [("$eq", want)])]
    return _all(parts)


def _all(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def condition(spec: dict[str, Any], schema: T.StructType | None = None) -> Column:
    """A filter document as a Column; several entries must all hold. An unknown operator is an error.

    With the table's schema, fields may be dotted paths through documents and arrays, and a comparison with an array holds where one of its
    items does; $elemMatch wants one item for which all of it holds, $all an item for each value, $size so many items.
    """
    parts = []
    for key, want in spec.items():
        if key in ("$and", "$or"):
            parts.append(reduce(lambda a, b: a & b if key == "$and" else a | b, (condition(w, schema) for w in want)))  # noqa: B023
        elif key == "$nor":
            parts += [~F.coalesce(condition(w, schema), F.lit(False)) for w in want]
        elif key == "$not":
            parts.append(~F.coalesce(condition(want, schema), F.lit(False)))
        elif isinstance(want, dict):
            c, kind = _path(key, schema)
            for op, v in want.items():
                if op == "$not":
                    parts.append(~F.coalesce(condition({key: v}, schema), F.lit(False)))
                else:
                    parts.append(_holds(c, kind, op, v))
        else:
            parts.append(_holds(*_path(key, schema), "$eq", want))
    return _all(parts)


def project(df: DataFrame, spec: dict[str, int]) -> DataFrame:
    """Fields with 1 are all that is left; with 0 they go."""
    take = [k for k, v in spec.items() if v]
    return df.select(*take) if take else df.drop(*spec)


def sort_columns(fields: list[str]) -> list[Column]:
    """`f` ascending with nulls first, `-f` descending with nulls last."""
    return [F.col(f[1:]).desc_nulls_last() if f.startswith("-") else F.col(f).asc_nulls_first() for f in fields]


def find(df: DataFrame, where: dict | None = None, fields: dict[str, int] | None = None, sort: list[str] | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
    """Filter, sort, skip, limit, project. A limit of 0 is none."""
    out = df.where(condition(where, df.schema)) if where else df
    if sort:
        out = out.orderBy(*sort_columns(sort))
    if skip:
        out = out.offset(skip)
    if limit:
        out = out.limit(limit)
    return project(out, fields) if fields else out


def page(df: DataFrame, number: int, size: int, sort: list[str]) -> DataFrame:
    """A page with total, total_pages, has_next and has_previous beside each row. sort must be a total order."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / size).cast("long")
    rows = df.orderBy(*sort_columns(sort)).offset((number - 1) * size).limit(size)
    return rows.join(F.broadcast(total)).withColumn("total_pages", pages).withColumn("has_next", F.lit(number) < pages).withColumn("has_previous", F.lit(number > 1))


_GROUP = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.first, "$last": F.last, "$addToSet": lambda c: F.sort_array(F.collect_set(c)), "$push": lambda c: F.sort_array(F.collect_list(c))}

#: Signs of a time format, as pipelines write it and as Spark does.
TIME_SIGNS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


def _time_text(arg: dict[str, Any]) -> Column:
    pattern = arg.get("format", "%Y-%m-%dT%H:%M:%S")
    parts = re.findall(r"%[^%]|(?:%%|[^%])+", pattern)
    if bad := [p for p in parts if len(p) == 2 and p[0] == "%" and p[1] != "%" and p not in TIME_SIGNS]:
        raise ValueError(f"unknown time sign {bad[0]}")
    return F.date_format(expression(arg["date"]), "".join(TIME_SIGNS.get(p) or "'" + p.replace("%%", "%").replace("'", "''") + "'" for p in parts))


def _choice(arg: Any) -> Column:
    test, yes, no = (arg["if"], arg["then"], arg["else"]) if isinstance(arg, dict) else arg
    return F.when(expression(test), expression(yes)).otherwise(expression(no))


def _fold(f: Callable[[Column, Column], Column]) -> Callable[[Any], Column]:
    return lambda arg: reduce(f, map(expression, arg))


def _call(f: Callable[..., Column]) -> Callable[[Any], Column]:
    return lambda arg: f(*map(expression, arg if isinstance(arg, list) else [arg]))


#: Operators of computed values, by name. Arithmetic with null is null.
_VALUE: dict[str, Callable[[Any], Column]] = {
    "$add": _fold(lambda a, b: a + b), "$multiply": _fold(lambda a, b: a * b), "$subtract": _fold(lambda a, b: a - b), "$divide": _fold(lambda a, b: a / b), "$mod": _fold(lambda a, b: a % b),
    "$abs": _call(F.abs), "$ceil": _call(F.ceil), "$floor": _call(F.floor), "$sqrt": _call(F.sqrt), "$pow": _call(F.pow),
    "$round": lambda arg: F.bround(expression(arg[0]), arg[1] if len(arg) > 1 else 0) if isinstance(arg, list) else F.bround(expression(arg), 0),
    "$concat": _call(F.concat), "$toLower": _call(F.lower), "$toUpper": _call(F.upper), "$strLenCP": _call(F.length), "$toString": lambda arg: expression(arg).cast("string"),
    "$size": _call(F.size), "$ifNull": _call(F.coalesce), "$cond": _choice, "$literal": F.lit,
    "$eq": _call(lambda a, b: a.eqNullSafe(b)), "$ne": _call(lambda a, b: ~a.eqNullSafe(b)), "$gt": _call(lambda a, b: a > b), "$gte": _call(lambda a, b: a >= b), "$lt": _call(lambda a, b: a < b), "$lte": _call(lambda a, b: a <= b),
    "$and": _fold(lambda a, b: a & b), "$or": _fold(lambda a, b: a | b), "$not": _call(lambda a: ~a),
    "$year": _call(F.year), "$month": _call(F.month), "$dayOfMonth": _call(F.dayofmonth), "$hour": _call(F.hour), "$dateToString": _time_text,
}


def expression(v: Any) -> Column:
    """A computed value: `$field`, an operator with its operands, a document of values, or a literal. An unknown operator is an error."""
    if isinstance(v, str) and v.startswith("$"):
        return F.col(v[1:])
    if isinstance(v, list):
        return F.array(*map(expression, v))
    if not isinstance(v, dict):
        return F.lit(v)
    if any(k.startswith("$") for k in v):
        if len(v) > 1:
            raise ValueError(f"one operator a document: {', '.join(v)}")
        ((op, arg),) = v.items()
        if op not in _VALUE:
            raise ValueError(f"unknown operator {op}")
        return _VALUE[op](arg)
    return F.struct(*[expression(x).alias(k) for k, x in v.items()])


def _accumulator(spec: dict[str, Any]) -> Column:
    if len(spec) != 1 or next(iter(spec)) not in _GROUP:
        raise ValueError(f"unknown accumulator {', '.join(spec)}")
    ((op, v),) = spec.items()
    return _GROUP[op](expression(v))


def unwind(df: DataFrame, arg: str | dict[str, Any]) -> DataFrame:
    """A row for each item of an array. Rows without items go, unless preserveNullAndEmptyArrays; includeArrayIndex names a column for
    the item's place. What is no array counts as its only item."""
    spec = {"path": arg} if isinstance(arg, str) else arg
    if unknown := spec.keys() - {"path", "preserveNullAndEmptyArrays", "includeArrayIndex"}:
        raise ValueError(f"unknown option {', '.join(sorted(unknown))}")
    field, keep, at = spec["path"].removeprefix("$"), spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    if not isinstance(df.schema[field].dataType, T.ArrayType):
        out = df if keep else df.where(F.col(field).isNotNull())
        return out.withColumn(at, F.lit(None).cast("int")) if at else out
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (field, at)]
    out = df.select(*rest, (F.posexplode_outer if keep else F.posexplode)(field).alias("_at", field))
    order = [F.col(f"`{c}`") for c in df.columns if c != at]
    return out.select(*order, *([F.col("_at").alias(at)] if at else []))


def bucket(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Groups by ranges: _id is the lower of the boundaries around the value, or default; a value outside of them without a default is an error."""
    value, bounds = expression(spec["groupBy"]), spec["boundaries"]
    if len(bounds) < 2 or any(a >= b for a, b in zip(bounds, bounds[1:], strict=False)):
        raise ValueError("boundaries must be two or more, ascending")
    own = reduce(lambda w, ab: w.when((value >= ab[0]) & (value < ab[1]), F.lit(ab[0])), zip(bounds, bounds[1:], strict=False), F)
    outside = F.lit(spec["default"]) if "default" in spec else F.raise_error(F.concat(F.lit("no bucket for "), F.coalesce(value.cast("string"), F.lit("null"))))
    if isinstance(spec.get("default"), str) and not isinstance(bounds[0], str):
        own = own.otherwise(F.lit(None)).cast("string")  # one column has one type
        own, outside = F.coalesce(own, outside), None
    output = spec.get("output", {"count": {"$sum": 1}})
    return df.groupBy((own if outside is None else own.otherwise(outside)).alias("_id")).agg(*[_accumulator(v).alias(k) for k, v in output.items()])


def facets(df: DataFrame, spec: dict[str, list[dict[str, Any]]], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(facet, document): what each of several pipelines over the same rows gives, a row a document, as JSON; the rows are made once.

    A database gives one document with a list for each; here a facet may have any number of documents, so they stay rows.
    """
    shared = cut(df, "facets")
    return reduce(DataFrame.unionByName, [(got := pipeline(shared, stages, tables)).select(F.lit(name).alias("facet"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in got.columns])).alias("document")) for name, stages in spec.items()])


def pipeline(df: DataFrame, stages: list[dict[str, Any]], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """An aggregation pipeline: $match, $project, $addFields, $unset, $group, $bucket, $sortByCount, $facet, $sort, $skip, $limit, $unwind, $lookup,
    $replaceRoot, $count. An unknown stage is an error."""
    for stage in stages:
        ((name, arg),) = stage.items()
        if name == "$match":
            df = df.where(condition(arg, df.schema))
        elif name == "$project":
            kept = [F.col(k) if v is True or v == 1 else expression(v).alias(k) for k, v in arg.items() if v is not False and v != 0]
            df = df.select(*kept) if kept else df.drop(*arg)
        elif name in ("$addFields", "$set"):
            df = df.withColumns({k: expression(v) for k, v in arg.items()})
        elif name == "$unset":
            df = df.drop(*([arg] if isinstance(arg, str) else arg))
        elif name == "$group":
            key = arg["_id"]
            keys = [F.lit(None).alias("_id")] if key is None else [expression(key).alias("_id")]
            df = df.groupBy(*keys).agg(*[_accumulator(spec).alias(k) for k, spec in arg.items() if k != "_id"])
        elif name == "$bucket":
            df = bucket(df, arg)
        elif name == "$sortByCount":
            df = df.groupBy(expression(arg).alias("_id")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "_id")
        elif name == "$facet":
            df = facets(df, arg, tables)
        elif name == "$sort":
            df = df.orderBy(*sort_columns([k if v > 0 else f"-{k}" for k, v in arg.items()]))
        elif name == "$skip":
            df = df.offset(arg)
        elif name == "$limit":
            df = df.limit(arg)
        elif name == "$unwind":
            df = unwind(df, arg)
        elif name == "$lookup":
            df = lookup(df, (tables or {})[arg["from"]], arg["localField"], arg["foreignField"], arg["as"])
        elif name == "$replaceRoot":
            df = df.select(expression(arg["newRoot"]).alias("_root")).select("_root.*")
        elif name == "$count":
            df = df.agg(F.count(F.lit(1)).alias(arg))
        else:
            raise ValueError(f"unknown stage {name}")
    return df


def lookup(left: DataFrame, right: DataFrame, local: str, foreign: str, into: str) -> DataFrame:
    """Left join with the matches as an array, empty if there are none; null matches null. The right side is grouped first."""
    grouped = right.groupBy(F.col(foreign).alias("_foreign")).agg(F.sort_array(F.collect_list(F.struct(*right.columns))).alias(into))
    out = left.join(grouped, left[local].eqNullSafe(F.col("_foreign")), "left").drop("_foreign")
    return out.withColumn(into, F.coalesce(into, F.array().cast(grouped.schema[into].dataType)))


def json_safe(df: DataFrame) -> DataFrame:
    """Times as ISO text, in structs and arrays of structs at any depth; plain list items stay as they are."""

    def fix(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        if isinstance(t, T.StructType):
            return F.struct(*[fix(c[f.name], f.dataType).alias(f.name) for f in t])
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            return F.transform(c, lambda x: fix(x, t.elementType))
        return c

    return df.select(*[fix(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def json_at(column: str, path: str) -> Column:
    """The value at a path (`$.a.b` or `a.b`) of a JSON column, as JSON writes it; keys may have any signs but dots."""
    keys = [k for k in path.removeprefix("$").split(".") if k]
    return F.get_json_object(column, "$" + "".join("['" + k.replace("'", "\\'") + "']" for k in keys))


def json_equals(column: str, path: str, value: Any) -> Column:
    """Whether the value at a path is this one: compared as JSON text, so True is `true`; None is a path that leads nowhere."""
    got = json_at(column, path)
    return got.isNull() if value is None else got == F.lit(json.dumps(value) if isinstance(value, (bool, int, float, list, dict)) else str(value))


def json_has(column: str, path: str, value: Any) -> Column:
    """Whether the JSON array of texts at a path has the value, or the JSON document there has it as a key."""
    got = json_at(column, path) if path.strip("$.") else F.col(column)
    listed = F.array_contains(F.from_json(got, "array<string>"), F.lit(str(value)))
    return F.coalesce(listed, F.array_contains(F.json_object_keys(got), F.lit(str(value))), F.lit(False))


def with_ids(df: DataFrame, key: str, ids: str | list | DataFrame) -> DataFrame:
    """Rows of any of the ids: a list, a table's column of the same name, or a comma list (blanks and empty ones go)."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key).distinct(), key, "left_semi")
    wanted = [x.strip() for x in ids.split(",")] if isinstance(ids, str) else ids
    return df.where(F.col(key).cast("string").isin([str(x) for x in wanted if str(x)]))
