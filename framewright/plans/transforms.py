"""Transform chains over nested records: functions from DataFrame to DataFrame that only build projections."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Group:
    """Inputs run in order; outputs run mirrored, so that the last added undoes first."""

    inputs: tuple[Transform, ...] = ()
    outputs: tuple[Transform, ...] = ()

    def push(self, inputs=(), outputs=()) -> Group:
        return Group((*self.inputs, *inputs), (*outputs, *self.outputs))


def compose(*transforms: Transform) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        for t in transforms:
            df = df.transform(t)
        return df

    return run


def _leaf(path: str) -> Column:
    parts = path.split("/")
    out = F.col(f"`{parts[0]}`")
    for p in parts[1:]:
        out = out.getField(p)
    return out


def leaves(schema: T.StructType, prefix: str = "") -> list[str]:
    out = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        out += leaves(field.dataType, f"{path}/") if isinstance(field.dataType, T.StructType) else [path]
    return out


def repack(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Columns by source path; a path that doesn't exist is an error."""
    known = set(leaves(df.schema)) | set(df.columns)
    if missing := [p for p in wanted.values() if p not in known]:
        raise KeyError(f"no such paths: {missing}")
    return df.select(*[_leaf(path).alias(name) for name, path in wanted.items()])


def flatten(df: DataFrame) -> DataFrame:
    return df.select(*[_leaf(p).alias(p) for p in leaves(df.schema)])


def unflatten(df: DataFrame) -> DataFrame:
    """Columns named a/b/c become nested structs."""

    def build(items: list[tuple[list[str], str]]) -> list[Column]:
        groups: dict[str, list] = {}
        for parts, name in items:
            groups.setdefault(parts[0], []).append((parts[1:], name))
        out = []
        for head, inner in groups.items():
            if any(not rest for rest, _ in inner):
                if len(inner) > 1:
                    raise ValueError(f"{head} is both a leaf and a node")
                out.append(F.col(f"`{inner[0][1]}`").alias(head))
            else:
                out.append(F.struct(*build(inner)).alias(head))
        return out

    return df.select(*build([(c.split("/"), c) for c in df.columns]))


def rename(df: DataFrame, patterns: dict[str, str | None]) -> DataFrame:
    """New names by the first pattern that matches a whole flattened name; None drops. Names that meet are an error."""
    names: dict[str, str] = {}
    for path in leaves(df.schema):
        new: str | None = path
        for pattern, target in patterns.items():
            if m := re.fullmatch(pattern, path):
                new = None if target is None else m.expand(target)
                break
        if new is None:
            continue
        if new in names:
            raise ValueError(f"{path} and {names[new]} both become {new}")
        names[new] = path
    if clash := [n for n in names if any(o.startswith(f"{n}/") for o in names)]:
        raise ValueError(f"leaves that are nodes too: {clash}")
    return unflatten(df.select(*[_leaf(path).alias(new) for new, path in names.items()]))


def apply_columns(df: DataFrame, selected: list[str], fn: Callable[[Column], Column], strict: bool = True) -> DataFrame:
    if strict and (missing := [c for c in selected if c not in df.columns]):
        raise KeyError(f"no such columns: {missing}")
    return df.withColumns({c: fn(F.col(c)) for c in selected if c in df.columns})


def default_prompt(df: DataFrame, prompt: str) -> DataFrame:
    return df.withColumn("prompt", F.coalesce("prompt", F.lit(prompt)) if "prompt" in df.columns else F.lit(prompt))


def drop_strings(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if not isinstance(f.dataType, T.StringType)])


def without(wanted: dict[str, str], *leaves_: str) -> dict[str, str]:
    """A repacking's names and paths without some leaves, such as the actions."""
    return {name: path for name, path in wanted.items() if name not in leaves_}


def features_by_kind(features: Column, kind: str) -> tuple[Column, Column]:
    """Names, sorted, of the features (a JSON object by name) whose dtype is ``kind``, and of all others."""
    by_name = F.from_json(features, "map<string, struct<dtype: string>>")
    is_kind, is_not = F.map_filter(by_name, lambda _, v: v["dtype"] == kind), F.map_filter(by_name, lambda _, v: ~v["dtype"].eqNullSafe(F.lit(kind)))
    return F.array_sort(F.map_keys(is_kind)), F.array_sort(F.map_keys(is_not))
