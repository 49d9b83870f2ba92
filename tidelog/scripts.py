"""Scripts as transforms: SQL expressions with named parameters, by context, inline or stored by name.

Context `update` changes the fields of each row by statements, one after another:
`field = expression`, `rename old to new`, `remove field`, parted by `;` outside of
quotes. Context `rows` is a whole query over {rows}, which may drop or multiply them.
`:name` is a parameter. Expressions must be deterministic, and what fails on a row
fails the migration: casts and arithmetic follow ANSI.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.transform import REGISTRY, Transform, checked, named
from .requests import Rejected, Request, Script

#: Text outside of quotes that ends a statement.
STATEMENT = re.compile(r"""((?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|[^;'"`])+)""")
NAME = r"`?([A-Za-z_][\w.]*)`?"


def statements(source: str) -> list[str]:
    return [x.strip() for x in STATEMENT.findall(source) if x.strip()]


def update(source: str, params: dict) -> Transform:
    steps: list[Callable[[DataFrame], DataFrame]] = []
    for line in statements(source):
        if m := re.fullmatch(rf"(?i)remove\s+{NAME}", line):
            steps.append(lambda df, a=m[1]: df.drop(a))
        elif m := re.fullmatch(rf"(?i)rename\s+{NAME}\s+to\s+{NAME}", line):
            steps.append(lambda df, a=m[1], b=m[2]: df.withColumnRenamed(a, b) if a in df.columns else df.withColumn(b, F.lit(None).cast("string")))
        elif m := re.fullmatch(rf"(?s){NAME}\s*=(?!=)\s*(.+)", line):
            steps.append(lambda df, a=m[1], e=m[2]: assigned(df, a, e, params))
        else:
            raise Rejected(f"not a statement: {line!r}")

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = step(df)
        return df

    return run


def assigned(df: DataFrame, name: str, expression: str, params: dict) -> DataFrame:
    kept = ", ".join(f"`{c}`" for c in df.columns if c != name)
    made = query(f"select {kept}, ({expression}) as `{name}` from {{rows}}", params)(df)
    return made.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*df.columns, name])))


def query(source: str, params: dict) -> Transform:
    if "{rows}" not in source:
        raise Rejected("a script of context rows reads from {rows}")
    head, *rest = source.split("{rows}")
    escaped = "{rows}".join(x.replace("{", "{{").replace("}", "}}") for x in (head, *rest))
    return lambda df: df.sparkSession.sql(escaped, args=params or None, rows=df)


#: How a script's source becomes a transform, by context. Others may be added.
CONTEXTS: dict[str, Callable[[str, dict], Transform]] = {"update": update, "rows": query}
#: Sources of stored scripts by id.
STORED: dict[str, str] = {}


def transform_of(script: Script | Transform) -> Transform:
    """A script's transform; a function is one already. Stored scripts are looked up among sources, then among registered functions."""
    if not isinstance(script, Script):
        return script
    context = (script.script_context or "").strip() or "update"
    if context not in CONTEXTS:
        raise Rejected(f"unknown script context {context!r}")
    if script.type == "inline":
        return CONTEXTS[context](script.source, script.params)
    if script.id in STORED:
        return CONTEXTS[context](STORED[script.id], script.params)
    if script.id in REGISTRY:
        return named(script.id)
    raise Rejected(f"no stored script {script.id!r}")


def applied(ops: DataFrame, request: Request, payload: tuple[str, ...]) -> DataFrame:
    """Ops after the request's transform. Deletes are transformed only if asked; else they keep their key, and carry no payload."""
    transform = transform_of(request.transform)
    if request.apply_to_deletes:
        return checked(transform(ops))
    is_delete = F.coalesce(F.col("op") == "DELETE", F.lit(False))
    writes = checked(transform(ops.where(~is_delete)))
    kept = [c for c in ops.columns if c not in payload]
    columns = ((F.col(f"`{f.name}`") if f.name in kept else F.lit(None)).cast(f.dataType).alias(f.name) for f in writes.schema.fields)
    return writes.unionByName(ops.where(is_delete).select(*columns))


def dry_run(sample: DataFrame, request: Request, payload: tuple[str, ...]) -> None:
    """Compile the transform against the schema, and run it on a row with an empty payload and, if it sees deletes, on a delete. Errors reject the request."""
    names = [c for c in sample.columns if c not in (*payload, "_id", "op")]
    empty = sample.sparkSession.range(1).select(*(F.lit(None).cast(sample.schema[c].dataType).alias(c) for c in (*names, *payload)), F.lit("sample").alias("_id"))
    ops = ["INDEX", "DELETE"] if request.apply_to_deletes else ["INDEX"]
    rows = empty.withColumn("op", F.explode(F.array(*map(F.lit, ops)))).select(*sample.columns)
    try:
        out = applied(rows, request, payload)
        if missing := [c for c in ("_id", "op", "seq_no", "source_shard", "_routing") if c not in out.columns]:
            raise Rejected(f"the transform takes away {', '.join(missing)}")
        if not out._jdf.queryExecution().analyzed().deterministic():
            raise Rejected("the transform isn't deterministic")
        out.collect()
    except Rejected:
        raise
    except Exception as e:
        raise Rejected(f"the transform fails: {str(e).splitlines()[0]}") from e
