"""Columns that an operator does not know travel with the rows as one struct, so that none can clash with its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The struct's name; a known column is never called so.
REST = "_rest"


def keep_columns(docs: DataFrame, *known: str) -> tuple[DataFrame, list[str]]:
    """``docs`` as the known columns and a struct of all others, and the order of all columns."""
    others = [c for c in docs.columns if c not in known]
    # A struct needs a field; the number counts for nothing.
    rest = F.struct(*[F.col(_quoted(c)).alias(c) for c in others]) if others else F.struct(F.lit(0).alias("none"))
    return docs.select(*[F.col(c) for c in known], rest.alias(REST)), docs.columns


def put_back(df: DataFrame, names: Sequence[str], *added: str) -> DataFrame:
    """The columns ``names`` in their order, those that are not in ``df`` from the struct, then the ``added`` ones, which
    replace columns of their names."""
    own = set(df.columns) - {REST}
    fields = set(df.schema[REST].dataType.fieldNames())
    columns = [F.col(REST).getField(c).alias(c) if c in fields else F.col(c) for c in names if c not in added]
    missing = [c for c in added if c not in own]
    if missing:
        raise ValueError(f"no columns {missing}")
    return df.select(*columns, *[F.col(c) for c in added])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
