"""Reading loosely typed JSON records held in a VARIANT column.

Feeds and model replies come without a contract, so every access must tell a
missing key from a JSON null and know what counts as "empty" (null, false, 0,
"", [] and {}). :func:`with_fields` reads each key once into a text and a type
column; all further logic works on those two.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.text import text_or_empty


def first_object(reply: Column) -> Column:
    """The outermost ``{...}`` of a chatty reply as VARIANT; NULL if none or invalid."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text_or_empty(reply), r"(?s)\{.*\}", 0), F.lit("")))


def array(v: Column, key: str, element: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{key}", f"array<{element}>")


@dataclass(frozen=True)
class Field:
    """One key of a record: its text (NULL if missing or null) and its JSON type
    (NULL if missing; VOID, BOOLEAN, BIGINT, DECIMAL(..), DOUBLE, STRING, ARRAY<..>, OBJECT<..>)."""

    text: Column
    kind: Column

    @property
    def missing(self) -> Column:
        return self.kind.isNull()

    def truthy(self, missing: bool = False) -> Column:
        """Is the value present and not empty?"""
        k, t = self.kind, self.text
        return (
            F.when(k == "STRING", t != "")
            .when(k.isNull(), F.lit(missing))
            .when(k == "VOID", F.lit(False))
            .when(k == "BOOLEAN", t == "true")
            .when(k.startswith("ARRAY"), t != "[]")
            .when(k.startswith("OBJECT"), t != "{}")
            .otherwise(t.try_cast("double") != 0)
        )

    def get(self, missing: str = "") -> Column:
        """Text with a default for a missing key only; JSON null stays NULL."""
        return F.when(self.missing, F.lit(missing)).otherwise(self.text)

    def if_truthy(self) -> Column:
        return F.when(self.truthy(), self.text)

    def shown(self, missing: str = "") -> Column:
        """Text as it reads inside a formatted string: null -> None, booleans capitalised."""
        return (
            F.when(self.kind.isNull(), F.lit(missing))
            .when(self.kind == "VOID", F.lit("None"))
            .when(self.kind == "BOOLEAN", F.initcap(self.text))
            .otherwise(self.text)
        )

    def shown_if_truthy(self) -> Column:
        return F.when(self.truthy(), self.shown()).otherwise(F.lit(""))


def with_fields(df: DataFrame, v: str, keys: Sequence[str]) -> tuple[DataFrame, dict[str, Field]]:
    """``df`` with two helper columns per key, and the fields to build expressions from."""
    columns, fields = [], {}
    for i, key in enumerate(keys):
        text, kind = f"_{v}_text{i}", f"_{v}_kind{i}"
        columns.append(F.try_variant_get(v, f"$.{key}", "string").alias(text))
        columns.append(F.schema_of_variant(F.variant_get(v, f"$.{key}", "variant")).alias(kind))
        fields[key] = Field(F.col(text), F.col(kind))
    return df.select("*", *columns), fields
