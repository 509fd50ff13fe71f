"""Reading nutrient amounts out of the ``nutriments`` column.

Entries are named ``<name>_100g`` and ``<name>``. The per-100 g entry counts;
a null, empty or zero one gives way to the plain entry, any other text does not.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.scalars import finite, number_in

PER_100G = "_100g"


def _number(entry: Column, layout: T.DataType) -> Column:
    """An entry as a double: zero where it says nothing, null where it is no number.

    A variant tells texts from numbers: the text "0" says something, namely nothing of the
    nutrient, so it does not give way to the plain entry. As null it counts as zero, too.
    """
    if isinstance(layout, T.StringType):
        return F.when(entry.isNull() | (entry == ""), 0.0).otherwise(number_in(entry))
    if isinstance(layout, T.VariantType):
        kind = F.schema_of_variant(entry)
        text = F.try_variant_get(entry, "$", "string")
        number = F.try_variant_get(entry, "$", "double")
        truth = F.try_variant_get(entry, "$", "boolean").cast("double")
        return (
            F.when(entry.isNull() | (kind == "VOID"), 0.0)
            .when(kind == "STRING", F.when(text == "", 0.0).otherwise(F.nullif(number_in(text), F.lit(0.0))))
            .when(kind == "BOOLEAN", truth)
            .otherwise(number)
        )
    return F.coalesce(entry.cast("double"), F.lit(0.0))


def _chosen(per_100g: Column, plain: Column) -> Column:
    return F.when(per_100g == 0, plain).otherwise(per_100g)


def _amount(number: Column) -> Column:
    return F.coalesce(finite(number), F.lit(0.0))


@dataclass(frozen=True)
class MapNutriments:
    """Nutriments as a map, with an open set of names.

    All names are read in array expressions: a lookup, parse and choice for each
    name of its own would make generated methods too large for the JVM to compile.
    A key with a null value counts as stated.
    """

    column: Column
    layout: T.MapType
    names: list[str]

    def _keys(self, suffix: str) -> Column:
        return F.array(*[F.lit(name + suffix) for name in self.names])

    def _entries(self, suffix: str) -> Column:
        return F.transform(self._keys(suffix), lambda k: F.try_element_at(self.column, k))

    def _number(self, entry: Column) -> Column:
        return _number(entry, self.layout.valueType)

    def steps(self) -> list[dict[str, Column]]:
        """Columns to add, step by step, before the others can be read.

        A plain entry is parsed only where it is needed.
        """
        stated = F.map_keys(self.column)
        chosen = F.zip_with(
            "_per_100g", self._entries(""), lambda n, entry: _chosen(n, self._number(entry))
        )
        return [
            {"_per_100g": F.transform(self._entries(PER_100G), self._number)},
            {
                "_amounts": F.transform(chosen, _amount),
                "_stated": F.zip_with(
                    self._keys(PER_100G),
                    self._keys(""),
                    lambda a, b: F.array_contains(stated, a) | F.array_contains(stated, b),
                ),
            },
        ]

    def _at(self, values: str, name: str) -> Column:
        return F.get(values, F.lit(self.names.index(name)))

    def amount(self, name: str) -> Column:
        return F.coalesce(self._at("_amounts", name), F.lit(0.0))

    def per_100g(self, name: str) -> Column:
        """The per-100 g entry alone; zero or null where it says nothing."""
        return finite(self._at("_per_100g", name))

    def has(self, name: str) -> Column:
        """Whether either entry is stated."""
        return F.coalesce(self._at("_stated", name), F.lit(False))


@dataclass(frozen=True)
class StructNutriments:
    """Nutriments as a struct; of columnar files only the fields used are read.

    A null field counts as not stated.
    """

    column: Column
    layout: T.StructType
    names: list[str]

    def _exists(self, key: str) -> bool:
        return key in self.layout.fieldNames()

    def _read(self, key: str) -> Column:
        if not self._exists(key):
            return F.lit(0.0)
        return _number(self.column.getField(key), self.layout[key].dataType)

    def steps(self) -> list[dict[str, Column]]:
        keys = [name + suffix for name in self.names for suffix in (PER_100G, "")]
        return [{f"_number_{key}": self._read(key) for key in keys}]

    def amount(self, name: str) -> Column:
        return _amount(
            _chosen(F.col(f"`_number_{name}{PER_100G}`"), F.col(f"`_number_{name}`"))
        )

    def per_100g(self, name: str) -> Column:
        """The per-100 g entry alone; zero or null where it says nothing."""
        return finite(F.col(f"`_number_{name}{PER_100G}`"))

    def has(self, name: str) -> Column:
        """Whether either entry is stated."""
        stated = [
            self.column.getField(key).isNotNull()
            for key in (name + PER_100G, name)
            if self._exists(key)
        ]
        return reduce(Column.__or__, stated, F.lit(False))


def nutriments_of(
    layout: T.DataType, column: Column, names: list[str]
) -> MapNutriments | StructNutriments:
    if isinstance(layout, T.MapType):
        return MapNutriments(column, layout, names)
    if isinstance(layout, T.StructType):
        return StructNutriments(column, layout, names)
    raise TypeError(f"nutriments must be a map or a struct, not {layout.simpleString()}")
