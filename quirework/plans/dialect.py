"""Pieces of Spark SQL that the derived input tables share."""

from __future__ import annotations


class Spark:
    """Spark SQL."""

    def div(self, a: str, b: int | str) -> str:
        return f"(({a}) div ({b}))"

    def each(self, low: str, high: str, name: str) -> str:
        """A lateral row for each integer from low to high."""
        return f"cross join lateral (select explode(sequence({low}, {high})) as {name})"

    def items(self, array: str, name: str, pos: str) -> str:
        """A lateral row for each element of an array, with its position from 0."""
        return f"cross join lateral (select posexplode({array}) as ({pos}, {name}))"

    def pick(self, values: list[str], index: str) -> str:
        return f"element_at(array({', '.join(quoted(v) for v in values)}), cast({index} as int) + 1)"

    def split(self, text: str, by: str) -> str:
        return f"split({text}, '{by}')"

    def prop(self, name: str) -> str:
        return f"cast(get_json_object(props, '$.{name}') as bigint)"

    def ts(self, col: str) -> str:
        return f"cast({col} as timestamp)"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SPARK = Spark()
