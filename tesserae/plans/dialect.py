"""The few spellings in which Spark SQL and DuckDB differ, for relational plans that both can run."""


class Spark:
    @staticmethod
    def div(a, b):
        return f"(({a}) div ({b}))"

    @staticmethod
    def shr(a, n):
        return f"shiftright({a}, {n})"

    @staticmethod
    def seq(low, high):
        """A table of i from low to high - 1."""
        return f"(SELECT id AS i FROM range({low}, {high}))"

    @staticmethod
    def bits(a):
        """The number of bits of a non-negative integer, 0 for 0."""
        return f"(CASE WHEN ({a}) = 0 THEN 0 ELSE length(bin({a})) END)"

    explode = staticmethod(lambda low, high, name: f"LATERAL VIEW explode(sequence({low}, {high})) e AS {name}")
    text = "STRING"


class Duck(Spark):
    @staticmethod
    def div(a, b):
        return f"(({a}) // ({b}))"

    @staticmethod
    def shr(a, n):
        return f"(({a}) >> {n})"

    @staticmethod
    def seq(low, high):
        return f"(SELECT range AS i FROM range({low}, {high}))"

    text = "VARCHAR"


def values(rows, columns: str) -> str:
    """An inline table."""
    cell = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({columns}))"


def matrix(m) -> str:
    """m[u][x] as a table of u, x, m."""
    return values([(u, x, v) for u, row in enumerate(m) for x, v in enumerate(row)], "u, x, m")
