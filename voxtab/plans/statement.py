"""Operators as SQL statements over named tables.

An operator is a function from a dialect to one SELECT statement whose FROM and JOIN name other tables: tables of the
given data, views of them (``voxtab.sources.views``) or other operators. Called with DataFrames it gives a
DataFrame; the tables that it is not given are built from the operators of those names. Catalyst sees one declarative plan.
The same statement in DuckDB's dialect checks the result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from inspect import signature

from pyspark.sql import DataFrame, SparkSession


class Dialect:
    """The functions that the two engines name or write differently."""

    def __init__(self, name: str, given: tuple[str, ...] = ()) -> None:
        self.name, self.spark, self.given = name, name == "spark", given

    def percentile(self, value: str, p: float) -> str:
        return f"percentile({value}, {p})" if self.spark else f"quantile_cont({value}, {p})"

    def swap(self, text: str, pattern: str, to: str) -> str:
        """Replace every match; patterns are written without backslashes."""
        return f"regexp_replace({text}, '{pattern}', '{to}')" if self.spark else f"regexp_replace({text}, '{pattern}', '{to}', 'g')"

    def swap_around(self, text: str, pattern: str, before: int, after: int) -> str:
        """Replace every match by a blank, but for two of its groups."""
        return f"regexp_replace({text}, '{pattern}', '${before} ${after}')" if self.spark else f"regexp_replace({text}, '{pattern}', '\\{before} \\{after}', 'g')"

    def matches(self, text: str, pattern: str) -> str:
        return f"({text} rlike '{pattern}')" if self.spark else f"regexp_matches({text}, '{pattern}')"

    def even(self, value: str, digits: int = 0) -> str:
        """Half-even rounding."""
        return f"bround({value}, {digits})" if self.spark else f"round_even({value}, {digits})"

    def each(self, array: str, var: str, body: str) -> str:
        return f"transform({array}, {var} -> {body})" if self.spark else f"list_transform({array}, lambda {var}: {body})"

    def keep(self, array: str, var: str, body: str) -> str:
        return f"filter({array}, {var} -> {body})" if self.spark else f"list_filter({array}, lambda {var}: {body})"

    def rows(self, array: str) -> str:
        """One row for each element, in a SELECT list."""
        return f"explode({array})" if self.spark else f"unnest({array})"

    def span(self, lo: str, hi: str) -> str:
        """Array of the integers lo..hi; lo <= hi."""
        return f"sequence({lo}, {hi})" if self.spark else f"generate_series({lo}, {hi})"

    def cut(self, text: str, mark: str) -> str:
        """Array of the parts of a text between one-character marks."""
        return f"split({text}, '[{mark}]')" if self.spark else f"string_split({text}, '{mark}')"

    def names(self, value: str, most: int = 3) -> str:
        """The first different values of a group in order, as one text."""
        if self.spark:
            return f"array_join(slice(array_sort(collect_set({value})), 1, {most}), ', ')"
        return f"array_to_string(list_sort(list_distinct(coalesce(list({value}) FILTER (WHERE {value} IS NOT NULL), [])))[1:{most}], ', ')"

    def parts(self, text: str) -> str:
        """Array of the parts of a value of several, which backslashes separate."""
        return f"split({text}, '[\\\\\\\\]', -1)" if self.spark else f"string_split({text}, chr(92))"

    def joined(self, value: str, mark: str, order: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order} as o, {value} as v))), x -> x.v), '{mark}')" if self.spark else f"string_agg({value}, '{mark}' ORDER BY {order})"

    def array(self, *items: str) -> str:
        if not items:
            return "array()" if self.spark else "cast([] AS varchar[])"
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def format(self, form: str, value: str) -> str:
        return f"format_string('{form}', {value})" if self.spark else f"printf('{form}', {value})"

    def fixed(self, value: str, digits: int = 1) -> str:
        """Text of a number with fixed places after half-even rounding; a negative one that rounds to zero keeps its sign, null stays null."""
        text = self.format(f"%.{digits}f", self.even(value, digits))
        if not self.spark:
            return text
        return f"CASE WHEN {value} < 0 AND {self.even(value, digits)} = 0 THEN '-' || {text} WHEN {value} IS NOT NULL THEN {text} END"

    def sha256(self, text: str) -> str:
        return f"sha2({text}, 256)" if self.spark else f"sha256({text})"

    def moment(self, text: str, form: str, strp: str) -> str:
        return f"try_to_timestamp({text}, '{form}')" if self.spark else f"try_strptime({text}, '{strp}')"

    def seconds(self, moment: str) -> str:
        return f"unix_seconds(cast({moment} as timestamp))" if self.spark else f"cast(floor(epoch({moment})) as bigint)"

    def json(self, text: str, path: str) -> str:
        return f"get_json_object({text}, '{path}')" if self.spark else f"json_extract_string({text}, '{path}')"

    def tree(self, text: str) -> str:
        """A JSON text as a value that ``branch`` and ``is_object`` read; null if it is none."""
        return f"try_parse_json({text})" if self.spark else f"CASE WHEN json_valid({text}) THEN json({text}) END"

    def is_object(self, tree: str) -> str:
        return f"(schema_of_variant({tree}) LIKE 'OBJECT%')" if self.spark else f"(json_type({tree}) = 'OBJECT')"

    def branch(self, tree: str, *keys: str) -> str:
        """Text at a path of names."""
        if self.spark:
            return f"try_variant_get({tree}, '$" + "".join(f'["{k}"]' for k in keys) + "', 'string')"
        return f"json_extract_string({tree}, '$" + "".join(f'."{k}"' for k in keys) + "')"

    def texts(self, tree: str, *keys: str) -> str:
        """Array of the texts of a list at a path: names by their first form that is there, empty ones and nulls left out; empty if there is no list."""
        name = " ".join(f"nullif({self.branch('x', k)}, '')," for k in ("Alphabetic", "Ideographic")) + f" {self.branch('x', 'Phonetic')}"
        if self.spark:
            items, own = f"""try_variant_get({tree}, '$""" + "".join(f'["{k}"]' for k in keys) + "', 'array<variant>')", "try_variant_get(x, '$', 'string')"
        else:
            items, own = f"json_extract({tree}, '$" + "".join(f'."{k}"' for k in keys) + "[*]')", "CASE WHEN json_type(x) <> 'NULL' THEN json_extract_string(x, '$') END"
        text = f"CASE WHEN {self.is_object('x')} THEN coalesce({name}) ELSE {own} END"
        return self.keep(f"coalesce({self.each(items, 'x', text)}, {self.array()})", "t", "t <> ''")

    def size(self, array: str) -> str:
        return f"size({array})" if self.spark else f"len({array})"

    def at(self, array: str, place: str | int) -> str:
        """Element at a 0-based place, null outside."""
        return f"get({array}, cast({place} AS int))" if self.spark else f"{array}[cast({place} AS int) + 1]"

    def total(self, array: str) -> str:
        """Sum of an array of doubles."""
        return f"aggregate({array}, cast(0 AS double), (a, x) -> a + x)" if self.spark else f"coalesce(list_sum({array}), 0)"

    def least_of(self, array: str) -> str:
        return f"array_min({array})" if self.spark else f"list_min({array})"

    def most_of(self, array: str) -> str:
        return f"array_max({array})" if self.spark else f"list_max({array})"

    def struct(self, **fields: str) -> str:
        if self.spark:
            return f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in fields.items())})"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def first_by(self, value: str, key: str) -> str:
        """Value of the row with the smallest key."""
        return f"min_by({value}, {key})" if self.spark else f"first({value} ORDER BY {key})"

    def pixels(self, inner: str) -> str:
        """Rows of a statement that has an array ``pixels``, once for each pixel, with its place p and its value."""
        if self.spark:
            return f"SELECT q.*, e.p, e.value FROM ({inner}) q LATERAL VIEW posexplode(pixels) e AS p, value"
        return f"SELECT *, pixels[p + 1] AS value FROM (SELECT *, unnest(range(0, len(pixels))) AS p FROM ({inner}) q) u"

    def mod(self, a: str, b: str) -> str:
        return f"pmod({a}, {b})" if self.spark else f"((({a}) % ({b})) + ({b})) % ({b})"

    @property
    def text(self) -> str:
        return "string" if self.spark else "varchar"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")
REGISTRY: dict[str, Operator] = {}
NAMED = re.compile(r"\b(FROM|JOIN) (\w+)")
#: Keywords are upper case in all statements, so a lower-case word after a table is its alias.
ALIASED = re.compile(r"\b(FROM|JOIN) (\w+)( [a-z]\w*)?")


def quote(value: str | float | bool | None) -> str:
    """A parameter as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"cast({value!r} AS double)"
    if isinstance(value, int):
        return str(value)
    parts = ["'" + p.replace("'", "''") + "'" for p in str(value).split("\\")]  # the engines read a backslash in a literal differently
    return parts[0] if len(parts) == 1 else f"({' || chr(92) || '.join(parts)})"


class Operator:
    """A named statement; see the module's docstring. What its builder takes beside the dialect are its parameters."""

    def __init__(self, build: Callable[..., str], view: bool) -> None:
        self.name, self.builder, self.view, self.__doc__ = build.__name__, build, view, build.__doc__
        self.params = tuple(signature(build).parameters)[1:]
        REGISTRY[self.name] = self

    def build(self, dialect: Dialect, params: dict | None = None) -> str:
        return self.builder(dialect, **{k: v for k, v in (params or {}).items() if k in self.params})

    def needs(self, dialect: Dialect, params: dict | None = None) -> list[str]:
        return list(dict.fromkeys(n for _, n in NAMED.findall(self.build(dialect, params)) if n in REGISTRY or n in BASE))

    def __call__(self, **given: DataFrame | str | float | bool | tuple | None) -> DataFrame:
        """The operator over given tables; other arguments are parameters of it or of an operator that it needs."""
        frames = {k: v for k, v in given.items() if isinstance(v, DataFrame)}
        params = {k: v for k, v in given.items() if k not in frames}
        spark = next(iter(frames.values())).sparkSession
        return spark.sql(*statement(self, SPARK, tuple(frames), params), **frames)


def statement(op: Operator, dialect: Dialect, given: tuple[str, ...] = BASE, params: dict | None = None) -> tuple[str]:
    """The operator and all that it needs, down to the given tables, as one statement."""
    order: list[str] = []
    dialect = Dialect(dialect.name, given)

    def visit(name: str) -> None:
        if name in given or name in order:
            return
        if name not in REGISTRY:
            raise KeyError(f"{op.name} needs a table {name}")
        for n in REGISTRY[name].needs(dialect, params):
            visit(n)
        order.append(name)

    for n in op.needs(dialect, params):
        visit(n)
    unknown = set(params or {}).difference(op.params, *(REGISTRY[n].params for n in order))
    if unknown:
        raise TypeError(f"{op.name} has no parameter {', '.join(sorted(unknown))}")

    def body(name: str) -> str:
        sql = REGISTRY[name].build(dialect, params).strip()
        if not dialect.spark:
            return sql
        return ALIASED.sub(lambda m: f"{m[1]} {{{m[2]}}}{m[3] or f' AS {m[2]}'}" if m[2] in given else m[0], sql)

    ctes = ",\n".join(f"{n} AS ({body(n)})" for n in order)
    return ((f"WITH {ctes}\n" if ctes else "") + f"SELECT * FROM (\n{body(op.name)}\n) result",)


def operator(build: Callable[..., str]) -> Operator:
    return Operator(build, view=False)


def view(build: Callable[..., str]) -> Operator:
    """A view of the given tables as a table of the domain; not a query of its own."""
    return Operator(build, view=True)


def over_tables(op: Operator) -> Callable[[SparkSession, str], DataFrame]:
    """The operator as a registered query over a folder of tables."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = statement(op, SPARK)[0]
        used = [n for n in BASE if f"{{{n}}}" in sql]
        return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in used})

    return query
