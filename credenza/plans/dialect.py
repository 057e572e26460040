"""The few places where Spark SQL and DuckDB spell the same thing differently."""

from __future__ import annotations


class Spark:
    name = "spark"

    def raw(self, s: str) -> str:
        return "r'" + s + "'"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.raw(pattern)}, '{by}')"

    def match(self, x: str, pattern: str) -> str:
        return f"rlike({x}, {self.raw(pattern)})"

    def group(self, x: str, pattern: str, n: int) -> str:
        return f"regexp_extract({x}, {self.raw(pattern)}, {n})"

    def half_even(self, x: str, d: int = 0) -> str:
        return f"bround({x}, {d})"

    def whole(self, x: str) -> str:
        """A double as an integer, halves to even: a cast cuts in Spark and rounds in DuckDB."""
        return f"CAST(rint({x}) AS BIGINT)"

    def percentile(self, x: str, q: float) -> str:
        return f"percentile({x}, {q}e0)"

    def argmax(self, v: str, *order: str) -> str:
        return f"max_by({v}, struct({', '.join(order)}))"

    def argmin(self, v: str, *order: str) -> str:
        return f"min_by({v}, struct({', '.join(order)}))"

    def listed(self, v: str, order: str, sep: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {v} AS v))), t -> t.v), '{sep}')"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def lines(self, table: str, key: str) -> str:
        return f"(SELECT {key}, CAST(pos AS BIGINT) AS pos, line FROM {table} LATERAL VIEW posexplode(split(text, '\\n')) l AS pos, line)"

    def minutes(self, n: int) -> str:
        return f"INTERVAL {n} MINUTES"

    def sum_product(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0e0, (s, x) -> s + x)"

    def to_date(self, x: str) -> str:
        return f"try_to_date({x}, 'yyyy-MM-dd')"

    def size(self, x: str) -> str:
        return f"CAST(size({x}) AS BIGINT)"

    def words(self, x: str) -> str:
        return f"filter(split({x}, r'[^A-Za-z]+'), t -> t <> '')"

    def distinct(self, x: str) -> str:
        return f"array_sort(array_distinct({x}))"

    def common(self, a: str, b: str) -> str:
        return f"size(array_intersect({a}, {b}))"


class Duck(Spark):
    name = "duckdb"

    def raw(self, s: str) -> str:
        return "'" + s + "'"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def match(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def half_even(self, x: str, d: int = 0) -> str:
        return f"round_even({x}, {d})"

    def whole(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def percentile(self, x: str, q: float) -> str:
        return f"quantile_cont({x}, {q})"

    def argmax(self, v: str, *order: str) -> str:
        return f"arg_max({v}, row({', '.join(order)}))"

    def argmin(self, v: str, *order: str) -> str:
        return f"arg_min({v}, row({', '.join(order)}))"

    def listed(self, v: str, order: str, sep: str) -> str:
        return f"string_agg({v}, '{sep}' ORDER BY {order}, {v})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def lines(self, table: str, key: str) -> str:
        return f"(SELECT {key}, i - 1 AS pos, parts[i] AS line FROM (SELECT {key}, string_split(text, chr(10)) AS parts FROM {table}) s, unnest(range(1, len(parts) + 1)) u(i))"

    def minutes(self, n: int) -> str:
        return f"INTERVAL {n} MINUTE"

    def sum_product(self, a: str, b: str) -> str:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"

    def to_date(self, x: str) -> str:
        return f"TRY_CAST({x} AS DATE)"

    def size(self, x: str) -> str:
        return f"CAST(len({x}) AS BIGINT)"

    def words(self, x: str) -> str:
        return f"list_filter(regexp_split_to_array({x}, '[^A-Za-z]+'), lambda t: t <> '')"

    def distinct(self, x: str) -> str:
        return f"list_sort(list_distinct({x}))"

    def common(self, a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))"


SPARK, DUCK = Spark(), Duck()
