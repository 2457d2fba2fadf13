"""One relational text, two engines: the few functions that Spark SQL and ANSI engines spell apart.

A plan written as a function of a Dialect runs on Spark through spark.sql and gives the same
plan's oracle text. Tables are written @name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class Dialect:
    """Spark's spelling; Oracle overrides what differs."""

    def sha(self, x):
        return f"sha2({x}, 256)"

    def hex_number(self, x):
        return f"CAST(conv({x}, 16, 10) AS DECIMAL(20, 0))"

    def half_even(self, x):
        return f"bround({x})"

    def size(self, x):
        return f"size({x})"

    def explode(self, x):
        return f"explode({x})"

    def series(self, a, b):
        return f"sequence({a}, {b})"

    def places(self, array):
        """1, 2, ... for the elements of an array of any length."""
        return f"transform({array}, (x, i) -> i + 1)"

    def rx(self, pattern):
        return "r'" + pattern + "'"

    def found(self, text, pattern):
        return f"regexp_extract_all({text}, {self.rx(pattern)}, 0)"

    def extract(self, text, pattern, group):
        return f"regexp_extract({text}, {self.rx(pattern)}, {group})"

    def replace(self, text, pattern, by):
        return f"regexp_replace({text}, {self.rx(pattern)}, '{by}')"

    def matches(self, text, pattern):
        return f"({text} RLIKE {self.rx(pattern)})"

    def joined(self, x, order, by):
        return f"listagg({x}, '{by}') WITHIN GROUP (ORDER BY {order})"

    def json(self, text, path):
        return f"get_json_object({text}, '{path}')"

    def array(self, *items):
        return f"array({', '.join(items)})"

    def array_distinct(self, x):
        return f"array_distinct({x})"

    def array_sort(self, x):
        return f"array_sort({x})"

    def array_join(self, x, by):
        return f"array_join({x}, '{by}')"

    def both(self, a, b):
        return f"array_intersect({a}, {b})"

    def less(self, a, b):
        return f"array_except({a}, {b})"

    def mapped(self, x, name, body):
        return f"transform({x}, {name} -> {body})"

    def kept(self, x, name, body):
        return f"filter({x}, {name} -> {body})"

    def slice(self, x, begin, length):
        return f"slice({x}, {begin}, {length})"

    def at(self, x, i):
        return f"element_at({x}, {i})"

    def chars(self, x):
        return f"char_length({x})"

    def distinct_count(self, x):
        return f"count(DISTINCT {x})"

    def collect(self, x):
        return f"collect_list({x})"

    def collect_distinct(self, x):
        return f"collect_set({x})"

    def days(self, x):
        return f"CAST(date_trunc('DAY', {x}) AS DATE)"

    def words(self, text):
        return self.found(text, r"[^\x20\x09-\x0D]+")

    def seconds(self, later, earlier):
        return f"CAST(timestampdiff(SECOND, {earlier}, {later}) AS BIGINT)"

    def levels(self, n):
        return f"MAX RECURSION LEVEL {n}"

    def value_at(self, q, x):
        return f"percentile({x}, {q})"

    def discrete(self, q, x):
        return f"CAST(percentile_disc({q}) WITHIN GROUP (ORDER BY {x}) AS BIGINT)"

    def split(self, text, by):
        return f"split({text}, {self.rx(by)})"

    def plain(self, text):
        """A string literal without escapes."""
        return self.rx(text)


class Oracle(Dialect):
    def sha(self, x):
        return f"sha256({x})"

    def hex_number(self, x):
        return f"CAST(('0x' || {x})::UBIGINT AS DECIMAL(20, 0))"

    def half_even(self, x):
        return f"round_even({x}, 0)"

    def size(self, x):
        return f"len({x})"

    def explode(self, x):
        return f"unnest({x})"

    def series(self, a, b):
        return f"generate_series({a}, {b})"

    def places(self, array):
        return f"range(1, len({array}) + 1)"

    def rx(self, pattern):
        return f"'{pattern}'"

    def found(self, text, pattern):
        return f"regexp_extract_all({text}, {self.rx(pattern)})"

    def replace(self, text, pattern, by):
        return f"regexp_replace({text}, {self.rx(pattern)}, '{by}', 'g')"

    def matches(self, text, pattern):
        return f"regexp_matches({text}, {self.rx(pattern)})"

    def joined(self, x, order, by):
        return f"string_agg({x}, '{by}' ORDER BY {order})"

    def json(self, text, path):
        return f"json_extract_string({text}, '{path}')"

    def array(self, *items):
        return f"[{', '.join(items)}]"

    def array_distinct(self, x):
        return f"list_distinct({x})"

    def array_sort(self, x):
        return f"list_sort({x})"

    def array_join(self, x, by):
        return f"array_to_string({x}, '{by}')"

    def both(self, a, b):
        return f"list_intersect({a}, {b})"

    def less(self, a, b):
        return f"list_filter(list_distinct({a}), lambda q: NOT list_contains({b}, q))"

    def mapped(self, x, name, body):
        return f"list_transform({x}, lambda {name}: {body})"

    def kept(self, x, name, body):
        return f"list_filter({x}, lambda {name}: {body})"

    def slice(self, x, begin, length):
        return f"list_slice({x}, {begin}, {begin} + {length} - 1)"

    def at(self, x, i):
        return f"list_extract({x}, {i})"

    def chars(self, x):
        return f"length({x})"

    def collect(self, x):
        return f"list({x})"

    def collect_distinct(self, x):
        return f"list(DISTINCT {x})"

    def days(self, x):
        return f"CAST({x} AS DATE)"

    def seconds(self, later, earlier):
        return f"CAST(date_diff('second', {earlier}, {later}) AS BIGINT)"

    def levels(self, n):
        return ""

    def value_at(self, q, x):
        return f"quantile_cont({x}, {q})"

    def discrete(self, q, x):
        return f"CAST(percentile_disc({q}) WITHIN GROUP (ORDER BY {x}) AS BIGINT)"

    def split(self, text, by):
        return f"regexp_split_to_array({text}, {self.rx(by)})"


SPARK, ORACLE = Dialect(), Oracle()


def on_spark(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Fractions become double literals, as they count in other engines, not decimals."""
    parts = text.split("'")
    parts[::2] = [re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1D", part) for part in parts[::2]]
    return spark.sql(re.sub(r"@(\w+)", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", "'".join(parts)))


def on_oracle(text: str) -> str:
    return re.sub(r"@(\w+)", r"\1", text)


def relational(*plans) -> dict:
    """Registry entries of plans written as functions of a Dialect, named as the functions are."""
    return {p.__name__: ((lambda spark, sf_dir, p=p: on_spark(spark, sf_dir, p(SPARK))), on_oracle(p(ORACLE))) for p in plans}
