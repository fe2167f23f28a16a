"""Writers: cards, notes, reports and tables as text or Parquet, built as columns and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slug(text: Column, most: int = 50) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.substring(t, 1, most)


def vcard_text(name: Column, emails: Column, phones: Column, organization: Column, role: Column) -> Column:
    """One card; emails and phones are arrays of texts, empty fields have no line."""
    line = lambda key, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(key), value))
    lines = F.concat(
        F.array(F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), line("FN:", name)),
        F.transform(F.coalesce(emails, F.array().cast("array<string>")), lambda e: F.concat(F.lit("EMAIL:"), e)),
        F.transform(F.coalesce(phones, F.array().cast("array<string>")), lambda p: F.concat(F.lit("TEL:"), p)),
        F.array(line("ORG:", organization), line("TITLE:", role), F.lit("END:VCARD")),
    )
    return F.array_join(lines, "\n")


def note_text(fields: dict[str, Column], title: Column, body: Column) -> Column:
    """A Markdown note with front matter; null fields are left out."""
    head = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *head, F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit(""), body)


def file_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """df with file_name: the name without forbidden signs; the second and later of a name get ` (n)`."""
    safe = F.regexp_replace(F.col(name), r'[<>:"/\\|?*]', "")
    n = F.row_number().over(Window.partitionBy(F.lower(safe)).orderBy(order)) - 1
    return df.withColumn("file_name", F.when(n > 0, F.concat(safe, F.lit(" ("), n.cast("string"), F.lit(").md"))).otherwise(F.concat(safe, F.lit(".md"))))


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_delimited(df: DataFrame, path: str, separator: str = "|") -> None:
    df.write.mode("overwrite").option("sep", separator).option("header", True).csv(path)


def write_index(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def with_section(text: Column, title: str, body: Column) -> Column:
    """The note with its section `## title` replaced by body, or with such a section at its end."""
    section = F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n"))
    at = F.instr(F.concat(F.lit("\n"), text), f"\n## {title}\n")
    before = F.when(at > 1, F.left(text, at - 1)).otherwise(F.lit(""))
    after = F.substring(text, at + len(title) + 4, F.length(text))
    following = F.instr(F.concat(F.lit("\n"), after), "\n## ")
    rest = F.when(following > 0, F.substring(after, following, F.length(after))).otherwise(F.lit(""))
    return F.when(at == 0, F.concat(F.regexp_replace(text, r"\n*$", ""), F.lit("\n\n"), section)).otherwise(F.concat(before, section, F.when(rest != "", F.concat(F.lit("\n"), rest)).otherwise(F.lit(""))))


def with_fields(text: Column, fields: dict[str, Column]) -> Column:
    """The note with these fields of its front matter set; a note without any gets one. Null values leave a field as it is."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in fields.items()]
    new = F.array_compact(F.array(*lines))
    named = F.transform(new, lambda x: F.substring_index(x, ":", 1))
    has = F.startswith(text, F.lit("---\n"))
    end = F.locate("\n---", text, 4)
    kept = F.filter(F.split(F.substring(text, F.lit(5), F.greatest(end - 5, F.lit(0))), "\n"), lambda x: (x != "") & ~F.array_contains(named, F.substring_index(x, ":", 1)))
    head = F.array_join(F.concat(F.when(has & (end > 0), kept).otherwise(F.array().cast("array<string>")), new), "\n")
    body = F.when(has & (end > 0), F.substring(text, end + 1, F.length(text))).otherwise(F.concat(F.lit("---\n"), text))
    return F.concat(F.lit("---\n"), head, F.lit("\n"), body)


def pipe_rows(df: DataFrame) -> DataFrame:
    """The rows of a Markdown pipe table, as the one column value: what a report shows of a table; nulls are empty cells."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\n]", " ") for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """A report: for each section a folder with its rows as JSON, and one as a pipe table with its header."""
    for title, df in sections.items():
        name = title.lower().replace(" ", "-")
        df.write.mode("overwrite").json(f"{path}/{name}/rows")
        head = df.sparkSession.createDataFrame([(f"## {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}",)], "value string")
        head.coalesce(1).write.mode("overwrite").text(f"{path}/{name}/table")
        pipe_rows(df).write.mode("append").text(f"{path}/{name}/table")


def write_photos(cards: DataFrame, path: str) -> None:
    """(name, photo) of the cards that carry a picture, as binary columns of a Parquet table."""
    cards.where("photo IS NOT NULL").select("name", "photo").write.mode("overwrite").parquet(path)


def merge_snapshot(old: DataFrame, new: DataFrame, key: str, added: list[str], first: list[str], last: list[str], sticky: list[str], latest: dict[str, str] | None = None, united: dict[str, int] | None = None) -> DataFrame:
    """An upsert of counters as one aggregation: added sums, first minima, last maxima, sticky or-ed booleans by key.

    latest: text columns that take the last non-empty value by the column named; united: array columns whose members are
    put together, old ones first, each once, up to a number. Both tables have one row per key.
    """
    extra = [*(latest or {}), *dict.fromkeys((latest or {}).values()), *(united or {})]
    columns = list(dict.fromkeys([key, *added, *first, *last, *sticky, *extra]))
    both = old.select(*columns, F.lit(0).alias("_turn")).unionByName(new.select(*columns, F.lit(1).alias("_turn")))
    none = F.array().cast("array<string>")
    kept = [F.max_by(c, F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.struct(by, "_turn"))).alias(c) for c, by in (latest or {}).items()]
    kept += [F.slice(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_turn", F.coalesce(c, none).alias("v")))), lambda x: x.v))), 1, most).alias(c) for c, most in (united or {}).items()]
    aggs = kept +  [F.sum(c).alias(c) for c in added] + [F.min(c).alias(c) for c in first] + [F.max(c).alias(c) for c in last] + [F.bool_or(c).alias(c) for c in sticky]
    return both.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
