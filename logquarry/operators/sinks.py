"""Sinks: filtered text, CSV and a Markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions.fields import field
from logquarry.functions.secrets import displayed, mask_secrets
from logquarry.functions.text import quote_csv
from logquarry.functions.times import format_gap, format_time
from logquarry.operators.aggregates import bookmark_rows


def write_text(df: DataFrame, path: str, mask: bool = False) -> None:
    """The lines' text in order, as text files."""
    text = displayed(F.col("text"), F.col("secret_block")) if mask else F.col("text")
    df.repartitionByRange("file_idx", "number").sortWithinPartitions("file_idx", "number").select(text.alias("value")).write.text(path)


def csv_rows(df: DataFrame, columns: list[str], mask: bool = False) -> DataFrame:
    """(file_id, number, row): the entries' cells as RFC 4180 rows without line ends."""
    cells = []
    for c in columns:
        cell = F.coalesce(field(c), F.lit(""))
        cells.append(quote_csv(mask_secrets(cell) if mask else cell))
    return df.where("NOT continuation").select("file_id", "number", F.concat_ws(",", *cells).alias("row"))


def csv_header(columns: list[str]) -> str:
    def quoted(c: str) -> str:
        return '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c

    return ",".join(map(quoted, columns))


def write_csv(df: DataFrame, columns: list[str], path: str, mask: bool = False) -> None:
    """Rows end in CR LF; the header that csv_header gives is the first row of the first file."""
    rows = csv_rows(df, columns, mask).repartitionByRange("file_id", "number").sortWithinPartitions("file_id", "number")
    spark = df.sparkSession
    head = spark.createDataFrame([(csv_header(columns),)], "row string").coalesce(1)
    head.union(rows.select("row")).write.option("lineSep", "\r\n").text(path)


def bookmark_report(df: DataFrame, bookmarks: DataFrame, title: str, url: str = "", zone: str | None = None) -> str:
    """A Markdown summary of bookmarked lines, of which there are as many as someone set by hand."""
    rows = bookmark_rows(df, bookmarks).select(
        "number",
        "note",
        mask_secrets(F.col("text")).alias("text"),
        format_time(F.col("time"), zone).alias("at"),
        F.when(F.col("since_ms").isNotNull(), format_gap(F.col("since_ms"))).alias("since"),
        F.coalesce(F.array_max(F.transform(F.regexp_extract_all("text", F.lit("`+"), F.lit(0)), F.length)), F.lit(0)).alias("ticks"),
    )
    out = [f"### {title}", ""]
    for r in rows.orderBy("number").collect():
        where = f"[L{r['number']}]({url}#L{r['number']})" if url else f"L{r['number']}"
        when = f" · {r['at']}" if r["at"] else ""
        since = f" ({r['since']})" if r["since"] else ""
        note = f" — {r['note']}" if r["note"] else ""
        fence = "`" * max(3, r["ticks"] + 1)
        text = r["text"] if len(r["text"]) <= 500 else r["text"][:500] + "…"
        out += [f"- **{where}**{when}{since}{note}", f"  {fence}", f"  {text}", f"  {fence}"]
    return "\n".join(out)
