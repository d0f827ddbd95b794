"""Export formats of analysed documents, as string columns and as writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import row
from ..plans.pipeline import entity_rows

HEADER = "index,label,text,start,end,score,verified"
#: Format name -> media type.
MEDIA_TYPES = {"json": "application/json", "jsonl": "application/x-ndjson", "csv": "text/csv"}


def export_rows(entities: Column) -> Column:
    """array<struct> with the seven exported fields, numbered from 0, scores rounded to four places."""
    return F.transform(entities, lambda e, i: row(
        index=i.cast("int"), label=e["label"], text=e["text"], start=e["start"], end=e["end"], score=F.round(e["score"], 4), verified=e["verified"]))


def to_json(profile: str = "server") -> Column:
    """The document as pretty JSON: text, stats and entities."""
    counts = F.transform("stats.by_label", lambda x: row(label=x["label"], count=x["count"]))
    short = row(total=F.col("stats.total"), risk=F.col("stats.risk"), characters=F.col("stats.characters"), by_label=counts)
    return F.to_json(F.struct("text", (short if profile == "server" else F.col("stats")).alias("stats"), export_rows(F.col("entities")).alias("entities")), {"pretty": "true"})


def to_jsonl() -> Column:
    """One JSON object a line for each entity; no break at the end."""
    return F.array_join(F.transform(export_rows(F.col("entities")), lambda r: F.to_json(r)), "\n")


def quoted(text: Column, always: bool = False) -> Column:
    inside = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return inside if always else F.when(text.rlike('[",\r\n]'), inside).otherwise(text)


def to_csv(profile: str = "server") -> Column:
    """Header and one line an entity; the browser profile always quotes the text and uses plain line feeds."""
    server = profile == "server"
    flag = lambda v: F.initcap(v.cast("string")) if server else v.cast("string")
    lines = F.transform(export_rows(F.col("entities")), lambda r: F.concat_ws(
        ",", r["index"], r["label"], quoted(r["text"], not server), r["start"], r["end"], r["score"], flag(r["verified"])))
    all_lines = F.concat(F.array(F.lit(HEADER)), lines)
    return F.concat(F.array_join(all_lines, "\r\n"), F.lit("\r\n")) if server else F.array_join(all_lines, "\n")


EXPORTERS = {"json": to_json, "jsonl": lambda profile="server": to_jsonl(), "csv": to_csv}


def format_names() -> list[str]:
    return sorted(EXPORTERS)


def export(analysed: DataFrame, fmt: str, profile: str = "server") -> DataFrame:
    """`analysed` with the column export. An unknown format is refused before any work."""
    if fmt not in EXPORTERS:
        raise ValueError(f"unknown format: {fmt}")
    return analysed.withColumn("export", EXPORTERS[fmt](profile))


def file_name(fmt: str) -> str:
    if fmt not in EXPORTERS:
        raise ValueError(f"unknown format: {fmt}")
    return f"entities.{fmt}"


def write_entities(analysed: DataFrame, path: str, fmt: str, *keys: str) -> None:
    """All entities of a collection as files of one format, written in parallel."""
    rows = entity_rows(analysed, *keys).withColumn("score", F.round("score", 4))
    if fmt == "csv":
        rows.write.csv(path, header=True, quote='"', escape='"')
    elif fmt in ("json", "jsonl"):
        rows.write.json(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def write_dataset(rows: DataFrame, path: str) -> None:
    """Labelled rows (text, entities) as JSON Lines."""
    rows.select("text", "entities").write.json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.select("text").write.text(path)
