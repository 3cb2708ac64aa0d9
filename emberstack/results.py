"""Answers leave as JSON, or as text for people to read; tasks write both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberstack.recording import Recording

WIDTH = 26  # of a label
SESSION = {"command_line": "Command line", "date": "Date", "runtime_ns": "Runtime (ns)", "processes": "Processes", "threads": "Threads", "samples": "Samples"}
SYSTEM = {"hostname": "Hostname", "platform": "Platform", "cpu_name": "CPU name", "n_processors": "Processors", "architecture": "Architecture"}
SOURCE = {"source_id": "Id", "n": "Samples", "rate": "Samples a second", "has_stacks": "Has stacks"}


def as_json(answer: DataFrame) -> DataFrame:
    """``(value)``, a JSON object for each row, with all of its columns in their order, nulls too."""
    return answer.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def about(recording: Recording) -> dict[str, DataFrame]:
    """What a recording says of itself: session, system, sources and processes."""
    return {"session": recording.session_info(), "system": recording.system_info(), "sources": recording.sample_sources(), "processes": recording.process_report()}


def write_json(answers: dict[str, DataFrame], folder: str) -> None:
    """Each answer as JSON lines in a folder of its name, replaced if there."""
    for name, answer in answers.items():
        as_json(answer).write.mode("overwrite").text(f"{folder}/{name}")


def _line(label: str, value: Column, indent: int = 0) -> Column:
    """A label and its value, or no line for a null."""
    return F.when(value.isNotNull(), F.concat(F.lit(" " * indent + f"{label}:".ljust(WIDTH - indent)), value.cast("string")))


def _block(rows: DataFrame, part: int, order: str | None, lines: list[tuple[Column, bool]]) -> DataFrame:
    """The lines of each row, in the order of a number; each is a text, or several if it says so."""
    said = F.flatten(F.array(*[c if several else F.array(c) for c, several in lines]))
    number = F.lit(0) if order is None else F.col(order)
    each = rows.select(F.struct(F.lit(part).alias("part"), number.cast("long").alias("number")).alias("place"), said.alias("said"))
    return each.select("place", F.posexplode("said").alias("at", "text")).where("text is not null")


def _fields(rows: DataFrame, labels: dict[str, str], indent: int = 0) -> list[tuple[Column, bool]]:
    return [(_line(label, F.col(c), indent), False) for c, label in labels.items() if c in rows.columns]


def _life(of, indent: int, columns: list[str]) -> list[Column]:
    return [_line(label, of(c), indent) for c, label in (("start_ts", "Start"), ("end_ts", "End"), ("context_switches", "Context switches")) if c in columns]


def _samples(of: Column, indent: int) -> Column:
    name = lambda x: F.coalesce(x["source"], F.concat(F.lit("source "), x["source_id"].cast("string")))
    return F.transform(of, lambda x: F.concat(F.lit(" " * indent), F.rpad(F.concat(name(x), F.lit(":")), WIDTH - indent, " "), x["n"].cast("string")))


def summary(recording: Recording) -> DataFrame:
    """``(place, at, text)``: the lines of a report in order: session, system, sources, then each process with its samples, threads and the
    sizes of what it met. Write ``text`` with ``write.text``, or show it; lines of what is unknown are left out."""
    parts = about(recording)
    title = lambda text: (F.lit(text), False)
    blocks = [_block(parts["session"], 0, None, [title("Session"), *_fields(parts["session"], SESSION, 2)]), _block(parts["system"], 1, None, [title("System"), *_fields(parts["system"], SYSTEM, 2)])]
    sources = parts["sources"]
    name = F.col("name") if "name" in sources.columns else F.lit(None).cast("string")
    blocks.append(_block(sources, 2, "source_id", [(F.concat(F.lit("Source "), F.coalesce(name, F.col("source_id").cast("string"))), False), *_fields(sources, SOURCE, 2)]))
    rows = parts["processes"]
    known = rows.schema["threads"].dataType.elementType.names

    def of_thread(x: Column) -> Column:
        number = x["tid"] if "tid" in known else x["thread_id"]
        label = F.concat(F.lit("  Thread "), number.cast("string"), F.coalesce(F.concat(F.lit(" "), x["name"]), F.lit("")) if "name" in known else F.lit(""))
        return F.concat(F.array(label, *_life(lambda c: x[c], 4, known)), _samples(x["samples"], 4))

    number = F.col("pid") if "pid" in rows.columns else F.col("process_id")
    lines = [(F.concat(F.lit("Process "), number.cast("string"), F.coalesce(F.concat(F.lit(" "), F.col("name")), F.lit(""))), False)]
    lines += [(c, False) for c in _life(F.col, 2, rows.columns)] + [(_samples(F.col("samples"), 2), True)]
    lines += _fields(rows, {"n_modules": "Modules", "n_functions": "Functions", "n_files": "Files"}, 2)
    empty = F.array().cast("array<string>")
    lines.append((F.coalesce(F.flatten(F.transform("threads", of_thread)), empty), True))
    blocks.append(_block(rows, 3, "process_id", lines))
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out.orderBy("place", "at")
