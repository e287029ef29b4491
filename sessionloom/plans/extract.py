"""The main plan: transcripts to ledgers, constraints, segments and a document, as sibling tables of one scan."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from sessionloom.operators import events as E
from sessionloom.operators import ledgers as L
from sessionloom.operators import masking as M
from sessionloom.operators import render, segment, triage
from sessionloom.sources import transcripts


@dataclass(frozen=True)
class Options:
    mode: str = "default"
    bad_line_rate: float = 0.02
    since_compaction: bool = False
    keep_reasoning: bool = False
    sidechains: bool = False
    min_episode: int = segment.EPISODE
    chunk: int = segment.CHUNK
    tail: int = segment.TAIL


def extract(spark: SparkSession, path: str, options: Options | None = None) -> dict[str, DataFrame]:
    """Name -> table, for every session below ``path``.  The events are persisted, as all other tables read them."""
    o = options or Options()
    lines = transcripts.raw_lines(spark, path, hashed=False)
    found = E.events(lines, o.bad_line_rate)
    found = (E.since_compaction(found) if o.since_compaction else found).persist()
    files, runs = L.files(found), L.commands(found, o.mode)
    errors = L.errors(found, runs, o.mode)
    plans = L.plan(found)
    rules = triage.constraints(found, L.vocabulary(files), o.mode)
    rows = M.masked_rows(found, o.mode, o.keep_reasoning, sidechains=o.sidechains)
    episodes = segment.split_oversized(rows, segment.episodes(rows, o.min_episode), o.chunk)
    marked = segment.tail(episodes, o.tail)
    tail = marked.where("in_tail").groupBy("session_key").agg(F.min("row_start").alias("from"))
    recent = segment.positions(rows).join(tail, "session_key").where(F.col("pos") >= F.col("from"))
    commits, facts = L.git(runs)
    out = {
        "events": found, "files": files, "edit_outcomes": L.edit_outcomes(found), "commands": runs, "errors": errors, "plan": plans, "messages": L.messages(found, o.mode), "commits": commits, "git": facts,
        "constraints": rules, "masked_rows": rows, "episodes": marked, "chunks": segment.chunks(marked.where("NOT in_tail"), o.chunk), "tail": recent.drop("from"),
    }
    out["document"] = render.document(found, rules, files, runs, errors, plans, recent)
    return out


def write(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Each table as Parquet, or JSON lines, in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{name}")


def projected(tables: dict[str, DataFrame]) -> DataFrame:
    """session_key, json: the rows of each table, without the key, as one object for each session; tables are sorted by their rows, and one without rows of the session is an empty list."""
    out = None
    for name, df in tables.items():
        row = F.struct(*[c for c in df.columns if c != "session_key"])
        own = df.groupBy("session_key").agg(F.array_sort(F.collect_list(row)).alias(name))
        out = own if out is None else out.join(own, "session_key", "full")
    filled = [F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType)).alias(name) for name in tables]
    return out.select("session_key", F.to_json(F.struct(*filled)).alias("json"))


def schemas(tables: dict[str, DataFrame]) -> dict[str, str]:
    """Name -> the table's schema as JSON."""
    return {name: df.schema.json() for name, df in tables.items()}


def read_back(spark: SparkSession, path: str, written: dict[str, str], form: str = "parquet") -> dict[str, DataFrame]:
    """The tables that ``write`` left, by the schemas of ``schemas``."""
    return {name: spark.read.format(form).schema(StructType.fromJson(json.loads(s))).load(f"{path}/{name}") for name, s in written.items()}


def unprojected(found: DataFrame, name: str, schema: str) -> DataFrame:
    """One table out of ``projected``, by its schema as JSON."""
    fields = StructType([f for f in StructType.fromJson(json.loads(schema)) if f.name != "session_key"])
    rows = F.from_json(F.get_json_object("json", f"$.{name}"), ArrayType(fields))
    return found.select("session_key", F.explode(rows).alias("r")).select("session_key", "r.*")
