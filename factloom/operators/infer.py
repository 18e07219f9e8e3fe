"""Models behind a small protocol: deciders, advisors, and the decisions made of their answers.

No model ships with this package. A backend is anything with `generate(items) -> answers`; it is built once a
Python worker and gets whole Arrow batches, so a batch of the engine is a batch of the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as tx


class Backend(Protocol):
    def generate(self, items: list[dict]) -> list[str]: ...


class Echo:
    """Answers with the prompt's last line: for tests."""

    def generate(self, items: list[dict]) -> list[str]:
        return [(x.get("prompt") or "").rstrip().rpartition("\n")[2] for x in items]


@dataclass
class Scripted:
    """Answers from a table of prompts: for tests."""

    answers: dict[str, str]
    default: str = ""

    def generate(self, items: list[dict]) -> list[str]:
        return [self.answers.get(x["prompt"], self.default) for x in items]


BACKENDS: dict[str, Callable[..., Backend]] = {"echo": Echo, "scripted": Scripted}
ADVISORS: dict[str, tuple[str, Callable[..., Backend]]] = {}
_built: dict[str, Backend] = {}


def register_advisor(name: str, scope: str, build: Callable[..., Backend]) -> None:
    """scope: the evidence type that the advisor reads, or `all`."""
    if scope not in ("table", "figure", "all"):
        raise ValueError(f"no such scope: {scope}")
    ADVISORS[name] = (scope, build)


def infer(requests: DataFrame, build: Callable[[], Backend], name: str, columns: list[str]) -> DataFrame:
    """requests with `answer` and `error`; an exception of the backend is the batch's error, not the job's.

    Rows are filtered and pruned before: nothing is pushed through this call. Write the result before using it twice, or the
    model runs twice.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _built:
            _built[name] = build()
        backend = _built[name]
        for f in frames:
            try:
                yield f.assign(answer=pd.Series(backend.generate(f[columns].to_dict("records")), dtype="object", index=f.index), error=None)
            except Exception as e:  # noqa: BLE001
                yield f.assign(answer=None, error=f"{type(e).__name__}: {e}")

    return requests.mapInPandas(run, f"{fields}, answer string, error string")


def advise(images: DataFrame, advisor: str) -> DataFrame:
    """Cache rows (image_path, advisor, evi_type, text) of the images in the advisor's scope; failed ones give no row."""
    scope, build = ADVISORS[advisor]
    rows = images if scope == "all" else images.where(F.col("evi_type") == scope)
    done = infer(rows, build, f"advisor:{advisor}", ["image_path"]).where("error is null")
    return done.select("image_path", F.lit(advisor).alias("advisor"), "evi_type", F.col("answer").alias("text"))


def decide_pair(one: Column, two: Column, joint: Column) -> Column:
    """(label, mode) of two single verdicts: exactly one Supported decides; else the joint answer does, else the default."""
    a, b = one.eqNullSafe(F.lit("Supported")), two.eqNullSafe(F.lit("Supported"))
    label = F.when(a & ~b, "evidence_id_1").when(b & ~a, "evidence_id_2").otherwise(F.coalesce(joint, F.lit(tx.DEFAULTS["task2"])))
    return F.struct(label.alias("label"), F.when(a != b, "decisive").otherwise("fallback").alias("mode"))


def mode_counts(decided: DataFrame) -> DataFrame:
    """How many decisions were made in each mode, and how many of them are right where a gold label stands beside."""
    right = F.count_if(F.col("label") == F.col("gold_label")) if "gold_label" in decided.columns else F.lit(None).cast("bigint")
    return decided.groupBy("mode").agg(F.count("*").alias("n"), right.alias("right"))


def debug_rows(rows: DataFrame, key: str, one: Column, two: Column, joint: Column) -> DataFrame:
    """(key, mode, one, two, joint, label, calls): what led to each decision, to be written beside the predictions."""
    decided = decide_pair(one, two, joint)
    calls = F.when(needs_joint(one, two), 3).otherwise(2)
    return rows.select(key, decided["mode"].alias("mode"), one.alias("one"), two.alias("two"), joint.alias("joint"), decided["label"].alias("label"), calls.alias("calls"))


def needs_joint(one: Column, two: Column) -> Column:
    """Whether the joint call has to be made at all: only the ties are sent to the model again."""
    a, b = one.eqNullSafe(F.lit("Supported")), two.eqNullSafe(F.lit("Supported"))
    return a == b


def figure_class(reply: Column) -> Column:
    """(num_panels, type, confidence) of a model's JSON reply; type parse_error where there is none."""
    parsed = F.from_json(tx.json_block(reply), "num_panels int, type string, confidence double")
    return F.struct(parsed["num_panels"].alias("num_panels"), F.coalesce(parsed["type"], F.lit("parse_error")).alias("type"), F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"))


def normalized_claims(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Answers without thinking and outer quotes; SKIP and empty ones are dropped, so a later run asks again."""
    clean = tx.strip(tx.strip_quotes(tx.strip_thinking(F.col(answer))))
    return answers.withColumn("claim", clean).where(~tx.is_skip(F.col("claim")))
