"""What an evaluation leaves behind: results, a summary, responses as text files, and logs of numbers.

Everything is written by Spark's writers, in whatever store the folder lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import evaluate
from lumenfold.session import cut
from lumenfold.sources.loaders import valid_response

#: What the three numbers of the summary say, and what they don't.
READING = (
    "- **Jaccard (Invariance):** how much the method sets of a system's successful prompts overlap, averaged over all pairs of prompts, those of one geometry included. It describes; it is nothing to maximise. Two empty sets overlap fully.",
    "- **Ground Truth Match:** share of successful prompts with an expected method and no failing one. Locally rejected names don't count.",
    "- **Clustering-for-All:** share of successful prompts with a clustering method or phrase. Read it with the numbers of prompts evaluated and failed.",
)


def write_text(lines: DataFrame, folder: str) -> None:
    """One row, one column of text, as one file."""
    lines.coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(folder)


def summary_page(metrics: DataFrame, name: str, experiment: str, timestamp: str) -> DataFrame:
    """One row, `value`: a heading, the table, and how to read it."""
    head = f"# {name}\n\n**Experiment ID:** {experiment}\n**Timestamp:** {timestamp}\n\n## Results\n\n"
    tail = "\n\n## Interpretation\n\n" + "\n".join(READING) + "\n"
    return evaluate.summary_table(metrics).select(F.concat(F.lit(head), "summary", F.lit(tail)).alias("value"))


def save_results(results: DataFrame, prompts: DataFrame, folder: str, name: str = "LLM Evaluation", experiment: str = "", timestamp: str = "") -> DataFrame:
    """results as JSON lines in results/, metrics in metrics/, the page in summary/ -> the metrics.

    The results are written first and read again, so that what made them runs once.
    """
    spark = results.sparkSession
    results.write.mode("overwrite").json(f"{folder}/results", ignoreNullFields=False)
    kept = spark.read.schema(results.schema).json(f"{folder}/results")
    metrics = cut(evaluate.system_metrics(kept, prompts))
    metrics.write.mode("overwrite").json(f"{folder}/metrics", ignoreNullFields=False)
    write_text(summary_page(metrics, name, experiment, timestamp), f"{folder}/summary")
    return metrics


def read_results(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/results")


def printed(metrics: DataFrame) -> DataFrame:
    """system, text: the block of each system on a console."""
    line = lambda name, c, spec, note: F.concat(F.lit(f"  {name}: "), evaluate.format_metric(F.col(c), spec), F.lit(f" ({note})"))
    return metrics.select("system", F.concat_ws("\n", F.concat("system", F.lit(":")), line("Jaccard Similarity", "jaccard_similarity_across_prompts", ".2f", "all successful pairs; not an optimization objective"), line("Ground Truth Match", "ground_truth_match_rate", ".1%", "higher is better"), line("Clustering-for-All", "clustering_for_all_rate", ".1%", "lower is better")).alias("text"))


def save_responses(results: DataFrame, folder: str) -> None:
    """Responses (system, prompt_id, raw_response) as text below system=/prompt_id=; rows without one leave no file.

    A system's and prompt's responses go to one file each where they are few, by a shuffle on both.
    """
    own = results.where(F.col("raw_response").isNotNull()).select("system", "prompt_id", F.col("raw_response").alias("value"))
    # A mark between responses lets several of one prompt be told apart again.
    own.repartition("system", "prompt_id").write.mode("overwrite").partitionBy("system", "prompt_id").option("lineSep", MARK).text(folder)


#: Ends a response in a file.
MARK = "\x1e\n"


def read_responses(spark: SparkSession, folder: str) -> DataFrame:
    """system, prompt_id, raw_response, as saved."""
    return spark.read.option("lineSep", MARK).schema("value string, system string, prompt_id string").text(folder).select("system", "prompt_id", F.col("value").alias("raw_response"))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """path, raw_response, valid: each file below a path as one response; an empty one, or one of blanks, isn't valid."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_response"), valid_response(F.col("value")).alias("valid"))


def save_artifact(results: DataFrame, folder: str, experiment: str) -> str:
    """Responses and results of an experiment in one folder, whose path is given back."""
    place = f"{folder}/responses_{experiment}"
    save_responses(results, f"{place}/raw_responses")
    results.write.mode("overwrite").json(f"{place}/results", ignoreNullFields=False)
    return place


def log_scalars(rows: DataFrame, folder: str | None) -> DataFrame:
    """(metric, value) rows that have a value, appended to a folder's log; without a folder nothing is written."""
    known = rows.where(F.col("value").isNotNull())
    if folder is not None:
        known.write.mode("append").json(folder)
    return known


def save_embeddings(states: DataFrame, folder: str, step: int) -> str:
    """The vectors after one step of a sequence, and where they are."""
    place = f"{folder}/step={step}"
    states.write.mode("overwrite").parquet(place)
    return place
