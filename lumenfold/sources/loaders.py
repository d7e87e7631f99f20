"""Sources: a registry of loaders, prompts, mock responses, tasks and parameter grids."""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import strip
from lumenfold.operators.tabular import merge, unit_interval

LOADERS: dict[str, Callable[..., DataFrame]] = {}


def loader(name: str):
    """Register a loader; names are module:function, as callers write them."""
    if ":" not in name:
        raise ValueError(f"{name!r} is not of the form module:function")

    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        LOADERS[name] = fn
        return fn

    return keep


@loader("tables:parquet")
def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


@loader("tables:json")
def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


@loader("tables:csv")
def csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).csv(path)


async def _awaited(value):
    return await value


def load_source(spark: SparkSession, source: dict) -> DataFrame:
    """{"loader": "module:function", "params": {...}} -> its frame; only registered loaders, async ones too, are called."""
    name = source.get("loader") or source.get("function")
    if not name:
        raise ValueError("a source names its loader")
    if ":" not in name:
        raise ValueError(f"{name!r} is not of the form module:function")
    if name not in LOADERS:
        raise ValueError(f"no loader {name!r}; registered: {sorted(LOADERS)}")
    out = LOADERS[name](spark, **source.get("params", {}))
    if inspect.isawaitable(out):
        out = asyncio.run(_awaited(out))
    if not isinstance(out, DataFrame):
        raise TypeError(f"{name} returned {type(out).__name__}, not a DataFrame")
    return out


def load_and_merge(spark: SparkSession, sources: Sequence[dict], strategy: str = "concat", on=None) -> DataFrame:
    return merge([load_source(spark, s) for s in sources], strategy, on, spark)


def mock_response(methods: Sequence[str], prompt: Column) -> Column:
    """A recommendation of the first three methods, with the prompt's length. Its sentences are fixed values."""
    first, second, third = [*methods[:3], *("", "pca", "tsne")[len(methods[:3]) :]]
    lines = (
        "Based on your data description, I would recommend the following analysis methods:\n",
        f"1. **{first.upper()}** - This is an excellent choice for your data structure.",
        f"2. **{second.upper()}** - For dimensionality reduction and visualization.",
        f"3. **{third.upper()}** - As an alternative visualization approach.\n",
        "These methods are well-suited for analyzing the patterns in your dataset.",
    )
    return F.concat(F.lit("\n".join(lines) + "\nMock adapter response (prompt length: "), F.length(prompt).cast("string"), F.lit(" chars).\n"))


def mock_results(prompts: DataFrame, system: str = "mock", methods: Sequence[str] = ("leiden", "umap", "pca"), response: str | None = None, fail_rate: float = 0.0, seed: int = 0) -> DataFrame:
    """(prompt_id, text) -> system, prompt_id, success, summary, error, raw_response.

    A share fail_rate of the prompts, by a hash of their ids, fails. Answers come at once: a delay is left to real models.
    """
    failed = unit_interval(F.lit(str(seed)), F.col("prompt_id").cast("string")) < fail_rate
    said = F.lit(response) if response is not None else mock_response(methods, F.coalesce("text", F.lit("")))
    # Texts of the two summaries are fixed values.
    rows = prompts.select(F.lit(system).alias("system"), F.col("prompt_id").cast("string").alias("prompt_id"), (~failed).alias("success"), F.when(~failed, said).alias("raw_response"))
    summary = F.when(F.col("success"), F.concat(F.lit("Mock response generated ("), F.length("raw_response").cast("string"), F.lit(" chars)"))).otherwise("Simulated failure (mock adapter)")
    return rows.select("system", "prompt_id", "success", summary.alias("summary"), F.when(~F.col("success"), "simulated failure").alias("error"), "raw_response")


def evaluate_grid(prompts: DataFrame, systems: DataFrame) -> DataFrame:
    """One row a prompt and system: both are lists of an evaluation's design."""
    return prompts.crossJoin(systems)


def valid_response(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def answer(c: Column) -> Column:
    """What follows the last mark of an answer."""
    return strip(F.element_at(F.split(c, r"\Q####\E", -1), -1))


def tasks(rows: DataFrame, order: str, n: int, prefix: str = "gsm8k_train_", domain: str = "math", logic: str = "arithmetic") -> DataFrame:
    """(question, answer) -> the first n by `order` as task_id, prompt, expected_answer, domain, logic_type."""
    first = rows.orderBy(F.col(order).asc_nulls_last()).limit(n)
    numbered = first.withColumn("i", F.row_number().over(Window.orderBy(F.col(order).asc_nulls_last())) - 1)  # n rows, in one task
    return numbered.select(F.concat(F.lit(prefix), F.col("i").cast("string")).alias("task_id"), F.col("question").alias("prompt"), answer(F.col("answer")).alias("expected_answer"), F.lit(domain).alias("domain"), F.lit(logic).alias("logic_type"))


#: Named sets of vectors: (spark, folder of tables) -> id, state.
DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "embeddings": lambda spark, folder: spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("state")),
}


def load_vectors(spark: SparkSession, data: str | DataFrame | Sequence[Sequence[float]], folder: str = "") -> DataFrame:
    """id, state: a named set, or what is given: a frame that has both columns, or rows of numbers, by their order."""
    if isinstance(data, DataFrame):
        return data.select("id", "state")
    if isinstance(data, str):
        if data not in DATASETS:
            raise ValueError(f"unknown dataset {data!r}; one of {sorted(DATASETS)}")
        return DATASETS[data](spark, folder)
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "id long, state array<double>")


def variants(metric: str, params: dict[str, object]) -> list[tuple[str, dict[str, object]]]:
    """(name, parameters) of each combination of listed values; single values don't enter the name."""
    out: list[tuple[str, dict[str, object]]] = [(metric, {})]
    for key, value in params.items():
        many = isinstance(value, (list, tuple))
        out = [(f"{name}__{key}_{v}" if many else name, own | {key: v}) for name, own in out for v in (value if many else [value])]
    return out


def metric_spec(spec: str | dict) -> tuple[str, dict]:
    if isinstance(spec, str):
        return spec, {}
    if isinstance(spec, dict) and len(spec) == 1:
        ((name, params),) = spec.items()
        return name, dict(params or {})
    raise ValueError(f"a metric is a name or one name with parameters, not {spec!r}")


def task_config(config: object, system: str) -> dict:
    if not isinstance(config, dict):
        raise ValueError(f"{system}: a task's settings are a dict, not {type(config).__name__}")
    return config


def geometry_config(config: dict, has_input: bool = False) -> dict:
    """Settings name data (unless vectors are given) and algorithms, or a pipeline, which has both."""
    if not (config.get("pipeline") or "data" in config or has_input):
        raise ValueError("settings need 'data' or 'pipeline', or vectors as input")
    if not (config.get("pipeline") or "algorithms" in config):
        raise ValueError("settings need 'algorithms' or 'pipeline'")
    if "algorithms" in config and not isinstance(config["algorithms"], dict):
        raise ValueError(f"'algorithms' is a dict, not {type(config['algorithms']).__name__}")
    return config


def projected(config: dict, known: Sequence[str]) -> tuple[dict, list[str]]:
    """-> (settings that an agent knows, names of those that it doesn't)."""
    return {k: v for k, v in config.items() if k in known}, sorted(set(config) - set(known))


def composed(read: Callable[[str], dict], name: str, over: dict | None = None) -> dict:
    """Settings `name` on top of those that its list `defaults` names, in order, a group's under the group's name;
    `_self_` in the list says where its own come in, else last. `over` wins."""
    own = dict(read(name))
    parts = list(own.pop("defaults", []))
    out: dict = {}
    for part in [*parts, *([] if "_self_" in parts else ["_self_"])]:
        if part == "_self_":
            out = deep_merge(out, own)
        elif isinstance(part, dict):
            for group, choice in part.items():
                out = deep_merge(out, {group: composed(read, f"{group}/{choice}")} if choice is not None else {})
        else:
            out = deep_merge(out, composed(read, part))
    return deep_merge(out, over or {})


def deep_merge(base: dict, over: dict) -> dict:
    """Nested settings; the second's values win, leaves whole."""
    out = dict(base)
    for key, value in over.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def dotted(settings: dict, prefix: str = "") -> dict[str, object]:
    """Nested settings as flat dotted keys."""
    out: dict[str, object] = {}
    for key, value in settings.items():
        name = f"{prefix}{key}"
        out |= dotted(value, f"{name}.") if isinstance(value, dict) else {name: value}
    return out
